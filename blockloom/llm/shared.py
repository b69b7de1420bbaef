"""The folder that all executors share, columns carried along, and memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from blockloom.llm import text

CARRIED = "_carried"
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def carried(df: DataFrame, used: Iterable[str], made: Iterable[str] = ()) -> tuple[DataFrame, Callable[[DataFrame], list]]:
    """df with its used columns and all others, but for those that made replaces, in one struct.

    No name among the others can then clash with a column that an operator makes. The function gives, for a table that
    still has the struct, the columns of df that are not replaced, in their order.
    """
    used, made = list(used), {m.lower() for m in made}
    names = [c for c in df.columns if c.lower() not in made]
    rest = [c for c in names if c not in used]
    held = df.select(*used, *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias(CARRIED)] if rest else []))
    return held, lambda out: [F.col(c) if c in used else F.col(CARRIED).getField(c).alias(c) for c in names if c in rest or c in out.columns]


def extended(df: DataFrame, new: str) -> StructType:
    """The schema of df and of new columns, which are given as text."""
    return StructType([*(StructField(f.name, f.dataType) for f in df.schema), *StructType.fromDDL(new)])


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which the Python worker, which Spark keeps for later tasks, gives freed memory back to the system."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        text.forget()
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except (AttributeError, OSError):  # another C library
            pass

    return wrapped


def mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str) -> DataFrame:
    """df through run, tidied, in Arrow batches of about BATCH_BYTES or of one row.

    Every running task holds a batch in the JVM and again in the Python worker. The bound is the session's setting, which
    Spark reads when the query runs; a session that has set its own keeps it.
    """
    spark = df.sparkSession
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInArrow(tidied(run), schema)


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where it is unset, and the executors are local, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = held.get() if held.isDefined() else None
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset; on a cluster it has to name a folder that all executors share")
        found = tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(found)
    return found


def checkpoint(df: DataFrame) -> DataFrame:
    """df computed once and kept in the shared folder, without its lineage.

    The collection of garbage lets the context cleaner remove shuffle files that the cut lineage alone needed.
    """
    checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    gc.collect()
    df.sparkSession._jvm.System.gc()
    return out


def dropped(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's own in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
