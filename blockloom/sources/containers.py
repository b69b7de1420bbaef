"""Containers of encoded chunks: a header, chunks in order, and a table of members with its own codec.

A container is a folder: `header` (one row), `chunks` (Parquet, sorted by stream and chunk inside its files, whose ranges
do not overlap) and `members` (Parquet, gzip), if any. Spark's commit protocol makes each appear whole or not; the header
is written last, so a folder without one is not a container.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from blockloom.config import CODECS, MIN_CHUNK, Config

log = logging.getLogger("blockloom")
VERSION, READABLE = 10, range(6, 11)


def write(encoded: DataFrame, path: str, config: Config, members: DataFrame | None = None) -> None:
    spark = encoded.sparkSession
    ordered = encoded.repartitionByRange("stream_id", "chunk_no").sortWithinPartitions("stream_id", "chunk_no")
    ordered.write.mode("overwrite").parquet(f"{path}/chunks")
    if members is not None:
        members.write.mode("overwrite").option("compression", "gzip").parquet(f"{path}/members")
    header = [(VERSION, config.codec, config.level, config.chunk_size, config.dedupe, config.digest, members is not None)]
    spark.createDataFrame(header, "version int, codec string, level int, chunk_size long, dedupe string, digest string, members boolean").coalesce(1).write.mode("overwrite").parquet(f"{path}/header")
    log.info("wrote container %s", path)


def header(spark: SparkSession, path: str) -> dict:
    """The header's fields; ValueError for what no reader of this version can read."""
    rows = spark.read.parquet(f"{path}/header").limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"{path} has {len(rows) or 'no'} header rows")
    found = rows[0].asDict()
    for bad, what in (
        (found["version"] not in READABLE, f"unreadable version {found['version']}"), (found["codec"] not in CODECS, f"unknown codec {found['codec']}"),
        (not 0 <= found["level"] <= 14, f"level {found['level']}"), (found["chunk_size"] and found["chunk_size"] < MIN_CHUNK, f"chunks of {found['chunk_size']} bytes"),
    ):
        if bad:
            raise ValueError(what)
    return found


def read(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame | None]:
    """Header, encoded chunks and members of a container."""
    found = header(spark, path)
    return found, spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/members") if found["members"] else None


def timed(n_bytes: int, step: Callable[[], object], clock: Callable[[], float] = time.monotonic) -> tuple[object, float]:
    """What step gives, and its throughput in MB a second."""
    start = clock()
    out = step()
    rate = n_bytes / 2**20 / max(clock() - start, 1e-9)
    log.info("%.1f MB/s", rate)
    return out, rate
