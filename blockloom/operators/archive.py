"""Archive members: catalogue, order, grouping by type, and tar and zip archives as rows."""

from __future__ import annotations

import io
import stat
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StructField, StructType

from blockloom.shared import kept, mapped

ENTRY_BYTES = 1024
KEY = 4
ARCHIVE_BYTES, BATCH_BYTES = 16 << 20, 4 << 20
ZIP_MAGIC = (b"PK\x03\x04", b"PK\x05\x06")


def normalized(path: Column) -> Column:
    """Without leading slashes, backslashes and the parent steps between them; a plain leading ../ stays."""
    return F.regexp_replace(path, r"^(?:[/\\](?:\.\.(?=[/\\]))?)+", "")


def listing(members: DataFrame) -> DataFrame:
    """size, the best of mtime, atime, ctime and birth time, and path."""
    times = [c for c in ("mtime", "atime", "ctime", "btime") if c in members.columns]
    date = F.coalesce(*(F.col(c) for c in times)) if times else F.lit(None).cast("timestamp")
    return members.select("size", date.alias("date"), normalized(F.col("path")).alias("path"))


def totals(members: DataFrame) -> DataFrame:
    """Members and their bytes with an entry's overhead."""
    return members.agg(F.count("*").alias("n_members"), F.coalesce(F.sum(F.col("size") + ENTRY_BYTES), F.lit(0)).alias("total_bytes"))


def sort_key(path: Column, size: Column, is_dir: Column) -> dict[str, Column]:
    """flag, key and rank: members without extension by initials of their folders and name, then by extension, then
    folders, the deepest first.

    Without extension the last characters of the key are the initials of the last folders and of the name; if the
    path is less deep, the name's first characters fill it up.
    """
    parts = F.split(path, "/")
    name = F.element_at(parts, -1)
    seps = F.size(parts) - 1
    initials = F.array_join(F.transform(parts, lambda p: F.substring(p, 1, 1)), "")
    # initials of folders (all but the path's own beginning, which no separator precedes), then the name
    folders = F.substring(initials, F.lit(2), F.greatest(seps - 1, F.lit(0)))
    filled = F.concat(folders, F.substring(name, F.lit(1), F.lit(KEY + 1) - F.least(seps, F.lit(KEY))))
    no_ext = F.when(seps < KEY, F.right(filled, F.lit(KEY))).otherwise(F.right(F.concat(folders, F.substring(name, 1, 1)), F.lit(KEY)))
    ext = F.substring(F.substring_index(name, ".", -1), 1, KEY)
    has = F.instr(name, ".") > 0
    return {
        "flag": F.when(is_dir | has, 1).otherwise(0),
        "key": F.when(is_dir, F.lit("\U0010ffff" * KEY)).when(has, ext).otherwise(no_ext),
        "rank": F.when(is_dir, F.lit((1 << 63) - 1) - seps).otherwise(size.cast("long")),
    }


def ordered(members: DataFrame, clustered_only: bool = False) -> DataFrame:
    """members in archive order; with clustered_only equal keys are together but ranges are not merged into one order."""
    keys = sort_key(F.col("path"), F.col("size"), F.coalesce(F.col("is_dir"), F.lit(False)) if "is_dir" in members.columns else F.lit(False))
    rows = members.withColumns(keys)
    if clustered_only:
        return rows.repartitionByRange("flag", "key", "rank", "path").sortWithinPartitions("flag", "key", "rank", "path")
    return rows.orderBy("flag", "key", "rank", "path")


def type_groups(members: DataFrame, part: str, order: list[str], kind: str) -> DataFrame:
    """Runs of members of one type within a part: part, group_no, kind, n, bytes.

    Ranges of (part, order) are cells, so a part of any size is spread over tasks. Runs are found and summed inside the
    cells; the small table of a cell's first and last kind and number of runs says whether a run goes on from the cell
    before, and which number it has. The cells are checkpointed, since another run could draw other bounds.
    """
    by = [*order, kind]
    rows = kept(members.select(F.col(part).alias("_part"), *by, "size").repartitionByRange("_part", *by).withColumn("_cell", F.spark_partition_id()))
    inside = Window.partitionBy("_part", "_cell").orderBy(*by)
    changed = (F.row_number().over(inside) > 1) & ~F.col(kind).eqNullSafe(F.lag(kind).over(inside))
    rows = rows.withColumn("_new", changed.cast("long")).withColumn("_run", F.sum("_new").over(inside))
    runs = rows.groupBy("_part", "_cell", "_run").agg(F.first(kind).alias("kind"), F.count("*").alias("n"), F.sum("size").alias("bytes"))
    ends = runs.groupBy("_part", "_cell").agg(F.min_by("kind", "_run").alias("_head"), F.max_by("kind", "_run").alias("_tail"), F.max("_run").alias("_more"))
    cells = Window.partitionBy("_part").orderBy("_cell")  # a row for each cell of a part
    opens = (F.row_number().over(cells) == 1) | ~F.col("_head").eqNullSafe(F.lag("_tail").over(cells))
    ends = ends.withColumn("_opens", opens.cast("long"))
    ends = ends.select(F.col("_part").alias("_p"), F.col("_cell").alias("_c"), (F.sum(F.col("_opens") + F.col("_more")).over(cells) - F.col("_more")).alias("_from"))
    runs = runs.join(ends, (F.col("_cell") == F.col("_c")) & F.col("_part").eqNullSafe(F.col("_p"))).withColumn("group_no", F.col("_from") + F.col("_run"))
    return runs.groupBy(F.col("_part").alias(part), "group_no").agg(F.first("kind").alias("kind"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))


def type_cuts(members: DataFrame, part: str, order: str, kind: str, least: int) -> DataFrame:
    """As type_groups, but a group is closed only when it has `least` bytes.

    Whether a member opens a group depends on all before it, so a part is folded in one task; that task reads its sorted
    members (part, order, kind, size) batch by batch and holds one open group.
    """
    schema = members.select(part, kind).schema
    types = [(part, schema[part].dataType), ("group_no", LongType()), ("kind", schema[kind].dataType), ("n", LongType()), ("bytes", LongType())]
    schema = StructType([StructField(*t) for t in types])
    arrow = to_arrow_schema(schema)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list | None = None
        for batch in batches:
            done = []
            for p, t, size in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                if group is None or group[0] != p or group[2] != t and group[4] >= least:
                    if group:
                        done.append(group)
                    group = [p, group[1] + 1 if group and group[0] == p else 1, t, 0, 0]
                group[3] += 1
                group[4] += size
            if done:
                yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, g, strict=True)) for g in done], arrow)
        if group:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, group, strict=True))], arrow)

    rows = members.select(part, order, kind, F.col("size").cast("long").alias("size"))
    return rows.repartition(part).sortWithinPartitions(part, order, kind).transform(mapped, fold, schema)


def archive_count(members: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> int:
    """How many archives members (data) make if each has about archive_bytes."""
    total = totals(members.select(F.octet_length("data").cast("long").alias("size"))).first()["total_bytes"]
    return max(1, -(-total // archive_bytes))


def tar_bytes(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode="w", format=tarfile.PAX_FORMAT) as tar:
        for path, data in members:
            info = tarfile.TarInfo(path)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    return out.getvalue()


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as packed:
        for path, data in members:
            packed.writestr(zipfile.ZipInfo(path), data, zipfile.ZIP_DEFLATED)  # a fixed date, so that reruns agree
    return out.getvalue()


def _packed(members: DataFrame, archives: int, write: Callable[[list[tuple[str, bytes]]], bytes]) -> DataFrame:
    rows = members.withColumn("archive_no", F.pmod(F.xxhash64("path"), F.lit(archives)).cast("int"))

    def pack(table: pa.Table) -> pa.Table:
        data = write(sorted(zip(table["path"].to_pylist(), table["data"].to_pylist(), strict=True)))
        return pa.table({"archive_no": table["archive_no"][:1], "data": pa.array([data], pa.binary())})

    return rows.select("archive_no", "path", "data").groupBy("archive_no").applyInArrow(pack, "archive_no int, data binary")


def tar_archives(members: DataFrame, archives: int) -> DataFrame:
    """members (path, data) packed into so many pax archives: archive_no, data."""
    return _packed(members, archives, tar_bytes)


def zip_archives(members: DataFrame, archives: int) -> DataFrame:
    """members (path, data) packed into so many zip archives: archive_no, data."""
    return _packed(members, archives, zip_bytes)


def opened(data: bytes) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of the plain files of a zip or tar archive, told by its first bytes."""
    if data[:4] in ZIP_MAGIC:
        with zipfile.ZipFile(io.BytesIO(data)) as packed:
            for z in packed.infolist():
                if not z.is_dir() and not stat.S_ISLNK(z.external_attr >> 16):
                    yield z.filename, packed.read(z)
    else:
        with tarfile.open(fileobj=io.BytesIO(data)) as tar:
            for m in tar:
                if m.isfile():
                    yield m.name, tar.extractfile(m).read()


def archive_members(archives: DataFrame) -> DataFrame:
    """path, size and data of the plain files in archives (data); links and paths that lead out are left out."""
    schema = pa.schema([("path", pa.string()), ("size", pa.int64()), ("data", pa.binary())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                found, held = [], 0
                for path, body in opened(data.as_py()):
                    if path.startswith("/") or ".." in path.split("/"):
                        continue
                    found.append((path, len(body), body))
                    held += len(body)
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)
                        found, held = [], 0
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), schema.types, strict=True)], schema=schema)

    return archives.select("data").transform(mapped, unpack, "path string, size long, data binary")


tar_members = archive_members
