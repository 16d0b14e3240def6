"""Shared helpers of the training-data operators: scratch tables, size-checked broadcasts, row locators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..operators.joins import skew_join

#: Largest table that an operator broadcasts itself; beyond it the plan shuffles (or works in blocks).
BROADCAST_BYTES = 64 << 20
#: Bytes of text that a Python worker has in hand at once; what it makes of them takes several times as much.
SLICE = 1 << 20


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Only a local session (tests) without that setting gets a temporary folder.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="tessera-llm-")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


class Scratch:
    """A folder of intermediate tables under the shared folder.

    Tables cut the lineage: a lost executor re-reads files and never repeats the work
    before them.  ``drop`` deletes one table when nothing reads it any more, ``close`` all;
    what is still there when the driver ends is deleted then.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        self.places: list[tuple[str, str]] = []
        path, files = self._files(self.path)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def place(self, name: str) -> str:
        """A path for a table; every call gives another one."""
        self.places.append((name, f"{self.path}/{name}-{len(self.places)}"))
        return self.places[-1][1]

    def write(self, df: DataFrame, name: str) -> str:
        path = self.place(name)
        df.write.parquet(path)
        return path

    def table(self, df: DataFrame, name: str) -> DataFrame:
        return self.spark.read.schema(df.schema).parquet(self.write(df, name))

    def drop(self, name: str) -> None:
        """Deletes the tables of that name."""
        for own, path in self.places:
            if own == name:
                self._delete(path)

    def _delete(self, path: str) -> None:
        path, files = self._files(path)
        files.delete(path, True)

    def _files(self, path: str) -> tuple:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def close(self) -> None:
        """Deletes all of them; nothing may read them any more."""
        self._delete(self.path)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df``, marked for broadcast if ``count * row_bytes`` is within :data:`BROADCAST_BYTES`."""
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST_BYTES else df


def met(big: DataFrame, side: DataFrame, on: str, how: str, row_bytes: int) -> DataFrame:
    """``big`` joined with ``side``: by broadcast if ``side`` is :func:`small`, else with the hot keys of ``big`` salted."""
    if side.count() * row_bytes <= BROADCAST_BYTES:
        return big.join(F.broadcast(side), on, how)
    return skew_join(big, side, on, how)


def located(docs: DataFrame, scratch: Scratch, *cols: str | Column) -> DataFrame:
    """``cols`` of ``docs`` with each row's place (``_file``, ``_row``) in the files it is read from.

    A frame that isn't a plain file scan (a join, an aggregate, rows from memory) is written
    to a scratch table first, so that its places are fixed.
    """
    try:
        return places(docs, *cols)
    except AnalysisException:
        return places(scratch.table(docs.select(*cols), "rows"), "*")


def places(docs: DataFrame, *cols: str | Column) -> DataFrame:
    """:func:`located` for a file scan; an error for any other frame.  A column of the files may be called _metadata."""
    own = docs.metadataColumn("_metadata")
    return docs.select(*cols, own.getField("file_path").alias("_file"), own.getField("row_index").alias("_row"))


def fixed(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` if it is a file scan, else a scratch table of it: its places are the same at every later use."""
    try:
        places(docs)
        return docs
    except AnalysisException:
        return scratch.table(docs, "docs")


def without(docs: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs``, all its columns whatever their names, without the rows at the places (_file, _row) in ``gone``.

    ``docs`` is :func:`fixed`, and ``gone`` was found in that same frame.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    gone = scratch.table(gone.select(F.col("_file").alias("_f"), F.col("_row").alias("_r")), "gone")
    on = (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r"))
    return places(docs, whole).join(small(gone, 256), on, "left_anti").select("row.*")


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id's decimal text, modulo ``n`` (a null id counts as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def running(df: DataFrame, groups: list[str], order: list[str], value: Column, out: str, scratch: Scratch) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the group up to and with this row.

    No group meets in one task: rows are range-partitioned by (group, order) and fixed in a
    scratch table, summed within each partition, and the sums of the partitions before are
    added (one row per partition and group).
    """
    keys = [*groups, *order]
    ranged = df.withColumn("_v", value).repartitionByRange(*keys).withColumn("_pid", F.spark_partition_id())
    fixed = scratch.table(ranged, out)
    sums = fixed.groupBy(*groups, "_pid").agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(*groups, "_pid", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    local = Window.partitionBy(*groups, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = fixed.withColumn("_l", F.sum("_v").over(local)).withColumnRenamed("_pid", "_p")
    base = base.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], "_pid", "_base")
    on = [F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)] + [F.col("_p") == F.col("_pid")]
    joined = rows.join(small(base, 64), on)
    return joined.select(*df.columns, (F.col("_l") + F.col("_base")).alias(out))


class Recent(dict):
    """What ``make`` gives for recent keys, ``limit`` of them at most: when half of that is full the older half goes."""

    def __init__(self, make: Callable, limit: int):
        super().__init__()
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
        if 2 * len(self) >= self.limit:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


def slices(batches: Iterator[pa.RecordBatch], text: str, limit: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the ``text`` column of each holds about ``limit`` bytes, one row at least."""
    for b in batches:
        step = max(1, int(b.num_rows * limit / max(1, b.column(b.schema.get_field_index(text)).nbytes)))
        for at in range(0, b.num_rows, step):
            yield b.slice(at, step)


def portions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """:func:`slices` of :data:`SLICE` bytes; what Arrow needed for the one before goes back to the system, as many workers share a machine's memory."""
    for b in slices(batches, "text", SLICE):
        yield b
        pa.default_memory_pool().release_unused()
