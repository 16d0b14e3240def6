"""Writers: context tables, prompts, epoch metrics.

Tables are written as tables, not as one file per image or question (millions of
tiny files do not scale); :func:`export_text_files` reproduces the one-file-per-
question layout on request, written by the executors in parallel and committed as a whole.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.grid import grid_pivot
from ..operators.joins import ensure_unique
from .text_files import TextFilesSource


def write_context(area: DataFrame, path: str, wide: bool = False, mode: str = "overwrite") -> None:
    """Context table, long (default) or wide (``Grid`` + 43 class columns), sorted by image inside
    each file so readers can skip row groups by ``img_name``."""
    out = grid_pivot(area) if wide else area
    out.sortWithinPartitions("img_name").write.mode(mode).parquet(path)


def write_context_table(area: DataFrame, table: str, buckets: int, mode: str = "overwrite") -> None:
    """Context table saved bucketed and sorted by ``img_name``: joins to questions and per-image
    aggregations read it co-partitioned, without shuffling the table."""
    area.write.mode(mode).bucketBy(buckets, "img_name").sortBy("img_name", "grid_ord", "class_ord").saveAsTable(table)


def write_prompts(prompts: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``index, text`` as parquet."""
    prompts.select("index", "text").write.mode(mode).parquet(path)


def export_text_files(prompts: DataFrame, folder: str) -> None:
    """One ``<index>.txt`` per question under ``folder``, a path or URI that the driver and all executors share.

    All files appear when the job commits, and none if it fails (:class:`sources.text_files.TextFilesSource`).
    """
    prompts.sparkSession.dataSource.register(TextFilesSource)
    rows = prompts.select(F.col("index").cast("string").alias("index"), "text")
    rows.write.format(TextFilesSource.name()).mode("append").option("folder", folder).save()


EPOCH_SCHEMA = "train_loss double, val_loss double, run string, epoch int"


def write_epoch_metrics(metrics: DataFrame, path: str) -> None:
    """``run, epoch, train_loss, val_loss`` rows into an epoch log: an epoch that is written again replaces itself.

    The log is partitioned by run and epoch, and only partitions of ``metrics`` are overwritten.  Two rows of one epoch are an error.
    """
    rows = metrics.select("train_loss", "val_loss", F.col("run").cast("string").alias("run"), F.col("epoch").cast("int").alias("epoch"))
    key = F.struct("run", "epoch").alias("key")
    rows = ensure_unique(rows.withColumn("key", key), "key").drop("key")
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run", "epoch").parquet(path)


def read_epoch_metrics(spark: SparkSession, path: str) -> DataFrame:
    """run, epoch, train_loss, val_loss of a log of :func:`write_epoch_metrics`."""
    return spark.read.schema(EPOCH_SCHEMA).parquet(path).select("run", "epoch", "train_loss", "val_loss")


def stream_epoch_metrics(metrics: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes a stream of ``run, epoch, train_loss, val_loss`` into an epoch log.

    A batch that is tried again writes the same partitions again.  A later batch with an epoch that
    is there replaces it.
    """

    def keep(batch: DataFrame, _: int) -> None:
        write_epoch_metrics(batch, path)

    writer = metrics.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def append_epoch_metrics(metrics: DataFrame, path: str) -> None:
    """Append ``run, epoch, train_loss, val_loss`` rows (one call per epoch).  A repeated call repeats
    its rows; :func:`write_epoch_metrics` doesn't."""
    metrics.select("run", "epoch", "train_loss", "val_loss").write.mode("append").parquet(path)


def counted(df: DataFrame, name: str = "rows", by: str | None = None, values: Sequence[str] = ()) -> tuple[DataFrame, Observation]:
    """``df`` and an observation of its row count (``n``), and of the count of each of ``values`` of the column ``by``
    (``n_<value>``, named in order).  Any one job that reads the frame whole fills it: no pass of its own.
    """
    seen = Observation(name)
    own = [F.count(F.when(F.col(by) == v, 1)).alias(f"n_{v}") for v in values] if by else []
    return df.observe(seen, F.count(F.lit(1)).alias("n"), *own), seen


def write_counted(df: DataFrame, path: str, by: str | None = None, values: Sequence[str] = (), mode: str = "overwrite") -> dict[str, int]:
    """Writes ``df`` as parquet and returns the counts of :func:`counted`, taken by the job that writes."""
    rows, seen = counted(df, f"write-{uuid.uuid4().hex}", by, values)
    rows.write.mode(mode).parquet(path)
    return seen.get
