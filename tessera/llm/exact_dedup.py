"""Exact dedup: a stateful stream keyed by content digest, with full bytes checked on hits.

Every document arrives in a stream as (digest of its normalised text, length, id, place of its
content).  The stream's state is kept per digest in RocksDB on the executors' disks and in the
checkpoint folder, without expiry: how many documents had that digest, and of the one that stays
its stable id and its place.  Digests seen more than once are hits: their full texts are
compared by grouping on the text itself (copies collapse in the task that reads them, so a hot
group sends one row per task), and a digest shared by different texts is split by text.

Nothing here is Python on the executors.

Defined cases: a null text counts as empty, and all empty texts are one group; a null id comes
last among equals; rows equal in every column are separate rows of which one stays; an empty
table gives an empty result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.joins import hot_keys_from_counts, skew_join
from .common import Scratch, fixed, located, read, small, without

#: Arrivals of one digest that one task of the joining back takes.
HOT_ROWS = 500

WHITE = "[\\x20\\x09-\\x0D]+"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), WHITE, "")


def sha256(norm: Column) -> Column:
    return F.unhex(F.sha2(norm, 256))


def _best() -> Column:
    """Least for the row that stays: most code points, then smallest id, then first place."""
    return F.struct((-F.col("chars")).alias("neg"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")


def stream_state(spark: SparkSession, arrivals: str, schema: StructType, scratch: Scratch, files_per_batch: int | None) -> DataFrame:
    """Runs the stream over the files in ``arrivals`` and returns its state: digest, group_size, best."""
    session = spark.newSession()  # the state store's settings stay out of the caller's session
    for k, v in {
        # state rows are small: a store for each core holds its part of them, more stores would each cost memory beside the heap
        "spark.sql.shuffle.partitions": str(min(int(spark.conf.get("spark.sql.shuffle.partitions")), cores(spark))),
        # stores of a stream that has ended are closed soon
        "spark.sql.streaming.stateStore.maintenanceInterval": "5s",
        "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
        "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "128",
        # many small stores: no disk blocks are set aside for their logs before these have content
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    }.items():
        session.conf.set(k, v)
    source = session.readStream.schema(schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source
    keyed = source.parquet(arrivals).groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))
    out, batches = scratch.place("updates"), []

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={n}")  # a batch that is tried again replaces itself
        batches.append(n)

    query = (
        keyed.writeStream.outputMode("update").foreachBatch(keep)
        .option("checkpointLocation", scratch.place("stream")).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    if not batches:
        return spark.createDataFrame([], keyed.schema)
    updates = spark.read.schema(keyed.schema).option("basePath", out).parquet(*(f"{out}/batch={n}" for n in dict.fromkeys(batches)))
    if len(set(batches)) == 1:
        return updates.select(*keyed.columns)
    latest = F.max(F.struct("batch", "group_size", "best")).alias("s")
    return updates.groupBy("digest").agg(latest).select("digest", "s.group_size", "s.best")


def exact_dedup(
    docs: DataFrame,
    scratch: Scratch,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
) -> DataFrame:
    """One row per document: doc_id, _file, _row, sha256 (binary), keep_id, group_size, kept.

    A batch of the stream takes ``files_per_batch`` files of arrivals, all of them if it is None.
    """
    spark = docs.sparkSession
    rows = located(docs, scratch, "doc_id", "text").withColumn("norm", normalised(F.col("text")))
    arrivals = rows.select(
        "doc_id", digest(F.col("norm")).alias("digest"), sha256(F.col("norm")).alias("sha256"),
        F.coalesce(F.char_length("text"), F.lit(0)).alias("chars"), "_file", "_row",
    )
    path = scratch.write(arrivals, "arrivals")
    arrived = spark.read.schema(arrivals.schema).parquet(path)
    state = stream_state(spark, path, arrivals.schema, scratch, files_per_batch)

    hits = state.where("group_size > 1").select(F.col("digest").alias("hit"))
    hits = small(hits, 64)
    content = rows.withColumn("digest", digest(F.col("norm"))).join(hits, F.col("digest") == F.col("hit"), "left_semi")
    texts = content.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("n"))
    collided = scratch.table(texts.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "collided")

    # the state knows the hot digests: their arrivals are salted
    hot = hot_keys_from_counts(state, "digest", "group_size", HOT_ROWS)
    keyed = skew_join(arrived, state, "digest", hot=hot).select("doc_id", "_file", "_row", "sha256", "digest", "group_size", "best")
    if not collided.isEmpty():  # different texts under one digest: the text itself is the key
        own = rows.withColumn("digest", digest(F.col("norm"))).join(collided, "digest", "left_semi")
        own = own.withColumn("chars", F.coalesce(F.char_length("text"), F.lit(0)))
        classes = own.groupBy("digest", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.min(_best()).alias("best"))
        split = own.join(classes, ["digest", "norm"]).withColumn("sha256", sha256(F.col("norm")))
        keyed = keyed.join(collided, "digest", "left_anti").unionByName(split.select(*keyed.columns))
    kept = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
    return keyed.select("doc_id", "_file", "_row", "sha256", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"))


def cores(spark: SparkSession) -> int:
    """Files of arrivals that a batch of the stream takes, one for each core."""
    return spark.sparkContext.defaultParallelism


def keep_first(docs: DataFrame, scratch: Scratch, files_per_batch: int | None = None) -> DataFrame:
    """``docs`` without the rows that :func:`exact_dedup` drops; its columns stay as they are."""
    docs = fixed(docs, scratch)
    found = exact_dedup(docs, scratch, files_per_batch=files_per_batch or cores(docs.sparkSession))
    return without(docs, found.where("not kept"), scratch)


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(read(spark, sf_dir, "documents"), Scratch(spark, "op10"), files_per_batch=cores(spark))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha256")).alias("text_sha256"))


OP10_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS chars,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
     k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id) AS keep_id,
                  count(*) OVER (PARTITION BY norm) AS group_size FROM n)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""
