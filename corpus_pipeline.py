"""The corpus pipeline: toxicity, exact dedup, SimHash near-dedup, benchmark decontamination, BPE.

Each stage works on all rows that the stage before has kept; a stage's result is written as
Parquet and read again as the next one's documents.  The filtering stages return the columns of
documents; the last one returns, per document that is left, its number of ids and the digests of
the ids and of the decoded text.  Empty tables, null or empty texts and extra columns pass
through as the operators' docstrings say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, decontaminate, exact_dedup, simhash, toxicity
from tessera.llm.common import Scratch, read

#: Rows that Spark sends to a Python worker at once; texts are long.
BATCH_ROWS = 1000

_open: list[Scratch] = []


def _scratch(spark: SparkSession, name: str) -> Scratch:
    """A stage's scratch tables.  Those of the stage before go: its result has been written by now."""
    while _open:
        _open.pop().close()
    _open.append(Scratch(spark, name))
    return _open[0]


def _small_batches(spark: SparkSession) -> None:
    """Sends :data:`BATCH_ROWS` rows to a worker at once: the executor has a batch in hand while it is written, and its worker the whole of it.

    Spark reads the setting when a stage's result is written, so it stays in the session; a smaller one is kept.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return toxicity.keep_ordinary(docs, read(spark, sf_dir, "labels"), _scratch(spark, "toxicity"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs, _scratch(spark, "copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return simhash.keep_one(docs, _scratch(spark, "near_copies"), words=4, distance=4)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"), _scratch(spark, "contaminated"), window=10)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    _small_batches(spark)
    return bpe.digests(docs, bpe.load(public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("SimHash near-dedup", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("BPE encoding and decoding", encode),
]

#: The toxicity model and the token ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    tables = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES[:-1]):
        docs = spark.read.parquet(tables.write(stage(spark, docs, sf_dir), f"stage{i}"))
        if i:
            tables.drop(f"stage{i - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
