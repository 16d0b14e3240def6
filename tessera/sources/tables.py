"""Readers for the parquet tables in a scale-factor folder.

Every reader selects only the columns it needs, so the parquet scan prunes the rest.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import check
from ..session import spread

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str, spread_out: bool = False) -> DataFrame:
    """Scan one table with only ``cols``; ``spread_out`` deals a scan that has fewer
    partitions than cores out to all of them (see :func:`tessera.session.spread`)."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    df = df.select(*cols) if cols else df
    return spread(df) if spread_out else df


def read_qa(spark: SparkSession, *paths: str) -> DataFrame:
    """Question tables (one or more parquet files) with the declared QA columns."""
    return check(spark.read.parquet(*paths), "qa")


def read_context_files(spark: SparkSession, *paths: str) -> DataFrame:
    """Wide context tables written as one parquet file per image: ``img_name`` is the file's name."""
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.parquet$", "")
    return spark.read.parquet(*paths).select(name.alias("img_name"), "*")
