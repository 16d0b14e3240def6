"""Fixtures of the training-data tests (a second conftest would hide the first)."""

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType


@pytest.fixture
def docs_of(spark, tmp_path):
    """Documents with clashing extra columns, written as Parquet and read back."""
    made = []

    def make(rows, id_name="doc_id", extra=True):
        fields = [StructField(id_name, LongType()), StructField("text", StringType())]
        names = ["fp", "digest", "_file", "_row", "norm", "key", "shard", "score", "lines", "a.b"] if extra else []
        fields += [StructField(n, StringType()) for n in names]
        df = spark.createDataFrame([(i, t, *["x"] * len(names)) for i, t in rows], StructType(fields))
        path = str(tmp_path / f"docs{len(made)}")
        df.coalesce(2).write.parquet(path)
        made.append(path)
        return spark.read.parquet(path)

    return make


@pytest.fixture
def scratch(spark):
    from tessera.llm.common import Scratch

    s = Scratch(spark, "test")
    yield s
    s.close()
