"""Declared schemas of the pipeline's tables, and a check that fails on mismatch.

Column names follow the original files; types are the Spark choices (see README).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

DDL = {
    "masks": "img_name string, height int, width int, pixels array<int>",
    "rgb": "img_name string, height int, width int, bands array<array<float>>",
    "manifest": "img_name string, path_to_your_file string",
    "qa": "index bigint, img_name string, question string, question_type string, answer string, "
    "grid_coordinates array<array<string>>",
    "vocab": "token string, id int",
    "area": "img_name string, grid string, grid_ord int, class string, class_ord int, value bigint",
    "logits": "id bigint, batch bigint, z array<double>, label int",
    "scores": "id bigint, batch bigint, p array<double>, y array<int>",
    "tokens": "id bigint, pos int, h array<double>, mask int",
    "heads": "head string, label int, w array<double>, b double",
    "epoch_metrics": "run string, epoch int, train_loss double, val_loss double",
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def check(df: DataFrame, name: str) -> DataFrame:
    """Return ``df`` with the declared columns (in declared order) or raise on a missing column or a type mismatch.

    Integer widening (int -> bigint, float -> double) is allowed and cast; anything else fails.
    """
    want = schema(name)
    have = {f.name: f.dataType for f in df.schema.fields}
    widen = {("IntegerType", "LongType"), ("ShortType", "IntegerType"), ("ShortType", "LongType"), ("FloatType", "DoubleType")}
    cols = []
    for f in want.fields:
        if f.name not in have:
            raise ValueError(f"{name}: missing column {f.name!r}")
        got = have[f.name]
        if got != f.dataType and (type(got).__name__, type(f.dataType).__name__) not in widen:
            raise TypeError(f"{name}: column {f.name!r} is {got.simpleString()}, expected {f.dataType.simpleString()}")
        cols.append(df[f.name].cast(f.dataType).alias(f.name) if got != f.dataType else df[f.name])
    return df.select(*cols)
