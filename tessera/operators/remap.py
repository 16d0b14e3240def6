"""Code <-> contiguous id remapping and argmax over class scores (row-wise, no shuffle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import classes as C


def code_id(code: Column, unknown: str = "zero") -> Column:
    """Contiguous id of a code; unknown codes give 0 (``zero``, as a zero-filled mask does) or NULL."""
    i = C.dense_lookup(code, {c: n for n, c in enumerate(K.ID_CODES)})
    if unknown == "zero":
        return F.coalesce(i, F.lit(0))
    if unknown == "null":
        return i
    raise ValueError("unknown must be zero or null")


def remap_codes(rasters: DataFrame, unknown: str = "zero") -> DataFrame:
    """Rasters with ``ids array<int>``: every pixel code mapped to its id (0..43)."""
    return rasters.withColumn("ids", F.transform("pixels", lambda c: code_id(c, unknown)))


def ids_to_codes(rasters: DataFrame, col: str = "ids") -> DataFrame:
    """Inverse of :func:`remap_codes`: ``codes array<int>`` from an id array."""
    table = C.id_to_code()
    return rasters.withColumn("codes", F.transform(col, lambda i: F.element_at(table, i + 1)))


def argmax(z: Column) -> Column:
    """0-based position of the first maximum of an array (ties -> first)."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def predicted_codes(logits: DataFrame, col: str = "z") -> DataFrame:
    """Adds ``id`` (argmax over class scores) and ``code`` (its class code)."""
    return logits.withColumn("id", argmax(F.col(col))).withColumn(
        "code", F.element_at(C.id_to_code(), F.col("id") + 1)
    )
