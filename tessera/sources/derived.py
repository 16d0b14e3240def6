"""Inputs of the pipeline derived from the driver's tables by integer arithmetic.

The test tables hold no rasters or questions, so these functions build them from real
rows, deterministically, with rules that SQL engines compute alike (the oracle repeats
them).  All derived work grows with the source tables.

* ``masks``    <- supplier: one raster per supplier (side 100, 130 or 120 pixels).
* ``manifest`` <- supplier x nation: image name, mask folder (nation name), split.
* ``qa``       <- orders x lineitem (x supplier for the image name).
* ``vectors``  <- embeddings as is (64 floats, label 0..9).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K
from ..operators.joins import checked_broadcast, skew_join
from .tables import read_table

# The 43 named codes, then one code with an id but no name and one unknown code.
MASK_CODES = K.CLASS_CODES + [K.NODATA_CODE, 335]
MAX_BROADCAST_ROWS = 1_000_000  # ~40 MB for (key, name) rows
MASK_ROWS = 64  # rasters that a Python worker holds at once, ~4 MB of codes


def mask_side(key) -> F.Column:
    return F.when(key % 10 == 8, 100).when(key % 10 == 9, 130).otherwise(120)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _mask_pixels(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    """Row-major pixel codes of each image, vectorised with NumPy.

    An Arrow batch holds thousands of keys, whose rasters together are some hundred MB:
    they leave ``MASK_ROWS`` at a time, so a worker holds that many rasters at most.
    """
    codes = np.array(MASK_CODES, dtype=np.int32)
    for key, side in batches:
        keys, sides = key.to_numpy(dtype=np.int64), side.to_numpy(dtype=np.int64)
        for i in range(0, len(keys), MASK_ROWS):
            out = []
            for s, n in zip(keys[i : i + MASK_ROWS], sides[i : i + MASK_ROWS]):
                y, x = np.divmod(np.arange(n * n, dtype=np.int64), n)
                out.append(codes[(s * 7 + (x // 12) * 3 + (y // 10) * 5 + (x * y) % 3) % len(MASK_CODES)])
            yield pd.Series(out)


def masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_name, height, width, pixels array<int> (row-major), one row per supplier.

    pixel (x, y) = MASK_CODES[(s_suppkey*7 + (x div 12)*3 + (y div 10)*5 + (x*y) % 3) % 45].
    The rasters are hash-partitioned by ``img_name``: every per-image aggregation
    downstream then runs without another shuffle (a raster table written bucketed by
    ``img_name`` gives the same property on a cluster).
    """
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", spread_out=True)
    side = mask_side(F.col("s_suppkey"))
    # Generate (vectorised, in the scan stage), then hash-partition the rasters by image:
    # a Python evaluation node does not report its input's partitioning, so partitioning
    # after it is what lets every per-image aggregation downstream skip the shuffle.  The
    # explicit count keeps AQE from coalescing into one partition.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return (
        sup.select(F.col("s_name").alias("img_name"), "s_suppkey", side.alias("height"), side.alias("width"))
        .select("img_name", "height", "width", _mask_pixels(F.col("s_suppkey"), F.col("height")).alias("pixels"))
        .repartition(parts, "img_name")
    )


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """img_name, path_to_your_file (folder = nation name), split ('val' for key % 5 = 0)."""
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    return sup.join(checked_broadcast(nation, MAX_BROADCAST_ROWS), sup.s_nationkey == nation.n_nationkey, "left").select(
        F.col("s_name").alias("img_name"),
        F.col("n_name").alias("path_to_your_file"),
        F.when(F.col("s_suppkey") % 5 == 0, "val").otherwise("train").alias("split"),
    )


def _bit(i: F.Column) -> F.Column:
    """A number with bit ``i`` (0 to 62) set."""
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), i.cast("int"))


def _named(bits: F.Column, names: list[tuple[str, int]], sep: str) -> F.Column:
    """The names whose bits are set, in the order of ``names``, joined by ``sep``."""
    return F.concat_ws(sep, *[F.when(bits.bitwiseAND(F.lit(1 << i).cast("bigint")) != 0, name) for name, i in names])


def qa(spark: SparkSession, sf_dir: str, hot_rows: int | None = None) -> DataFrame:
    """index, img_name, question, question_type, answer, grid_coordinates.

    index = o_orderkey; image = supplier name of the order's smallest l_suppkey;
    question = o_orderpriority; question_type = o_orderstatus; answer = names of the
    sorted distinct class ordinals ``l_partkey % 43`` joined by ', ';
    grid_coordinates = per l_linenumber the sorted distinct cells ``l_partkey % 17``
    (16 -> 'z9').  Orders without lines get NULL image and answer and no coordinates.
    Every collected list is bounded (7 line numbers x 17 cells, 43 ordinals).
    """
    li = read_table(spark, sf_dir, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", spread_out=True)
    orders = read_table(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus", spread_out=True)
    sup = read_table(spark, sf_dir, "supplier", "s_suppkey", "s_name")
    part = F.col("l_partkey")
    part = F.when(part < 0, F.raise_error(F.lit("negative l_partkey")).cast("bigint")).otherwise(part)
    # sets as bits: buffers of fixed size, where a set of objects would be sorted and kept apart for every line
    per_line = li.groupBy("l_orderkey", "l_linenumber").agg(
        F.bit_or(_bit(F.when(part % 17 < K.N_CELLS, part % 17).otherwise(K.N_CELLS))).alias("cells"),
        F.bit_or(_bit(part % K.N_CLASSES)).alias("ords"),
        F.min("l_suppkey").alias("min_supp"),
    )
    cells = sorted([*((name, i) for i, name in enumerate(K.CELL_NAMES)), ("z9", K.N_CELLS)])
    per_order = per_line.groupBy("l_orderkey").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("l_linenumber", "cells"))), lambda s: F.split(_named(s["cells"], cells, " "), " ")
        ).alias("grid_coordinates"),
        F.coalesce(F.bit_or("ords"), F.lit(0)).alias("ords"),
        F.min("min_supp").alias("min_supp"),
    )
    names = [(name, i) for i, name in enumerate(K.CLASS_NAMES)]
    q = orders.join(per_order, orders.o_orderkey == per_order.l_orderkey, "left").select(
        F.col("o_orderkey").alias("index"),
        F.col("min_supp"),
        F.col("o_orderpriority").alias("question"),
        F.col("o_orderstatus").alias("question_type"),
        F.when(F.col("ords").isNotNull(), _named(F.col("ords"), names, ", ")).alias("answer"),
        F.coalesce(F.col("grid_coordinates"), F.array().cast("array<array<string>>")).alias("grid_coordinates"),
    )
    img = sup.select(F.col("s_suppkey").alias("min_supp"), F.col("s_name").alias("img_name"))
    if hot_rows is None:
        # supplier names are a dimension: broadcast when the count allows it, else a
        # shuffle join whose hot keys AQE splits
        j = q.join(checked_broadcast(img, MAX_BROADCAST_ROWS), "min_supp", "left")
    else:
        j = skew_join(q, img, "min_supp", "left", hot_rows=hot_rows)
    return j.select(
        "index", "img_name", "question", "question_type", "answer", "grid_coordinates"
    )


def class_scores(embedding) -> F.Column:
    """44 class scores (doubles) from all 64 values: value i is added to class i mod 44."""
    n = K.N_IDS
    return F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda c: F.get(embedding, c).cast("double") + F.coalesce(F.get(embedding, c + n).cast("double"), F.lit(0.0)),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, embedding array<float> (64), label 0..9."""
    return read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label", spread_out=True)
