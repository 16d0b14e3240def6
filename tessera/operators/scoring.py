"""Scoring and evaluation: pooling, linear heads, losses, epoch metrics.

* pooling adds up whole vectors per group, first in each task and then by group: the hidden
  dimension is never exploded and a hot group stays cheap;
* linear heads multiply Arrow batches of pooled vectors by the (size-checked) head
  matrix with NumPy inside the tasks;
* losses are row-wise projections, then two-level averages.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as K

MAX_HEAD_WEIGHTS = 10_000_000  # doubles (80 MB broadcast); a 335 x 768 head has 257,280


# --- pooling -----------------------------------------------------------------------------
#: Bytes of group sums that a task holds before it hands them on.
POOL_BYTES = 64 << 20


def pool_vectors(tokens: DataFrame, by: Sequence[str], h: str = "h", mask: str = "mask") -> DataFrame:
    """Per group, ``sum(h * mask) / sum(mask)`` of whole vectors: ``*by, vec array<double>``.

    A vector-valued aggregate in two phases.  Each task adds up its batches (one matrix per Arrow batch) and
    hands on one row per group, a vector and a weight; these are dealt out by group and read sorted, one group
    after another.  So a hot group sends a row per task, a group is never gathered, and the hidden dimension is
    never exploded.

    A group whose rows are all masked has NULL in every place.  Rows without a vector don't count, NULL places of a
    vector and a NULL mask count as 0, a group without any vector has no row.  Vectors of different lengths fail the job.
    """
    by = list(by)
    rows = tokens.select(*by, F.col(h).alias("_h"), F.col(mask).cast("double").alias("_m"))
    keys = rows.select(*by).schema
    sums = T.StructType([*keys.fields, T.StructField("_h", T.ArrayType(T.DoubleType())), T.StructField("_m", T.DoubleType())])
    pooled = T.StructType([*keys.fields, T.StructField("vec", T.ArrayType(T.DoubleType()))])
    part = rows.where(F.col("_h").isNotNull()).mapInArrow(_group_sums(len(by), False), sums)
    dealt = part.repartition(*by).sortWithinPartitions(*by) if by else part.coalesce(1)
    return dealt.mapInArrow(_group_sums(len(by), True), pooled)


def _group_sums(n_keys: int, last: bool):
    """Sums vectors and weights by the first ``n_keys`` columns.  ``last``: the rows are sums, sorted by group; gives their means."""

    def emit(groups: dict, types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
        columns = [pa.array([g[0][i] for g in groups.values()], t) for i, t in enumerate(types)]
        sums, weights = np.stack([g[1] for g in groups.values()]), np.array([g[2] for g in groups.values()])
        ends = pa.array(np.arange(len(groups) + 1) * sums.shape[1], pa.int32())
        if not last:
            return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, sums.ravel()), pa.array(weights)], [*names, "_h", "_m"])
        none = weights == 0
        means = sums / np.where(none, 1.0, weights)[:, None]
        flat = pa.array(means.ravel(), mask=np.repeat(none, sums.shape[1]))
        return pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(ends, flat)], [*names, "vec"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple, list] = {}
        width, types, names = None, [], []
        for b in batches:
            if not b.num_rows:
                continue
            types, names = [c.type for c in b.columns[:n_keys]], b.schema.names[:n_keys]
            vectors = b.column(n_keys)
            lengths = np.asarray(pc.list_value_length(vectors))
            width = int(lengths[0]) if width is None else width
            if (lengths != width).any():
                raise ValueError("vectors of different lengths")
            h = np.asarray(pc.fill_null(vectors.flatten(), 0), dtype=np.float64).reshape(b.num_rows, width)
            m = np.asarray(pc.fill_null(b.column(n_keys + 1), 0.0))
            codes = np.zeros(b.num_rows, np.int64)
            for c in b.columns[:n_keys]:
                found = c.dictionary_encode(null_encoding="encode")
                codes = np.unique(codes * len(found.dictionary) + np.asarray(found.indices), return_inverse=True)[1]
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.diff(codes[order], prepend=-1))
            h = h[order] if last else h[order] * m[order][:, None]
            sums = np.add.reduceat(h, starts, axis=0) if width else np.zeros((len(starts), 0))
            weights = np.add.reduceat(m[order], starts)
            first = pa.array(order[starts])
            keys = list(zip(*(c.take(first).to_pylist() for c in b.columns[:n_keys]))) if n_keys else [()]
            now = None
            for at in np.argsort(order[starts]).tolist():
                now = tuple("NaN" if k != k else k for k in keys[at])
                known = groups.get(now)
                if known is None:
                    groups[now] = [keys[at], sums[at].copy(), float(weights[at])]
                else:
                    known[1] += sums[at]
                    known[2] += float(weights[at])
            if last and len(groups) > 1:  # sorted: all but the last group are whole
                held = groups.pop(now)
                yield emit(groups, types, names)
                groups = {now: held}
            elif not last and len(groups) * 8 * max(1, width) > POOL_BYTES:
                yield emit(groups, types, names)
                groups = {}
        if groups:
            yield emit(groups, types, names)

    return run


def masked_mean_pool(tokens: DataFrame, by: Sequence[str], h: str = "h", mask: str = "mask") -> DataFrame:
    """:func:`pool_vectors` in long form, ``*by, dim, pooled``: only pooled vectors are exploded."""
    long = pool_vectors(tokens, by, h, mask).select(*by, F.posexplode_outer("vec").alias("dim", "pooled"))
    return long.where(F.col("dim").isNotNull())


def pooled_vectors(pooled: DataFrame, by: Sequence[str]) -> DataFrame:
    """Long ``(by, dim, pooled)`` back to one ``array<double>`` per group (bounded by hidden size)."""
    return pooled.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("dim", "pooled"))), lambda s: s["pooled"]).alias("vec")
    )


# --- heads -------------------------------------------------------------------------------
def head_matrix(weights: DataFrame, head: str) -> tuple[np.ndarray, np.ndarray]:
    """Collect one head ``(head, label, w array<double>, b)`` as (W, b) after a size check."""
    rows = weights.where(F.col("head") == head).select("label", "w", "b")
    n = rows.count()
    if n == 0:
        raise ValueError(f"no weights for head {head!r}")
    width = rows.select(F.max(F.size("w"))).first()[0]
    if n * width > MAX_HEAD_WEIGHTS:
        raise ValueError("head matrix too large to ship to tasks")
    got = rows.orderBy("label").collect()
    W = np.array([r["w"] for r in got], dtype=np.float64)
    b = np.array([r["b"] for r in got], dtype=np.float64)
    return W, b


def score_heads(pooled: DataFrame, vec: str, heads: dict[str, tuple[np.ndarray, np.ndarray]], activation: str = "tanh") -> DataFrame:
    """Adds one ``array<double>`` column per head: ``sigmoid(W @ act(x) + b)``; NULL for a vector that isn't there or has a place without a value.

    The head matrices are broadcast once; each Arrow batch is one matrix product.
    """
    out = pooled
    for name, (W, b) in heads.items():
        value = (np.asarray(W, dtype=np.float64), np.asarray(b, dtype=np.float64))
        try:
            shipped = pooled.sparkSession.sparkContext.broadcast(value)
            get = lambda bw=shipped: bw.value
        except Exception:  # no SparkContext (Spark Connect): the matrix travels with the UDF
            get = lambda v=value: v
        out = out.withColumn(name, _head_udf(get, activation)(F.col(vec)))
    return out


def _head_udf(get, activation: str):
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def score(x: pd.Series) -> pd.Series:
        Wm, bv = get()
        if len(x) == 0:
            return pd.Series([], dtype=object)
        H = np.stack([np.full(Wm.shape[1], np.nan) if v is None else np.asarray(v, dtype=np.float64) for v in x])
        if activation == "tanh":
            H = np.tanh(H)
        p = 1.0 / (1.0 + np.exp(-(H @ Wm.T + bv)))
        unknown = np.isnan(H).any(axis=1)
        return pd.Series([None if u else v for u, v in zip(unknown, p)])

    return score


# --- losses ------------------------------------------------------------------------------
def logsumexp(z: Column) -> Column:
    """Stable log-sum-exp of an array in one pass (running max and rescaled sum)."""
    init = F.struct(F.lit(float("-inf")).alias("m"), F.lit(0.0).alias("s"))

    def step(acc, x):
        xd = x.cast("double")
        m = F.greatest(acc["m"], xd)
        return F.struct(m.alias("m"), (acc["s"] * F.exp(acc["m"] - m) + F.exp(xd - m)).alias("s"))

    return F.aggregate(z, init, step, lambda acc: acc["m"] + F.log(acc["s"]))


def softmax_ce(z: Column, label: Column) -> Column:
    """Cross-entropy of one row: ``logsumexp(z) - z[label]`` (label is 0-based)."""
    return logsumexp(z) - F.element_at(z, (label + 1).cast("int")).cast("double")


def _clamped_log(p: Column) -> Column:
    # log(0) is NULL in Spark; the loss clamps it at -100
    return F.greatest(F.coalesce(F.log(p), F.lit(K.LOG_CLAMP)), F.lit(K.LOG_CLAMP))


def bce(p: Column, y: Column) -> Column:
    """Mean binary cross-entropy over the labels of one row (probabilities ``p``, targets ``y``)."""
    terms = F.zip_with(
        p,
        y,
        lambda pi, yi: -(yi.cast("double") * _clamped_log(pi) + (F.lit(1.0) - yi.cast("double")) * _clamped_log(F.lit(1.0) - pi)),
    )
    return F.aggregate(terms, F.lit(0.0), lambda a, t: a + t) / F.size(p)


def batch_losses(rows: DataFrame, by: Sequence[str], loss: str = "loss") -> DataFrame:
    """Mean loss per batch: ``*by, n, loss``."""
    return rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(loss).alias("loss"))


def epoch_metrics(batches: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean of batch means (a short batch weighs as much as a full one) and row-weighted mean."""
    return batches.groupBy(*by).agg(
        F.avg("loss").alias("loss"),
        (F.sum(F.col("loss") * F.col("n")) / F.sum("n")).alias("row_mean"),
        F.count(F.lit(1)).alias("n_batches"),
        F.sum("n").alias("n_rows"),
    )


def epoch_record(batches: DataFrame, run: str, a0: float = 0.0, b0: float = 1.0) -> DataFrame:
    """run, epoch, train_loss, val_loss: means over the batches of ``a0 * lp + b0 * la``.

    ``batches``: epoch, split (train or val), batch, lp, la (mean losses of the two heads in a batch).
    """
    total = weighted_total(F.col("lp"), F.col("la"), a0, b0)
    of = lambda split: F.avg(F.when(F.col("split") == split, total)).alias(f"{split}_loss")
    return batches.groupBy("epoch").agg(of("train"), of("val")).select(F.lit(run).alias("run"), "epoch", "train_loss", "val_loss")


def score_vqa(tokens: DataFrame, by: Sequence[str], heads: dict[str, tuple[np.ndarray, np.ndarray]], h: str = "h", mask: str = "mask") -> DataFrame:
    """Token vectors -> masked mean -> tanh -> sigmoid heads: ``*by`` and one array per head (NULL if all of a group is masked)."""
    return score_heads(pool_vectors(tokens, by, h, mask), "vec", heads).drop("vec")


def weighted_total(loss_patch: Column, loss_answ: Column, a0: float = 0.0, b0: float = 1.0) -> Column:
    return F.lit(a0) * loss_patch + F.lit(b0) * loss_answ
