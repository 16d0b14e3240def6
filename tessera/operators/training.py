"""Joint training of both heads: one distributed pass a step, whatever the number of labels.

The loss of a row is ``sum of w_k * l_k``, where l_k is the mean binary cross-entropy over the labels of head
k, on ``sigmoid(W_k @ act(x) + b_k)``.  A step ships the head matrices to the tasks; every Arrow batch is two matrix products
per head (scores, gradient), a task hands on one row with its sums, and a tree of partial sums leaves a few rows for
the driver, which takes an AdamW step (decoupled weight decay) on the matrices.  So a pass costs the same
for one label as for hundreds, and what the driver holds is bounded by the heads' size.

The examples are written once as a table (lineage cut): a lost executor reads files again.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..session import cut_lineage
from .scoring import MAX_HEAD_WEIGHTS

#: Partial sums that one task of the tree adds up.
FAN_IN = 16


@dataclass
class AdamW:
    """Adam with decoupled weight decay on one matrix."""

    rate: float = 1e-3
    decay: float = 0.01
    betas: tuple[float, float] = (0.9, 0.999)
    eps: float = 1e-8
    steps: int = 0
    mean: np.ndarray | None = field(default=None, repr=False)
    square: np.ndarray | None = field(default=None, repr=False)

    def step(self, weights: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        b1, b2 = self.betas
        self.steps += 1
        self.mean = (1 - b1) * gradient + (b1 * self.mean if self.mean is not None else 0)
        self.square = (1 - b2) * gradient**2 + (b2 * self.square if self.square is not None else 0)
        m, v = self.mean / (1 - b1**self.steps), self.square / (1 - b2**self.steps)
        return weights * (1 - self.rate * self.decay) - self.rate * m / (np.sqrt(v) + self.eps)


def _matrix(column: pa.Array, width: int, what: str) -> np.ndarray:
    if column.null_count or column.flatten().null_count:
        raise ValueError(f"NULL in {what}")
    if (np.asarray(pc.list_value_length(column)) != width).any():
        raise ValueError(f"{what} of {width} values expected")
    return np.asarray(column.flatten(), dtype=np.float64).reshape(-1, width)


def _sums(params, scale: list[float], activation: str, gradient: bool):
    """Arrow batches of (x, y_1, ...) to one row: rows, loss, gradient sums of all heads, flat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = params.value
        n, loss, total = 0, 0.0, [np.zeros_like(w) for w in heads] if gradient else []
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column(0), heads[0].shape[1] - 1, "vectors")
            x = np.tanh(x) if activation == "tanh" else x
            x = np.hstack([x, np.ones((len(x), 1))])
            n += len(x)
            for k, w in enumerate(heads):
                y = _matrix(b.column(1 + k), len(w), "labels")
                p = 1.0 / (1.0 + np.exp(-(x @ w.T)))
                with np.errstate(divide="ignore"):
                    terms = y * np.maximum(np.log(p), K.LOG_CLAMP) + (1 - y) * np.maximum(np.log(1 - p), K.LOG_CLAMP)
                loss -= scale[k] * terms.sum() / len(w)
                if gradient:
                    total[k] += scale[k] / len(w) * ((p - y).T @ x)
        if n:
            flat = np.concatenate([t.ravel() for t in total]) if gradient else np.zeros(0)
            yield _row(n, loss, flat)

    return run


def _row(n: int, loss: float, flat: np.ndarray) -> pa.RecordBatch:
    ends = pa.array([0, len(flat)], pa.int32())
    return pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([loss]), pa.ListArray.from_arrays(ends, pa.array(flat))], ["n", "loss", "g"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, loss, flat = 0, 0.0, None
    for b in batches:
        for i in range(b.num_rows):
            own = np.asarray(b.column(2)[i].values)
            n, loss, flat = n + b.column(0)[i].as_py(), loss + b.column(1)[i].as_py(), own.copy() if flat is None else flat + own
    if n:
        yield _row(n, loss, flat)


SUMS = "n bigint, loss double, g array<double>"


def head_pass(rows: DataFrame, heads: list[np.ndarray], scale: list[float], activation: str = "tanh", gradient: bool = True) -> tuple[int, float, list[np.ndarray]]:
    """(rows, loss sum, gradient sums) over ``rows`` (x, then one label array per head): one pass over the data.

    A head is a matrix with the bias as its last column.  Partial sums of :data:`FAN_IN` tasks are
    added up at a time until that many are left at most.
    """
    shared = rows.sparkSession.sparkContext.broadcast(heads)
    parts, n = rows.mapInArrow(_sums(shared, scale, activation, gradient), SUMS), rows.rdd.getNumPartitions()
    while n > FAN_IN:
        n = -(-n // FAN_IN)
        parts = parts.repartition(n).mapInArrow(_added, SUMS)
    got = parts.collect()
    shared.unpersist()
    flat = np.sum([r["g"] for r in got], axis=0) if got else np.zeros(sum(w.size for w in heads) if gradient else 0)
    cuts = np.cumsum([w.size for w in heads])[:-1]
    sums = [g.reshape(w.shape) for g, w in zip(np.split(flat, cuts), heads)] if gradient else []
    return sum(r["n"] for r in got), sum(r["loss"] for r in got), sums


def train_heads(
    examples: DataFrame,
    vector: str,
    labels: Mapping[str, str],
    start: Mapping[str, tuple[np.ndarray, np.ndarray]],
    scale: Mapping[str, float],
    epochs: int = 30,
    rate: float = 1e-3,
    decay: float = 0.01,
    validation: Column | str = "val",
    batch: Column | None = None,
    batches: int = 1,
    activation: str = "tanh",
    run: str = "heads",
) -> tuple[dict[str, tuple[np.ndarray, np.ndarray]], DataFrame]:
    """Trains all heads together; returns them as (W, b) and ``run, epoch, train_loss, val_loss``, one row per epoch.

    ``labels`` and ``scale`` name each head's label array (0 or 1) and its weight in the loss, ``start`` its first
    (W, b).  Rows where ``validation`` is true are held out: their loss is taken after the epoch's steps.  An epoch takes
    one step on all other rows, or ``batches`` steps on those whose ``batch`` is 0, 1, ...: each batch lies in
    files of its own, so an epoch reads the table once either way.  ``train_loss`` is the mean of the steps' losses, each at
    the weights before its step.  A NULL or a vector or label array of another length fails the job; no rows to train on
    are an error; without held-out rows ``val_loss`` is NULL.
    """
    names = list(labels)
    heads = [np.hstack([np.asarray(start[k][0], float), np.asarray(start[k][1], float)[:, None]]) for k in names]
    if sum(w.size for w in heads) > MAX_HEAD_WEIGHTS:
        raise ValueError("head matrices too large to ship to tasks")
    weights = [float(scale[k]) for k in names]
    held = F.col(validation) if isinstance(validation, str) else validation
    step = F.when(held, F.lit(-1)).otherwise((F.lit(0) if batch is None else batch).cast("int"))
    columns = [F.col(vector).alias("_x"), *[F.col(labels[k]).alias(f"_y{i}") for i, k in enumerate(names)]]
    table = cut_lineage(examples.select(*columns, step.alias("_step")), "train_heads", partition_by="_step")
    rows = lambda at: table.where(F.col("_step") == at).drop("_step")
    optimisers, record = [AdamW(rate, decay) for _ in heads], []
    for epoch in range(1, epochs + 1):
        losses = []
        for at in range(batches):
            n, loss, sums = head_pass(rows(at), heads, weights, activation)
            if not n:
                continue
            losses.append(loss / n)
            heads = [o.step(w, g / n) for o, w, g in zip(optimisers, heads, sums)]
        if not losses:
            raise ValueError("no rows to train on")
        n, loss, _ = head_pass(rows(-1), heads, weights, activation, gradient=False)
        record.append((run, epoch, float(np.mean(losses)), loss / n if n else None))
    out = {k: (w[:, :-1], w[:, -1]) for k, w in zip(names, heads)}
    return out, examples.sparkSession.createDataFrame(record, "run string, epoch int, train_loss double, val_loss double")


def head_table(spark, heads: Mapping[str, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``head, label, w array<double>, b`` of trained heads, as :func:`scoring.head_matrix` reads them."""
    rows = [(k, j, w.tolist(), float(b)) for k, (W, B) in heads.items() for j, (w, b) in enumerate(zip(W, B))]
    return spark.createDataFrame(rows, "head string, label int, w array<double>, b double")
