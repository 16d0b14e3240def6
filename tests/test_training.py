"""Joint training of the heads against NumPy: gradients, AdamW steps, epoch losses, batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators import scoring as S
from tessera.operators import training as T


def losses(x, ys, heads, scale):
    x1 = np.hstack([np.tanh(x), np.ones((len(x), 1))])
    total, grads = 0.0, []
    for y, w, a in zip(ys, heads, scale):
        p = 1 / (1 + np.exp(-(x1 @ w.T)))
        with np.errstate(divide="ignore"):
            total += a * -(y * np.maximum(np.log(p), K.LOG_CLAMP) + (1 - y) * np.maximum(np.log(1 - p), K.LOG_CLAMP)).mean()
        grads.append(a * (p - y).T @ x1 / y.size)
    return total, grads


def adamw(w, g, m, v, t, rate, decay):
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return w * (1 - rate * decay) - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8), m, v


def brute(x, ys, val, batch, heads, scale, epochs, rate, decay, batches):
    state = [(np.zeros_like(w), np.zeros_like(w)) for w in heads]
    out, t = [], 0
    for e in range(epochs):
        own = []
        for b in range(batches):
            at = ~val & (batch == b)
            loss, grads = losses(x[at], [y[at] for y in ys], heads, scale)
            own.append(loss)
            t += 1
            new = [adamw(w, g, m, v, t, rate, decay) for w, g, (m, v) in zip(heads, grads, state)]
            heads, state = [n[0] for n in new], [n[1:] for n in new]
        out.append((np.mean(own), losses(x[val], [y[val] for y in ys], heads, scale)[0] if val.any() else None))
    return heads, out


def data(spark, n=240, d=6, parts=5):
    rng = np.random.default_rng(7)
    x, ya, yb = rng.normal(size=(n, d)), rng.integers(0, 2, (n, 3)), (rng.random((n, 11)) < 0.2).astype(int)
    val = np.arange(n) % 4 == 0
    df = spark.createDataFrame([(i, x[i].tolist(), ya[i].tolist(), yb[i].tolist(), bool(val[i])) for i in range(n)], "id long, x array<double>, ya array<int>, yb array<int>, val boolean")
    start = {"a": (rng.normal(size=(3, d)), rng.normal(size=3)), "b": (rng.normal(size=(11, d)), np.zeros(11))}
    heads = [np.hstack([w, b[:, None]]) for w, b in start.values()]
    return df.repartition(parts), x, [ya, yb], val, start, heads


@pytest.mark.parametrize("batches", [1, 3])
def test_epochs_match_numpy(spark, batches):
    df, x, ys, val, start, heads = data(spark)
    batch = np.arange(len(x)) % batches
    want_heads, want = brute(x, ys, val, batch, heads, [0.25, 0.75], 4, 0.05, 0.1, batches)
    got, record = T.train_heads(df, "x", {"a": "ya", "b": "yb"}, start, {"a": 0.25, "b": 0.75}, epochs=4, rate=0.05, decay=0.1, batch=F.col("id") % batches, batches=batches)
    rows = record.orderBy("epoch").collect()
    assert [(r["run"], r["epoch"]) for r in rows] == [("heads", e) for e in range(1, 5)]
    for r, (train, held) in zip(rows, want):
        assert r["train_loss"] == pytest.approx(train, rel=1e-9) and r["val_loss"] == pytest.approx(held, rel=1e-9)
    for (W, b), w in zip(got.values(), want_heads):
        assert W == pytest.approx(w[:, :-1], rel=1e-8, abs=1e-10) and b == pytest.approx(w[:, -1], rel=1e-8, abs=1e-10)
    assert rows[-1]["train_loss"] < rows[0]["train_loss"]
    table = T.head_table(spark, got)
    assert S.head_matrix(table, "b")[0] == pytest.approx(got["b"][0])


def test_one_pass_a_step_for_any_number_of_labels_and_a_tree_of_sums(spark, monkeypatch):
    df, x, ys, val, start, heads = data(spark, parts=40)
    rows = df.select("x", "ya", "yb")
    n, loss, grads = T.head_pass(rows, heads, [1.0, 2.0])
    want, g = losses(x, ys, heads, [1.0, 2.0])
    assert n == len(x) and loss / n == pytest.approx(want)
    for a, b in zip(grads, g):
        assert a / n == pytest.approx(b)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("one pass", "one pass")
    T.head_pass(rows, heads, [1.0, 2.0])
    assert len(jobs.getJobIdsForGroup("one pass")) <= 3  # a job of each level that AQE plans
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_a_zero_weight_leaves_a_head_to_its_decay(spark):
    df, *_, start, heads = data(spark)
    got, _ = T.train_heads(df, "x", {"a": "ya", "b": "yb"}, start, {"a": 0.0, "b": 1.0}, epochs=2, rate=0.1, decay=0.5)
    assert got["a"][0] == pytest.approx(start["a"][0] * 0.95**2)


def test_what_fails_and_what_is_null(spark):
    df, *_, start, _ = data(spark, n=20)
    two = {"a": "ya", "b": "yb"}, start, {"a": 1.0, "b": 1.0}
    _, record = T.train_heads(df, "x", *two, epochs=1, validation=F.lit(False))
    assert record.first()["val_loss"] is None
    with pytest.raises(ValueError, match="no rows"):
        T.train_heads(df, "x", *two, epochs=1, validation=F.lit(True))
    with pytest.raises(Exception, match="NULL in vectors"):
        T.train_heads(df.withColumn("x", F.when(F.col("id") != 3, F.col("x"))), "x", *two, epochs=1)
    with pytest.raises(Exception, match="labels of 3 values"):
        T.train_heads(df.withColumn("ya", F.slice("ya", 1, 2)), "x", *two, epochs=1)


def test_saturated_probabilities_are_clamped(spark):
    df = spark.createDataFrame([([50.0], [0], False), ([50.0], [1], False)], "x array<double>, y array<int>, val boolean")
    start = {"h": (np.array([[1000.0]]), np.array([0.0]))}
    _, record = T.train_heads(df, "x", {"h": "y"}, start, {"h": 1.0}, epochs=1)
    assert record.first()["train_loss"] == pytest.approx(50.0)  # 100 and 0
