"""The vector aggregate of pooling against NumPy, and its plan."""

import numpy as np
import pytest

from tessera.operators import scoring as S


def brute(rows):
    out = {}
    for g, h, m in rows:
        if h is not None:
            out.setdefault(g, []).append(([0.0 if x is None else x for x in h], m or 0))
    res = {}
    for g, own in out.items():
        w = sum(m for _, m in own)
        s = np.sum([np.array(h) * m for h, m in own], axis=0)
        res[g] = [None] * len(s) if w == 0 else (s / w).tolist()
    return res


def check(df, rows, by=("g",)):
    got = {tuple(r[c] for c in by) if len(by) > 1 else r[by[0]]: r["vec"] for r in S.pool_vectors(df, list(by)).collect()}
    want = brute(rows)
    assert set(got) == set(want)
    for k, v in want.items():
        assert got[k] == pytest.approx(v, rel=1e-12, abs=1e-12) if None not in v else got[k] == v


SCHEMA = "g string, h array<float>, mask int"


def test_masked_empty_hot_and_null_groups(spark):
    rng = np.random.default_rng(0)
    names = ["hot"] * 400 + [f"g{i % 37}" for i in range(500)] + [None] * 20
    rows = [(g, np.float32(rng.normal(size=5)).tolist(), int(rng.integers(3))) for g in names]
    rows += [("masked", [1.0] * 5, 0)] * 3 + [("masked", [2.0] * 5, None), ("no vector", None, 1), ("gaps", [None, 1.0, None, 2.0, 3.0], 1), ("gaps", [4.0] * 5, 1), ("hot", None, 1)]
    check(spark.createDataFrame(rows, SCHEMA).repartition(7), rows)
    check(spark.createDataFrame(rows, SCHEMA).coalesce(1), rows)
    assert S.pool_vectors(spark.createDataFrame([], SCHEMA), ["g"]).collect() == []
    assert S.pool_vectors(spark.createDataFrame([("a", [], 1)], SCHEMA), ["g"]).first()["vec"] == []


def test_several_keys_and_none(spark):
    rng = np.random.default_rng(1)
    rows = [((i % 3, float(i % 2), f"x{i % 5}"), rng.normal(size=4).tolist(), 1 + i % 2) for i in range(300)]
    df = spark.createDataFrame([(*k, h, m) for k, h, m in rows], "a int, b double, c string, h array<double>, mask int")
    check(df, rows, ("a", "b", "c"))
    whole = S.pool_vectors(df, []).collect()
    assert len(whole) == 1 and whole[0]["vec"] == pytest.approx(brute([(0, h, m) for _, h, m in rows])[0])


def test_groups_across_batches_and_early_hand_on(spark):
    """Groups longer than an Arrow batch, and more group sums than a task holds at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        rows = [(f"g{i % 3}" if i < 200 else f"s{i // 3}", [float(i), 1.0], 1) for i in range(320)]
        check(spark.createDataFrame(rows, SCHEMA).repartition(3), rows)
        run = S._group_sums(1, False)
        import pyarrow as pa

        schema = pa.schema([("g", pa.string()), ("_h", pa.list_(pa.float64())), ("_m", pa.float64())])
        wide = [pa.record_batch([[f"g{i}"], [[1.0] * 1000], [1.0]], schema=schema) for i in range(20_000 // 2)]
        assert len(list(run(iter(wide)))) > 1
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_lengths_that_differ_fail(spark):
    df = spark.createDataFrame([("a", [1.0], 1), ("a", [1.0, 2.0], 1)], SCHEMA).coalesce(1)
    with pytest.raises(Exception, match="different lengths"):
        S.pool_vectors(df, ["g"]).collect()


def test_plan_has_no_generator_and_one_row_per_group_and_task_is_shuffled(spark):
    rows = [(f"g{i % 4}", [1.0, 2.0], 1) for i in range(1000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    heads = {"p": (np.ones((3, 2)), np.zeros(3))}
    for out in (S.pool_vectors(df, ["g"]), S.score_vqa(df, ["g"], heads)):
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
    part = df.select("g", "h", df["mask"].cast("double")).mapInArrow(S._group_sums(1, False), "g string, _h array<double>, _m double")
    assert part.count() == 5 * 4


def test_all_masked_groups_have_no_scores(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [1.0, 2.0], 1)], SCHEMA)
    got = {r["g"]: r["p"] for r in S.score_vqa(df, ["g"], {"p": (np.ones((1, 2)), np.zeros(1))}).collect()}
    assert got["a"] is None and got["b"] == pytest.approx([1 / (1 + np.exp(-(np.tanh(1) + np.tanh(2))))])
