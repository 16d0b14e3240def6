import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera import constants as K
from tessera.operators import images as IM
from tessera.operators import remap as R
from tessera.operators import scoring as S


def test_b1_bilinear_2x2_to_4x4(spark):
    df = spark.createDataFrame([([0.0, 1.0, 2.0, 3.0],)], "img array<double>")
    out = IM.resize_bilinear(df, "img", 2, 2, 4, 4).first()["img"]
    t = [0, 0.25, 0.75, 1]
    assert out == pytest.approx([2 * t[y] + t[x] for y in range(4) for x in range(4)])


def test_resize_same_size_is_identity_and_bands(spark):
    rng = np.random.default_rng(1)
    a = rng.random(35).tolist()
    df = spark.createDataFrame([(a, [a, a])], "img array<double>, bands array<array<double>>")
    assert IM.resize_bilinear(df, "img", 5, 7, 5, 7).first()["img"] == pytest.approx(a)
    bands = IM.resize_bilinear(df, "bands", 5, 7, 10, 14).first()["bands"]
    assert len(bands) == 2 and len(bands[0]) == 140


def test_b2_normalize(spark):
    df = spark.createDataFrame([([[255.0], [0.0], [0.0]],)], "b array<array<double>>")
    mean, std = K.NORM_MULTISPECTRAL
    out = df.select(IM.normalize_bands(F.col("b"), mean, std).alias("n")).first()["n"]
    assert out[0][0] == pytest.approx(12.291429, abs=1e-6)
    assert out[1][0] == pytest.approx(-0.1457 / 0.0547)


def test_s1_bce(spark):
    df = spark.createDataFrame([([0.5], [1]), ([0.0], [1])], "p array<double>, y array<int>")
    got = [r["l"] for r in df.select(S.bce(F.col("p"), F.col("y")).alias("l")).collect()]
    assert got == pytest.approx([0.693147, 100.0], abs=1e-6)


def test_s2_mean_of_batch_means(spark):
    losses = [1, 1, 1, 2, 2, 2, 9]
    df = spark.createDataFrame([(i // 3, float(v)) for i, v in enumerate(losses)], "batch long, loss double")
    m = S.epoch_metrics(S.batch_losses(df, ["batch"]), []).first()
    assert m["loss"] == pytest.approx(4.0)
    assert m["row_mean"] == pytest.approx(2.571429, abs=1e-6)


def test_s3_uniform_logits_ce(spark):
    df = spark.createDataFrame([([0.7] * 44, 5)], "z array<double>, label int")
    got = df.select(S.softmax_ce(F.col("z"), F.col("label")).alias("l")).first()["l"]
    assert got == pytest.approx(math.log(44), abs=1e-9)


def test_ce_matches_numpy(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(size=(20, 10)) * 30
    lab = rng.integers(0, 10, 20)
    df = spark.createDataFrame([(r.tolist(), int(l)) for r, l in zip(z, lab)], "z array<double>, label int")
    got = [r["l"] for r in df.select(S.softmax_ce(F.col("z"), F.col("label")).alias("l")).collect()]
    m = z.max(1)
    ref = m + np.log(np.exp(z - m[:, None]).sum(1)) - z[np.arange(20), lab]
    assert got == pytest.approx(ref.tolist(), rel=1e-12)


def test_pool_and_heads_match_numpy(spark):
    rng = np.random.default_rng(2)
    H = rng.normal(size=(6, 4, 8))
    mask = rng.integers(0, 2, size=(6, 4))
    mask[:, 0] = 1
    rows = [(q, t, H[q, t].tolist(), int(mask[q, t])) for q in range(6) for t in range(4)]
    tok = spark.createDataFrame(rows, "id int, pos int, h array<double>, mask int")
    pooled = S.pooled_vectors(S.masked_mean_pool(tok, ["id"]), ["id"])
    ref = (H * mask[:, :, None]).sum(1) / mask.sum(1)[:, None]
    got = {r["id"]: r["vec"] for r in pooled.collect()}
    for q in range(6):
        assert got[q] == pytest.approx(ref[q].tolist())
    W, b = rng.normal(size=(3, 8)), rng.normal(size=3)
    scored = {r["id"]: r["head"] for r in S.score_heads(pooled, "vec", {"head": (W, b)}).collect()}
    want = 1 / (1 + np.exp(-(np.tanh(ref) @ W.T + b)))
    for q in range(6):
        assert scored[q] == pytest.approx(want[q].tolist())


def test_head_matrix_from_table(spark):
    w = spark.createDataFrame([("patch", 1, [0.0, 1.0], 0.5), ("patch", 0, [1.0, 0.0], -0.5)], "head string, label int, w array<double>, b double")
    W, b = S.head_matrix(w, "patch")
    assert W.tolist() == [[1.0, 0.0], [0.0, 1.0]] and b.tolist() == [-0.5, 0.5]


def test_argmax_first_max_and_code(spark):
    df = spark.createDataFrame([([0.1, 3.0, 3.0, -1.0],)], "z array<double>")
    r = R.predicted_codes(df).first()
    assert r["id"] == 1 and r["code"] == 112


def test_resize_checks_the_size_of_a_row(spark):
    df = spark.createDataFrame([([float(i) for i in range(16)],)], "img array<double>")
    with pytest.raises(Exception, match="2 x 2 expected"):
        IM.resize_bilinear(df, "img", 2, 2, 2, 2).collect()


def test_fully_masked_group_is_null(spark):
    df = spark.createDataFrame([("a", [1.0, 2.0], 0), ("b", [1.0, 2.0], 1)], "g string, h array<double>, mask int")
    got = {(r["g"], r["dim"]): r["pooled"] for r in S.masked_mean_pool(df, ["g"]).collect()}
    assert got == {("a", 0): None, ("a", 1): None, ("b", 0): 1.0, ("b", 1): 2.0}


def test_generators_evaluate_once(spark):
    from conftest import SF_SMALL

    from tessera.plans.queries import QUERIES

    plan = QUERIES["score_heads"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_predicted_rasters_match_the_column_form(spark):
    import random

    rng = random.Random(4)
    maps = [[float(rng.randint(0, 9)) for _ in range(12)] for _ in range(K.N_IDS)]
    df = spark.createDataFrame([("a", maps)], "img_name string, logits array<array<double>>")
    got = IM.predicted_rasters(df, 3, 4, side=10).first()
    wide = IM.resize_bilinear(df, "logits", 3, 4, 10, 10).first()["logits"]
    assert (got["height"], got["width"]) == (10, 10)
    for p, code in enumerate(got["pixels"]):
        best = max(m[p] for m in wide)
        assert wide[K.ID_CODES.index(code)][p] == pytest.approx(best)
