"""Hard negatives against brute force: the index, the certified windows, ties, nulls, hot vectors."""

import numpy as np
import pytest
from llm_fixtures import scratch  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import hard_negatives as H


def brute(rows, positives=5, negatives=10):
    """rows: (id, vector, label), in order.  (anchor place, positive place, rank, negative place, scores) as sets of ids."""
    ok = [(n, i, v, lab) for n, (i, v, lab) in enumerate(rows) if lab is not None and v is not None and all(x is not None for x in v)]
    width = max((len(v) for _, _, v, _ in ok), default=0)
    ok = [(n, i, np.array([*v, *[0] * (width - len(v))], dtype=np.int64), lab) for n, i, v, lab in ok]
    key = lambda t: (-t[0], t[2] is None, t[2] or 0, t[1])
    out = []
    for n, i, v, lab in ok:
        if i is None or i % 100:
            continue
        scored = [(int(v @ w), m, j, other) for m, j, w, other in ok if m != n]
        for ps, _, pid, _ in sorted((s for s in scored if s[3] == lab), key=key)[:positives]:
            fit = sorted((s for s in scored if s[3] != lab and 30 * ps <= 100 * s[0] <= 90 * ps), key=key)[:negatives]
            out += [(i, pid, r + 1, s[2], ps, s[0]) for r, s in enumerate(fit)]
    return sorted(out, key=repr)


def run(spark, scratch, rows, **kw):  # noqa: F811
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "id bigint, vector array<int>, label int, uid string, i string").coalesce(1)
    got = H.hard_negatives(df, F.col("id") % 100 == 0, scratch, **kw)
    cols = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
    return sorted((tuple(r[c] for c in cols) for r in got.collect()), key=repr)


def test_all_windows_match_brute_force(spark, scratch):  # noqa: F811
    rng = np.random.default_rng(1)
    centres = rng.integers(-60, 60, (9, 10))
    rows = [(int(k), (centres[k % 9] + rng.integers(-15, 15, 10)).tolist(), int(rng.integers(3))) for k in range(1500)]
    # repeated rows, equal ids, null ids, short and empty vectors, rows that take no part
    rows += rows[:50] + [(None, rows[0][1], 1), (None, rows[0][1], 0), (100, rows[3][1][:4], 0), (200, [], 1), (300, None, 1), (400, rows[5][1], None), (500, [None] * 10, 2)]
    want = brute(rows)
    assert len(want) > 300 and run(spark, scratch, rows) == want
    assert run(spark, scratch, rows, cell_rows=2, fit_rows=64) == want  # whatever the codebooks are like


def test_a_third_of_the_rows_with_one_vector(spark, scratch):  # noqa: F811
    rng = np.random.default_rng(2)
    rows = [(k, [30] * 8 if k % 3 == 0 else rng.integers(-40, 40, 8).tolist(), k % 2) for k in range(900)]
    assert run(spark, scratch, rows) == brute(rows)


def test_nothing_to_search(spark, scratch):  # noqa: F811
    assert run(spark, scratch, []) == []
    assert run(spark, scratch, [(100, None, 1), (200, [1], None)]) == []
    assert run(spark, scratch, [(101, [1], 1)]) == []  # no anchor
    assert run(spark, scratch, [(100, [1], 1)]) == []  # no positive
    assert run(spark, scratch, [(100, [0], 1), (1, [0], 1), (2, [0], 2)]) == [(100, 1, 1, 2, 0, 0)]  # zero is within its window
    assert run(spark, scratch, [(100, [5], 1), (1, [-2], 1), (2, [-1], 2)]) == []  # a negative score has no window


def test_blocks_of_anchors_give_the_same(spark, scratch, monkeypatch):  # noqa: F811
    rng = np.random.default_rng(3)
    rows = [(k * 10, rng.integers(-40, 40, 6).tolist(), k % 3) for k in range(300)]
    whole = run(spark, scratch, rows)
    monkeypatch.setattr(H, "BLOCK_BYTES", 2000)
    assert run(spark, scratch, rows) == whole == brute(rows)


def test_a_walk_falls_and_bounds_its_rows():
    import pyarrow as pa

    rng = np.random.default_rng(4)
    v = rng.integers(-50, 50, (400, 7))
    centres = H.codebook(v[:, :4].astype(float), 6), H.codebook(v[:, 4:].astype(float), 6)
    batch = pa.table({"id": range(400), "uid": range(400), "label": [0] * 400, "vector": pa.array(v.tolist(), pa.list_(pa.int32())),
                      "i": H.nearest(v[:, :4], centres[0]), "j": H.nearest(v[:, 4:], centres[1])}).to_batches()
    chunk = H.Chunk(batch, centres, 7)
    anchor = v[0].astype(float)
    seen, last = [], np.inf
    for upper, lower, rows in chunk.walk(anchor):
        assert upper <= last
        last = upper
        if rows:
            scores = chunk.v[rows[0]:rows[1]] @ anchor
            assert (scores <= upper).all() and (scores >= lower).all()
            seen += range(*rows)
    assert sorted(seen) == list(range(400))


def test_certified_walks_leave_cells_out():
    """Clustered vectors: a window is certified long before every row is scored."""
    import pyarrow as pa

    rng = np.random.default_rng(5)
    middle = rng.integers(-100, 100, (40, 8))
    v = (middle[np.arange(8000) % 40] + rng.integers(-3, 4, (8000, 8)))
    centres = H.codebook(v[:, :4].astype(float), 40), H.codebook(v[:, 4:].astype(float), 40)
    batch = pa.table({"id": range(8000), "uid": range(8000), "label": [0] * 8000, "vector": pa.array(v.tolist(), pa.list_(pa.int32())),
                      "i": H.nearest(v[:, :4], centres[0]), "j": H.nearest(v[:, 4:], centres[1])}).to_batches()
    chunk, scored = H.Chunk(batch, centres, 8), []
    offer = chunk._offer
    chunk._offer = lambda a, held, w: (scored.extend(held), offer(a, held, w))
    best = H.Best(5, 0, True, 0)
    chunk.scan(v[0].astype(float), [best])
    want = sorted(((-int(s), k) for k, s in enumerate(v @ v[0]) if k), )[:5]
    assert [(r[0], r[3]) for r in best.rows] == want
    assert sum(b - a for a, b in scored) < 2000


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_recall_on_the_table_is_whole(spark, sf):
    got = {(r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"]) for r in H.op13_hard_negatives(spark, sf).collect()}
    rows = []
    for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect():
        lab = (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]
        rows.append((r["vec_id"], np.floor(256 * np.array(r["embedding"], dtype=np.float64)).astype(int).tolist(), lab))
    assert got == {x[:4] for x in brute(rows)}


def test_components_that_do_not_fit_fail(spark, scratch):  # noqa: F811
    with pytest.raises(Exception, match="too large"):
        run(spark, scratch, [(100, [1 << 24], 1), (1, [1], 1)])


def test_scaling_drops_what_is_not_finite(spark):
    df = spark.createDataFrame([([0.5, -0.001],), ([float("nan")],), ([float("inf")],), ([None],), (None,), ([],)], "v array<float>")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    got = [r[0] for r in df.select(H.scaled(F.transform("v", finite)).cast("array<int>")).collect()]
    assert got == [[128, -1], [None], [None], [None], None, []]
