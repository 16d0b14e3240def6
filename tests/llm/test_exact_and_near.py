"""Exact and near dedup against brute force, with nulls, ties, repeats and forced hash collisions."""

import random
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from llm_fixtures import docs_of, scratch  # noqa: F401
from tessera.llm import exact_dedup, simhash

ROWS = [
    (1, "a b"), (2, "ab"), (3, "a\tb\n"), (4, None), (5, ""), (6, " "), (7, "x"), (7, "x"), (8, "é è"), (9, "éè"),
    (None, "ab"), (10, "long " * 5000), (11, "long" * 5000), (12, "only one"),
]


def brute(rows):
    groups = {}
    for at, (i, t) in enumerate(rows):
        norm = "".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r")
        groups.setdefault(norm, []).append((-len(t or ""), i is None, i or 0, at, i))
    return {norm: (min(own)[4], len(own)) for norm, own in groups.items()}


def check_exact(found, rows):
    want = brute(rows)
    got = [r.asDict() for r in found.collect()]
    assert len(got) == len(rows)
    norm = {}
    for i, t in rows:
        norm.setdefault(i, []).append("".join(c for c in t or "" if c not in " \t\n\x0b\x0c\r"))
    for r in got:
        assert any((r["keep_id"], r["group_size"]) == want[n] for n in norm[r["doc_id"]]), r
    assert sum(r["kept"] for r in got) == len(want)


def test_exact_dedup_matches_brute_force(spark, docs_of, scratch):
    check_exact(exact_dedup.exact_dedup(docs_of(ROWS), scratch), ROWS)


def test_state_holds_over_batches(spark, docs_of, scratch):
    rows = [(i, f"text {i % 7}") for i in range(60)]
    check_exact(exact_dedup.exact_dedup(docs_of(rows, extra=False), scratch, files_per_batch=1), rows)


def test_the_query_runs_in_batches(spark, scratch, tmp_path, monkeypatch):
    rows = [(i, f"text {i % 7}") for i in range(12 * spark.sparkContext.defaultParallelism)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3 * spark.sparkContext.defaultParallelism)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(exact_dedup, "Scratch", lambda *_: scratch)
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        check_exact(exact_dedup.op10_exact_dedup(spark, str(tmp_path)), rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert len(list(Path(scratch.path.removeprefix("file:")).glob("updates-*/batch=*"))) > 1


def test_full_bytes_split_a_shared_digest(spark, docs_of, scratch):
    weak = lambda norm: F.unhex(F.substring(F.sha2(norm, 256), 1, 2))  # noqa: E731 - one byte: texts collide
    rows = [(i, f"text number {i % 300}") for i in range(900)]
    check_exact(exact_dedup.exact_dedup(docs_of(rows), scratch, digest=weak), rows)


def test_exact_dedup_of_nothing_and_of_memory_rows(spark, docs_of, scratch):
    assert exact_dedup.exact_dedup(docs_of([]), scratch).count() == 0


def test_keep_first_leaves_columns_and_best_rows(spark, docs_of, scratch):
    docs = docs_of(ROWS)
    kept = exact_dedup.keep_first(docs, scratch)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in kept.collect()) == sorted(
        [(3, "a\tb\n"), (6, " "), (7, "x"), (8, "é è"), (10, "long " * 5000), (12, "only one")]
    )


def test_rows_from_memory_are_placed_first(spark, scratch):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "doc_id bigint, text string").where("doc_id > 0")
    assert sorted(r["kept"] for r in exact_dedup.exact_dedup(df.groupBy("doc_id").agg(F.first("text").alias("text")), scratch).collect()) == [False, True]


# --- SimHash --------------------------------------------------------------------------
def slow_fingerprint(text, k):
    import xxhash

    words = []
    for c in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" "):
        words += [c] if c else []
    if not words:
        return 0
    grams = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint_matches_definition():
    for text in (None, "", " \n", "One", "a B c", "É a É a É a É", "the quick brown fox jumps over the lazy dog " * 30):
        assert simhash.fingerprint(text, 4) % (1 << 64) == slow_fingerprint(text, 4)


def test_segments_find_every_pair():
    """Every pattern of up to ``distance`` differing bits is within the radius in some segment."""
    rng = random.Random(3)
    for n in (10, 10**5, 10**7, 10**10):
        for distance in (0, 1, 3, 4, 5):
            plan = simhash.segments(n, distance)
            for _ in range(2000):
                diff = sum(1 << b for b in rng.sample(range(64), rng.randint(0, distance)))
                assert any((diff >> lo & ((1 << bits) - 1)).bit_count() <= r for lo, bits, r in plan)


def brute_components(fps, distance):
    left, out = set(fps), {}
    while left:
        todo, own = [left.pop()], []
        while todo:
            x = todo.pop()
            own.append(x)
            near = {y for y in left if (x ^ y).bit_count() <= distance}
            left -= near
            todo += near
        out |= dict.fromkeys(own, frozenset(own))
    return out


def families(rng, n):
    """Chains and clouds of near fingerprints around a few centres, many in the same buckets, and single ones."""
    out = set()
    for _ in range(3):
        x = rng.getrandbits(64)
        for _ in range(n):
            y = x
            for b in rng.sample(range(64), rng.randint(0, 6)):
                y ^= 1 << b
            out.add(y)
    return sorted(out | {rng.getrandbits(64) for _ in range(n)})


def test_links_and_components_match_brute_force(spark, scratch):
    fps = families(random.Random(5), 60)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    nodes = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    # small limits: crowded buckets and several blocks per bucket
    edges = simhash.links(nodes, 4, scratch, hot=4, block=16)
    root = {r["node"]: r["root"] for r in simhash.components(edges, scratch).collect()}
    groups = {}
    for x, s in zip(fps, signed):
        groups.setdefault(root.get(s, s), set()).add(x)
    want = brute_components(fps, 4)
    assert {frozenset(g) for g in groups.values()} == set(want.values())


def test_components_of_a_long_path(spark, scratch):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000, 1001)], "a bigint, b bigint")
    root = {r["node"]: r["root"] for r in simhash.components(edges, scratch).collect()}
    assert all(root[i] == 0 for i in range(1, 201)) and root[1001] == 1000


def test_near_groups_edge_cases(spark, docs_of, scratch):
    base = [f"word{i}" for i in range(300)]
    rows = [(3, " ".join(base)), (2, " ".join(base[:-1] + ["other"])), (9, None), (5, ""), (7, "\n"), (4, "a b c d"), (4, "A b  c D"), (None, "a B c d")]
    docs = docs_of(rows)
    got = sorted((str(r["doc_id"]), r["best"]["doc_id"]) for r in simhash.near_groups(docs, scratch).collect())
    assert got == sorted([("3", 2), ("2", 2), ("9", 5), ("5", 5), ("7", 5), ("4", 4), ("4", 4), ("None", 4)])
    assert simhash.near_groups(docs_of([]), scratch).count() == 0


def test_keep_one_keeps_one_row_of_each_group(spark, docs_of, scratch):
    docs = docs_of([(4, "a b c d"), (4, "A b  c D"), (1, "something else here now"), (2, None), (3, "")])
    kept = simhash.keep_one(docs, scratch)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4]


def test_forest_connects_what_links_connect():
    fps = np.array(families(random.Random(8), 40), dtype=np.uint64).view(np.int64)
    edges = simhash.forest(fps, 4)
    want = brute_components([int(x) % (1 << 64) for x in fps], 4)
    assert len(edges) == len(want) - len(set(want.values()))
    assert all(want[a % (1 << 64)] is want[b % (1 << 64)] for a, b in edges)
