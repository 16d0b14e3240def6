"""URL rules and reputation, line templates and resharding against brute force."""

import random
from collections import Counter, defaultdict

import pytest
from llm_fixtures import docs_of, scratch  # noqa: F401
from pyspark.sql import functions as F

from tessera.llm import hosts, line_templates, reshard

SF_SMALL = "/root/testdata/sf0.001"


# --- hosts ----------------------------------------------------------------------------
def urls_df(spark, urls):
    return spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id bigint, url string")


def test_url_parts_and_rules(spark, scratch):  # noqa: F811
    want = {
        "http://A.Example.NET/en/x?y#z": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "https://example.net/de/": ("example.net", "/de/", "net/", "block"),
        "x://net": ("net", "", None, "allow"),
        "x://notexample.com/de/1": ("notexample.com", "/de/1", None, "allow"),
        "x://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/", "block"),
        "x://É.org/fr/a://b/c": ("É.org", "/fr/a://b/c", "org/fr/", "allow"),
        "x://h?/p": ("h", "", None, "allow"),
        "x://h#/p": ("h", "", None, "allow"),
        "nothing": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "x:///only/path": ("", "/only/path", None, "allow"),
        "x://a\nb/c\nd": ("a\nb", "/c\nd", None, "allow"),
    }
    none = spark.createDataFrame([], "host string, good int")
    got = hosts.judge(urls_df(spark, list(want)).withColumn("domain", F.lit("x")).withColumn("b", F.lit(1)), none, scratch)
    assert {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in got.collect()} == want


def test_bad_hosts_are_blocked_and_unknown_ones_follow_their_domain(spark, scratch):  # noqa: F811
    rows = [("bad.spam.org", 0)] * 60 + [("worse.spam.org", 0)] * 60 + [("good.fine.org", 1)] * 80 + [("few.fine.org", 0)] * 2
    rows += [(f"h{i}.d{i}.de", int(i % 5 > 0)) for i in range(100)]
    outcomes = spark.createDataFrame(rows, "host string, good int")
    urls = [f"http://{h}/" for h in ("bad.spam.org", "new.spam.org", "good.fine.org", "few.fine.org", "new.fine.org", "new.unknown.de", "a.zz")]
    got = {r["host"]: r["verdict"] for r in hosts.judge(urls_df(spark, urls), outcomes, scratch, rules=()).collect()}
    assert got == {
        "bad.spam.org": "block", "new.spam.org": "block", "good.fine.org": "allow", "few.fine.org": "allow",
        "new.fine.org": "allow", "new.unknown.de": "allow", "a.zz": "allow",
    }


def test_suffixes_of_two_labels(spark):
    df = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("x.y.de",), ("de",), ("",)], "host string")
    got = {r["host"]: (r["d"], r["s"]) for r in df.select("host", hosts.domain_of(F.col("host")).alias("d"), hosts.suffix_of(F.col("host")).alias("s")).collect()}
    assert got == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk": ("b.co.uk", "co.uk"), "x.y.de": ("y.de", "de"), "de": ("de", "de"), "": ("", "")}


def test_no_pages(spark, scratch):  # noqa: F811
    assert hosts.judge(urls_df(spark, []), spark.createDataFrame([], "host string, good int"), scratch).count() == 0


# --- lines ----------------------------------------------------------------------------
def slow_cut(rows, min_docs):
    split = [(d, n, line.split()) for d, (_, text) in enumerate(rows) for n, line in enumerate((text or "").split("\n"))]
    split = [x for x in split if x[2]]
    whole = defaultdict(set)
    for d, _, w in split:
        whole[tuple(w)].add(d)
    gone = {(d, n) for d, n, w in split if len(whole[tuple(w)]) >= (min_docs if len(w) < 50 else 2)}
    lines = [(d, n, ["<*>" if any(c in "0123456789" for c in t) else t for t in w]) for d, n, w in split if len(w) > 3]
    lines = [(d, n, w[3:], (len(w), tuple(w[:3]))) for d, n, w in lines]
    leaves = Counter(leaf for *_, leaf in lines)
    seen = Counter((leaf, i, t) for _, _, w, leaf in lines for i, t in enumerate(w) if t != "<*>")
    templates, where = {}, defaultdict(set)
    for d, n, w, leaf in lines:
        t = tuple(x if x != "<*>" and seen[leaf, i, x] >= max(min_docs, 0.05 * leaves[leaf]) else "<*>" for i, x in enumerate(w))
        if sum(x != "<*>" for x in t) >= 0.6 * len(t):
            templates[d, n] = (leaf, t)
            where[leaf, t].add(d)
    gone |= {k for k, t in templates.items() if len(where[t]) >= min_docs}
    return ["\n".join(x for n, x in enumerate((text or "").split("\n")) if (d, n) not in gone) for d, (_, text) in enumerate(rows)]


def test_short_long_and_numbered_lines(spark, docs_of, scratch):  # noqa: F811
    long = " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    said = ["He said that apples fall", "He said that rivers bend", "He said that nobody knew", "He said that winters end", "He said that music helps", "He said that doors close"]
    rows = []
    for i in range(8):
        lines = ["Menu", "Read on", f"own {i}", "10:45 2024-01-02 17 3 99", said[i % 6] + (" soon" if i > 5 else "")]
        lines += [long] * (i in (2, 5)) + [long + " more"] * (i == 3)
        rows.append((i, "\n".join(lines)))
    rows += [(50, "two words " * 500_000), (51, "two words " * 500_000), (52, "one\ntwo\n" * 50_000)]
    got = {r["doc_id"]: r["text"] for r in line_templates.drop_recurring(docs_of(rows), scratch).collect()}
    assert list(got[i] for i, _ in rows) == slow_cut(rows, 6)
    for i in range(8):
        # short and numbered lines that recur unchanged go, and a long passage of two documents; what only leads alike stays
        assert got[i].split("\n") == [f"own {i}", said[i % 6] + (" soon" if i > 5 else "")] + [long + " more"] * (i == 3)
    assert got[50] == got[51] == "" and got[52] == rows[-1][1]


def test_a_line_of_a_third_of_the_documents(spark, docs_of, scratch):  # noqa: F811
    rows = [(i, f"own line number {chr(97 + i % 26)}{i}" + ("\nshared by very many documents here" if i % 3 == 0 else "")) for i in range(900)]
    got = {r["doc_id"]: r["n_dropped"] for r in line_templates.drop_recurring(docs_of(rows), scratch).collect()}
    assert got == {i: int(i % 3 == 0) for i in range(900)}


def test_recurring_templates_go(spark, docs_of, scratch):  # noqa: F811
    rng = random.Random(5)
    rows = []
    for i in range(30):
        lines = [f"page {i} of {rng.randint(1, 99)} printed", "all rights reserved here", f"{rng.random()} unique words stay {i} alone x{i}"]
        lines += ["the user " + rng.choice(["anna", "bob", "carl", "dora"]) + f" logged in from home at {rng.choice(['noon', 'night'])}"]
        lines += [" ".join(rng.choice("abcdefgh") for _ in range(rng.randint(0, 6))) for _ in range(4)] + ["", "  "]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines)))
    rows += [(100, None), (101, ""), (102, "all rights reserved here\n" * 400), (102, "all rights\treserved  here"), (None, "alone")]
    got = line_templates.drop_recurring(docs_of(rows), scratch).collect()
    assert sorted((r["doc_id"] or -1, r["text"]) for r in got) == sorted(((i or -1), t) for (i, _), t in zip(rows, slow_cut(rows, 6)))
    assert all(r["n_lines"] >= r["n_dropped"] for r in got)
    assert not any("all rights reserved" in r["text"] for r in got)
    assert all("unique words stay" in r["text"] for r in got if r["doc_id"] is not None and r["doc_id"] < 30)


def test_no_documents_no_lines(spark, docs_of, scratch):  # noqa: F811
    assert line_templates.drop_recurring(docs_of([]), scratch).count() == 0


# --- shards ---------------------------------------------------------------------------
def test_transfers_move_the_fewest_bytes():
    rng = random.Random(7)
    for _ in range(60):
        sizes = {i: rng.randint(0, 50) for i in rng.sample(range(9), rng.randint(1, 6))}
        shards = rng.sample(range(9), rng.randint(1, 6))
        total, capacity = sum(sizes.values()), {}
        for s in shards:
            capacity[s] = rng.randint(0, 40)
        capacity[shards[0]] += max(0, total - sum(capacity.values()))
        moves = reshard.transfers(sizes, capacity)
        after = Counter(sizes)
        for m in moves:
            assert m.size > 0 and m.old != m.new
            after[m.old] -= m.size
            after[m.new] += m.size
        assert all(0 <= n <= capacity.get(s, 0) for s, n in after.items())
        assert sum(m.size for m in moves) == sum(max(0, n - capacity.get(s, 0)) for s, n in sizes.items())
    with pytest.raises(ValueError):
        reshard.transfers({0: 5}, {0: 4})


def test_shards_are_whole_even_and_gapless(spark, docs_of, scratch):  # noqa: F811
    rng = random.Random(1)
    rows = [(i, "x" * int(rng.expovariate(0.01))) for i in range(600)] + [(7, None), (7, None), (None, "é"), (8, "")]
    got = reshard.rewrite(docs_of(rows), reshard.old_shard(4), 6, scratch).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"], r["text"] is None, r["text"]) for r in got) == sorted((i is None, i, t is None, t) for i, t in rows)
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        assert r["size"] == len((r["text"] or "").encode()) + 8
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert sorted(sizes) == list(range(6)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.02 * sum(sizes.values()) / 6
    moved = sum(r["size"] for r in got if r["old"] != r["shard"])
    assert abs(moved - sum(sizes.values()) / 3) < 0.02 * sum(sizes.values())


def test_untouched_shards_keep_their_rows(spark, docs_of, scratch):  # noqa: F811
    rows = [(i, "abc") for i in range(40)]
    got = reshard.rewrite(docs_of(rows), reshard.old_shard(4), {0: 110, 1: 55, 2: 110, 3: 110, 4: 55}, scratch).collect()
    by = defaultdict(list)
    for r in got:
        by[r["shard"]].append((r["slot"], r["doc_id"]))
    assert {s: len(v) for s, v in by.items()} == {0: 10, 1: 5, 2: 10, 3: 10, 4: 5}
    assert all(sorted(n for n, _ in v) == list(range(len(v))) for v in by.values())
    assert sorted(by[0]) == [(n, 4 * n) for n in range(10)]


def test_no_documents_no_shards(spark, docs_of, scratch):  # noqa: F811
    assert reshard.rewrite(docs_of([]), reshard.old_shard(4), 6, scratch).count() == 0
