"""Decontamination, toxicity and LM scoring against brute force and held-out rows."""

import math
import random
import weakref
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from llm_fixtures import docs_of, scratch  # noqa: F401
from tessera.llm import decontaminate, mixing, toxicity


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


# --- decontamination ------------------------------------------------------------------
def slow_words(text):
    out, word = [], ""
    for c in text or "":
        c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
        if c.isdigit() and c.isascii() or "a" <= c <= "z" or ord(c) > 127:
            word += c
        else:
            out += [word] if word else []
            word = ""
    return out + ([word] if word else [])


def slow_hits(text, items, window):
    w, hit, found = slow_words(text), set(), set()
    for item, t in items:
        v = slow_words(t)
        for i in range(max(1, len(v) - window + 1)) if v else ():
            g = v[i : i + window]
            for at in range(len(w) - len(g) + 1):
                if w[at : at + len(g)] == g:
                    hit.update(range(at, at + len(g)))
                    found.add("null" if item is None else str(item))
    return len(w), len(hit), sorted(found)


def cases():
    rng = random.Random(2)
    vocab = ["a", "b", "c", "dé", "é9", "X"]
    text = lambda n: rng.choice([" ", "-", ". "]).join(rng.choice(vocab) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)] + [(100, None), (101, ""), (101, "a"), (None, "a b c")]
    items = [(i, text(rng.randint(0, 9))) for i in range(12)] + [(50, None), (51, "..."), (52, "b"), (53, "b"), (None, "c dé")]
    docs += [(200 + i, "x " * i + (t or "") + " y" * 2000) for i, (_, t) in enumerate(items)]
    return docs, items


def check_find(spark, docs_of, scratch, **kw):
    docs, items = cases()
    found = decontaminate.find(docs_of(docs), docs_of(items, id_name="item_id"), scratch, window=4, **kw)
    want = sorted(str((i, *slow_hits(t, items, 4))) for i, t in docs)
    got = []
    for r in found.collect():
        spans = list(zip(r["spans"][::2], r["spans"][1::2]))
        got.append(str((r["doc_id"], r["n_words"], len({p for lo, hi in spans for p in range(lo, hi)}), sorted(r["items"]))))
    assert sorted(got) == want
    counted = sorted(str((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"])) for r in decontaminate.digests(found).collect())
    assert counted == sorted(str((i, n, h, len(f), h > 0)) for i, n, h, f in ((i, *slow_hits(t, items, 4)) for i, t in docs))


def test_windows_match_brute_force(spark, docs_of, scratch):
    check_find(spark, docs_of, scratch)


def test_blocks_of_windows_match_brute_force(spark, docs_of, scratch):
    check_find(spark, docs_of, scratch, block=20, shingle=2)


def test_a_shared_window_and_long_words_stay_within_blocks(spark, docs_of, scratch):
    """A third of the items share a text, one word is very long: blocks are cut by distinct windows and their bytes."""
    long = "z" * 5000
    items = [(i, "the same four words") for i in range(40)] + [(100 + i, f"q{i} r{i} s{i} t{i}") for i in range(80)] + [(300, f"{long} a b c")]
    cut = decontaminate.windows(docs_of(items, id_name="item_id"), 4)
    found = decontaminate.numbered(cut, scratch).collect()
    assert len(found) == len({bytes(r["window"]) for r in found}) == 82 and len({r["id"] for r in found}) == 82
    assert max(r["id"] for r in found) == 82 + 5006 // decontaminate.WINDOW_BYTES
    docs = [(i, "x the same four words q7 r7 s7 t7") for i in range(50)] + [(90, f"a {long} a b c"), (91, "the same"), (92, "q3 r3 s3 t3")]
    got = decontaminate.find(docs_of(docs), docs_of(items, id_name="item_id"), scratch, window=4, block=15).collect()
    want = {i: slow_hits(t, items, 4) for i, t in docs}
    for r in got:
        n, hit, found = want[r["doc_id"]]
        spans = list(zip(r["spans"][::2], r["spans"][1::2]))
        assert (r["n_words"], len({p for lo, hi in spans for p in range(lo, hi)}), r["items"]) == (n, hit, found)
    assert len(got) == len(docs)


def test_contaminated_rows_go_and_others_stay(spark, docs_of, scratch):
    docs = docs_of([(1, "we saw one two three four here"), (2, "one two three five"), (3, None)])
    items = docs_of([(9, "One, two; three four")], id_name="item_id")
    kept = decontaminate.drop_contaminated(docs, items, scratch, window=4)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontaminate.find(docs, items.limit(0), scratch).where("size(spans) > 0").count() == 0


def test_empty_documents(spark, docs_of, scratch):
    assert decontaminate.find(docs_of([]), docs_of([(1, "a b")], id_name="item_id"), scratch).count() == 0


# --- toxicity -------------------------------------------------------------------------
def corpus(n=600, seed=4):
    rng = random.Random(seed)
    usual, bad = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)], ["grrr", "bah", "ugh"]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(usual) for _ in range(rng.randint(40, 200))]
        toxic = rng.random() < 0.2
        if toxic:
            words = [rng.choice(bad) if rng.random() < 0.06 else w for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_documents_are_told_apart(spark, docs_of, scratch):
    rows, labels = corpus()
    labels_df = spark.createDataFrame([(i, 1, t) for i, t in labels], "doc_id bigint, quality int, toxic int")
    docs = docs_of([*rows, (9000, None), (9001, ""), (None, "grrr"), (9002, "bah ugh " * 20000)])
    model = toxicity.fit(docs, labels_df, scratch)
    got = {r["doc_id"]: r["score"] for r in toxicity.differences(docs, model, ["doc_id"]).collect()}
    assert all(0 <= s <= 1 for s in got.values())
    held = [(i, t) for i, t in labels if fold(i, 5) == 0]
    right = sum((got[i] >= 0.5) == bool(t) for i, t in held)
    assert right / len(held) > max(0.95, 1 - sum(t for _, t in held) / len(held))
    assert got[9000] < 0.5 and got[9001] == got[9000] and got[9002] > 0.9
    kept = toxicity.keep_ordinary(docs, labels_df, scratch)
    assert kept.columns == docs.columns and 9002 not in {r["doc_id"] for r in kept.collect()}


def slow_models(texts, labels):
    """The two models by the definition: (gate, own terms, left weights, p(y, v, w), words) from plain counts."""
    import math
    from collections import Counter, defaultdict

    words = [toxicity.words_of(t) for t in texts]
    n, before, docs = [Counter(), Counter()], [defaultdict(set), defaultdict(set)], [Counter(), Counter()]
    for own, y in zip(words, labels):
        for u, v, w in zip(["", "", *own], ["", *own], own):
            n[y][v, w] += 1
            before[y][v, w].add(u)
        docs[y].update(set(own))
    sizes = [labels.count(0), labels.count(1)]
    pairs = set(n[0]) | set(n[1])
    vocabulary = sorted({w for _, w in pairs})
    cont = [Counter(w for _, w in n[y]) for y in (0, 1)]
    shared = Counter(w for _, w in pairs)
    total, C = sum(shared.values()), [sum(c.values()) for c in cont]
    D = toxicity.DISCOUNT

    def g2(a, na, b, nb):
        def part(k, of, p):
            return (k * math.log(p) if k and p else 0.0) + ((of - k) * math.log(1 - p) if of > k and p < 1 else 0.0)

        p = (a + b) / (na + nb)
        return 2 * (part(a, na, a / na) + part(b, nb, b / nb) - part(a, na, p) - part(b, nb, p))

    share = lambda w: max(shared[w] - D, 0) / total + D * len(vocabulary) / total / (len(vocabulary) + 1)
    limit = toxicity.GATE * math.log(len(vocabulary))
    kept = [w for w in vocabulary if g2(docs[1][w], sizes[1], docs[0][w], sizes[0]) >= limit]
    own = {w: [max(cont[y][w] - D, 0) / C[y] for y in (0, 1)] for w in kept}
    left = [1 - sum(p[y] for p in own.values()) for y in (0, 1)]
    spoken = [{p: len(us) for p, us in before[y].items()} for y in (0, 1)]
    of = [Counter() for _ in (0, 1)]
    for y in (0, 1):
        for (_, w), k in spoken[y].items():
            of[y][w] += k
    limit = toxicity.GATE * math.log(len(pairs))
    told = [p for p in pairs if of[0][p[1]] and of[1][p[1]] and g2(spoken[1].get(p, 0), of[1][p[1]], spoken[0].get(p, 0), of[0][p[1]]) >= limit]
    after = [Counter(), Counter()]
    for y in (0, 1):
        for (v, _), k in n[y].items():
            after[y][v] += k
    own_pair = {p: [max(n[y][p] - D, 0) / after[y][p[0]] if after[y][p[0]] else 0.0 for y in (0, 1)] for p in told}
    left_after = {v: [1 - sum(m[y] for (x, _), m in own_pair.items() if x == v) for y in (0, 1)] for v, _ in told}

    def p(y, v, w):
        low = own.get(w, [0, 0])[y] + left[y] * share(w)
        return own_pair.get((v, w), [0, 0])[y] + left_after.get(v, [1, 1])[y] * low

    return kept, told, p, share, vocabulary


def told_corpus():
    """Toxic words, and a word that is toxic only after another."""
    rows, labels = corpus(400)
    rng = random.Random(1)
    out = []
    for (_, text), (_, y) in zip(rows, labels):
        words = text.split()
        for _ in range(rng.randint(1, 4)):
            at = rng.randrange(len(words))
            words[at:at] = ["you", "lamp"] if y else [rng.choice(["the", "a"]), "lamp"]
            words.insert(rng.randrange(len(words)), "you")
        out.append(" ".join(words))
    return out, [y for _, y in labels]


def test_probabilities_of_the_lower_order_sum_to_one(spark, docs_of, scratch):
    """Of both orders: over the vocabulary and the word that was never seen, after every kind of context, in each class."""
    texts, labels = told_corpus()
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int")
    model = toxicity.Model()
    toxicity.learn(model, scratch.table(toxicity.pair_counts(df), "counts"), labels.count(0), labels.count(1))
    kept, told, p, share, vocabulary = slow_models(texts, labels)
    assert {"grrr", "bah", "ugh"} <= set(model.word) and all(model.word[w] > 1 for w in ("grrr", "bah", "ugh"))
    assert set(model.own) == set(kept) and set(model.pair) == set(told) and ("you", "lamp") in model.pair
    for y in (0, 1):
        for v in ("", "you", "grrr", "never seen"):
            each = [model.probability(y, v, w, share(w)) for w in [*vocabulary, "never seen"]]
            assert min(each) > 0 and abs(sum(each) - 1) < 1e-9
            assert all(abs(q - p(y, v, w)) < 1e-12 for q, w in zip(each, vocabulary))


def test_differences_equal_brute_force(spark, docs_of, scratch):
    import math

    texts, labels = told_corpus()
    model = toxicity.Model()
    df = spark.createDataFrame(list(zip(texts, labels)), "text string, toxic int")
    toxicity.learn(model, scratch.table(toxicity.pair_counts(df), "counts"), labels.count(0), labels.count(1))
    p = slow_models(texts, labels)[2]
    for text in [*texts[:60], "", "you lamp lamp", "nothing of this was seen", "grrr you lamp"]:
        w = toxicity.words_of(text)
        want = sum(math.log(p(1, v, x) / p(0, v, x)) for v, x in zip(["", *w], w))
        assert abs(model.difference(w) - want) < 1e-9


def test_copies_of_a_passage_speak_once(spark, docs_of, scratch):
    """A pair in many copies of one toxic text isn't told apart by their number."""
    rows, labels = corpus(300)
    texts = [t for _, t in rows] + ["wzz the same " + rows[0][1] + " quick wab brown"] * 200
    df = spark.createDataFrame([(t, y) for t, y in zip(texts, [y for _, y in labels] + [1] * 200)], "text string, toxic int")
    counts = toxicity.pair_counts(df).where("v = 'quick' AND w = 'wab'").first()
    assert (counts["n1"], counts["docs1"], counts["n0"], counts["docs0"]) == (200, 1, 0, 0)


def test_labels_of_one_kind_give_the_prior(spark, docs_of, scratch):
    docs = docs_of([(1, "a b"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert toxicity.fit(docs, none, scratch).prior == 0.0
    one = spark.createDataFrame([(1, 1, 1), (1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(docs, one, scratch)
    assert model.weights is None and model.score(np.zeros(1), np.zeros(1))[0] in (0.0, 1.0)
    assert toxicity.differences(docs_of([]), model, ["doc_id"]).count() == 0


# --- LM scoring -----------------------------------------------------------------------
def test_scores_and_base_match_definition(spark, docs_of, scratch):
    rng = random.Random(6)
    vocab = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(vocab[min(59, int(rng.expovariate(0.1)))] for _ in range(rng.randint(0, 80)))
    rows = [(i, text()) for i in range(150)] + [(500, None), (501, ""), (502, "W1 \n w1\tnever-seen " * 3), (None, "w2")]
    got = mixing.score(docs_of(rows), scratch, tree_words=8, dictionary=20).collect()
    tokens = lambda t: (t or "").lower().split() + [None]
    train = Counter(x for i, t in rows if fold("" if i is None else i, 10) for x in tokens(t))
    n, v = sum(train.values()), len(train)
    assert len(got) == len(rows)
    want = {i: t for i, t in rows}
    for r in got:
        own = tokens(want[r["doc_id"]])
        base = sum(math.log10((train[x] + 0.1) / (n + 0.1 * (v + 1))) for x in own)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(train[x] > 0 for x in own), n)
        assert r["held_out"] == (fold("" if r["doc_id"] is None else r["doc_id"], 10) == 0)
        assert abs(r["base_score"] - base) < 1e-8 and r["score"] < 0
    assert mixing.score(docs_of([]), scratch).count() == 0


def test_scores_do_not_depend_on_partitions_and_long_texts_are_cut(spark, docs_of, scratch, monkeypatch):
    """1 and 8 partitions; texts longer than a chunk, with their words before carried over; bits per byte."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(40)]
    text = lambda n: " ".join(vocab[min(39, int(rng.expovariate(0.2)))] for _ in range(n))
    rows = [(i, text(rng.randint(0, 60))) for i in range(300)] + [(1000, text(5000)), (1001, text(5000)), (1002, None), (1003, "é")]
    docs = docs_of(rows)
    monkeypatch.setattr(mixing, "CLASS_ROWS", 7)
    key = lambda r: r["doc_id"]
    one = sorted(mixing.score(docs.coalesce(1), scratch, tree_words=8, dictionary=20).collect(), key=key)
    many = sorted(mixing.score(docs.repartition(8), scratch, tree_words=8, dictionary=20).collect(), key=key)
    want = dict(rows)
    for a, b in zip(one, many):
        assert a["doc_id"] == b["doc_id"] and abs(a["score"] - b["score"]) <= 1e-6 * abs(a["score"])
        size = len((want[a["doc_id"]] or "").encode())
        assert a["n_bytes"] == size and abs(a["bits"] + a["score"] * math.log2(10)) < 1e-6
        assert a["bits_per_byte"] is None if not size else abs(a["bits_per_byte"] - a["bits"] / size) < 1e-9
    coder = mixing.Coder(mixing.huffman_tree([b"w0", b"w1", b"w2"], [9, 5, 1], 4, 7))
    texts = [coder.symbols(mixing.words_of(t)) for _, t in rows[:20] + rows[300:302]]
    whole = coder.bits(*coder.tokens(texts))
    monkeypatch.setattr(mixing, "CHUNK_TOKENS", 1000)
    cut = list(coder.runs(texts))
    assert len(cut) > 10 and max(len(n) for _, _, n in cut) == 1000
    assert all(np.array_equal(np.concatenate([c[0][k] for c in cut]), whole[0][k]) for k in range(mixing.TABLES))
    assert all(np.array_equal(np.concatenate([c[k] for c in cut]), whole[k]) for k in (1, 2))


def test_probabilities_of_the_next_token_sum_to_one():
    rng = np.random.default_rng(1)
    tree = mixing.huffman_tree([b"a", b"b", b"c"], [9, 5, 1], 4, 7)
    coder = mixing.Coder(tree)
    tables = mixing.tables_of(rng.integers(0, 9, (mixing.TABLES, 1 << mixing.SLOTS, 2)))
    mixer = mixing.Mixer.fresh()
    total = 0.0
    for s in range(5):  # every symbol after the same two words
        sym = np.array([0, 1, s])
        slots, bit, n = coder.bits(*coder.tokens([(sym, sym)]))
        assert n.tolist() == tree.length[sym].tolist()
        total += 10 ** mixer.log10(tables, slots, bit)[-tree.length[s] :].sum()
    assert abs(total - 1) < 1e-5


def test_mixing_learns_what_the_context_tells():
    """An alternating text is far more likely than its unigram share once weights are taught."""
    tree = mixing.huffman_tree([b"a", b"b"], [50, 50], 1, 1)
    coder = mixing.Coder(tree)
    texts = [coder.symbols([b"a", b"b"] * 2000)] * 4
    slots, bit, _ = coder.bits(*coder.tokens(texts))
    counts = np.zeros((mixing.TABLES, 1 << mixing.SLOTS, 2))
    for k, s in enumerate(slots):
        np.add.at(counts[k], (s, bit), 1)
    tables, mixer = mixing.tables_of(counts), mixing.Mixer.fresh()
    before = mixer.log10(tables, slots, bit).sum()
    mixer.learn(tables, slots, bit, np.zeros_like(mixer.weights))
    after = mixer.log10(tables, slots, bit).sum()
    assert after > before and after / len(bit) > math.log10(0.9)


# --- memory ---------------------------------------------------------------------------
@pytest.mark.parametrize("module", [toxicity, decontaminate])
def test_a_worker_holds_the_words_of_one_text(monkeypatch, module):
    """Before, it held those of 8 MB of text: some 100 MB."""

    class Words(list):
        pass

    made, most, plain = [], [0], module.words_of

    def words_of(text):
        most[0] = max(most[0], sum(r() is not None for r in made))
        own = Words(plain(text))
        made.append(weakref.ref(own))
        return own

    monkeypatch.setattr(module, "words_of", words_of)
    texts = [f"one two three four {i}" for i in range(50)] + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": range(52), "text": texts, "_file": ["f"] * 52, "_row": range(52)})
    if module is toxicity:
        out = toxicity.scored(iter([batch]), toxicity.Model(word={"one": 2.0}), ["doc_id"])
    else:
        out = decontaminate.scanned(iter([batch]), decontaminate.Index([((b"two", b"three"), 7)], {}, 3))
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(52)] and len(made) == 52 and most[0] <= 1
    if module is toxicity:
        assert {(r["n"], r["difference"]) for r in rows} == {(4, 2.0), (0, 0.0)}
    else:
        assert [(r["n_words"], r["spans"], r["windows"]) for r in rows] == [(5, [1, 3], [7])] * 50 + [(0, [], [])] * 2
