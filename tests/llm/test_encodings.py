"""BPE and Huffman files against the tokenizers library, and exact round trips."""

import json
import random
import struct
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm_fixtures import docs_of, scratch  # noqa: F401
from tessera.llm import bpe, huffman, stretches

PATH = public_tokenizers.path("word_bpe_49k.json")
SF_SMALL = "/root/testdata/sf0.001"
ALPHABET = ["a", "b", "A", "Σ", "İ", "é", "é", " ", "\n", "1", "'s", "'", "!", "<|endoftext|>", "<|", "ß", "漢", "🙂", "\x00", "\x85", "　", "́", "²"]


def texts():
    rng = random.Random(9)
    mixed = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    words = ["".join(rng.choice("abtheinrso") for _ in range(rng.randint(1, 60))) for _ in range(300)]
    return [None, "", "   \n", *mixed, *words, "the end of it " * 8000]


@pytest.fixture(scope="module")
def reference():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def test_ids_and_texts_match_the_library(spark, docs_of, reference):
    rows = list(enumerate(texts()))
    got = {r["doc_id"]: (r["ids"], r["decoded"]) for r in bpe.encode_decode(docs_of(rows), bpe.load(PATH)).collect()}
    for i, t in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        assert got[i] == (ids, reference.decode(ids, skip_special_tokens=False)), t


def test_every_prefix_has_the_unique_last_token():
    """The stored token is what merging by rank gives for the prefix."""
    b = bpe.Bpe(json.loads(bpe.load(PATH)))
    for w in ("internationalization", "thehththat", "don", "ééaux", "1"):
        symbols = [b.bytes[c] for c in w.encode()]
        symbols[-1] += b.end
        assert list(b.word(w)) == b.merged([b.vocab[s] for s in symbols])


def test_digests_of_edge_cases(spark, docs_of):
    got = bpe.digests(docs_of([(1, None), (1, ""), (None, "x")]), bpe.load(PATH)).collect()
    assert sorted(r["n_tokens"] for r in got) == [0, 0, 1] and len({r["ids_sha256"] for r in got}) == 2
    assert bpe.digests(docs_of([]), bpe.load(PATH)).count() == 0


def test_tables_are_small():
    """Before, the tables took 49 MB: a dictionary for every node of the automaton and for every token."""
    spec = json.loads(bpe.load(PATH))
    tracemalloc.start()
    b = bpe.Bpe(spec)
    size, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert b.one_way and size < 25e6


def test_known_pairs_take_each_others_places(monkeypatch, reference):
    """Before, up to 600,000 pairs were kept, each as objects of its own; now a pair gives way to another of the same place."""
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 7)
    b = bpe.Bpe(json.loads(bpe.load(PATH)))
    for text in filter(None, texts()):
        ids = reference.encode(text, add_special_tokens=False).ids
        assert b.chunk(text) == ids and b.chunk(text) == ids
    assert len(b.fits) == 7


def test_a_worker_holds_little():
    """Before, 8 MB of text were encoded at once, and a remembered word took 300 bytes."""
    seen = []
    texts = pa.array(["the end of it " * 5000] * 120)
    for b in bpe.portions(iter([pa.RecordBatch.from_arrays([texts], ["text"])])):
        seen.append(b.column("text").to_pylist())
    assert sum(seen, []) == texts.to_pylist()
    assert max(sum(map(len, own)) for own in seen) <= 2 << 20
    w = bpe.Worker(bpe.load(PATH))
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("abtheinrso") for _ in range(9)) for _ in range(4000)})
    w.digests(pa.array([" ".join(words)]))
    assert {type(v) for v in w.words.values()} == {bytes} and len(w.words) == len(words)
    assert sum(sys.getsizeof(k) + sys.getsizeof(v) for k, v in w.words.items()) < 160 * len(words)
    assert w.words.limit <= 200_000


# --- Huffman --------------------------------------------------------------------------
def test_code_lengths_are_optimal_and_limited():
    rng = np.random.default_rng(3)
    for limit in (9, 12, 16):
        counts = rng.zipf(1.3, 400).clip(0, 10**7) * (rng.random(400) > 0.2)
        n = huffman.code_lengths(counts, limit)
        assert ((n > 0) == (counts > 0)).all() and n.max() <= limit
        assert sum(2.0 ** -n[n > 0].astype(float)) == 1.0
    # without a binding limit: the cost of an ordinary Huffman code
    import heapq

    heap, cost = [int(c) for c in counts if c], 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        cost += s
        heapq.heappush(heap, s)
    free = huffman.code_lengths(counts, 40)
    assert int((free * counts).sum()) == cost <= int((n * counts).sum())


def test_blocks_round_trip():
    rng = np.random.default_rng(4)
    counts = rng.integers(1, 1000, 500)
    n = huffman.code_lengths(counts)
    for sizes in ([1], [1, 1, 700, 3], [huffman.STEP], [huffman.STEP + 1, 5000]):
        docs = [rng.integers(0, 500, s).astype(np.uint32) for s in sizes]
        got = huffman.unpack(huffman.pack(docs, n, huffman.canonical(n)), huffman.decode_table(n))
        assert len(got) == len(docs) and all((a == b).all() for a, b in zip(got, docs))


def test_one_id_alone_has_a_code():
    n = huffman.code_lengths(np.array([0, 5, 0]))
    assert n.tolist() == [0, 1, 0]
    assert huffman.unpack(huffman.pack([np.array([1, 1])], n, huffman.canonical(n)), huffman.decode_table(n))[0].tolist() == [1, 1]


def test_files_round_trip(spark, docs_of, scratch, reference, monkeypatch):
    monkeypatch.setattr(huffman, "BLOCK_IDS", 64)
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts())]
    path = huffman.write_files(docs_of(rows), scratch, bpe.load(PATH), 49408)
    got = {r["doc_id"]: r for r in huffman.read_files(spark, path).collect()}
    start = 0
    for i, t in sorted(rows):
        ids = reference.encode(t or "", add_special_tokens=False).ids + [huffman.END]
        assert (got[i]["start"], got[i]["n_tokens"]) == (start, len(ids))
        assert bytes(got[i]["ids"]) == struct.pack(f"<{len(ids)}I", *ids)
        start += len(ids)


def test_files_of_repeated_null_and_no_ids(spark, docs_of, scratch):
    path = huffman.write_files(docs_of([(2, "a"), (2, "a"), (None, "b"), (1, None)]), scratch, bpe.load(PATH), 49408)
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"]) for r in huffman.read_files(spark, path).collect()))
    assert got == [(0, None, 2), (2, 1, 1), (3, 2, 2), (5, 2, 2)]
    empty = huffman.write_files(docs_of([]), scratch, bpe.load(PATH), 49408)
    assert huffman.read_files(spark, empty).count() == 0


def test_query_crc(spark):
    got = huffman.op8_huffman(spark, SF_SMALL).orderBy("doc_id").limit(1).first()
    text = spark.read.parquet(f"{SF_SMALL}/documents.parquet").orderBy("doc_id").first()["text"]
    ids = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids + [1]
    assert (got["start"], got["ids_crc32"]) == (0, zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))


PIECES = [
    "the", "The", "THE,", "word.", "x" * 70, "don't", "'s", "it's!!", "a''", "b'", "<|endoftext|>", "<|startoftext|>x", "x<|endoftext|>,", "<|", "|>",
    "fi\ufb01", "\u03a3\u03a3", "\u1112\u1161\u11ab", "e\u0301", "\u00e9t\u00e9,###", "\u0130", "\u212a", "\u212b", "\u00df\u1e9e", "\u00a0", "\u2028", "\t", "\r", "\x00", "\x1f",
    "1", "23.", "\U0001f600", "\u4f60\u597d", "$$$", ",###", "&&&", "", " ", "\n", "=\u0338", "a=\u0338", "\u0345",
]


@settings(max_examples=400, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.one_of(st.none(), st.lists(st.one_of(st.sampled_from(PIECES), st.text(max_size=4)), max_size=14).map("".join)), min_size=1, max_size=6))
def test_random_texts_as_the_library(workers, texts):
    worker, encoder, library = workers
    column = pa.array(texts, pa.string())
    sizes, spelled, decoded = worker.texts(column)
    for i, (text, raw) in enumerate(zip(texts, encoder.texts(column))):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u2").tolist() == [*ids, huffman.END]
        assert sizes[i] == len(ids) and bytes(spelled[i]).decode() == " ".join(map(str, ids))
        assert bytes(decoded[i]).decode() == library.decode(ids, skip_special_tokens=False)


@pytest.fixture(scope="module")
def workers():
    spec = bpe.load(PATH)
    return bpe.Worker(spec), huffman.Encoder(spec, "<u2"), Tokenizer.from_file(PATH)


def test_a_slice_of_a_column_is_cut_by_its_own_rows(workers):
    column = pa.array(["a b", None, "", "c  d\ne", "f"]).slice(1, 3)
    distinct, order, bounds = stretches.cut(column)
    cut = [[distinct[k] for k in order[a:z]] for a, z in zip(bounds, bounds[1:])]
    assert cut == [[""], [""], ["c", "", "d", "e"]]
    assert [len(r) // 2 for r in workers[1].texts(column)] == [1, 1, 4]
