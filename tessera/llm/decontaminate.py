"""Benchmark decontamination: a prefix-filtered set join.

An item is cut into windows of ``window`` consecutive words (a shorter item is one window).
Every window is the set of its word shingles with their offsets.  Shingles are ordered by
rarity, counted over all documents.  For an overlap of all shingles the necessary prefix of a
window is its single rarest shingle, so a document can contain the window only where it has
that shingle; positional bounds (the window has to begin and end inside the document) cut the
candidates, and the words of the item-sized window of the document are compared exactly.

Distinct windows are numbered by a running sum of their sizes and cut into blocks by number, so
a block is bounded however many items share a window or however long its words are; each block
is broadcast and all documents are scanned against it, and the blocks' findings are merged per
document.  The usual benchmark is one block; a larger one takes more scans, never more memory.
Scans find windows by number; the ids of their items are joined to each distinct set of found
windows in Spark, hot windows salted.

Defined cases: a null or empty text has no words, no hits and no items; an item without words
is never found; items with equal windows are all named; a null item id reads as "null"; items of
one id are one item; documents of one id are rows of their own; an empty table gives an empty result, an empty benchmark no hits;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.joins import skew_join
from .common import Scratch, fixed, located, portions, read, running, slices, without

#: Words of a shingle, and the windows of a block (about 1 KB each in a task; one of over WINDOW_BYTES counts as several).
SHINGLE, BLOCK, WINDOW_BYTES = 3, 100_000, 256

# 0-9, a-z and every byte of a longer UTF-8 sequence are part of words; A-Z are lower-cased
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))

Words = tuple[bytes, ...]


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


def grams(words: list[bytes] | Words, size: int):
    return zip(*(words[i:] for i in range(size)))


def windows(items: DataFrame, window: int) -> DataFrame:
    """Distinct windows (words joined by a space) and the ids of the items that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            for item, text in zip(b.column("item").to_pylist(), b.column("text").to_pylist()):
                w = words_of(text)
                own = {b" ".join(w[i : i + window]) for i in range(max(1, len(w) - window + 1))} if w else ()
                yield pa.RecordBatch.from_pydict({"window": pa.array(list(own), pa.binary()), "item": pa.array([item] * len(own), pa.string())})

    cut = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), "text").mapInArrow(run, "window binary, item string")
    return cut.distinct()


def numbered(cut: DataFrame, scratch: Scratch) -> DataFrame:
    """(window, id): every distinct window once, ids rise by the window's size in units of WINDOW_BYTES."""
    size = 1 + F.floor(F.octet_length("window") / WINDOW_BYTES)
    return scratch.table(running(cut.select("window").distinct(), [], ["window"], size, "id", scratch), "numbered")


class Index:
    """The windows of a block by their rarest shingle."""

    def __init__(self, found: list[tuple[Words, int]], rarity: dict[Words, int], shingle: int):
        self.ids = dict(found)
        self.by: dict[int, dict[Words, list[tuple[int, Words]]]] = defaultdict(lambda: defaultdict(list))
        for w in self.ids:
            size = min(shingle, len(w))
            _, rarest, at = min((rarity.get(g, 0), g, i) for i, g in enumerate(grams(w, size)))
            self.by[size][rarest].append((at, w))
        self.by = {size: dict(own) for size, own in self.by.items()}

    def scan(self, words: list[bytes]) -> tuple[list[int], list[int]]:
        """First word and end of every found window, flat, and the windows' ids."""
        spans, ids = set(), set()
        for size, prefix in self.by.items():
            for at, g in enumerate(grams(words, size)):
                if g in prefix:
                    for offset, w in prefix[g]:
                        lo = at - offset
                        hi = lo + len(w)
                        if lo >= 0 and hi <= len(words) and tuple(words[lo:hi]) == w and (lo, hi) not in spans:
                            spans.add((lo, hi))
                            ids.add(self.ids[w])
        return [x for s in sorted(spans) for x in s], sorted(ids)


def shingle_counts(docs: DataFrame, wanted: dict[int, set[Words]]) -> dict[Words, int]:
    """How often each wanted shingle occurs in all documents."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[Words] = Counter()
        for b in portions(batches):
            for text in b.column("text").to_pylist():
                w = words_of(text)
                for size, own in shared.value.items():
                    total.update(filter(own.__contains__, grams(w, size)))
        yield pa.RecordBatch.from_pydict({
            "shingle": pa.array([b" ".join(g) for g in total], pa.binary()), "n": pa.array(total.values(), pa.int64())
        })

    rows = docs.select("text").mapInArrow(run, "shingle binary, n bigint").groupBy("shingle").agg(F.sum("n").alias("n"))
    return {tuple(bytes(r["shingle"]).split(b" ")): r["n"] for r in rows.toLocalIterator()}  # no more than were asked for


def scanned(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """The rows with their findings; a worker holds one text's words at a time."""
    for b in portions(batches):
        got = [(len(w), *index.scan(w)) for w in map(words_of, b.column("text").to_pylist())]
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("_file"), b.column("_row"), pa.array([n for n, _, _ in got], pa.int64()),
            pa.array([s for _, s, _ in got], pa.list_(pa.int32())), pa.array([i for _, _, i in got], pa.list_(pa.int64())),
        ], ["doc_id", "_file", "_row", "n_words", "spans", "windows"])


def hits(docs: DataFrame, found: DataFrame, scratch: Scratch, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, _file, _row, n_words, spans (hit words as [from, to) pairs), windows (ids of
    the ``numbered`` windows in ``found``, ascending)."""
    spark = docs.sparkSession
    rows = located(docs, scratch, "doc_id", "text")
    blocks = -(-(found.agg(F.max("id")).first()[0] or 1) // block)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, _file string, _row bigint, n_words bigint, spans array<int>, windows array<bigint>"
    scans = []
    for k in range(blocks):
        part = found.where((F.col("id") > k * block) & (F.col("id") <= (k + 1) * block))
        own = [(tuple(bytes(r["window"]).split(b" ")), r["id"]) for r in part.toLocalIterator()]  # no more than ``block``
        wanted: dict[int, set[Words]] = defaultdict(set)
        for w, _ in own:
            wanted[min(shingle, len(w))].update(grams(w, min(shingle, len(w))))
        shared = spark.sparkContext.broadcast(Index(own, shingle_counts(docs, dict(wanted)), shingle))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            return scanned(batches, shared.value)

        scans.append(rows.mapInArrow(run, schema))
    if blocks == 1:
        return scans[0]
    # a row per block and document: what is collected is bounded by the number of blocks
    return reduce(DataFrame.unionByName, scans).groupBy("doc_id", "_file", "_row", "n_words").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.flatten(F.collect_list("windows"))).alias("windows")
    )


def find(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = 10, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, _file, _row, n_words, spans (hit words as [from, to) pairs), items (sorted ids)."""
    cut = scratch.table(windows(benchmark, window), "windows")
    found = numbered(cut, scratch)
    own_set = F.when(F.size("windows") > 0, F.sha2(F.array_join("windows", ","), 256)).alias("set")
    rows = scratch.table(hits(docs, found, scratch, shingle, block).select("*", own_set), "hits")
    # documents with the same windows have the same items, so items meet each distinct set once
    sets = rows.where("set IS NOT NULL").groupBy("set").agg(F.first("windows").alias("windows"))
    each = scratch.table(sets.select("set", F.explode("windows").alias("id")), "sets")
    items = skew_join(cut, found, "window").select("id", "item")
    named = skew_join(each, items, "id").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    out = skew_join(rows, scratch.table(named, "named"), "set", "left")
    return out.select("doc_id", "_file", "_row", "n_words", "spans", F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def digests(found: DataFrame) -> DataFrame:
    """The findings as counts and a hash of the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_hit = []
            for spans in b.column("spans").to_pylist():
                reach = hit = 0
                for lo, hi in sorted(zip(spans[::2], spans[1::2])):
                    hit += max(0, hi - max(lo, reach))
                    reach = max(reach, hi)
                n_hit.append(hit)
            items = b.column("items").to_pylist()
            yield pa.RecordBatch.from_arrays([
                b.column("doc_id"), b.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()),
                pa.array([hashlib.sha256(",".join(sorted(i)).encode()).hexdigest() for i in items], pa.string()), pa.array([h > 0 for h in n_hit]),
            ], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = found.schema["doc_id"].dataType.simpleString()
    return found.select("doc_id", "n_words", "spans", "items").mapInArrow(
        run, f"doc_id {kind}, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean"
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, window: int = 10) -> DataFrame:
    """``docs`` without the documents that contain a window of an item; its columns stay as they are."""
    docs = fixed(docs, scratch)
    found = numbered(scratch.table(windows(benchmark, window), "windows"), scratch)
    return without(docs, hits(docs, found, scratch).where(F.size("spans") > 0), scratch)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), Scratch(spark, "op1")))


#: Words by SQL's regular expressions; windows joined by a space are searched in the joined words.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
     b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
     bw AS (SELECT DISTINCT item, len(g) AS k, array_to_string(g, ' ') AS g FROM (
              SELECT item, w[i : i + 9] AS g FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0))),
     ks AS (SELECT DISTINCT k FROM bw),
     dw AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS g FROM (
              SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
     m AS (SELECT doc_id, dw.k, i, item FROM dw JOIN bw USING (k, g)),
     h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
     t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
