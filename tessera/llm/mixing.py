"""LM scoring by logistic context mixing.

A text is a sequence of tokens: its words and one end.  The ``TREE`` most frequent words, the end
and an escape for all other words are leaves of a Huffman tree, and every token is coded as the
bits of its path.  Several predictors look up counts of that bit in tables addressed by hashed
contexts (the tree node alone, with the word before, with the two words before, with the word
before last).  Their stretched probabilities are mixed by weights chosen by a gate (how much the
contexts have been seen); an adaptive probability map refines the mixture.  A word outside the
tree costs its escape and its smoothed unigram share among such words, so the probabilities
of all token sequences sum to one.

Folds by crc32 of the id modulo 10: 0 is held out; 1 teaches weights and map online, on tables
that haven't seen it; 2 to 9 fill the tables; all of 1 to 9 are counted as unigrams.  The rows that
teach are dealt into classes of about ``CLASS_ROWS`` by a hash of the id; each class teaches a mixer
of its own in the order of a hash, and the mixers are averaged by their bits.  Classes depend on the
rows alone, so a text's score is the same however the table is partitioned.

Sizes.  Unigram counts are a distributed table of all words and grow with the corpus; tasks get
up to ``DICTIONARY`` of the most frequent ones, and rarer words meet their counts in a join.  The
context tables have a fixed number of slots, as hashed contexts do; tasks send their counts
compressed, and they are summed in a tree.  Every text is counted and scored whole, ``CHUNK_TOKENS``
of its tokens at a time, the two words before carried over; what a long text needs beyond that is its words
and three numbers a token.

Defined cases: a null or empty text is the end alone; without training rows every token has the
same smoothed count; ids that repeat are scored alike and a null id counts as the empty text for
the fold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, fold, read, slices

TREE, DICTIONARY = 1 << 12, 1 << 18
#: log2 of the slots of a context table, tables, gate levels per table, and cells of the probability map.
SLOTS, TABLES, LEVELS, CELLS = 20, 4, 8, 33
CHUNK_TOKENS, BATCH_BITS, CHUNKS, CLASS_ROWS = 1 << 16, 1 << 13, 16, 2000
ALPHA = 0.1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words


# --- the tree -------------------------------------------------------------------------
@dataclass
class Tree:
    """Symbols 0.. are the words, then the escape, then the end; paths of all symbols, one after another."""

    words: dict[bytes, int]
    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    bit: np.ndarray

    @property
    def escape(self) -> int:
        return len(self.words)

    @property
    def end(self) -> int:
        return len(self.words) + 1


def huffman_tree(words: list[bytes], counts: list[int], escape: int, end: int) -> Tree:
    weights = [max(1, c) for c in [*counts, escape, end]]
    heap = [(w, i, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent: dict[int, tuple[int, int]] = {}
    made = len(weights)
    while len(heap) > 1:
        (w0, _, a), (w1, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        parent[a], parent[b] = (made, 0), (made, 1)
        heapq.heappush(heap, (w0 + w1, made, made))
        made += 1
    start, length, node, bit = [], [], [], []
    for i in range(len(weights)):
        path, at = [], i
        while at in parent:
            at, own = parent[at]
            path.append((at - len(weights), own))
        start.append(len(node))
        length.append(len(path))
        for n, own in reversed(path):
            node.append(n)
            bit.append(own)
    as_int = lambda x: np.array(x, np.int64)
    return Tree({w: i for i, w in enumerate(words)}, as_int(start), as_int(length), as_int(node), np.array(bit, np.int8))


class Coder:
    """Turns words into symbols, contexts and bits."""

    def __init__(self, tree: Tree):
        self.tree = tree

    def symbols(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol and context class of each word, then of the end; a word outside the tree is known by its last letters."""
        t = self.tree
        get, escape = t.words.get, t.escape
        sym = [get(w, escape) for w in words]
        base = t.end + 1
        cls = [s if s != escape else base + ((w[-1] << 8 | w[-2]) if len(w) > 1 else w[-1]) for s, w in zip(sym, words)]
        return np.array([*sym, t.end], np.int64), np.array([*cls, t.end], np.int64)

    def tokens(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every token of the texts, one after another: its symbol, the class of the word before and of the one before that."""
        end = self.tree.end
        sym = np.concatenate([s for s, _ in texts])
        one = np.concatenate([np.concatenate([[end], c[:-1]]) for _, c in texts])
        two = np.concatenate([np.concatenate([[end, end], c[:-2]])[: len(c)] for _, c in texts])
        return sym, one, two

    def runs(self, texts: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[list[np.ndarray], np.ndarray, np.ndarray]]:
        """:meth:`bits` of CHUNK_TOKENS tokens at a time."""
        own = self.tokens(texts)
        for at in range(0, len(own[0]), CHUNK_TOKENS):
            yield self.bits(*(x[at : at + CHUNK_TOKENS] for x in own))

    def bits(self, sym: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """Slots of every bit in each table, the bits, and the number of bits of every token."""
        t = self.tree
        n = t.length[sym]
        ends = np.cumsum(n)
        path = np.arange(int(ends[-1])) + np.repeat(t.start[sym] - (ends - n), n)
        node, bit = t.node[path], t.bit[path]
        key = node.astype(np.uint64) + np.uint64(1)
        a, b = np.repeat(one, n).astype(np.uint64), np.repeat(two, n).astype(np.uint64)
        mix, top = np.uint64(0x9E3779B97F4A7C15), np.uint64(64 - SLOTS)
        h1 = (a * np.uint64(0xC2B2AE3D27D4EB4F) ^ key) * mix
        h2 = ((h1 ^ (h1 >> np.uint64(29))) + b * np.uint64(0x165667B19E3779F9)) * mix
        h3 = ((b + np.uint64(0x7F4A7C15)) * np.uint64(0x85EBCA77C2B2AE63) ^ key) * mix
        return [node & ((1 << SLOTS) - 1), *((h >> top).astype(np.int64) for h in (h1, h2, h3))], bit, n


# --- predictors and mixer -------------------------------------------------------------
@dataclass
class Tables:
    """Per table and slot: stretched probability of a one, and how much was seen (a level)."""

    stretch: np.ndarray
    level: np.ndarray


def tables_of(counts: np.ndarray) -> Tables:
    """``counts``: TABLES x slots x 2."""
    n = counts.sum(-1)
    p = (counts[..., 1] + 0.4) / (n + 0.8)
    level = np.minimum(LEVELS - 1, np.ceil(np.log2(n + 1.0) * 0.7)).astype(np.uint8)
    return Tables(np.log(p / (1 - p)).astype(np.float32), level)


@dataclass
class Mixer:
    """Weights per gate, and the probability map: per level and cell of the mixture, ones and trials."""

    weights: np.ndarray
    ones: np.ndarray
    trials: np.ndarray

    @staticmethod
    def fresh() -> Mixer:
        cells = 1 / (1 + np.exp(-np.linspace(-8, 8, CELLS)))
        w = np.zeros((LEVELS * LEVELS, TABLES + 1))
        w[:, :3] = 0.4
        return Mixer(w, np.tile(cells * 64, (LEVELS, 1)), np.full((LEVELS, CELLS), 64.0))

    def inputs(self, tables: Tables, slots: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x = np.ones((len(slots[0]), TABLES + 1), np.float32)
        for k, s in enumerate(slots):
            x[:, k] = tables.stretch[k][s]
        one = tables.level[1][slots[1]].astype(np.int64)
        return x, one * LEVELS + tables.level[2][slots[2]], one

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.clip(np.einsum("ij,ij->i", x, self.weights.astype(np.float32)[gate]), -7.99, 7.99)

    def refined(self, s: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The probability of a one: half the mixture, half what the map has seen near it."""
        at = (s + 8) * ((CELLS - 1) / 16)
        lo = at.astype(np.int64)
        part = at - lo
        table = (self.ones / self.trials).astype(np.float32).ravel()
        cell = level * CELLS + lo
        seen = table[cell] * (1 - part) + table[cell + 1] * part
        return np.clip(0.5 / (1 + np.exp(-s)) + 0.5 * seen, 1e-6, 1 - 1e-6)

    def learn(self, tables: Tables, slots: list[np.ndarray], bit: np.ndarray, pace: np.ndarray) -> None:
        """Online: every batch of bits is predicted with the weights of those before, then corrects them."""
        for at in range(0, len(bit), BATCH_BITS):
            own = [s[at : at + BATCH_BITS] for s in slots]
            y = bit[at : at + BATCH_BITS].astype(np.float64)
            x, gate, level = self.inputs(tables, own)
            s = self.mixed(x, gate)
            error = y - 1 / (1 + np.exp(-s))
            n = np.bincount(gate, minlength=LEVELS * LEVELS)
            slope = np.stack([np.bincount(gate, error * x[:, k], LEVELS * LEVELS) for k in range(TABLES + 1)], 1) / np.maximum(n, 1)[:, None]
            pace += slope**2
            self.weights += 0.05 * slope / np.sqrt(pace + 1e-9)
            cell = level * CELLS + np.rint((s + 8) * ((CELLS - 1) / 16)).astype(np.int64)
            self.ones += np.bincount(cell, y, LEVELS * CELLS).reshape(LEVELS, CELLS)
            self.trials += np.bincount(cell, minlength=LEVELS * CELLS).reshape(LEVELS, CELLS)

    def log10(self, tables: Tables, slots: list[np.ndarray], bit: np.ndarray) -> np.ndarray:
        x, gate, level = self.inputs(tables, slots)
        p = self.refined(self.mixed(x, gate), level)
        return np.log10(np.where(bit == 1, p, 1 - p))


def chunks(batches: Iterator[pa.RecordBatch], coder: Coder, *cols: str) -> Iterator[tuple[list[tuple], list[list[bytes]], list]]:
    """Rows' ``cols``, words and symbols, about CHUNK_TOKENS tokens at a time."""
    rows, words, texts, n = [], [], [], 0
    for b in slices(batches, "text"):
        own = list(zip(*(b.column(c).to_pylist() for c in cols))) if cols else [()] * b.num_rows
        for row, text in zip(own, b.column("text").to_pylist()):
            w = words_of(text)
            rows.append(row)
            words.append(w)
            texts.append(coder.symbols(w))
            n += len(w) + 1
            if n >= CHUNK_TOKENS:
                yield rows, words, texts
                rows, words, texts, n = [], [], [], 0
    if n:
        yield rows, words, texts


# --- jobs -----------------------------------------------------------------------------
def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all rows; a task adds up its own words first, in bounded memory."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for b in slices(batches, "text"):
            for text in b.column("text").to_pylist():
                total.update(words_of(text))
            if len(total) > 500_000:
                yield rows()
                total.clear()
        yield rows()

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def context_tables(docs: DataFrame, tree: Tree) -> Tables:
    """The tables filled with the bits of all rows; the driver gets five bytes per slot."""
    sc = docs.sparkSession.sparkContext
    shared, size = sc.broadcast(tree), TABLES << SLOTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, coder = np.zeros(size, np.int64), Coder(shared.value)
        for _, _, texts in chunks(batches, coder):
            for slots, bit, _ in coder.runs(texts):
                for k, s in enumerate(slots):
                    total[k << SLOTS + 1 : k + 1 << SLOTS + 1] += np.bincount(s * 2 + bit, minlength=2 << SLOTS)
        pack = zstandard.ZstdCompressor(1).compress
        parts = [pack(p.tobytes()) for p in np.split(total, CHUNKS)]
        yield pa.RecordBatch.from_arrays([pa.array(range(CHUNKS), pa.int32()), pa.array(parts, pa.binary())], ["chunk", "counts"])

    def summed(group: pd.DataFrame) -> np.ndarray:
        unpack = zstandard.ZstdDecompressor().decompress
        return sum(np.frombuffer(unpack(c), np.int64) for c in group["counts"])

    def added(key, group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"chunk": [key[0]], "counts": [zstandard.ZstdCompressor(1).compress(summed(group).tobytes())]})

    def filled(key, group: pd.DataFrame) -> pd.DataFrame:
        t = tables_of(summed(group).reshape(-1, 2))
        return pd.DataFrame({"chunk": [key[0]], "stretch": [t.stretch.tobytes()], "level": [t.level.tobytes()]})

    # tasks send a table each, so there are only a few per core; they are added up in two steps
    tasks = min(docs.rdd.getNumPartitions(), 4 * sc.defaultParallelism)
    sent = docs.select("text").coalesce(max(1, tasks)).mapInArrow(run, "chunk int, counts binary")
    some = sent.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(math.isqrt(tasks) + 1)))
    some = some.groupBy("chunk", "part").applyInPandas(added, "chunk int, counts binary")
    whole = some.groupBy("chunk").applyInPandas(filled, "chunk int, stretch binary, level binary").orderBy("chunk").collect()  # CHUNKS rows
    if not whole:
        return tables_of(np.zeros((TABLES, 1 << SLOTS, 2)))
    stretch = np.concatenate([np.frombuffer(r["stretch"], np.float32) for r in whole])
    level = np.concatenate([np.frombuffer(r["level"], np.uint8) for r in whole])
    return Tables(stretch.reshape(TABLES, -1), level.reshape(TABLES, -1))


def frequent(vocabulary: DataFrame, most: int) -> DataFrame:
    """The most frequent words, ``most`` at most: all above the least count that leaves no more.

    Counts are compared in steps of a 64th of a power of two, so the driver sees few of them.
    """
    step = F.floor(F.log2("n") * 64).cast("int")
    sizes = vocabulary.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    least, total = None, 0
    for r in sizes:
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    return vocabulary.where(step >= least if least is not None else F.lit(False))


def taught(docs: DataFrame, shared) -> Mixer:
    """A mixer taught online by every class of rows, averaged by the bits that each class has seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tables = shared.value
        coder, fresh = Coder(tree), Mixer.fresh()
        total, seen = np.zeros(fresh.weights.size + 2 * fresh.ones.size), 0
        for _, own in groupby(by_class(batches), key=lambda b: b.column("class")[0].as_py()):  # a class lies together in one task
            mixer, pace, n = Mixer.fresh(), np.zeros((LEVELS * LEVELS, TABLES + 1)), 0
            for _, _, texts in chunks(own, coder):
                for slots, bit, _ in coder.runs(texts):
                    mixer.learn(tables, slots, bit, pace)
                    n += len(bit)
            total += np.concatenate([mixer.weights.ravel() * n, (mixer.ones - fresh.ones).ravel(), (mixer.trials - fresh.trials).ravel()])
            seen += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total), pa.array(np.full(len(total), seen))], ["i", "v", "n"])

    classes = max(1, docs.count() // CLASS_ROWS)
    dealt = docs.select("text", F.xxhash64(F.col("doc_id").cast("string"), "text").alias("at"))
    dealt = dealt.withColumn("class", F.pmod(F.shiftright("at", 20), F.lit(classes))).repartition("class").sortWithinPartitions("class", "at", "text")
    rows = dealt.select("class", "text").mapInArrow(run, "i int, v double, n bigint").groupBy("i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    got = rows.orderBy("i").toPandas()  # one row per weight and map cell
    mixer = Mixer.fresh()
    if len(got) and got["n"].iloc[0]:
        values, w, m = got["v"].to_numpy(), mixer.weights.size, mixer.ones.size
        mixer.weights = (values[:w] / got["n"].iloc[0]).reshape(mixer.weights.shape)
        mixer.ones += values[w : w + m].reshape(mixer.ones.shape)
        mixer.trials += values[w + m :].reshape(mixer.trials.shape)
    return mixer


def by_class(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, cut where the class changes."""
    for b in batches:
        kind = b.column("class").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(kind)) + 1).tolist(), len(kind)]
        for lo, hi in zip(cuts, cuts[1:]):
            if hi > lo:
                yield b.slice(lo, hi - lo)


def score(docs: DataFrame, scratch: Scratch, tree_words: int = TREE, dictionary: int = DICTIONARY) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits (the
    model's, for the whole text), n_bytes (of the text in UTF-8) and bits_per_byte (null for a text without bytes)."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text").withColumn("fold", fold(F.col("doc_id"), 10))
    vocabulary = scratch.table(word_counts(rows.where("fold != 0")), "vocabulary")
    sums = vocabulary.agg(F.sum("n"), F.count(F.lit(1))).first()
    ends = rows.where("fold != 0").count()
    tokens, distinct = (sums[0] or 0) + ends, sums[1] + (ends > 0)
    top = frequent(vocabulary, dictionary).toPandas().sort_values(["n", "word"], ascending=[False, True])  # ``dictionary`` rows at most
    words, counts = [bytes(w) for w in top["word"]], top["n"].to_list()
    del top
    head = sum(counts[:tree_words])
    tree = huffman_tree(words[:tree_words], counts[:tree_words], tokens - ends - head, ends)
    outside = math.log10(tokens - ends - head + ALPHA * (sums[1] - len(tree.words) + 1))
    log_c = [math.log10(c + ALPHA) for c in [*counts[:tree_words], 0, ends]]
    rarer = {w: math.log10(c + ALPHA) for w, c in zip(words[tree_words:], counts[tree_words:])}

    tables = context_tables(rows.where("fold > 1"), tree)
    mixer = taught(rows.where("fold = 1"), spark.sparkContext.broadcast((tree, tables)))
    shared = spark.sparkContext.broadcast((tree, tables, mixer, np.array(log_c), rarer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, tables, mixer, log_c, rarer = shared.value
        coder = Coder(tree)
        names = ["key", "doc_id", "fold", "n_bytes", "n_tokens", "n_known", "n_outside", "inside", "dictionary", "mixed", "rare"]
        kinds = [pa.int64(), id_type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.map_(pa.binary(), pa.int32())]
        for own, words, texts in chunks(batches, coder, "key", "doc_id", "fold", "n_bytes"):
            logs = [np.add.reduceat(mixer.log10(tables, slots, bit), np.cumsum(n) - n, dtype=np.float64) for slots, bit, n in coder.runs(texts)]
            first = np.cumsum([0, *(len(sym) for sym, _ in texts[:-1])])
            mixed = np.add.reduceat(np.concatenate(logs), first)
            out = []
            for row, w, (sym, _), m in zip(own, words, texts, mixed.tolist()):
                left = [x for x, s in zip(w, sym.tolist()) if s == tree.escape]
                rare = Counter(x for x in left if x not in rarer)
                n_rare = sum(rare.values())
                inside = float(log_c[sym].sum() - len(left) * log_c[tree.escape])
                known = len(sym) - n_rare - (not has_ends)
                out.append((*row, len(sym), known, len(left), inside, sum([rarer[x] for x in left if x in rarer]), m, list(rare.items())))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    id_type, has_ends = to_arrow_type(docs.schema["doc_id"].dataType), ends > 0
    kind, n_bytes = docs.schema["doc_id"].dataType.simpleString(), F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint")
    scored = rows.withColumn("key", F.monotonically_increasing_id()).select("key", "doc_id", "fold", "text", n_bytes.alias("n_bytes")).mapInArrow(
        run,
        f"key bigint, doc_id {kind}, fold bigint, n_bytes bigint, n_tokens bigint, n_known bigint, n_outside bigint, "
        "inside double, dictionary double, mixed double, rare map<binary,int>",
    )
    scored = scratch.table(scored, "scored")
    rare = scored.select("key", F.explode("rare").alias("word", "k")).join(vocabulary, "word", "left")
    rare = rare.groupBy("key").agg(
        F.sum(F.col("k") * F.log10(F.coalesce("n", F.lit(0)) + ALPHA)).alias("rare_log"), F.sum(F.when(F.col("n") > 0, F.col("k"))).alias("rare_known")
    )
    all_rows = scored.drop("rare").join(rare, "key", "left").fillna(0, ["rare_log", "rare_known"])
    log_n = math.log10(tokens + ALPHA * (distinct + 1))
    base = F.col("inside") + F.col("dictionary") + F.col("rare_log") - F.col("n_tokens") * log_n
    model = F.col("mixed") + F.col("dictionary") + F.col("rare_log") - F.col("n_outside") * outside
    bits = -model * F.lit(math.log2(10))
    return all_rows.select(
        "doc_id", (F.col("fold") == 0).alias("held_out"), "n_tokens", (F.col("n_known") + F.col("rare_known")).alias("n_known"),
        F.lit(tokens).cast("bigint").alias("train_tokens"), base.alias("base_score"), model.alias("score"),
        bits.alias("bits"), "n_bytes", F.when(F.col("n_bytes") > 0, bits / F.col("n_bytes")).alias("bits_per_byte"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"), Scratch(spark, "op7"))
