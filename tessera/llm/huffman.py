"""Token ids as a binary file format: canonical, length-limited Huffman codes.

Writing: every text is encoded (each distinct stretch between white space once per task) and
ended with id ``END``; global counts of the ids give code lengths of at most ``MAX_BITS``
(package-merge), and the canonical codes follow from the lengths alone.  Documents are sorted by
id in ranges, and each range is cut into blocks of whole documents.

File format.  ``codes``: one row, the code length of every id as bytes.  ``blocks``: one row per
block, (part, block, data); ``data`` is little-endian:

    magic "THB1" | uint32 documents | uint32 ids | uint32 checkpoints | uint32 payload bytes
    uint32 ids of each document | uint64 bit offset of every STEP-th id of the block | payload

Codes are written most significant bit first.  ``index`` holds, per block, the doc_ids and the
number of ids before the block within its part, and ``parts`` the ids of each part, from which
every document's global start follows.

Reading: blocks are independent, and within a block decoding starts at every checkpoint at once:
one table look-up on the next MAX_BITS bits gives an id and its length for all segments together.

Defined cases: a null or empty text is the end id alone; a text longer than a block is a block of
its own; ids that repeat are ordered by the ids of their tokens and their crc, a null id comes first; an
empty table gives no block and an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import byte_symbols
from .common import Recent, Scratch, read, slices
from .stretches import SIGNS, cut, latin, recall, together

END, MAX_BITS, STEP, BLOCK_IDS = 1, 16, 256, 1 << 16
MAGIC = b"THB1"
#: Words, and other stretches of text, whose ids a Python worker remembers.
CACHE_WORDS, CACHE_OTHERS = 600_000, 100_000


# --- codes ----------------------------------------------------------------------------
def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits (package-merge); 0 for ids that don't occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids don't fit codes of {limit} bits")
    coins = used[np.lexsort((used, counts[used]))]
    weight = counts[coins].astype(np.int64)
    # each level: the coins and the pairs of the level below, by weight; -1 marks a pair
    levels, pairs = [], np.empty(0, np.int64)
    for _ in range(limit):
        w = np.concatenate([weight, pairs])
        order = np.argsort(w, kind="stable")
        levels.append(order < len(coins))
        w = w[order]
        pairs = w[: len(w) // 2 * 2].reshape(-1, 2).sum(1)
    take = 2 * len(coins) - 2
    for own in reversed(levels):
        n = int(own[:take].sum())
        lengths[coins[:n]] += 1
        take = 2 * (take - n)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id: by length, then by id."""
    codes, code, before = np.zeros(len(lengths), np.uint32), 0, 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        if n := int(lengths[i]):
            code = (code << (n - before)) if before else 0
            codes[i], before = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id, length) for every value of the next MAX_BITS bits."""
    ids, sizes = np.zeros(1 << MAX_BITS, np.uint32), np.zeros(1 << MAX_BITS, np.int64)
    codes = canonical(lengths)
    for i in np.flatnonzero(lengths):
        n = int(lengths[i])
        lo = int(codes[i]) << (MAX_BITS - n)
        ids[lo : lo + (1 << (MAX_BITS - n))] = i
        sizes[lo : lo + (1 << (MAX_BITS - n))] = n
    return ids, sizes


# --- blocks ---------------------------------------------------------------------------
def pack(docs: list[np.ndarray], lengths: np.ndarray, codes: np.ndarray) -> bytes:
    """One block from the id arrays of its documents."""
    ids = np.concatenate(docs)
    n = lengths[ids].astype(np.int64)
    at = np.concatenate([[0], np.cumsum(n)])
    size = int(at[-1] + 7) // 8
    # a code and its offset in the first byte span three bytes at most
    value = codes[ids].astype(np.int64) << (24 - n - (at[:-1] & 7))
    first = at[:-1] >> 3
    payload = np.zeros(size + 3)
    for k in range(3):
        payload += np.bincount(first + k, weights=(value >> (16 - 8 * k)) & 255, minlength=size + 3)
    check = at[:-1][::STEP].astype("<u8")
    head = MAGIC + struct.pack("<4I", len(docs), len(ids), len(check), size)
    counts = np.array([len(d) for d in docs], "<u4")
    return head + counts.tobytes() + check.tobytes() + payload[:size].astype(np.uint8).tobytes()


def unpack(block: bytes, table: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The id arrays of a block's documents."""
    if block[:4] != MAGIC:
        raise ValueError("not a block of this format")
    docs, n, checks, size = struct.unpack_from("<4I", block, 4)
    counts = np.frombuffer(block, "<u4", docs, 20)
    at = np.frombuffer(block, "<u8", checks, 20 + 4 * docs).astype(np.int64)
    raw = np.frombuffer(block, np.uint8, size, 20 + 4 * docs + 8 * checks)
    raw = np.concatenate([raw, np.zeros(4, np.uint8)]).astype(np.uint32)
    window = (raw[:-3] << 16) | (raw[1:-2] << 8) | raw[2:-1]  # the 24 bits from each byte on
    ids, sizes = table
    out = np.zeros((STEP, checks), np.uint32)
    for k in range(STEP):  # all segments side by side; what runs past the end is cut off below
        byte = np.minimum(at >> 3, len(window) - 1)
        bits = (window[byte] >> (24 - MAX_BITS - (at & 7)).astype(np.uint32)) & ((1 << MAX_BITS) - 1)
        out[k] = ids[bits]
        at = at + sizes[bits]
    flat = out.T.reshape(-1)[:n]
    return np.split(flat, np.cumsum(counts)[:-1])


# --- jobs -----------------------------------------------------------------------------
class Encoder:
    """The tokenizers library, with a cache of the ids (as bytes) of recent words and other stretches.

    No token, letter composition or special token crosses a space or line end, so a text's ids
    are those of its stretches.  A stretch of Latin letters, perhaps with signs after them, is
    normalised here and given to the library's model as one word, and the signs, which are a word
    of their own, to the library; any other stretch goes through the library's whole chain of steps.
    """

    def __init__(self, spec: str, dtype: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_str(spec)
        self.whole.no_truncation()
        self.whole.no_padding()
        self.model, self.symbols = self.whole.model, byte_symbols()
        self.code, self.end = np.dtype(dtype).char, np.array([END], dtype).tobytes()
        size = max(self.whole.get_vocab(with_added_tokens=True).values()) + 1
        self.raw = [i.tobytes() for i in np.arange(size).astype(dtype)]
        self.words, self.others = Recent(self.word, CACHE_WORDS), Recent(self.chain, CACHE_OTHERS)

    def chain(self, stretch: str) -> bytes:
        return array(self.code, self.whole.encode(stretch, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        spelled, raw = word if word.isascii() else "".join([self.symbols[b] for b in word.encode()]), self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(spelled)])

    def stretch(self, c: str) -> bytes:
        letters = c.rstrip(SIGNS)
        if word := latin(letters):
            ids = recall(self.words, word)
            return ids + recall(self.others, c[len(letters) :]) if len(letters) < len(c) else ids
        return recall(self.others, c) if c else b""

    def texts(self, texts: pa.Array) -> list[bytes]:
        """Each text's ids in little-endian bytes, END appended."""
        distinct, order, bounds = cut(texts)
        ids, at = together([*map(self.stretch, distinct)], order, bounds)
        return [bytes(ids[a:z]) + self.end for a, z in zip(at, at[1:])]


_ENCODERS: dict[str, Encoder] = {}


def encoder(key: str, spec: str, dtype: str) -> Encoder:
    """The encoder of this Python process; tasks that follow in it find its cache warm."""
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec, dtype)
    return _ENCODERS[key]


def stored(size: int) -> str:
    """The type in which ids below ``size`` are kept between the jobs."""
    return "<u2" if size <= 1 << 16 else "<u4"


def encode(docs: DataFrame, spec: str, dtype: str = "<u4") -> DataFrame:
    """doc_id and the bytes of its ids."""
    spec_of, key = docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256((dtype + spec).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(key, spec_of.value, dtype)
        for b in slices(batches, "text"):
            ids = pa.array(e.texts(b.column("text")), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), ids], ["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary")


def id_counts(encoded: DataFrame, size: int, dtype: str) -> np.ndarray:
    """Global counts per id: each task sends one row per id that it saw, at most ``size`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in slices(batches, "ids"):
            total += np.bincount(np.frombuffer(b"".join(b.column("ids").to_pylist()), dtype), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def write_files(docs: DataFrame, scratch: Scratch, spec: str, size: int, out: str | None = None) -> str:
    """Encodes ``docs`` and writes the format to folder ``out``; ``size``: number of ids."""
    spark, out = docs.sparkSession, out or scratch.place("files")
    dtype = stored(size)
    encoded = scratch.table(encode(docs, spec, dtype), "encoded")
    lengths = code_lengths(id_counts(encoded, size, dtype))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").coalesce(1).write.parquet(f"{out}/codes")
    coded = spark.sparkContext.broadcast((lengths, canonical(lengths)))  # two small arrays of ``size`` entries
    kind = docs.schema["doc_id"].dataType.simpleString()
    ranged = encoded.withColumn("tie", F.crc32("ids")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie", "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, codes = coded.value
        names = ["part", "block", "before", "n", "doc_ids", "data"]
        doc_ids, held, n, block, before = [], [], 0, 0, 0

        def row() -> pa.RecordBatch:
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(id_type), pa.binary()]
            values = [part, block, before, n, doc_ids, pack(held, lengths, codes)]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

        for b in slices(batches, "ids"):
            id_type = b.schema.field("doc_id").type
            for doc_id, ids, part in zip(*(b.column(c).to_pylist() for c in ("doc_id", "ids", "part"))):
                got = np.frombuffer(ids, dtype)
                if n and n + len(got) > BLOCK_IDS:
                    yield row()
                    doc_ids, held, n, block, before = [], [], 0, block + 1, before + n
                doc_ids.append(doc_id)
                held.append(got)
                n += len(got)
        if n:
            yield row()

    blocks = ranged.select("doc_id", "ids", F.spark_partition_id().alias("part")).mapInArrow(
        run, f"part int, block bigint, before bigint, n bigint, doc_ids array<{kind}>, data binary"
    )
    blocks.write.parquet(f"{out}/blocks")
    scratch.drop("encoded")
    return out


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it) and ids (uint32 bytes) of every document."""
    return _decoded(spark, path, "ids binary", lambda ids: pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()))


def _decoded(spark: SparkSession, path: str, column: str, of) -> DataFrame:
    blocks = spark.read.parquet(f"{path}/blocks")
    lengths = np.frombuffer(spark.read.parquet(f"{path}/codes").first()["lengths"], np.uint8)
    # one row per part: the running sum over the parts is bounded by the number of written ranges
    sums = {r["part"]: r["n"] for r in blocks.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    order = sorted(sums)
    base = dict(zip(order, np.concatenate([[0], np.cumsum([sums[p] for p in order])]).tolist()))
    shared = spark.sparkContext.broadcast((lengths, base))
    name = column.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, base = shared.value
        table = decode_table(lengths)
        for b in slices(batches, "data", 1 << 20):
            for part, before, doc_ids, data in zip(b.column("part").to_pylist(), b.column("before").to_pylist(), b.column("doc_ids"), b.column("data").to_pylist()):
                ids = unpack(data, table)
                n = np.array([len(i) for i in ids], np.int64)
                start = base[part] + before + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([doc_ids.values, pa.array(start), pa.array(n), of(ids)], ["doc_id", "start", "n_tokens", name])

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    return blocks.select("part", "before", "doc_ids", "data").mapInArrow(run, f"doc_id {kind}, start bigint, n_tokens bigint, {column}")


def op8_huffman(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import json

    import public_tokenizers

    with open(vocabulary or public_tokenizers.path("word_bpe_49k.json"), encoding="utf-8") as f:
        spec = f.read()
    spelled = json.loads(spec)
    size = 1 + max(*spelled["model"]["vocab"].values(), *(t["id"] for t in spelled["added_tokens"]), END)
    path = write_files(read(spark, sf_dir, "documents"), Scratch(spark, "op8"), spec, size)
    crc = lambda ids: pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
    return _decoded(spark, path, "ids_crc32 bigint", crc)
