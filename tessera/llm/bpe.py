"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word there is exactly one token that can end its encoding.  A suffix
automaton (trie of all token strings with failure links) gives the tokens that end at each
position, longest first; a candidate is right if it may follow the last token of the prefix
before it: the pair must be what merging its own symbols gives.  The tokens stored for every
prefix are back-pointers; following them from the end emits the ids.

A word's last symbol carries the end-of-word mark, which makes it a symbol of its own, so
words are independent and each distinct word of a task is encoded once (bounded cache).

Defined cases: a null or empty text, or one of white space only, has no ids and decodes to the
empty string; nothing is cut from long texts; repeated rows give repeated results; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .common import Recent, portions, read
from .stretches import SIGNS, cut, latin, recall, together

#: Words, and other stretches of text, that a Python worker remembers.
CACHE_WORDS, CACHE_OTHERS = 200_000, 50_000
#: Places for pairs of tokens of which it is remembered whether they are compatible; a prime.
CACHE_PAIRS = 524_287


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Bpe:
    """A merge vocabulary over words with an end-of-word mark, read from a tokenizer file.

    Every Python worker has one, so its tables are arrays of numbers, and a pair of tokens is one number.
    """

    def __init__(self, spec: dict):
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.bytes = byte_symbols()
        self.n_ids = max(self.names, default=0) + 1
        # the merges are pairs of tokens; the rank of a merge is its place in the list
        self.rank: dict[int, int] = {}  # by left token * n_ids + right token
        self.makes = array("i")  # by rank
        for r, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.rank[self.vocab[a] * self.n_ids + self.vocab[b]] = r
            self.makes.append(self.vocab[a + b])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        # the file's own normaliser and word pattern, run by the library, whose tables say what a letter is
        kept = {"normalizer": spec["normalizer"], "pre_tokenizer": spec["pre_tokenizer"]["pretokenizers"][0]}
        steps = Tokenizer.from_str(json.dumps(spec | kept | {"added_tokens": [], "model": model | {"vocab": {}, "merges": []}}))
        self.normal, self.words = steps.normalizer.normalize_str, steps.pre_tokenizer.pre_tokenize_str
        # letters are one word, and signs after them another, as far as the pattern goes; no special token looks like that
        letters = "".join(chr(c) for c in range(0x250) if chr(c).isalpha())
        self.lone = all([w for w, _ in self.words(x + s)] == [x, s] for x in ("a", letters, letters[::-1]) for s in (*SIGNS, SIGNS))
        self.lone &= all(t.rstrip(SIGNS) and not t.rstrip(SIGNS).isalpha() for t in self.special)
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in self.special) + ")") if self.special else None
        self._build()

    # --- tokens as strings of symbols -------------------------------------------------
    def symbols(self, token: str) -> list[str]:
        """One symbol per byte; the end mark belongs to the last symbol."""
        if self.end and token.endswith(self.end) and token != self.end:
            body = token[: -len(self.end)]
            return [*body[:-1], body[-1] + self.end]
        return [*token]

    def _build(self) -> None:
        """The automaton: a trie of the tokens; fail: the longest proper suffix that is in the trie."""
        made = {self.makes[r] for r in self.rank.values()}  # symbols and merge results; nothing else is ever emitted
        code = {c: n for n, c in enumerate(self.bytes)}
        code |= {c + self.end: 256 + n for c, n in code.items()} if self.end else {}
        go: dict[int, int] = {}  # by node << 9 | symbol
        at, above, depth = array("i", [-1]), array("q", [0]), array("i", [0])  # the token that a node spells, its key in go, its depth
        self.length = array("i", [0]) * self.n_ids
        for token, i in self.vocab.items():
            spelled = self.symbols(token)
            self.length[i] = len(spelled)
            if (i in made or len(spelled) == 1) and all(c in code for c in spelled):  # no text has any other symbol
                node = 0
                for c in spelled:
                    key = node << 9 | code[c]
                    if key not in go:
                        go[key] = len(at)
                        at.append(-1)
                        above.append(key)
                        depth.append(depth[node] + 1)
                    node = go[key]
                at[node] = i
        fail = array("i", [0]) * len(at)
        for node in np.argsort(np.frombuffer(depth, np.int32), kind="stable").tolist():  # by breadth
            if depth[node] > 1:
                f, c = fail[above[node] >> 9], above[node] & 511
                while f and f << 9 | c not in go:
                    f = fail[f]
                fail[node] = go.get(f << 9 | c, 0)
        # how each token is made, and its place in the order of making: symbols first, then merges by rank
        self.left, self.right, self.order = (array("i", [-1]) * self.n_ids for _ in range(3))
        for pair, r in self.rank.items():
            to = self.makes[r]
            self.left[to], self.right[to] = divmod(pair, self.n_ids)
            self.order[to] = r
        # taking tokens apart needs one way of making each, and tokens that their own symbols give
        self.one_way = len(made) == len(self.rank) and all(self.apart(*divmod(pair, self.n_ids), r) for pair, r in self.rank.items())
        self.at, self.fail = at, fail
        keys = np.sort(np.fromiter(go, np.int64, len(go)))
        self.keys, self.to = array("q", keys.tobytes()), array("i", np.array([go[k] for k in keys.tolist()], np.int32).tobytes())
        self.steps: dict[int, int] = {}  # of those taken, by node << 9 | symbol
        self.ends: list[tuple[tuple[int, int], ...] | None] = [None] * len(at)  # of the nodes that were met
        self.fits = array("q", [-1]) * CACHE_PAIRS  # pair * 2, plus 1 if compatible

    # --- pair compatibility -----------------------------------------------------------
    def merged(self, ids: list[int]) -> list[int]:
        """The merges applied to a short sequence in order of rank."""
        while len(ids) > 1:
            pairs = [a * self.n_ids + b for a, b in zip(ids, ids[1:])]
            best = min((self.rank[p] for p in pairs if p in self.rank), default=None)
            if best is None:
                break
            (a, b), to, out, i = divmod(next(p for p in pairs if self.rank.get(p) == best), self.n_ids), self.makes[best], [], 0
            while i < len(ids):
                if i + 1 < len(ids) and ids[i] == a and ids[i + 1] == b:
                    out.append(to)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def apart(self, left: int, right: int, limit: float = math.inf) -> bool:
        """Whether no merge of a rank below ``limit`` crosses the border of two tokens while they are made.

        The merges are undone at the border, the latest first.  The two tokens there lay side by side until
        the merge just undone, so their own merge, if it comes before that one, would have crossed the border; of one
        rank, the left of two merges comes first.
        """
        rank, order, n = self.rank, self.order, self.n_ids
        while True:
            crossing = rank.get(left * n + right)
            if crossing is not None and crossing < limit:
                return False
            if order[left] > order[right]:
                limit, left = order[left], self.right[left]
            elif order[right] >= 0:
                limit, right = order[right] + 1, self.left[right]
            else:
                return True

    def compatible(self, left: int, right: int) -> bool:
        """Whether encoding the two tokens' symbols together gives just these two tokens."""
        if self.one_way:
            got = self.apart(left, right)
        else:
            spelled = self.symbols(self.names[left]) + self.symbols(self.names[right])
            got = self.merged([self.vocab[s] for s in spelled]) == [left, right]
        pair = left * self.n_ids + right
        self.fits[pair % CACHE_PAIRS] = pair << 1 | got
        return got

    # --- encoding ---------------------------------------------------------------------
    def step(self, node: int, c: int) -> int:
        """The node after reading one symbol (a byte, or 256 + byte for the last one of a word)."""
        keys, found, to = self.keys, 0, node
        while True:
            at = bisect_left(keys, to << 9 | c)
            if at < len(keys) and keys[at] == to << 9 | c:
                found = self.to[at]
                break
            if not to:
                break
            to = self.fail[to]
        self.steps[node << 9 | c] = found
        return found

    def ending(self, node: int) -> tuple[tuple[int, int], ...]:
        """The tokens that end at the node, longest first, and their lengths."""
        own = self.ends[node]
        if own is None:
            i = self.at[node]
            own = self.ends[node] = (((i, self.length[i]),) if i >= 0 else ()) + (self.ending(self.fail[node]) if node else ())
        return own

    def word(self, word: str) -> tuple[int, ...]:
        raw = [*word.encode()]
        raw[-1] += 256 if self.end else 0
        last, node, steps, ends, fits, n_ids = [-1], 0, self.steps, self.ends, self.fits, self.n_ids
        for n, c in enumerate(raw, 1):  # last[n]: the token that ends the encoding of the first n symbols
            to = steps.get(node << 9 | c)
            node = self.step(node, c) if to is None else to
            for token, size in ends[node] or self.ending(node):
                if size == n:
                    last.append(token)
                    break
                left = last[n - size]
                pair = left * n_ids + token
                known = fits[pair % CACHE_PAIRS]
                if known & 1 if known >> 1 == pair else self.compatible(left, token):
                    last.append(token)
                    break
        out, n = [], len(raw)
        while n:
            out.append(last[n])
            n -= self.length[last[n]]
        return tuple(out[::-1])

    def chunk(self, chunk: str) -> list[int]:
        """The ids of a stretch of text: special tokens first, then word by word."""
        out: list[int] = []
        for part in self.cut.split(chunk) if self.cut else [chunk]:
            if part in self.special:
                out.append(self.special[part])
            else:
                for w, _ in self.words(self.normal(part)):
                    out += self.word(w)
        return out

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are joined by a space as they are written."""
        names = self.names
        return " ".join([names[i] for i in ids])


def load(path: str) -> str:
    """The tokenizer file's text; a few MB, broadcast to the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Worker:
    """What a task keeps while it encodes: of recent words and other stretches their ids and how they are written."""

    def __init__(self, spec: str):
        self.bpe = Bpe(json.loads(spec))
        self.words = Recent(lambda word: self.written(self.bpe.word(word)), CACHE_WORDS)
        self.others = Recent(lambda stretch: self.written(self.bpe.chunk(stretch)), CACHE_OTHERS)

    def written(self, ids: list[int]) -> bytes:
        """Ids as text and, after a line end, the decoded text, a space after each id; one object a word, as very many are remembered."""
        return f"{' '.join(map(str, ids))} \n{self.bpe.decode(ids)} ".encode() if ids else b""

    def part(self, stretch: str) -> tuple[bytes, bytes]:
        """Ids and decoded text; a word of Latin letters and the signs after it are looked up apart, any other stretch as a whole."""
        letters = stretch.rstrip(SIGNS)
        if self.bpe.lone and (word := latin(letters)):
            ids, _, decoded = recall(self.words, word).partition(b"\n")
            if len(letters) < len(stretch):
                more_ids, _, more = recall(self.others, stretch[len(letters) :]).partition(b"\n")
                return ids + more_ids, decoded + more
            return ids, decoded
        ids, _, decoded = recall(self.others, stretch).partition(b"\n")
        return ids, decoded

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, list[memoryview], list[memoryview]]:
        """Of each text: number of ids, ids joined by a space, decoded text."""
        distinct, order, bounds = cut(texts)
        parts = [*map(self.part, distinct)]
        sizes = np.concatenate([[0], np.cumsum(np.array([p[0].count(b" ") for p in parts], np.int64)[order])])[bounds]

        def rows(k: int) -> list[memoryview]:
            text, at = together([p[k] for p in parts], order, bounds)
            return [text[a : max(a, z - 1)] for a, z in zip(at, at[1:])]  # without the last space

        return np.diff(sizes), rows(0), rows(1)

    def digests(self, texts: pa.Array) -> list[pa.Array]:
        """Of each text: number of ids, SHA-256 of the ids and of the decoded text."""
        n, spelled, decoded = self.texts(texts)
        return [pa.array(n, pa.int64()), *(pa.array([hashlib.sha256(x).hexdigest() for x in own], pa.string()) for own in (spelled, decoded))]


_WORKERS: dict[str, Worker] = {}


def worker(key: str, spec: str) -> Worker:
    """The worker of this Python process: tasks that follow in it find its tables built and its cache warm."""
    if key not in _WORKERS:
        _WORKERS.clear()
        _WORKERS[key] = Worker(spec)
    return _WORKERS[key]


def encode_decode(docs: DataFrame, spec: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids array<int>`` and ``decoded`` of every row's text."""
    spec_of, key = docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = worker(key, spec_of.value)
        for b in portions(batches):
            _, spelled, decoded = w.texts(b.column("text"))
            ids = pa.array([np.array(bytes(s).split(), np.int32) for s in spelled], pa.list_(pa.int32()))
            decoded = pa.array([str(d, "utf-8") for d in decoded], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), ids, decoded], [*keep, "ids", "decoded"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return docs.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, f"{schema}, ids array<int>, decoded string")


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """Of every row: number of ids, SHA-256 of the ids and of the decoded text (neither leaves the task)."""
    spec_of, key = docs.sparkSession.sparkContext.broadcast(spec), hashlib.sha256(spec.encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = worker(key, spec_of.value)
        for b in portions(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *w.digests(b.column("text"))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), load(vocabulary or public_tokenizers.path("word_bpe_49k.json")))
