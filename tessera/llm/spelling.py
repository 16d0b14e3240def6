"""Spelling variants: the vocabulary's minimised acceptor composed with a one-edit transducer and itself.

The composition V ∘ E ∘ V accepts the pairs of vocabulary words that one edit (a code point inserted,
deleted or replaced) turns into each other.  Its states are (state of V, edit made or not, state
of V).  It is enumerated in parts, one for each initial state: the state that the composition is in after a
context that both words share.  As one edit leaves a half of a word unchanged, every pair of
words of l and l (or l + 1) code points is in the part of their common first half or in that of their
common last half; the second leaves out pairs that have the first in common, so each pair is accepted once.
A part of more than ``part`` words is cut again, by halves of what its context leaves open, until one open code
point is left, where the alphabet bounds it.  No part is quadratic: in each, the open middles become
a minimised acyclic automaton, and the composition walks the product of its states only as far as
both sides go on.

Words are counted in Spark (partial counts in the tasks that read); parts are dealt out by context and read
sorted, one at a time.  Forms are followed to their roots by pointer doubling.

Defined cases: null and empty texts have no words; a null id counts as empty text in the checksum;
repeated rows count each time; ties between forms go to the smallest word; an empty table gives an
empty result; other columns are ignored, whatever their names.  Texts and words may be of any length.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, met, read, small

#: Letters of a word, as the inside of a character class.
LETTERS = "A-Za-zÀ-ÿ"
#: One occurrence in so many is changed before counting.
EVERY = 199
#: Words of a part from which on it is cut again.
PART = 2000

PAIR = pa.schema([("a", pa.string()), ("na", pa.int64()), ("b", pa.string()), ("nb", pa.int64())])


def occurrences(docs: DataFrame, shortest: int = 6, every: int = EVERY) -> DataFrame:
    """``word``, one row per occurrence of at least ``shortest`` code points, from ``doc_id`` and ``text``."""
    # an outer explode: a plain one has Spark search every text twice
    run = F.explode_outer(F.regexp_extract_all("text", F.lit(f"([{LETTERS}]{{{shortest},}})"), F.lit(0))).alias("run")
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), run).where(F.col("run").isNotNull())
    runs = runs.select("id", ascii_lower(F.col("run")).alias("run"))
    h, size = F.crc32(F.concat("id", F.lit(":"), "run")), F.char_length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, size))
    return runs.select(F.when(h % every == 0, cut).otherwise(F.col("run")).alias("word")).where(F.char_length("word") >= shortest)


def vocabulary(words: DataFrame, least: int = 5) -> DataFrame:
    """word, n: the words that occur at least ``least`` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


# --- the automata ------------------------------------------------------------------------
class Acceptor:
    """Minimised acyclic acceptor of sorted distinct strings; state 0 accepts only the empty string, if any does."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self._known: dict[tuple, int] = {}
        path: list[tuple[dict[str, int], bool]] = [({}, False)]
        last = ""
        for w in words:
            same = 0
            while same < len(last) and same < len(w) and last[same] == w[same]:
                same += 1
            self._freeze(path, last, same)
            path += [({}, False) for _ in range(len(w) - same)]
            path[-1] = (path[-1][0], True)
            last = w
        self._freeze(path, last, 0)
        self.start = self._state(*path[0])
        self._both: dict[tuple[int, int], list[str]] = {}
        self._edits: dict[int, list[tuple[str, str]]] = {}

    def _state(self, arcs: dict[str, int], final: bool) -> int:
        key = (final, *arcs.items())
        found = self._known.setdefault(key, len(self.arcs))
        if found == len(self.arcs):
            self.arcs.append(arcs)
            self.final.append(final)
        return found

    def _freeze(self, path: list, last: str, keep: int) -> None:
        while len(path) - 1 > keep:
            done = self._state(*path.pop())
            path[-1][0][last[len(path) - 1]] = done

    def both(self, p: int, q: int) -> list[str]:
        """The strings that are accepted from either state: the composition after its edit."""
        key = (p, q) if p <= q else (q, p)
        if key not in self._both:
            out, todo = [], [(*key, "")]
            while todo:
                x, y, s = todo.pop()
                if self.final[x] and self.final[y]:
                    out.append(s)
                ax, ay = self.arcs[x], self.arcs[y]
                if len(ay) < len(ax):
                    ax, ay = ay, ax
                todo += [(t, ay[c], s + c) for c, t in ax.items() if c in ay]
            self._both[key] = out
        return self._both[key]

    def edits(self, q: int) -> list[tuple[str, str]]:
        """Pairs of strings from ``q`` whose first code points the edit makes differ; of unequal lengths, the longer one first."""
        if q not in self._edits:
            out, arcs = [], list(self.arcs[q].items())
            for i, (c, x) in enumerate(arcs):
                # inserting c before another c is the same edit one place on
                out += [(c + s, s) for s in self.both(x, q) if s[:1] != c]
                out += [(c + s, d + s) for d, y in arcs[i + 1:] for s in self.both(x, y)]
            self._edits[q] = out
        return self._edits[q]

    def pairs(self) -> Iterator[tuple[str, str]]:
        """The pairs that acceptor ∘ one edit ∘ acceptor accepts, each once."""
        todo = [(self.start, "")]
        while todo:  # before its edit the composition is in the same state on both sides
            q, s = todo.pop()
            yield from ((s + a, s + b) for a, b in self.edits(q))
            todo += [(t, s + c) for c, t in self.arcs[q].items()]


def steps(size: int, path: str) -> tuple[int, int, list[tuple[int, int]]]:
    """(i, j, apart) of the part at ``path`` for words of ``size`` (or one more) code points: i first and j last ones are
    common, and of each (at, n) in ``apart`` the n code points from ``at`` on are not all equal."""
    i, j, apart = 0, 0, []
    for way in path:
        n = -(-(size - i - j) // 2)
        if way == "L":
            i += n
        else:
            apart.append((i, n))
            j = size - i - n
    return i, j, apart


def part_pairs(size: int, path: str, words: dict[str, int]) -> Iterator[tuple[str, str]]:
    """The near pairs that the part at ``path`` accepts of its ``words``."""
    i, j, apart = steps(size, path)
    some = next(iter(words))
    left, right = some[:i], some[len(some) - j:]
    for a, b in Acceptor(sorted(w[i:len(w) - j] for w in words)).pairs():
        a, b = left + a + right, left + b + right
        if len(b) == size and all(a[at:at + n] != b[at:at + n] for at, n in apart):
            yield a, b


def near_pairs(words: DataFrame, scratch: Scratch, shortest: int = 6, part: int = PART) -> DataFrame:
    """a, na, b, nb: every two of the ``words`` (word, n) that one edit tells apart, once."""
    size = F.char_length("word")
    either = F.explode(F.array(size, size - 1)).alias("size")  # pairs with longer words, pairs with shorter ones
    open_ = words.select("word", "n", either, F.lit("").alias("path"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    todo, found, level = open_.where(F.col("size") >= max(1, shortest)), [], 0
    while todo is not None:
        entries = scratch.table(_halved(todo), f"entries{level}")
        left_open = F.max(F.col("size") - F.col("i") - F.col("j")).alias("left_open")  # the same in all of a part
        counts = entries.groupBy("key").agg(F.count(F.lit(1)).alias("members"), left_open)
        large = scratch.table(counts.where((F.col("members") > part) & (F.col("left_open") > 1)).select("key"), f"large{level}")
        calm = entries.join(small(large, 64), "key", "left_anti")
        found.append(scratch.table(_accepted(calm), f"pairs{level}"))
        todo = None if large.isEmpty() else entries.join(small(large, 64), "key", "left_semi").drop("key")
        level += 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _halved(parts: DataFrame) -> DataFrame:
    """The entries of both halves of each part: word, n, size, path, i, j and ``key``, the context."""
    n = F.ceil((F.col("size") - F.col("i") - F.col("j")) / 2).cast("int")
    ways = F.array(
        F.struct(F.concat("path", F.lit("L")).alias("path"), (F.col("i") + n).alias("i"), F.col("j").alias("j")),
        F.struct(F.concat("path", F.lit("R")).alias("path"), F.col("i").alias("i"), (F.col("size") - F.col("i") - n).alias("j")),
    )
    cut = parts.select("word", "n", "size", F.explode(ways).alias("w")).select("word", "n", "size", "w.*")
    left = F.col("word").substr(F.lit(1), F.col("i"))
    right = F.col("word").substr(F.char_length("word") - F.col("j") + 1, F.col("j"))
    return cut.withColumn("key", F.concat_ws(" ", F.col("size").cast("string"), "path", left, right))


def _accepted(entries: DataFrame) -> DataFrame:
    """Runs the composition of every part; parts are read one at a time from rows sorted by context."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("key", "word", "n"))))
        out: list[tuple] = []
        for key, part in groupby(rows, lambda r: r[0]):
            words = {w: n for _, w, n in part}
            if len(words) > 1:
                size, path = key.split(" ")[:2]
                out += [(a, words[a], b, words[b]) for a, b in part_pairs(int(size), path, words)]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR)], schema=PAIR)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), PAIR)], schema=PAIR)

    dealt = entries.select("key", "word", "n").repartition("key").sortWithinPartitions("key")
    return dealt.mapInArrow(run, "a string, na bigint, b string, nb bigint")


def roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """word, root: ``forms`` (word, form) followed to the last, which has no form.  Forms never lead back."""
    now, step = scratch.table(forms.select("word", F.col("form").alias("root")), "roots0"), 0
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = met(now, on, "root", "left", 128)
        step += 1
        then = scratch.table(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"roots{step}")
        scratch.drop(f"roots{step - 1}")
        if then.where("moved").isEmpty():
            return then.drop("moved")
        now = then.drop("moved")


def spelling(words: DataFrame, scratch: Scratch, factor: int = 5, shortest: int = 6, part: int = PART) -> DataFrame:
    """word, n, n_near, form, form_n, root of the ``words`` (word, n), all of at least ``shortest`` code points.

    A word's form is its most frequent near word, if that occurs at least ``factor`` times as often.
    """
    pairs = near_pairs(words, scratch, shortest, part)
    ways = F.array(F.struct("a", "na", "b", "nb"), F.struct(F.col("b").alias("a"), F.col("nb").alias("na"), F.col("a").alias("b"), F.col("na").alias("nb")))
    sides = pairs.select(F.explode(ways).alias("p")).select("p.*")
    best = F.min(F.struct((-F.col("nb")).alias("neg"), F.col("b").alias("form"))).alias("best")  # strings sort by code point
    near = scratch.table(sides.groupBy(F.col("a").alias("word")).agg(F.count(F.lit(1)).alias("n_near"), best), "near")
    joined = words.join(near, "word", "left")
    has = -F.col("best.neg") >= factor * F.col("n")
    rows = joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, F.col("best.form")).alias("form"), F.when(has, -F.col("best.neg")).alias("form_n"),
    )
    rows = scratch.table(rows, "forms")
    last = roots(rows.where("form IS NOT NULL"), scratch)
    return rows.join(last, "word", "left").withColumn("root", F.coalesce("root", "word"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op11")
    words = scratch.table(vocabulary(occurrences(read(spark, sf_dir, "documents"))), "vocabulary")
    return spelling(words, scratch).select("word", "form", "root", "n", "n_near", "form_n")


# the checksum runs over the bits of each run's UTF-8 bytes: a byte is mixed in, then eight marks shift
OP11_SQL = """
WITH RECURSIVE
r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]{6,}')) AS run FROM documents),
l AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM r),
h AS (SELECT run, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(id || run, ''), lambda ch:
              CASE WHEN unicode(ch) < 128 THEN [CAST(unicode(ch) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]
                   ELSE [192 + (unicode(ch) >> 6), -1, -1, -1, -1, -1, -1, -1, -1, 128 + (unicode(ch) & 63), -1, -1, -1, -1, -1, -1, -1, -1] END))),
              lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295) AS h FROM l),
o AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, 2 + h % length(run)) ELSE run END AS word FROM h),
v AS (SELECT word, count(*) AS n FROM o WHERE length(word) >= 6 GROUP BY word HAVING count(*) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
e AS (SELECT a.word, b.word AS near, b.n AS m FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
b AS (SELECT word, count(*) AS n_near, first(near ORDER BY m DESC, near) AS near, max(m) AS m FROM e GROUP BY word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 5 * n THEN near END AS form, CASE WHEN m >= 5 * n THEN m END AS form_n
      FROM v LEFT JOIN b ON v.word = b.word),
w(word, last) AS (SELECT word, word FROM f UNION ALL SELECT w.word, f.form FROM w JOIN f ON w.last = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, w.last AS root, f.n, f.n_near, f.form_n
FROM f JOIN w ON f.word = w.word JOIN f g ON w.last = g.word AND g.form IS NULL
"""
