"""Hard negatives by an inverted multi-index: two half-space codebooks, cells visited by a heap, certified windows.

Vectors are cut into two halves and each half is quantised by a codebook of its own (k-means on a
bounded sample); a cell is a pair of codewords, and every row is indexed in its cell.  An anchor's inner
product with a row of cell (i, j) is at most the sum of two half scores,
``<a1, c_i> + |a1| r_i`` and ``<a2, c_j> + |a2| r_j``, where the radius r is the largest distance of a row's half
from its codeword.  With each list of half scores sorted, a heap walks the cells by falling sum (multi-sequence
algorithm) and stops when its window is certified: no cell that is left can hold a row that belongs in it.
So results are exact, whatever the codebooks are like; they only decide how much is visited.

Two passes.  The first finds each anchor's best rows of its own label (its positives); the second, for each
positive, the best rows of other labels whose scores are within a window set by the positive's.  In each pass
anchors travel in blocks of bounded bytes to the index, which lies sorted by cell; a task holds a bounded
chunk of it, with the chunk's own radii, and returns the few best rows of each window, which Spark
merges.  Rows of a crowded cell are spread over chunks.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part; shorter vectors are
padded with zeros; a null id comes last among equal scores and is never an anchor; equal ids and repeated
rows are rows of their own, in the order of the index; a positive of negative score has no window; an empty
table, or none that takes part, gives an empty result; other columns are ignored, whatever their names.  Components
beyond ``2**23`` after scaling fail the job: their scores don't fit a long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read

#: Rows that the codebooks are fitted on, about (chosen by a hash of the row's number).
FIT_ROWS = 16_384
#: Rows a cell holds on average.
CELL_ROWS = 16
#: Bytes of index vectors that a task searches at a time, and of the anchors of a block.
CHUNK_BYTES, BLOCK_BYTES = 32 << 20, 16 << 20
#: Rows that are scored at a time.
STEP = 512
LARGEST = 1 << 23


def scaled(vector: Column) -> Column:
    """floor(256 * x) of every component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def valid_rows(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` (id, vector of integers or null components, label) without the rows that take no part, with a number ``uid`` each."""
    keep = F.col("label").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    large = F.exists("vector", lambda x: F.abs(x) > LARGEST)
    vector = F.when(large, F.raise_error(F.lit("a component is too large")).cast("array<int>")).otherwise(F.col("vector").cast("array<int>"))
    rows = df.where(keep).select("id", vector.alias("vector"), F.col("label").cast("long").alias("label"))
    return scratch.table(rows.withColumn("uid", F.monotonically_increasing_id()), "rows")


# --- the index ---------------------------------------------------------------------------
def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norms = (centres * centres).sum(1) / 2
    out = np.empty(len(x), np.int32)
    for at in range(0, len(x), 4096):
        out[at:at + 4096] = (norms - x[at:at + 4096] @ centres.T).argmin(1)
    return out


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means centres of ``x``, from evenly spaced distinct rows on."""
    start = np.unique(x, axis=0)
    centres = start[np.linspace(0, len(start) - 1, min(k, len(start))).astype(int)]
    for _ in range(rounds):
        own = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        n = np.bincount(own, minlength=len(centres))[:, None]
        centres = np.where(n > 0, sums / np.maximum(n, 1), centres)
    return centres


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """An Arrow list column as float64 rows of ``width`` values, padded with zeros."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.value_lengths(), dtype=np.int64)
    if len(ends) and (ends == width).all():
        return flat.reshape(-1, width).astype(np.float64)
    out = np.zeros((len(ends), width))
    out[np.arange(width) < ends[:, None]] = flat
    return out


@dataclass
class Index:
    rows: DataFrame  # uid, id, vector, label, i, j
    centres: tuple[np.ndarray, np.ndarray]
    width: int


def build_index(rows: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS, cell_rows: int = CELL_ROWS) -> Index | None:
    """Every row of :func:`valid_rows` in its cell, sorted by cell; None if there is no row."""
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("vector"))).first()
    if not n:
        return None
    cut = min(1.0, fit_rows / n) * (1 << 30)
    sample = rows.where(F.pmod(F.xxhash64("uid"), F.lit(1 << 30)) < cut).select("vector").toArrow()["vector"].combine_chunks()
    if not len(sample):
        sample = rows.limit(1).select("vector").toArrow()["vector"].combine_chunks()
    x, half, k = matrix(sample, width), (width + 1) // 2, max(1, round((n / cell_rows) ** 0.5))
    centres = codebook(x[:, :half], k), codebook(x[:, half:], k)
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one, two = shared.value
        for b in batches:
            v = matrix(b.column("vector"), width)
            cells = [pa.array(nearest(v[:, :half], one)), pa.array(nearest(v[:, half:], two))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cells], [*b.schema.names, "i", "j"])

    cells = rows.select("uid", "id", "vector", "label").mapInArrow(placed, "uid bigint, id bigint, vector array<int>, label bigint, i int, j int")
    order = ["i", "j", "uid"]
    return Index(scratch.table(cells.repartitionByRange(*order).sortWithinPartitions(*order), "index"), centres, width)


# --- the search --------------------------------------------------------------------------
class Chunk:
    """Rows of the index that a task searches: vectors sorted by cell, and the radii of their codewords."""

    def __init__(self, batches: list[pa.RecordBatch], centres: tuple[np.ndarray, np.ndarray], width: int):
        t = pa.Table.from_batches(batches).combine_chunks()
        half = (width + 1) // 2
        ids = t["id"].combine_chunks()
        self.no_id = np.asarray(ids.is_null())
        self.id, self.uid, self.label = np.asarray(ids.fill_null(0)), t["uid"].to_numpy(), t["label"].to_numpy()
        v = matrix(t["vector"].combine_chunks(), width)
        # sums of products up to 2**53 are exact in doubles
        exact = width * float(np.abs(v).max(initial=0)) ** 2 < 2.0**53
        self.v = v if exact else v.astype(np.int64)
        self.codes, self.parts, self.radii, own = [], [], [], []
        for h, name in enumerate("ij"):
            used, at = np.unique(t[name].to_numpy(), return_inverse=True)
            c = centres[h][used]
            far = np.zeros(len(used))
            np.maximum.at(far, at, np.linalg.norm((v[:, :half] if h == 0 else v[:, half:]) - c[at], axis=1))
            self.codes.append(used), self.parts.append(c), self.radii.append(far), own.append(at)
        cell = own[0].astype(np.int64) * len(self.codes[1]) + own[1]
        order = np.argsort(cell, kind="stable")
        for name in ("id", "no_id", "uid", "label", "v"):
            setattr(self, name, getattr(self, name)[order])
        names, starts = np.unique(cell[order], return_index=True)
        self.cells = dict(zip(names.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cell)])))
        self.half = half

    def walk(self, anchor: np.ndarray) -> Iterator[tuple[float, float, tuple[int, int] | None]]:
        """(upper bound, lower bound, rows) of the cells by falling upper bound; the rows of an empty cell are None."""
        halves = anchor[:self.half].astype(np.float64), anchor[self.half:].astype(np.float64)
        upper, lower, order = [], [], []
        for a, c, r in zip(halves, self.parts, self.radii):
            mid, reach = c @ a, np.linalg.norm(a) * r
            slack = 1e-6 * (np.abs(mid) + reach) + 1e-3  # of the rounding above
            by = np.argsort(-(mid + reach + slack), kind="stable")
            order.append(by.tolist())
            upper.append((mid + reach + slack)[by].tolist())
            lower.append((mid - reach - slack)[by].tolist())
        wide, cells = len(self.codes[1]), self.cells
        heap = [(-(upper[0][0] + upper[1][0]), 0, 0)]
        while heap:
            up, s, t = heapq.heappop(heap)
            yield -up, lower[0][s] + lower[1][t], cells.get(order[0][s] * wide + order[1][t])
            if t + 1 < len(upper[1]):
                heapq.heappush(heap, (-(upper[0][s] + upper[1][t + 1]), s, t + 1))
            if t == 0 and s + 1 < len(upper[0]):
                heapq.heappush(heap, (-(upper[0][s + 1] + upper[1][0]), s + 1, 0))

    def scan(self, anchor: np.ndarray, windows: list["Best"]) -> None:
        """Offers rows to the ``windows``, cell by cell, until all are certified."""
        held: list[tuple[int, int]] = []
        n, top = 0, max((w.high for w in windows), default=-1)
        for upper, lower, rows in self.walk(anchor):
            if held and (n >= STEP or any(w.certified(upper) for w in windows)):
                self._offer(anchor, held, windows)
                held, n = [], 0
            windows = [w for w in windows if not w.certified(upper)]
            if not windows:
                break
            if rows is not None and lower <= top:
                held.append(rows)
                n += rows[1] - rows[0]
        if held:
            self._offer(anchor, held, windows)

    def _offer(self, anchor: np.ndarray, held: list[tuple[int, int]], windows: list["Best"]) -> None:
        at = np.concatenate([np.arange(a, b) for a, b in held])
        scores = np.rint(self.v[at] @ anchor.astype(self.v.dtype)).astype(np.int64)
        for w in windows:
            w.offer(self, at, scores)


class Best:
    """The first ``size`` rows of one window: scores from ``low`` to ``high``, of the ``label`` or of others."""

    def __init__(self, size: int, label: int, same: bool, uid: int, low: float = -np.inf, high: float = np.inf):
        self.size, self.label, self.same, self.uid, self.low, self.high = size, label, same, uid, low, high
        self.rows: list[tuple[int, bool, int, int]] = []  # (-score, no id, id, uid), sorted

    def certified(self, bound: float) -> bool:
        """No row that scores ``bound`` at most belongs in here; one that ties with the last row may."""
        return bound < self.low or (len(self.rows) == self.size and -self.rows[-1][0] > bound)

    def offer(self, chunk: Chunk, at: np.ndarray, scores: np.ndarray) -> None:
        least = -self.rows[-1][0] if len(self.rows) == self.size else -np.inf
        fit = ((chunk.label[at] == self.label) == self.same) & (scores >= max(self.low, least)) & (scores <= self.high)
        at, scores = at[fit], scores[fit]
        if len(at) > self.size:  # only the best and what ties with them
            keep = scores >= np.partition(scores, -self.size - 1)[-self.size - 1]
            at, scores = at[keep], scores[keep]
        more = zip((-scores).tolist(), chunk.no_id[at].tolist(), chunk.id[at].tolist(), chunk.uid[at].tolist())
        self.rows = heapq.nsmallest(self.size, [*self.rows, *(r for r in more if r[3] != self.uid)])


FOUND = pa.schema([("a", pa.int64()), ("p", pa.int64()), ("score", pa.int64()), ("id", pa.int64()), ("uid", pa.int64())])


def _search(index: Index, anchors: DataFrame, scratch: Scratch, name: str, size: int, windows) -> DataFrame:
    """The first ``size`` rows of each window of each anchor: a, p (numbers of anchor and window), score, id, uid, rank.

    ``anchors``: uid, vector, label and whatever ``windows(row)`` makes a list of (p, :class:`Best`) from.
    """
    spark, width, centres = anchors.sparkSession, index.width, index.centres
    per_row = 8 * width + 256
    blocks = max(1, -(-anchors.count() * per_row // BLOCK_BYTES))
    numbered = scratch.table(anchors.withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks))), f"{name}_anchors")
    limit = max(1024, CHUNK_BYTES // (8 * width))

    def found_in(batches: list[pa.RecordBatch], block) -> Iterator[pa.RecordBatch]:
        chunk, out = Chunk(batches, centres, width), []
        for row, vector in block:
            own = windows(row)
            chunk.scan(vector, [w for _, w in own])
            out += [(row["uid"], p, -r[0], None if r[1] else r[2], r[3]) for p, w in own for r in w.rows]
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), FOUND)], schema=FOUND)

    parts = []
    for b in range(blocks):
        rows = numbered.where(F.col("block") == b).drop("block").toArrow()
        vectors = matrix(rows["vector"].combine_chunks(), width) if rows.num_rows else []
        shared = spark.sparkContext.broadcast(list(zip(rows.drop_columns(["vector"]).to_pylist(), vectors)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                if n and n + batch.num_rows > limit:
                    yield from found_in(held, shared.value)
                    held, n = [], 0
                held.append(batch)
                n += batch.num_rows
            if n:
                yield from found_in(held, shared.value)

        parts.append(scratch.table(index.rows.mapInArrow(run, "a bigint, p bigint, score bigint, id bigint, uid bigint"), f"{name}{b}"))
        shared.unpersist()
    found = parts[0]
    for more in parts[1:]:
        found = found.unionByName(more)
    order = Window.partitionBy("a", "p").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last(), "uid")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= size)


def hard_negatives(
    rows: DataFrame,
    is_anchor: Column,
    scratch: Scratch,
    positives: int = 5,
    negatives: int = 10,
    window: tuple[int, int] = (30, 90),
    fit_rows: int = FIT_ROWS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score (and the rows' numbers, anchor and positive).

    ``rows``: id, vector (integers), label.  A negative's score is ``window`` per cent of the positive's, both ends included.
    """
    spark, (low, high) = rows.sparkSession, window
    rows = valid_rows(rows, scratch)
    index = build_index(rows, scratch, fit_rows, cell_rows)
    anchors = rows.where(is_anchor)
    if index is None or anchors.isEmpty():
        return spark.createDataFrame([], "anchor bigint, positive bigint, anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")

    def of_label(row: dict) -> list:
        return [(-1, Best(positives, row["label"], True, row["uid"]))]

    def of_others(row: dict) -> list:
        # scores are integers: low * p <= 100 * s <= high * p
        ends = [(p["uid"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in row["wanted"]]
        return [(uid, Best(negatives, row["label"], False, row["uid"], a, b)) for uid, a, b in ends if a <= b]

    best = scratch.table(_search(index, anchors, scratch, "positives", positives, of_label), "best")
    wanted = best.groupBy("a").agg(F.collect_list(F.struct("uid", "score")).alias("wanted"))  # a few rows of each anchor
    asking = anchors.join(wanted, F.col("uid") == F.col("a")).drop("a")
    found = _search(index, asking, scratch, "negatives", negatives, of_others)
    pairs = best.select(F.col("a").alias("anchor"), F.col("uid").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    named = pairs.join(anchors.select(F.col("uid").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    found = found.select(F.col("a").alias("anchor"), F.col("p").alias("positive"), "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return named.join(found, ["anchor", "positive"])


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "embeddings")
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)
    label = F.col("label").cast("long")
    rows = rows.select(
        F.col("vec_id").alias("id"), scaled(F.transform("embedding", finite)).alias("vector"),
        F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
    )
    found = hard_negatives(rows, F.col("id") % 100 == 0, Scratch(spark, "op13"))
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


OP13_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q
           FROM embeddings
           WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
           FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
     p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
           QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
WINDOW w AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other_id)
QUALIFY row_number() OVER w <= 10
"""
