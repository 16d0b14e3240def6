"""SimHash near-dedup by multi-index hashing.

A document's fingerprint sums, bit by bit, the hashes of all its word shingles.  Two
fingerprints link at ``distance`` or fewer differing bits.  The 64 bits are cut into segments;
by the pigeonhole principle linked fingerprints agree in some segment up to a small radius, so
every distinct fingerprint is entered in one table per segment and looks up the Hamming ball
around its own value there; whole distances are verified in the join.

Buckets of many fingerprints (families of near copies) would give all pairs of their members.
Those buckets are dealt to tasks in blocks of bounded size, every pair of blocks meets once, and
a task returns a spanning forest of the links it finds, never the links themselves: no link
between different fingerprints is lost for the components.  Components are found by alternating
star contraction on tables; equal fingerprints are merged before anything else.

Defined cases: a null or empty text, or one of white space only, has fingerprint zero and links
like any other; a text of fewer words than a shingle is one shingle; ids that repeat are rows of
their own; a null id is the largest; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fixed, located, read, slices, small, without

#: A bucket with more members goes to blocks; a block holds at most so many fingerprints of a side.
HOT, BLOCK = 32, 1 << 15
SEED = 42


def fingerprint(text: str | None, words: int) -> int:
    w = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space parts words
    if not w:
        return 0
    joined = b" ".join(w)
    ends = [e - 1 for e in accumulate(len(x) + 1 for x in w)]
    starts, h = [0, *(e + 1 for e in ends[:-1])], xxhash.xxh64_intdigest
    if len(w) < words:
        hashes = [h(joined, SEED)]
    else:
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :])]
    votes = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        bits = np.array(hashes[at : at + (1 << 16)], dtype=">u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(bits, axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * votes > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(rows: DataFrame, words: int) -> DataFrame:
    """``rows`` (with ``text``) with ``fp`` (64 bits in a bigint) in place of the text."""
    keep = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            fp = pa.array([fingerprint(t, words) for t in b.column("text").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), fp], [*keep, "fp"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.mapInArrow(run, f"{schema}, fp bigint")


def segments(n: int, distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of each segment, for ``n`` fingerprints.

    With m segments and distance = m * q + a, linked values are within q bits in one of the
    first a + 1 segments or within q - 1 in another.  m is the number with the least work: a
    look-up counts as four comparisons, and a value meets n / 2**bits entries.
    """
    best: tuple[float, list[tuple[int, int, int]]] = (math.inf, [])
    for m in range(1, max(1, distance) + 1):
        q, a = divmod(distance, m)
        cuts = [64 * i // m for i in range(m + 1)]
        own = [(lo, hi - lo, q if i <= a else q - 1) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]
        own = [s for s in own if s[2] >= 0]
        if any(s[2] > 2 for s in own):
            continue
        work = sum(ball * (4 + n / 2.0**bits) for _, bits, r in own for ball in [sum(math.comb(bits, k) for k in range(r + 1))])
        best = min(best, (work, own))
    if not best[1]:
        raise ValueError("distance is too large for 64 bits")
    return best[1]


def masks(bits: int, radius: int) -> list[int]:
    """All values of ``bits`` bits with at most ``radius`` (0 to 2) ones."""
    ones = [1 << i for i in range(bits)]
    return [0, *(ones if radius else []), *([a | b for i, a in enumerate(ones) for b in ones[:i]] if radius > 1 else [])]


def forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """(member, root) edges that connect just what links connect among ``fps``.

    Each value is taken up once and compared only with those that nothing has reached yet.
    """
    left, out = np.unique(fps), []
    while len(left):
        root, left = int(left[0]), left[1:]
        todo = [root]
        while todo and len(left):
            near = np.bitwise_count((left ^ np.int64(todo.pop())).view(np.uint64)) <= distance
            found = left[near].tolist()
            out += [(x, root) for x in found]
            todo += found
            left = left[~near]
    return out


def links(nodes: DataFrame, distance: int, scratch: Scratch, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect whatever links connect."""
    spark = nodes.sparkSession
    plan = segments(nodes.count(), distance)
    value = [F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << bits) - 1 if bits < 64 else -1)) for lo, bits, _ in plan]
    entry = F.array(*[F.struct(F.lit(i).alias("seg"), v.alias("key")) for i, v in enumerate(value)])
    table = nodes.select("fp", F.inline(entry))
    def around(i: int, v: Column, bits: int, radius: int) -> Column:
        near = F.array(*[F.lit(m).cast("bigint") for m in masks(bits, radius)])
        return F.transform(near, lambda m: F.struct(F.lit(i).alias("seg"), v.bitwiseXOR(m).alias("key")))

    ball = F.concat(*[around(i, v, bits, r) for i, (v, (_, bits, r)) in enumerate(zip(value, plan))])
    probes = nodes.select(F.col("fp").alias("probe"), F.inline(ball))

    sizes = table.groupBy("seg", "key").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > hot)
    sizes = small(scratch.table(sizes, "hot"), 64)
    keys = ["seg", "key"]
    linked = (F.bit_count(F.col("fp").bitwiseXOR(F.col("probe"))) <= distance) & (F.col("probe") < F.col("fp"))
    calm = table.join(sizes, keys, "left_anti").alias("t").join(
        probes.alias("p"), (F.col("t.seg") == F.col("p.seg")) & (F.col("t.key") == F.col("p.key")) & linked
    ).select(F.col("probe").alias("a"), F.col("fp").alias("b"))

    members = table.join(sizes, keys).select(*keys, "fp", "members")
    probing = scratch.table(probes.join(sizes, keys).select(*keys, F.col("probe").alias("fp"), "members"), "probing")
    probed = scratch.table(probing.groupBy(*keys).agg(F.count(F.lit(1)).alias("probes")), "probed")
    rows_of, cols_of = F.ceil(F.col("members") / block).cast("int"), F.ceil(F.col("probes") / block).cast("int")

    def dealt(df: DataFrame, own: str, own_n: Column, other: str, other_n: Column) -> DataFrame:
        mine = F.pmod(F.xxhash64("fp"), own_n).cast("int").alias(own)
        return df.join(small(probed, 64), keys).select(*keys, "fp", mine, F.explode(F.sequence(F.lit(0), other_n - 1)).alias(other))

    met = dealt(members, "r", rows_of, "c", cols_of).unionByName(dealt(probing, "c", cols_of, "r", rows_of))

    def joined(group: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(forest(group["fp"].to_numpy(np.int64), distance), columns=["a", "b"], dtype="int64")

    crowded = met.groupBy(*keys, "r", "c").applyInPandas(joined, "a bigint, b bigint")
    both = calm.unionByName(crowded)
    return scratch.table(both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): every node of an edge and the least node that it is connected to.

    Alternating large-star and small-star steps (Kiveris et al., 2014): every step is a table,
    neighbours' minima are pre-aggregated, and the number of steps grows with the logarithm of
    the longest path.
    """

    def star(e: DataFrame, name: str, large: bool) -> DataFrame:
        # e has (u, v), u > v
        sides = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = scratch.table(sides.groupBy("u").agg(F.min("v").alias("m")), f"{name}_min")
        least = least.select(F.col("u").alias("w"), F.least("m", "w").alias("m") if large else F.col("m"))
        found = sides.join(least, F.col("u") == F.col("w"))
        if large:
            out = found.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = found.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        return scratch.table(out.where("u > v").distinct(), name)

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    now = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    seen, step = None, 0
    while (mark := digest(now)) != seen:
        seen, step = mark, step + 1
        now = star(star(now, f"large{step}", True), f"small{step}", False)
        for gone in (f"large{step}_min", f"small{step}_min", f"large{step}", f"small{step - 1}"):
            scratch.drop(gone)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def near_groups(docs: DataFrame, scratch: Scratch, words: int = 4, distance: int = 4, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, _file, _row, fp, best (the group's least row as a struct)."""
    rows = scratch.table(fingerprints(located(docs, scratch, "doc_id", "text"), words), "fingerprints")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_file", "_row")).alias("best")
    nodes = scratch.table(rows.groupBy("fp").agg(first), "nodes")
    roots = components(links(nodes, distance, scratch, hot, block), scratch)
    member = nodes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "best")
    member = scratch.table(member, "member")
    least = scratch.table(member.groupBy("root").agg(F.min("best").alias("best")), "least")
    classes = scratch.table(member.drop("best").join(least, "root").select(F.col("fp").alias("f"), "best"), "classes")
    return rows.join(classes, F.col("fp") == F.col("f")).drop("f")


def keep_one(docs: DataFrame, scratch: Scratch, words: int = 4, distance: int = 4) -> DataFrame:
    """``docs`` with the least row of each group only; its columns stay as they are."""
    docs = fixed(docs, scratch)
    own = (F.col("_file") == F.col("best._file")) & (F.col("_row") == F.col("best._row"))
    return without(docs, near_groups(docs, scratch, words, distance).where(~own), scratch)


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(read(spark, sf_dir, "documents"), Scratch(spark, "op4"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))
