"""Minimum-cost-flow resharding.

From the bytes in the old shards and the capacities of the new ones, a minimum-cost flow says
how many bytes go from which shard to which: a byte that stays in its shard costs nothing, any
other one unit.  The network has a node per shard and one hub for all moves, so it stays linear
in the number of shards, and the flow is solved by successive shortest paths.  Transfers are then
realised in blocks of documents: an old shard's documents, in the order of their checksums, are
taken as long as they lie wholly within a transfer, and what then is missing (less than two
documents) is filled up with the smallest ones.  Every transfer becomes a few ranges of its shard's
orders; a document's new shard follows from its size, id, checksum and place and those few
ranges alone, so the documents need no join before they are written.

Writing: files of shards that neither give nor take stay as they are; the others are rewritten
through one range-partitioned shuffle, sorted by id, each row with its position; a document's slot
is its position plus the number of rows of the files before, gapless from 0.

Defined cases: a null text has size 8 (nothing plus the row's overhead) and checksum 0; null ids
come first; equal rows are told apart by their places; documents
larger than a capacity get a shard each as far as there are any; an empty table gives empty
shards and an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, located, read, running, small

OVERHEAD = 8
OLD_SHARDS, NEW_SHARDS = 16, 24
#: What an old shard's rows are ordered by; a row's place tells equal rows apart.
KEY = {"size": "bigint", "doc_id": "bigint", "crc": "bigint", "_file": "string", "_row": "bigint"}
ORDERS = {"size": list(KEY), "crc": ["crc", "doc_id", "size", "_file", "_row"]}


# --- the flow -------------------------------------------------------------------------
class Network:
    """A flow network with costs; arcs are kept with their reverses."""

    def __init__(self, nodes: int):
        self.out: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def solve(self, source: int, sink: int) -> tuple[int, int]:
        """(flow, cost): augments along a shortest path until there is none."""
        flow = paid = 0
        while True:
            far = [float("inf")] * len(self.out)
            by, waiting, queued = [-1] * len(self.out), deque([source]), {source}
            far[source] = 0
            while waiting:
                u = waiting.popleft()
                queued.discard(u)
                for e in self.out[u]:
                    if self.room[e] and far[u] + self.cost[e] < far[self.to[e]]:
                        far[self.to[e]], by[self.to[e]] = far[u] + self.cost[e], e
                        if self.to[e] not in queued:
                            waiting.append(self.to[e])
                            queued.add(self.to[e])
            if by[sink] < 0:
                return flow, paid
            path, v = [], sink
            while v != source:
                path.append(by[v])
                v = self.to[by[v] ^ 1]
            push = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            flow, paid = flow + push, paid + push * far[sink]


@dataclass(frozen=True)
class Transfer:
    old: int
    new: int
    size: int


def transfers(sizes: dict[int, int], capacity: dict[int, int]) -> list[Transfer]:
    """The moves of least total bytes that fit ``sizes`` into ``capacity`` (which must hold them)."""
    old, new = sorted(sizes), sorted(capacity)
    if sum(sizes.values()) > sum(capacity.values()):
        raise ValueError("the new shards are too small")
    left, right = {s: 3 + i for i, s in enumerate(old)}, {s: 3 + len(old) + i for i, s in enumerate(new)}
    source, sink, hub = 0, 1, 2
    net = Network(3 + len(old) + len(new))
    leaves, enters = {}, {}
    for s in old:
        net.arc(source, left[s], sizes[s], 0)
        if s in right:
            net.arc(left[s], right[s], sizes[s], 0)
        leaves[s] = net.arc(left[s], hub, sizes[s], 1)
    for s in new:
        net.arc(right[s], sink, capacity[s], 0)
        enters[s] = net.arc(hub, right[s], capacity[s], 0)
    net.solve(source, sink)
    # what goes through the hub, matched up: any matching costs the same
    give = deque((s, net.room[leaves[s] ^ 1]) for s in old if net.room[leaves[s] ^ 1])
    out = []
    for s in new:
        need = net.room[enters[s] ^ 1]
        while need:
            a, n = give.popleft()
            take = min(n, need)
            out.append(Transfer(a, s, take))
            need -= take
            if n > take:
                give.appendleft((a, n - take))
    return out


def even(total: int, shards: int) -> dict[int, int]:
    """Capacities that differ by one byte at most and sum to ``total``."""
    return {s: total // shards + (s < total % shards) for s in range(shards)}


# --- the rows -------------------------------------------------------------------------
def size_of(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint") + OVERHEAD


def checksum(text: Column) -> Column:
    return F.crc32(F.coalesce(text.cast("binary"), F.lit(b"")))


def old_shard(shards: int) -> Column:
    """The layout before: documents dealt out by id (a null id: shard 0)."""
    return F.coalesce(F.pmod(F.col("doc_id"), F.lit(shards)), F.lit(0)).cast("int")


Range = tuple[int, tuple, tuple, int]


def fill(rows: DataFrame, wanted: list[Transfer], by: str, scratch: Scratch) -> tuple[list[Range], list[Transfer]]:
    """The rows that lie wholly inside each transfer's stretch of their shard's order, and what is still to move.

    A range is (old shard, its first and last key in the order ``by``, new shard).
    """
    upto: dict[int, int] = {}
    ends = []
    for m in wanted:
        lo = upto.get(m.old, 0)
        ends.append((m.old, lo, lo + m.size, m.new))
        upto[m.old] = lo + m.size
    stretches = rows.sparkSession.createDataFrame(ends, "o int, lo bigint, hi bigint, new int")
    summed = running(rows.where(F.col("old").isin(list(upto))), ["old"], ORDERS[by], F.col("size"), "upto", scratch)
    inside = (F.col("old") == F.col("o")) & (F.col("upto") - F.col("size") >= F.col("lo")) & (F.col("upto") <= F.col("hi"))
    key = F.struct(*ORDERS[by])
    found = summed.join(F.broadcast(stretches), inside).groupBy("old", "lo", "new")  # no more stretches than shards, old and new
    got = {(r["old"], r["lo"]): r for r in found.agg(F.sum("size").alias("n"), F.min(key).alias("first"), F.max(key).alias("last")).collect()}
    ranges, left = [], []
    for old, lo, hi, new in ends:
        r = got.get((old, lo))
        if r:
            ranges.append((old, tuple(r["first"]), tuple(r["last"]), new))
        if rest := hi - lo - (r["n"] if r else 0):
            left.append(Transfer(old, new, rest))
    return ranges, left


def plan(rows: DataFrame, capacity: int | dict[int, int], scratch: Scratch) -> tuple[list[Transfer], list[tuple[str, list[Range]]]]:
    """Transfers, and rounds of (order, ranges of rows) that realise them.

    ``rows``: old and KEY.  ``capacity``: bytes per new shard, or a number of shards of even size.
    The first round goes by checksum, the others fill up by size until what is missing is below a
    thousandth of the bytes, or no document is small enough.
    """
    sizes = {r["old"]: r["n"] for r in rows.groupBy("old").agg(F.sum("size").alias("n")).collect()}
    total = sum(sizes.values())
    moves = transfers(sizes, even(total, capacity) if isinstance(capacity, int) else capacity)
    left, rounds = moves, []
    while left and (len(rounds) < 2 or sum(m.size for m in left) > total / 1000):
        by = "size" if rounds else "crc"
        ranges, rest = fill(rows.where(assigned(rounds).isNull()), left, by, scratch)
        if not ranges and rounds:
            break
        left = rest
        rounds.append((by, ranges))
    return moves, rounds


def assigned(rounds: list[tuple[str, list[Range]]]) -> Column:
    """The new shard of a row by the first round that moves it, else null; a round has no more ranges than shards."""
    out = F.when(F.lit(False), 0)
    for by, ranges in rounds:
        key = F.struct(*ORDERS[by])
        for old, first, last, new in ranges:
            lo, hi = (F.struct(*[F.lit(v).cast(KEY[k]) for v, k in zip(end, ORDERS[by])]) for end in (first, last))
            out = out.when((F.col("old") == old) & (key >= lo) & (key <= hi), new)
    return out


def new_shard(rounds: list[tuple[str, list[Range]]]) -> Column:
    return F.coalesce(assigned(rounds), F.col("old")).cast("int")


def rewrite(docs: DataFrame, old: Column, capacity: int | dict[int, int], scratch: Scratch, out: str | None = None) -> DataFrame:
    """Reshards ``docs`` and writes the affected shards to ``out``; returns the files' rows.

    Result: doc_id, text, size, crc, old, shard, slot.  A shard that no transfer touches isn't
    written: its rows are read from where they were.
    """
    spark, out = docs.sparkSession, out or scratch.place("shards")
    rows = located(docs, scratch, "doc_id", "text").withColumns({"size": size_of(F.col("text")), "crc": checksum(F.col("text")), "old": old})
    narrow = scratch.table(rows.drop("text"), "sizes")
    moves, rounds = plan(narrow, capacity, scratch)
    placed = rows.withColumn("shard", new_shard(rounds))
    touched = sorted({m.old for m in moves} | {m.new for m in moves})
    changed = F.col("shard").isin(touched) if touched else F.lit(False)
    ordered = placed.where(changed).drop("_file", "_row").repartitionByRange("shard", "doc_id", "crc").sortWithinPartitions("shard", "doc_id", "crc")
    ordered = ordered.withColumn("file", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    path = f"{out}/rewritten"
    ordered.write.partitionBy("shard").parquet(path)
    files = spark.read.schema(ordered.schema).parquet(path)
    # one row per written file; a shard's files are in the order of their numbers
    spans = files.groupBy("shard", "file").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("shard", "file").collect()
    base, before, last = [], 0, None
    for r in spans:
        before = 0 if r["shard"] != last else before
        base.append((r["shard"], r["file"], before - r["first"]))
        before, last = before + r["n"], r["shard"]
    shift = spark.createDataFrame(base, "s int, f int, shift bigint")
    cols = ["doc_id", "text", "size", "crc", "old", "shard", "slot"]
    written = files.join(small(shift, 32), (F.col("shard") == F.col("s")) & (F.col("file") == F.col("f")))
    written = written.withColumn("slot", F.col("at") + F.col("shift")).select(*cols)
    untouched = narrow.withColumn("shard", new_shard(rounds)).where(~changed)
    if untouched.isEmpty():
        return written
    ranked = running(untouched, ["shard"], ["doc_id", "crc", "_file", "_row"], F.lit(1).cast("bigint"), "rank", scratch)
    ranked = ranked.select(F.col("_file").alias("f"), F.col("_row").alias("r"), (F.col("rank") - 1).alias("slot"))
    stay = placed.where(~changed).join(ranked, (F.col("_file") == F.col("f")) & (F.col("_row") == F.col("r")))
    return written.unionByName(stay.select(*cols))


def op2_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """16 shards by id are spread evenly over 24; all figures come from the written files."""
    files = rewrite(read(spark, sf_dir, "documents"), old_shard(OLD_SHARDS), NEW_SHARDS, Scratch(spark, "op2"))
    return files.select(
        "doc_id", size_of(F.col("text")).alias("size"), checksum(F.col("text")).alias("text_crc32"), F.lit("bytes").alias("law"),
        "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), F.col("old").alias("old_shard"),
    )
