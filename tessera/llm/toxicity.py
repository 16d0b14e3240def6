"""Toxicity by class-conditional Kneser-Ney models.

Two bigram models, of toxic and of ordinary text, are learnt from labelled rows:

    p_y(w | v) = own(n_y(v, w)) / n_y(v) + l_y(v) * p_y(w)       pairs
    p_y(w)     = own(c_y(w)) / C_y       + l_y    * shared(w)    words, by continuation counts
    shared(w)  = (c(w) - D) / C          + D * V / C / (V + 1)   counts pooled over the classes

own(n) is n less the absolute discount D for expressions that keep counts of their own, and 0 for all others;
the weights l are what is left to one.  c(w) counts the distinct words before w, V the words; a word
that was never seen has the last term of shared alone.  So each class sums to one.

An expression keeps counts of its own only if its documents speak for a difference between the classes: its likelihood-ratio statistic
(of a pair: of the distinct words before it, given its second word) is at least 1.5 ln(number of expressions), which chance alone rarely reaches in
any of them.  Everything rarer is smoothed into the shared counts, where both classes have it alike.
Without this gate, with own counts for all expressions, the models tell little: most words of these texts are rare, and of
thousands of chance differences a text's sum is noise (README has figures).  A text's
log-likelihoods are compared per word, and a logistic regression on the length-normalised
differences turns them into a probability.

Folds by crc32 of the id modulo 5: 0 is never learnt from, 1 calibrates, the others are counted.
The classifier is fitted on at most ``fit_rows`` labelled rows, those with the smallest crc32 of
their id; every text is scored whole.  Counting and testing run as Spark jobs; the driver gets
the expressions that were kept, a few sums, and two numbers per calibration row.

Defined cases: a text without words (null or empty, say) gets the share of toxic labels as its
score; labels that are null are skipped, and of several labels of one id the largest counts; rows that repeat
are scored alike; without labels of both kinds every score is the share of toxic labels (0
without any); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fixed, fold, located, portions, read, slices, without

#: Most labelled rows that the classifier is fitted on.
FIT_ROWS = 20_000
DISCOUNT = 0.75
#: Times ln(number of expressions): the statistic from which on an expression keeps counts of its own.
GATE = 1.5
WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


# --- the model ------------------------------------------------------------------------
@dataclass
class Model:
    """Log-ratio of toxic to ordinary probability of every expression that differs from the rest."""

    rest: float = 0.0  # of a word without own counts
    word: dict[str, float] = field(default_factory=dict)
    pair: dict[tuple[str, str], float] = field(default_factory=dict)
    after: dict[str, float] = field(default_factory=dict)  # contexts with own pairs: of their weights l
    weights: np.ndarray | None = None  # of the calibration: bias and design columns
    prior: float = 0.0
    # (ordinary, toxic) of the terms above, for looking at the models
    own: dict[str, tuple[float, float]] = field(default_factory=dict)
    left: tuple[float, float] = (1.0, 1.0)
    own_pair: dict[tuple[str, str], tuple[float, float]] = field(default_factory=dict)
    left_after: dict[str, tuple[float, float]] = field(default_factory=dict)

    def probability(self, y: int, v: str, w: str, shared: float) -> float:
        """p_y(w | v) of a word with ``shared`` probability."""
        low = self.own.get(w, (0.0, 0.0))[y] + self.left[y] * shared
        return self.own_pair.get((v, w), (0.0, 0.0))[y] + self.left_after.get(v, (1.0, 1.0))[y] * low

    def difference(self, words: list[str]) -> float:
        get, rest = self.word.get, self.rest
        total = sum([get(w, rest) for w in words])
        if self.after:
            for v, w in zip(["", *words], words):
                if v in self.after:
                    got = self.pair.get((v, w))
                    total += self.after[v] if got is None else got - get(w, rest)
        return total

    def score(self, difference: np.ndarray, n: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(n), self.prior)
        p = 1 / (1 + np.exp(-np.clip(design(difference, n) @ self.weights, -35, 35)))
        return np.where(n > 0, p, self.prior)


def design(difference: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Bias, the difference per word and per square root of words (its noise), and the square root."""
    n = np.maximum(n, 1)
    return np.stack([np.ones(len(n)), 20 * difference / n, difference / np.sqrt(n), np.sqrt(n) / 20], 1)


def calibrate(difference: np.ndarray, n: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression by Newton steps with a light ridge."""
    x, b = design(difference, n), np.zeros(4)
    ridge = np.diag([1e-6, *[0.05] * 3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -35, 35)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge + 1e-9 * np.eye(4), x.T @ (y - p) - ridge @ b)
        b = b + np.clip(step, -5, 5)
    return b


def statistic(a: Column, n: Column, b: Column, m: Column) -> Column:
    """Likelihood ratio (G squared) for a of n and b of m having one rate."""

    def part(k: Column, of: Column, p: Column) -> Column:
        yes = F.when((k > 0) & (p > 0), k * F.log(p)).otherwise(0.0)
        return yes + F.when((of > k) & (p < 1), (of - k) * F.log(1 - p)).otherwise(0.0)

    p = (a + b) / (n + m)
    return 2 * (part(a, n, a / n) + part(b, m, b / m) - part(a, n, p) - part(b, m, p))


# --- fitting --------------------------------------------------------------------------
def pair_counts(labelled: DataFrame) -> DataFrame:
    """v, w, n0, n1, docs0, docs1, by class (ordinary, toxic): how often word w follows word v ("" at the start), and after how many distinct words.

    v null: the word w by itself, and in how many documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["toxic", "u", "v", "w", "n", "docs"]
        kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()]
        for b in slices(batches, "text", 1 << 19):
            n: Counter = Counter()
            docs: Counter = Counter()
            for text, toxic in zip(b.column("text").to_pylist(), b.column("toxic").to_pylist()):
                w = words_of(text)
                n.update((toxic, u, v, x) for u, v, x in zip(["", "", *w], ["", *w], w))
                for x, k in Counter(w).items():
                    n[toxic, None, None, x] += k
                    docs[toxic, x] += 1
            cols = [*zip(*n)] or [[], [], [], []]
            own = [docs[y, x] if v is None else 0 for y, _, v, x in n]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*cols, n.values(), own], kinds)], names)

    rows = labelled.select("toxic", "text").mapInArrow(run, "toxic int, u string, v string, w string, n bigint, docs bigint")
    t = F.col("toxic") == 1
    both = [F.sum(F.when(t if y else ~t, F.col(c)).otherwise(0)).alias(f"{c}{y}") for c in ("n", "docs") for y in (0, 1)]
    triples = rows.groupBy("u", "v", "w").agg(*both)
    # copies of one passage have the same word before a pair: however many, they speak once
    spoken = [F.sum(F.when(F.col("v").isNull(), F.col(f"docs{y}")).otherwise((F.col(f"n{y}") > 0).cast("long"))).alias(f"docs{y}") for y in (0, 1)]
    return triples.groupBy("v", "w").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), *spoken)


def fit(docs: DataFrame, labels: DataFrame, scratch: Scratch, fit_rows: int = FIT_ROWS) -> Model:
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.withColumn("crc", F.crc32(F.col("id").cast("string"))).where("crc % 5 != 0")
    total = known.count()
    if total > fit_rows:  # a cut of the checksums that leaves 96 % of fit_rows on average, so that chance can't exceed it
        known = known.where(F.col("crc") < int(0.96 * fit_rows / total * 2**32))
    rows = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("id"))  # fit_rows rows at most
    rows = scratch.table(rows.select("text", "toxic", (F.col("crc") % 5 == 1).alias("calibrates")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in rows.where("not calibrates").groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model()
    model.prior = float(rows.agg(F.avg("toxic")).first()[0] or 0.0)
    if len(sizes) == 2:
        counts = scratch.table(pair_counts(rows.where("not calibrates")), "counts")
        learn(model, counts, sizes[0], sizes[1])
        held = differences(rows.where("calibrates"), model, ["toxic"]).toPandas()
        if held["toxic"].nunique() == 2:
            model.weights = calibrate(held["difference"].to_numpy(), held["n"].to_numpy(float), held["toxic"].to_numpy(float))
        scratch.drop("counts")
    scratch.drop("labelled")
    return model


def learn(model: Model, counts: DataFrame, ordinary: int, toxic: int) -> None:
    """Fills ``model`` from pair counts over so many ordinary and toxic documents."""
    pairs, singles = counts.where("v IS NOT NULL"), counts.where("v IS NULL").drop("v")
    # lower order: continuation counts per class, and shared ones over both
    cont = pairs.groupBy("w").agg(
        F.count_if(F.col("n0") > 0).alias("c0"), F.count_if(F.col("n1") > 0).alias("c1"), F.count(F.lit(1)).alias("shared")
    )
    sums = cont.agg(F.sum("c0"), F.sum("c1"), F.sum("shared"), F.count(F.lit(1))).first()
    if not sums[0] or not sums[1]:
        return
    total, n_words = sums[2], sums[3]
    limit = GATE * math.log(max(2, n_words))
    g = statistic(F.col("docs1"), F.lit(float(toxic)), F.col("docs0"), F.lit(float(ordinary)))
    own = singles.join(cont, "w").where(g >= limit).select("w", "c0", "c1", "shared").collect()  # the few expressions that differ
    model.own = {r["w"]: tuple(max(r[f"c{y}"] - DISCOUNT, 0) / sums[y] for y in (0, 1)) for r in own}
    model.left = tuple(1 - sum(p[y] for p in model.own.values()) for y in (0, 1))
    model.rest = math.log(model.left[1] / model.left[0])
    low = lambda w, c: [model.own.get(w, (0.0, 0.0))[y] + model.left[y] * shared_of(c, total, n_words) for y in (0, 1)]
    for r in own:
        p = low(r["w"], r["shared"])
        model.word[r["w"]] = math.log(p[1] / p[0])
    # higher order: pairs that tell more than their second word does (one that only one class has tells all by itself)
    n_pairs = pairs.count()
    word = pairs.groupBy(F.col("w").alias("x")).agg(F.sum("docs0").cast("double").alias("d0"), F.sum("docs1").cast("double").alias("d1"))
    shown = pairs.join(word.where("d0 > 0 AND d1 > 0"), F.col("w") == F.col("x"))
    g2 = statistic(F.col("docs1"), F.col("d1"), F.col("docs0"), F.col("d0"))
    better = shown.where(g2 >= GATE * math.log(max(2, n_pairs))).join(cont.select("w", "shared"), "w").select("v", "w", "n0", "n1", "shared").collect()
    names = following(pairs, {r["v"] for r in better})
    context = {r["v"]: (r["n0"], r["n1"]) for r in names.groupBy("v").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).collect()}
    for r in better:
        n = context[r["v"]]
        mass = tuple(max(r[f"n{y}"] - DISCOUNT, 0) / n[y] if n[y] else 0.0 for y in (0, 1))
        model.own_pair[r["v"], r["w"]] = mass
        left = model.left_after.get(r["v"], (1.0, 1.0))
        model.left_after[r["v"]] = (left[0] - mass[0], left[1] - mass[1])
    model.after = {v: math.log(left[1] / left[0]) for v, left in model.left_after.items()}
    for r in better:
        p = [m + q * x for m, q, x in zip(model.own_pair[r["v"], r["w"]], model.left_after[r["v"]], low(r["w"], r["shared"]))]
        model.pair[r["v"], r["w"]] = math.log(p[1] / p[0])


def shared_of(count: int, total: int, n_words: int) -> float:
    """The shared probability of a word with ``count`` distinct words before it (0: never seen)."""
    return max(count - DISCOUNT, 0) / total + DISCOUNT * n_words / total / (n_words + 1)


def following(pairs: DataFrame, names: set[str]) -> DataFrame:
    """The pairs after the few contexts ``names``."""
    table = pairs.sparkSession.createDataFrame([(v,) for v in sorted(names)], "name string")
    return pairs.join(F.broadcast(table), F.col("v") == F.col("name"), "left_semi")


# --- scoring --------------------------------------------------------------------------
def scored(batches: Iterator[pa.RecordBatch], model: Model, keep: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows with their scores; a worker holds one text's words at a time."""
    for b in portions(batches):
        told = [(model.difference(w), len(w)) for w in map(words_of, b.column("text").to_pylist())]
        d, n = np.array([x for x, _ in told], float), np.array([x for _, x in told], np.int64)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(c) for c in keep), pa.array(d), pa.array(n), pa.array(model.score(d, n.astype(float)))], [*keep, "difference", "n", "score"]
        )


def differences(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns, ``difference`` of the log-likelihoods, ``n`` words, ``score``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return scored(batches, shared.value, keep)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keep).schema)
    return rows.select(*keep, "text").mapInArrow(run, f"{schema}, difference double, n bigint, score double")


def keep_ordinary(docs: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """``docs`` without the rows whose score is 0.5 or more; its columns stay as they are."""
    docs = fixed(docs, scratch)
    model = fit(docs, labels, scratch)
    scored = differences(located(docs, scratch, "text"), model, ["_file", "_row"])
    return without(docs, scored.where("score >= 0.5"), scratch)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = fit(docs, read(spark, sf_dir, "labels"), Scratch(spark, "op9"))
    scored = differences(docs.select("doc_id", "text"), model, ["doc_id"])
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
