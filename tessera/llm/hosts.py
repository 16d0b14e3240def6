"""URL filters by empirical-Bayes host reputation.

Labelled page outcomes (good or bad) are counted per host, registered domain and suffix.  From
the top down, each level's rate is shrunk towards the level above by a beta prior whose mean is
the parent's posterior mean and whose strength is the beta-binomial moment estimate of that
level: the more alike the members of a level are, the stronger the prior.  A host without labels
has its domain's posterior, an unknown domain its suffix's, an unknown suffix the global one.  A
host is blocked if the upper bound of its rate of good pages (posterior mean plus ``z`` standard
deviations) is below ``least``, that is, if it is surely bad.

Explicit rules (host and path prefix) come first: a rule fits its host and all subdomains, and
the longest fitting rule decides.

Only DataFrame operations; rows per host are pre-aggregated, and a host with a third of all pages
meets its verdict in a join that Spark can split.

Defined cases: a null url, or one without "://", has an empty host and path, no rule, and the verdict of
the empty host like any other; suffixes are the last label, or the last two for those listed; a host
that is a suffix is its own registered domain; labels that are null are skipped, pages that
repeat count as often as they are there; empty tables give an empty result or the prior alone; other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower, read

#: Suffixes of two labels (fixed values); every other suffix is the last label.
SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "com.br", "com.cn", "co.in", "co.za")
#: Bound: ``z`` standard deviations, the least rate of good pages, and the range of prior strengths.
Z, LEAST, STRENGTH = 1.645, 0.5, (1.0, 1000.0)


@dataclass(frozen=True)
class Rule:
    host: str
    path: str
    verdict: str

    def __str__(self) -> str:
        return self.host + self.path


RULES = (
    Rule("net", "/", "block"), Rule("example.net", "/en/", "allow"), Rule("example.com", "/de/", "block"), Rule("org", "/fr/", "allow"),
)


# --- url parts ------------------------------------------------------------------------
def host_of(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return ascii_lower(F.coalesce(rest, F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def suffix_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), two).otherwise(F.substring_index(host, ".", -1))


def domain_of(host: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """One label more than the suffix."""
    two = F.substring_index(host, ".", -2)
    return F.when(two.isin(*suffixes), F.substring_index(host, ".", -3)).otherwise(two)


def rule_of(host: Column, path: Column, rules: tuple[Rule, ...] = RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits; longer rules are asked first."""
    rule = verdict = F.when(F.lit(False), "")
    for r in sorted(rules, key=lambda r: (-len(str(r)), str(r))):
        fits = ((host == r.host) | host.endswith(f".{r.host}")) & path.startswith(r.path)
        rule, verdict = rule.when(fits, str(r)), verdict.when(fits, r.verdict)
    return rule, verdict


# --- reputation -----------------------------------------------------------------------
def strength(counts: DataFrame, mean: Column) -> float:
    """How many pages the prior of a level is worth: the beta-binomial moment estimate.

    Members with n pages of which good vary around ``mean`` with variance mean (1 - mean) / n
    times 1 + (n - 1) / (strength + 1); solved for strength over all members with two or more pages.
    """
    spread = mean * (1 - mean)
    off = F.pow(F.col("good") / F.col("n") - mean, 2) * F.col("n")
    r = counts.where("n > 1").agg(F.sum(off - spread).alias("over"), F.sum(spread * (F.col("n") - 1)).alias("room")).first()
    lo, hi = STRENGTH
    if not r["room"] or r["over"] is None:
        return lo
    rho = r["over"] / r["room"]  # correlation of pages of one member
    return min(hi, max(lo, 1 / rho - 1)) if rho > 0 else hi


def reputation(outcomes: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame, tuple[float, float]]:
    """Posterior (a, b) of good pages per host, domain and suffix, and the global (a, b).

    ``outcomes``: host, good (0 or 1), a row per labelled page.
    """
    hosts = outcomes.groupBy("host").agg(F.sum("good").cast("double").alias("good"), F.count(F.lit(1)).cast("double").alias("n"))
    hosts = scratch.table(hosts.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    suffixes = domains.groupBy("suffix").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("good").alias("good"), F.sum("n").alias("n")).first()
    top = (1 + (total["good"] or 0.0), 1 + (total["n"] or 0.0) - (total["good"] or 0.0))  # uniform prior
    mean = top[0] / (top[0] + top[1])

    def posterior(counts: DataFrame, prior: Column, s: float) -> DataFrame:
        return counts.withColumns({"a": s * prior + F.col("good"), "b": s * (1 - prior) + F.col("n") - F.col("good")})

    s = strength(suffixes, F.lit(mean))
    by_suffix = scratch.table(posterior(suffixes, F.lit(mean), s), "by_suffix")
    parent = by_suffix.select("suffix", (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    own = domains.join(parent, "suffix")
    by_domain = scratch.table(posterior(own, F.col("up"), strength(own, F.col("up"))), "by_domain")
    parent = by_domain.select("domain", (F.col("a") / (F.col("a") + F.col("b"))).alias("up"))
    own = hosts.join(parent, "domain")
    by_host = scratch.table(posterior(own, F.col("up"), strength(own, F.col("up"))), "by_host")
    return by_host, by_domain, by_suffix, top


def upper(a: Column, b: Column) -> Column:
    """Mean plus Z standard deviations of a beta distribution."""
    n = a + b
    return a / n + Z * F.sqrt(a * b / (n * n * (n + 1)))


def judge(urls: DataFrame, outcomes: DataFrame, scratch: Scratch, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``urls`` (any columns and ``url``) with host, path, rule, bound and verdict."""
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    pages = urls.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumns({"rule": rule, "_ruled": ruled})
    by_host, by_domain, by_suffix, top = reputation(outcomes, scratch)
    bound = lambda df, key, out: df.select(F.col(key).alias(f"_{out}"), upper(F.col("a"), F.col("b")).alias(out))
    known = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    known = known.withColumns({"domain": domain_of(F.col("host")), "suffix": suffix_of(F.col("host"))})
    for df, key, out in ((by_host, "host", "h"), (by_domain, "domain", "d"), (by_suffix, "suffix", "s")):
        known = known.join(bound(df, key, out), F.col(key) == F.col(f"_{out}"), "left")
    top_bound = upper(F.lit(float(top[0])), F.lit(float(top[1])))
    known = known.select(F.col("host").alias("_host"), F.coalesce("h", "d", "s", top_bound).alias("bound"))
    known = scratch.table(known, "bounds")
    method = F.when(F.col("bound") < LEAST, "block").otherwise("allow")
    judged = pages.join(known, F.col("host") == F.col("_host")).withColumn("verdict", F.coalesce("_ruled", method))
    return judged.drop("_host", "_ruled")


def op6_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page outcomes are the quality labels of the same id."""
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    labels = read(spark, sf_dir, "labels").where("quality IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.max("quality").alias("good"))
    outcomes = pages.join(labels, F.col("page_id") == F.col("id")).select(host_of(F.col("url")).alias("host"), "good")
    judged = judge(pages, outcomes, Scratch(spark, "op6"))
    return judged.select("page_id", "host", "path", "rule", "verdict")


_TWO = ", ".join(f"'{s}'" for s in SUFFIXES)
_HOST = "translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LAST = "array_to_string(list_slice(string_split(host, '.'), -{0}, -1), '.')"
_SUFFIX = f"CASE WHEN {_LAST.format(2)} IN ({_TWO}) THEN {_LAST.format(2)} ELSE {_LAST.format(1)} END"
_DOMAIN = f"CASE WHEN {_LAST.format(2)} IN ({_TWO}) THEN {_LAST.format(3)} ELSE {_LAST.format(2)} END"
_STRENGTH = (
    f"SELECT CASE WHEN room IS NULL OR room = 0 THEN {STRENGTH[0]} WHEN over_ / room > 0 "
    f"THEN least({STRENGTH[1]}, greatest({STRENGTH[0]}, room / over_ - 1)) ELSE {STRENGTH[1]} END AS k FROM "
    "(SELECT sum(n * pow(good / n - up, 2) - up * (1 - up)) AS over_, sum(up * (1 - up) * (n - 1)) AS room FROM {0} WHERE n > 1)"
)
_UPPER = f"a / (a + b) + {Z} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))"
OP6_SQL = f"""
WITH p AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
     l AS (SELECT doc_id, max(quality) AS good FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
     h AS (SELECT *, {_SUFFIX} AS suffix, {_DOMAIN} AS domain FROM (
             SELECT host, CAST(sum(good) AS DOUBLE) AS good, CAST(count(*) AS DOUBLE) AS n FROM p JOIN l ON page_id = doc_id GROUP BY host)),
     d AS (SELECT domain, suffix, sum(good) AS good, sum(n) AS n FROM h GROUP BY domain, suffix),
     s AS (SELECT suffix, sum(good) AS good, sum(n) AS n FROM d GROUP BY suffix),
     g AS (SELECT 1 + coalesce(sum(good), 0) AS a, 1 + coalesce(sum(n) - sum(good), 0) AS b FROM h),
     s1 AS (SELECT s.*, a / (a + b) AS up FROM s, g), sk AS ({_STRENGTH.format("s1")}),
     sp AS (SELECT suffix, k * up + good AS a, k * (1 - up) + n - good AS b FROM s1, sk),
     d1 AS (SELECT d.*, a / (a + b) AS up FROM d JOIN sp USING (suffix)), dk AS ({_STRENGTH.format("d1")}),
     dp AS (SELECT domain, k * up + good AS a, k * (1 - up) + n - good AS b FROM d1, dk),
     h1 AS (SELECT h.*, dp.a / (dp.a + dp.b) AS up FROM h JOIN dp USING (domain)), hk AS ({_STRENGTH.format("h1")}),
     hp AS (SELECT host, k * up + good AS a, k * (1 - up) + n - good AS b FROM h1, hk),
     b AS (SELECT host, coalesce(hb, db, sb, gb) AS bound FROM (SELECT DISTINCT host, {_SUFFIX} AS suffix, {_DOMAIN} AS domain FROM p)
           LEFT JOIN (SELECT host, {_UPPER} AS hb FROM hp) USING (host) LEFT JOIN (SELECT domain, {_UPPER} AS db FROM dp) USING (domain)
           LEFT JOIN (SELECT suffix, {_UPPER} AS sb FROM sp) USING (suffix), (SELECT {_UPPER} AS gb FROM g)),
     r AS (SELECT *, CASE {" ".join(f"WHEN (host = '{r.host}' OR host LIKE '%.{r.host}') AND starts_with(path, '{r.path}') THEN '{r}'" for r in sorted(RULES, key=lambda r: -len(str(r))))} END AS rule
           FROM p)
SELECT page_id, host, path, rule, CASE {" ".join(f"WHEN rule = '{r}' THEN '{r.verdict}'" for r in RULES)}
       WHEN bound < {LEAST} THEN 'block' ELSE 'allow' END AS verdict
FROM r JOIN b USING (host)
"""
