"""Line dedup by a log-template tree.

Lines are parsed as log messages are: a tree of fixed depth sorts them by their number of tokens
and then by their first ``DEPTH`` tokens, in which tokens with digits count as variable.  In a
leaf, a token is constant where at least ``MIN_DOCS`` lines, and a share of ``SHARE`` of the leaf's, have it at the same place; else it is
a variable field.  The constants in their places are the line's template.  What the tree compared can't be evidence, so
only the tokens after the leading ones count: a template of which ``CONSTANT`` or more of those are constant,
found in at least ``MIN_DOCS`` documents, is recurring.  A line of no more than ``DEPTH`` tokens has none after them: all its tokens must be constant, that is, the
whole line recurs unchanged.  That holds for any line, digits or not: word for word in
``MIN_DOCS`` documents, or in two if it has at least ``LONG`` tokens.  Recurring lines are dropped from every document.

Only DataFrame operations.  Places are counted by 64-bit keys of (leaf, place, token), and lines by 128-bit digests: neither text nor
tokens are shuffled.  Leaves with too few lines are left out first, and a line's constants are added up in the task
that reads it.  Nothing is collected but the line numbers of one document.

Defined cases: a null text is one empty line; lines without tokens are always kept; lines are
separated by line feeds, tokens by ASCII white space; several equal lines of a document count as one
document; ids that repeat are documents of their own; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, Scratch, fixed, located, met, places, read

DEPTH, MIN_DOCS, CONSTANT, SHARE, LONG = 3, 6, 0.6, 0.05, 50
ANY = "<*>"


def tokens_of(line: Column) -> Column:
    return F.regexp_extract_all(line, F.lit(r"([^\x20\x09-\x0D]+)"), 1)


def masked(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), ANY).otherwise(t))


def lines_of(rows: DataFrame) -> DataFrame:
    """A row per line that has tokens: its document's place, number, tokens, their number and its leaf (a 64-bit key)."""
    lines = rows.select("_file", "_row", F.posexplode_outer(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line_no", "line"))
    # the generator makes the tokens a column that later expressions refer to: they are found once
    lines = lines.select("_file", "_row", "line_no", F.explode(F.array(tokens_of(F.col("line")))).alias("tokens"))
    lead = F.array_join(masked(F.slice("tokens", 1, DEPTH)), " ")
    n = F.size("tokens")
    return lines.select("*", n.alias("n_tokens"), F.xxhash64(n, lead).alias("leaf")).where("n_tokens > 0")


def recurring_lines(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """(_file, _row, line_no) of every line that recurs across documents, whole or by its template."""
    lines = lines_of(located(docs, scratch, "text"))
    at = ["_file", "_row", "line_no"]
    digest = F.unhex(F.md5(F.array_join("tokens", " "))).alias("digest")
    spots = scratch.table(lines.select(*at, "n_tokens", "leaf", digest), "spots")

    # whole lines: a document's equal lines meet in the task that reads them
    each = spots.select("digest", "n_tokens", "_file", "_row").distinct()
    counted = each.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("n_tokens").alias("n_tokens"))
    whole = scratch.table(counted.where((F.col("docs") >= min_docs) | ((F.col("n_tokens") >= LONG) & (F.col("docs") >= 2))).select("digest"), "whole")
    unchanged = met(spots, whole, "digest", "left_semi", 96).select(*at)

    # templates: constant places by their keys
    beyond = F.col("n_tokens") > DEPTH
    full = spots.where(beyond).groupBy("leaf").agg(F.count(F.lit(1)).alias("lines")).where(F.col("lines") >= min_docs)
    full = scratch.table(full, "leaves")
    later = F.slice("tokens", DEPTH + 1, F.col("n_tokens"))
    keys = F.transform(later, lambda t, i: F.when(~t.rlike("[0-9]"), F.xxhash64("leaf", i, t)))  # variable: null
    held = met(lines.where(beyond), full, "leaf", "inner", 64).select(*at, "n_tokens", "leaf", "lines", keys.alias("keys"))
    held = scratch.table(held, "held")
    spelled = held.select(*at, "n_tokens", "leaf", "lines", F.explode_outer("keys").alias("key")).where(F.col("key").isNotNull())
    constant = spelled.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("lines").alias("lines"))
    constant = constant.where((F.col("n") >= min_docs) & (F.col("n") >= SHARE * F.col("lines"))).select("key")
    constant = scratch.table(constant, "constant")
    # the constants of a line as a set: two sums without carry of hashes of their keys
    parsed = met(spelled, constant, "key", "left_semi", 64).groupBy(*at, "n_tokens", "leaf").agg(
        F.count(F.lit(1)).alias("constants"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("one"), F.bit_xor(F.xxhash64("key", F.lit(2))).alias("two")
    )
    template = ["leaf", "one", "two"]
    parsed = scratch.table(parsed.where(F.col("constants") >= CONSTANT * (F.col("n_tokens") - DEPTH)).select(*at, *template), "parsed")
    seen = parsed.select(*template, "_file", "_row").distinct().groupBy(*template).agg(F.count(F.lit(1)).alias("docs"))
    seen = scratch.table(seen.where(F.col("docs") >= min_docs).select(F.struct(*template).alias("template")), "seen")
    alike = met(parsed.select(*at, F.struct(*template).alias("template")), seen, "template", "left_semi", 96).select(*at)
    return unchanged.unionByName(alike).distinct()


def drop_recurring(docs: DataFrame, scratch: Scratch, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, text without its recurring lines, n_lines, n_dropped."""
    docs = fixed(docs, scratch)
    gone = recurring_lines(docs, scratch, min_docs).groupBy(F.col("_file").alias("_f"), F.col("_row").alias("_r"))
    gone = scratch.table(gone.agg(F.collect_list("line_no").alias("gone")), "gone")  # no more than the document's lines
    size = gone.agg(F.sum(256 + 4 * F.size("gone"))).first()[0] or 0
    gone = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    rows = places(docs, "doc_id", "text").withColumn("lines", F.split(F.coalesce("text", F.lit("")), "\n"))
    rows = rows.join(gone, (F.col("_file") == F.col("_f")) & (F.col("_row") == F.col("_r")), "left")
    kept = F.filter("lines", lambda _, i: ~F.array_contains("gone", i))
    text = F.when(F.col("gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    dropped = F.coalesce(F.array_size("gone"), F.lit(0)).cast("bigint").alias("n_dropped")
    return rows.select("doc_id", text.alias("text"), F.size("lines").cast("bigint").alias("n_lines"), dropped)


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = drop_recurring(read(spark, sf_dir, "documents"), Scratch(spark, "op3"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


OP3_SQL = rf"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no FROM documents),
     x AS (SELECT doc_id, line_no, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS raw FROM l),
     t AS (SELECT doc_id, line_no, array_to_string(raw, ' ') AS whole, len(raw) AS n,
                  list_transform(raw, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '{ANY}' ELSE x END) AS w FROM x WHERE len(raw) > 0),
     u AS (SELECT whole FROM t GROUP BY whole, n HAVING count(DISTINCT doc_id) >= {MIN_DOCS} OR (n >= {LONG} AND count(DISTINCT doc_id) >= 2)),
     h AS (SELECT doc_id, line_no, w, n, array_to_string(w[1:{DEPTH}], ' ') AS front, count(*) OVER (PARTITION BY n, array_to_string(w[1:{DEPTH}], ' ')) AS leaf_lines
           FROM t WHERE n > {DEPTH}),
     s AS (SELECT doc_id, line_no, n, front, leaf_lines, unnest(w[{DEPTH} + 1:]) AS token, generate_subscripts(w[{DEPTH} + 1:], 1) AS place FROM h),
     c AS (SELECT n, front, place, token FROM s WHERE token <> '{ANY}' GROUP BY n, front, place, token, leaf_lines HAVING count(*) >= {MIN_DOCS} AND count(*) >= {SHARE} * leaf_lines),
     p AS (SELECT doc_id, line_no, n, front, count(c.token) AS constants, string_agg(coalesce(c.token, '{ANY}'), ' ' ORDER BY place) AS template
           FROM s LEFT JOIN c USING (n, front, place, token) GROUP BY doc_id, line_no, n, front),
     q AS (SELECT * FROM p WHERE constants >= {CONSTANT} * (n - {DEPTH})),
     r AS (SELECT n, front, template FROM q GROUP BY ALL HAVING count(DISTINCT doc_id) >= {MIN_DOCS}),
     g AS (SELECT doc_id, line_no FROM q JOIN r USING (n, front, template) UNION SELECT doc_id, line_no FROM t JOIN u USING (whole))
SELECT doc_id, count(*) AS n_lines, count(g.line_no) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE g.line_no IS NULL), '')) AS text_sha256
FROM l LEFT JOIN g USING (doc_id, line_no) GROUP BY doc_id
"""
