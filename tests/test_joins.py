"""Hot and cold keys: bucketed sides stay where they are, uniqueness by keys alone."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import encode as E
from tessera.operators.joins import ensure_unique, skew_join


@pytest.fixture
def bucketed(spark):
    qa = spark.range(4000).select("id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("i"), F.col("id") % 50)).alias("img_name"))
    context = spark.createDataFrame([("hot", "t")] + [(f"i{k}", f"t{k}") for k in range(40)], "img_name string, text string")
    for df, name in ((qa, "qa_b"), (context, "context_b")):
        df.write.mode("overwrite").bucketBy(8, "img_name").saveAsTable(name)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield spark.table("qa_b"), spark.table("context_b")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    spark.sql("DROP TABLE qa_b")
    spark.sql("DROP TABLE context_b")


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for x in re.findall(r"(?<!Broadcast)Exchange [^\n]*", plan) if "BroadcastExchange" not in x]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_bucketed_sides_are_not_shuffled(bucketed, how):
    qa, context = bucketed
    plain = skew_join(qa, context, "img_name", how)
    assert exchanges(plain) == []  # no hot key: the plain bucketed join
    split = skew_join(qa, context, "img_name", how, hot_rows=500)
    moved = exchanges(split)
    assert moved and all("_salt" in x for x in moved)  # only hot rows move
    want = sorted(qa.join(context, "img_name", how).collect(), key=repr)
    assert sorted(plain.collect(), key=repr) == want == sorted(split.collect(), key=repr)


def test_hot_rows_spread_over_tasks(spark):
    big = spark.range(0, 3000, 1, 6).select("id", F.lit("h").alias("k"))
    small = spark.createDataFrame([("h", 1), ("h", 2)], "k string, v int")
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        out = skew_join(big, small, "k", hot_rows=300)
        assert out.count() == 6000 and out.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_unique_keys_pass_and_repeated_ones_fail(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    assert ensure_unique(df, "k").count() == 3
    for again in (2, None):
        with pytest.raises(ValueError, match="duplicate k: " + ("NULL" if again is None else "2")):
            ensure_unique(df.unionByName(spark.createDataFrame([(again, "d")], "k int, v string")), "k")


def test_array_ids_do_not_depend_on_the_way(spark):
    """Empty arrays, NULL arrays and places, tokens with spaces: one answer for every ``max_tokens``."""
    df = spark.createDataFrame([(1, []), (2, ["a", None, "b"]), (3, ["x y"]), (4, None), (5, ["a", "zz"])], "k int, v array<string>")
    vocab = spark.createDataFrame([("a", 10), ("b", 11), ("x y", 12), ("x", 13)], "token string, id int")
    want = {1: [], 2: [10, E.UNK, 11], 3: [12], 4: [], 5: [10, E.UNK]}
    for most in (0, 1, 100):
        assert {r["k"]: r["ids"] for r in E.array_ids(df, "v", "k", vocab, max_tokens=most).collect()} == want
