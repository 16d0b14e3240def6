"""The derived question table: sets per line and order, with rows and keys that are NULL or come twice."""

from pyspark.sql import functions as F

from tessera import constants as K
from tessera.sources import derived as D


def test_questions_from_lines(spark, tmp_path):
    lines = [(1, 20, 5, 1), (1, 3, 4, 1), (1, 3, 4, 1), (1, 16, 9, 2), (2, None, 5, 1), (3, 42, None, None), (None, 1, 4, 1)]
    tables = {
        "lineitem": (lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int"),
        "orders": ([(i, f"q{i}", "O") for i in (1, 2, 3, 4)], "o_orderkey long, o_orderpriority string, o_orderstatus string"),
        "supplier": ([(4, "four"), (5, "five")], "s_suppkey long, s_name string"),
    }
    for name, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    qa = D.qa(spark, str(tmp_path))
    assert "collect_set" not in qa._jdf.queryExecution().executedPlan().toString()
    got = {r["index"]: (r["img_name"], r["answer"], r["grid_coordinates"]) for r in qa.collect()}
    name = K.CLASS_NAMES.__getitem__
    assert got == {
        1: ("four", ", ".join(map(name, (3, 16, 20))), [["d1"], ["z9"]]),  # parts 20 and 3 are one cell
        2: ("five", "", [["z9"]]),
        3: (None, name(42), [["a3"]]),
        4: (None, None, []),
    }
    every = spark.range(17).select(F.lit(7).cast("long").alias("l_orderkey"), F.col("id").alias("l_partkey"), F.lit(4).cast("long").alias("l_suppkey"), F.lit(1).alias("l_linenumber"))
    every.write.mode("overwrite").parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(7, "q", "O")], tables["orders"][1]).write.mode("overwrite").parquet(f"{tmp_path}/orders.parquet")
    assert D.qa(spark, str(tmp_path)).first()["grid_coordinates"] == [sorted([*K.CELL_NAMES, "z9"])]
