from tessera.session import cut_lineage, ensure_checkpoint_dir, spread


def test_checkpoint_dir_is_kept_when_set(spark):
    first = ensure_checkpoint_dir(spark)
    assert first and ensure_checkpoint_dir(spark) == first


def test_cut_lineage_writes_a_table_in_the_checkpoint_folder(spark):
    df = spark.range(1000).selectExpr("id", "id * 2 AS v")
    out = cut_lineage(df, "t")
    assert sorted(out.collect()) == sorted(df.collect())
    folder = ensure_checkpoint_dir(spark).replace("file:", "").rstrip("/")
    files = out.inputFiles()
    assert files and all(folder + "/tables/t-" in f for f in files)


def test_spread_only_when_too_few_partitions(spark):
    par = spark.sparkContext.defaultParallelism
    one = spark.range(100).coalesce(1)
    assert spread(one).rdd.getNumPartitions() == par
    many = spark.range(0, 100, 1, par * 2)
    assert spread(many).rdd.getNumPartitions() == par * 2
