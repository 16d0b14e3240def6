"""Session helpers: builder defaults and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings a job of this package wants on any cluster.  Shuffle width is left to the
# cluster (or AQE), except in local sessions where 200 tiny tasks only cost overhead.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "tessera") -> SparkSession:
    """A local session for tests and benchmarks (never used on a cluster)."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    b = (
        b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", os.environ.get("TESSERA_DRIVER_MEMORY", "8g"))
        .config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="tessera-wh-"))
    )
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the session's checkpoint folder; create a local one only if none is set.

    On a cluster ``spark.checkpoint.dir`` names a shared folder and is used as is.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # sessions without a local SparkContext (Spark Connect)
        current = spark.conf.get("spark.checkpoint.dir", None)
        if not current:
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        return current
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a shared folder before running on a cluster")
    path = tempfile.mkdtemp(prefix="tessera-ckpt-")  # local sessions (tests) only
    sc.setCheckpointDir(path)
    return path


def cut_lineage(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as a parquet table in the shared checkpoint folder and read it back.

    Cuts the lineage (later stages read files, so a lost executor does not recompute
    the input) with the vectorised parquet writer and reader; an RDD checkpoint would
    Java-serialise every row.  Partitioning and row order are not kept.  With ``partition_by`` the
    rows of each value lie in files of their own.  The table is deleted when the driver ends.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"
    if hasattr(spark, "_jvm"):  # not under Spark Connect
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    write = df.write.mode("error")
    (write.partitionBy(partition_by) if partition_by else write).parquet(path)
    return spread(spark.read.schema(df.schema).parquet(path))


def spread(df: DataFrame) -> DataFrame:
    """Deals ``df`` out to all cores if it has fewer partitions than the cluster has cores.

    Small inputs (one file, one row group) scan as a single task, and per-row work in
    that stage would run on one core.  Large inputs already have many splits, so this
    adds no shuffle where the data is big.  Rows go round, not by key: a hot key's rows
    spread like any others.
    """
    target = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= target else df.repartition(target)
