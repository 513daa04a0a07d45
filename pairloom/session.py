"""Session settings and the shared folder for stage tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "*", app: str = "pairloom") -> SparkSession:
    """A session for tests and benches on one machine."""
    return (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def stage_root(spark: SparkSession) -> str:
    """Folder for stage tables: the cluster's ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder of its own; a
    cluster has to name a folder that every executor can reach.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/pairloom-{spark.sparkContext.applicationId}"
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="spark-pairloom-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder}/pairloom-{spark.sparkContext.applicationId}"


def remove_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of stage tables in whatever file system holds it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def stage_table(df: DataFrame, name: str, partition_by: tuple = (), root: str | None = None) -> DataFrame:
    """Write ``df`` as a Parquet stage table and read it back.

    This is the lineage cut between research stages: a lost executor re-reads
    files instead of recomputing every earlier stage, later filters and column
    lists reach the Parquet scan, and the optimizer sees real sizes.
    """
    spark = df.sparkSession
    path = f"{root or stage_root(spark)}/{name}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
