"""SparkSession construction and cluster-safe helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession

# Settings every job relies on: UTC dates, ANSI mode with try_* functions, AQE for skew.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "ledgerlake") -> SparkSession:
    """Build (or reuse) a session. On a cluster ``master`` stays None and the launcher decides."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.ui.showConsoleProgress", "false")
        builder = builder.config("spark.driver.memory", os.environ.get("LEDGERLAKE_DRIVER_MEM", "16g"))
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    apply_conf(spark)
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def apply_conf(spark: SparkSession) -> None:
    """Session-level settings that queries rely on (idempotent, safe on a shared session)."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")


def checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only when the session names none: an explicit ``fallback`` (tests), else a temporary folder for
    a local master, which shares it with itself; a cluster without the setting is an error. The
    choice is registered as the context's checkpoint directory.
    """
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not d:
        master = spark.sparkContext.master
        if not fallback and master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        d = fallback or tempfile.mkdtemp(prefix="ledgerlake-")
        spark.sparkContext.setCheckpointDir(d)
    if d.startswith("file:"):
        d = d[len("file:"):]
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the cluster's checkpoint folder (survives executor loss)."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def keep_where(df: DataFrame, cond) -> DataFrame:
    """``df.filter(cond)`` that is evaluated where it is written.

    Catalyst pushes a filter below projections by substituting the aliases it references. When
    those aliases are large parsing/cleaning expressions that are referenced several times,
    the substitution multiplies them (plans of megabytes, code past the 64 KB method limit).
    Wrapping the condition with an always-true nondeterministic test (``spark_partition_id() >=
    0``) stops that pushdown only; it does not change which rows are kept. Filter raw input
    (accounts, files, dates) *before* heavy projections so that pruning still reaches the scan.
    """
    from pyspark.sql import functions as F
    flag = "_keep_where"
    return (df.withColumn(flag, F.when(F.spark_partition_id() >= 0, cond))
              .filter(F.col(flag)).drop(flag))
