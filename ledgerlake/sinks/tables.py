"""Table sinks and maintenance (K1–K8) as Parquet/CSV writes.

The reference keeps a SQLite file with four tables; here each table is a Parquet dataset. Row
level "delete then insert" becomes dynamic partition overwrite: only partitions present in the
new data are replaced, everything else is untouched.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.session import checkpoint_dir, cut_lineage

ACCOUNT_BUCKETS = 64   # account_id → bucket directory (no directory per account at scale)

# K8: table definitions (the SQL schema of the reference, as Spark types + partitioning).
TRANSACTIONS_SCHEMA = T.StructType([
    T.StructField("txn_id", T.LongType()), T.StructField("account_id", T.StringType()),
    T.StructField("date", T.DateType()), T.StructField("description", T.StringType()),
    T.StructField("amount", T.DoubleType()), T.StructField("currency", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("category", T.StringType()),
    T.StructField("confidence_score", T.DoubleType()), T.StructField("file_hash", T.StringType()),
    T.StructField("created_at", T.TimestampType())])
SESSIONS_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("settings", T.StringType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("last_active", T.TimestampType())])
ANALYSIS_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("analysis_type", T.StringType()),
    T.StructField("results", T.StringType()), T.StructField("created_at", T.TimestampType())])
CUSTOM_CATEGORY_SCHEMA = T.StructType([
    T.StructField("session_id", T.StringType()), T.StructField("category_name", T.StringType()),
    T.StructField("keywords", T.StringType()), T.StructField("emoji", T.StringType()),
    T.StructField("created_at", T.TimestampType())])
PARTITIONING = {"transactions": ["account_bucket"], "analysis_results": ["created_date"]}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (never machine-local)."""
    return os.path.join(checkpoint_dir(spark), "ledgerlake", f"{name}-{uuid.uuid4().hex[:12]}")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def export_csv(df: DataFrame, path: str) -> str:
    """K1: header CSV directory (one file per task; no single-writer bottleneck)."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def save_converted_csv(df: DataFrame, source_path: str, target: str) -> str:
    """K2: ``<stem>_converted_to_<CUR>`` next to the source."""
    stem = os.path.splitext(source_path.rstrip("/"))[0]
    return export_csv(df, f"{stem}_converted_to_{target}")


def with_account_bucket(df: DataFrame, buckets: int = ACCOUNT_BUCKETS) -> DataFrame:
    return df.withColumn("account_bucket", F.pmod(F.xxhash64(F.col("account_id").cast("string")), F.lit(buckets)))


def save_transactions(df: DataFrame, path: str, buckets: int = ACCOUNT_BUCKETS) -> None:
    """Replace the rows of every (account, file_hash) present in ``df``.

    The table is partitioned by ``account_bucket`` only (a bounded number of directories —
    one directory per file hash would explode with the number of uploads). Replacing means:
    read the touched buckets (a literal list, at most ``buckets`` numbers, so the scan prunes), drop
    the (account, file_hash) pairs being replaced (anti-join), add the new rows, cut the
    lineage in the shared checkpoint folder (we overwrite what we read) and overwrite only the
    touched buckets (dynamic partition overwrite). Untouched buckets are never rewritten.
    """
    spark = df.sparkSession
    new = with_account_bucket(df, buckets)
    if _exists(spark, path):
        old = spark.read.parquet(path)
        keys = new.select("account_id", "file_hash").distinct()
        touched = [r[0] for r in new.select("account_bucket").distinct().collect()]
        keep = old.filter(F.col("account_bucket").isin(touched)).join(keys, ["account_id", "file_hash"], "left_anti")
        new = cut_lineage(keep.unionByName(new.select(*keep.columns)))
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("account_bucket").parquet(path))


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """K4: INSERT OR REPLACE on ``key`` = rows of old without a new version, plus new."""
    return old.join(new.select(*key), key, "left_anti").unionByName(new)


def save_analysis_result(results: DataFrame, path: str, analysis_type: str, session_col: str = "account_id",
                         created_at=None) -> None:
    """K5: one JSON document per session (``to_json(struct(*))``), appended, partitioned by day."""
    ts = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    payload = [c for c in results.columns if c != session_col]
    out = results.select(F.col(session_col).cast("string").alias("session_id"),
                         F.lit(analysis_type).alias("analysis_type"),
                         F.to_json(F.struct(*payload)).alias("results"), ts.alias("created_at"))
    out.withColumn("created_date", F.to_date("created_at")).write.mode("append") \
       .partitionBy("created_date").parquet(path)


def custom_category_rows(df: DataFrame) -> DataFrame:
    """(session_id, category_name, keywords ARRAY) → stored rows with JSON keywords."""
    return df.select(F.col("session_id").cast("string"), "category_name",
                     F.to_json(F.col("keywords")).alias("keywords"),
                     F.coalesce(F.col("emoji") if "emoji" in df.columns else F.lit(None), F.lit("📝")).alias("emoji"),
                     F.current_timestamp().alias("created_at"))


def read_custom_categories(df: DataFrame) -> DataFrame:
    """Decode the JSON keyword list."""
    return df.withColumn("keywords", F.from_json(F.col("keywords"), "array<string>"))


def retention_filter(df: DataFrame, as_of: str, days_old: int = 30, ts_col: str = "created_at") -> DataFrame:
    """K7: rows newer than ``as_of − days_old`` (the rows a cleanup would keep)."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days_old)
    return df.filter(F.col(ts_col) >= cutoff.cast("timestamp"))


def orphans(child: DataFrame, parent: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``child`` whose ``key`` has no row in ``parent`` (declared foreign key)."""
    return child.join(parent.select(*key).distinct(), key, "left_anti")


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """K8: the columns of a table definition, cast; missing ones null, others left out."""
    return df.select([(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema])


def append_custom_categories(df: DataFrame, path: str) -> None:
    """K6: store user categories under the declared schema."""
    typed(custom_category_rows(df), CUSTOM_CATEGORY_SCHEMA).write.mode("append").parquet(path)


def apply_retention(spark: SparkSession, paths: list[str], as_of: str, days_old: int = 30, ts_col: str = "created_at",
                    partition: dict[str, str] | None = None) -> None:
    """K7: rewrite each table with the rows that ``retention_filter`` keeps.

    What stays is written to the shared scratch folder first, then over the table, so a failure
    leaves either the old or the new rows on disk."""
    for path in paths:
        old = spark.read.parquet(path)
        kept = scratch_path(spark, "retention")
        retention_filter(old, as_of, days_old, ts_col).write.parquet(kept)
        writer = spark.read.schema(old.schema).parquet(kept).write.mode("overwrite").option("partitionOverwriteMode", "static")
        by = (partition or {}).get(path)
        (writer.partitionBy(by) if by else writer).parquet(path)
