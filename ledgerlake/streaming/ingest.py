"""Structured Streaming jobs (X1–X3, re-aimed: the reference has no streaming operator).

X1  statement ingest: a directory of CSV drops → the same parse / validate operators as batch →
    ``foreachBatch`` replace-by-file-hash save (K3). The stream checkpoint makes each file count
    exactly once across restarts and executor loss.
X2  duplicate suppression: ``dropDuplicatesWithinWatermark`` on the event / row key.
X3  running daily spend per account: event-time windows with a watermark; every micro-batch's
    updated windows are appended to a changelog table, readers take the newest version per key
    (``max_by`` over the batch id) — an idempotent sink that survives re-execution of a batch.
    Budget-style alerts for the batch are written next to it.
Checkpoints live under the cluster's shared ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.operators import statements as ST
from ledgerlake.operators import upload as U
from ledgerlake.session import checkpoint_dir, cut_lineage
from ledgerlake.sinks import tables as K
from ledgerlake.sinks import versions as V
from ledgerlake.sources import statements as SRC

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()),
    T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])
RAW_STATEMENT_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in
                                     ("date", "description", "amount", "type", "category")])


def _ckpt(spark: SparkSession, name: str) -> str:
    return os.path.join(checkpoint_dir(spark), "ledgerlake-streams", name)


# ---- X1 --------------------------------------------------------------------------------

def ingest_statements(spark: SparkSession, source_dir: str, table_path: str, as_of: str,
                      name: str = "statement_ingest", max_files_per_trigger: int = 1000):
    """Start the ingest stream (trigger availableNow: process what is there, then stop).
    Each file's rows are keyed by their content (``file_hash`` over the hashes and the number of
    its rows), so the same statement under another name replaces its rows instead of adding
    them. Quarantined rows go to a folder of the batch, which a replayed batch overwrites."""
    raw = (spark.readStream.schema(RAW_STATEMENT_SCHEMA).option("header", True)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir)
           .withColumn("source_file", F.col("_metadata.file_path"))
           .withColumn("account_id", F.regexp_extract(F.col("source_file"), r"account=([^/]+)", 1)))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        cells = F.xxhash64(*RAW_STATEMENT_SCHEMA.names)
        files = batch.groupBy("account_id", "source_file").agg(F.sha2(F.concat_ws(
            "|", F.bit_xor(cells), F.sum(cells.cast("decimal(38,0)")), F.count(F.lit(1))), 256).alias("file_hash"))
        # of equal files of a batch one counts
        files = files.groupBy("account_id", "file_hash").agg(F.min("source_file").alias("source_file"))
        parsed = ST.parse_statements(batch.join(files, ["account_id", "source_file"]), as_of).persist()   # split reads it twice
        good, bad = ST.split(parsed)
        out = (good.withColumn("txn_id", F.xxhash64("source_file", "date", "description", "amount"))
                   .withColumn("created_at", F.current_timestamp()))
        K.save_transactions(out, table_path)
        bad.write.mode("overwrite").parquet(f"{table_path}_quarantine/batch_id={batch_id}")
        parsed.unpersist()

    return (raw.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


UPLOAD_SCHEMA = T.StructType([T.StructField("txn_id", T.LongType()), T.StructField("account_id", T.StringType()), *RAW_STATEMENT_SCHEMA.fields])


def ingest_uploads(spark: SparkSession, source_dir: str, table_path: str, as_of: str, model=None, custom: DataFrame | None = None,
                   name: str = "upload_ingest", max_files_per_trigger: int = 1000, sep: str = ","):
    """Dropped files through the whole upload chain (``upload.process``: parse, recover, categorise,
    own categories) into the versioned table at ``table_path``; lost rows go to ``<table>_quarantine``.

    A file's rows are keyed by its content, and saving replaces the rows of its key. So a batch that
    is run again after a crash, or the same file under another name, changes nothing."""
    raw = (spark.readStream.schema(UPLOAD_SCHEMA).option("header", True).option("sep", sep).option("escape", '"').option("multiLine", False)
           .option("maxFilesPerTrigger", max_files_per_trigger).csv(source_dir)
           .withColumn("source_file", F.col("_metadata.file_path")))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()   # hashed, then processed
        try:
            files = SRC.duplicate_files(rows.select("source_file", F.to_json(F.struct(*UPLOAD_SCHEMA.names)).alias("line")))
            kept = SRC.with_files(rows, files.filter("kept").select("source_file", "file_hash"))   # one row a file
            good, lost = U.process(kept, as_of, model, custom)
            # saving reads the rows several times: the chain runs once
            V.replace(cut_lineage(good.withColumn("created_at", F.current_timestamp())), table_path)
            lost.write.mode("overwrite").parquet(f"{table_path}_quarantine/batch_id={batch_id}")
        finally:
            rows.unpersist()

    return (raw.writeStream.foreachBatch(write_batch)
            .option("checkpointLocation", _ckpt(spark, name)).trigger(availableNow=True).start())


# ---- X2 / X3 ---------------------------------------------------------------------------

def event_stream(spark: SparkSession, directory: str, glob: str = "events*.parquet",
                 max_files_per_trigger: int = 100) -> DataFrame:
    """Events as a stream of signed transactions (purchase = expense, signup = income); the
    source watches ``directory`` for files matching ``glob``."""
    e = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
         .option("pathGlobFilter", glob).parquet(directory))
    return (e.filter(F.col("event_type").isin("purchase", "signup"))
             .withWatermark("ts", "1 day")
             .dropDuplicatesWithinWatermark(["event_id"])           # X2
             .select(F.col("event_id").alias("txn_id"), F.col("user_id").alias("account_id"), "ts",
                     F.when(F.col("event_type") == "purchase", -F.col("value")).otherwise(F.col("value")).alias("amount")))


def daily_spend(events: DataFrame) -> DataFrame:
    """Per (account, 1-day event-time window) expense, income and count."""
    a = F.col("amount")
    m = a.cast("decimal(18,2)")
    return (events.groupBy("account_id", F.window("ts", "1 day").alias("w"))
            .agg(F.sum(F.when(a < 0, -m)).cast("double").alias("spend"),
                 F.sum(F.when(a > 0, m)).cast("double").alias("income"),
                 F.count(F.lit(1)).alias("n"))
            .select("account_id", F.date_format(F.col("w.start"), "yyyy-MM-dd").alias("day"),
                    F.coalesce("spend", F.lit(0.0)).alias("spend"),
                    F.coalesce("income", F.lit(0.0)).alias("income"), "n"))


def run_daily_spend(spark: SparkSession, events_dir: str, out_path: str, alert_threshold: float = 500.0,
                    name: str = "daily_spend", glob: str = "events*.parquet"):
    """Run X2+X3 with trigger availableNow; returns the finished query handle."""
    agg = daily_spend(event_stream(spark, events_dir, glob))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        b = batch.withColumn("batch_id", F.lit(batch_id)).persist()   # read twice below
        try:
            # a folder per batch: a replayed batch overwrites what it wrote
            b.drop("batch_id").write.mode("overwrite").parquet(f"{out_path}/changelog/batch_id={batch_id}")
            (b.filter(F.col("spend") > alert_threshold)
              .select("account_id", "day", "spend", F.lit("high").alias("severity"))
              .write.mode("overwrite").parquet(f"{out_path}/alerts/batch_id={batch_id}"))
        finally:
            b.unpersist()

    q = (agg.writeStream.outputMode("update").foreachBatch(write_batch)
         .option("checkpointLocation", _ckpt(spark, name + "-" + os.path.basename(out_path.rstrip("/"))))
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def latest_daily_spend(spark: SparkSession, out_path: str) -> DataFrame:
    """Current value per (account, day): the row of the newest batch (changelog read)."""
    c = spark.read.parquet(out_path + "/changelog")
    newest = F.struct("batch_id")
    return (c.groupBy("account_id", "day")
             .agg(F.max_by("spend", newest).alias("spend"), F.max_by("income", newest).alias("income"),
                  F.max_by("n", newest).alias("n")))
