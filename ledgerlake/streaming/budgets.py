"""Monthly category spend on a running stream, with an alert at each crossing.

Uploads bring the same rows again, under the same or another file name: rows are told apart by
their own hash, and a repeated one is dropped within the watermark's delay, in state that is dealt by row. Each
batch sums its new rows by account, month and category and merges the sums with the open months that the
batch before it left: spend, count and alert level, as a table dealt by the same key. Both steps are
ordinary aggregates, so no account is visited one by one.
An alert is emitted once, by the batch in which the month's spend crosses a limit; a month is
closed, with its total, when the watermark has passed its end. Rows older than the watermark come
too late: Spark leaves them out, and :func:`late_rows` tells how many a run has left out.

Every batch writes folders of its own, which a replayed batch overwrites, and reads those of the batch
before it: a stream killed between its output and its checkpoint leaves each alert once.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.dims import BUDGET_SHARES
from ledgerlake.streaming.ingest import _ckpt

#: Shares of the recommended amount above which spending is reported.
LEVELS = [("medium", 1.2), ("high", 1.5)]
ROWS = "txn_id long, account_id long, date date, description string, amount double, category string"
HELD = "account_id long, month long, category string, cents long, n long, before int, level int, closed boolean"
OUT = "account_id long, month string, category string, kind string, spend double, n long"


def row_hash() -> Column:
    """What makes a statement row the same row, whatever file brings it."""
    return F.xxhash64("account_id", "txn_id", "date", "description", "amount", "category")


def uploads(spark: SparkSession, directory: str, delay: str, files: int) -> DataFrame:
    """Rows of dropped files as a stream, each once."""
    rows = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", files).option("recursiveFileLookup", True).parquet(directory)
    rows = rows.filter(F.col("date").isNotNull()).withColumn("ts", F.col("date").cast("timestamp")).withColumn("row_hash", row_hash())
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["account_id", "row_hash"])


def monthly_sums(rows: DataFrame) -> DataFrame:
    """(account_id, month, category, cents, n, last): a batch's spend, and the latest time of all its rows.

    ``month`` counts from 1970 as ``12 * years + months``."""
    spent = F.col("amount") < 0
    return (rows.select("account_id", "ts", ((F.year("date") - 1970) * 12 + F.month("date") - 1).cast("long").alias("month"),
                        F.coalesce("category", F.lit("other")).alias("category"), F.when(spent, F.round(-F.col("amount") * 100).cast("long")).alias("cents"))
            .groupBy("account_id", "month", "category").agg(F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"), F.count("cents").alias("n"), F.max("ts").alias("last")))


def advance(held: DataFrame, sums: DataFrame, limits: dict[str, float], now: Column) -> DataFrame:
    """The open months after a batch (``HELD``): ``before`` and ``level`` are the number of limits passed before
    and after it, ``closed`` is set where the watermark ``now`` has passed the month's end.

    ``limits``: recommended amount of a category; categories without one are only totalled."""
    parts = held.select("account_id", "month", "category", "cents", "n", "level").unionByName(
        sums.filter("n > 0").select("account_id", "month", "category", "cents", "n", F.lit(0).alias("level")))
    out = parts.groupBy("account_id", "month", "category").agg(F.sum("cents").alias("cents"), F.sum("n").alias("n"), F.max("level").alias("before"))
    bars = F.create_map(*[x for c, limit in limits.items() for x in (F.lit(c), F.array(*[F.lit(round(limit * share * 100)).cast("long") for _, share in LEVELS]))])
    passed = F.coalesce(F.size(F.filter(F.element_at(bars, F.col("category")), lambda bar: F.col("cents") > bar)), F.lit(0))
    after = F.col("month") + 1
    end = F.make_date((F.floor(after / 12) + 1970).cast("int"), (F.pmod(after, F.lit(12)) + 1).cast("int"), F.lit(1)).cast("timestamp")
    return out.select("account_id", "month", "category", "cents", "n", "before", F.greatest("before", passed).alias("level"),
                      F.coalesce(end <= now, F.lit(False)).alias("closed"))


def events(held: DataFrame) -> DataFrame:
    """(account_id, month, category, kind, spend, n) of a batch: kinds medium, high, closed."""
    crossed = F.slice(F.array(*[F.lit(kind) for kind, _ in LEVELS]), F.col("before") + 1, F.col("level") - F.col("before"))
    kinds = F.concat(crossed, F.when(F.col("closed"), F.array(F.lit("closed"))).otherwise(F.array().cast("array<string>")))
    name = F.concat_ws("-", F.lpad((F.floor(F.col("month") / 12) + 1970).cast("string"), 4, "0"), F.lpad((F.pmod("month", F.lit(12)) + 1).cast("string"), 2, "0"))
    return held.select("account_id", name.alias("month"), "category", F.explode(kinds).alias("kind"), (F.col("cents") / 100).alias("spend"), "n")


def run_monthly_alerts(spark: SparkSession, directory: str, out_path: str, income: float, delay: str = "60 days", files: int = 100,
                       name: str = "monthly_alerts", fail_in: int | None = None):
    """Take in what lies in ``directory`` and return the finished query. ``fail_in``: for tests, end after the
    output of that batch was written, before the stream knows of it."""
    limits = {c: income * share for c, share in BUDGET_SHARES}
    checkpoint = _ckpt(spark, f"{name}-{os.path.basename(out_path.rstrip('/'))}")
    place = lambda kind, n: f"{checkpoint}-held/{kind}/batch_id={n}"

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        # the rows are read once: to read them again would run the state of their repetitions again
        monthly_sums(batch).write.mode("overwrite").parquet(place("sums", batch_id))
        sums = spark.read.parquet(place("sums", batch_id))
        # the watermark of a batch: the latest time of the batches before it, less the delay
        if batch_id:
            held = spark.read.schema(HELD).parquet(place("months", batch_id - 1)).filter("NOT closed")
            latest = spark.read.schema("last timestamp").parquet(place("latest", batch_id - 1))
        else:
            held, latest = spark.createDataFrame([], HELD), spark.createDataFrame([(None,)], "last timestamp")
        now = F.lit(latest.select(F.col("last") - F.expr(f"INTERVAL {delay}")).first()[0])
        advance(held, sums, limits, now).write.mode("overwrite").parquet(place("months", batch_id))
        latest.union(sums.select("last")).agg(F.max("last").alias("last")).write.mode("overwrite").parquet(place("latest", batch_id))
        events(spark.read.schema(HELD).parquet(place("months", batch_id))).write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")
        if batch_id == fail_in:
            raise RuntimeError("killed")
        for kind in ("sums", "months", "latest"):   # a replayed batch reads those of the one before it
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place(kind, batch_id - 2))
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    query = (uploads(spark, directory, delay, files).writeStream.outputMode("append").foreachBatch(write_batch)
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()
    return query


def late_rows(query) -> int:
    """Rows that a finished run has left out because they were older than the watermark."""
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def alerts(spark: SparkSession, out_path: str) -> DataFrame:
    """All output rows so far, one per event."""
    return spark.read.schema(OUT + ", batch_id long").parquet(out_path)
