"""Versioned tables (K3, K7, J11): uploads are replaced and old rows go without rewriting the table.

``data/<id>`` holds Parquet files that never change, ``log/<n>`` the list of the files of version
``n`` with the rows and the range of accounts and times of each. The table is the newest list that
Spark has marked complete (``_SUCCESS``), so a job that dies leaves the version before it whole.
Files are cut from the sorted keys by size, so their number follows the table's and a large
account spreads over several.

One writer at a time: a second one finds its list's folder taken and fails. A reader that started
before ``sweep`` may lose files under it; sweep when none runs. The driver holds the list of files
(Spark's own file index does), never rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.session import cut_lineage

LIST = "file string, n_rows long, first_key string, last_key string, first_time timestamp, last_time timestamp, n_timed long"
KEYS = ("account_id", "file_hash")
MANY_KEYS = 1000    # this many accounts are looked up one by one, more by their range


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """The complete versions, oldest first."""
    fs, log = _fs(spark, f"{path}/log")
    if not fs.exists(log):
        return []
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath() for s in fs.listStatus(log)]
    return sorted(int(p.getName()) for p in names if p.getName().isdigit() and fs.exists(path_of(p, "_SUCCESS")))


def files(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The files of a version (the newest); none if the table is new."""
    done = versions(spark, path)
    if not done:
        return spark.createDataFrame([], LIST)
    return spark.read.schema(LIST).parquet(f"{path}/log/{done[-1] if version is None else version}")


def _read(spark: SparkSession, names: list[str], schema=None) -> DataFrame:
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(*names)


def read(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the newest)."""
    names = [r["file"] for r in files(spark, path, version).select("file").collect()]
    if names:
        return _read(spark, names)
    fs, schema = _fs(spark, f"{path}/data/schema")   # every row is gone: the columns stay
    if fs.exists(schema):
        return spark.read.parquet(f"{path}/data/schema")
    raise ValueError(f"{path} is no table")


def _commit(spark: SparkSession, path: str, listed: DataFrame) -> int:
    """Write the list of the next version. An incomplete list of a dead job is passed over by its number."""
    fs, log = _fs(spark, f"{path}/log")
    taken = [int(s.getPath().getName()) for s in fs.listStatus(log) if s.getPath().getName().isdigit()] if fs.exists(log) else []
    n = max(taken, default=0) + 1
    listed.coalesce(1).write.mode("error").parquet(f"{path}/log/{n}")   # one row a file of the table
    return n


def _add(rows: DataFrame, path: str, keys: tuple[str, ...], time: str) -> DataFrame:
    """Write ``rows`` as new files, sorted by key and row so that one account may fill several; their list."""
    spark = rows.sparkSession
    place = f"{path}/data/{uuid.uuid4().hex}"
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    (rows.withColumn("_tie", tie).repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys).drop("_tie")
         .write.parquet(place))
    if not _fs(spark, f"{path}/data/schema")[0].exists(_fs(spark, f"{path}/data/schema")[1]):
        spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/data/schema")
    key = F.col(keys[0]).cast("string")
    written = spark.read.schema(rows.schema).parquet(place)
    return written.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.count(F.lit(1)).alias("n_rows"), F.min(key).alias("first_key"), F.max(key).alias("last_key"),
        F.min(F.col(time).cast("timestamp")).alias("first_time"), F.max(F.col(time).cast("timestamp")).alias("last_time"),
        F.count(time).alias("n_timed"))


def _rewrite(spark: SparkSession, path: str, listed: DataFrame, old: list[str], rows: DataFrame | None,
             keys: tuple[str, ...], time: str) -> dict[str, int]:
    """Version with the files ``old`` replaced by ``rows``; how many files went, stayed and came."""
    stay = listed.filter(~F.col("file").isin(old)) if old else listed
    new = None if rows is None else cut_lineage(_add(rows, path, keys, time))
    version = _commit(spark, path, stay if new is None else stay.unionByName(new))
    now = files(spark, path, version).count()
    added = 0 if new is None else new.count()
    return {"version": version, "removed": len(old), "kept": now - added, "added": added}


def replace(rows: DataFrame, path: str, keys: tuple[str, ...] = KEYS, time: str = "created_at") -> dict[str, int]:
    """The rows of every key in ``rows`` are replaced; files without such a key stay as they are.

    The list says which files can hold an account of ``rows``; of those only the key columns are
    read to find the files that hold one, and only these are read whole and written anew. Keys may
    be null. Repeating a call leaves the same rows."""
    spark = rows.sparkSession
    listed = files(spark, path)
    wanted = cut_lineage(rows.select(*keys).distinct())
    accounts = wanted.select(F.col(keys[0]).cast("string").alias("k")).distinct()
    some = accounts.limit(MANY_KEYS + 1)
    near = F.col("first_key").isNull() | F.col("last_key").isNull()
    if some.count() <= MANY_KEYS:
        one = F.broadcast(accounts)   # at most MANY_KEYS
        candidates = listed.join(one, near | F.col("k").isNull() | F.col("k").between(F.col("first_key"), F.col("last_key")), "left_semi")
    else:
        ends = accounts.agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.bool_or(F.col("k").isNull()).alias("null_key")).first()
        candidates = listed.filter(near | F.lit(ends["null_key"]) | ((F.col("last_key") >= F.lit(ends["lo"])) & (F.col("first_key") <= F.lit(ends["hi"]))))
    names = [r["file"] for r in candidates.select("file").collect()]
    touched, kept = [], None
    if names:
        same = lambda left: [left[k].eqNullSafe(wanted[k]) for k in keys]
        held = _read(spark, names).select(*keys, F.col("_metadata.file_path").alias("_file"))
        touched = [r["_file"] for r in held.join(wanted, same(held), "left_semi").select("_file").distinct().collect()]
        if touched:
            old = _read(spark, touched)
            kept = old.join(wanted, same(old), "left_anti").select(*rows.columns)
    return _rewrite(spark, path, listed, touched, rows if kept is None else kept.unionByName(rows), keys, time)


def expire(spark: SparkSession, path: str, as_of: str, days_old: int = 30, keys: tuple[str, ...] = KEYS,
           time: str = "created_at") -> dict[str, int]:
    """K7: rows older than ``as_of - days_old`` go. Files with old rows only leave the list, files
    with both are written anew, all others stay. Rows without a time go, as in ``retention_filter``."""
    cutoff = F.date_sub(F.to_date(F.lit(as_of)), days_old).cast("timestamp")
    listed = files(spark, path)
    if not versions(spark, path):
        raise ValueError(f"{path} is no table")
    # the list alone tells which files hold old rows; no data is read for the others
    old_rows = (F.col("first_time") < cutoff) | (F.col("n_timed") < F.col("n_rows"))
    concerned = listed.filter(F.col("last_time").isNull() | (F.col("last_time") < cutoff) | old_rows)
    found = concerned.select("file", F.coalesce(F.col("last_time") >= cutoff, F.lit(False)).alias("has_new")).collect()
    gone = [r["file"] for r in found if not r["has_new"]]
    mixed = [r["file"] for r in found if r["has_new"]]
    rows = None
    if mixed:
        old = _read(spark, mixed)
        rows = old.filter(F.col(time).cast("timestamp") >= cutoff)
    return _rewrite(spark, path, listed, gone + mixed, rows, keys, time)


def sweep(spark: SparkSession, path: str) -> int:
    """Delete the files that the newest version does not list, and the older lists; how many files went."""
    done = versions(spark, path)
    live = {r["file"].rsplit("/data/", 1)[1] for r in files(spark, path).select("file").collect()}
    fs, data = _fs(spark, f"{path}/data")
    found, n = fs.listFiles(data, True), 0
    while found.hasNext():
        p = found.next().getPath()
        name = p.toString().rsplit("/data/", 1)[1]
        if p.getName().startswith("part-") and not name.startswith("schema/") and name not in live:
            fs.delete(p, False)
            n += 1
    for old in done[:-1]:
        fs.delete(_fs(spark, f"{path}/log/{old}")[1], True)
    return n
