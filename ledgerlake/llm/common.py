"""Shared helpers: reading tables, the shared scratch folder, Arrow batches."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Bytes of one Arrow batch sent to a Python worker; a longer text goes alone.
BATCH_BYTES = "4m"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound what a Python worker holds at once, and see that workers can import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    ship(spark)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors once per application, as ``--py-files`` would."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-"), "ledgerlake_package.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(top):
            for n in names:
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("ledgerlake", os.path.relpath(full, top)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)


def scratch(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where none is named, a local master gets a temporary folder (one machine, so it is shared by
    all workers); a cluster without the setting is an error, as no folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="ledgerlake-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/llm/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut, lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    """The schema of rows that come back from Python, where any value may be null."""
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo ``n`` (null: null)."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % n


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` less the columns whose names (in any case) an operator is about to add."""
    taken = {n.lower() for n in names}
    return df.select([F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def aside(docs: DataFrame, *used: str):
    """``docs`` with all columns but ``used`` under names no operator takes, and the way back."""
    own = [c if c in used else f"own_{i}" for i, c in enumerate(docs.columns)]
    names = docs.columns
    return docs.toDF(*own), lambda df: df.select([F.col(a).alias(c) for a, c in zip(own, names)])


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
