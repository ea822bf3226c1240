"""Quoted records that run over line ends, found split by split.

Reading a file's quotes is an automaton of two states: outside and inside a quoted cell, switched
by every line with an odd number of quotes. A split does not know the state it begins in, so it is
summed up for either: how it switches the state, and where its last record begins if it is entered
outside or inside. These summaries, one row per split, are composed by a prefix scan over a file's
splits; every line then knows the record it belongs to. No task holds more lines than a split or a
record has, whatever the size of the file.

A quote that never closes is text: where a file ends inside a quoted cell, the lines from the last
opening on are records of their own (else the rest of the file would be one cell).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def n_quotes(line: Column) -> Column:
    return F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))


def numbered(lines: DataFrame) -> DataFrame:
    """``lines`` with ``no`` (place in the split), ``odd`` and ``flip`` (odd lines before it in the split, mod 2)."""
    split = Window.partitionBy("source_file", "at.block").orderBy("at.seq")
    odd = n_quotes(F.col("line")) % 2
    before = F.sum(odd).over(split.rowsBetween(Window.unboundedPreceding, -1))
    return lines.withColumns({"no": F.row_number().over(split), "odd": odd, "flip": F.coalesce(before, F.lit(0)) % 2})


def split_states(lines: DataFrame) -> DataFrame:
    """(source_file, block, enter, carried, open_from): one row per split of ``numbered`` lines.

    ``enter``: state the split begins in; ``carried``: block and number of the line where the record
    begins that the split is entered in; ``open_from``: the same of a last record that never closes.
    """
    per = lines.groupBy("source_file", F.col("at.block").alias("block")).agg(
        F.sum("odd").alias("odd"),
        F.max(F.when(F.col("flip") == 0, F.col("no"))).alias("outside"), F.max(F.when(F.col("flip") == 1, F.col("no"))).alias("inside"))
    order = Window.partitionBy("source_file").orderBy("block")
    past, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("source_file")
    per = per.withColumn("enter", F.coalesce(F.sum("odd").over(past), F.lit(0)) % 2)
    begun = F.when(F.col("enter") == 0, F.col("outside")).otherwise(F.col("inside"))
    per = per.withColumn("begun", F.when(begun.isNotNull(), F.struct("block", begun.alias("no"))))
    per = per.withColumn("carried", F.last("begun", ignorenulls=True).over(past))
    ends_inside = F.sum("odd").over(whole) % 2 == 1
    return per.select("source_file", "block", "enter", "carried", F.when(ends_inside, F.max("begun").over(whole)).alias("open_from"))


def join_records(lines: DataFrame) -> DataFrame:
    """One row per record: ``line`` has its lines with their line ends, all else is that of its first line."""
    rest = [c for c in lines.columns if c not in ("source_file", "at", "line")]
    placed = numbered(lines)
    states = split_states(placed)
    # lines and states are both dealt by split: the join moves the small side only
    known = placed.withColumn("block", F.col("at.block")).join(states, ["source_file", "block"])
    split = Window.partitionBy("source_file", "block").orderBy("no").rowsBetween(Window.unboundedPreceding, 0)
    start = F.when((F.col("enter") + F.col("flip")) % 2 == 0, F.col("no"))
    own = F.struct("block", "no")
    record = F.coalesce(F.when(F.max(start).over(split).isNotNull(), F.struct("block", F.max(start).over(split).alias("no"))), F.col("carried"), own)
    known = known.withColumn("record", record)
    known = known.withColumn("record", F.when(F.col("record") == F.col("open_from"), own).otherwise(F.col("record")))
    lone = F.struct("block", "no", "line", "at", *rest)
    got = known.groupBy("source_file", "record").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("block", "no", "line"))), lambda x: x["line"]).alias("parts"),
        F.min_by(lone, own).alias("first"))
    return got.select("source_file", "first.at", F.array_join("parts", "\n").alias("line"), *[F.col(f"first.{c}").alias(c) for c in rest])
