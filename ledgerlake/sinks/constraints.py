"""K8: the declared constraints of the tables, checked before rows are written.

Violations come as a table (constraint, column, key, n_rows), one row per constraint, column and
offending value, so a third of all rows with one bad value is one row. ``admit`` parts the rows
into those that keep every constraint and those that break one.

Defined cases: a null value breaks NOT NULL alone (as in SQL it is neither a duplicate nor an
orphan); of rows with one unique value all are named, and of ``admit`` the first by ``order``
stays; an empty table breaks nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rules:
    not_null: tuple[str, ...] = ()
    unique: tuple[str, ...] = ()                    # one column each
    references: tuple[tuple[str, str], ...] = ()    # (column, the parent's column)


# FIXED VALUES — the declarations of the four tables.
TABLES = {
    "sessions": Rules(not_null=("session_id",), unique=("session_id",)),
    "transactions": Rules(not_null=("account_id", "date", "description", "amount", "category", "type"),
                          references=(("account_id", "session_id"),)),
    "analysis_results": Rules(not_null=("session_id", "analysis_type", "results"), references=(("session_id", "session_id"),)),
    "custom_categories": Rules(not_null=("session_id", "category_name", "keywords"), references=(("session_id", "session_id"),)),
}


def violations(df: DataFrame, rules: Rules, parent: DataFrame | None = None) -> DataFrame:
    """(constraint, column, key, n_rows). NOT NULL costs one scan without a shuffle of rows; each
    unique or foreign key one aggregate of its values (pre-aggregated) and a join of the values."""
    spark = df.sparkSession
    out = spark.createDataFrame([], "constraint string, column string, key string, n_rows long")
    if rules.not_null:
        counts = df.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in rules.not_null])
        each = counts.select(F.inline(F.array(*[F.struct(F.lit("not null").alias("constraint"), F.lit(c).alias("column"),
                                                         F.lit(None).cast("string").alias("key"), F.col(c).alias("n_rows")) for c in rules.not_null])))
        out = out.unionByName(each.filter("n_rows > 0"))
    values = lambda c: df.filter(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n_rows"))
    for c in rules.unique:
        out = out.unionByName(values(c).filter("n_rows > 1").select(F.lit("unique").alias("constraint"), F.lit(c).alias("column"), "key", "n_rows"))
    for c, p in rules.references:
        known = parent.select(F.col(p).cast("string").alias("key"))
        out = out.unionByName(values(c).join(known, "key", "left_anti").select(F.lit("foreign key").alias("constraint"), F.lit(c).alias("column"), "key", "n_rows"))
    return out


def admit(df: DataFrame, rules: Rules, parent: DataFrame | None = None, order: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(rows that keep every constraint, rows that break one with ``broken``, the names of what they break).

    A parent's value is joined once per distinct value of the child, so a large account is one row
    in that join; the way back is an equi-join that AQE splits where it is skewed."""
    broken = [F.when(F.col(c).isNull(), F.lit(f"not null {c}")) for c in rules.not_null]
    for i, (c, p) in enumerate(rules.references):
        known = parent.select(F.col(p).cast("string").alias(f"_known{i}")).filter(F.col(f"_known{i}").isNotNull()).distinct()
        df = df.join(known, F.col(c).cast("string") == F.col(f"_known{i}"), "left")
        broken.append(F.when(F.col(c).isNotNull() & F.col(f"_known{i}").isNull(), F.lit(f"foreign key {c}")))
    for i, c in enumerate(rules.unique):
        by = [F.col(o) for o in order] or [F.xxhash64(*[F.col(f"`{x}`") for x in df.columns])]
        df = df.withColumn(f"_nth{i}", F.row_number().over(Window.partitionBy(c).orderBy(*by)))
        broken.append(F.when(F.col(c).isNotNull() & (F.col(f"_nth{i}") > 1), F.lit(f"unique {c}")))
    marked = df.withColumn("broken", F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>"))
    marked = marked.drop(*[f"_known{i}" for i in range(len(rules.references))], *[f"_nth{i}" for i in range(len(rules.unique))])
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)
