"""Upload pipeline: statement rows → parsed, recovered and categorised transactions.

Composes the operators a user runs on an upload: parse and validate (F1, V1), recover what was
rejected (P1–P7), categorise rows without a category (G3–G7) and let the account's own categories win
(G8). The parsed and the recovered rows are checkpointed, as accepted and rejected rows, their texts and their categories
are all taken from them; the same chain serves batch and ``foreachBatch``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.operators import categorize as G
from ledgerlake.operators import recover as R
from ledgerlake.operators import statements as ST
from ledgerlake.session import cut_lineage, keep_where

RAW = ["date", "description", "amount", "type", "category"]


def accept(rows: DataFrame, as_of: str) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) of raw text rows; ``how`` is 'parsed' or the strategy that recovered a row.

    Every row is in exactly one of the two; rejected rows keep their text and reason."""
    missing = [c for c in RAW if c not in rows.columns and c != "type"]
    for c in missing:
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    present = [c for c in RAW if c in rows.columns]
    lineage = [c for c in rows.columns if c not in (*RAW, "currency")]
    good, bad = ST.split(cut_lineage(ST.parse_statements(rows.withColumn("_text", F.struct(*present)), as_of)))
    good = good.select(*lineage, F.lit("parsed").alias("how"), F.col("date").cast("string").alias("date"), "description", "amount",
                       "currency", "type", "category", "confidence_score")
    again = R.recover_rows(bad.select(*lineage, F.col("reject_reason").alias("_reason"), "_text", *[F.col(f"_text.{c}").alias(c) for c in present]),
                           as_of, columns=present)
    again = cut_lineage(again)
    sound = R.is_valid_recovered(again)
    found = keep_where(again, sound).select(
        *lineage, F.col("strategy_used").alias("how"), "date", "description", "amount", "currency", "type",
        F.when(F.col("category") == "other", F.lit("")).otherwise(F.col("category")).alias("category"), F.col("confidence").alias("confidence_score"))
    lost = keep_where(again, ~F.coalesce(sound, F.lit(False))).select(*lineage, "_text.*", F.col("_reason").alias("reject_reason"))
    return good.unionByName(found), lost


def process(rows: DataFrame, as_of: str, model: G.NBModel | None = None, custom: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(transactions, rejected): ``accept``, then categories for rows without one.

    ``custom`` (account_id, category, keywords): an account's own category replaces the blended one
    where one of its keywords scores."""
    accepted, lost = accept(rows, as_of)
    need = F.coalesce(F.col("category"), F.lit("")).isin("", "other")
    out = G.categorize(accepted.withColumn("_open", need), model or G.default_model(rows.sparkSession))
    if custom is not None:
        texts = accepted.filter(need).select("account_id", F.lower(F.trim("description")).alias("desc")).distinct()
        own = G.custom_rule_scores(texts, custom, "desc").select("account_id", F.col("desc").alias("_desc"), "custom_category")
        out = out.withColumn("_desc", F.lower(F.trim("description"))).join(own, ["account_id", "_desc"], "left")
        out = out.withColumn("category", F.when(F.col("_open"), F.coalesce("custom_category", "category")).otherwise(F.col("category"))).drop("_desc", "custom_category")
    return out.drop("_open"), lost
