"""Mixing sources to target weights by pivotal dependent rounding.

Each document of a source wants ``x = target / source_size`` copies. The whole part is certain;
the fractions are rounded together: two fractional documents meet, and a random amount of words
moves from one to the other until one of them wants a whole number of copies. The words moved
leave the source's total unchanged and the expected copies of every document as they were, so a
source misses its target by less than one document. Documents meet in buckets of about
``BUCKET`` rows; the one undecided document of a bucket goes up a reduction tree with fan-in
``BUCKET`` until each source has one, which is rounded at random. Only undecided documents
travel, so the tree holds 1/BUCKET of the rows and no task sees a whole source.

Randomness is seeded by source, level and bucket, and buckets depend on the document alone, so
reruns agree whatever the partitioning.

Defined cases: a null or empty text has size 0 and its copies are drawn alone; null sources are a
source of their own, last in order; a null doc_id is a value like any other; repeated rows are
separate documents; an empty table gives no rows; columns named like the added ones (``mix_*``)
are replaced, all others are kept.
"""

from __future__ import annotations

import random

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import WORD, aside, materialize, nullable, small_batches, without

BUCKET = 512
ADDED = ("mix_size", "mix_source_size", "mix_target", "mix_copies")
WORK = ("mix_base", "mix_p", "mix_bucket")


def source_targets(sizes: DataFrame, ratio: float, weights: tuple, cap: float) -> DataFrame:
    """Targets of sources (source, mix_source_size, mix_docs): ``ratio`` of all sizes shared by weight.

    No target exceeds ``cap`` times its source's size; the excess is shared again by weight among
    the rest, which ends at one level per unit of weight (sources filled in order of cap/weight).
    One row per source, so the windows without partitions hold the list of sources only.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    w = F.array(*[F.lit(float(x)) for x in weights])
    filled = (sizes
              .withColumn("w", F.element_at(w, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
              .withColumn("cap", F.lit(float(cap)) * F.col("mix_source_size"))
              .withColumn("pool", F.lit(float(ratio)) * F.sum("mix_source_size").over(every))
              .withColumn("full_at", F.col("cap") / F.col("w")))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    levels = (filled
              .withColumn("level", (F.col("pool") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("w").over(after))
              .withColumn("at", F.row_number().over(order)))
    open_at = F.when(F.col("full_at") > F.col("level"), F.struct("at", "level"))
    final = levels.withColumn("open", F.min(open_at).over(every))
    target = F.when(F.col("open").isNull() | (F.col("at") < F.col("open.at")), F.col("cap")).otherwise(
        F.least("cap", F.col("open.level") * F.col("w")))
    return final.select("source", "mix_source_size", "mix_docs", target.alias("mix_target"))


def meet(p: float, s: float, q: float, t: float, u: float) -> tuple[float, float]:
    """Move words between two documents of sizes s, t that want p, q copies until one is whole.

    ``u`` in [0, 1) picks the direction so that both keep their expectation.
    """
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    if u * (up + down) < down:
        return (1.0, q - (1 - p) * s / t) if (1 - p) * s < q * t else (p + q * t / s, 0.0)
    return (0.0, q + p * s / t) if p * s < (1 - q) * t else (p - (1 - q) * t / s, 1.0)


def whole(p: float) -> float:
    return 0.0 if p < 1e-9 else 1.0 if p > 1 - 1e-9 else p


def _round(level: int, seed: int, last: bool):
    """Arrow batches sorted by (source, bucket, size) -> the same rows with decided copies.

    Holds one undecided row beside the batch. ``mix_p`` stays non-null on a bucket's last
    undecided row, which goes up the tree.
    """
    def decided(row: pa.RecordBatch, copies: list, left: list) -> pa.RecordBatch:
        for name, values, kind in (("mix_copies", copies, pa.int32()), ("mix_p", left, pa.float64())):
            row = row.set_column(row.schema.get_field_index(name), pa.field(name, kind), pa.array(values, kind))
        return row

    def run(batches):
        group, rng, held = None, None, None  # held: [row of an earlier batch or index, base, p, size]
        for batch in batches:
            n = batch.num_rows
            src, bucket, base, p, size = (batch.column(batch.schema.get_field_index(c)).to_pylist()
                                          for c in ("source", "mix_bucket", "mix_base", "mix_p", "mix_size"))
            copies, left = [0] * n, [None] * n

            def settle(held, ended):
                """Give a document that leaves the table of two its copies."""
                row, b, q, _ = held
                undecided = ended and q not in (0.0, 1.0) and not last
                if ended and last and q not in (0.0, 1.0):
                    q = 1.0 if rng.random() < q else 0.0
                c, rest = b + int(q == 1.0), q if undecided else None
                if isinstance(row, int):
                    copies[row], left[row] = c, rest
                    return None
                return decided(row, [c], [rest])

            out = []
            for i in range(n):
                if (src[i], bucket[i]) != group:
                    if held is not None:
                        out.append(settle(held, True))
                    group, held = (src[i], bucket[i]), None
                    rng = random.Random(f"{seed}/{level}/{src[i]}/{src[i] is None}/{bucket[i]}")
                q = whole(p[i])
                if size[i] == 0 and 0 < q < 1:
                    q = 1.0 if rng.random() < q else 0.0
                mine = [i, base[i], q, float(size[i])]
                if q in (0.0, 1.0):
                    settle(mine, False)
                elif held is None:
                    held = mine
                else:
                    a, b = meet(held[2], held[3], q, mine[3], rng.random())
                    held[2], mine[2] = whole(a), whole(b)
                    done = [x for x in (held, mine) if x[2] in (0.0, 1.0)]
                    out += [settle(x, False) for x in done]
                    held = next((x for x in (held, mine) if x[2] not in (0.0, 1.0)), None)
            keep = list(range(n))
            if held is not None and isinstance(held[0], int):
                k = held[0]
                held[0] = batch.slice(k, 1)
                keep.remove(k)
            yield from (x for x in out if x is not None)
            full = decided(batch, copies, left)
            yield full if len(keep) == n else full.take(pa.array(keep, pa.int64()))
        if held is not None:
            q = held[2]
            if last:
                q = 1.0 if rng.random() < q else 0.0
            yield decided(held[0], [held[1] + int(q == 1.0)], [None if last else q])
    return run


def mix(docs: DataFrame, ratio: float = 1.5, weights: tuple = (3, 1, 2), cap: float = 2.0, seed: int = 7,
        text: str = "text") -> DataFrame:
    """``docs`` with ``mix_size``, ``mix_source_size``, ``mix_target`` and ``mix_copies`` added.

    ``docs`` needs ``doc_id``, ``source`` and either ``mix_size`` or the text column.
    """
    spark = docs.sparkSession
    small_batches(spark)
    if "mix_size" not in docs.columns:
        docs = without(docs, "mix_size").withColumn(
            "mix_size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))
    docs = without(docs, *ADDED[1:], *WORK)
    sizes = docs.groupBy("source").agg(F.sum("mix_size").alias("mix_source_size"), F.count(F.lit(1)).alias("mix_docs"))
    targets = materialize(source_targets(sizes, ratio, weights, cap), "mix-targets")
    most = targets.agg(F.max("mix_docs")).first()[0] or 0
    # by its written size Spark broadcasts the list of sources, or joins it otherwise
    t = targets.withColumnRenamed("source", "mix_source")
    x = F.when(F.col("mix_source_size") > 0, F.col("mix_target") / F.col("mix_source_size")).otherwise(F.lit(1.0))
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "source", "mix_size")]
    known = [c for c in docs.columns if not isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType))]
    rows = (docs.join(t, docs["source"].eqNullSafe(t["mix_source"]), "left")
            .withColumn("mix_x", x).withColumn("mix_base", F.floor(F.col("mix_x") + 1e-9).cast("int"))
            .withColumn("mix_p", F.greatest(F.lit(0.0), F.col("mix_x") - F.col("mix_base")))
            .withColumn("mix_tie", F.xxhash64(*[F.col(f"`{c}`") for c in known]))
            .withColumn("mix_bucket", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "mix_tie"),
                                             F.ceil(F.col("mix_docs") / BUCKET).cast("long")))
            .withColumn("mix_copies", F.lit(0).cast("int"))
            .select("doc_id", "source", "mix_size", *rest, "mix_source_size", "mix_target", "mix_copies",
                    "mix_base", "mix_p", "mix_tie", "mix_bucket"))
    done, level, groups = [], 0, -(-most // BUCKET)
    while True:
        last = groups <= 1
        dealt = rows.repartition("source", "mix_bucket").sortWithinPartitions(
            "source", "mix_bucket", F.col("mix_size").desc(), "doc_id", "mix_tie")
        rows = materialize(dealt.mapInArrow(_round(level, seed, last), nullable(dealt.schema)), f"mix-level{level}")
        done.append(rows.filter(F.col("mix_p").isNull()))
        if last:
            break
        rows = rows.filter(F.col("mix_p").isNotNull()).withColumn(
            "mix_bucket", F.floor(F.col("mix_bucket") / BUCKET).cast("long"))
        groups, level = -(-groups // BUCKET), level + 1
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.select("doc_id", "source", *rest, *ADDED)


def repeated(docs: DataFrame, **kw) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it."""
    plain, back = aside(docs, "doc_id", "source", kw.get("text", "text"))
    return back(mix(plain, **kw).withColumn("mix_copy", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies")))))
