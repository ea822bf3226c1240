"""Ranked lexical search by pipelined term partitioning.

Terms belong to owners by how many documents hold them, the rarest first. The bundle of an item
(a query) carries its sparse accumulators, one integer score per document reached so far, through
the owners one after the other; every owner stage is a cogroup of the bundles with the owner's
posting lists, which adds the integer contributions of the item's terms. An accumulator goes on
only while what later owners can add at most may still bring it to the item's tenth best score, a
bound that loses no result and no tie. After the last owner the best documents are selected.

Bundles and posting lists are dealt by block of documents (``BLOCK`` consecutive ones of a scan),
so a term that stands in every document is spread over all blocks, as are the accumulators of an
item; items are bundled by up to ``BUNDLE`` to a group. Best scores are merged in two steps, so
that documents with equal scores, copies for instance, do not meet in one task.

The items' terms are sent to the texts as one dictionary of at most ``MOST_TERMS`` terms; a larger
set of items is ranked in runs of items, each with its own dictionary.

Integer weights: term w = floor(1000 ln((2 N + 2) / (2 df + 1))), document m = 10 + 90 n N div L,
contribution w * (10^9 tf div (1000 tf + 8 m)).

Defined cases: null and empty texts hold no term and are never found, nor is anything for an item
without terms; equal scores are ranked by smaller key, null last; repeated rows of either table
are rows of their own; empty tables give no rows; ``key`` must be an integer column, other columns
of both tables are not read.
"""

from __future__ import annotations

import re
from array import array
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import materialize, small_batches

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM = re.compile(TERM.encode())
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
BLOCK, BUNDLE, MOST_TERMS = 8192, 256, 1 << 18
#: An owner's terms stand in at most 1 of so many documents; the last one has the rest.
OWNERS = [1024, 128, 32, 8]


def terms_of(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))


INDEX = "block long, term int, docs long, words long, ratio double, top int, at array<int>, tf array<int>, n array<int>, keys array<long>"


def index(docs: DataFrame, vocabulary: list[str], text: str, key: str) -> DataFrame:
    """Posting lists of the vocabulary's terms by block of documents, written out.

    One row per (block, term): ``at`` (place in the block), ``tf`` and ``n`` of its documents, their
    number ``docs``, the least ``ratio`` n / tf and the ``top`` tf. Term -1 has the keys of a block.
    """
    spark = docs.sparkSession
    small_batches(spark)
    numbers = spark.sparkContext.broadcast({t.encode(): i for i, t in enumerate(vocabulary)})

    def closed(block, term, at, tf, n, sizes, keys):
        order = np.argsort(np.frombuffer(term, np.int32), kind="stable")
        term, at, tf, n = (np.frombuffer(x, np.int32)[order] for x in (term, at, tf, n))
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts, len(term)).astype(np.int32)
        some = len(starts) > 0
        sizes = np.array(sizes, np.int64)
        rows = len(starts) + 1
        lists = [pa.ListArray.from_arrays(pa.array(np.append(ends, len(term)).astype(np.int32)), pa.array(x)) for x in (at, tf, n)]
        return pa.RecordBatch.from_arrays([
            pa.array(np.full(rows, block)), pa.array(np.append(term[starts], -1).astype(np.int32)),
            pa.array(np.append(np.diff(ends), (sizes > 0).sum()).astype(np.int64)), pa.array(np.append(np.zeros(rows - 1, np.int64), sizes.sum())),
            pa.array(np.append(np.minimum.reduceat(n / tf, starts) if some else [], 0.0)),
            pa.array(np.append(np.maximum.reduceat(tf, starts) if some else [], 0).astype(np.int32)), *lists,
            pa.array([None] * (rows - 1) + [keys], pa.list_(pa.int64()))],
            ["block", "term", "docs", "words", "ratio", "top", "at", "tf", "n", "keys"])

    def run(batches):
        number = numbers.value
        block = TaskContext.get().partitionId() << 32
        parts, sizes, keys = [array("i") for _ in range(4)], [], []
        term, at, tf, n = parts
        for b in batches:
            for k, x in zip(b.column(0), b.column(1)):
                count = {}
                found = _TERM.findall((x.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER))
                for i in map(number.get, found):
                    if i is not None:
                        count[i] = count.get(i, 0) + 1
                term.extend(count)
                tf.extend(count.values())
                at.extend(repeat(len(sizes), len(count)))
                n.extend(repeat(len(found), len(count)))
                sizes.append(len(found))
                keys.append(k.as_py())
                if len(sizes) == BLOCK:
                    yield closed(block, *parts, sizes, keys)
                    parts, sizes, keys = [array("i") for _ in range(4)], [], []
                    term, at, tf, n = parts
                    block += 1
        if sizes:
            yield closed(block, *parts, sizes, keys)

    rows = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(run, INDEX), "rank-index", "zstd")


def best(lists: DataFrame, column: str, k: int) -> DataFrame:
    """(item, ``column``): the ``k`` least entries of all lists of an item, merged in two steps."""
    salt = F.pmod(F.xxhash64("block"), F.lit(max(1, round(lists.count() ** 0.5))))
    for keys in (["item", salt.alias("salt")], ["item"]):
        lists = lists.groupBy(*keys).agg(F.slice(F.sort_array(F.flatten(F.collect_list(column))), 1, k).alias(column))
    return lists.select("item", column)


def _stage(bundles: DataFrame, lists: DataFrame, n_docs: int, n_words: int) -> DataFrame:
    """One owner: bundles with the contributions of its posting lists, less accumulators below need."""
    def add(key, left: pa.Table, right: pa.Table) -> pa.Table:
        size = 1 + max([int(x.max()) for t in (left, right) if t.num_rows and len(x := t["at"].combine_chunks().flatten().to_numpy())], default=-1)
        scores, need = {}, {}
        for item, least, at, score in zip(left["item"].to_pylist(), left["need"].to_pylist(), left["at"], left["score"]):
            scores[item], need[item] = np.zeros(size, np.int64), least
            scores[item][at.values.to_numpy()] = score.values.to_numpy()
        for at, tf, n, asks in zip(right["at"], right["tf"], right["n"], right["asks"].to_pylist()):
            at, tf, n = at.values.to_numpy(), tf.values.to_numpy().astype(np.int64), n.values.to_numpy().astype(np.int64)
            part = 1_000_000_000 * tf // (1000 * tf + 8 * (10 + 90 * n * n_docs // n_words))
            for a in asks:
                if a["item"] not in scores:
                    scores[a["item"]], need[a["item"]] = np.zeros(size, np.int64), a["need"]
                scores[a["item"]][at] += a["w"] * part
        out = []
        for item, score in scores.items():
            kept = np.flatnonzero(score >= max(1, need[item]))
            if len(kept):
                out.append((item, kept, score[kept]))
        ends = pa.array(np.cumsum([0] + [len(x[1]) for x in out]), pa.int32())
        flat = [np.concatenate([x[i] for x in out] or [np.zeros(0, np.int64)]) for i in (1, 2)]
        return pa.table([pa.array([key[0].as_py()] * len(out), pa.int32()), pa.array([key[1].as_py()] * len(out), pa.int64()), pa.array([x[0] for x in out], pa.int64()),
                         pa.ListArray.from_arrays(ends, pa.array(flat[0], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(flat[1], pa.int64()))],
                        names=["bundle", "block", "item", "at", "score"])

    both = ["bundle", "block"]
    return bundles.groupBy(*both).cogroup(lists.groupBy(*both)).applyInArrow(add, "bundle int, block long, item long, at array<int>, score array<long>")


def _rank_run(docs: DataFrame, asked: DataFrame, text: str, key: str, k: int) -> DataFrame:
    """(item, rank, key, score) of one run of items; ``asked`` has columns item, term_text."""
    spark = docs.sparkSession
    words = asked.select("term_text").distinct().orderBy("term_text").collect()  # at most MOST_TERMS
    vocabulary = [r[0] for r in words]
    table = index(docs, vocabulary, text, key)
    whole = table.filter("term = -1").agg(F.sum("docs"), F.sum("words")).first()
    n_docs, n_words = whole[0] or 0, whole[1] or 0
    numbers = spark.createDataFrame([(t, i) for i, t in enumerate(vocabulary)], "term_text string, term int")
    owner = F.lit(len(OWNERS))
    for i in reversed(range(len(OWNERS))):
        owner = F.when(F.col("df") * OWNERS[i] <= n_docs, i).otherwise(owner)
    # the most that a posting can be: least length per occurrence with the most occurrences
    share = 9 / F.col("top") + 90 * F.col("ratio") * F.lit(float(n_docs)) / F.lit(float(max(1, n_words)))
    stats = (table.filter("term >= 0").groupBy("term").agg(F.sum("docs").alias("df"), F.min("ratio").alias("ratio"), F.max("top").alias("top"))
             .select("term", owner.alias("owner"), F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w"),
                     (F.floor(1e9 / (1000 + 8 * share)) + 1).cast("long").alias("most")))
    stats = materialize(stats.join(F.broadcast(numbers), "term"), "rank-terms")
    postings = materialize(table.filter("term >= 0").select("block", "term", "at", "tf", "n").join(F.broadcast(stats.select("term", "owner")), "term")
                           .repartition("owner", "block"), "rank-postings", "zstd")
    n_items = asked.select("item").distinct().count()
    bundle = F.pmod(F.xxhash64("item"), F.lit(max(1, -(-n_items // BUNDLE)))).cast("int")
    asks = materialize(asked.join(F.broadcast(stats), "term_text").select("item", bundle.alias("bundle"), "term", "owner", "w", (F.col("w") * F.col("most")).alias("most")), "rank-asks")
    rest = asks.groupBy("item").agg(*[F.sum(F.when(F.col("owner") > i, F.col("most")).otherwise(0)).alias(f"rest_{i}") for i in range(len(OWNERS) + 1)])

    bundles = spark.createDataFrame([], "bundle int, block long, item long, at array<int>, score array<long>")
    tenth = spark.createDataFrame([], "item long, bar long")
    for i in range(len(OWNERS) + 1):
        need = rest.join(tenth, "item", "left").select("item", (F.coalesce("bar", F.lit(0)) - F.col(f"rest_{i}")).alias("need"))
        ask = asks.filter(F.col("owner") == i).join(need, "item").groupBy("bundle", "term").agg(F.collect_list(F.struct("item", "w", "need")).alias("asks"))
        lists = postings.filter(F.col("owner") == i).join(ask, "term").select("bundle", "block", "at", "tf", "n", "asks")
        bundles = materialize(_stage(bundles.join(need, "item"), lists, n_docs, max(1, n_words)), "rank-bundles", "zstd")
        tops = bundles.select("item", "block", F.transform(F.slice(F.sort_array("score", asc=False), 1, k), lambda x: -x).alias("least"))
        tenth = materialize(best(tops, "least", k).filter(F.size("least") == k).select("item", (-F.element_at("least", -1)).alias("bar")), "rank-bars")

    # final selection: a block's best k by score and key, then those of all blocks
    keys = table.filter("term = -1").select("block", "keys")
    got = bundles.join(tenth, "item", "left").join(keys, "block")
    pairs = F.filter(F.arrays_zip("at", "score"), lambda p: p["score"] >= F.coalesce("bar", F.lit(1)))
    named = F.transform(pairs, lambda p: F.struct((-p["score"]).alias("low"), F.get("keys", p["at"]).isNull().alias("none"), F.get("keys", p["at"]).alias("key")))
    tops = got.select("item", "block", F.slice(F.sort_array(named), 1, k).alias("least")).filter(F.size("least") > 0)
    chosen = best(tops, "least", k).select("item", F.posexplode("least").alias("at", "p"))
    return chosen.select("item", (F.col("at") + 1).cast("int").alias("rank"), F.col("p.key").alias("key"), (-F.col("p.low")).alias("score"))


def rank(docs: DataFrame, items: DataFrame, k: int = 10, text: str = "text", key: str = "doc_id", item_text: str = "text", item_key: str = "item_id") -> DataFrame:
    """(item_key, rank, key, score): the ``k`` best documents of every item, score above 0."""
    items = materialize(items.select(F.col(item_key).alias("item_key"), F.col(item_text).alias("item_text")).withColumn("item", F.monotonically_increasing_id()), "rank-items")
    asked = materialize(items.select("item", F.explode(F.array_distinct(terms_of(F.col("item_text")))).alias("term_text")), "rank-asked")
    runs = 1
    run = F.pmod(F.xxhash64("item"), F.lit(runs))
    while runs < 1 << 20 and (asked.groupBy(run.alias("run")).agg(F.countDistinct("term_text").alias("n")).agg(F.max("n")).first()[0] or 0) > MOST_TERMS:
        runs *= 2
        run = F.pmod(F.xxhash64("item"), F.lit(runs))
    found = None
    for r in range(runs):
        one = _rank_run(docs, asked.filter(run == r) if runs > 1 else asked, text, key, k)
        found = one if found is None else found.unionByName(one)
    return found.join(items.select("item", "item_key"), "item").select(F.col("item_key").alias(item_key), "rank", F.col("key").alias(key), "score")
