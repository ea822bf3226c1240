"""Target-distribution importance resampling by segment deduplication.

Features of a text are its words and pairs of neighbouring words, hashed into buckets. A document
is drawn by the mean log ratio of its features' shares in a target and in the corpus, plus Gumbel
noise (so that the highest scores are a weighted sample without replacement).

Line breaks cut the texts into lines. A corpus repeats many lines, so the features of a line are
hashed once for all its occurrences: lines are counted in one shuffle, the features of the
different ones are counted and multiplied by the occurrences, and the pairs that reach over a line
break are added from the documents. The gains of a document are put together in the same way, from
those of its lines and its pairs across lines.

A line that makes up a 4096th of all lines or more is sent to the documents (there are at most
4096 of them), the others are joined by two 64-bit hashes; so a line that stands in a third of all
documents does not go to one task. Totals are 64-bit integers by bucket, at most ``BUCKETS`` rows.

Defined cases: null and empty texts have no line with a word, no features and weight 0; they and
texts with fewer than ``least`` words are never drawn; equal scores are drawn by smaller doc_id,
null last, then in any order; repeated rows are rows of their own; without a target text every
gain is that of an empty target; an empty table gives no rows; all columns are kept, and those
named like an added one (``res_words``, ``res_features``, ``res_weight``, ``res_score``,
``res_rank``) are replaced.
"""

from __future__ import annotations

import re
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import aside, materialize, ship, small_batches, without

BUCKETS = 10_000
#: Share of all lines from which a line is sent to the documents.
HOT = 4096
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def line_key(line) -> list[Column]:
    return [F.xxhash64(line, F.lit(7)).alias("k1"), F.xxhash64(line, F.lit(13)).alias("k2")]


def features(tokens: list[bytes], buckets: int = BUCKETS) -> list[int]:
    """Buckets of all words and of all pairs of neighbouring words."""
    single = [crc32(w) for w in tokens]
    # the hash of "a b" goes on from that of "a"
    return [c % buckets for c in single] + [crc32(b, crc32(b" ", c)) % buckets for c, b in zip(single, tokens[1:])]


def _tokens(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").translate(_LOWER))


def lines_of(docs: DataFrame, text: str) -> DataFrame:
    return docs.select(F.explode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line")).filter("line != ''")


def distinct_lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """k1, k2, times, n_words, buckets (one per feature) of every different line, written out."""
    spark = docs.sparkSession
    small_batches(spark)
    counted = lines_of(docs, text).groupBy("line").agg(F.count(F.lit(1)).alias("times")).select(*line_key("line"), "times", "line")

    def run(batches):
        for b in batches:
            found = [_tokens(x.as_py()) for x in b.column(3)]
            flat = [features(t) for t in found]
            ends = np.cumsum([0] + [len(f) for f in flat])
            values = np.fromiter((x for f in flat for x in f), np.int16, int(ends[-1]))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array([len(t) for t in found], pa.int64()),
                                              pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int16()))],
                                             ["k1", "k2", "times", "n_words", "buckets"])
    return materialize(counted.mapInArrow(run, "k1 long, k2 long, times long, n_words long, buckets array<short>").filter("n_words > 0"), "resample-lines", "zstd")


def crossing(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less the text, with ``cross``: buckets of the pairs that reach over line breaks."""
    spark = docs.sparkSession
    small_batches(spark)
    at = docs.columns.index(text)
    rest = [i for i in range(len(docs.columns)) if i != at]

    def ends(line: bytes):
        """First and last word of a line; every byte of a word beyond ASCII is one of a word."""
        first = _WORD.search(line)
        return first and (first.group(), _WORD.search(line[::-1]).group()[::-1])

    def run(batches):
        for b in batches:
            per = []
            for x in b.column(at):
                raw = (x.as_py() or "").encode("utf-8", "surrogatepass").translate(_LOWER)
                borders = [e for line in raw.split(b"\n") if (e := ends(line))]
                per.append([crc32(n[0], crc32(b" ", crc32(p[1]))) % BUCKETS for p, n in zip(borders, borders[1:])])
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in rest), pa.array(per, pa.list_(pa.int16()))], [*(b.schema.names[i] for i in rest), "cross"])
    schema = docs.drop(text).schema.add("cross", T.ArrayType(T.ShortType()))
    return docs.mapInArrow(run, schema)


def _counted(rows: DataFrame, weighted: bool) -> DataFrame:
    """(bucket, n) of arrays of buckets, counted per task before they are shuffled."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            buckets = b.column(0)
            if weighted:
                lens = np.diff(buckets.offsets.to_numpy())
                np.add.at(total, buckets.flatten().to_numpy(), np.repeat(b.column(1).to_numpy(), lens))
            else:
                total += np.bincount(buckets.flatten().to_numpy(), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["bucket", "n"])
    return rows.mapInArrow(run, "bucket int, n long")


def totals(lines: DataFrame, crossed: DataFrame) -> np.ndarray:
    """Features of a corpus by bucket: those of its lines times their occurrences, and those across lines."""
    ship(lines.sparkSession)
    both = _counted(lines.select("buckets", "times"), True).unionByName(_counted(crossed.select("cross"), False))
    out = np.zeros(BUCKETS, np.int64)
    for r in both.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row per bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + B) / ((s + 1) (T + B)))) by bucket."""
    all_s, all_t = float(corpus.sum()) + BUCKETS, float(target.sum()) + BUCKETS
    return np.floor(1000 * np.log((target + 1.0) * all_s / ((corpus + 1.0) * all_t))).astype(np.int64)


def _line_gains(lines: DataFrame, gain: np.ndarray) -> DataFrame:
    def run(batches):
        for b in batches:
            buckets = b.column(4)
            lens = np.diff(buckets.offsets.to_numpy())     # no line here is without a feature
            sums = np.add.reduceat(gain[buckets.flatten().to_numpy()], np.cumsum(lens) - lens) if b.num_rows else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(sums, pa.int64())], ["k1", "k2", "times", "n_words", "gain"])
    return lines.mapInArrow(run, "k1 long, k2 long, times long, n_words long, gain long")


def weigh(docs: DataFrame, target: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` less the text, with ``res_words``, ``res_features`` and ``res_weight`` (floored mean gain)."""
    docs = without(docs, "res_words", "res_features", "res_weight")
    plain, _ = aside(docs, text)
    own = dict(zip(plain.columns, docs.columns))
    kept = [c for c in plain.columns if c != text]
    # rows get a number where their pairs across lines and the hashes of their lines are written
    keys = F.transform(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), lambda x: x != ""),
                       lambda x: F.struct(*line_key(x)))
    numbered = plain.select(F.struct(F.lit(0).alias("own"), *kept).alias("own"), keys.alias("keys"), F.col(text).alias("text"))
    rows = materialize(crossing(numbered, "text").withColumn("row", F.monotonically_increasing_id()), "resample-rows", "zstd")
    lines = distinct_lines(docs, text)
    corpus = totals(lines, rows)
    goal = target.select(F.col(text).alias("text"))
    gain = gains(corpus, totals(distinct_lines(goal), crossing(goal)))

    scored = materialize(_line_gains(lines, gain), "resample-gains")
    every = scored.agg(F.sum("times")).first()[0] or 0
    hot = scored.filter(F.col("times") * HOT >= every).select("k1", "k2", "n_words", "gain")
    places = rows.select("row", F.explode("keys").alias("k")).select("row", "k.k1", "k.k2")
    here = places.join(F.broadcast(hot.select("*", F.lit(True).alias("hot"))), ["k1", "k2"], "left")
    here = materialize(here.groupBy("row", F.when(F.col("hot").isNull(), F.col("k1")).alias("k1"), F.when(F.col("hot").isNull(), F.col("k2")).alias("k2"))
                       .agg(F.count(F.lit(1)).alias("n"), F.sum("n_words").alias("n_words"), F.sum("gain").alias("gain")), "resample-places")
    cold = (here.filter("k1 IS NOT NULL").select("row", "k1", "k2", "n")
            .join(scored.filter(F.col("times") * HOT < every), ["k1", "k2"])
            .select("row", (F.col("n") * F.col("n_words")).alias("n_words"), (F.col("n") * F.col("gain")).alias("gain")))
    parts = (here.filter("k1 IS NULL AND n_words IS NOT NULL").select("row", "n_words", "gain").unionByName(cold)
             .groupBy("row").agg(F.sum("n_words").alias("n_words"), F.sum("gain").alias("gain")))

    def across(batches):
        for b in batches:
            cross = b.column(2)
            lens = np.diff(cross.offsets.to_numpy())
            to = np.concatenate([[0], np.cumsum(gain[cross.flatten().to_numpy()])])
            end = np.cumsum(lens)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(to[end] - to[end - lens], pa.int64())], ["row", "own", "across"])
    base = rows.select("row", "own", "cross")
    base = base.mapInArrow(across, base.drop("cross").schema.add("across", "long"))
    n = F.coalesce("n_words", F.lit(0)).cast("long")
    whole = F.coalesce("gain", F.lit(0)) + F.col("across")
    some = F.when(n > 0, 2 * n - 1).otherwise(0).cast("long")
    # floors go down: the remainder of a negative sum is taken off first
    mean = F.when(F.col("some") > 0, F.expr("(total - pmod(total, some)) DIV some")).otherwise(0).cast("long")
    got = base.join(parts, "row", "left").select("own", n.alias("n_words"), whole.cast("long").alias("total"), some.alias("some"))
    got = got.select("own.*", F.col("n_words").alias("res_words"), F.col("some").alias("res_features"), mean.alias("res_weight")).drop("own")
    return got.select([F.col(c).alias(own.get(c, c)) for c in got.columns])


def draw(weighed: DataFrame, percent: int = 25, least: int = 20, key: str = "doc_id", seed: str = "7:") -> DataFrame:
    """``weighed`` with ``res_score`` and ``res_rank`` (1, 2, ... by score, null where not drawn).

    Ranks come from a prefix sum over the counts of each score (integers of a bounded range) and an
    order within a score, so no task sorts the corpus.
    """
    weighed = without(weighed, "res_score", "res_rank")
    names = weighed.columns
    plain = weighed.toDF(*[f"own_{i}" for i in range(len(names))])
    col = {c: F.col(f"own_{i}") for i, c in enumerate(names)}
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(seed), F.coalesce(col[key].cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = materialize(plain.select("*", (col["res_weight"] + noise).cast("long").alias("score")), "resample-scores")
    fit = scored.filter(col["res_words"] >= least)
    counts = materialize(fit.groupBy("score").agg(F.count(F.lit(1)).alias("n")), "resample-counts")
    # two steps of prefix sums: 256 scores to a band, and over the bands
    band = F.shiftright("score", 8)
    down = Window.orderBy(F.desc("band")).rowsBetween(Window.unboundedPreceding, -1)
    bands = counts.groupBy(band.alias("band")).agg(F.sum("n").alias("n")).select("band", F.coalesce(F.sum("n").over(down), F.lit(0)).alias("above"))
    inside = Window.partitionBy("band").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    before = (counts.withColumn("band", band).withColumn("over", F.coalesce(F.sum("n").over(inside), F.lit(0)))
              .join(bands, "band").select("score", (F.col("above") + F.col("over")).alias("before")))
    take = (counts.agg(F.sum("n")).first()[0] or 0) * percent // 100
    place = F.row_number().over(Window.partitionBy("score").orderBy(col[key].asc_nulls_last()))
    asked = F.col("before").isNotNull() & (col["res_words"] >= least)
    joined = scored.join(before.filter(F.col("before") < take), "score", "left")
    ranked = joined.filter(asked).withColumn("rank", F.col("before") + place)
    ranked = ranked.unionByName(joined.filter(~asked).withColumn("rank", F.lit(None).cast("long")))
    rank = F.when(F.col("rank") <= take, F.col("rank")).cast("long")
    return ranked.select(*[col[c].alias(c) for c in names], F.col("score").alias("res_score"), rank.alias("res_rank"))


def resample(docs: DataFrame, target: DataFrame, text: str = "text", percent: int = 25, least: int = 20, key: str = "doc_id") -> DataFrame:
    return draw(weigh(docs, target, text), percent, least, key)
