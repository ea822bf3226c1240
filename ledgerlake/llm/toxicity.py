"""Toxic passages by maximum-scoring segment search.

A token's weight is its log-odds between toxic and other labelled documents under an informative
Dirichlet prior (the rates of all labelled documents, ``LEAST_PRIOR`` documents of either label at
least), kept where its likelihood ratio stands ``LEAST_Z`` standard deviations above 0 and lowered by
``CAUTION`` of its own. Tokens are words, and beginnings of words
counted over the words that no longer token explains; one that more clean than toxic documents
have is no mark, and a word takes the longest of its own. All other words weigh ``-DRIFT``, so that a clean text drifts down. One linear scan
finds all maximal scoring segments of a text. By the extreme-value law a clean text of n words
has a segment of score S or more with E = K n exp(-lambda S) expected ones: lambda solves
sum p(w) exp(lambda w) = 1 over the word weights of clean labelled documents, K makes their mean E
one. Segments with E below ``SIGNIFICANT`` are passages; a document's evidence is the sum of
their -ln E (of its best segment where it has none), its score the share of toxic labelled
documents at that evidence, fitted to rise with it.

The fit reads at most ``TRAIN_DOCS`` labelled rows of either label in expectation (chosen by a
hash of the doc_id); every whole text is scored.

Defined cases: null and empty texts have no passage; without rows of both labels nothing has a
passage and the score is the share of toxic rows (0 without rows); documents labelled twice
count as toxic if one label says so, null labels are left out; repeated rows score alike; an
empty table gives no rows; columns named like the added ones (``tox_*``) are replaced, others kept.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import materialize, nullable, small_batches, without

TRAIN_DOCS = 20_000
PREFIXES = range(3, 9)
PRIOR_WEIGHT = 50.0
#: Prior documents of a feature and side at least, whatever the sample's size.
LEAST_PRIOR = 1.0
LEAST_Z = 3.5
CAUTION = 2.0
#: Labelled rows at least behind each step of the calibration.
LEAST_ROWS = 20
DRIFT = 0.2
SIGNIFICANT = 0.05
WORDS = re.compile(r"[^\W_]+")
#: Words whose weights a worker remembers.
REMEMBERED = 500_000


def words_of(text: str | None) -> list[str]:
    return WORDS.findall((text or "").lower())


def features(word: str) -> list[str]:
    """The word and its beginnings, which end in ``*``, from long to short."""
    return [word, *(word[:n] + "*" for n in reversed(PREFIXES) if n < len(word))]


def strength(y1: Column, y0: Column, n1: float, n0: float) -> tuple[Column, Column, Column]:
    """How a feature of y1 of n1 toxic and y0 of n0 clean documents marks toxic ones: z, log-odds, their deviation.

    z is the signed root of the likelihood ratio, so that fewer clean documents never make it less.
    """
    prior = F.greatest(F.lit(PRIOR_WEIGHT) * (y1 + y0) / F.lit(n1 + n0), F.lit(LEAST_PRIOR))
    a, b, rest = y1 + prior, y0 + prior, F.greatest(F.lit(PRIOR_WEIGHT) - prior, F.lit(LEAST_PRIOR))
    odds = F.log(a / (F.lit(n1) - y1 + rest)) - F.log(b / (F.lit(n0) - y0 + rest))

    def part(k, n, share):
        return F.when(k > 0, k * F.log(k / (F.lit(n) * share))).otherwise(F.lit(0.0))
    have = (y1 + y0) / F.lit(n1 + n0)
    lack = 1 - have
    ratio = part(y1, n1, have) + part(y0, n0, have) + part(F.lit(n1) - y1, n1, lack) + part(F.lit(n0) - y0, n0, lack)
    return F.signum(y1 / F.lit(n1) - y0 / F.lit(n0)) * F.sqrt(2 * F.greatest(ratio, F.lit(0.0))), odds, F.sqrt(1 / a + 1 / b)


def segments(at: list[int], weights: list[float], drift: float = DRIFT) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last word, score) of a text, by one scan.

    ``at`` are the positions of words with a positive weight; every other word weighs -drift.
    A candidate keeps the cumulative score before it (left) and after it (right); a new one
    merges backwards while a candidate with a lower left has a right below its own.
    """
    stack: list[list] = []  # [first, last, left, right, number of the nearest candidate with a lower left]
    total, before = 0.0, 0
    for i, w in zip(at, weights):
        total -= drift * (i - before)
        new = [i, i, total, total + w, -1]
        total += w
        before = i + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][2] >= new[2]:
                j = stack[j][4]
            if j < 0 or stack[j][3] >= new[3]:
                new[4] = j
                stack.append(new)
                break
            new = [stack[j][0], new[1], stack[j][2], new[3], -1]
            del stack[j:]
    return [(s[0], s[1], s[3] - s[2]) for s in stack]


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    rate: float = 1.0       # lambda
    scale: float = 1.0      # K
    prior: float = 0.0      # share of toxic rows
    levels: list[float] = field(default_factory=list)     # evidence ...
    posterior: list[float] = field(default_factory=list)  # ... and the share of toxic rows there

    def weight(self, word: str) -> float:
        return next((self.weights[f] for f in features(word) if f in self.weights), 0.0)

    def expected(self, n: int, score: float) -> float:
        return self.scale * max(1, n) * math.exp(-min(700.0, self.rate * score))

    def passages(self, at: list[int], weights: list[float], n: int) -> list[tuple[int, int, float, float]]:
        """Significant segments: first and last word, score, E."""
        found = [(a, b, s, self.expected(n, s)) for a, b, s in segments(at, weights)]
        return [x for x in found if x[3] < SIGNIFICANT]

    def evidence(self, found: list, at: list[int], weights: list[float], n: int) -> float:
        """The sum of -ln E of the passages, or that of the best segment where there is none."""
        if found:
            return sum(-math.log(max(x[3], 1e-300)) for x in found)
        return -math.log(self.expected(n, max((s for _, _, s in segments(at, weights)), default=0.0)))

    def score(self, evidence: float) -> float:
        """Posterior of label 1 at this evidence."""
        return float(np.interp(evidence, self.levels, self.posterior)) if self.levels else self.prior


def rising(level: list[float], toxic: list[float], clean: list[float]) -> tuple[list[float], list[float]]:
    """Share of toxic rows by level, made to rise by pooling neighbours that do not, then strictly.

    Half a row of each label is added to a pool, so no share is 0 or 1.
    """
    pools: list[list] = []
    for x, t, c in zip(level, toxic, clean):
        if pools and pools[-1][1] + pools[-1][2] < LEAST_ROWS:
            pools[-1] = [pools[-1][0] + [x], pools[-1][1] + t, pools[-1][2] + c]
        else:
            pools.append([[x], t, c])
        while len(pools) > 1 and pools[-2][1] * (pools[-1][1] + pools[-1][2]) >= pools[-1][1] * (pools[-2][1] + pools[-2][2]):
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2] + last[2]]
    share, at = [], []
    for xs, t, c in pools:
        share.append((t + 0.5) / (t + c + 1))
        at.append(sum(xs) / len(xs))
    share = list(np.maximum.accumulate(share))
    # straight lines between the pools; beyond the last the share goes on towards 1
    return [at[0] - 10, *at, at[-1] + 40], [share[0] / 2, *share, (share[-1] + 1) / 2]


def weigher(model: Model):
    """texts -> (positions, weights, number of words) per text, with word weights remembered."""
    known: dict[str, float] = {}

    def run(text: str | None):
        words = words_of(text)
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = model.weight(w)
        row = np.fromiter(map(known.__getitem__, words), float, len(words))
        at = np.flatnonzero(row > 0)
        return at.tolist(), row[at].tolist(), len(words)
    return run


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    small_batches(docs.sparkSession)
    marks = materialize(labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id")
                        .agg((F.max("toxic") > 0).cast("int").alias("toxic")), "toxic-labels")
    sizes = marks.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    share = F.xxhash64(F.col("doc_id").cast("string"), F.lit(13)) / F.lit(2.0 ** 64) + 0.5
    chosen = marks.join(F.broadcast(sizes), "toxic").filter(share <= F.lit(float(bound)) / F.col("n")).select("doc_id", "toxic")
    # twice the bound of ids: they go to the texts, whatever the size of either table
    sample = materialize(docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("toxic", "text"), "toxic-sample")
    of = {r["toxic"]: r["n"] for r in sizes.collect()}
    total = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    model = Model(prior=of.get(1, 0) / max(1, sum(of.values())))
    if len(total) < 2:
        return model

    def count(batches):
        from collections import Counter
        seen = Counter()
        for b in batches:
            for toxic, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen.update((toxic, w) for w in set(words_of(text)))
        keys = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array([k[1] for k in keys], pa.string()), pa.array([k[0] for k in keys], pa.int32()),
                                          pa.array([seen[k] for k in keys], pa.int64())], ["word", "toxic", "n"])

    n1, n0 = float(total[1]), float(total[0])
    side = lambda k: F.coalesce(F.sum(F.when(F.col("toxic") == k, F.col("n"))), F.lit(0))
    words = materialize(sample.mapInArrow(count, "word string, toxic int, n long").groupBy("word")
                        .agg(side(1).alias("y1"), side(0).alias("y0")), "toxic-words")

    def strong(counts: DataFrame) -> dict[str, float]:
        """Weights of the features that mark toxic documents; fewer than the words of the sample's toxic rows."""
        y1, y0 = F.least(F.col("y1"), F.lit(n1)), F.least(F.col("y0"), F.lit(n0))
        z, odds, sd = strength(y1, y0, n1, n0)
        rows = (counts.filter(F.col("y1") > 1).filter(y1 * F.lit(of[1] / n1) > y0 * F.lit(of[0] / n0))
                .select("feature", z.alias("z"), odds.alias("odds"), sd.alias("sd"))
                .filter((F.col("z") >= LEAST_Z) & (F.col("odds") > CAUTION * F.col("sd"))))
        return {r[0]: r[1] for r in rows.select("feature", F.col("odds") - CAUTION * F.col("sd")).collect()}

    model.weights = strong(words.withColumnRenamed("word", "feature"))
    words = words.join(F.broadcast(_names(words, model.weights, "word")), "word", "left_anti")
    for n in reversed(PREFIXES):  # a beginning counts the words that no longer feature explains
        start = words.filter(F.length("word") > n).withColumn("feature", F.concat(F.substring("word", 1, n), F.lit("*")))
        found = strong(start.groupBy("feature").agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")))
        model.weights |= found
        words = (words.withColumn("feature", F.when(F.length("word") > n, F.concat(F.substring("word", 1, n), F.lit("*"))))
                 .join(F.broadcast(_names(words, found, "feature")), "feature", "left_anti").drop("feature"))
    weights = model.weights

    def observe(batches):
        run = weigher(Model(weights))
        for b in batches:
            got = [(t, *run(x)) for t, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.list_(pa.int32())),
                                              pa.array([g[2] for g in got], pa.list_(pa.float64())), pa.array([g[3] for g in got], pa.int64())],
                                             ["toxic", "at", "w", "n"])

    seen = materialize(sample.mapInArrow(observe, "toxic int, at array<int>, w array<double>, n long"), "toxic-hits")
    clean = seen.filter("toxic = 0")
    words = clean.agg(F.sum("n")).first()[0] or 0
    hits = {r[0]: r[1] for r in clean.select(F.explode("w").alias("w")).groupBy(F.round("w", 1).alias("w")).count().collect()}
    mean = float(np.mean(list(weights.values()))) if weights else 1.0
    hits[round(mean, 1)] = hits.get(round(mean, 1), 0) + 1  # an unseen hit is not an impossible one
    model.rate = solve_rate(hits, max(1, words))
    rate = model.rate

    def calibrate(batches):
        for b in batches:
            got = [(t, n, max((s for _, _, s in segments(at, w)), default=0.0)) for t, at, w, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64()),
                                              pa.array([g[2] for g in got], pa.float64())], ["toxic", "n", "best"])

    best = seen.select("toxic", "at", "w", "n").mapInArrow(calibrate, "toxic int, n long, best double")
    e = F.greatest(F.col("n"), F.lit(1)) * F.exp(-F.least(F.lit(700.0), F.lit(rate) * F.col("best")))
    model.scale = 1 / max(1e-12, best.withColumn("e", e).filter("toxic = 0").agg(F.avg("e")).first()[0] or 1.0)

    def weighed(batches):
        for b in batches:
            got = [(t, round(4 * model.evidence(model.passages(at, w, n), at, w, n))) for t, at, w, n in zip(*(c.to_pylist() for c in b.columns))]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.int64())], ["toxic", "level"])

    levels = seen.select("toxic", "at", "w", "n").mapInArrow(weighed, "toxic int, level long").groupBy(
        F.least("level", F.lit(400)).alias("level")).agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))
    rows = sorted(levels.collect())  # quarters of a unit of evidence up to 100
    model.levels, model.posterior = rising([r[0] / 4 for r in rows], [r[1] * of[1] / n1 for r in rows], [r[2] * of[0] / n0 for r in rows])
    return model


def _names(like: DataFrame, names, column: str) -> DataFrame:
    return like.sparkSession.createDataFrame([(x,) for x in names], f"{column} string")


def solve_rate(hits: dict[float, int], words: int) -> float:
    """The positive lambda with sum p(w) exp(lambda w) = 1; rest of the words weigh -DRIFT."""
    rest = max(1, words - sum(hits.values()))
    n = rest + sum(hits.values())

    def excess(x: float) -> float:
        return rest / n * math.exp(-x * DRIFT) + sum(c / n * math.exp(min(700.0, x * w)) for w, c in hits.items()) - 1
    low, high = 1e-6, 1e-3
    while excess(high) < 0 and high < 100:
        low, high = high, high * 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return low


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``tox_score``, ``tox_words`` and ``tox_passages`` (first, last word, score, e)."""
    small_batches(docs.sparkSession)
    docs = without(docs, "tox_score", "tox_words", "tox_passages")
    at_text = docs.columns.index(text)
    passage = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType()),
                                        T.StructField("score", T.DoubleType()), T.StructField("e", T.DoubleType())]))
    kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32()), ("score", pa.float64()), ("e", pa.float64())]))

    def run(batches):
        weigh = weigher(model)
        for b in batches:
            scores, sizes, found = [], [], []
            for t in b.column(at_text).to_pylist():
                at, w, n = weigh(t)
                hits = model.passages(at, w, n)
                scores.append(model.score(model.evidence(hits, at, w, n)))
                sizes.append(n)
                found.append([dict(zip(("first", "last", "score", "e"), h)) for h in hits])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64()), pa.array(sizes, pa.int64()), pa.array(found, kind)],
                                             [*b.schema.names, "tox_score", "tox_words", "tox_passages"])

    schema = nullable(docs.schema).add("tox_score", "double").add("tox_words", "long").add(T.StructField("tox_passages", passage))
    return docs.mapInArrow(run, schema)
