"""License scans by diagonal voting.

A template is a short text with a label. Every run of ``k`` words of a document (its hash) is
joined with the places of the same run in the templates; a hit at document word ``i`` and
template word ``j`` votes for the diagonal ``i - j``, on which a verbatim copy puts all its hits.
Votes are added up by diagonal, neighbouring diagonals (a word added, lost or changed shifts the
rest of a copy by little) are merged, and each merged span is verified: the longest chain of hits
that rises in both texts must cover a share of the template's words; of overlapping spans the one
that covers most stays. Exact templates are phrases of which only whole, verbatim copies count:
every one is a place of its own.

The join sends the templates to the texts. Their size is bounded by ``MOST_GRAMS`` runs; a larger
set is refused. What is shuffled afterwards are hits, never texts. Hits are compared word by word
where they arise, so equal hashes of different words are no hit.

Defined cases: null and empty texts have no word and no span; texts shorter than ``k`` words have
no hit; ties between templates go to the first label in order; repeated rows are scanned each on
its own; an empty table gives no rows; all columns but the text are kept, and those named like an
added one (``lic_words``, ``lic_spans``, ``lic_score``) are replaced.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import aside, materialize, ship, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of one hash, distance of diagonals that are merged, share of a template that must be covered.
K, NEAR, SHARE = 2, 4, 0.6
#: Runs of all templates together, at most: some MB once sent to every executor.
MOST_GRAMS = 200_000

# FIXED VALUES: phrases and labels of the base scan.
PHRASES = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# FIXED VALUES: public wordings of license notices, for the labels of the method.
NOTICES = [
    ("agpl", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution license"),
    ("cc-by", "licensed under cc by 4 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased (null: none)."""
    lower = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))


def grams(tokens: Column, k: int) -> Column:
    """Hashes of all runs of ``k`` words, in order."""
    n = F.size(tokens) - k
    rolling = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(k)]))
    return F.when(n >= 0, rolling)


def templates(spark, exact=PHRASES, similar=NOTICES, k: int = K) -> DataFrame:
    """One row per run of every template: number, label, exact, words, size, place, hash."""
    rows = [(i, label, flag, text) for i, (label, text, flag) in enumerate([(*t, True) for t in exact] + [(*t, False) for t in similar])]
    df = spark.createDataFrame(rows, "template int, label string, exact boolean, template_text string")
    df = df.withColumn("template_words", words(F.col("template_text"))).drop("template_text")
    short = [r[0] for r in df.filter(F.size("template_words") < k).select("template").collect()]
    if short:
        raise ValueError(f"templates of fewer than {k} words: {short}")
    return df.select("*", F.size("template_words").alias("template_size"), F.posexplode(grams(F.col("template_words"), k)).alias("template_at", "gram"))


def hits(docs: DataFrame, table: DataFrame, text: str = "text", k: int = K) -> DataFrame:
    """Rows (scan_row, at, template, ...) of all shared runs, and one row with ``at`` 0 or null per document.

    Written out: the row numbers of one scan serve all later steps.
    """
    if table.count() > MOST_GRAMS:
        raise ValueError(f"templates have more than {MOST_GRAMS} runs of {k} words")
    kept = [c for c in docs.columns if c != text]
    read = docs.select(F.struct(F.lit(0).alias("own"), *[F.col(c) for c in kept]).alias("scan_own"), words(F.col(text)).alias("scan_words"))
    read = read.select("*", F.monotonically_increasing_id().alias("scan_row"), grams(F.col("scan_words"), k).alias("scan_grams"))
    runs = read.select("scan_row", "scan_own", "scan_words", F.posexplode_outer("scan_grams").alias("at", "gram"))
    same = F.slice("scan_words", F.col("at") + 1, k) == F.slice("template_words", F.col("template_at") + 1, k)
    found = runs.join(F.broadcast(table), "gram", "left")
    found = found.withColumn("hit", F.coalesce(same, F.lit(False))).withColumn("first", F.coalesce(F.col("at"), F.lit(0)) == 0)
    found = found.filter(F.col("hit") | F.col("first"))
    return materialize(found.select(
        "scan_row", "at", "hit", "template", "label", "exact", "template_size", "template_at",
        F.when(F.col("first"), F.col("scan_own")).alias("scan_own"), F.when(F.col("first"), F.size("scan_words")).cast("long").alias("lic_words")), "license-hits")


def chain(pairs: list[tuple[int, int]], k: int) -> tuple[int, int, int]:
    """(template words covered, first, last document word) of the longest chain that rises in both."""
    tails, ends, before = [], [], [-1] * len(pairs)
    pairs.sort(key=lambda p: (p[0], -p[1]))
    for i, (_, j) in enumerate(pairs):
        at = bisect_left(tails, j)
        before[i] = ends[at - 1] if at else -1
        tails[at:at + 1], ends[at:at + 1] = [j], [i]
    covered, at, last = set(), ends[-1], pairs[ends[-1]][0] + k - 1
    while at >= 0:
        covered.update(range(pairs[at][1], pairs[at][1] + k))
        first, at = pairs[at][0], before[at]
    return len(covered), first, last


def _spans(found: DataFrame, k: int, near: int, share: float) -> DataFrame:
    """Verified spans: scan_row, template, label, exact, first_word, last_word, coverage."""
    key = ["scan_row", "template"]
    votes = (found.filter("hit").withColumn("diagonal", F.col("at") - F.col("template_at"))
             .groupBy(*key, "diagonal").agg(F.first("label").alias("label"), F.first("exact").alias("exact"), F.first("template_size").alias("size"),
                                            F.count(F.lit(1)).alias("votes"), F.sort_array(F.collect_list(F.struct("at", "template_at"))).alias("pairs")))
    # a phrase must have every vote on one diagonal
    whole = votes.filter(F.col("exact") & (F.col("votes") == F.col("size") - k + 1)).select(
        *key, "label", "exact", F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("size") - 1).cast("long").alias("last_word"),
        F.lit(1.0).alias("coverage"))
    # neighbouring diagonals are one group, which begins where the gap to the one before is wide
    order = Window.partitionBy(*key).orderBy("diagonal")
    rest = votes.filter(~F.col("exact")).withColumn("new", (F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"))
    rest = rest.withColumn("group", F.sum(F.coalesce("new", F.lit(0))).over(order))
    rest = (rest.groupBy(*key, "group")
            .agg(F.first("label").alias("label"), F.first("size").alias("size"), F.sum("votes").alias("votes"),
                 F.max(F.struct("votes", -F.col("diagonal"))).alias("best"), F.flatten(F.collect_list("pairs")).alias("pairs"))
            .filter(F.col("votes") >= share * (F.col("size") - k + 1) / 2))
    # the strongest diagonal of a group places the copy; hits farther off belong to others
    start = -F.col("best")["col2"]
    place = rest.withColumn("pairs", F.filter("pairs", lambda p: (p["at"] >= start - F.col("size") / 2) & (p["at"] <= start + F.col("size") * 1.5)))
    place = place.select(*key, "label", "size", "pairs")

    def verify(batches):
        for b in batches:
            out = [[], []]
            for row, many in zip(b.column(0).to_pylist(), b.column(1)):
                found = []
                for t in many.as_py():
                    n, first, last = chain([(p["at"], p["template_at"]) for p in t["pairs"]], k)
                    if n >= share * t["size"]:
                        found.append((-n, -n / t["size"], t["label"], t["template"], first, last))
                kept = []
                for s in sorted(found):     # by words covered; a span that meets one already kept goes
                    at = bisect_left(kept, (s[4],))
                    if not (at < len(kept) and kept[at][0] <= s[5] or at and kept[at - 1][1] >= s[4]):
                        insort(kept, (s[4], s[5], s[2], s[3], -s[1]))
                out[0] += [row] * len(kept)
                out[1] += kept
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), *(pa.array([s[i] for s in out[1]], kind) for i, kind in
                                              ((3, pa.int32()), (2, pa.string()), (0, pa.int64()), (1, pa.int64()), (4, pa.float64())))],
                                             ["scan_row", "template", "label", "first_word", "last_word", "coverage"])

    ship(found.sparkSession)
    per = place.groupBy("scan_row").agg(F.collect_list(F.struct("template", "label", "size", "pairs")).alias("many"))
    similar = per.mapInArrow(verify, "scan_row long, template int, label string, first_word long, last_word long, coverage double")
    return whole.unionByName(similar.withColumn("exact", F.lit(False)))


def scan(docs: DataFrame, table: DataFrame | None = None, text: str = "text", k: int = K, near: int = NEAR, share: float = SHARE) -> DataFrame:
    """All columns of ``docs`` but the text, with what the templates found in it:

    ``lic_words`` (words of the text), ``lic_spans`` (verified spans in the order of their first
    word: first_word, last_word, label, exact, template, coverage) and ``lic_score`` (best coverage).
    """
    docs = without(docs, "lic_words", "lic_spans", "lic_score")
    plain, _ = aside(docs, text)
    found = hits(plain, templates(docs.sparkSession, k=k) if table is None else table, text, k)
    whole = found.filter(F.col("scan_own").isNotNull()).dropDuplicates(["scan_row"]).select("scan_row", "scan_own", "lic_words")
    spans = (_spans(found, k, near, share).groupBy("scan_row")
             .agg(F.sort_array(F.collect_list(F.struct("first_word", "last_word", "label", "exact", "template", "coverage"))).alias("lic_spans"),
                  F.max("coverage").alias("lic_score")))
    none = F.from_json(F.lit("[]"), spans.schema["lic_spans"].dataType)
    got = whole.join(spans, "scan_row", "left").select(
        "scan_own.*", "lic_words", F.coalesce("lic_spans", none).alias("lic_spans"), F.coalesce("lic_score", F.lit(0.0)).alias("lic_score")).drop("own")
    own = {a: c for a, c in zip(plain.columns, docs.columns)}
    return got.select([F.col(c).alias(own.get(c, c)) for c in got.columns])
