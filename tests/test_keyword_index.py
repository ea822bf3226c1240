"""Keyword rules through the gram index against the loop over every keyword."""

import random

from ledgerlake.operators import categorize as G
from ledgerlake.operators import keyword_index as KI


def _both(spark, texts, dictionary, patterns):
    descs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, desc string")
    by_index = KI.rule_scores(descs, KI.dictionary_rows(spark, dictionary), patterns=patterns)
    by_loop = G.rule_scores(descs, dictionary=dictionary, patterns=patterns)
    cols = ["id", "desc", "rule_category", "rule_confidence"]
    assert by_index.columns == cols
    return ({r["id"]: tuple(r) for r in df.select(cols).collect()} for df in (by_index, by_loop))


def test_same_scores_as_the_loop(spark):
    rnd = random.Random(7)
    syllables = ["ka", "fé", "shop", "b", "uber", "net", "o", "gas", "station", "x1", "日本"]
    word = lambda: "".join(rnd.choices(syllables, k=rnd.randint(1, 3)))
    dictionary = {c: [" ".join(word() for _ in range(rnd.choice((1, 1, 1, 2)))) for _ in range(40)] for c in ("zeta", "alpha", "mid")}
    dictionary["mid"] += dictionary["alpha"][:5] + ["b", "shop", "shop", "日"]
    texts = [" ".join(word() for _ in range(rnd.randint(1, 6))) for _ in range(150)]
    texts += [dictionary["zeta"][0], "", "   ", "shop, shop (shop)!", "hot " * 500, texts[0], "no match at all: qqq"]
    got, want = _both(spark, texts, dictionary, {"alpha": "uber|gas", "zeta": r"station\b"})
    assert got == want and len(got) == len(texts) and {"zeta", "alpha", "mid", "other"} <= {r[2] for r in got.values()}


def test_nulls_blank_keywords_and_empty_tables(spark):
    descs = spark.createDataFrame([(1, None), (2, "coffee shop")], "id int, desc string")
    keys = spark.createDataFrame([("food", 0, "coffee"), ("food", 0, None), ("food", 0, "  "), ("food", 0, "coffee")], "category string, place int, keyword string")
    got = {r["id"]: (r["rule_category"], r["rule_confidence"]) for r in KI.rule_scores(descs, keys, patterns={}).collect()}
    assert got == {1: ("other", 0.0), 2: ("food", 0.7)}   # twice 1.5 in the text and 2 for the token
    assert KI.rule_scores(descs.limit(0), keys, patterns={}).count() == 0
    assert {r["rule_category"] for r in KI.rule_scores(descs, keys.limit(0), patterns={}).collect()} == {"other"}


def test_pairs_are_those_of_a_nested_loop(spark):
    rnd = random.Random(3)
    a, b = ({"".join(rnd.choices("abc", k=rnd.randint(1, n))) for _ in range(120)} for n in (4, 9))
    frames = [spark.createDataFrame([(x,) for x in xs] * 2 + [("",)], "s string") for xs in (a, b)]
    got = [tuple(r) for r in KI.containments(*frames).collect()]
    assert sorted(got) == sorted((x, y) for x in a for y in b if x in y)
