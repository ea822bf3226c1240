import random
import re

import pytest

from ledgerlake.llm import licenses as li
from ledgerlake.llm.queries import op11_license_scan
from tests.llm.helpers import empty, odd, prose

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def base(text):
    """(places, labels) of the base phrases, by trying every word."""
    w = tokens(text)
    found = [(i, label) for label, phrase in li.PHRASES for i in range(len(w)) if w[i:i + len(phrase.split())] == phrase.split()]
    return sorted(i for i, _ in found), sorted({label for _, label in found})


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = li.scan(docs).collect()
    assert len(got) == len(rows)
    texts = {}
    for d, t in rows:
        texts.setdefault(d, []).append((len(tokens(t)), base(t)))
    for r in got:
        exact = [s for s in r["lic_spans"] if s["exact"]]
        mine = (r["lic_words"], (sorted(s["first_word"] for s in exact), sorted({s["label"] for s in exact})))
        assert mine in texts[r["doc_id"]]
        assert 0 <= r["lic_score"] <= 1 and (not exact or r["lic_score"] == 1)
    return {r["doc_id"]: {s["label"] for s in r["lic_spans"]} for r in got}


def test_places_against_every_word(spark):
    rnd = random.Random(4)
    bits = ["MIT", "License", "the", "apache", "license,", "General", "PUBLIC", "license", "gnu", "mit-license", "Ärzte", "x9"]
    rows = [(i, " ".join(rnd.choice(bits) for _ in range(rnd.randrange(0, 40)))) for i in range(150)]
    rows += [(200, "mit license " * 5000), (201, "license mit"), (202, "mit"), (203, "MIT\n\nLicense"), (204, "mit license mit license"), (205, "general public general public license")]
    labels = check(spark, rows)
    assert labels[200] == labels[203] == {"mit"} and "gpl" in labels[205] and not labels[202]


def test_damaged_notices_are_found_and_clean_texts_left_alone(spark):
    rnd, rows, want = random.Random(6), [], {}
    for n, (label, text) in enumerate(li.NOTICES):
        w = text.split()
        for m, change in enumerate(["none", "lost", "added", "swapped"]):
            x = list(w)
            if len(w) >= 8 and change != "none":
                at = rnd.randrange(2, len(w) - 2)
                x[at:at + 1] = {"lost": [], "added": [x[at], "really"], "swapped": ["foo"]}[change]
            d = n * 10 + m
            rows.append((d, prose(d, 60) + ". " + " ".join(x).title() + ". " + prose(d + 1, 40)))
            want[d] = label
    rows += [(1000 + i, prose(i, 200)) for i in range(30)] + [(2000, "the of the of the of the software " * 500), (2001, "this is the subject of a work to use under the terms " * 50)]
    labels = check(spark, rows)
    assert all(want[d] in labels[d] for d in want)
    assert not any(labels[1000 + i] for i in range(30)) and not labels[2000] and not labels[2001]


def test_overlapping_notices_keep_the_best(spark):
    labels = check(spark, [(1, "Licensed under CC BY-NC 4.0."), (2, "Licensed under CC BY 4.0."), (3, "Licensed under CC BY 4.0. Other text in between them all. Released under the MIT License.")])
    assert labels == {1: {"cc-by-nc"}, 2: {"cc-by"}, 3: {"cc-by", "mit"}}


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "5 AS lic_words", "'s' AS scan_row", "1 AS gram")
    got = li.scan(docs).collect()
    assert len(got) == 12 and set(got[0].asDict()) == {"doc_id", "lang", "source", "n_chars", "scan_row", "gram", "lic_words", "lic_spans", "lic_score"}
    assert all(r["lic_words"] == 0 and r["lic_spans"] == [] and r["lic_score"] == 0 for r in got if r["doc_id"] in (1, 2, 3))
    assert {r["scan_row"] for r in got} == {"s"} and li.scan(empty(spark)).count() == 0
    with pytest.raises(ValueError):
        li.templates(spark, [("x", "one")], [])


def test_query_against_brute_force(spark):
    d = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in op11_license_scan(spark, d).collect()}
    for doc in spark.read.parquet(f"{d}/documents.parquet").collect():
        places, labels = base(doc["text"])
        r = got.pop(doc["doc_id"])
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(tokens(doc["text"])), len(places), ",".join(labels))
        assert (r["first_word"], r["last_word"]) == ((places[0], places[-1]) if places else (None, None))
        assert set(labels) <= set(r["labels"].split(","))
    assert not got
