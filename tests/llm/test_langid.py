import itertools

import numpy as np
import pytest

from ledgerlake.llm import langid
from tests.llm.helpers import empty, odd


def test_forward_sums_all_segmentations():
    table = langid.pieces(langid.VOCABULARY)
    rnd = np.random.default_rng(0)
    probs = rnd.random((len(table.texts) + 1, 2))
    probs[0] = 0
    number = {t: i + 1 for i, t in enumerate(table.texts)}

    def brute(word, lang):
        total = 0.0
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, last = [], 0
            for i, c in enumerate(cuts, 1):
                if c:
                    parts.append(word[last:i])
                    last = i
            parts.append(word[last:])
            p = 1.0
            for x in parts:
                p *= probs[number[x], lang] if x in number else langid.UNKNOWN if len(x) == 1 else 0.0
            total += p
        return np.log10(total)
    for word in ["▁house", "▁été", "▁漢字", "▁straße", "a"]:
        codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
        assert langid.forward(table, probs, codes)[0] == pytest.approx([brute(word, 0), brute(word, 1)])
        counts = langid.expected(table, probs[:, 0], codes, np.ones(1))
        assert (counts * np.array([0] + [len(t) for t in table.texts])).sum() <= len(word) + 1e-9


def test_held_out_accuracy(spark):
    from ledgerlake.llm.queries import op10_language_id
    got = op10_language_id(spark, "/root/testdata/sf0.001")
    lang = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "lang")
    rows = got.filter("held_out").join(lang, "doc_id").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in rows) >= 0.97 * len(rows) and got.count() == 200


def test_odd_rows(spark):
    docs = odd(spark).selectExpr("*", "'x' AS lang_pred")
    model = langid.fit(docs.select("text", "lang"))
    got = langid.predict(docs, model).collect()
    assert len(got) == 12 and all(r["lang_pred"] == "und" and r["lang_score"] == 0 for r in got if not (r["text"] or "").strip())
    assert all(0 <= r["lang_score"] <= 1 for r in got)
    assert {r["lang_pred"] for r in got if r["doc_id"] == 8} == {"de"}
    none = langid.fit(empty(spark).select("text", "lang"))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    assert langid.predict(empty(spark), model).count() == 0
    assert langid.accepted(odd(spark), model).columns == odd(spark).columns


def test_copies_neither_fill_nor_empty_the_sample(spark):
    rows = [(f"copied text {i % 3}", "xx") for i in range(900)] + [(f"own text {i}", "yy") for i in range(500)] + [("often", "yy")] * 300 + [("lone", "zz")]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(4)
    for bound in (1, 2, 50):
        got = [tuple(r) for r in langid.sampled(labelled, bound).collect()]
        assert len(got) == len(set(got)) == min(bound, 3) + min(bound, 501) + 1 and {g[0] for g in got} == {"xx", "yy", "zz"}
    assert langid.fit(labelled, bound=2)[0] == ["xx", "yy", "zz"]


def test_long_pieces_and_long_runs_are_not_cut(monkeypatch):
    table = langid.pieces(langid.VOCABULARY)
    rnd = np.random.default_rng(1)
    probs = rnd.random((len(table.texts) + 1, 2)) / 100
    probs[0] = 0
    number = {t: i + 1 for i, t in enumerate(table.texts)}
    longest = max(table.texts, key=len)
    assert len(longest) == table.longest == 16

    def brute(word, lang):
        """Chances of all beginnings, exactly, then of the whole."""
        from fractions import Fraction
        alpha = [Fraction(1)]
        for j in range(1, len(word) + 1):
            total = Fraction(0)
            for i in range(j):
                x = word[i:j]
                p = probs[number[x], lang] if x in number else langid.UNKNOWN if j - i == 1 else 0.0
                total += alpha[i] * Fraction(p)
            alpha.append(total)
        # a fraction's logarithm without a float of its own size
        return (alpha[-1].numerator.bit_length() - alpha[-1].denominator.bit_length()) * np.log10(2), alpha[-1]

    for word in [longest, "▁" + "straßenbahnhaltestelle" * 5, "漢字仮名" * 30]:
        codes = np.array([[ord(c) for c in word]], dtype=np.uint32)
        for monkey in (4096, 7):
            monkeypatch.setattr(langid, "BLOCK", monkey)
            for got in (langid.forward(table, probs, codes)[0], langid.run_forward(table, probs, codes[0])):
                for lang in (0, 1):
                    rough, exact = brute(word, lang)
                    shift = round(rough)
                    assert got[lang] == pytest.approx(shift + np.log10(float(exact / 10 ** shift if shift >= 0 else exact * 10 ** -shift)))
        monkeypatch.setattr(langid, "RUN", 10 ** 9)
        short = codes[:, :40]   # the unscaled way underflows beyond
        one = langid.expected(table, probs[:, 0], short, np.ones(1))
        monkeypatch.setattr(langid, "RUN", 64)
        assert np.allclose(one, langid.run_expected(table, probs[:, 0], short[0]))


def test_slices_keep_rows_and_words(monkeypatch):
    texts = ["a b c", None, "", "d " * 23, "1 2", "e"]
    for size in (1, 3, 10, 1000):
        monkeypatch.setattr(langid, "SLICE", size)
        parts = list(langid.slices(texts))
        assert all(len(w) <= size for _, w in parts)
        assert [(i, w) for r, ws in parts for i, w in zip(r, ws)] == [(i, "▁" + w) for i, t in enumerate(texts) for w in (t or "").split() if w.isalpha()]


def test_number_signs_are_no_letters(spark):
    docs = spark.createDataFrame([(1, "½ ² Ⅷ 12 ٣"), (2, "haus"), (3, "x" * 200_000)], "doc_id long, text string")
    model = langid.fit(spark.createDataFrame([("das haus", "de"), ("the house", "en")], "text string, lang string"))
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.predict(docs, model).collect()}
    assert got[1] == ("und", 0) and got[2][0] == "de" and got[3][0] in ("de", "en") and 0 <= got[3][1] <= 1
