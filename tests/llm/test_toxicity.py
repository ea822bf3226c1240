from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.llm import toxicity
from tests.llm.helpers import empty, odd


@given(st.lists(st.sampled_from([0.0, 0.0, 0.0, 0.3, 1.0, 2.5]), max_size=60))
def test_segments_are_the_maximal_ones(weights):
    """All maximal scoring subsequences, against the definition by repeated best segments."""
    scores = [w if w > 0 else -toxicity.DRIFT for w in weights]

    def brute(lo, hi):
        best = None
        for i in range(lo, hi):
            total = 0.0
            for j in range(i, hi):
                total += scores[j]
                if total > 1e-9 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and j - i < best[1] - best[0])):
                    best = (i, j, total)
        if best is None:
            return []
        return [*brute(lo, best[0]), best, *brute(best[1] + 1, hi)]
    at = [i for i, w in enumerate(weights) if w > 0]
    got = toxicity.segments(at, [weights[i] for i in at])
    want = brute(0, len(scores))
    assert abs(sum(s for *_, s in got) - sum(s for *_, s in want)) < 1e-6
    assert max((s for *_, s in got), default=0) == max((s for *_, s in want), default=0) or abs(max(s for *_, s in got) - max(s for *_, s in want)) < 1e-9


def test_rate_solves_its_equation():
    import math
    hits, words = {2.0: 30, 4.0: 5}, 100_000
    x = toxicity.solve_rate(hits, words)
    assert abs((words - 35) / words * math.exp(-x * toxicity.DRIFT) + sum(c / words * math.exp(x * w) for w, c in hits.items()) - 1) < 1e-3


def test_held_out_quality(spark):
    from ledgerlake.llm.queries import op3_toxicity
    d = "/root/testdata/sf0.01"
    rows = op3_toxicity(spark, d).join(spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"), "doc_id").filter("held_out").collect()
    hit = sum(r["predicted"] and r["toxic"] for r in rows)
    assert hit >= 0.75 * sum(r["toxic"] for r in rows) and hit >= 0.75 * sum(r["predicted"] for r in rows)


def test_odd_rows(spark):
    labels = spark.createDataFrame([(4, 1), (4, 0), (8, 0), (6, None), (None, 1)], "doc_id long, toxic int")
    for train in (labels, labels.limit(0)):
        model = toxicity.fit(odd(spark), train)
        got = toxicity.score(odd(spark).selectExpr("*", "1 AS tox_score"), model).collect()
        assert len(got) == 12 and all(0 <= r["tox_score"] <= 1 for r in got)
        assert all(not r["tox_passages"] for r in got if not r["text"])
    assert toxicity.score(empty(spark), model).count() == 0


def test_passages_are_found():
    model = toxicity.Model(weights={"vile": 4.0, "nas*": 3.0}, rate=2.0, scale=0.01, levels=[-10.0, 3.0, 50.0], posterior=[0.01, 0.5, 0.99])
    run = toxicity.weigher(model)
    at, w, n = run("clean words here " * 20 + "vile nasty vile " + "more clean words " * 20)
    found = model.passages(at, w, n)
    assert [(a, b) for a, b, *_ in found] == [(60, 62)]
    assert model.score(model.evidence(found, at, w, n)) > 0.5 > model.score(model.evidence([], [], [], 100))


def test_fewer_clean_documents_never_weaken_a_mark(spark):
    from pyspark.sql import functions as F
    at = {(200, 20_000, 20_000), (50, 500, 20_000), (20, 300, 2700), (3, 300, 2700), (5, 100, 20_000), (400, 500, 500)}
    for y1, n1, n0 in at:
        z, odds, sd = toxicity.strength(F.lit(float(y1)), F.col("id").cast("double"), float(n1), float(n0))
        rows = spark.range(40).select(z.alias("z"), (odds - toxicity.CAUTION * sd).alias("w")).collect()
        rows = [r for r in rows if r["z"] > 0]
        assert rows[0]["z"] >= toxicity.LEAST_Z and rows[0]["w"] > 0
        assert all(a["z"] >= b["z"] and a["w"] >= b["w"] for a, b in zip(rows, rows[1:]))


def test_a_word_of_toxic_documents_only_is_a_mark(spark):
    docs = spark.range(2050).selectExpr("id AS doc_id", "IF(id < 5, 'xyzzy plain words', 'plain words') AS text")
    model = toxicity.fit(docs, docs.selectExpr("doc_id", "CAST(doc_id < 50 AS int) AS toxic"))
    assert model.weights.keys() == {"xyzzy"} and model.weights["xyzzy"] > 0
