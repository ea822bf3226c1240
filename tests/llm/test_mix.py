from collections import Counter, defaultdict

import pytest
from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.llm import mix
from tests.llm.helpers import empty, odd, odd_rows


def shared(sizes, ratio=1.5, weights=(3, 1, 2), cap=2.0):
    """Targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, left = dict.fromkeys(names, 0.0), ratio * sum(sizes.values())
    open_ = [s for s in names if sizes[s]]
    while left > 1e-9 and open_:
        total, rest = sum(w[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * w[s] / total
            rest += max(0.0, target[s] - cap * sizes[s])
            target[s] = min(target[s], cap * sizes[s])
        open_ = [s for s in open_ if target[s] < cap * sizes[s] - 1e-9]
        left = rest
    return target


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 1000, "c": 7, None: 50}, {"x": 0, "y": 5}, {"s": 3}, {f"s{i:02d}": (i * 37) % 91 for i in range(40)}])
def test_targets_reshare_the_excess(spark, sizes):
    df = spark.createDataFrame([(k, v, 1) for k, v in sizes.items()], "source string, mix_source_size long, mix_docs long")
    got = {r["source"]: r["mix_target"] for r in mix.source_targets(df, 1.5, (3, 1, 2), 2.0).collect()}
    assert got == pytest.approx(shared(sizes))


@given(st.floats(0.01, 0.99), st.floats(0.01, 0.99), st.integers(1, 1000), st.integers(1, 1000), st.floats(0, 0.999))
def test_a_meeting_keeps_words_and_makes_one_whole(p, q, s, t, u):
    a, b = mix.meet(p, s, q, t, u)
    assert a * s + b * t == pytest.approx(p * s + q * t)
    assert min(abs(a), abs(1 - a), abs(b), abs(1 - b)) < 1e-9
    up, down = min((1 - p) * s, q * t), min(p * s, (1 - q) * t)
    assert (up * down - down * up) == 0 and -1e-9 <= a <= 1 + 1e-9 and -1e-9 <= b <= 1 + 1e-9


def test_mix_meets_targets_and_is_repeatable(spark):
    rows = [(i, f"s{0 if i % 3 else i % 7}", 1 + (i * 7919) % 400) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_size long")
    one = {r["doc_id"]: r for r in mix.mix(docs).collect()}
    two = {r["doc_id"]: r["mix_copies"] for r in mix.mix(docs.repartition(3)).collect()}
    assert {k: r["mix_copies"] for k, r in one.items()} == two and len(one) == 6000
    taken, target = defaultdict(int), {}
    for r in one.values():
        assert 0 <= r["mix_copies"] <= 2
        taken[r["source"]] += r["mix_copies"] * r["mix_size"]
        target[r["source"]] = r["mix_target"]
    for s in target:  # a source misses by less than its largest document
        assert abs(taken[s] - target[s]) <= 400


def test_odd_rows_and_clashing_columns(spark):
    docs = odd(spark).selectExpr("*", "1 AS mix_target", "2 AS `Mix_P`", "array(1) AS `a b`")
    got = mix.mix(docs).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r[0], r[1]) for r in odd_rows())
    assert {r["mix_size"] for r in got if not (r["text"] or "").strip()} == {0}
    assert mix.mix(empty(spark)).count() == 0
    again = mix.repeated(odd(spark))
    assert again.columns == odd(spark).columns and mix.repeated(empty(spark)).count() == 0
