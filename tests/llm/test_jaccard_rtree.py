import random
from collections import defaultdict

import numpy as np

from ledgerlake.llm import jaccard_rtree as jr
from tests.llm.helpers import empty, odd, odd_rows, prose


def brute(rows, width, percent):
    """(doc_id, set size, component) of all rows by comparing every pair of sets."""
    sets = []
    for _, t in rows:
        w = jr._WORD.findall((t or "").encode().translate(jr._LOWER))
        sets.append(frozenset(tuple(w[k:k + width]) for k in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else []))
    top = list(range(len(rows)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                top[find(i)] = find(j)
    ids = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[find(i)].append(d)
    return sorted((d, len(sets[i]), min((x for x in ids[find(i)] if x is not None), default=None)) for i, (d, _) in enumerate(rows) if d is not None)


def check(spark, rows, width=4, percent=85):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jr.near_groups(docs, width, percent).filter("doc_id IS NOT NULL").collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute(rows, width, percent)


def changed(text, rnd, n):
    w = text.split()
    for _ in range(n):
        w[rnd.randrange(len(w))] = f"new{rnd.randrange(10 ** 6)}"
    return " ".join(w)


def test_chains_families_and_shared_passages(spark):
    rnd, rows = random.Random(1), []
    passage = prose(99, 60)
    for f in range(12):
        text = prose(f, rnd.choice([6, 20, 90, 250]))
        for g in range(rnd.choice([1, 2, 6, 15])):
            rows.append(changed(text, rnd, rnd.randrange(0, 6)) if g else text)
        chain = text  # each links with the next, the ends do not
        for _ in range(5):
            chain = changed(chain, rnd, 1 + len(chain.split()) // 60)
            rows.append(chain)
    rows += [prose(1000 + i, 150) + " " + passage for i in range(40)] + [passage] * 5
    rnd.shuffle(rows)
    check(spark, [(i * 2, t) for i, t in enumerate(rows)])
    check(spark, [(i * 2, t) for i, t in enumerate(rows)], 5, 80)


def test_large_cells_in_parts_finish_exactly(spark, monkeypatch):
    monkeypatch.setattr(jr, "FOREST", 8)
    monkeypatch.setattr(jr, "LEAF", 4)
    rnd = random.Random(2)
    text = prose(5, 120)
    check(spark, [(i, changed(text, rnd, rnd.randrange(0, 5))) for i in range(80)] + [(1000 + i, prose(i, 30)) for i in range(20)])


def test_the_tree_loses_no_pair():
    rnd = np.random.default_rng(0)
    points = rnd.poisson(2, (150, jr.GROUPS)).astype("<u2")
    points[75:] = np.maximum(points[:75].astype(int) + rnd.integers(-1, 2, (75, jr.GROUPS)) * (rnd.random((75, jr.GROUPS)) < 0.1), 0)
    sizes = points.sum(axis=1).astype(np.int64)
    i, j, _ = jr.together(jr.survivors(points, sizes, 85))
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    want = {(a, b) for a in range(150) for b in range(a + 1, 150)
            if np.minimum(points[a], points[b]).sum() >= jr.needed(sizes[a] + sizes[b], 85) and 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])}
    assert got == want and len(want) >= 20


def test_odd_rows(spark):
    check(spark, [(r[0], r[1]) for r in odd_rows()])
    assert jr.near_groups(empty(spark)).count() == 0
    kept = jr.drop_near_copies(odd(spark))
    assert kept.columns == odd(spark).columns
    texts = sorted((r["text"] or "")[:20] for r in kept.collect())
    assert texts.count("one two  three") == 1 and "one two\tthree" not in texts and len(texts) == 8
    assert jr.drop_near_copies(empty(spark)).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60) if i != 30] + [(5, 5), (40, 35)], "a long, b long")
    got = {r["node"]: r["label"] for r in jr.components(links).collect()}
    assert got == {i: 0 if i <= 30 else 31 for i in range(61)}
