from collections import Counter
from hashlib import sha256

from hypothesis import given
from hypothesis import strategies as st

from ledgerlake.llm import merkle
from tests.llm.helpers import empty, odd, odd_rows, prose

TEXTS = st.text(alphabet=st.sampled_from("ab c.\n,é漢"), max_size=900)


@given(TEXTS, TEXTS)
def test_roots_test_equality_and_pieces_make_the_text(a, b):
    for blocks in (False, True):
        assert "".join(p for s in merkle.sections(a, blocks) for para in s for p in para) == a
    assert (merkle.fingerprint(a)[:32] == merkle.fingerprint(b)[:32]) == (a == b)
    assert 0 <= merkle.likeness(merkle.fingerprint(a), merkle.fingerprint(b)) <= 1


def test_edits_are_located():
    lines = [prose(i, 30) + "." for i in range(60)]
    old, new = "\n".join(lines), "\n".join(lines[:20] + ["An inserted line, new here."] + lines[20:])
    at = new.index("An inserted")
    spans = merkle.edits(old, new)
    assert spans and all(at - 200 <= a and b <= at + 400 for a, b in spans)
    assert merkle.edits(old, old) == []
    assert merkle.likeness(merkle.fingerprint(old), merkle.fingerprint(new)) > 0.95


def test_likeness_has_no_border():
    words = prose(5, 400).split()
    text = " ".join(w + "," * (i % 5 == 4) for i, w in enumerate(words))   # clauses
    for n in (20, 159, 160, 319, 321, 639, 640, 1500):
        one, two = text[:n], text[:n + 2]
        assert merkle.likeness(merkle.fingerprint(one), merkle.fingerprint(two)) > 0.85, n
    for n in (40, 161, 200, 320, 400, 641, 800, 1700):   # a text that loses a quarter may pass below a border
        one = text[:n]
        for other in ("", "x", "other words of another text " * 20):
            kept = merkle.likeness(merkle.fingerprint(one), merkle.fingerprint(merkle.tail_replaced(one, other)))
            assert 0.5 < kept < 0.95, (n, kept)


@given(TEXTS, TEXTS)
def test_likeness_from_the_top_is_that_of_all_pieces(a, b):
    for blocks in (False, True):
        x, y = (merkle._printed(merkle.hashed(t, blocks)[1]) for t in (a, b))
        bags = [Counter(leaf[:3] for _, paragraphs in merkle.hashed(t, blocks)[1] for leaves in paragraphs for leaf in leaves) for t in (a, b)]
        n = bags[0].total() + bags[1].total()
        assert merkle._alike(x, y) == (2 * (bags[0] & bags[1]).total() / n if n else 0.0)


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: r[0])
    for i, (d, t) in enumerate(rows):
        n = rows[(i + 1) % len(rows)][1]
        k = len(t) // 4
        e = t[:len(t) - k] + n[:k]
        f = merkle.fingerprint
        yield (d, len(t), sha256(e.encode()).hexdigest(), f(t), f(e), merkle.likeness(f(t), f(e)), merkle.likeness(f(t), f(n)))


def test_against_next_over_many_ranges(spark):
    rows = [(i * 3, prose(i, i % 50) if i % 7 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = merkle.against_next(docs).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == list(brute(rows))


def test_odd_rows(spark):
    assert merkle.against_next(odd(spark).select("doc_id", "text")).count() == len(odd_rows())
    assert merkle.against_next(empty(spark).select("doc_id", "text")).count() == 0
    one = merkle.against_next(spark.createDataFrame([(1, "abcdefgh")], "doc_id long, text string")).collect()
    assert one[0]["edited_sha256"] == sha256(b"abcdefab").hexdigest()
    marked = merkle.fingerprints(odd(spark).selectExpr("*", "1 AS merkle")).collect()
    assert len({r["merkle"] for r in marked if not r["text"]}) == 1
