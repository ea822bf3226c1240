import random
import sys
import time

import hypothesis.strategies as st
import pytest
from hypothesis import HealthCheck, given, settings

from ledgerlake.llm import wrappers as wr

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var x="<p>no</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">A</a></li>{nav}</ul></nav><div class="cookie-notice">We use cookies</div><div class="ad">Buy</div>
<{box}><header><h1>Title {n} &amp; more</h1></header><p>First  <b>bold</b>
text {n}<p>Second &lt;tag&gt; &eacute; caf&#233;{more}<form>Name <input></form><aside>Side</aside></{end}>
<section id="comments"><article><p>Nice!</p></article></section><footer>&copy; site</footer></body></html>"""


def page(n, box="article", nav="", more=""):
    return PAGE.format(n=n, box=box, end=box.split()[0], nav=nav, more=more)


def run(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrappers, slots = wr.infer(pages)
    return {r["page_id"]: r["main_text"] for r in wr.extract(pages, slots).collect()}, {r["host"]: r["wrapper"] for r in wrappers.collect()}


def test_main_text_without_the_rest(spark):
    want = "Title {} & more\nFirst bold text {}\nSecond <tag> é café"
    rows = [(i, "http://h.example/x", page(i, nav="<li><a>B</a></li>" * i)) for i in range(5)]
    rows += [(10 + i, "https://u@main.example:80/x", page(10 + i, box="main")) for i in range(3)]
    rows += [(20 + i, "http://div.example", page(20 + i, box='div class="post-content"')) for i in range(3)]
    got, _ = run(spark, rows)
    assert got == {i: want.format(i, i) for i in got} and len(got) == 11


def test_host_statistics_where_no_element_tells(spark):
    rows = [(i, "http://plain.example/", f"<div><p>About us and our terms</p></div><div><p>Story number {i} goes on</p></div>"
             f"<div><p><a href=/>One</a> <a href=/>Two {i}</a></p></div>") for i in range(4)]
    rows = [(i, u, h.replace("<div>", '<div class="top">', 1)) for i, u, h in rows]
    got, _ = run(spark, rows)
    assert all(f"Story number {i} goes on" in t and "About us" not in t for i, t in got.items())


def test_wrappers_align_optional_and_repeated_parts(spark):
    rows = [(1, "http://a.example", "<ul><li>x</ul><p>t</p>"), (2, "http://a.example", "<ul><li>x<li>y</ul><h1>h</h1><p>t</p>"), (3, "http://a.example", "<p>only</p>")]
    _, wrappers = run(spark, rows)
    assert wr.expression(wr.unpacked(wrappers["a.example"])) == "ul(li(#)+)? h1(#)? p(#)"


def test_odd_rows(spark):
    rows = [(1, None, None), (2, "", ""), (3, "not a url", "just text &amp; more"), (4, "http://h.example", "<article><p>cut mid ta"),
            (5, "http://h.example", "<article><p>whole</p></article><p"), (5, "http://h.example", "<article><p>whole</p></article><p"),
            (6, "http://h.example", "</div></p><article></article>"), (7, "http://long.example", "<article>" + "<p>para graph</p>" * 20000 + "</article>"),
            (None, "http://h.example", "<article>" + "<div>" * 50_000 + "deep" + "</article>")]
    got, _ = run(spark, rows)
    assert got[1] == got[2] == got[6] == "" and got[3] == "just text & more" and got[4] == "cut mid ta" and got[5] == "whole"
    assert got[7] == "\n".join(["para graph"] * 20000) and got[None] == "deep"
    assert run(spark, []) == ({}, {})


def test_whole_table_against_its_template(spark):
    """The generated pages have one template, so a plain cut at its marks tells the text."""
    import re
    from html import unescape

    from ledgerlake.llm.queries import op7_html_wrappers
    d = "/root/testdata/sf0.001"
    html = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{d}/pages.parquet").collect()}
    for r in op7_html_wrappers(spark, d).collect():
        body = re.sub(r"</?b>", "", re.search(r"<article>(.*?)</article>", html[r["page_id"]], re.S)[1]).replace("<br>", " ")
        want = "\n".join(x for x in (" ".join(unescape(b).split()) for b in re.split(r"</?(?:p|h1)>", body)) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


def items(depth=3):
    import hypothesis.strategies as st
    leaf = st.just(["#", "", []])
    return st.lists(leaf if not depth else st.one_of(leaf, st.tuples(st.sampled_from("xyz"), items(depth - 1)).map(lambda x: [x[0], "", x[1]])), max_size=4)


@pytest.mark.parametrize("long", [3, 256])
@given(raw=st.lists(items(), min_size=1, max_size=6))
@settings(suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_a_wrapper_matches_its_trees(raw, long, monkeypatch):
    """Short lists of any order as well as rows that repeat."""
    monkeypatch.setattr(wr, "LONG", long)

    def fold(x):
        return wr.folded([[c[0], c[1], fold(c[2])] for c in x])
    trees = [fold(x) for x in raw]
    wrapper = trees[0]
    for x in trees[1:]:
        wrapper = wr.aligned(wrapper, x)
    assert wr.unpacked(wr.packed(wrapper)) == wrapper
    wrapper = wr.unpacked(wr.packed(wrapper))
    for x, t in zip(raw, trees):
        for have, want in ((x, t), (t, wrapper), (wr.unpacked(wr.packed(t)), wrapper)):
            to = wr.placed(have, want)
            assert {id(y[0]) for y in wr.texts(have)} == set(to)
    assert wr.placed([["#", "", []], ["w", "", [["#", "", []]]]], wrapper) is None


def test_slots_are_those_of_the_wrapper(spark):
    """Two elements of one path are two slots of the wrapper: the first says the same on all pages."""
    rows = [(i, "http://two.example/", f"<div><p>About us</p></div><h2>Story {i}</h2><div><p>It goes {i} on</p></div>") for i in range(4)]
    rows += [(i, "http://many.example/", "<h2>T</h2>" * (i % 2) + "<div><p>About us</p></div>" + f"<h{i % 7 or 1}>S</h{i % 7 or 1}>" + f"<ul><li>A {i}</li></ul>" * i
              + f"<div><p>It goes {i} on</p></div>") for i in range(100, 200)]
    got, wrappers = run(spark, rows)
    assert all("About us" not in t and f"It goes {i} on" in t for i, t in got.items()) and len(got) == 104
    assert wr.expression(wr.unpacked(wrappers["two.example"])) == "div(p(#)) h2(#) div(p(#))"


def test_elements_that_differ_in_a_late_word(spark):
    side, body, note = ('<div class="row col-md-4 px {}">{}</div>'.format(*x) for x in (("sidebar", "Links"), ("main-content", "Text {0}"), ("lead", "Lead {0}")))
    for n, parts in enumerate(([side, body], [body, side], [side, note], [note, side])):
        got, _ = run(spark, [(i, "http://grid.example/", "".join(parts).format(i)) for i in range(4)])
        assert got == {i: f"{'Text' if n < 2 else 'Lead'} {i}" for i in range(4)}


def test_constant_blocks_over_different_pages(spark):
    copies = [(i, "http://copies.example/", "<div><h1>T</h1><p>text</p></div>") for i in range(5)]
    two = [(10 + i, "http://two.example/", f"<div><p>About us</p><p>Our terms</p><p>Story {i}</p></div>") for i in range(4)]
    once = [(20 + i, "http://once.example/", f"<div><p>Same</p><p>{'Same' if i else 'Other'}</p></div>" + "<hr>" * (i > 1)) for i in range(3)]
    got, _ = run(spark, copies + two + once + two)
    assert all(got[i] == "T\ntext" for i in range(5)) and all(got[10 + i] == f"Story {i}" for i in range(4))
    assert got[20] == "Other" and got[21] == got[22] == ""


def wrapper_of(*pages):
    out = None
    for p in pages:
        t = wr.tree(wr.read(p)[0])
        out = t if out is None else wr.aligned(out, t)
    assert all(wr.placed(wr.tree(wr.read(p)[0]), out) is not None for p in pages)
    return wr.expression(out)


def test_rows_of_elements_are_repeated_groups():
    pair = "<h2>a</h2><p>x</p>"
    assert wrapper_of(pair * 2, pair * 4) == wrapper_of(pair * 4, pair) == wrapper_of(pair, pair * 2) == "(h2(#) p(#))+"
    assert wrapper_of(pair * 3, pair + "<p>y</p>") == "(h2(#) p(#)+)+"
    assert wrapper_of("<h1>t</h1>" + pair * 2 + "<hr>", "<h1>t</h1><hr>") == "h1(#) (h2(#) p(#))* hr"
    assert wrapper_of((pair * 2 + "<ul></ul>") * 2) == "((h2(#) p(#))+ ul)+"


def test_deep_and_long_pages():
    """Nested and alternating elements take seconds, and lose no block."""
    limit = sys.getrecursionlimit()
    sys.setrecursionlimit(wr.DEPTH)
    try:
        start = time.time()
        root, blocks = wr.read("<article>" + "<div>" * 50_000 + "deep<nav>menu</nav>end" + "</div>" * 50_000 + "after</article>last")
        assert [(t, x.out, x.main) for x, t, _ in blocks] == [("deep", False, 2), ("menu", True, 0), ("end", False, 2), ("after", False, 2), ("last", False, 0)]
        text, _, slots = wr.numbered(root)
        assert wr.packed(wr.unpacked(text)) == text and {id(x.item) for x, *_ in blocks} == set(slots)
        root, blocks = wr.read("<article>" + "".join(f"<{k}>t</{k}>" for k in ("h2", "p") * 10_000) + "</article>")
        assert len(blocks) == 20_000 and wr.expression(wr.unpacked(wr.numbered(root)[0])) == "article((h2(#) p(#))+)"
        mixed = "".join(f"<{k}>t</{k}>" for k in random.Random(1).choices(("h2", "p", "ul"), k=20_000))
        assert wrapper_of(mixed, "<p>x</p><h2>y</h2>") == "(h2(#)* p(#)* ul(#)*)*"
        assert time.time() - start < 60
    finally:
        sys.setrecursionlimit(limit)


def test_marked_words_within_names_drop_no_article(spark):
    names = ("post category-social", "post share-price-news", "comment-is-free", "story alert-level")
    rows = [(i, f"http://h{i}.example/", f'<nav>menu</nav><article class="{c}"><p>Text {i}</p></article><article class="comment"><p>Nice</p></article>') for i, c in enumerate(names)]
    cards = '<article class="comment-card"><p>{}</p></article>'
    rows += [(10, "http://cards.example/", '<div class="body-text"><p>Story</p></div>' + cards.format("one") + cards.format("two"))]
    rows += [(11, "http://inner.example/", '<article><p>Story</p><article class="reader-comment"><p>Nice</p></article></article>')]
    got, _ = run(spark, rows)
    assert got == {**{i: f"Text {i}" for i in range(4)}, 10: "Story", 11: "Story"}


def test_the_wrapper_decides_inside_articles(spark):
    """What a template says in all articles of a host is no text; versions of one text keep what they share."""
    def article(i, *extra):
        return f"<article><h1>Title {i}</h1>" + "".join(f"<p>Words {i} {j} that only this article has, as articles do</p>" for j in range(1 + i % 3)) + "".join(extra) + "</article>"
    rows = [(i, "http://share.example/", article(i, "<div>Read this on our pages</div>")) for i in range(12)]
    rows += [(20 + i, "http://few.example/", article(i, "<div>Read this on our pages</div>")) for i in range(9)]
    rows += [(40 + i, "http://versions.example/", article(0, "<p>Shared words</p>" * 3, f"<p>{i}</p>")) for i in range(12)]
    rows += [(60 + i, "http://copies.example/", "<nav>x</nav>" * i + article(0)) for i in range(12)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    _, slots = wr.infer(pages)
    got, bare = ({r["page_id"]: r["main_text"] for r in wr.extract(pages, s).collect()} for s in (slots, slots.limit(0)))
    assert all("our pages" in bare[i] and got[i] == bare[i].removesuffix("\nRead this on our pages") for i in range(12))
    assert all(got[i] == bare[i] for i in got if i >= 20) and len(got) == 45
    assert got[41].endswith("Shared words\n1")
