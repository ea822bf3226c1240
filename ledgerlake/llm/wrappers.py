"""Main text of web pages by wrappers inferred per host (union-free regular expressions).

A page is read as a tree of block elements with text slots. Neighbouring equal elements fold
into one repeated element, rows of elements that repeat (``h2 p h2 p``) into one repeated group, so pages of one template differ
little whatever their length, and the different trees of a host are few. They are aligned one after the other: elements that both
have merge child by child, what only one has becomes optional, what one repeats becomes repeated; a list that stays
longer than ``LONG`` items allows its elements in any order, ``(a? b?)*``. The
result is the host's wrapper, a regular expression without unions whose text slots are numbered.
Trees are counted before they travel, and a host's trees are aligned in parts of about ``FAN`` whose
wrappers are aligned again, in as many rounds as it takes, so a host may hold any share of the pages.
Every tree of a host is then matched against its wrapper, which tells the slots of its pages' texts.

Slots are judged once per host, by the wrapper's nodes. Menus, headers, footers, sidebars, notices, adverts, forms and
comments are known by element, role and class names; an article with such a word only within a longer name (``category-social``)
is text unless the wrapper repeats it as a row's member or it lies in another article. Slots outside articles and main parts are text where they
are not mostly links. Blocks that all different pages with the
slot have are the template's (``LEAST_PAGES`` at least, copies of a page count once; in articles and main parts ``LEAST_TEXTS`` different texts, and not
where such blocks make up more than ``FIXED_SHARE`` of them). A page's text is its other blocks in text slots: those of its articles, else of its main part, else all.

Defined cases: null html counts as empty and gives the empty text; pages without a host (null or
odd urls) share the host ``''``; of a page whose tree was not among the inferred ones the element, role
and class names alone decide; unclosed elements end with their parents, a cut page where it is
cut; text outside any element is a block of the body; repeated rows are extracted alike; an empty
table gives no rows; columns named like the added ones (``main_text``) are replaced, others kept.
"""

from __future__ import annotations

import json
import re
import sys
from difflib import SequenceMatcher
from functools import lru_cache
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import materialize, nullable, small_batches, without

#: Trees or wrappers aligned by one task in a round.
FAN = 32
#: Different pages with a slot at least, for a block on all of them to be constant.
LEAST_PAGES = 3
#: Different texts with a slot of the main part at least, for a block on all of them to be constant, and the share of a host's main text such blocks may be.
LEAST_TEXTS, FIXED_SHARE = 10, 0.25
#: Elements nested deeper become neighbours at this depth, as in browsers; what they are is still told by all their parents.
DEEP = 500
#: Recursion of workers.
DEPTH = 100_000
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|textarea|iframe|svg|math|object|select)\b.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>"
    r"|</?[a-zA-Z][^>]*\Z", re.S | re.I)
_NAMES = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[a-z]+")
#: Items of a repeated group at most, items of a list at most before it allows any order, the label of such a list.
GROUP, LONG, ANY = 32, 256, "(*)"
BLOCKS = frozenset("""
    address article aside blockquote body button center caption dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol option p pre section summary
    table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that a new one closes when they are open in the same container.
CLOSED_BY = {**{x: {"p"} for x in BLOCKS if x not in ("button", "label", "option")}, "li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"},
             "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}
SCOPES = frozenset("html body table ul ol dl div section article main aside nav header footer form blockquote td th li dd figure details dialog fieldset menu".split())
NOT_TEXT = frozenset("head title nav footer aside form button label legend menu dialog fieldset option".split())
MARKS = frozenset("""
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar cookie cookies consent notice
    notices alert alerts comment comments respond reply replies menu menus nav navbar navigation navigationbar breadcrumb breadcrumbs
    share sharing social related recommended newsletter subscribe subscription signup login popup modal overlay widget widgets footer
    masthead topbar toolbar pagination pager skip disqus paywall contentinfo complementary search disclaimer""".split())
MAIN_MARKS = frozenset("article main content post entry story".split())


def doubtful(label: str) -> bool:
    """Whether an article or main part has a marked word only within longer names, as in ``category-social``."""
    name, *words = label.split(".")
    return name in ("article", "main") and not MARKS.intersection(words) and any("-" in w and MARKS.intersection(w.split("-")) for w in words)


@lru_cache(100_000)
def judged(label: str, out: bool, main: int) -> tuple[bool, int]:
    """Whether an element is no text, and its main part, from its label and those of its parent."""
    name, *names = label.split(".")
    words = {x for w in names for x in w.split("-")}
    doubt = doubtful(label)
    # the header of an article holds its headings; a doubtful article in an article is no part of it
    out = (out or (not main and (name == "header" or "header" in words)) or name in NOT_TEXT
           or (main == 2 and name == "article" if doubt else bool(MARKS & words)))
    own = 1 if doubt else 2 if name == "article" else 1 if name == "main" or MAIN_MARKS & words else 0
    return out, 0 if out else max(main, own)


class Node:
    """An open or closed block element or a text slot: its item (label, mark, children), what it is."""

    __slots__ = ("name", "item", "out", "main")

    def __init__(self, name: str, attributes: str, parent: "Node | None"):
        words: list[str] = []
        if attributes and "=" in attributes:
            for _, *value in _NAMES.findall(attributes):
                words += ["-".join(_PART.findall(w)) for w in "".join(value).lower().split()]
        self.name = name
        self.item: list = [".".join([name, *dict.fromkeys(filter(None, words))]), "", []]
        self.out, self.main = judged(self.item[0], parent.out, parent.main) if parent is not None else (False, 0)


def read(html: str | None) -> tuple[Node, list[tuple[Node, str, int]]]:
    """The tree of a page, and its blocks: (text slot, text, characters in links).

    A node's ``main`` is 2 in an article, 1 in a main part, 0 elsewhere.
    """
    root = Node("body", "", None)
    stack, blocks, text, linked, in_link, at, slot, slot_in = [root], [], [], 0, 0, 0, root, root

    def flush() -> None:
        nonlocal linked, slot, slot_in
        if text:
            block = " ".join(unescape("".join(text)).split())
            if block:
                held = stack[min(len(stack) - 1, DEEP)].item[2]
                if not blocks or slot_in is not stack[-1] or held[-1] is not slot.item:
                    slot, slot_in = Node("#", "", stack[-1]), stack[-1]
                    held.append(slot.item)
                blocks.append((slot, block, linked))
            text.clear()
            linked = 0
    html = html or ""
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at:m.start()]
            text.append(piece)
            if in_link:
                linked += len(piece)
        at = m.end()
        name = m[3]
        if name is None:
            continue
        name = name.lower()
        if name in BLOCKS:
            flush()
            if m[2]:
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name == name:
                        del stack[k:]
                        break
                in_link = 0
            elif name not in ("html", "body"):
                ends = CLOSED_BY.get(name, ())
                for k in range(len(stack) - 1, 0, -1):
                    if stack[k].name in ends:
                        del stack[k:]
                    elif stack[k].name in SCOPES:
                        break
                node = Node(name, m[4], stack[-1])
                stack[min(len(stack) - 1, DEEP)].item[2].append(node.item)
                if name not in VOID:
                    stack.append(node)
        elif name == "br":
            text.append("\n")
        elif name == "a":
            in_link = 0 if m[2] else 1
    if at < len(html):
        text.append(html[at:])
    flush()
    return root, blocks


# ---- wrappers: [label, mark, children]; mark is '', '?', '+' or '*'; a text slot is ['#', mark, []];
# a group of items is ['(labels)', mark, items], a list of any order [['(*)', '*', items]] ----

def either(a: str, b: str) -> str:
    """The mark that allows what either mark allows."""
    return {(False, False): "", (True, False): "?", (False, True): "+", (True, True): "*"}[(a in "?*" and a != "") or (b in "?*" and b != ""), (a in "+*" and a != "") or (b in "+*" and b != "")]


def optional(item: list) -> list:
    return [item[0], either(item[1], "?"), item[2]]


def merged(x: list, y: list, mark: str = "") -> list:
    """One item for two of one label; the items of a group are merged one by one."""
    inner = [merged(p, q) for p, q in zip(x[2], y[2])] if x[0][0] == "(" else aligned(x[2], y[2])
    return [x[0], either(either(x[1], y[1]), mark), inner]


def neighbours(children: list) -> list:
    """Neighbours of one label as one repeated item."""
    out: list = []
    for c in children:
        if out and out[-1][0] == c[0]:
            out[-1] = merged(out[-1], c, "+")
        else:
            out.append(c)
    return out


def grouped(children: list) -> list:
    """Items that repeat as a row, ``h2 p h2 p``, as one repeated group ``(h2 p)+``; the shortest row from the left counts."""
    labels = [c[0] for c in children]
    out, i, n = [], 0, len(children)
    while i < n:
        for k in range(2, min(GROUP, (n - i) // 2) + 1):
            if labels[i + k] == labels[i] and labels[i:i + k] == labels[i + k:i + 2 * k]:
                row, j = children[i:i + k], i + k
                while labels[j:j + k] == labels[i:i + k]:
                    row = [merged(x, y) for x, y in zip(row, children[j:j + k])]
                    j += k
                out.append([f"({' '.join(labels[i:i + k])})", "+", row])
                i = j
                break
        else:
            out.append(children[i])
            i += 1
    return out


def members(items: list) -> list:
    """Items in order, groups replaced by what they hold."""
    out, stack = [], list(reversed(items))
    while stack:
        x = stack.pop()
        if x[0][0] == "(":
            stack += reversed(x[2])
        else:
            out.append(x)
    return out


def loosened(items: list) -> list:
    """A list that allows the items in any order, ``(a? b? c?)*`` with every label once."""
    by: dict[str, list] = {}
    for x in members(items):
        by[x[0]] = merged(by[x[0]], x, "*") if x[0] in by else [x[0], "*", x[2]]
    return [[ANY, "*", [by[k] for k in sorted(by)]]]


def folded(children: list) -> list:
    """A list of items with its repeats folded; one that stays longer than ``LONG`` is loosened."""
    while True:
        out = grouped(neighbours(children))
        if len(out) == len(children):
            return loosened(out) if len(out) > LONG else out
        children = out


def absorbed(items: list, groups: dict[str, list]) -> list:
    """Items that form one row of a group of the other list, as that group."""
    for label, row in groups.items():
        k, names, i, out = len(row), [x[0] for x in items], 0, []
        while i < len(items):
            if names[i] == row[0] and names[i:i + k] == row:
                out.append([label, "", items[i:i + k]])
                i += k
            else:
                out.append(items[i])
                i += 1
        items = out
    return items


def aligned(a: list, b: list) -> list:
    """One list of items that matches what either matches: common items merge, others become optional."""
    if any(x and x[0][0] == ANY for x in (a, b)):
        return loosened(a + b)
    if [x[0] for x in a] == [x[0] for x in b]:
        return [merged(x, y) for x, y in zip(a, b)]
    rows = [{x[0]: [y[0] for y in x[2]] for x in items if x[0][0] == "("} for items in (a, b)]
    a, b = absorbed(a, {k: r for k, r in rows[1].items() if k not in rows[0]}), absorbed(b, {k: r for k, r in rows[0].items() if k not in rows[1]})
    out = []
    for tag, i, k, j, n in SequenceMatcher(None, [x[0] for x in a], [x[0] for x in b], autojunk=False).get_opcodes():
        if tag == "equal":
            out += [merged(x, y) for x, y in zip(a[i:k], b[j:n])]
        else:
            out += [optional(x) for x in a[i:k]] + [optional(x) for x in b[j:n]]
    return folded(out)


def tree(root: Node) -> list:
    """The folded tree of a page, from the leaves up."""
    done: dict[int, list] = {}
    order, stack = [], [root.item]
    while stack:
        item = stack.pop()
        order.append(item)
        stack += item[2]
    for item in reversed(order):
        done[id(item)] = folded([[c[0], c[1], done.pop(id(c))] for c in item[2]])
    return done[id(root.item)]


def packed(items: list) -> str:
    """A list of items as text without nesting: label, mark and number of children of every item, parents first."""
    out, stack = [len(items)], list(reversed(items))
    while stack:
        x = stack.pop()
        out += [x[0], x[1], len(x[2])]
        stack += reversed(x[2])
    return json.dumps(out, separators=(",", ":"))


def unpacked(text: str) -> list:
    """The inverse of ``packed``."""
    flat = json.loads(text)
    items: list = []
    open_lists, at = [(items, flat[0])], 1
    while open_lists:
        held, n = open_lists[-1]
        if len(held) == n:
            open_lists.pop()
            continue
        label, mark, n = flat[at:at + 3]
        held.append([label, mark, []])
        at += 3
        if n:
            open_lists.append((held[-1][2], n))
    return items


def steps(items: list) -> tuple[list, list[set], set, set]:
    """A list of items as an automaton: its places (items, and groups both whole and by member),
    for each place those that may follow, the first places, the last ones."""
    places: list = []
    after: list[set] = []

    def link(some: set, more: set) -> None:
        for p in some:
            after[p] |= more

    def part(x: list) -> tuple[set, set, bool]:
        places.append(x)
        after.append(set())
        first, last, empty = {len(places) - 1}, {len(places) - 1}, False
        if x[0][0] == "(":
            f, z, empty = row(x[2])
            first, last = first | f, last | z
        if x[1] in ("+", "*"):
            link(last, first)
        return first, last, empty or x[1] in ("?", "*")

    def row(xs: list) -> tuple[set, set, bool]:
        first, last, empty = set(), set(), True
        for x in xs:
            f, z, e = part(x)
            link(last, f)
            first = first | f if empty else first
            last = last | z if e else z
            empty = empty and e
        return first, last, empty
    first, last, empty = row(items)
    return places, after, first, last | ({-1} if empty else set())


def placed(have: list, want: list) -> dict[int, list] | None:
    """The match of a tree (folded or not) with a wrapper: id of a text slot -> text slot of the wrapper.

    Of several ways the one that ends and comes from the leftmost places counts. None where the wrapper does not match.
    """
    known: dict[tuple[int, int], list | None] = {}
    automata: dict[int, tuple] = {}

    def fits(x: list, item: list) -> bool:
        return x[0] == item[0] and either(item[1], x[1]) == item[1] and way(x[2], item[2]) is not None

    def ordered(a: list, b: list) -> list | None:
        if len(a) == len(b):
            out = list(zip(a, b))
            for x, item in out:
                if not fits(x, item):
                    break
            else:
                return out
        if id(b) not in automata:
            automata[id(b)] = steps(b)
        places, after, first, last = automata[id(b)]
        reach, came = first, []
        for x in a:
            here: dict[int, int] = {}
            good = {p for p in (reach if not came else set().union(*(after[q] for q in came[-1]))) if fits(x, places[p])}
            if not came:
                here = dict.fromkeys(good, -1)
            else:
                for q in sorted(came[-1]):
                    for p in after[q] & good:
                        here.setdefault(p, q)
            if not here:
                return None
            came.append(here)
        ends = sorted(set(came[-1]) & last) if came else sorted(last & {-1})
        if not ends:
            return None
        out, p = [], ends[0]
        for x, here in zip(reversed(a), reversed(came)):
            out.append((x, places[p]))
            p = here[p]
        return out[::-1]

    def way(a: list, b: list) -> list | None:
        """The items of ``a`` and their items of ``b``."""
        key = id(a), id(b)
        if key not in known:
            known[key] = None
            if b and b[0][0] == ANY:
                by = {x[0]: x for x in b[0][2]}
                out = [(x, by.get(x[0])) for x in members(a)]
                for x, item in out:
                    if item is None or way(x[2], item[2]) is None:
                        break
                else:
                    known[key] = out
            else:
                known[key] = ordered(a, b)
        return known[key]

    if way(have, want) is None:
        return None
    slots: dict[int, list] = {}
    stack = [(have, want)]
    while stack:
        a, b = stack.pop()
        for x, item in known[id(a), id(b)]:
            if item[0] == "#":
                slots[id(x)] = item
            else:
                stack.append((x[2], item[2]))
    return slots


def texts(items: list) -> list[tuple[list, bool, int]]:
    """The text slots of a wrapper in order: (item, no text, main); a slot's number is its place."""
    out, stack = [], [(x, False, 0, False) for x in reversed(items)]
    while stack:
        item, no, main, again = stack.pop()
        if item[0] == "#":
            out.append((item, no, main))
        else:
            if item[0][0] != "(":
                # a doubtful article that repeats is one of a list, of comments or cards
                no, main = judged(item[0], no or (doubtful(item[0]) and (again or item[1] in ("+", "*"))), main)
            # members of a repeated group repeat, what is in them does not by that
            stack += [(x, no, main, item[0][0] == "(" and (again or item[1] in ("+", "*"))) for x in reversed(item[2])]
    return out


def numbered(root: Node) -> tuple[str, str, dict[int, int]]:
    """A page's folded tree, its name, and the numbers of the page's text slots in it: id of the item -> number."""
    folds = tree(root)
    text = packed(folds)
    at = {id(x[0]): i for i, x in enumerate(texts(folds))}
    return text, digest(text), {k: at[id(x)] for k, x in placed(root.item[2], folds).items()}


def digest(text: str) -> str:
    return blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def block_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def expression(items: list) -> str:
    """A wrapper as a regular expression over elements."""
    return " ".join((f"{'' if x[0][0] == '(' else x[0]}({expression(x[2])})" if x[2] else x[0]) + x[1] for x in items)


def host_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _align(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One wrapper per key: the trees (keys.., tree, pages) of a key aligned, common ones first."""
    n = len(keys)

    def run(batches):
        sys.setrecursionlimit(DEPTH)
        at, held, pages = None, None, 0

        def closed():
            return pa.RecordBatch.from_arrays([*(pa.array([x], pa.string() if k == "host" else pa.int32()) for k, x in zip(keys, at)),
                                               pa.array([packed(held)]), pa.array([pages], pa.int64())], [*keys, "tree", "pages"])
        for b in batches:
            for *key, t, p in zip(*(b.column(k).to_pylist() for k in range(n + 2))):
                if key != at:
                    if at is not None:
                        yield closed()
                    at, held, pages = key, unpacked(t), p
                else:
                    held, pages = aligned(held, unpacked(t)), pages + p
        if at is not None:
            yield closed()

    schema = ", ".join([f"{k} {'string' if k == 'host' else 'int'}" for k in keys] + ["tree string", "pages long"])
    return (rows.select(*keys, "tree", "pages").repartition(*keys).sortWithinPartitions(*keys, F.col("pages").desc(), "tree")
            .mapInArrow(run, schema))


def _match(trees: DataFrame, wrappers: DataFrame) -> DataFrame:
    """The text slots of all trees: (host, name, slot, place, kind), kind -1 for no text, else the main part."""

    def run(batches):
        sys.setrecursionlimit(DEPTH)
        at = None
        for b in batches:
            out = []
            for host, name, text, wrapper in zip(*(c.to_pylist() for c in b.columns)):
                if wrapper != at:
                    at, items = wrapper, unpacked(wrapper)
                    slots = {id(x): (i, -1 if no else main) for i, (x, no, main) in enumerate(texts(items))}
                have = unpacked(text)
                to = placed(have, items)
                out += [(host, name, i, *slots[id(to[id(x)])]) for i, (x, *_) in enumerate(texts(have))]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), *[pa.int32()] * 3])],
                                             ["host", "name", "slot", "place", "kind"])
    return (trees.join(wrappers, "host").select("host", "name", "tree", "wrapper")
            .mapInArrow(run, "host string, name string, slot int, place int, kind int"))


def infer(pages: DataFrame, url: str = "url", html: str = "html") -> tuple[DataFrame, DataFrame]:
    """Wrappers (host, wrapper, pages) of all hosts, and verdicts (host, name, slots) on the slots of all trees.

    ``slots`` has the text slots of a tree in order: (slot, place in the wrapper, keep, hashes of the blocks that all its pages have).
    """
    small_batches(pages.sparkSession)
    block = pa.list_(pa.struct([("slot", pa.int32()), ("hash", pa.int64()), ("chars", pa.int64()), ("linked", pa.int64()), ("also", pa.list_(pa.int32()))]))
    kinds = {"host": pa.string(), "name": pa.string(), "tree": pa.string(), "pages": pa.int64(), "page": pa.string(), "blocks": block}

    def look(batches):
        from collections import Counter
        sys.setrecursionlimit(DEPTH)
        trees, size = Counter(), 0

        def rows(found):
            return pa.RecordBatch.from_arrays([pa.array(found.get(k, [None] * len(found["host"])), t) for k, t in kinds.items()], list(kinds))

        def flush():
            yield rows({**{k: [x[i] for x in trees] for i, k in enumerate(("host", "name", "tree"))}, "pages": list(trees.values())})
        for b in batches:
            found = []
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                root, blocks = read(page)
                text, name, slots = numbered(root)
                size += 0 if (host, name, text) in trees else len(text)
                trees[host, name, text] += 1
                # copies of a page count once, in its main part copies of its text
                for part in (False, True):
                    inside = [(slots[id(x.item)], block_hash(t), len(t), linked) for x, t, linked in blocks if not x.out and bool(x.main) == part]
                    if not inside:
                        continue
                    met, at = {}, {}
                    for slot, h, n, linked in inside:
                        x = met.get((slot, h))
                        if x is None:
                            x = met[slot, h] = [slot, h, 0, 0, tuple(at.get(h, ()))]
                            at.setdefault(h, []).append(slot)
                        x[2], x[3] = x[2] + n, x[3] + linked
                    same = digest(" ".join(str(x[1]) for x in inside)) if part else digest(page or "")
                    found.append((host, name, same, [dict(zip(("slot", "hash", "chars", "linked", "also"), x)) for x in met.values()]))
            yield rows({k: [x[i] for x in found] for i, k in enumerate(("host", "name", "page", "blocks"))})
            if size > 32_000_000:
                yield from flush()
                trees, size = Counter(), 0
        yield from flush()

    seen = materialize(pages.select(host_of(F.col(url)).alias("host"), html).mapInArrow(
        look, "host string, name string, tree string, pages long, page string, "
              "blocks array<struct<slot:int,hash:long,chars:long,linked:long,also:array<int>>>"), "page-trees")
    trees = materialize(seen.filter(F.col("tree").isNotNull()).groupBy("host", "name", "tree").agg(F.sum("pages").alias("pages")), "trees")
    parts, most = trees, None
    while most is None or most > FAN:
        sizes = parts.groupBy("host").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.agg(F.max("n")).first()[0] or 0
        part = F.pmod(F.xxhash64("tree"), F.ceil(F.col("n") / FAN)).cast("int")
        parts = materialize(_align(parts.join(sizes, "host").withColumn("part", part), ["host", "part"]).drop("part"), "wrappers")
    wrappers = parts.select("host", F.col("tree").alias("wrapper"), "pages")
    slots = materialize(_match(trees, wrappers), "slots")

    # slots of a tree may share a place in the wrapper: a block, a page counts once there
    places = (slots.groupBy("host", "name").agg(F.sort_array(F.collect_list(F.struct("slot", "place", "kind"))).alias("at"))
              .select("host", "name", F.transform("at", lambda x: x["place"]).alias("places"), F.transform("at", lambda x: x["kind"]).alias("kinds")))
    place = F.get("places", F.col("slot"))
    sums = [F.sum(k).alias(k) for k in ("n", "chars", "linked")]
    different = materialize(seen.filter(F.col("page").isNotNull()).dropDuplicates(["host", "page"]).select("host", "name", "blocks"), "different-pages")
    counts = materialize(
        different.select("host", "name", F.inline("blocks")).withColumn("n", F.lit(1)).groupBy("host", "name", "slot", "hash", "also").agg(*sums)
        .join(places, ["host", "name"])
        .withColumn("n", F.when(F.exists("also", lambda i: F.get("places", i) == place), 0).otherwise(F.col("n")))
        .select("host", place.alias("place"), F.get("kinds", F.col("slot")).alias("kind"), "hash", "n", "chars", "linked")
        .groupBy("host", "place", "kind", "hash").agg(*sums), "slot-blocks")
    page_counts = (different.select("host", "name", F.array_distinct(F.transform("blocks", lambda x: x["slot"])).alias("of")).groupBy("host", "name", "of")
                   .agg(F.count(F.lit(1)).alias("pages")).join(places, ["host", "name"])
                   .select("host", "pages", F.explode(F.array_distinct(F.transform("of", lambda i: F.get("places", i)))).alias("place"))
                   .groupBy("host", "place").agg(F.sum("pages").alias("pages")))
    totals = materialize(counts.groupBy("host", "place").agg((2 * F.sum("linked") <= F.sum("chars")).alias("plain")).join(page_counts, ["host", "place"]),
                         "slot-totals")
    # a block of a page counts once at a place, so this is on all pages with it
    fixed = (counts.join(totals, ["host", "place"])
             .filter((F.col("n") == F.col("pages")) & (F.col("n") >= F.when(F.col("kind") > 0, LEAST_TEXTS).otherwise(LEAST_PAGES))))
    # texts that share most of what they say are versions of one text, and nothing in them is their template's
    main = counts.filter(F.col("kind") > 0).groupBy("host").agg(F.sum("chars").alias("all_chars"))
    share = fixed.filter(F.col("kind") > 0).groupBy("host").agg(F.sum("chars").alias("fixed_chars")).join(main, "host")
    share = share.select("host", (F.col("fixed_chars") <= FIXED_SHARE * F.col("all_chars")).alias("few"))
    same = (fixed.join(share, "host", "left").filter((F.col("kind") <= 0) | F.col("few"))
            .groupBy("host", "place").agg(F.sort_array(F.collect_list("hash")).alias("same")))
    verdicts = (slots.join(totals.select("host", "place", "plain").join(same, ["host", "place"], "left"), ["host", "place"], "left")
                .withColumn("keep", (F.col("kind") > 0) | ((F.col("kind") == 0) & F.coalesce(F.col("plain"), F.lit(True)))))
    return wrappers, materialize(verdicts.groupBy("host", "name").agg(
        F.sort_array(F.collect_list(F.struct("slot", "place", "keep", "same"))).alias("slots")), "verdicts")


def extract(pages: DataFrame, slots: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``pages`` with the column ``main_text``: the blocks whose slots are kept, one per line."""
    small_batches(pages.sparkSession)
    pages = without(pages, "main_text", "wrapper_host", "wrapper_tree", "wrapper_blocks", "wrapper_slots")
    cols = [*pages.columns, "wrapper_host"]
    at = pages.columns.index(html)
    kind = pa.list_(pa.struct([("slot", pa.int32()), ("main", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))

    def run(batches):
        sys.setrecursionlimit(DEPTH)
        for b in batches:
            names, found = [], []
            for page in b.column(at).to_pylist():
                root, blocks = read(page)
                _, name, number = numbered(root)
                names.append(name)
                found.append([{"slot": number[id(x.item)], "main": x.main, "hash": block_hash(t), "text": t} for x, t, _ in blocks if not x.out])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(names, pa.string()), pa.array(found, kind)], [*cols, "wrapper_tree", "wrapper_blocks"])

    schema = (nullable(pages.schema).add("wrapper_host", "string").add("wrapper_tree", "string")
              .add("wrapper_blocks", T.ArrayType(T.StructType.fromDDL("slot int, main int, hash long, text string"))))
    found = pages.withColumn("wrapper_host", host_of(F.col(url))).select([F.col(f"`{c}`") for c in cols]).mapInArrow(run, schema)
    joined = found.join(slots.select(F.col("host").alias("wrapper_host"), F.col("name").alias("wrapper_tree"), F.col("slots").alias("wrapper_slots")),
                        ["wrapper_host", "wrapper_tree"], "left")

    def keep(x):
        verdict = F.get("wrapper_slots", x["slot"])
        return F.coalesce(verdict["keep"], F.lit(True)) & ~F.coalesce(F.array_contains(verdict["same"], x["hash"]), F.lit(False))
    kept = F.filter("wrapper_blocks", keep)
    most = F.transform(F.array(kept), lambda k: F.struct(k.alias("k"), F.array_max(F.transform(k, lambda x: x["main"])).alias("most")))
    text = F.transform(most, lambda s: F.array_join(F.transform(F.filter(s["k"], lambda x: x["main"] == s["most"]), lambda x: x["text"]), "\n"))[0]
    return joined.select(*[F.col(f"`{c}`") for c in pages.columns], text.alias("main_text"))
