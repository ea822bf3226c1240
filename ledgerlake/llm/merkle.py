"""Document fingerprints: Merkle trees over sections, paragraphs and pieces.

A text is a list of sections, a section a run of paragraphs, a paragraph (line) a run of pieces:
clauses of 24 to 160 characters, or blocks of up to 4. Texts of ``CLAUSES_FROM`` characters have a
tree of clauses, texts below ``BLOCKS_BELOW`` a tree of blocks, those between both, so two texts
of like length always have a tree of the same kind. A piece is hashed, a paragraph hashes its
pieces, a section its paragraphs, the root its sections.
Sections end at blank lines and after paragraphs whose hash is 0 modulo ``SECTION``, so an edit
moves no border beyond the section it is in. Equal roots mean equal texts; where roots differ,
the branches that differ locate the edit.

A fingerprint is text: the root's 32 hex digits, ``:``, the tree of clauses, and, if there is one,
``|`` and the tree of blocks. A tree is its sections joined by ``;``, each the first 8 digits of its
hash, ``/`` and its paragraphs joined by ``,``; a paragraph is the first 6 digits of each of its
pieces. Likeness is twice the pieces that two trees share over all their pieces, found from
the top: equal sections and equal paragraphs are taken whole, pieces are compared in the rest only.
It is that of the blocks if both texts have them, else of the clauses.

Defined cases: null text counts as empty, whose fingerprint has no section; likeness of equal
roots is 1, of a text with and one without pieces 0, of texts without a common kind of tree (one
has more than ``BLOCKS_BELOW / CLAUSES_FROM`` times the other's length) 0; the next document follows in order of
doc_id (null first), then of the text's hash; repeated rows follow each other; the last is
followed by the first, a single one by itself; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b, sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.common import materialize, nullable, small_batches, without

CLAUSES_FROM = 160
BLOCKS_BELOW = 640
SECTION = 8
_PIECES = re.compile(r".{24,160}?(?:[.,;:!?|][ \t]|$)|.{1,160}(?!\S)|.{1,160}|\n+", re.M)
_BLOCKS = re.compile(r"[^\S\n]*[^\s]{1,4}[^\S\n]*|[^\S\n]+|\n+")


def sections(text: str, blocks: bool = False) -> list[list[list[str]]]:
    """Sections of paragraphs of pieces; joined, the pieces are the text (line ends go with the next)."""
    out, paragraph, section, line_end = [], [], [], ""
    for piece in (_BLOCKS if blocks else _PIECES).findall(text):
        if piece[0] != "\n":
            paragraph.append(line_end + piece)
            line_end = ""
            continue
        if paragraph:
            section.append(paragraph)
            if len(piece) > 1 or blake2b("".join(paragraph).encode(), digest_size=1).digest()[0] % SECTION == 0:
                out.append(section)
                section = []
        paragraph, line_end = [], piece
    if line_end:
        paragraph.append(line_end)
    if paragraph:
        section.append(paragraph)
    if section:
        out.append(section)
    return out


def hashed(text: str, blocks: bool = False) -> tuple[bytes, list[tuple[bytes, list[list[bytes]]]]]:
    """Root, and per section its hash and the piece hashes of its paragraphs."""
    tree, tops = [], []
    for section in sections(text, blocks):
        leaves = [[blake2b(p.encode(), digest_size=16).digest() for p in paragraph] for paragraph in section]
        top = blake2b(b"".join(blake2b(b"".join(x), digest_size=16, person=b"paragraph").digest() for x in leaves),
                      digest_size=16, person=b"section").digest()
        tops.append(top)
        tree.append((top, leaves))
    return blake2b(b"".join(tops), digest_size=16, person=b"root").digest(), tree


def _printed(tree) -> str:
    return ";".join(top.hex()[:8] + "/" + ",".join("".join([leaf[:3].hex() for leaf in leaves]) for leaves in paragraphs)
                    for top, paragraphs in tree)


def fingerprint(text: str | None) -> str:
    text = text or ""
    clauses = hashed(text) if len(text) >= CLAUSES_FROM else None
    blocks = hashed(text, True) if len(text) < BLOCKS_BELOW else None
    return ((clauses or blocks)[0].hex() + ":" + (_printed(clauses[1]) if clauses else "")
            + ("|" + _printed(blocks[1]) if blocks else ""))


def _rest(x: list[str], y: list[str]) -> tuple[list[str], list[str], list[str]]:
    """(in both, only in ``x``, only in ``y``), each as often as it is there."""
    left, right = Counter(x), Counter(y)
    both = left & right
    return list(both.elements()), list((left - both).elements()), list((right - both).elements())


def _pieces(paragraphs: list[str]) -> list[str]:
    return [p[i:i + 6] for p in paragraphs for i in range(0, len(p), 6)]


def _alike(a: str, b: str) -> float:
    """The share of pieces that two printed trees have in common, by branches from the top."""
    total = sum(len(p) // 6 for t in (a, b) for s in t.split(";") for p in s[9:].split(","))
    if not total:
        return 0.0
    equal, x, y = _rest(a.split(";"), b.split(";"))
    same = sum(len(p) // 6 for s in equal for p in s[9:].split(","))
    equal, x, y = _rest(*([p for s in t for p in s[9:].split(",")] for t in (x, y)))
    same += sum(len(p) // 6 for p in equal) + len(_rest(_pieces(x), _pieces(y))[0])
    return 2 * same / total


def likeness(a: str, b: str) -> float:
    """0 to 1: the share of pieces that two fingerprints have in common."""
    if a[:32] == b[:32]:
        return 1.0
    (x, x_bar, x_blocks), (y, y_bar, y_blocks) = a[33:].partition("|"), b[33:].partition("|")
    return _alike(x_blocks, y_blocks) if x_bar and y_bar else _alike(x, y) if x and y else 0.0


def edits(old: str, new: str) -> list[tuple[int, int]]:
    """Spans (start, end) of ``new`` in branches that ``old`` does not have."""
    blocks = min(len(old), len(new)) < CLAUSES_FROM
    before = hashed(old, blocks)[1]
    seen = {leaf for _, paragraphs in before for leaves in paragraphs for leaf in leaves}
    known = {top for top, _ in before}
    spans, at = [], 0
    for section, (top, _) in zip(sections(new, blocks), hashed(new, blocks)[1]):
        for paragraph in section:
            for piece in paragraph:
                end = at + len(piece)
                if top not in known and blake2b(piece.encode(), digest_size=16).digest() not in seen:
                    if spans and spans[-1][1] == at:
                        spans[-1] = (spans[-1][0], end)
                    else:
                        spans.append((at, end))
                at = end
    return spans


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the column ``merkle``."""
    small_batches(docs.sparkSession)
    docs = without(docs, "merkle")
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            prints = pa.array([fingerprint(t) for t in b.column(at).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns, prints], [*b.schema.names, "merkle"])

    return docs.mapInArrow(run, nullable(docs.schema).add("merkle", "string"))


def tail_replaced(text: str, following: str, parts: int = 4) -> str:
    """The last 1/parts of a text replaced by as many first characters of the following one."""
    k = len(text) // parts
    return text[:len(text) - k] + following[:k]


_RESULT = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _compared(text: str, own: str, following: str, next_print: str) -> tuple:
    edited = tail_replaced(text, following)
    changed = fingerprint(edited)
    return (len(text), sha256(edited.encode()).hexdigest(), own, changed, likeness(own, changed), likeness(own, next_print))


def against_next(docs: DataFrame) -> DataFrame:
    """Each document (doc_id, text) against its edited text and the next document.

    The rows are sorted by range once; a task streams its range with one row held back. Only the
    first and the last row of each range travel further, to meet across the border.
    """
    spark = docs.sparkSession
    small_batches(spark)
    kinds = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_chars", T.LongType()),
                          *(T.StructField(c, T.StringType()) for c in _RESULT[1:4]),
                          *(T.StructField(c, T.DoubleType()) for c in _RESULT[4:]),
                          T.StructField("part", T.IntegerType()), T.StructField("edge", T.StringType()), T.StructField("text", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(kinds)

    def run(batches):
        from pyspark import TaskContext
        part, held = TaskContext.get().partitionId(), None
        for b in batches:
            rows = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                text = text or ""
                own = fingerprint(text)
                if held is None:
                    rows.append((doc_id, None, None, own, None, None, None, part, "first", text))
                else:
                    rows.append((held[0], *_compared(held[1], held[2], text, own), None, None, None))
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)
        if held is not None:
            row = (held[0], None, None, held[2], None, None, None, part, "last", held[1])
            yield pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(row, arrow)], schema=arrow)

    key = F.xxhash64(F.coalesce("text", F.lit("")))
    ordered = (docs.select("doc_id", "text", key.alias("tie")).repartitionByRange("doc_id", "tie")
               .sortWithinPartitions("doc_id", "tie").select("doc_id", "text"))
    rows = ordered.mapInArrow(run, kinds)
    path = materialize(rows, "merkle", "zstd")  # hex digits halve
    edges = path.filter(F.col("edge").isNotNull())
    parts = edges.filter("edge = 'first'").select("part")  # one row per range
    order = Window.orderBy("part")
    following = parts.withColumn("next", F.coalesce(F.lead("part").over(order), F.first("part").over(
        order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))
    ends = (edges.filter("edge = 'last'").select("doc_id", "text", "fingerprint", "part").join(following, "part")
            .join(edges.filter("edge = 'first'").select(F.col("part").alias("next"), F.col("text").alias("next_text"),
                                                        F.col("fingerprint").alias("next_print")), "next")
            .select("doc_id", "text", "fingerprint", "next_text", "next_print"))
    closed = T.StructType(kinds.fields[:len(_RESULT) + 1])
    shape = to_arrow_schema(closed)

    def close(batches):
        for b in batches:
            rows = [(i, *_compared(t, own, n, p)) for i, t, own, n, p in zip(*(c.to_pylist() for c in b.columns))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), shape)], schema=shape)

    return path.filter(F.col("edge").isNull()).select("doc_id", *_RESULT).unionByName(ends.mapInArrow(close, closed))
