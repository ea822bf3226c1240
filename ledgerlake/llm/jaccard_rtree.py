"""N-gram Jaccard join with count-vector R-trees.

A document is the set of its hashed word shingles. The shingles are dealt into ``GROUPS`` groups;
the counts per group are the document's point. For two documents the sum over the groups of the
smaller count is at least their overlap, and for two boxes of an R-tree the sum of the smaller
upper corners bounds the overlap of any two points in them; pairs and boxes whose bound is below
the overlap that the threshold needs are passed over, the others are verified on the sets.

Boxes of random points prune little, so one tree over a corpus would compare every document with
every other of its size. The points are therefore dealt to cells first, each with a tree of its
own: linked documents must share one of the first ``n - ceil(t n) + 1`` shingles of either in
any common order of the shingles (rare ones first), so every link has both ends in a cell. No
link is lost: cells that hold the same documents are searched once.

Only connections matter to components: in a cell, surviving pairs are tried from the highest
bound down while they join documents not yet joined. What the sets confirm is joined; then every
surviving pair of a cell whose ends are still in different components is verified as well. A cell
of more than ``FOREST`` points is dealt into parts that share one of them; in the second round
the points outside the cell's largest component meet all parts, so no pair of unlike components
is left out and no task holds a whole large cell. Equal sets are one point from the start, so
copies are never paired.

A shingle is frequent when it makes up ``FREQUENT`` of all shingles or more, so at most 1/FREQUENT
are; their counts order the shingles and change which cells there are, never which links.

Defined cases: null and empty texts have no shingle, no link and are their own component; texts
shorter than a shingle are one shingle, linked only with equal ones; rows with equal doc_id and text
count as one document; a null doc_id is the component of rows linked with no other doc_id; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import gc
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm.common import WORD, aside, materialize, small_batches

GROUPS = 256
#: Rate at which a shingle is frequent, and the shingles that a task counts together.
FREQUENT, CHUNK = 1 / (1 << 19), 1 << 22
#: Points of an R-tree leaf; cells of more than FOREST points are dealt into parts of half as many.
LEAF, FOREST = 32, 1024
#: Pairs that a task holds before it passes them on.
FLUSH = 200_000
#: Words whose hashes a worker remembers.
REMEMBERED = 400_000
NARROW_ROWS = 20_000
_WORD = re.compile(WORD.encode())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit permutation that spreads every bit (splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


class Shingles:
    """Texts -> sorted arrays of the 64-bit hashes of their distinct word shingles."""

    def __init__(self, width: int):
        self.width, self.known = width, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _WORD.findall((text or "").encode().translate(_LOWER))
        if not words:
            return np.zeros(0, np.uint64)
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        width = min(self.width, len(h))
        x = np.full(len(h) - width + 1, width, np.uint64)
        for k in range(width):
            x = mixed(x * _A + h[k:len(h) - width + 1 + k])
        return np.unique(x)


def point(shingles: np.ndarray) -> np.ndarray:
    """Counts per group; 16 bits each, saturated (see ``needs_no_bound``)."""
    return np.minimum(np.bincount((shingles >> np.uint64(40)).astype(np.int64) % GROUPS, minlength=GROUPS), 65535).astype("<u2")


def identity(shingles: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return (d >> 64) - (1 << 63), (d & 0xFFFFFFFFFFFFFFFF) - (1 << 63)


def needed(sizes, percent: int):
    """Overlap that two sets of these sizes together need: inter >= t (a + b) / (1 + t)."""
    return -(-percent * sizes // (100 + percent))


def prefix(shingles: np.ndarray, hashes: np.ndarray, counts: np.ndarray, percent: int) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles, rare ones first, then by hash."""
    n = len(shingles)
    k = n + percent * n // -100 + 1
    at = np.searchsorted(hashes, shingles) if len(hashes) else np.zeros(n, np.int64)
    at = np.minimum(at, max(0, len(hashes) - 1))
    often = np.where(hashes[at] == shingles, counts[at], 0) if len(hashes) else np.zeros(n, np.int64)
    return shingles[np.lexsort((shingles, often))[:k]]


# ---- the tree of a cell ----

def survivors(points: np.ndarray, sizes: np.ndarray, percent: int, labels: np.ndarray | None = None):
    """Blocks (i, j, bound) of pairs whose summed minima reach the needed overlap; of unlike labels only.

    A packed R-tree: points sorted by label and size fill leaves of ``LEAF``; pairs of leaves are
    bounded by their upper corners and sizes, those left by their points. One block holds the
    pairs of one leaf with the leaves from it on.
    """
    order = np.lexsort((sizes, labels)) if labels is not None else np.argsort(sizes, kind="stable")
    leaves = [order[i:i + LEAF] for i in range(0, len(order), LEAF)]
    corner = np.array([points[x].max(axis=0) for x in leaves])
    low, high = np.array([sizes[x].min() for x in leaves]), np.array([sizes[x].max() for x in leaves])
    only = [labels[x[0]] if labels is not None and (labels[x] == labels[x[0]]).all() else None for x in leaves]
    for a, x in enumerate(leaves):
        out_i, out_j, out_b = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        bound = np.minimum(corner[a], corner[a:]).sum(axis=1, dtype=np.int64)
        fits = (bound >= needed(low[a] + low[a:], percent)) | (high[a] > 65535)
        fits &= (100 * high[a:] >= percent * low[a]) & (100 * high[a] >= percent * low[a:])
        for b in np.flatnonzero(fits) + a:
            if only[a] is not None and only[a] == only[b]:
                continue
            y = leaves[b]
            sums = np.minimum(points[x][:, None, :], points[y][None, :, :]).sum(axis=2, dtype=np.int64)
            both = sizes[x][:, None] + sizes[y][None, :]
            ok = (sums >= needed(both, percent)) | (np.maximum(sizes[x][:, None], sizes[y][None, :]) > 65535)
            ok &= (100 * sizes[x][:, None] >= percent * sizes[y][None, :]) & (100 * sizes[y][None, :] >= percent * sizes[x][:, None])
            if a == b:
                ok = np.triu(ok, 1)
            if labels is not None:
                ok &= labels[x][:, None] != labels[y][None, :]
            i, j = np.nonzero(ok)
            out_i.append(x[i].astype(np.int32))
            out_j.append(y[j].astype(np.int32))
            out_b.append((sums[i, j] / np.maximum(1, both[i, j] - sums[i, j])).astype(np.float32))
        yield np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_b)


def together(blocks) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = list(blocks)
    return tuple(np.concatenate([p[k] for p in parts]) for k in range(3))


def forest(i: np.ndarray, j: np.ndarray, bound: np.ndarray, nodes: np.ndarray) -> list[tuple[int, int]]:
    """Pairs from the highest bound down that join what is not yet joined."""
    top = list(range(len(nodes)))

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x
    out = []
    # equal bounds by the nodes' order, so cells that share documents choose the same pairs
    rank = np.argsort(np.argsort(nodes)).astype(np.int32)
    for k in np.lexsort((np.maximum(rank[i], rank[j]), np.minimum(rank[i], rank[j]), -bound)).tolist():
        a, b = find(int(i[k])), find(int(j[k]))
        if a != b:
            top[a] = b
            out.append((int(min(nodes[i[k]], nodes[j[k]])), int(max(nodes[i[k]], nodes[j[k]]))))
            if len(out) == len(nodes) - 1:
                break
    return out


def runs(batches, keys: int):
    """Arrow batches sorted by their first ``keys`` columns -> tables that never split a run of equal keys."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        held = t if held is None else pa.concat_tables([held, t])
        cols = [held.column(c).to_numpy() for c in range(keys)]
        last = np.ones(held.num_rows, bool)
        for c in cols:
            last &= c == c[-1]
        cut = held.num_rows - int(last.sum())
        if cut >= NARROW_ROWS or (cut and held.num_rows >= NARROW_ROWS):
            yield held.slice(0, cut)
            held = held.slice(cut)
    if held is not None and held.num_rows:
        yield held


def starts_of(*columns: np.ndarray) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# ---- the join ----

def _base(docs: DataFrame, width: int) -> DataFrame:
    """Rows of documents (doc_id, tie, n, c1, c2, point) and of shingles frequent in a task (shingle, n)."""
    def run(batches):
        cut, pending, size = Shingles(width), [], 0

        def frequent():
            h, c = np.unique(np.concatenate(pending), return_counts=True)
            hit = c >= max(2, FREQUENT * size * 0.5)
            none = pa.nulls(int(hit.sum()))
            return pa.RecordBatch.from_arrays([none.cast(ids), none.cast(pa.int64()), pa.array(c[hit].astype(np.int64)), none.cast(pa.int64()),
                                               none.cast(pa.int64()), none.cast(pa.binary()), pa.array(h[hit].view(np.int64))], names)
        names = ["doc_id", "tie", "n", "c1", "c2", "point", "shingle"]
        ids = None
        for b in batches:
            ids = b.schema.field("doc_id").type
            sets = [cut(t) for t in b.column(2).to_pylist()]
            key = [identity(s) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array([k[0] for k in key], pa.int64()),
                 pa.array([k[1] for k in key], pa.int64()), pa.array([point(s).tobytes() for s in sets], pa.binary()), pa.nulls(len(sets), pa.int64())], names)
            pending += sets
            size += sum(map(len, sets))
            if size >= CHUNK:
                yield frequent()
                pending, size = [], 0
        if size:
            yield frequent()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("tie"), "text").mapInArrow(
        run, f"doc_id {kind}, tie long, n long, c1 long, c2 long, point binary, shingle long")


def _frequent(spark: SparkSession, base: DataFrame):
    """Hashes and counts of the frequent shingles, sorted by hash; fewer than 1/FREQUENT."""
    total = base.filter(F.col("shingle").isNull()).agg(F.sum("n")).first()[0] or 0
    least = max(16.0, FREQUENT * total)
    rows = (base.filter(F.col("shingle").isNotNull()).groupBy("shingle").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least)).collect()
    h = np.array([r[0] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(h)
    return h[order], np.array([r[1] for r in rows], np.int64)[order]


#: Different sets that a task remembers.
REMEMBERED = 1 << 18


def _signatures(docs: DataFrame, width: int, percent: int, hashes: np.ndarray, counts: np.ndarray) -> DataFrame:
    """(shingle, c1, c2) of the first shingles of every different set; a task sends copies of a set once."""
    sent = docs.sparkSession.sparkContext.broadcast((hashes, counts))

    def run(batches):
        cut = Shingles(width)
        known: set[tuple[int, int]] = set()
        for b in batches:
            new = {}
            if len(known) > REMEMBERED:
                known.clear()  # what is sent again is dropped where its shingles meet
            for t in b.column(0).to_pylist():
                s = cut(t)
                if len(s) and (name := identity(s)) not in known:
                    known.add(name)
                    new[name] = s
            heads = [prefix(s, *sent.value, percent) for s in new.values()]
            size = [len(h) for h in heads]
            key = np.array(list(new), np.int64).reshape(-1, 2)
            flat = np.concatenate(heads) if heads else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), pa.array(np.repeat(key[:, 0], size)), pa.array(np.repeat(key[:, 1], size))],
                                             ["shingle", "c1", "c2"])

    return docs.select("text").mapInArrow(run, "shingle long, c1 long, c2 long")


def _cells(signatures: DataFrame) -> DataFrame:
    """(d1, d2, c1, c2): the different sets of documents that share a shingle, each named by its members."""
    def run(batches):
        seen: set[tuple[int, int]] = set()
        for t in runs(batches, 1):
            s, c1, c2 = (t.column(k).to_numpy() for k in range(3))
            keep = starts_of(s, c1, c2)  # copies have the same shingles
            s, c1, c2 = s[keep], c1[keep], c2[keep]
            at = starts_of(s)
            size = np.diff(np.append(at, len(s)))
            x = mixed(c1.view(np.uint64) * _A + c2.view(np.uint64))
            d1, d2 = np.add.reduceat(x, at).view(np.int64), np.add.reduceat(mixed(x + _A), at).view(np.int64)
            new = []
            for k in np.flatnonzero(size > 1):
                name = (int(d1[k]), int(d2[k]))
                if name not in seen:
                    seen.add(name)
                    new.append(k)
            new = np.array(new, np.int64)
            rows = np.concatenate([np.arange(at[k], at[k] + size[k]) for k in new]) if len(new) else new
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(d1[new], size[new])), pa.array(np.repeat(d2[new], size[new])),
                                              pa.array(c1[rows]), pa.array(c2[rows])], ["d1", "d2", "c1", "c2"])

    dealt = signatures.repartition("shingle").sortWithinPartitions("shingle", "c1", "c2")
    found = dealt.mapInArrow(run, "d1 long, d2 long, c1 long, c2 long")
    return found.dropDuplicates(["d1", "d2", "c1", "c2"])


def _tried(cells: DataFrame, percent: int) -> DataFrame:
    """(a, b): pairs of nodes to verify, from cells (d1, d2, part, node, n, point, label or null).

    Without labels the first round: a forest of the surviving pairs of each part. With labels every
    surviving pair of unlike labels.
    """
    def batch(found: list) -> pa.RecordBatch:
        both = np.unique(np.concatenate(found), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], ["a", "b"])

    def run(batches):
        for t in runs(batches, 3):
            d1, d2, part, node, n = (t.column(k).to_numpy() for k in range(5))
            points = np.frombuffer(b"".join(t.column(5).to_pylist()), dtype="<u2").reshape(len(node), GROUPS)
            labels = None if t.column(6).null_count else t.column(6).to_numpy()
            at = starts_of(d1, d2, part)
            size = np.diff(np.append(at, len(node)))
            found, rows_ = [], 0
            two = at[size == 2]
            if len(two) and labels is None:
                sums = np.minimum(points[two], points[two + 1]).sum(axis=1, dtype=np.int64)
                x, y = n[two], n[two + 1]
                ok = ((sums >= needed(x + y, percent)) | (np.maximum(x, y) > 65535)) & (100 * x >= percent * y) & (100 * y >= percent * x)
                found.append(np.stack([np.minimum(node[two], node[two + 1])[ok], np.maximum(node[two], node[two + 1])[ok]], axis=1))
            for k, m in zip(at[size > 2], size[size > 2]):
                rows = slice(k, k + m)
                p, s, v = points[rows], n[rows], node[rows]
                if labels is not None:
                    parts = (np.stack([np.minimum(v[i], v[j]), np.maximum(v[i], v[j])], axis=1) for i, j, _ in survivors(p, s, percent, labels[rows]))
                else:
                    parts = [np.array(forest(*together(survivors(p, s, percent)), v), np.int64).reshape(-1, 2)]
                for pairs in parts:
                    found.append(pairs)
                    rows_ += len(pairs)
                    if rows_ > FLUSH:
                        yield batch(found)
                        found, rows_ = [], 0
            if found:
                yield batch(found)

    dealt = (cells.select("d1", "d2", "part", "node", "n", "point", "label").repartition("d1", "d2", "part")
             .sortWithinPartitions("d1", "d2", "part", "node"))
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _parts(cells: DataFrame, everywhere) -> DataFrame:
    """Large cells (parts > 1) dealt into parts; rows where ``everywhere`` holds go to all parts of their cell."""
    own = F.array(F.pmod(F.xxhash64("node"), F.col("parts")))
    return cells.withColumn("part", F.explode(F.when(everywhere, F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(own)))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (node, set) reach the threshold."""
    left = sets.select(F.col("node").alias("a"), F.col("set").alias("set_a"))
    right = sets.select(F.col("node").alias("b"), F.col("set").alias("set_b"))

    def run(batches):
        for t in batches:
            keep = []
            for k, (x, y) in enumerate(zip(t.column(2).to_pylist(), t.column(3).to_pylist())):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                small, large = (x, y) if len(x) <= len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                inter = int((large[at] == small).sum())
                if 100 * inter >= percent * (len(x) + len(y) - inter):
                    keep.append(k)
            yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(keep, pa.int64())), t.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    # sorted joins at every size: what is broadcast at one would not be at the next
    both = pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "set_a", "set_b")
    return both.mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the links (a, b) is connected with.

    Large-star and small-star steps turn the links into stars around the smallest node in a number
    of rounds that grows with the logarithm of the longest path.
    """
    edges = materialize(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        before = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = materialize(both.join(materialize(least, "star"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .filter("u != v").distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        joined = large.join(least, "u")
        edges = materialize(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
                            .filter("u != v").distinct(), "small-star")
        if edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of what has been written and is no longer needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def near_groups(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, tie, n_shingles, node (null without shingles), label, component_id: a row per row of ``docs``.

    Rows of one component have the same label; component_id is its smallest doc_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = materialize(_base(docs, width), "shingles")
    rows = base.filter(F.col("shingle").isNull()).drop("shingle")
    classes = materialize(rows.filter("n > 0").groupBy("c1", "c2")
                          .agg(F.min("doc_id").alias("rep"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "tie")).alias("row"),
                               F.first("n").alias("n"), F.first("point").alias("point"))
                          .withColumn("node", F.monotonically_increasing_id()), "classes")
    signatures = _signatures(docs, width, percent, *_frequent(spark, base))
    cells = materialize(_cells(signatures), "cells")
    release(spark)
    cells = materialize(cells.join(classes.select("c1", "c2", "node", "n", "point").hint("merge"), ["c1", "c2"]).drop("c1", "c2"), "cell-points")
    release(spark)
    large = materialize(cells.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("hub")).filter(F.col("size") > FOREST)
                        .select("d1", "d2", "hub", F.ceil(F.col("size") * 2 / FOREST).alias("parts")), "large-cells")
    sized = cells.join(large, ["d1", "d2"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    first = _parts(sized.withColumn("label", F.lit(None).cast("long")), F.col("node") == F.col("hub"))
    pairs = materialize(_tried(first, percent), "pairs")
    release(spark)
    links = _verified(docs, classes, pairs, width, percent)
    labels = materialize(components(links), "labels")
    release(spark)
    # what is left: cells of several components, larger than two
    # without the points until it is known which cells are open; sorted joins as above
    named = materialize(sized.select("d1", "d2", "node", "parts").join(labels.hint("merge"), "node", "left")
                        .withColumn("label", F.coalesce("label", "node")), "cell-labels")
    open_cells = materialize(named.groupBy("d1", "d2").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size"))
                             .filter("low != high and size > 2").select("d1", "d2"), "open-cells")
    # a pair of unlike labels has an end outside the cell's most frequent label: those ends go to all parts
    most = materialize(named.filter("parts > 1").groupBy("d1", "d2", "label").agg(F.count(F.lit(1)).alias("size"))
                       .groupBy("d1", "d2").agg(F.max_by("label", F.struct("size", "label")).alias("most")), "most-labels")
    rest = _parts(named.join(open_cells, ["d1", "d2"]).join(most, ["d1", "d2"], "left"), F.col("label") != F.col("most"))
    rest = rest.join(classes.select("node", "n", "point").hint("merge"), "node")
    more = materialize(_tried(rest, percent).join(pairs, ["a", "b"], "left_anti"), "more-pairs")
    if more.take(1):
        links = links.unionByName(_verified(docs, classes, more, width, percent))
        labels = materialize(components(links), "labels")
    release(spark)
    named = materialize(classes.select("c1", "c2", "rep", "node").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "named")
    smallest = materialize(named.groupBy("label").agg(F.min("rep").alias("component_id")), "smallest")
    known = materialize(named.join(smallest, "label").select("c1", "c2", "node", "label", "component_id"), "components")
    return (rows.select("doc_id", "tie", F.col("n").alias("n_shingles"), "c1", "c2").join(known, ["c1", "c2"], "left")
            .select("doc_id", "tie", "n_shingles", "node", "label",
                    F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))


def _verified(docs: DataFrame, classes: DataFrame, pairs: DataFrame, width: int, percent: int) -> DataFrame:
    """The links among the pairs, from the texts of one document of each set that is in a pair."""
    spark = docs.sparkSession
    wanted = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    of = materialize(classes.join(wanted, "node").select("node", F.col("row.doc_id").alias("row_id"), F.col("row.tie").alias("row_tie")), "wanted")
    texts = docs.select("doc_id", F.xxhash64("text").alias("tie"), "text")
    hit = texts["doc_id"].eqNullSafe(of["row_id"]) & (texts["tie"] == of["row_tie"])

    def run(batches):
        cut = Shingles(width)
        for b in batches:
            sets = [cut(t).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["node", "set"])

    sets = materialize(texts.join(of.hint("merge"), hit).select("node", "text").mapInArrow(run, "node long, set binary"), "sets")
    release(spark)
    links = materialize(_linked(pairs, sets, percent).distinct(), "verified")
    release(spark)
    return links


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one document of each component: the row of the smallest doc_id."""
    groups = materialize(near_groups(docs.select("doc_id", "text"), width, percent), "near-groups")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")).alias("row")
    one = groups.filter(F.col("label").isNotNull()).groupBy("label").agg(first).select("row.doc_id", "row.tie")
    kept = materialize(one.unionByName(groups.filter(F.col("label").isNull()).select("doc_id", "tie")).distinct(), "near-kept")
    kept = kept.select(F.col("doc_id").alias("near_id"), F.col("tie").alias("near_tie"))
    plain, back = aside(docs, "doc_id", "text")
    own = plain.withColumn("near_key", F.xxhash64("text"))
    hit = own["doc_id"].eqNullSafe(kept["near_id"]) & (own["near_key"] == kept["near_tie"])
    return back(own.join(kept, hit, "left_semi").dropDuplicates(["doc_id", "near_key"]))
