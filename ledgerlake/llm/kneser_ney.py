"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Counting: each task turns its training texts into word hashes, counts their bigrams in chunks
and sends the counts, packed by shard, to the task of the shard; a shard holds contexts by hash, with the
few very frequent contexts split over several. A shard writes its bigrams as sorted hash
arrays to a file in the shared folder, with the totals and type counts of its contexts, and passes on how many
different words stand before each word; a second round of shards does the same for words.
Scoring: workers map the files into memory and look up the bigrams of a batch by binary search.
Everything is counted over all training texts; discounts come from the counts of counts.

    P(w|v) = (max(c(vw) - D(c), 0) + (D1 N1(v) + D2 N2(v) + D3 N3+(v)) P(w)) / c(v)
    P(w)   = (max(n(w) - D'(n), 0) + (D1' M1 + D2' M2 + D3' M3+) / (V + 1)) / T

with n(w) the different words before w, T their sum, M the numbers of words with n = 1, 2, 3 or
more, V the different tokens; a context that was never seen leaves P(w).

Defined cases: null text counts as empty, whose only token is the end; without training rows
every token has probability 1/(V + 1) = 1; repeated rows count each; an empty table gives no
rows; columns named like the added ones (``lm_*``) are replaced, others kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.common import WORD, materialize, nullable, partitions, scratch, small_batches, without
from ledgerlake.llm.shared_files import get_arrays, put_arrays

#: Tokens that a task counts together, and that a shard is sized for.
CHUNK, SHARD = 1 << 22, 1 << 21
#: A context is split when it holds more than 1/SPLIT of a shard, over PARTS shards.
SPLIT, PARTS = 4, 16
REMEMBERED = 300_000
_WORD = re.compile(WORD.encode())
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
START, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in (b" start", b" end"))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def bigram(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    x = (v ^ (v >> np.uint64(31))) * _A + w
    x = (x ^ (x >> np.uint64(30))) * _B
    return x ^ (x >> np.uint64(27))


def tokens(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode().translate(_LOWER))


class Hashes:
    """Texts -> token hashes, each text closed by the end token."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all tokens, and the number of tokens of each text."""
        known, parts, sizes = self.known, [], []
        for text in texts:
            words = tokens(text)
            if len(known) > REMEMBERED:
                known.clear()
            for w in set(words).difference(known):
                known[w] = xxhash.xxh3_64_intdigest(w)
            h = np.empty(len(words) + 1, np.uint64)
            h[:-1] = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
            h[-1] = END
            parts.append(h)
            sizes.append(len(h))
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.array(sizes, np.int64)


def before(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The token before each token; the start before the first of a text."""
    v = np.empty_like(h)
    v[1:] = h[:-1]
    v[np.cumsum(sizes) - sizes] = START
    return v


def shard_of(v: np.ndarray, w: np.ndarray, split: np.ndarray, shards: int) -> np.ndarray:
    """Shards of bigrams: by context, those in ``split`` also by word."""
    s = (v >> np.uint64(20)) % np.uint64(shards)
    if len(split):
        at = np.minimum(np.searchsorted(split, v), len(split) - 1)
        s = np.where(split[at] == v, (s + ((w >> np.uint64(24)) % np.uint64(PARTS)) * np.uint64(7919)) % np.uint64(shards), s)
    return s.astype(np.int64)


#: Largest part of a count in a packed row.
WIDEST = 2 ** 32 - 1


def summed(keys: np.ndarray, *values: np.ndarray) -> tuple:
    """Distinct keys, sorted, with the sums of their values."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    at = np.flatnonzero(np.append(np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]))
    return keys[at], *(np.add.reduceat(x[order], at) if len(at) else x for x in values)


@dataclass
class Model:
    files: list[str] = field(default_factory=list)        # bigrams and contexts by shard
    word_files: list[str] = field(default_factory=list)   # words by shard
    split: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    discounts: tuple = (0.0, 0.0, 0.0)
    lower: tuple = (0.0, 0.0, 0.0)
    types: int = 0        # T: different bigrams
    left: float = 1.0     # mass of P(w) for unseen words, before it is shared by V + 1
    total: int = 0        # N
    vocabulary: int = 0   # V


def discounts(n: list[int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from the numbers of things counted 1, 2, 3 and 4 times, within (0, count]."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05 * k), 0.95 * k) for k, d in enumerate(raw, 1))


def chunks(c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts as 32-bit parts: the place each part belongs to, and the part; larger counts have several, which add up to them."""
    times = np.maximum(-(-c // WIDEST), 1)
    at = np.repeat(np.arange(len(c)), times)
    before = (np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)) * WIDEST
    return at, np.minimum(c[at] - before, WIDEST).astype(np.uint32)


_PACK = ["shard", "kind", "v", "w", "c"]
_PACK_TYPE = "shard int, kind string, v binary, w binary, c binary"


def _packed(shard: np.ndarray, kind: str, shards: int, v, w: np.ndarray, c: np.ndarray):
    """Rows of counts by shard: keys as 64-bit and counts as 32-bit arrays."""
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(shards + 1))
    rows = []
    for s in range(shards):
        i = order[ends[s]:ends[s + 1]]
        if len(i):
            at, part = chunks(c[i])
            rows.append((s, kind, v[i][at].tobytes() if v is not None else b"", w[i][at].tobytes(), part.tobytes()))
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [[]] * 5, (pa.int32(), pa.string(), *[pa.binary()] * 3))], _PACK)


def _shard_rows(batches):
    """Packed rows sorted by shard -> (shard, {kind: (v, w, c)}) with all counts of a shard."""
    held, at = {}, None

    def close():
        out = {}
        for kind, rows in held.items():
            v, w, c = (b"".join(r[k] for r in rows) for k in range(3))
            out[kind] = np.frombuffer(v, np.uint64), np.frombuffer(w, np.uint64), np.frombuffer(c, np.uint32).astype(np.int64)
        return at, out
    for b in batches:
        for shard, kind, *data in zip(*(b.column(k).to_pylist() for k in range(5))):
            if shard != at:
                if held:
                    yield close()
                held, at = {}, shard
            held.setdefault(kind, []).append(data)
    if held:
        yield close()


def _counted(texts: DataFrame, split: np.ndarray, shards: int) -> DataFrame:
    """Packed counts of bigrams (kind b, by context) and words (kind u, by word)."""
    def run(batches):
        hashed, held, size = Hashes(), [], 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            v = before(h, np.concatenate([x[1] for x in held]))
            words, counts = np.unique(h, return_counts=True)
            yield _packed((words >> np.uint64(20)).astype(np.int64) % shards, "u", shards, None, words, counts)
            _, first, counts = np.unique(bigram(v, h), return_index=True, return_counts=True)
            v, w = v[first], h[first]
            order = np.lexsort((w, v))  # equal contexts side by side take little room
            v, w, counts = v[order], w[order], counts[order]
            yield _packed(shard_of(v, w, split, shards), "b", shards, v, w, counts)
        for b in batches:
            held.append(hashed(b.column(0).to_pylist()))
            size += len(held[-1][0])
            if size >= CHUNK:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    return texts.mapInArrow(run, _PACK_TYPE)


_META = "file string, wordfile string, shard int, kind string, v binary, w binary, c binary, n1 long, n2 long, n3 long, n4 long, size long, total long"


def _meta(file=None, wordfile=None, shard=None, kind=None, v=None, w=None, c=None, counts=(0, 0, 0, 0), size=0, total=0):
    kinds = (pa.string(), pa.string(), pa.int32(), pa.string(), *[pa.binary()] * 3, *[pa.int64()] * 6)
    values = (file, wordfile, shard, kind, v, w, c, *counts, size, total)
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, kinds)], [x.split()[0] for x in _META.split(", ")])


def _counts_of_counts(c: np.ndarray) -> list[int]:
    return [int((c == k).sum()) for k in (1, 2, 3, 4)]


def _bigram_shards(packed: DataFrame, folder: str, split: np.ndarray, shards: int) -> DataFrame:
    def run(batches):
        for shard, got in _shard_rows(batches):
            none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            v, w, c = got.get("b", none)
            g, first, where = np.unique(bigram(v, w), return_index=True, return_inverse=True)
            c = np.bincount(where, c, minlength=len(g)).astype(np.int64)
            v, w = v[first], w[first]
            ctx, total, n1, n2, n3 = summed(v, c, (c == 1).astype(np.int64), (c == 2).astype(np.int64), (c > 2).astype(np.int64))
            large = np.flatnonzero(c > 65534)
            file = put_arrays(folder, f"bigrams-{shard:06d}", {
                "g": g, "c": np.minimum(c, 65535).astype(np.uint16), "large": large, "large_c": c[large],
                "v": ctx, "total": total, "n1": n1.astype(np.uint32), "n2": n2.astype(np.uint32), "n3": n3.astype(np.uint32)})
            yield _meta(file=file, shard=shard, kind="file", counts=_counts_of_counts(c), size=len(g))
            words, n = np.unique(w, return_counts=True)
            to = (words >> np.uint64(20)).astype(np.int64) % shards
            _, uw, uc = got.get("u", none)
            uw, uc = summed(uw, uc)
            at, part = chunks(uc)
            for batch in (_packed(to, "n", shards, None, words, n),
                          pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array(["u"]), pa.array([b""], pa.binary()), pa.array([uw[at].tobytes()], pa.binary()),
                                                      pa.array([part.tobytes()], pa.binary())], _PACK)):
                n_rows = batch.num_rows
                if n_rows:
                    zero = pa.array(np.zeros(n_rows, np.int64))
                    yield pa.RecordBatch.from_arrays([pa.nulls(n_rows, pa.string()), pa.nulls(n_rows, pa.string()), *batch.columns, *[zero] * 6],
                                                     [x.split()[0] for x in _META.split(", ")])

    return packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, _META)


def _word_shards(packed: DataFrame, folder: str, shards: int) -> DataFrame:
    def run(batches):
        for shard, got in _shard_rows(batches):
            none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            _, uw, uc = got.get("u", none)
            _, nw, n = got.get("n", none)
            words, c, n = summed(np.concatenate([uw, nw]), np.concatenate([uc, np.zeros(len(nw), np.int64)]), np.concatenate([np.zeros(len(uw), np.int64), n]))
            file = put_arrays(folder, f"words-{shard:06d}", {"w": words, "c": c, "n": n})
            yield _meta(wordfile=file, shard=shard, kind="file", counts=[*_counts_of_counts(n)], size=len(words), total=int(c.sum()))

    return packed.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard").mapInArrow(run, _META)


def fit(texts: DataFrame, column: str = "text") -> Model:
    """Count the model of the rows of ``texts`` into the shared folder."""
    spark = texts.sparkSession
    small_batches(spark)
    texts = texts.select(column)
    folder = scratch(spark, "kneser-ney")

    def few(batches):  # a small sample tells how many shards there should be and which contexts to split; no count uses it
        hashed = Hashes()
        for b in batches:
            h, _ = hashed(b.column(0).to_pylist())
            w, c = np.unique(h, return_counts=True)
            hit = c > max(1, len(h) // 1000)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(w[hit], np.uint64(0)).view(np.int64)), pa.array(np.append(c[hit], len(h)))], ["w", "n"])
    rate = 64
    seen = {r[0]: r[1] for r in texts.sample(1 / rate, 5).mapInArrow(few, "w long, n long").groupBy("w").agg(F.sum("n")).collect()}
    tokens_ = seen.pop(0, 0) * rate
    shards = max(partitions(spark), -(-tokens_ // SHARD))
    hot = [w for w, n in seen.items() if n * rate * shards * SPLIT > tokens_ and w]
    split = np.sort(np.array([*hot, int(START.view(np.int64))], np.int64).view(np.uint64))
    first = materialize(_bigram_shards(_counted(texts, split, shards), folder, split, shards), "kn-bigrams")
    files = first.filter("kind = 'file'")
    last = materialize(_word_shards(first.filter("kind != 'file'").select(*_PACK), folder, shards), "kn-words")
    model = Model(split=split)
    rows = files.select("shard", "file", "n1", "n2", "n3", "n4", "size").collect()  # one row per shard
    model.files = ["" for _ in range(shards)]
    for r in rows:
        model.files[r["shard"]] = r["file"]
    model.types = sum(r["size"] for r in rows)
    model.discounts = discounts([sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4)])
    rows = last.select("shard", "wordfile", "n1", "n2", "n3", "n4", "size", "total").collect()
    model.word_files = ["" for _ in range(shards)]
    for r in rows:
        model.word_files[r["shard"]] = r["wordfile"]
    m = [sum(r[f"n{k}"] for r in rows) for k in (1, 2, 3, 4)]
    model.vocabulary, model.total = sum(r["size"] for r in rows), sum(r["total"] for r in rows)
    model.lower = discounts(m)
    d1, d2, d3 = model.lower
    more = model.vocabulary - m[0] - m[1]
    model.left = (d1 * m[0] + d2 * m[1] + d3 * more) / model.types if model.types else 1.0
    return model


class Scorer:
    """Looks up words and bigrams in the mapped files."""

    def __init__(self, model: Model):
        self.m = model
        self.files = [get_arrays(f) if f else None for f in model.files]
        self.words = [get_arrays(f) if f else None for f in model.word_files]
        self.shards = len(model.files)
        self.clear()

    def clear(self) -> None:
        self.known: dict[int, int] = {}
        self.rows = np.zeros((0, 4))  # P(w), count, total of the context, its interpolation weight

    def context(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Total count and interpolation weight of contexts, 0 where never seen."""
        total, weight = np.zeros(len(v)), np.zeros(len(v))
        d = self.m.discounts

        def add(shard: int, i: np.ndarray) -> None:
            f = self.files[shard]
            if f is None or not len(f["v"]):
                return
            at = np.minimum(np.searchsorted(f["v"], v[i]), len(f["v"]) - 1)
            hit = f["v"][at] == v[i]
            i, at = i[hit], at[hit]
            total[i] += f["total"][at]
            weight[i] += d[0] * f["n1"][at] + d[1] * f["n2"][at] + d[2] * f["n3"][at]
        home = ((v >> np.uint64(20)) % np.uint64(self.shards)).astype(np.int64)
        cut = np.isin(v, self.m.split)
        for i in np.flatnonzero(cut):  # a split context lies in several shards
            for s in {int((home[i] + k * 7919) % self.shards) for k in range(PARTS)}:
                add(s, np.array([i]))
        rest = np.flatnonzero(~cut)
        order = rest[np.argsort(home[rest], kind="stable")]
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            if len(part):
                add(int(home[part[0]]), part)
        return total, weight

    def learn(self, w: np.ndarray) -> None:
        m = self.m
        n, c = np.zeros(len(w)), np.zeros(len(w))
        home = ((w >> np.uint64(20)) % np.uint64(max(1, self.shards))).astype(np.int64)
        order = np.argsort(home, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(home[order])) + 1):
            f = self.words[home[part[0]]] if len(part) and self.shards else None
            if f is None or not len(f["w"]):
                continue
            at = np.minimum(np.searchsorted(f["w"], w[part]), len(f["w"]) - 1)
            hit = f["w"][at] == w[part]
            n[part[hit]], c[part[hit]] = f["n"][at[hit]], f["c"][at[hit]]
        d = np.array([0.0, *m.lower])
        low = m.left / (m.vocabulary + 1)
        p = low + np.maximum(n - d[np.minimum(n, 3).astype(np.int64)], 0) / m.types if m.types else np.full(len(w), 1 / (m.vocabulary + 1))
        total, weight = self.context(w) if self.shards else (np.zeros(len(w)), np.zeros(len(w)))
        self.known.update(zip(w.tolist(), range(len(self.known), len(self.known) + len(w))))
        self.rows = np.concatenate([self.rows, np.stack([p, c, total, weight], axis=1)])

    def score(self, h: np.ndarray, sizes: np.ndarray):
        """Per text: known tokens, log10 probability under the base and under the model."""
        m = self.m
        words, where = np.unique(np.append(h, START), return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.clear()
        new = words[[x not in self.known for x in words.tolist()]]
        if len(new):
            self.learn(new)
        row = self.rows[np.fromiter(map(self.known.__getitem__, words.tolist()), np.int64, len(words))]
        at, start = where[:-1], where[-1]
        prior = np.empty_like(at)
        prior[1:] = at[:-1]
        prior[np.cumsum(sizes) - sizes] = start
        v = before(h, sizes)
        g, shard = bigram(v, h), shard_of(v, h, m.split, max(1, self.shards))
        c = np.zeros(len(h))
        asked = np.flatnonzero((row[at, 1] > 0) & (row[prior, 2] > 0))
        order = asked[np.lexsort((g[asked], shard[asked]))]
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            f = self.files[shard[part[0]]] if len(part) else None
            if f is None or not len(f["g"]):
                continue
            k = np.minimum(np.searchsorted(f["g"], g[part]), len(f["g"]) - 1)
            hit = f["g"][k] == g[part]
            part, k = part[hit], k[hit]
            c[part] = f["c"][k]
            if len(f["large"]):
                big = np.flatnonzero(c[part] == 65535)
                c[part[big]] = f["large_c"][np.searchsorted(f["large"], k[big])]
        d = np.array([0.0, *m.discounts])
        low, total, weight = row[at, 0], row[prior, 2], row[prior, 3]
        p = np.where(total > 0, (np.maximum(c - d[np.minimum(c, 3).astype(np.int64)], 0) + weight * low) / np.maximum(total, 1), low)
        base = np.log10((row[at, 1] + 0.1) / (m.total + 0.1 * (m.vocabulary + 1)))
        first = np.cumsum(sizes) - sizes
        return (np.add.reduceat((row[at, 1] > 0).astype(np.int64), first), np.add.reduceat(base, first), np.add.reduceat(np.log10(p), first))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lm_tokens, lm_known, lm_base and lm_score (log10 probabilities) and lm_perplexity."""
    small_batches(docs.sparkSession)
    docs = without(docs, "lm_tokens", "lm_known", "lm_base", "lm_score", "lm_perplexity")
    at = docs.columns.index(text)

    def run(batches):
        hashed, scorer = Hashes(), Scorer(model)
        for b in batches:
            if not b.num_rows:
                continue
            h, sizes = hashed(b.column(at).to_pylist())
            known, base, got = scorer.score(h, sizes)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(known), pa.array(base), pa.array(got), pa.array(10 ** np.minimum(300, -got / sizes))],
                                             [*b.schema.names, "lm_tokens", "lm_known", "lm_base", "lm_score", "lm_perplexity"])

    schema = nullable(docs.schema).add("lm_tokens", "long").add("lm_known", "long")
    return docs.mapInArrow(run, schema.add("lm_base", "double").add("lm_score", "double").add("lm_perplexity", "double"))
