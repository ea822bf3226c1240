"""Language ID by segmentation-marginalised unigrams.

A language gives each piece of a fixed public vocabulary a probability. A word's probability is
the sum over all its segmentations into pieces, found by the forward algorithm; a text's score is
the product over its words, and languages are compared by their posterior. The piece
probabilities are fitted by expectation-maximisation: the E step (expected piece counts by
forward-backward) runs over word counts in Spark, the M step normalises one vector per language
of the size of the vocabulary.

The fit reads at most ``TRAIN_DOCS`` different labelled texts of a language (those with the lowest
hashes; copies count once); prediction reads every whole text. Words are runs of letters (Unicode
categories L*), lower-cased, of any length, and pieces are as long as the vocabulary has them; long
runs go through the same recurrence in blocks, rescaled so that nothing underflows.

A task holds the words of a slice of ``SLICE`` words at a time, whatever the lengths of the texts.

Defined cases: null texts and texts without a letter are ``und`` with score 0; without any
labelled row every text is ``und`` with score 0; ties go to the first language in order; repeated
rows are predicted alike; an empty table gives no rows; columns named like the added ones
(``lang_pred``, ``lang_score``) are replaced, all others kept.
"""

from __future__ import annotations

import functools
import itertools
import re
import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import aside, materialize, nullable, small_batches, without

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
TRAIN_DOCS = 3000
ROUNDS = 3
#: Words scored at once, the length from which a run is scored on its own, and letters of one block of it.
SLICE, RUN, BLOCK = 50_000, 64, 4096
#: Probability of a letter that is no piece of the vocabulary, and the pseudo-count of a piece.
UNKNOWN, PRIOR = 1e-7, 0.05
#: Different words whose scores a worker remembers.
REMEMBERED = 150_000
#: Letters of a text up to which its words are found at once.
WHOLE = 1 << 18
# runs of word characters less digits; other number signs (fractions, Roman numerals) are taken out before
LETTERS = re.compile(r"[^\W\d_]+")
NUMBERS = frozenset(c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())
_BLANK = {ord(c): " " for c in NUMBERS}
_MULT, _SPREAD = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Pieces:
    """The vocabulary's lower-case letter pieces as a hash table over code points."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        texts = {sp.id_to_piece(i) for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
        self.texts = sorted(t for t in texts if t and t == t.lower() and (t.lstrip("▁").isalpha() or t == "▁"))
        self.longest = max(map(len, self.texts))
        hashes = np.array([self._hash([ord(c) for c in t]) for t in self.texts], dtype=np.uint64)
        self.bits = 18
        self.slots = np.zeros(1 << self.bits, dtype=np.int32)   # number of a piece + 1
        self.keys = np.concatenate([np.zeros(1, np.uint64), hashes])
        for i, h in enumerate(hashes):
            s = (int(h) * int(_SPREAD) & 0xFFFFFFFFFFFFFFFF) >> (64 - self.bits)
            while self.slots[s]:
                s = (s + 1) & ((1 << self.bits) - 1)
            self.slots[s] = i + 1

    @staticmethod
    def _hash(codes) -> int:
        h = 0
        for c in codes:
            h = (h * int(_MULT) + int(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def find(self, h: np.ndarray) -> np.ndarray:
        """Numbers (from 1) of the pieces with these hashes, 0 where there is none."""
        s = (h * _SPREAD >> np.uint64(64 - self.bits)).astype(np.int64)
        got = self.slots[s]
        wrong = np.flatnonzero((got > 0) & (self.keys[got] != h))
        while len(wrong):
            s[wrong] = (s[wrong] + 1) & ((1 << self.bits) - 1)
            got[wrong] = self.slots[s[wrong]]
            wrong = wrong[(got[wrong] > 0) & (self.keys[got[wrong]] != h[wrong])]
        return got

    def lattice(self, codes: np.ndarray):
        """(start, length, piece numbers) for all substrings of words of one length, rows = words."""
        n, size = codes.shape
        for i in range(size):
            h = np.zeros(n, np.uint64)
            for k in range(1, min(self.longest, size - i) + 1):
                h = h * _MULT + codes[:, i + k - 1].astype(np.uint64) + np.uint64(1)
                yield i, k, self.find(h)

    def starting(self, codes: np.ndarray, lo: int, hi: int) -> np.ndarray:
        """Piece numbers of the substrings of one run that begin at lo..hi, by length less one."""
        out = np.zeros((hi - lo, self.longest), dtype=np.int32)
        h = np.zeros(hi - lo, np.uint64)
        for k in range(1, self.longest + 1):
            n = min(hi, len(codes) - k + 1) - lo
            if n <= 0:
                break
            h = h[:n] * _MULT + codes[lo + k - 1:lo + k - 1 + n].astype(np.uint64) + np.uint64(1)
            out[:n, k - 1] = self.find(h)
        return out


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def by_length(words: list[str]):
    """Groups of equally long words: (indices, code points)."""
    sizes = np.fromiter((len(w) for w in words), np.int64, len(words))
    order = np.argsort(sizes, kind="stable")
    for idx in np.split(order, np.flatnonzero(np.diff(sizes[order])) + 1):
        if len(idx):
            text = "".join([words[i] for i in idx])
            yield idx, np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).reshape(len(idx), -1)


def chances(table: Pieces, probs: np.ndarray, codes: np.ndarray, lo: int, hi: int):
    """(piece numbers, probabilities) of the substrings that begin at lo..hi; a letter always has one."""
    piece = table.starting(codes, lo, hi)
    p = probs[piece]
    p[:, 0][piece[:, 0] == 0] = UNKNOWN
    return piece, p


def run_forward(table: Pieces, probs: np.ndarray, codes: np.ndarray, log: np.ndarray | None = None) -> np.ndarray:
    """log10 probability of one run of any length in each language; ``log`` takes that of every beginning."""
    k, total = table.longest, np.zeros(probs.shape[1])
    ahead = np.zeros((k, probs.shape[1]))      # what reaches the next positions, over 10 ** total
    ahead[0] = 1
    for lo in range(0, len(codes), BLOCK):
        hi = min(len(codes), lo + BLOCK)
        _, p = chances(table, probs, codes, lo, hi)
        alpha = np.concatenate([ahead, np.zeros((hi - lo, probs.shape[1]))])
        for i in range(hi - lo):
            if i % 16 == 0:
                scale = alpha[i].copy()
                alpha[i:i + k] /= scale
                total = total + np.log10(scale)
            if log is not None:
                log[lo + i] = total + np.log10(alpha[i])
            alpha[i + 1:i + k + 1] += alpha[i] * p[i]
        ahead = alpha[hi - lo:]
    return total + np.log10(ahead[0])


def run_expected(table: Pieces, probs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Expected piece counts of one run of any length, one language: backward over the blocks."""
    k, size, out = table.longest, len(codes), np.zeros(len(probs))
    log = np.zeros((size, 1))
    whole = float(run_forward(table, probs[:, None], codes, log)[0])
    behind, total = np.zeros(k), 0.0           # chances of the rest after the next positions, over 10 ** total
    behind[0] = 1
    for lo in reversed(range(0, size, BLOCK)):
        hi = min(size, lo + BLOCK)
        piece, p = chances(table, probs, codes, lo, hi)
        beta = np.concatenate([np.zeros(hi - lo), behind])
        for i in reversed(range(hi - lo)):
            after = beta[i + 1:i + k + 1]
            beta[i] = p[i] @ after
            share = p[i] * after * 10 ** (log[lo + i, 0] + total - whole)
            np.add.at(out, piece[i], share)
            if i % 16 == 0:
                total += np.log10(beta[i])
                beta[i:i + k] /= beta[i]
        behind = beta[:k]
    out[0] = 0
    return out


def forward(table: Pieces, probs: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """log10 probability of each word (rows of code points) in each language."""
    n, size = codes.shape
    if size > RUN:
        return np.array([run_forward(table, probs, c) for c in codes])
    alpha = [np.zeros((n, probs.shape[1])) for _ in range(size + 1)]
    alpha[0][:] = 1
    log = np.zeros((n, probs.shape[1]))
    for i, k, piece in table.lattice(codes):
        if k == 1 and i and i % 16 == 0:
            scale = alpha[i].copy()
            for a in alpha[i:i + table.longest]:
                a /= scale
            log += np.log10(scale)
        p = probs[piece]
        if k == 1:
            p[piece == 0] = UNKNOWN
        alpha[i + k] += alpha[i] * p
    return log + np.log10(alpha[size])


def expected(table: Pieces, probs: np.ndarray, codes: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected piece counts of weighted words of one language (probs: one column)."""
    n, size = codes.shape
    if size > RUN:
        return sum(w * run_expected(table, probs, c) for w, c in zip(weight, codes))
    steps = list(table.lattice(codes))
    chance = [np.where(piece == 0, UNKNOWN if k == 1 else 0.0, probs[piece]) for _, k, piece in steps]
    alpha, beta = np.zeros((size + 1, n)), np.zeros((size + 1, n))
    alpha[0], beta[size] = 1, 1
    for (i, k, _), p in zip(steps, chance):
        alpha[i + k] += alpha[i] * p
    for (i, k, _), p in zip(reversed(steps), reversed(chance)):
        beta[i] += p * beta[i + k]
    out = np.zeros(len(probs))
    for (i, k, piece), p in zip(steps, chance):
        out += np.bincount(piece, alpha[i] * p * beta[i + k] / alpha[size] * weight, minlength=len(probs))
    out[0] = 0
    return out


def gathered(batches, rows: int = 20_000):
    """Columns as lists, of so many rows at a time: wide array steps for narrow rows."""
    columns, size = None, 0
    for b in batches:
        got = [c.to_pylist() for c in b.columns]
        columns = got if columns is None else [x + y for x, y in zip(columns, got)]
        size += b.num_rows
        if size >= rows:
            yield columns
            columns, size = None, 0
    if columns:
        yield columns


def words_of(text: str | None):
    """The words of a text with their start mark, one after the other."""
    text = (text or "").lower()
    if not text.isascii() and not NUMBERS.isdisjoint(text):
        text = text.translate(_BLANK)
    found = LETTERS.findall(text) if len(text) <= WHOLE else (m.group() for m in LETTERS.finditer(text))
    return map("▁".__add__, found)


def slices(texts):
    """(row of each word, words) of consecutive texts, ``SLICE`` words at a time."""
    rows, words = [], []
    for i, text in enumerate(texts):
        found = words_of(text)
        while part := list(itertools.islice(found, SLICE - len(words))):
            words += part
            rows.append((i, len(part)))
            if len(words) >= SLICE:
                yield np.repeat([r for r, _ in rows], [n for _, n in rows]), words
                rows, words = [], []
    if words:
        yield np.repeat([r for r, _ in rows], [n for _, n in rows]), words


def sampled(labelled: DataFrame, bound: int) -> DataFrame:
    """The ``bound`` different texts of each language with the lowest hashes, or all where it has no more."""
    labelled = labelled.select("lang", "text", F.xxhash64("text", F.lit(11)).alias("at"))
    texts = materialize(labelled.select("lang", "at").distinct(), "langid-texts")
    sizes = texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))
    # of a large language only about twice the bound are ranked
    share = F.col("at") / F.lit(2.0 ** 64) + 0.5
    near = texts.join(sizes, "lang").filter((share <= F.lit(2.0 * bound + 100) / F.col("n")) | (F.col("at") == F.col("least")))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    # written, so that Spark knows its size and sends it to the texts rather than the texts to it
    chosen = materialize(near.withColumn("rank", rank).filter(F.col("rank") <= bound).select("lang", "at"), "langid-chosen")
    return labelled.join(chosen, ["lang", "at"]).dropDuplicates(["lang", "at"]).select("lang", "text")


def fit(labelled: DataFrame, path: str = VOCABULARY, bound: int = TRAIN_DOCS, rounds: int = ROUNDS):
    """(languages, piece probabilities (pieces + 1) x languages) from columns text, lang."""
    spark = labelled.sparkSession
    small_batches(spark)
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample = sampled(labelled, bound)

    def words(batches):
        from collections import Counter
        for b in batches:
            lang = b.column(0).to_pylist()
            for row, word in slices(x.as_py() for x in b.column(1)):
                counts = Counter(zip((lang[i] for i in row), word))
                yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()),
                                                  pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])

    counts = materialize(sample.mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word")
                         .agg(F.sum("n").alias("n")), "langid-words")
    langs = [r[0] for r in counts.select("lang").distinct().orderBy("lang").collect()]
    table = pieces(path)
    probs = np.zeros((len(table.texts) + 1, len(langs)))
    probs[1:] = 1.0 / len(table.texts)

    def e_step(batches):
        table, total = pieces(path), {}
        for lang, word, n in gathered(batches):
            for name in set(lang):
                j = [i for i, x in enumerate(lang) if x == name]
                col, weight = langs.index(name), np.array([n[i] for i in j], dtype=float)
                acc = total.setdefault(name, np.zeros(len(table.texts) + 1))
                for idx, codes in by_length([word[i] for i in j]):
                    acc += expected(table, probs[:, col], codes, weight[idx])
        for name, acc in total.items():
            hit = np.flatnonzero(acc)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(hit), pa.string()), pa.array(hit, pa.int64()), pa.array(acc[hit])],
                                             ["lang", "piece", "n"])

    for _ in range(rounds if langs else 0):
        got = (counts.mapInArrow(e_step, "lang string, piece long, n double").groupBy("lang", "piece")
               .agg(F.sum("n").alias("n"))).collect()  # at most one row per language and piece of the vocabulary
        new = np.full_like(probs, PRIOR)
        for r in sorted(got):
            new[r["piece"], langs.index(r["lang"])] += r["n"]
        new[0] = 0
        probs = new / new.sum(axis=0)
    return langs, probs


def predict(docs: DataFrame, model, path: str = VOCABULARY, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` (posterior of that language) added."""
    langs, probs = model
    small_batches(docs.sparkSession)
    docs = without(docs, "lang_pred", "lang_score")
    at = docs.columns.index(text)

    def run(batches):
        table, known = pieces(path), {}
        score = np.zeros((0, max(1, len(langs))))
        for b in batches:
            by_doc, lens = np.zeros((b.num_rows, score.shape[1])), np.zeros(b.num_rows, np.int64)
            for row, words in slices(x.as_py() for x in b.column(at)):
                if len(known) > REMEMBERED:
                    known, score = {}, score[:0]
                new = [w for w in dict.fromkeys(words) if w not in known]
                known.update(zip(new, range(len(known), len(known) + len(new))))
                fresh = np.zeros((len(new), score.shape[1]))
                if langs:
                    for idx, codes in by_length(new):
                        fresh[idx] = forward(table, probs, codes)
                score = np.concatenate([score, fresh])
                where = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
                starts = np.flatnonzero(np.diff(row, prepend=-1))
                by_doc[row[starts]] += np.add.reduceat(score[where], starts)
                lens += np.bincount(row, minlength=b.num_rows)
            best = by_doc.argmax(axis=1)
            gap = np.clip(by_doc - by_doc.max(axis=1, keepdims=True), -300, 0)
            post = 1 / np.power(10.0, gap).sum(axis=1)
            sure = (lens > 0) & bool(langs)
            pred = [langs[j] if k else "und" for j, k in zip(best, sure)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pred, pa.string()), pa.array(np.where(sure, post, 0.0))],
                                             [*b.schema.names, "lang_pred", "lang_score"])

    schema = nullable(docs.schema).add("lang_pred", "string").add("lang_score", "double")
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, model, least: float = 0.5, **kw) -> DataFrame:
    """``docs`` less those without a language: no letter, or no language above ``least``."""
    plain, back = aside(docs, kw.get("text", "text"))
    return back(predict(plain, model, **kw).filter((F.col("lang_pred") != "und") & (F.col("lang_score") >= least)))


def training_rows(docs: DataFrame, held_out: Column) -> DataFrame:
    return docs.filter(~F.coalesce(held_out, F.lit(False))).select("text", "lang")
