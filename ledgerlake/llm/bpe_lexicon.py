"""BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are merged once and compiled into an automaton whose states are
shared by all words with the same endings; the words passed over on the way to a final state
number the word, and the number points to its ids. Workers map the automaton's arrays into
memory and walk all words of a batch together. Words that it does not hold are merged exactly:
in each round the pair of the lowest rank of every word is merged, until no pair has a rank.

A word is frequent when it makes up more than 1/``LEXICON`` of all repeated words, so fewer than
``LEXICON`` words are, whatever the corpus. The lexicon changes how fast ids are found, never which.

The text rules are those of the tokenizer file: special tokens found in the raw text stand for
themselves; the rest is NFC-normalised and lower-cased by the file's own normaliser and split by
its pattern. Decoding joins the vocabulary's strings by one space, as a file without a decoder asks.

Defined cases: null text counts as empty and has no ids; decoding no ids gives the empty text;
null or unknown ids decode to nothing; repeated rows are encoded alike; an empty table gives no
rows; columns named like the added ones (``bpe_ids``, ``bpe_text``) are replaced, others kept.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.arrays import IntTable, map_arrays, ragged, save_arrays
from ledgerlake.llm.common import materialize, nullable, small_batches, without

TOKENIZER = "/opt/tokenizers/word_bpe_49k.json"
LEXICON = 1 << 18
#: Different words whose ids a worker remembers beside the lexicon.
REMEMBERED = 400_000


def byte_chars() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


class Vocabulary:
    """The tokenizer file: text rules, merge ranks and strings of ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.normalizer = Tokenizer.from_file(path).normalizer
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.split = regex.compile(pattern.replace(r"\s", r"\p{White_Space}"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")")
        chars = byte_chars()
        self.inner = np.array([vocab[c] for c in chars], dtype=np.int64)
        self.final = np.array([vocab[c + suffix] for c in chars], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[i]] for p in pairs], dtype=np.uint64) for i in (0, 1))
        self.ranks = IntTable.build(left << np.uint64(32) | right)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        strings = {**{i: s for s, i in vocab.items()}, **{i: s for s, i in self.special.items()}}
        self.strings = pa.array([strings.get(i) for i in range(max(strings) + 1)], pa.string())

    def words(self, text: str | None) -> list[str]:
        """Pre-tokens in order; a special token is marked by a leading space, which no pre-token has."""
        if not text:
            return []
        out = []
        for part in self.cut.split(text) if any(x in text for x in self.special) else (text,):
            if part in self.special:
                out.append(" " + part)
            elif part:
                out += self.split.findall(self.normal(part))
        return out

    def normal(self, text: str) -> str:
        """The file's normaliser; Latin-1 texts are in NFC as they are and only need lower case."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.normalizer.normalize_str(text)
        return text.lower()

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after the other, and how many each has."""
        data = [w.encode() for w in words]
        lens = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        ids = self.inner[flat]
        ends = np.cumsum(lens)
        ids[ends[lens > 0] - 1] = self.final[flat[ends[lens > 0] - 1]]
        word = np.repeat(np.arange(len(words)), lens)
        done_ids, done_word = [], []
        while len(ids):
            same = word[1:] == word[:-1]
            rank = np.where(same, self.ranks.find(ids[:-1].astype(np.uint64) << np.uint64(32) | ids[1:].astype(np.uint64)), -1)
            rank = np.append(rank, -1)
            rank[rank < 0] = 1 << 30
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(ids)))
            low = np.repeat(least, sizes)
            over = low == 1 << 30
            if over.any():  # words without a pair left are finished
                done_ids.append(ids[over])
                done_word.append(word[over])
            hit = (rank == low) & ~over
            # of a run of overlapping pairs every second one is merged, from the left
            run = np.flatnonzero(hit)
            if len(run):
                new = np.append(True, np.diff(run) != 1)
                first = np.maximum.accumulate(np.where(new, np.arange(len(run)), 0))
                run = run[(np.arange(len(run)) - first) % 2 == 0]
                ids[run] = self.merged[rank[run]]
                over[run + 1] = True
            ids, word = ids[~over], word[~over]
        if not done_ids:
            return np.zeros(0, np.int64), np.zeros(len(words), np.int64)
        ids, word = np.concatenate(done_ids), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return ids[order], np.bincount(word, minlength=len(words))


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def compile_words(words: list[str]) -> dict[str, np.ndarray]:
    """Minimal acyclic automaton over the words' bytes, as arrays; words are numbered in byte order.

    ``keys`` are state * 256 + byte, with the state that follows and the number of words passed
    over by taking that edge; ``final`` tells which states end a word.
    """
    data = sorted(w.encode() for w in words)
    register: dict[tuple, int] = {}
    final, edges = [], []          # finished states
    path: list[list] = [[False, []]]  # open states along the last word: [ends a word, [(byte, state)], next byte]

    def close(depth: int) -> None:
        while len(path) > depth:
            ends, out = path.pop()[:2]
            key = (ends, tuple(out))
            if key not in register:
                register[key] = len(final)
                final.append(ends)
                edges.append(out)
            path[-1][1].append((path[-1][2], register[key]))

    last = b""
    for w in data:
        common = len(os.path.commonprefix([last, w]))
        close(common + 1)
        for byte in w[common:]:
            path[-1][2:] = [byte]
            path.append([False, []])
        path[-1][0] = True
        last = w
    close(1)
    ends, out = path.pop()[:2]
    root = len(final)
    final.append(ends)
    edges.append(out)
    below = np.zeros(len(final), dtype=np.int64)
    keys, target, skipped = [], [], []
    for s, out in enumerate(edges):  # states are finished after those they lead to
        n = int(final[s])
        for byte, t in out:
            keys.append(s << 8 | byte)
            target.append(t)
            skipped.append(n)
            n += int(below[t])
        below[s] = n
    table = IntTable.build(np.array(keys, dtype=np.uint64))
    return {"slots": table.slots, "keys": table.keys, "target": np.array(target, np.int64), "skipped": np.array(skipped, np.int64),
            "final": np.array(final, bool), "root": np.array([root], np.int64)}


class Transducer:
    """A compiled lexicon: word numbers by a walk of all words together, ids by number."""

    def __init__(self, a: dict[str, np.ndarray]):
        self.a, self.table = a, IntTable(a["slots"], a["keys"])

    def numbers(self, words: list[str]) -> np.ndarray:
        """The number of each word, -1 for words that the lexicon does not hold."""
        data = [w.encode() for w in words]
        lens = np.fromiter(map(len, data), np.int64, len(data))
        flat = np.frombuffer(b"".join(data), dtype=np.uint8)
        start = np.cumsum(lens) - lens
        out = np.full(len(words), -1, np.int64)
        alive = np.arange(len(words))
        state, number, step = np.full(len(words), self.a["root"][0]), np.zeros(len(words), np.int64), 0
        while len(alive):
            ended = lens[alive] == step
            if ended.any():
                hit = ended & self.a["final"][state]
                out[alive[hit]] = number[hit]
                alive, state, number = alive[~ended], state[~ended], number[~ended]
            edge = self.table.find(state.astype(np.uint64) << np.uint64(8) | flat[start[alive] + step].astype(np.uint64))
            ok = edge >= 0
            alive, edge = alive[ok], edge[ok]
            state, number, step = self.a["target"][edge], number[ok] + self.a["skipped"][edge], step + 1
        return out

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return ragged(self.a["ids"], self.a["offsets"], numbers)


def frequent_words(docs: DataFrame, text: str, path: str, bound: int) -> list[str]:
    """Words that make up more than 1/bound of all repeated words of the corpus: fewer than ``bound``."""
    def count(batches):
        from collections import Counter
        vocab, c = vocabulary(path), Counter()

        def counted():
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["word", "n"])
        for b in batches:
            c.update(itertools.chain.from_iterable(map(vocab.words, b.column(0).to_pylist())))
            if len(c) > REMEMBERED:
                yield counted()
                c.clear()
        yield counted()

    counts = materialize(docs.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
                         .filter(F.col("n") > 1), "bpe-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in counts.filter((F.col("n") * bound > total) & ~F.col("word").startswith(" ")).select("word").collect()]


def lexicon(docs: DataFrame, text: str = "text", path: str = TOKENIZER, bound: int = LEXICON) -> str:
    """Compile the lexicon of a corpus and send it to all workers; the name to open it by."""
    spark = docs.sparkSession
    small_batches(spark)
    words = sorted(frequent_words(docs, text, path, bound), key=str.encode)
    arrays = compile_words(words)
    ids, lens = vocabulary(path).merge(words)
    arrays |= {"ids": ids, "offsets": np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)}
    name = f"lexicon-{uuid.uuid4().hex}"
    file = os.path.join(tempfile.mkdtemp(prefix="ledgerlake-"), name)
    save_arrays(file, arrays)
    spark.sparkContext.addFile(file)  # at most LEXICON words: a few MB
    return name


@functools.lru_cache(maxsize=2)
def transducer(name: str) -> Transducer:
    return Transducer(map_arrays(SparkFiles.get(name)))


class Encoder:
    """Ids of word lists: the lexicon first, then exact merges, remembered for the next batches."""

    def __init__(self, path: str, lex: Transducer):
        self.vocab, self.lex = vocabulary(path), lex
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.values, self.offsets = np.zeros(0, np.int64), np.zeros(1, np.int64)

    def learn(self, words: list[str]) -> None:
        marked = [w for w in words if w[0] == " "]
        words = [w for w in words if w[0] != " "] if marked else words
        numbers = self.lex.numbers(words)
        seen = np.flatnonzero(numbers >= 0)
        new = np.flatnonzero(numbers < 0)
        parts = [self.lex.ids(numbers[seen]), self.vocab.merge([words[i] for i in new])]
        parts.append((np.array([self.vocab.special[w[1:]] for w in marked], np.int64), np.ones(len(marked), np.int64)))
        names = [*(words[i] for i in seen), *(words[i] for i in new), *marked]
        self.known.update(zip(names, range(len(self.known), len(self.known) + len(names))))
        self.values = np.concatenate([self.values, *(p[0] for p in parts)])
        lens = np.concatenate([p[1] for p in parts])
        self.offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum(lens)])

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        per = list(map(self.vocab.words, texts))
        flat = list(itertools.chain.from_iterable(per))
        if len(self.known) > REMEMBERED:
            self.clear()
        new = [w for w in dict.fromkeys(flat) if w not in self.known]
        if new:
            self.learn(new)
        rows = np.fromiter(map(self.known.__getitem__, flat), np.int64, len(flat))
        ids, lens = ragged(self.values, self.offsets, rows)
        ends = np.concatenate([[0], np.cumsum(lens)])
        docs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, per), np.int64, len(per)))])
        return pa.ListArray.from_arrays(pa.array(ends[docs], pa.int32()), pa.array(ids, pa.int32()))


@functools.lru_cache(maxsize=1)
def encoder(path: str, name: str) -> Encoder:
    """A worker's encoder; the tasks it runs one after the other share what it remembers."""
    return Encoder(path, transducer(name))


def encode(docs: DataFrame, text: str = "text", path: str = TOKENIZER, name: str | None = None) -> DataFrame:
    """``docs`` with the column ``bpe_ids`` (array of int). ``name``: a lexicon that was made before."""
    spark = docs.sparkSession
    name = name or lexicon(docs, text, path)
    docs = without(docs, "bpe_ids")
    at = docs.columns.index(text)

    def run(batches):
        own = encoder(path, name)
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, own.encode(b.column(at).to_pylist())], [*b.schema.names, "bpe_ids"])

    small_batches(spark)
    return docs.mapInArrow(run, nullable(docs.schema).add("bpe_ids", T.ArrayType(T.IntegerType())))


def decode(encoded: DataFrame, ids: str = "bpe_ids", path: str = TOKENIZER) -> DataFrame:
    """``encoded`` with the column ``bpe_text``."""
    small_batches(encoded.sparkSession)
    encoded = without(encoded, "bpe_text")
    at = encoded.columns.index(ids)

    def run(batches):
        strings = vocabulary(path).strings
        for b in batches:
            lists = b.column(at)
            values = lists.values.slice(lists.offsets[0].as_py(), lists.offsets[-1].as_py() - lists.offsets[0].as_py())
            known = pc.and_(pc.greater_equal(values, 0), pc.less(values, len(strings)))
            tokens = strings.take(pc.if_else(known, values, None))
            offsets = pc.subtract(lists.offsets, lists.offsets[0])
            if tokens.null_count:
                gone = np.concatenate([[0], np.cumsum(tokens.is_null().to_numpy(zero_copy_only=False))])
                at_ = offsets.to_numpy(zero_copy_only=False)
                offsets, tokens = pa.array(at_ - gone[at_], pa.int32()), tokens.drop_null()
            text = pc.binary_join(pa.ListArray.from_arrays(offsets, tokens), " ")
            yield pa.RecordBatch.from_arrays([*b.columns, text], [*b.schema.names, "bpe_text"])

    return encoded.mapInArrow(run, nullable(encoded.schema).add("bpe_text", "string"))
