"""Token counts by separator scan over flat token files.

A flat token file is nothing but 16-bit token ids, one document after the other, each closed by
the end-of-document id; there is no index. The files are cut into blocks of a fixed number of
tokens, which tasks read by range and search with one vectorised comparison. A block knows
how many documents end in it and the tokens before its first and after its last end; a prefix scan over these
few numbers (per file, then over files) gives every block the number of documents before it and
the open tokens it takes over, and with them each document's place and length.

Defined cases: a document without tokens counts 0; tokens after the last separator of a file are
one more, open document (``closed`` false); empty files have no document; null texts are
written as documents without tokens, repeated rows each on their own; an empty table writes no
file and counts nothing; ids that do not fit 16 bits are an error when they are written.
"""

from __future__ import annotations

import base64
import functools
import os
import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import materialize, scratch, small_batches
from ledgerlake.llm.shared_files import file_size, put_file, read_range

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
BLOCK = 1 << 20


@functools.lru_cache(maxsize=2)
def encoding(path: str):
    import tiktoken
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, folder: str, path: str = TOKENIZER, end: int = END) -> DataFrame:
    """One flat token file per task in ``folder``; returns (file, place, doc_id): which document is the nth of a file.

    A task that runs again writes the same rows to the same name.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext
        name = f"tokens-{TaskContext.get().partitionId():06d}.bin"
        encode, place = encoding(path).encode_ordinary, 0
        with tempfile.TemporaryDirectory(prefix="ledgerlake-") as d:
            own = os.path.join(d, name)
            with open(own, "wb") as f:
                for b in batches:
                    for text in b.column(1).to_pylist():
                        ids = np.array([*encode(text or ""), end])
                        if ids.max() > 65535:
                            raise ValueError("token ids of a flat file have 16 bits")
                        f.write(ids.astype("<u2").tobytes())
                    n = b.num_rows
                    yield pa.RecordBatch.from_arrays([pa.array([name] * n, pa.string()), pa.array(np.arange(place, place + n)), b.column(0)],
                                                     ["file", "place", "doc_id"])
                    place += n
            if place:
                put_file(folder, name, own)

    return docs.select("doc_id", "text").mapInArrow(run, f"file string, place long, doc_id {kind}")


def blocks_of(spark: SparkSession, folder: str, files: DataFrame, block: int = BLOCK) -> DataFrame:
    """(file, block, start, tokens) of the files (file): ranges of at most ``block`` tokens."""
    def sizes(batches):
        for b in batches:
            names = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([file_size(f"{folder}/{n}") // 2 for n in names], pa.int64())], ["file", "size"])

    sized = files.select("file").mapInArrow(sizes, "file string, size long").filter("size > 0")
    at = F.sequence(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / block).cast("long"))
    return sized.select("file", "size", F.explode(at).alias("block")).select(
        "file", "block", (F.col("block") * block).alias("start"), F.least(F.lit(block), F.col("size") - F.col("block") * block).cast("long").alias("tokens"))


def scan(folder: str, blocks: DataFrame, end: int = END) -> DataFrame:
    """(file, place, start, n_tokens, closed) of all documents in the blocks (file, block, start, tokens)."""
    spark = blocks.sparkSession
    small_batches(spark)

    def ends(file: str, start: int, tokens: int) -> np.ndarray:
        ids = np.frombuffer(read_range(f"{folder}/{file}", 2 * start, 2 * tokens), "<u2")
        return np.flatnonzero(ids == end)

    def look(batches):
        for b in batches:
            rows = []
            for file, block, start, tokens in zip(*(b.column(k).to_pylist() for k in range(4))):
                hit = ends(file, start, tokens)
                rows.append((file, block, start, tokens, len(hit), start + int(hit[-1]) + 1 if len(hit) else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 5))],
                                                 ["file", "block", "start", "tokens", "ends", "open_from"])

    found = materialize(blocks.select("file", "block", "start", "tokens").repartition(F.col("file"), F.col("block"))
                        .mapInArrow(look, "file string, block long, start long, tokens long, ends long, open_from long"), "token-blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    stitched = materialize(found.withColumn("first_place", F.coalesce(F.sum("ends").over(before), F.lit(0)))
                           .withColumn("begin", F.coalesce(F.last("open_from", ignorenulls=True).over(before), F.lit(0)))
                           .withColumn("is_last", F.lead("block").over(Window.partitionBy("file").orderBy("block")).isNull()), "token-prefix")

    def cut(batches):
        for b in batches:
            for file, start, tokens, n, place, begin, last in zip(*(b.column(k).to_pylist() for k in range(7))):
                hit = ends(file, start, tokens) + start
                stop = start + tokens
                tail = int(last and (hit[-1] + 1 if len(hit) else begin) < stop)
                starts = np.concatenate([[begin], hit + 1])[:len(hit) + tail]
                stops = np.append(hit, stop)[:len(hit) + tail]
                n = len(starts)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file] * n, pa.string()), pa.array(np.arange(place, place + n)), pa.array(starts.astype(np.int64)),
                     pa.array((stops - starts).astype(np.int64)), pa.array(np.arange(n) < len(hit))], ["file", "place", "start", "n_tokens", "closed"])

    dealt = stitched.select("file", "start", "tokens", "ends", "first_place", "begin", "is_last", "block").repartition(F.col("file"), F.col("block"))
    return dealt.select("file", "start", "tokens", "ends", "first_place", "begin", "is_last").mapInArrow(
        cut, "file string, place long, start long, n_tokens long, closed boolean")


def count_documents(docs: DataFrame, path: str = TOKENIZER, end: int = END, block: int = BLOCK) -> DataFrame:
    """(doc_id, file, place, start, n_tokens, closed): ``docs`` written to flat files and counted from them."""
    spark = docs.sparkSession
    folder = scratch(spark, "tokens")
    written = materialize(write_tokens(docs, folder, path, end), "token-places")
    blocks = blocks_of(spark, folder, written.select("file").distinct(), block)
    # both sides have a row per document: never a broadcast, however small the files' names compress
    return written.hint("merge").join(scan(folder, blocks, end), ["file", "place"], "left")
