"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of ``BLOCK`` bytes. Equal blocks get equal integer names by
sorting: blocks are dealt by a hash ``q`` of their bytes and sorted there, and the name is
``(q, rank of the block among the different blocks of that hash)``, so two different blocks never
share a name, whatever the hash does. Then adjacent names of a document are paired and the
pairs named in the same way, halving the length at each level, until one name stands for the
document: its identity, equal for two documents exactly when their texts are.

A hash that holds many rows is dealt over several salts; each salt ranks alone, and the few
distinct blocks of the salts are matched by content afterwards. Text is shuffled once.

Defined cases: null text counts as empty, and empty texts are equal; of equal texts the smallest
doc_id stays (a null doc_id after all others), of equal doc_ids one row; repeated rows are
separate rows of one group; an empty table gives no rows; no other column is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.common import aside, materialize, partitions

BLOCK = 4096
#: A hash is salted when it holds more rows than this and than its share of a partition.
HOT_ROWS = 256


def normalized(text: Column) -> Column:
    """Each run of white space as one space; null as the empty text. Single spaces stay as they are."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " ")


def hot_hashes(df: DataFrame) -> DataFrame:
    """(q, salts) of the hashes that hold more than a sixteenth of a partition's rows.

    At most 16 times as many rows as there are partitions, so it may be broadcast at any size.
    """
    counts = materialize(df.groupBy("q").agg(F.count(F.lit(1)).alias("n"))
                         .groupBy(F.when(F.col("n") > HOT_ROWS, F.col("q")).alias("q")).agg(F.sum("n").alias("n")), "hot")
    total = counts.agg(F.sum("n")).first()[0] or 0
    counts = counts.filter(F.col("q").isNotNull())
    limit = max(HOT_ROWS, total // (16 * partitions(df.sparkSession)))
    return counts.filter(F.col("n") > limit).select("q", F.ceil(F.col("n") / limit).cast("int").alias("salts"))


def named(df: DataFrame, narrow: DataFrame, key: str, spread: list[str], label: str) -> DataFrame:
    """``df`` with ``key`` replaced by its name (n1, n2), written to the shared folder.

    ``df`` and ``narrow`` have q = xxhash64(key); ``narrow`` is the same rows with q alone.
    ``spread`` tells rows of one key apart, to deal them over salts.
    """
    hot = hot_hashes(narrow)
    salted = df.join(F.broadcast(hot), "q", "left").withColumn(
        "salt", F.when(F.col("salts").isNull(), F.lit(0)).otherwise(
            F.pmod(F.xxhash64(*spread), F.col("salts")).cast("int")))
    w = Window.partitionBy("q", "salt").orderBy(key)
    ranked = (salted.withColumn("r", F.dense_rank().over(w))
              .withColumn("first", F.row_number().over(w) == F.rank().over(w))
              .withColumn("sample", F.when(F.col("salts").isNotNull() & F.col("first"), F.col(key)))
              .drop(key, "first", "salts"))
    ranked = materialize(ranked, label)
    # one row per hot hash, salt and different key: bounded like the list of hot hashes
    seen = ranked.filter(F.col("sample").isNotNull()).select("q", "salt", "r", "sample")
    one = seen.groupBy("q", "sample").agg(F.min(F.struct("salt", "r")).alias("as"))
    names = materialize(seen.join(one, ["q", "sample"]).select("q", "salt", "r", "as"), f"{label}-hot")
    return (ranked.join(F.broadcast(names), ["q", "salt", "r"], "left")
            .withColumn("n1", F.col("q"))
            .withColumn("n2", F.coalesce(F.col("as.salt"), F.col("salt")).cast("long") * (1 << 31)
                        + F.coalesce(F.col("as.r"), F.col("r")))
            .drop("q", "salt", "r", "as", "sample"))


def identities(docs: DataFrame, text: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs``: rid, doc_id, sha (of the normalised text), n_blocks, n1, n2.

    Two rows have equal (n_blocks, n1, n2) exactly when their normalised texts are equal. The
    number of levels is the logarithm of the longest text in blocks.
    """
    def cut(df: DataFrame, *cols) -> DataFrame:
        data = df.select(*cols, normalized(F.col(text)).alias("norm")).withColumn("data", F.col("norm").cast("binary"))
        data = data.withColumn("n_blocks", F.greatest(F.lit(1), F.ceil(F.octet_length("data") / block)).cast("int"))
        blocks = F.transform(F.sequence(F.lit(0), F.col("n_blocks") - 1),
                             lambda i: F.substring(F.col("data"), i * block + 1, F.lit(block)))
        return data, blocks

    data, blocks = cut(docs, F.monotonically_increasing_id().alias("rid"), F.col("doc_id"))
    rows = (data.withColumn("sha", F.unhex(F.sha2("data", 256)))
            .select("rid", "doc_id", "sha", "n_blocks", F.posexplode(blocks).alias("pos", "key"))
            .withColumn("sha", F.when(F.col("pos") == 0, F.col("sha")))
            .withColumn("q", F.xxhash64("key")))
    data, blocks = cut(docs)
    narrow = data.select(F.explode(blocks).alias("key")).select(F.xxhash64("key").alias("q"))
    level = named(rows, narrow, "key", ["rid", "pos"], "blocks")
    done, k = [level.filter(F.col("n_blocks") == 1)], 1
    longest = level.agg(F.max("n_blocks")).first()[0] or 1
    while k < longest:
        side = lambda bit: F.max(F.when(F.col("pos") % 2 == bit, F.struct("n1", "n2")))
        pairs = (level.filter(F.col("n_blocks") > k).withColumn("half", (F.col("pos") / 2).cast("int"))
                 .groupBy("rid", "half")
                 .agg(F.max("doc_id").alias("doc_id"), F.max("sha").alias("sha"), F.max("n_blocks").alias("n_blocks"),
                      F.struct(side(0).alias("a"), side(1).alias("b")).alias("key"))
                 .withColumnRenamed("half", "pos")
                 .withColumn("q", F.xxhash64("key.a.n1", "key.a.n2", "key.b.n1", "key.b.n2")))
        pairs = materialize(pairs, f"pairs{k}")
        level = named(pairs, pairs.select("q"), "key", ["rid", "pos"], f"names{k}")
        k *= 2
        done.append(level.filter(F.col("n_blocks") <= k))
    cols = ["rid", "doc_id", "sha", "n_blocks", "n1", "n2"]
    out = done[0].select(cols)
    for d in done[1:]:
        out = out.unionByName(d.select(cols))
    return out


def exact_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row per row of ``docs``."""
    ids = materialize(identities(docs, text), "identities")
    key = ["n_blocks", "n1", "n2"]
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("keep")
    groups = materialize(ids.groupBy(key).agg(F.count(F.lit(1)).alias("size"), first).filter(F.col("size") > 1), "groups")
    return ids.join(groups, key, "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("keep.rid") == F.col("rid"), F.lit(True)).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text equals that of a row that stays."""
    kept = exact_groups(docs, text).filter("kept").select(
        F.col("doc_id").alias("dedup_id"), F.unhex("text_sha256").alias("dedup_sha"))
    plain, back = aside(docs, "doc_id", text)
    own = plain.withColumn("dedup_key", F.unhex(F.sha2(normalized(F.col(text)).cast("binary"), 256)))
    hit = own["doc_id"].eqNullSafe(kept["dedup_id"]) & (own["dedup_key"] == kept["dedup_sha"])
    # rows repeated with the same doc_id share that key: one of them stays
    return back(own.join(kept, hit, "left_semi").dropDuplicates(["doc_id", "dedup_key"]))
