"""Statement file sources (S1–S16): CSV scans, file profiling, encodings, hashes.

* ``read_lines`` / ``profile_lines`` — files of any size, read line-wise in splits: per file the
  encoding, delimiter, header, widths, corruption counts and parse strategy as one pre-aggregated
  group-by over all lines.
* ``read_records`` — the lossless path: every record of every file, split by that file's own
  delimiter and header into any number of cells; extra cells and broken quotes are kept and
  reported, quoted line ends are rejoined, windows-1252 bytes are decoded.
* ``read_statements`` — Spark's split CSV reader for files that share one header.
* ``read_files`` / ``profile_files`` — one row per file from ``binaryFile`` for uploads: size limit
  report, content hash, first-lines indicators.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut_lineage
from ledgerlake.sources.quoting import join_records

# FIXED VALUES — limits and patterns of the file checks.
MAX_FILE_BYTES = 16 * 1024 * 1024
DELIMITERS = [",", ";", "\t", "|"]
CORRUPTION_PATTERNS = [r"\d+,\d+,\d+", r"[^\w\s€$₹£¥₽₱₩]+\d+[^\w\s€$₹£¥₽₱₩]+", r"^\d+$"]
PROFILE_CHARS = 1000
PROFILE_LINES = 10
# windows-1252 where it differs from latin-1
CP1252_BYTES = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"
CP1252_CHARS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"


def read_statements(spark: SparkSession, paths, sep: str = ",", header: bool = True,
                    encoding: str = "UTF-8") -> DataFrame:
    """All-STRING CSV scan (split across tasks, no row cap) + ``source_file``."""
    df = (spark.read.option("header", header).option("sep", sep).option("encoding", encoding)
          .option("mode", "PERMISSIVE").option("inferSchema", False).csv(paths))
    df = df.toDF(*[c.strip() for c in df.columns])       # S10: strip names
    return df.withColumn("source_file", F.col("_metadata.file_path"))


def read_lines(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """(source_file, at, line): all lines of text files in splits; ``at`` orders the lines of a file."""
    raw = (spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", True).text(paths)
           .select(F.col("_metadata.file_path").alias("source_file"),
                   F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq")).alias("at"),
                   F.col("value")))
    plain = F.is_valid_utf8("value")
    old = F.translate(F.decode(F.col("value").cast("binary"), "ISO-8859-1"), CP1252_BYTES, CP1252_CHARS)
    text = F.regexp_replace(F.when(plain, F.col("value")).otherwise(old), "^\ufeff|\r$", "")
    return raw.select("source_file", "at", text.alias("line"), plain.alias("utf8"))


def cells_of(line: Column, sep: Column) -> Column:
    """The cells of a CSV record, any number of them: quotes may hold separators, ``""`` is a quote."""
    quoted = F.split(line, F.concat(F.when(sep == "|", F.lit("\\|")).otherwise(sep), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)')), -1)
    plain = F.split(line, F.when(sep == "|", F.lit("\\|")).otherwise(sep), -1)
    raw = F.when(F.contains(line, F.lit('"')), quoted).otherwise(plain)
    bare = lambda c: F.when(c.rlike(r'(?s)^\s*".*"\s*$') & (F.length(F.trim(c)) > 1),
                            F.replace(F.regexp_replace(c, r'^\s*"|"\s*$', ""), F.lit('""'), F.lit('"'))).otherwise(c)
    return F.transform(raw, bare)


def profile_lines(lines: DataFrame) -> DataFrame:
    """S3-S5, S8, S11 decided on all lines of a file, one pre-aggregated row per file."""
    n = {d: F.sum(_count(F.col("line"), d)) for d in DELIMITERS}
    filled = F.trim("line") != ""
    per = lines.groupBy("source_file").agg(
        F.min_by("line", "at").alias("header_line"), F.min("at").alias("header_at"), F.bool_and("utf8").alias("utf8"),
        *[c.alias(f"_n{i}") for i, c in enumerate(n.values())],
        F.count(F.when(filled, 1)).alias("n_lines"),
        F.min(F.when(filled, _count(F.col("line"), ","))).alias("_least"), F.max(F.when(filled, _count(F.col("line"), ","))).alias("_most"),
        F.bool_or(_count(F.col("line"), '"') % 2 == 1).alias("open_quotes"),
        *[F.count(F.when(F.col("line").rlike(p), 1)).alias(f"_p{i}") for i, p in enumerate(CORRUPTION_PATTERNS)])
    ranked = F.transform(F.reverse(F.array_sort(F.array(*[
        F.struct(F.col(f"_n{i}").alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]))), lambda x: x["d"])
    per = per.withColumn("likely_delimiters", ranked).withColumn("delimiter", F.get("likely_delimiters", F.lit(0)))
    per = per.withColumn("header", F.transform(cells_of(F.col("header_line"), F.col("delimiter")), lambda c: F.trim(c)))
    has_header = F.size(F.filter("header", lambda c: c.rlike("[a-zA-Z]"))) >= 2
    damaged = (F.col("_least") != F.col("_most")) | sum(F.col(f"_p{i}") for i in range(len(CORRUPTION_PATTERNS))).cast("boolean")
    strategy = (F.when((F.col("delimiter") == ",") & (F.size("header") > 2), F.lit("standard"))
                 .when(F.size("header") > 2, F.lit("delimiter_detection"))
                 .when(damaged, F.lit("corrupted_column")).otherwise(F.lit("manual_mapping")))
    return per.select("source_file", F.when(F.col("utf8"), F.lit("utf-8")).otherwise(F.lit("windows-1252")).alias("encoding"),
                      "delimiter", "likely_delimiters", has_header.alias("has_header"), "header", "header_at", "n_lines", "open_quotes",
                      F.size("header").alias("column_count"), damaged.alias("damaged"), strategy.alias("strategy"))


def with_files(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``lines`` with what is known of their file. The lines stay in their splits: to shuffle them by file would
    deal a large file to one task. ``files`` has one row a file, as Spark's own list of files on the driver has."""
    return lines.join(F.broadcast(files), "source_file")


def read_records(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """Every record of every file by its own header, nothing dropped but blank lines.

    Columns: source_file, at, parse_strategy, header, cells, fields (map of header name to cell; a
    repeated name keeps its last cell), extra (cells beyond the header) and _corrupt_record (the
    record's text where it has extra or missing cells or an open quote). Files without a header
    line name their columns ``_c0``, ``_c1``, ...
    """
    lines = read_lines(spark, paths, glob)
    files = cut_lineage(profile_lines(lines))   # both kinds of files are told by it: all lines are profiled once
    known = with_files(lines, files)
    known = known.filter((F.col("at") != F.col("header_at")) | ~F.col("has_header"))
    keep = ["source_file", "at", "line", "strategy", "header", "has_header", "delimiter"]
    # files with a quoted line end: records are put together split by split
    joined = join_records(known.filter("open_quotes").select(*keep)).select(*keep)
    rows = known.filter("NOT open_quotes").select(*keep).unionByName(joined).filter(F.trim("line") != "")
    rows = rows.withColumn("cells", cells_of(F.col("line"), F.col("delimiter")))
    names = F.when(F.col("has_header"), F.col("header")).otherwise(F.transform(F.col("cells"), lambda c, i: F.concat(F.lit("_c"), i.cast("string"))))
    rows = rows.withColumn("header", names)
    n = F.least(F.size("header"), F.size("cells"))
    pairs = F.arrays_zip(F.slice("header", 1, n).alias("k"), F.slice("cells", 1, n).alias("v"))
    last = F.filter(pairs, lambda x, i: ~F.exists(F.filter(pairs, lambda y, j: j > i), lambda y: y["k"] == x["k"]))
    bad = (F.size("cells") != F.size("header")) | (_count(F.col("line"), '"') % 2 == 1)
    return rows.select("source_file", "at", F.col("strategy").alias("parse_strategy"), "header", "cells",
                       F.map_from_entries(last).alias("fields"),
                       F.when(F.size("cells") > F.size("header"), F.slice("cells", F.size("header") + 1, F.size("cells") - F.size("header"))).alias("extra"),
                       F.when(bad, F.col("line")).alias("_corrupt_record"))


def statement_columns(records: DataFrame, aliases: dict[str, list[str]]) -> DataFrame:
    """C11/C13 in the read path: canonical columns from each file's own header.

    A canonical column takes the cell of the first header name that is its name, or else contains one of
    its aliases (lower-cased). Missing cells are null."""
    # the lowered names are a column of their own: every canonical column looks them up
    staged = records.withColumn("_low", F.transform("header", lambda h: F.lower(F.trim(h))))
    known = lambda place: F.nullif(place, F.lit(0).cast("long"))

    def at(name: str, words: list[str]) -> Column:
        fuzzy = lambda h: sum((F.contains(h, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
        return F.coalesce(known(F.array_position("_low", F.lit(name))), known(F.array_position(F.transform("_low", fuzzy), F.lit(True))))
    cell = lambda place: F.nullif(F.get("cells", (place - 1).cast("int")), F.lit(""))
    return staged.select("source_file", "parse_strategy", "extra", "_corrupt_record", *[cell(at(c, w)).alias(c) for c, w in aliases.items()])


def read_text_minimal(spark: SparkSession, paths, columns: list[str]) -> DataFrame:
    """Naive comma split of text lines. The first line of each file is the header and is
    skipped; blank lines and lines with fewer fields than the header are skipped; a
    non-numeric amount drops only that field (NULL); defaults 'uncategorized' / 'USD'.
    Lines are read in splits; the first line of a file is known from the per-file minimum."""
    lines = read_lines(spark, paths, "*")
    first = lines.groupBy("source_file").agg(F.min("at").alias("first_at"))
    lines = lines.join(first, "source_file").filter(F.col("at") != F.col("first_at"))
    lines = lines.select(F.col("source_file").alias("_f"), "line", F.split(F.col("line"), ",").alias("_parts"))
    parts = F.col("_parts")
    body = lines.filter((F.trim("line") != "") & (F.size(parts) >= len(columns)))
    sel = []
    for i, c in enumerate(columns):
        v = F.trim(F.get(parts, i))
        if c == "amount":
            sel.append(F.when(v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), v.try_cast("double")).alias(c))
        else:
            sel.append(v.alias(c))
    out = body.select(*sel, F.col("_f").alias("source_file"))
    if "category" not in columns:
        out = out.withColumn("category", F.lit("uncategorized"))
    if "currency" not in columns:
        out = out.withColumn("currency", F.lit("USD"))
    return out


def read_files(spark: SparkSession, paths, glob: str = "*.csv") -> DataFrame:
    """``binaryFile`` scan: path, modificationTime, length, content (one row per file)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)


def _count(text: Column, sub: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(sub), F.lit("")))


def profile_files(files: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """S3–S6, S8, S11, S13, S14 as one projection over ``binaryFile`` rows.

    Note: Spark's file listing skips zero-length files, so the "file is empty" reason only
    applies to rows built by other means; empty uploads simply produce no row."""
    bom = F.substring(F.col("content"), 1, 3) == F.unhex(F.lit("EFBBBF"))
    utf8 = F.is_valid_utf8(F.col("content").cast("string"))
    encoding = F.when(bom, F.lit("utf-8-sig")).when(utf8, F.lit("utf-8")).otherwise(F.lit("windows-1252"))
    text = F.when(utf8, F.decode(F.col("content"), "UTF-8")).otherwise(
        F.translate(F.decode(F.col("content"), "ISO-8859-1"), CP1252_BYTES, CP1252_CHARS))
    staged = files.select("path", "length", "content", encoding.alias("encoding"), text.alias("_text"))
    head = F.substring(F.col("_text"), 1, PROFILE_CHARS)
    counts = F.array(*[F.struct(_count(head, d).alias("n"), F.lit(-i).alias("o"), F.lit(d).alias("d"))
                       for i, d in enumerate(DELIMITERS)])
    ranked = F.transform(F.reverse(F.array_sort(counts)), lambda s: s["d"])   # by count desc, then list order
    lines = F.slice(F.split(F.col("_text"), "\r?\n"), 1, PROFILE_LINES)
    first_line = F.get(lines, 0)
    hits = F.flatten(F.transform(lines, lambda ln, i: F.filter(
        F.array(*[F.when(ln.rlike(p), F.concat(F.lit("Line "), (i + 1).cast("string"),
                                                F.lit(f": Pattern '{p}' detected")))
                  for p in CORRUPTION_PATTERNS]), lambda x: x.isNotNull())))
    col_counts = F.array_sort(F.array_distinct(F.transform(
        F.filter(lines, lambda ln: F.trim(ln) != ""), lambda ln: _count(ln, ",") + 1)))
    indicators = F.when(F.size(col_counts) > 1, F.array_append(
        hits, F.concat(F.lit("Inconsistent column counts: "), F.array_join(col_counts.cast("array<string>"), ",")))) \
        .otherwise(hits)
    s1 = staged.select("path", "length", "encoding", "_text", ranked.alias("likely_delimiters"),
                       first_line.alias("_first"), indicators.alias("corruption_indicators"),
                       F.sha2(F.col("content"), 256).alias("file_hash"))
    delim = F.get(F.col("likely_delimiters"), 0)
    fields = F.split(F.col("_first"), F.when(delim == "|", F.lit("\\|")).otherwise(delim))
    header_guess = F.size(F.filter(fields, lambda f: f.rlike("[a-zA-Z]"))) >= 2
    comma_cols = F.size(F.split(F.col("_first"), ","))
    valid_reason = (F.when(F.col("length") > max_bytes, F.lit("file too large"))
                     .when(F.col("length") == 0, F.lit("file is empty"))
                     .when(~F.lower(F.col("path")).endswith(".csv"), F.lit("unsupported file type")))
    strategy = (F.when(comma_cols > 2, F.lit("standard"))
                 .when(F.size(fields) > 2, F.lit("delimiter_detection"))
                 .when(F.size(F.col("corruption_indicators")) > 0, F.lit("corrupted_column"))
                 .otherwise(F.lit("manual_mapping")))
    return s1.select(
        "path", F.col("length").alias("file_size"), "encoding", F.regexp_replace("_first", "^\ufeff", "").alias("header_line"), delim.alias("delimiter"), "likely_delimiters",
        header_guess.alias("has_header"), F.size(fields).alias("column_count"),
        F.least(F.greatest(F.size(F.filter(F.split(F.col("_text"), "\r?\n"), lambda ln: F.trim(ln) != "")) -
                           F.when(header_guess, 1).otherwise(0), F.lit(0)), F.lit(5)).alias("sample_rows"),
        "corruption_indicators", "file_hash",
        valid_reason.isNull().alias("valid"), valid_reason.alias("invalid_reason"),
        strategy.alias("strategy"))


def read_by_profile(spark: SparkSession, profile: DataFrame) -> DataFrame:
    """One CSV scan per (delimiter, header line, encoding), united by name.

    Files are read with their own header only; the size and type checks of the profile are a
    report and drop nothing. For many different headers ``read_records`` needs one scan."""
    groups = (profile.groupBy("delimiter", "has_header", "encoding", "header_line")
              .agg(F.collect_list("path").alias("paths")).collect())
    out = None
    for g in groups:
        enc = "UTF-8" if g["encoding"].startswith("utf-8") else "ISO-8859-1"
        df = read_statements(spark, g["paths"], sep=g["delimiter"], header=g["has_header"], encoding=enc)
        if enc != "UTF-8":
            df = df.select(*[F.translate(c, CP1252_BYTES, CP1252_CHARS).alias(c) for c in df.columns])
        df = df.withColumn("parse_strategy", F.lit("standard" if g["delimiter"] == "," else "delimiter_detection"))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out if out is not None else spark.createDataFrame([], "source_file string, parse_strategy string")


def read_corrupted_columns(spark: SparkSession, paths, sep: str = ",") -> DataFrame:
    """Headerless read; per file, the first of the first three lines with ≥ 2 cells that
    contain letters is the header and is dropped from the data. Files carry different headers,
    so each row comes out as ``fields MAP<header name, value>`` plus its file; rows have any width."""
    lines = read_lines(spark, paths, "*").filter(F.trim("line") != "")
    cells = lines.select("source_file", "at", cells_of(F.col("line"), F.lit(sep)).alias("cells"))
    # the first lines lie in a file's first split
    top = (cells.filter(F.col("at.block") == 0).withColumn("line_no", F.row_number().over(Window.partitionBy("source_file").orderBy("at")))
           .filter((F.col("line_no") <= 3) & (F.size(F.filter("cells", lambda c: c.rlike("[a-zA-Z]"))) >= 2)))
    headers = top.groupBy("source_file").agg(F.min_by("cells", "line_no").alias("header"), F.min("at").alias("header_at"))
    data = cells.join(headers, "source_file", "left").filter(F.col("header_at").isNull() | (F.col("at") != F.col("header_at")))
    names = F.coalesce(F.col("header"), F.transform("cells", lambda c, i: F.concat(F.lit("_c"), i.cast("string"))))
    n = F.least(F.size(names), F.size("cells"))
    return data.select("source_file", "at", names.alias("header"),
                       F.map_from_arrays(F.slice(F.transform(names, lambda c: F.trim(c)), 1, n),
                                         F.slice("cells", 1, n)).alias("fields"),
                       F.when(F.size("cells") > F.size(names), F.slice("cells", F.size(names) + 1, F.size("cells") - F.size(names))).alias("extra"))


def content_hashes(lines: DataFrame) -> DataFrame:
    """(source_file, file_hash, n_lines) from a file's lines in any order and split.

    Two sums of independent 64-bit hashes and the number of lines; ends of lines and the byte order
    mark do not count. One partial aggregate per split, so one file of any size stays spread."""
    wide = lambda c: F.sum(c.cast("decimal(20,0)"))
    per = lines.groupBy("source_file").agg(wide(F.xxhash64("line")).alias("_a"), wide(F.xxhash64(F.lit(1), F.col("line"))).alias("_b"),
                                           F.count(F.lit(1)).alias("n_lines"))
    return per.select("source_file", F.sha2(F.concat_ws("|", "_a", "_b", "n_lines"), 256).alias("file_hash"), "n_lines")


def duplicate_files(lines: DataFrame) -> DataFrame:
    """Every file with ``keep_file``, the first by name of the files with the same lines."""
    own = content_hashes(lines)
    first = own.groupBy("file_hash").agg(F.min("source_file").alias("keep_file"), F.count(F.lit(1)).alias("copies"))
    return own.join(first, "file_hash").withColumn("kept", F.col("source_file") == F.col("keep_file"))


def without_duplicate_files(rows: DataFrame, verdicts: DataFrame) -> DataFrame:
    """``rows`` less those of files that repeat another (``duplicate_files``). Dropped files are the
    joined side, so the rows of a file that stays are not shuffled where few files repeat."""
    dropped = verdicts.filter(~F.col("kept")).select("source_file")
    return rows.join(dropped, "source_file", "left_anti")
