"""Parsing strategies tried on every file at once.

A file is read by the first strategy whose result is sound, in this order:

``standard``             comma, the first record is the header
``delimiter_detection``  of the separators by frequency the first that gives more than two columns
``corrupted_column``     only for files with signs of damage: comma, no header line expected; the first of
                         the first three records with two cells that hold letters is the header
``manual_mapping``       as standard, less records without any value
``manual_recovery``      what is left: as manual_mapping, whatever the structure
``unreadable``           no strategy reads the file: records are wider than its header

A strategy reads a file if no record is wider than its header (shorter ones are filled with nulls);
the result is sound (S12) with a record, three columns and a cell that holds a digit. All strategies
are judged in one pass over the records: cell counts per separator and the shares of numeric cells are one
pre-aggregated row per file, and every file's verdicts are kept as a list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerlake.session import cut_lineage
from ledgerlake.sources.quoting import join_records
from ledgerlake.sources.statements import DELIMITERS, cells_of, profile_lines, read_lines, with_files

STRATEGIES = ["standard", "delimiter_detection", "corrupted_column", "manual_mapping", "manual_recovery", "unreadable"]
#: What reads as a missing value, a whole number, a number, a truth value.
MISSING = r"(?i)^\s*(|nan|null|none|n/a|na|#n/a)\s*$"
WHOLE, NUMBER, TRUTH = r"^\s*[+-]?\d+\s*$", r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$", r"^(True|TRUE|true|False|FALSE|false)$"
SAMPLES = 3


def file_records(spark: SparkSession, paths, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(records: source_file, at, line; files: one row per file) with quoted line ends rejoined, blank lines left out."""
    lines = read_lines(spark, paths, glob)
    files = cut_lineage(profile_lines(lines).select("source_file", "encoding", "likely_delimiters", "damaged", "open_quotes"))
    known = with_files(lines.select("source_file", "at", "line"), files.select("source_file", "open_quotes"))
    plain = known.filter("NOT open_quotes").select("source_file", "at", "line")
    records = plain.unionByName(join_records(known.filter("open_quotes").select("source_file", "at", "line")))
    return records.filter(F.trim("line") != ""), files.drop("open_quotes")


def first_records(records: DataFrame, n: int) -> DataFrame:
    """``records`` with ``place``, the first ``n`` of a file only; each task passes on at most ``n`` rows of a file."""
    return records.withColumn("place", F.row_number().over(Window.partitionBy("source_file").orderBy("at"))).filter(F.col("place") <= n)


def _letters(cells: Column) -> Column:
    return F.size(F.filter(cells, lambda c: c.rlike("[a-zA-Z]")))


def judge(records: DataFrame, files: DataFrame) -> DataFrame:
    """One row per file: strategy, delimiter, header_at (null: none), header, and ``tried``, a list of
    (strategy, delimiter, columns, records, numeric_share, accepted, reason) in the order of the trials."""
    counts = [F.size(cells_of(F.col("line"), F.lit(d))) for d in DELIMITERS]
    stats = []
    for i, d in enumerate(DELIMITERS):
        cells = cells_of(F.col("line"), F.lit(d))
        numeric = F.size(F.filter(cells, lambda c: c.rlike(r"\d")))
        stats += [F.max(F.struct(counts[i].alias("n"))).getField("n").alias(f"width_{i}"), F.sum(counts[i]).alias(f"cells_{i}"), F.sum(numeric).alias(f"numeric_{i}")]
    per = records.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), *stats)
    top = (first_records(records, 3).groupBy("source_file")
           .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "at", "line"))), lambda x: F.struct(x["at"].alias("at"), x["line"].alias("line"))).alias("top")))
    # the widest record after the first is not needed: one wider than the header is the widest of all
    per = per.join(top, "source_file").join(files, "source_file")
    first = F.get("top", F.lit(0))

    def stat(name: str, d: Column) -> Column:
        out = F.col(f"{name}_0")
        for i in range(1, len(DELIMITERS)):
            out = F.when(d == DELIMITERS[i], F.col(f"{name}_{i}")).otherwise(out)
        return out

    def trial(strategy: str, d: Column, header: Column, header_at: Column, allowed: Column) -> Column:
        """The verdict on reading the file with separator ``d`` and this header record."""
        head = cells_of(header, d)
        data = F.col("n") - F.when(header_at.isNotNull(), 1).otherwise(0)
        columns = F.size(cells_of(first["line"], d))      # a header found further down does not change the width
        numeric = stat("numeric", d) - F.when(header_at.isNotNull(), F.size(F.filter(head, lambda c: c.rlike(r"\d")))).otherwise(0)
        share = numeric / F.nullif(stat("cells", d) - F.when(header_at.isNotNull(), F.size(head)).otherwise(0), F.lit(0))
        reason = (F.when(~allowed, F.lit("no sign of damage" if strategy == "corrupted_column" else "no separator gives three columns"))
                  .when(stat("width", d) > columns, F.lit("records wider than the header")))
        if strategy not in ("manual_recovery", "unreadable"):
            reason = (reason.when(data == 0, F.lit("no record")).when(columns < 3, F.lit("fewer than three columns"))
                      .when(numeric == 0, F.lit("no numeric cell")))
        if strategy == "unreadable":
            reason = F.lit(None).cast("string")
        return F.struct(F.lit(strategy).alias("strategy"), d.alias("delimiter"), columns.alias("columns"), data.alias("records"),
                        F.coalesce(F.round(share, 4), F.lit(0.0)).alias("numeric_share"), reason.isNull().alias("accepted"), reason.alias("reason"),
                        header_at.alias("header_at"), F.when(header_at.isNotNull(), header).alias("header_line"))

    comma, yes = F.lit(","), F.lit(True)
    wide = F.filter("likely_delimiters", lambda d: (F.size(cells_of(first["line"], d)) > 2) & (stat("width", d) <= F.size(cells_of(first["line"], d))))
    found = F.get(wide, F.lit(0))
    headed = F.get(F.filter("top", lambda x: (_letters(cells_of(x["line"], comma)) >= 2)), F.lit(0))
    none = F.lit(None).cast(records.schema["at"].dataType)
    tried = F.array(
        trial("standard", comma, first["line"], first["at"], yes),
        trial("delimiter_detection", F.coalesce(found, comma), first["line"], first["at"], found.isNotNull()),
        trial("corrupted_column", comma, F.coalesce(headed["line"], first["line"]), F.coalesce(headed["at"], none), F.col("damaged")),
        trial("manual_mapping", comma, first["line"], first["at"], yes),
        trial("manual_recovery", comma, first["line"], first["at"], yes),
        trial("unreadable", comma, first["line"], none, yes))
    # the list ends with the strategy that was taken
    upto = F.array_position(F.transform("all", lambda t: t["accepted"]), True).cast("int")
    per = per.select("source_file", "encoding", tried.alias("all")).withColumn("tried", F.slice("all", 1, upto))
    taken = F.element_at("tried", -1)
    header = F.when(taken["header_line"].isNotNull(), F.transform(cells_of(taken["header_line"], taken["delimiter"]), lambda c: F.trim(c)))
    return per.select("source_file", "encoding", taken["strategy"].alias("strategy"), taken["delimiter"].alias("delimiter"), taken["columns"].alias("columns"),
                      taken["header_at"].alias("header_at"), header.alias("header"),
                      F.transform("tried", lambda t: t.dropFields("header_at", "header_line")).alias("tried"))


def route(records: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Records as their file's strategy reads them: source_file, at, strategy, header, cells (as many as the header).

    Empty cells are null. Without a header the columns are ``_c0``, ``_c1``, ... Records without any value
    are left out by the manual strategies, as they are for every strategy where ``keep`` asks for it
    (:func:`without_empty`). Unreadable files keep each record's text as one cell."""
    known = with_files(records, verdicts.select("source_file", "strategy", "delimiter", "columns", "header_at", "header"))
    known = known.filter(F.col("header_at").isNull() | (F.col("at") != F.col("header_at")))
    unread = F.col("strategy") == "unreadable"
    raw = F.when(unread, F.array("line")).otherwise(cells_of(F.col("line"), F.col("delimiter")))
    width = F.when(unread, 1).otherwise(F.col("columns"))
    names = F.coalesce("header", F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.concat(F.lit("_c"), i.cast("string"))))
    cells = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.nullif(F.get(F.col("raw"), i), F.lit("")))
    rows = known.withColumn("raw", raw).select("source_file", "at", "strategy", names.alias("header"), cells.alias("cells"))
    return rows.filter(~F.col("strategy").isin("manual_mapping", "manual_recovery") | ~empty(F.col("cells")))


def empty(cells: Column) -> Column:
    """No cell has a value."""
    return F.forall(cells, lambda c: c.isNull() | c.rlike(MISSING))


def without_empty(rows: DataFrame) -> DataFrame:
    return rows.filter(~empty(F.col("cells")))


def read_cascade(spark: SparkSession, paths, glob: str = "*.csv") -> tuple[DataFrame, DataFrame]:
    """(routed records, verdicts per file)."""
    records, files = file_records(spark, paths, glob)
    verdicts = cut_lineage(judge(records, files))   # one row a file: all records are judged once
    return route(records, verdicts), verdicts


def describe_columns(rows: DataFrame, samples: int = SAMPLES) -> DataFrame:
    """One row per file and column: position, name, filled, dtype and the cells of the first ``samples`` records.

    The type is the least of a lattice that holds all cells, over all records: ``bool`` (no cell missing), ``int64``
    (no cell missing), ``float64`` (also for columns without a value), else ``object``. Every cell gives three truth
    values, so the type is one aggregate that is merged per task, for any number of columns."""
    cell = F.when(F.col("cell").rlike(MISSING), None).otherwise(F.col("cell"))
    long = rows.select("source_file", F.posexplode("cells").alias("position", "cell"), "header")
    long = long.select("source_file", "position", F.get("header", F.col("position")).alias("name"), cell.alias("cell"))
    full = F.count("cell") == F.count(F.lit(1))
    types = long.groupBy("source_file", "position").agg(
        F.first("name", ignorenulls=True).alias("name"), F.count("cell").alias("filled"), F.count(F.lit(1)).alias("records"),
        F.when((F.count("cell") > 0) & full & F.bool_and(F.col("cell").rlike(TRUTH)), "bool")
         .when((F.count("cell") > 0) & full & F.bool_and(F.col("cell").rlike(WHOLE)), "int64")
         .when((F.count("cell") == 0) | F.bool_and(F.col("cell").rlike(NUMBER)), "float64").otherwise("object").alias("dtype"))
    # each task passes on the first records of a file only
    top = first_records(rows.select("source_file", "at", "cells"), samples).select("source_file", "place", F.posexplode("cells").alias("position", "cell"))
    first = top.groupBy("source_file", "position").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "cell"))), lambda x: x["cell"]).alias("samples"))
    return types.join(first, ["source_file", "position"])
