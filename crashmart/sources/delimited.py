"""Native delimited text. Every value stays text; nothing is inferred.

A file set without line breaks inside fields is scanned line by line, which Spark can split at any size. Positions are
then counted per split and shifted by the split's offset, so a locator is the logical record number in its own file even
though no task sees a whole file. Where quoted fields hold line breaks, lines are put together to records first, by the quotes before them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from ..contracts import FileSpec
from ..errors import ContractError
from ..functions.hashing import record_id
from ..session import materialize

CORRUPT, VALID = "_malformed", "_valid_utf8"
BOM = "\ufeff"


def headers(spark: SparkSession, path: str) -> DataFrame:
    """(file, cells) of every file. Reads only the first line of each file's first split."""
    first = (spark.read.option("lineSep", "\n").text(path)
             .select(F.col("_metadata.file_path").alias("file"), "value",
                     F.col("_metadata.file_block_start").alias("start"), _row_in_task().alias("row"))
             .filter("start = 0"))
    # The lowest row id of a file's first split is its first line.
    lines = first.groupBy("file").agg(F.min_by("value", "row").alias("line"))
    return lines.select("file", _cells(F.regexp_replace("line", rf"\A{BOM}|\r\z", "")).alias("cells"))


def _cells(line: Column) -> Column:
    """Cells of one header line: quoted or plain, split at commas outside quotes."""
    parts = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"|[^,]*)'), F.lit(1))
    return F.transform(parts, lambda c: F.when(
        c.startswith('"'), F.replace(F.substring(c, F.lit(2), F.length(c) - 2), F.lit('""'), F.lit('"'))).otherwise(c))


def check_headers(spark: SparkSession, path: str, spec: FileSpec) -> None:
    """Complete ordered header, no duplicates, in every file of the set."""
    wanted, example = F.array(*[F.lit(h) for h in spec.header]), F.min(F.struct("file", "cells"))
    twice = F.size(F.array_distinct("cells")) != F.size("cells")
    found = (headers(spark, path).withColumns({"twice": twice, "other": F.col("cells") != wanted}).groupBy("twice", "other")
             .agg(F.count(F.lit(1)).alias("n"), example.alias("example")).collect())      # four groups at most, one example of each
    if not found:
        raise ContractError("MISSING_HEADER", "the input has no header", resource_id=spec.resource_id)
    for row in sorted(found, key=lambda r: r["example"]["file"]):
        file, cells = row["example"]
        if row["twice"]:
            raise ContractError("DUPLICATE_HEADER", "duplicate header cells", file=file, actual=list(cells))
        if row["other"]:
            raise ContractError("HEADER_MISMATCH", "header differs from the contract", file=file,
                                expected=list(spec.header), actual=list(cells))


def _row_in_task() -> Column:
    """Row number within the running task: the low 33 bits of the built-in id."""
    return F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))


def _schema(spec: FileSpec) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in spec.header]
                        + [T.StructField(CORRUPT, T.StringType())])


def _csv_options() -> dict[str, str]:
    return {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT, "quote": '"', "escape": '"',
            "emptyValue": "", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false",
            "maxCharsPerColumn": "-1", "maxColumns": str(1 << 16)}


def _positions(rows: DataFrame) -> DataFrame:
    """Add `position` (1-based, per file) to rows carrying file, start and row."""
    splits = rows.groupBy("file", "start").agg(F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)   # rows are splits
    # Written first: Spark then knows the size, and broadcasts the few values of each split or shuffles the lines as that allows.
    offsets = materialize(splits.select("file", "start", "first_row",
                                        F.coalesce(F.sum("n").over(before), F.lit(0).cast("bigint")).alias("offset")), "offsets")
    return (rows.join(offsets, ["file", "start"])
            .withColumn("position", F.col("offset") + F.col("row") - F.col("first_row") + 1)
            .drop("start", "row", "first_row", "offset"))


def _logical_records(lines: DataFrame) -> DataFrame:
    """Lines (file, start, row, _valid_utf8, line) put together to records (file, position, _valid_utf8, line), blank ones included.

    A line goes on with the record before it where an odd number of quotes stands before it in its file. Quotes are counted inside each
    split, then over the splits, and so are the records that begin; only the lines of one record ever meet in one place.
    """
    inside = Window.partitionBy("file", "start").orderBy("row")
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)      # rows are splits
    zero = F.lit(0).cast("bigint")
    counted = lines.withColumn("quotes", (F.length("line") - F.length(F.replace("line", F.lit('"')))).cast("bigint")).withColumn(
        "before", F.coalesce(F.sum("quotes").over(inside.rowsBetween(Window.unboundedPreceding, -1)), zero))
    splits = counted.groupBy("file", "start").agg(F.sum("quotes").alias("quotes"), F.count_if(F.col("before") % 2 == 0).alias("even"), F.count(F.lit(1)).alias("n"))
    splits = splits.withColumn("open", F.coalesce(F.sum("quotes").over(earlier), zero) % 2)
    begun = F.when(F.col("open") == 0, F.col("even")).otherwise(F.col("n") - F.col("even"))
    splits = materialize(splits.select("file", "start", "open", F.coalesce(F.sum(begun).over(earlier), zero).alias("records")), "offsets")
    begins = ((F.col("before") + F.col("open")) % 2 == 0).cast("bigint")
    numbered = counted.join(splits, ["file", "start"]).withColumn("position", F.col("records") + F.sum(begins).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("start", "row", "line")))
    return (numbered.groupBy("file", "position").agg(parts.alias("parts"), F.bool_and(VALID).alias(VALID))
            .select("file", "position", VALID, F.array_join(F.transform("parts", lambda x: x["line"]), "\n").alias("line")))


def scan(spark: SparkSession, path: str, spec: FileSpec) -> DataFrame:
    """Rows as (file, position, cells..., _malformed, _valid_utf8). Blank records are dropped but keep their number."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        _row_in_task().alias("row"), F.is_valid_utf8("value").alias(VALID), F.col("value").alias("line"))
    records = _logical_records(lines) if spec.multi_line else _positions(lines)
    parsed = F.from_csv("line", F.lit(_schema(spec).toDDL()), {**_csv_options(), "multiLine": str(spec.multi_line).lower()})
    placed = (records.withColumn("position", F.col("position") - 1)        # record 1 is the header
              .withColumn("line", F.regexp_replace("line", r"\r\z", ""))
              .filter((F.col("position") > 0) & (F.col("line") != ""))
              .withColumn("cells", parsed)
              .select("file", "position", "cells.*", VALID))
    # A native value is never NULL: an empty field is empty text.
    return placed.select("file", "position", *[F.coalesce(f"`{n}`", F.lit("")).alias(n) for n in spec.header],
                         CORRUPT, VALID)


def gate_counts(rows: DataFrame, spec: FileSpec) -> DataFrame:
    """One row per file: records, wrong width, NUL characters, invalid UTF-8."""
    cells = [F.col(f"`{n}`") for n in spec.header]
    anywhere = lambda test: F.greatest(*[test(c) for c in cells], F.lit(False))
    return rows.groupBy("file").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("row_width_mismatch"),
        F.count_if(anywhere(lambda c: F.instr(c, "\u0000") > 0)).alias("nul_character"),
        F.count_if(~F.col(VALID)).alias("invalid_utf8"),
        F.max("position").alias("last_position"))


def malformed(rows: DataFrame) -> DataFrame:
    """The offending records with their locators."""
    return rows.filter(F.col(CORRUPT).isNotNull()).select(
        "file", F.concat(F.lit("csv:"), F.col("position")).alias("row_locator"), CORRUPT)


def trim_trailing_blank(rows: DataFrame, columns: list[str]) -> DataFrame:
    """Drop all-NULL rows after the last row of each file that holds a value; keep the ones before it."""
    filled = F.greatest(*[F.col(f"`{c}`").isNotNull() for c in columns], F.lit(False))
    last = materialize(rows.groupBy("file").agg(F.max(F.when(filled, F.col("position"))).alias("last")), "last_rows")
    return rows.join(last, "file").filter(F.col("position") <= F.col("last")).drop("last")


def to_records(rows: DataFrame, spec: FileSpec) -> DataFrame:
    """Rows in the raw-record form: identity, locator and payload map. Positions restart in every file."""
    names = [F.col(f"`{n}`") for n in spec.header]
    locator = F.concat(F.lit("csv:"), F.col("position"))
    payload = F.map_from_arrays(F.array(*[F.lit(n) for n in spec.header]), F.array(*names))
    identity = [F.lit(spec.resource_id), F.lit(spec.file_sha256), F.lit(spec.parser_version), locator]
    return rows.select(
        record_id(*identity).alias("raw_record_id"), F.lit(spec.source_id).alias("source_id"),
        F.lit(spec.resource_id).alias("resource_id"), F.lit(spec.file_sha256).alias("file_sha256"),
        F.lit(spec.parser_version).alias("parser_version"), locator.alias("row_locator"), payload.alias("payload"))
