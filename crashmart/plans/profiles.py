"""Source profiles: what a native file contains, before and beside the typed model."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dates import iso_date
from ..functions.numbers import DIGITS, count_token, exact_pair
from ..functions.text import trimmed_or_null
from ..operators.relations import category_totals, first_per_group, key_sizes


def grain(df: DataFrame, key: str, in_analysis: Column) -> DataFrame:
    """Q1: rows, blank keys, distinct keys, duplicate or blank keys, analysis rows."""
    k = trimmed_or_null(key)
    per = df.groupBy(k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.count_if(in_analysis).alias("a"))
    blank, n = F.col("k").isNull(), F.col("n")
    return per.agg(
        F.sum("n").alias("full_source_rows"), F.coalesce(F.sum(F.when(blank, n)), F.lit(0)).alias("blank_keys"),
        F.count("k").alias("distinct_nonblank_keys"), (F.sum("n") - F.count("k")).alias("duplicate_or_blank_keys"),
        F.sum("a").alias("analysis_rows"))


def key_examples(df: DataFrame, order: list[Column], columns: list[str], n: int = 5) -> DataFrame:
    """Q2: the first n rows in native order, for tracing by hand."""
    return df.orderBy(*order).select(*columns).limit(n)


def month_coverage(df: DataFrame, year: str, month: str) -> DataFrame:
    """Q3: rows per year and month; an unknown month stays NULL."""
    return df.groupBy(year, month).agg(F.count(F.lit(1)).alias("row_count")).orderBy(year, F.col(month).asc_nulls_last())


def category_counts(df: DataFrame, column: str, categories: DataFrame, missing: str) -> DataFrame:
    """Q4: every listed category with its count, explicit zero included."""
    return category_totals(df, F.coalesce(trimmed_or_null(column), F.lit(missing)), categories, "native_value", "row_count")


def count_quality(df: DataFrame, parts: list[str], total: str, first: str) -> DataFrame:
    """Q5: rows with missing or invalid tokens, rows whose parts do not add up, and sums over fully known rows."""
    fields = [*parts, total]
    missing = reduce(lambda a, b: a | b, [trimmed_or_null(f"`{f}`").isNull() for f in fields])
    invalid = reduce(lambda a, b: a | b, [F.coalesce(~F.trim(F.col(f"`{f}`")).rlike(DIGITS), F.lit(False)) for f in fields])
    # Digit tokens are whole numbers of any length: what 38 digits cannot hold fails the job rather than leave the sums.
    value = lambda f: F.when(known, F.trim(F.col(f"`{f}`"))).cast("decimal(38,0)")
    known = ~missing & ~invalid
    added = reduce(lambda a, b: a + b, [value(f) for f in parts])
    return df.agg(
        F.count_if(missing).alias("rows_with_missing_count"), F.count_if(invalid).alias("rows_with_invalid_count"),
        F.count_if(F.coalesce(known & (added != value(total)), F.lit(False))).alias("component_mismatch_rows"),
        F.sum(value(first)).cast("bigint").alias("first_part_sum"), F.sum(value(total)).cast("bigint").alias("total_sum"))


def wide_totals(df: DataFrame, columns: list[str]) -> DataFrame:
    """Q6: wide count columns as rows: missing, invalid, sum and rows above zero per column."""
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("category"), F.col(f"`{c}`").alias("raw_value")) for c in columns])))
    t = F.trim("raw_value")
    empty = F.col("raw_value").isNull() | (t == "")
    number = F.coalesce(t.rlike(DIGITS), F.lit(False))
    return long.groupBy("category").agg(
        F.count_if(empty).alias("missing_rows"),
        F.count_if(F.col("raw_value").isNotNull() & ~number).alias("invalid_rows"),
        F.sum(F.when(number, t).cast("decimal(38,0)")).cast("bigint").alias("aggregate_sum"),
        F.count_if(F.coalesce(t.rlike(r"\A[1-9][0-9]*\z"), F.lit(False))).alias("rows_above_zero"))


def coordinate_presence(df: DataFrame, latitude: str, longitude: str, crs: str, reason: str) -> DataFrame:
    """Q7: presence of native coordinates; presence is not map eligibility."""
    both = trimmed_or_null(latitude).isNotNull() & trimmed_or_null(longitude).isNotNull()
    return df.agg(F.count(F.lit(1)).alias("analysis_rows"), F.count_if(both).alias("native_coordinate_rows"),
                  F.count_if(~both).alias("missing_coordinate_rows")).select(
        "*", F.lit(crs).alias("source_crs"), F.lit(False).alias("published_map_available"), F.lit(reason).alias("reason_code"))


def published_boundary(crash: DataFrame, unit: DataFrame) -> DataFrame:
    """Q8: what was published for one source."""
    return crash.agg(F.count(F.lit(1)).alias("crash_count"), F.count_if("map_eligible").alias("published_map_count"),
                     F.count_if(~F.col("map_eligible")).alias("published_unmapped_count")).crossJoin(
        unit.agg(F.count(F.lit(1)).alias("canonical_unit_count")))


# ------------------------------------------------------------------------------------------------------ multi-file profile

def key_stats(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row: rows, rows with a blank key part, distinct keys, duplicate groups, duplicate extra rows."""
    from ..functions.text import is_blank
    per = key_sizes(df, keys)
    blank = reduce(lambda a, b: a | b, [is_blank(k) for k in keys])
    zero = F.lit(0).cast("bigint")
    return per.agg(
        F.coalesce(F.sum("n"), zero).alias("row_count"), F.coalesce(F.sum(F.when(blank, F.col("n"))), zero).alias("blank_key_rows"),
        F.count(F.lit(1)).alias("distinct_key_count"), F.count_if(F.col("n") > 1).alias("duplicate_key_groups"),
        F.coalesce(F.sum(F.col("n") - 1), zero).alias("duplicate_extra_rows"))


def date_profile(df: DataFrame, token: str) -> DataFrame:
    """One row: first and last valid date and the number of invalid tokens."""
    day = iso_date(token)
    return df.agg(F.date_format(F.min(day), "yyyy-MM-dd").alias("date_min"), F.date_format(F.max(day), "yyyy-MM-dd").alias("date_max"),
                  F.count_if(day.isNull()).alias("invalid_date_count"))


def rows_by_period(df: DataFrame, token: str) -> DataFrame:
    """Rows by year and by month in one pass: period is YYYY or YYYY-MM."""
    day = iso_date(token)
    per = df.filter(day.isNotNull()).groupBy(F.date_format(day, "yyyy-MM").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    years = per.groupBy(F.substring("month", 1, 4).alias("period")).agg(F.sum("n").alias("row_count"))
    return years.unionByName(per.select(F.col("month").alias("period"), F.col("n").alias("row_count")))


def token_histogram(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts of every token of several columns in one pass: (field, token, row_count)."""
    long = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("string").alias("token")) for c in columns])))
    return long.groupBy("field", "token").agg(F.count(F.lit(1)).alias("row_count"))


def component_mismatches(df: DataFrame, parts: list[str], total: str) -> DataFrame:
    """Rows whose known parts do not add up to the known total."""
    added = reduce(lambda a, b: a + b, [count_token(p).cast("bigint") for p in parts])
    return df.filter(added != count_token(total).cast("bigint"))


def coordinate_groups(df: DataFrame, keys: list[str], latitude: str, longitude: str) -> DataFrame:
    """One row: groups, groups with more than one row, with several exact pairs, with an unusable pair."""
    per = df.withColumn("pair", exact_pair(latitude, longitude)).groupBy(*keys, "pair").agg(F.count(F.lit(1)).alias("n"))
    groups = per.groupBy(*keys).agg(F.sum("n").alias("n"), F.count("pair").alias("pairs"), F.count_if(F.col("pair").isNull()).alias("bad"))
    return groups.agg(F.count(F.lit(1)).alias("group_count"), F.count_if(F.col("n") > 1).alias("duplicate_groups"),
                      F.count_if(F.col("pairs") > 1).alias("multiple_coordinate_groups"),
                      F.count_if(F.col("bad") > 0).alias("groups_with_invalid_coordinates"))


def finding_counts(findings: DataFrame, year: str) -> DataFrame:
    """Rows per finding and occurrence year (NULL when the parent is unknown)."""
    return findings.groupBy("finding", year).agg(F.count(F.lit(1)).alias("row_count"))


def finding_examples(findings: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """At most n located examples per finding."""
    return first_per_group(findings, ["finding"], order, n)
