"""Fixed-snapshot reports.

Every report reads one succeeded batch, filters the fact first, aggregates, and joins the small dimensions last. A value is
NULL when nothing known contributes to it; its known count says how much did.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import KINDS, Manifest
from ..errors import ContractError
from ..functions.aggregates import count_where, ordered_distinct_text, percentage, sum_where
from ..functions.dates import month_of_id
from ..model import coverage_frame
from ..operators.filters import among, in_months, within_years
from ..operators.relations import no_rows
from ..operators.spine import month_spine, year_spine

ALL_MONTHS = tuple(range(1, 13))
PARENT = ["batch_id", "source_id", "release_scope", "crash_key"]


@dataclass(frozen=True)
class Batch:
    """One built batch: its log entry and its tables."""

    batch_id: str
    dataset_kind: str
    status: str
    manifest: Manifest
    fact: DataFrame
    unit: DataFrame
    sources: DataFrame
    severities: DataFrame


@dataclass(frozen=True)
class Request:
    dataset_kind: str
    source_ids: tuple[str, ...] | None = None
    year_from: int | None = None
    year_to: int | None = None
    months: tuple[int, ...] | None = None
    grain: str = "year"


@dataclass(frozen=True)
class Bounds:
    year_from: int
    year_to: int


def validate(batch: Batch | None, request: Request) -> Bounds:
    """Request rules, all on declared values. Years default to the batch's analysis years."""
    if request.dataset_kind not in KINDS:
        raise ContractError("DATASET_KIND", "expected official or synthetic", kind=request.dataset_kind)
    if request.grain not in ("year", "month"):
        raise ContractError("GRAIN", "expected year or month", grain=request.grain)
    if batch is None:
        raise ContractError("BATCH", "unknown batch")
    if batch.dataset_kind != request.dataset_kind:
        raise ContractError("BATCH_MODE", "batch belongs to another dataset kind")
    if batch.status != "succeeded":
        raise ContractError("BATCH_STATUS", "batch is not succeeded", status=batch.status)
    low = batch.manifest.year_from if request.year_from is None else request.year_from
    high = batch.manifest.year_to if request.year_to is None else request.year_to
    if not (1 <= low <= 9999 and 1 <= high <= 9999 and low <= high):
        raise ContractError("YEAR_RANGE", "invalid year interval", year_from=low, year_to=high)
    months = request.months
    if months is not None and (not months or len(set(months)) != len(months)
                               or any(type(m) is not int or not 1 <= m <= 12 for m in months)):
        raise ContractError("MONTHS", "use unique months from 1 to 12", months=months)
    ids = request.source_ids
    if ids is not None:
        if not ids or len(set(ids)) != len(ids) or any(not isinstance(i, str) or not i.strip() for i in ids):
            raise ContractError("SOURCES", "use unique non-empty source ids", sources=ids)
        enabled = {s.source_id for s in batch.manifest.sources}
        if set(ids) - enabled:
            raise ContractError("SOURCE", "source is not enabled for this batch", sources=sorted(set(ids) - enabled))
    return Bounds(low, high)


def _scoped(batch: Batch, request: Request, bounds: Bounds, months: bool = True) -> DataFrame:
    """Facts of the batch, sources, years and, unless told otherwise, months."""
    df = batch.fact.filter(F.col("batch_id") == batch.batch_id)
    df = within_years(among(df, "source_id", request.source_ids), "occurrence_year", bounds.year_from, bounds.year_to)
    return in_months(df, request.months) if months else df


def _stamp(df: DataFrame, batch: Batch) -> DataFrame:
    return df.select(F.lit(batch.dataset_kind).alias("dataset_kind"), F.lit(batch.batch_id).alias("batch_id"), "*")


def _measures() -> dict[str, tuple[Column, Column]]:
    fatal_known = F.col("fatal_crash_eligible") & F.col("is_fatal_crash").isNotNull()
    deaths_known = F.col("fatality_eligible") & F.col("fatality_count").isNotNull()
    hurt_known = F.col("casualty_eligible") & F.col("casualty_count").isNotNull()
    return {
        "fatal_crash": (count_where(fatal_known), count_where(fatal_known & F.col("is_fatal_crash"))),
        "fatality": (count_where(deaths_known), sum_where(F.col("fatality_count"), deaths_known)),
        "casualty": (count_where(hurt_known), sum_where(F.col("casualty_count"), hurt_known)),
    }


def trend(batch: Batch, request: Request) -> DataFrame:
    """Dense source x year [x month] rows with stated coverage.

    The fact is aggregated to at most sources x years x 13 rows before anything is joined, so unknown months and period
    values come from the same single pass.
    """
    bounds = validate(batch, request)
    spark = batch.fact.sparkSession
    monthly, months = request.grain == "month", list(request.months or ALL_MONTHS)
    sources = among(batch.sources.filter(F.col("batch_id") == batch.batch_id), "source_id", request.source_ids).select("source_id")
    spine = (month_spine(sources, bounds.year_from, bounds.year_to, months) if monthly
             else year_spine(sources, bounds.year_from, bounds.year_to).withColumn("period_month", F.lit(None).cast("int")))

    covered = coverage_frame(spark, batch.manifest).filter(F.col("covered_year").between(bounds.year_from, bounds.year_to))
    covered = covered.filter(F.col("covered_month").isin(months)).withColumnRenamed("covered_year", "period_year")
    grain = ["source_id", "period_year"]
    if monthly:
        covered, grain = covered.withColumn("period_month", F.col("covered_month")), [*grain, "period_month"]
    coverage = covered.groupBy(*grain).agg(
        F.countDistinct("covered_month").cast("int").alias("covered_month_count"),
        ordered_distinct_text(F.col("basis")).alias("coverage_basis"))

    measures = _measures()
    # One pass: per source, year and month (13th group = unknown month).
    base = (_scoped(batch, request, bounds, months=False)
            .groupBy("source_id", F.col("occurrence_year").alias("period_year"), "month_id")
            .agg(F.count(F.lit(1)).alias("rows"),
                 *[known.alias(f"{m}_known_count") for m, (known, _) in measures.items()],
                 *[value.alias(f"{m}_count") for m, (_, value) in measures.items()]))
    unknown = base.groupBy("source_id", "period_year").agg(
        F.coalesce(F.sum(F.when(F.col("month_id").isNull(), F.col("rows"))), F.lit(0)).alias("unknown_months"))
    used = base if not monthly and request.months is None else base.filter(
        F.col("month_id").isNotNull() & (F.col("month_id") % 100).isin(months))
    if monthly:
        used = used.withColumn("period_month", month_of_id(F.col("month_id")))
    totals = used.groupBy(*grain).agg(
        F.sum("rows").alias("crash_count"),
        F.coalesce(F.sum(F.when(F.col("month_id").isNotNull(), F.col("rows"))), F.lit(0)).alias("month_known_count"),
        *[F.sum(f"{m}_{part}").alias(f"{m}_{part}") for m in measures for part in ("known_count", "count")])

    zero = F.lit(0).cast("bigint")
    joined = spine.join(coverage, grain, "left").join(totals, grain, "left").join(unknown, ["source_id", "period_year"], "left")
    n_covered = F.coalesce("covered_month_count", F.lit(0))
    open_ = n_covered > 0
    requested = 1 if monthly else len(months)
    count = lambda name: F.when(open_, F.coalesce(name, zero))
    excluded = zero if not monthly and request.months is None else F.coalesce("unknown_months", zero)
    out = joined.select(
        "source_id", F.lit(request.grain).alias("grain"), "period_year", "period_month",
        F.when(~open_, "not_covered").when(n_covered == requested, "covered").otherwise("partial").alias("coverage_status"),
        F.lit(requested).alias("requested_month_count"), n_covered.alias("covered_month_count"), "coverage_basis",
        count("crash_count").alias("crash_count"), count("month_known_count").alias("month_known_count"),
        F.when(open_, excluded).alias("excluded_unknown_month_count"),
        *[col for m in measures for col in (
            F.when(open_ & (F.coalesce(f"{m}_known_count", zero) > 0), F.col(f"{m}_count")).alias(f"{m}_count"),
            count(f"{m}_known_count").alias(f"{m}_known_count"))])
    return _stamp(out, batch).orderBy("source_id", "period_year", F.col("period_month").asc_nulls_first())


def severity(batch: Batch, request: Request) -> DataFrame:
    """Populated categories per source and definition. Sources are never pooled."""
    bounds = validate(batch, request)
    keys = ["source_id", "severity_code"]
    counts = _scoped(batch, request, bounds).groupBy("batch_id", *keys).agg(F.count(F.lit(1)).alias("crash_count"))
    months = F.array(*[F.lit(m) for m in request.months]) if request.months else F.lit(None).cast("array<int>")
    out = counts.join(batch.severities, ["batch_id", *keys]).select(
        "source_id", F.lit(bounds.year_from).alias("filter_year_from"), F.lit(bounds.year_to).alias("filter_year_to"),
        months.alias("filter_months"), "definition_version", "severity_code", "severity_label", "definition_text", "crash_count")
    return _stamp(out, batch).orderBy("source_id", "definition_version", "severity_code")


def _mappable() -> Column:
    return F.col("map_eligible") & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()


def map_points(batch: Batch, request: Request, ordered: bool = True) -> DataFrame:
    """One point per eligible crash."""
    bounds = validate(batch, request)
    points = _scoped(batch, request, bounds).filter(_mappable())
    names = batch.sources.select("batch_id", "source_id", "source_name", "jurisdiction_code")
    out = points.join(names, ["batch_id", "source_id"]).select(
        "source_id", "source_name", "jurisdiction_code", "release_scope", "crash_key", "occurrence_year",
        month_of_id(F.col("month_id")).alias("occurrence_month"), "severity_code", "latitude", "longitude")
    out = _stamp(out, batch)
    return out.orderBy("source_id", "release_scope", "crash_key") if ordered else out


def map_coverage(batch: Batch, request: Request) -> DataFrame:
    """Always one row: crashes, points and percentage (NULL without crashes)."""
    bounds = validate(batch, request)
    one = _scoped(batch, request, bounds).agg(
        F.count(F.lit(1)).alias("crash_count"), count_where(_mappable()).alias("point_count"))
    ids = F.array(*[F.lit(i) for i in request.source_ids]) if request.source_ids else F.lit(None).cast("array<string>")
    months = F.array(*[F.lit(m) for m in request.months]) if request.months else F.lit(None).cast("array<int>")
    return _stamp(one.select(
        ids.alias("filter_source_ids"), F.lit(bounds.year_from).alias("filter_year_from"),
        F.lit(bounds.year_to).alias("filter_year_to"), months.alias("filter_months"), "crash_count", "point_count",
        percentage(F.col("point_count"), F.col("crash_count")).alias("coverage_percentage")), batch)


def check_map(points: DataFrame, coverage: DataFrame) -> None:
    """Stated and delivered points must agree."""
    stated, actual = coverage.first()["point_count"], points.count()
    if stated != actual:
        raise ContractError("MAP_POINTS", "coverage and points disagree", stated=stated, actual=actual)


def _eligible_units(batch: Batch, request: Request) -> DataFrame:
    units = batch.unit.filter((F.col("batch_id") == batch.batch_id) & F.col("count_eligible"))
    return among(units, "source_id", request.source_ids)


def unit_counts(batch: Batch, request: Request) -> DataFrame:
    """Eligible units whose parent passes the filters, by source, scope and type.

    Units are counted per parent before the semi join, so a parent with very many units crosses the network as one row per
    type.
    """
    bounds = validate(batch, request)
    per_parent = (_eligible_units(batch, request).groupBy(*PARENT, "statistical_scope", "unit_type_code")
                  .agg(F.count(F.lit(1)).alias("n")))
    parents = _scoped(batch, request, bounds).select(*PARENT)
    return _named_units(batch, per_parent.join(parents, PARENT, "left_semi"))


def unit_counts_by_membership(batch: Batch, request: Request) -> DataFrame:
    """The same report without a join: parents and units stacked, membership seen per parent key.

    Units are already one row per parent and type, so the window never spans more rows than a parent has types.
    """
    from pyspark.sql import Window
    bounds = validate(batch, request)
    per_parent = (_eligible_units(batch, request).groupBy(*PARENT, "statistical_scope", "unit_type_code")
                  .agg(F.count(F.lit(1)).alias("n")).withColumn("parent_row", F.lit(False)))
    parents = _scoped(batch, request, bounds).select(*PARENT).distinct().withColumn("parent_row", F.lit(True))
    stacked = per_parent.unionByName(parents, allowMissingColumns=True)
    member = stacked.withColumn("has_parent", F.bool_or("parent_row").over(Window.partitionBy(*PARENT)))
    return _named_units(batch, member.filter(~F.col("parent_row") & F.col("has_parent")))


def _named_units(batch: Batch, counted: DataFrame) -> DataFrame:
    totals = (counted.groupBy("batch_id", "source_id", "statistical_scope", "unit_type_code")
              .agg(F.sum("n").alias("unit_count")))
    names = batch.sources.select("batch_id", "source_id", "source_name", "jurisdiction_code")
    out = totals.join(names, ["batch_id", "source_id"]).select(
        "source_id", "source_name", "jurisdiction_code", "statistical_scope", "unit_type_code", "unit_count")
    return _stamp(out, batch).orderBy("source_id", "statistical_scope", "unit_type_code")


def batch_sources(batch: Batch, dataset_kind: str) -> DataFrame:
    validate(batch, Request(dataset_kind))
    rows = batch.sources.filter(F.col("batch_id") == batch.batch_id)
    return _stamp(rows.select("source_id", "source_name", "jurisdiction_code", "release_label", "release_scope"),
                  batch).orderBy("source_id")


def batch_years(batch: Batch, dataset_kind: str) -> Bounds:
    validate(batch, Request(dataset_kind))
    return Bounds(batch.manifest.year_from, batch.manifest.year_to)


def source_totals(crash: DataFrame) -> DataFrame:
    """Crashes, fatal crashes, fatalities, casualties and mapped crashes per source."""
    return crash.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("crash_count"),
        count_where(F.col("is_fatal_crash") & F.col("fatal_crash_eligible")).alias("fatal_crash_count"),
        sum_where(F.col("fatality_count"), F.col("fatality_eligible")).alias("fatality_count"),
        sum_where(F.col("casualty_count"), F.col("casualty_eligible")).alias("casualty_count"),
        count_where(F.col("map_eligible")).alias("map_count"))


def bundle(batch: Batch, request: Request) -> dict[str, DataFrame]:
    """All reports of one batch, resolved once, so a release switch in between cannot mix batches."""
    bounds = validate(batch, request)
    if bounds.year_from < batch.manifest.year_from or bounds.year_to > batch.manifest.year_to:
        raise ContractError("YEARS_OUTSIDE_BATCH", "requested years exceed the batch", year_from=bounds.year_from,
                            year_to=bounds.year_to)
    return {"trend": trend(batch, request), "severity": severity(batch, request), "points": map_points(batch, request),
            "coverage": map_coverage(batch, request), "units": unit_counts(batch, request),
            "sources": batch_sources(batch, request.dataset_kind)}


def require_one_batch(frames: dict[str, DataFrame], batch_id: str) -> None:
    for name, df in frames.items():
        if not no_rows(df.filter(~F.col("batch_id").eqNullSafe(F.lit(batch_id)))):
            raise ContractError("MIXED_BATCH", "a report returned rows of another batch", report=name)


REPORTS = {"trend": trend, "severity": severity, "map": map_points, "units": unit_counts}


@dataclass(frozen=True)
class Answer:
    source_id: str
    report: str
    status: str
    reason: str | None
    rows: DataFrame | None


def limited_report(batch: Batch, source_id: str, report: str, request: Request) -> Answer:
    """One source, one report. What the source's policy withholds is stated, never returned as an empty result."""
    if report not in REPORTS:
        raise ContractError("REPORT", "unknown report", report=report)
    only = Request(request.dataset_kind, (source_id,), request.year_from, request.year_to, request.months, request.grain)
    validate(batch, only)
    reason = dict(batch.manifest.source(source_id).unavailable).get(report)
    if reason:
        return Answer(source_id, report, "unavailable", reason, None)
    return Answer(source_id, report, "available", None, REPORTS[report](batch, only))
