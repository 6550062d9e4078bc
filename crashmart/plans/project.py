"""Native records to typed rows, driven by the source contract.

Relationship checks run on the complete snapshot; the analysis years are applied afterwards. Values that cannot be trusted
are withheld with a reason; the row itself always stays.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import CRS, MISSING_CODE, FileSpec, Manifest, Source
from ..errors import ContractError
from ..functions.dates import date_precision, iso_date, month_number, year_token
from ..functions.notes import fields_note, location_note, quality_notes, severity_rule_note
from ..functions.numbers import INT_MAX, SCALE7, count_token, decimal_token, guarded_cast, known_sum, within
from ..functions.text import encode_key, is_blank, missing_token
from ..model import UNIT_SCHEMA, contract_frame
from ..operators import observations as obs
from ..operators.filters import within_years
from ..operators.relations import duplicate_groups, orphans
from ..sources.records import select_file

CATEGORY = "string_token string, category_code string, category_fatal boolean"


@dataclass(frozen=True)
class Projection:
    crash: DataFrame
    unit: DataFrame
    # Observations behind unresolved locations, one row each (None when the source publishes none).
    candidates: DataFrame | None = None


def native(raw: DataFrame, spec: FileSpec, fields: list[str]) -> DataFrame:
    """Selected records with the named payload fields as columns."""
    rows = select_file(raw, spec)
    return rows.select("raw_record_id", "source_id", "file_sha256", "parser_version", "row_locator",
                       *[F.try_element_at("payload", F.lit(f)).alias(col_name(f)) for f in dict.fromkeys(fields)])


def col_name(field: str) -> str:
    """Column holding a native field. The prefix keeps it apart from typed columns, whose names ignore case."""
    return "f:" + field.replace(".", "_")


def col_names(fields: tuple[str, ...]) -> list[str]:
    return [col_name(f) for f in fields]


def c(name: str) -> Column:
    return F.col(col_name(name))


def parent_rows(rows: DataFrame, spec: FileSpec) -> DataFrame:
    """Crash rows renamed to the key columns of a child file."""
    return rows.select(*[c(k).alias(col_name(p)) for k, p in zip(spec.parent_crash_fields, spec.parent_fields)])


def token(source: Source, name: str) -> Column:
    return missing_token(c(name), source.empty_is_missing)


def crash_fields(source: Source) -> list[str]:
    spec, d, n, loc = source.file("crash"), source.dates, source.counts, source.location
    found = [*spec.key_fields, d.year_field, source.severity.field, n.fatality_field, *n.part_fields,
             *loc.crash_key, loc.latitude_field if loc.style == "own" else "",
             loc.longitude_field if loc.style == "own" else ""]
    return [f for f in [*found, d.month_field or "", n.total_field or "",
                        source.units.declared_field or "" if source.units else ""] if f]


def crash_rows(raw: DataFrame, source: Source) -> DataFrame:
    return native(raw, source.file("crash"), crash_fields(source))


def unit_rows(raw: DataFrame, source: Source) -> DataFrame:
    spec = source.file("unit")
    return native(raw, spec, [*spec.key_fields, *spec.parent_fields, source.units.type_field])


def year_of(source: Source) -> Column:
    d = source.dates
    if d.style == "date":
        year = F.year(iso_date(c(d.year_field)))
        return F.when(year.between(d.year_min, d.year_max), year)
    return year_token(c(d.year_field), d.year_pattern, d.year_min, d.year_max)


def month_of(source: Source) -> Column:
    d = source.dates
    if d.style == "date":
        return F.month(iso_date(c(d.year_field)))
    if d.style == "month_name":
        return month_number(token(source, d.month_field))
    month = guarded_cast(token(source, d.month_field), r"\A[0-9]{1,2}\z", "int")
    return F.when(month.between(1, 12), month)


def counts_of(source: Source) -> tuple[Column, Column, Column]:
    """(fatalities, casualties, all parts) as bigint before the int32 check."""
    n = source.counts
    killed = count_token(token(source, n.fatality_field))
    parts = known_sum(*[count_token(token(source, f)) for f in n.part_fields]) if n.part_fields else F.lit(None).cast("bigint")
    if n.total == "sum":
        return killed, parts, parts
    declared = count_token(token(source, n.total_field)).cast("bigint")
    return killed, F.when(parts.isNotNull(), declared) if n.total == "declared_with_parts" else declared, parts


# ---------------------------------------------------------------------------------------------------------------- gates

def relationship_counts(raw: DataFrame, source: Source) -> DataFrame:
    """One row: blank keys, duplicate keys and orphans over the complete snapshot."""
    spec = source.file("crash")
    crash = crash_rows(raw, source)
    blank = reduce(lambda a, b: a | b, [is_blank(c(k)) for k in spec.key_fields])
    usable = crash.filter(~blank)
    out = crash.agg(F.count_if(blank).alias("crash_blank_key_count"))
    out = out.crossJoin(duplicate_groups(usable, col_names(spec.key_fields)).agg(F.count(F.lit(1)).alias("crash_duplicate_key_count")))
    if not source.has("unit"):
        return out
    us = source.file("unit")
    unit = unit_rows(raw, source)
    unit_blank = reduce(lambda a, b: a | b, [is_blank(c(k)) for k in us.key_fields])
    parented = unit.filter(~reduce(lambda a, b: a | b, [is_blank(c(k)) for k in us.parent_fields]))
    parents = parent_rows(crash, us)
    # One-row frames side by side.
    return (out
            .crossJoin(unit.agg(F.count_if(unit_blank).alias("unit_blank_key_count")))
            .crossJoin(duplicate_groups(unit.filter(~unit_blank), col_names(us.key_fields))
                       .agg(F.count(F.lit(1)).alias("unit_duplicate_key_count")))
            .crossJoin(orphans(parented, parents, col_names(us.parent_fields))
                       .agg(F.coalesce(F.sum("n"), F.lit(0).cast("bigint")).alias("orphan_unit_count"))))


def value_counts(raw: DataFrame, source: Source) -> DataFrame:
    """One row of bad-token counts over the complete snapshot, in a single pass."""
    rows, d, n = crash_rows(raw, source), source.dates, source.counts
    severity = token(source, source.severity.field)
    declared = [t for t, _ in source.severity.categories]
    killed, total, parts = counts_of(source)
    fields = list(dict.fromkeys([n.fatality_field, *n.part_fields, *([n.total_field] if n.total_field else [])]))
    bad = lambda f: token(source, f).isNotNull() & count_token(token(source, f)).isNull()
    month_bad = F.lit(False)
    if d.style != "date":
        month_bad = (token(source, d.month_field).isNotNull() | F.lit(d.month_required)) & month_of(source).isNull()
    mismatch = (count_token(token(source, n.total_field)) != parts) if n.total == "declared_with_parts" else F.lit(False)
    within = (killed > total) if n.fatality_within_total else F.lit(False)
    where = lambda test: F.count_if(F.coalesce(test, F.lit(False)))
    return rows.agg(
        where(year_of(source).isNull()).alias("invalid_year_count"),
        where(month_bad).alias("invalid_month_count"),
        where(severity.isNotNull() & ~severity.isin(declared)).alias("undefined_category_count"),
        where(reduce(lambda a, b: a | b, [bad(f) for f in fields])).alias("invalid_count_token_count"),
        where(parts > INT_MAX).alias("count_overflow_count"),
        where(mismatch).alias("component_total_mismatch_count"),
        where(within).alias("fatality_above_total_count"))


def unit_type_counts(raw: DataFrame, source: Source) -> DataFrame:
    """One row: units of undeclared type and bad declared unit counts."""
    kind = token(source, source.units.type_field)
    bad = unit_rows(raw, source).agg(
        F.count_if(F.coalesce(kind.isNotNull() & ~kind.isin([t for t, _ in source.units.types]), F.lit(False)))
        .alias("undefined_unit_type_count"))
    if not source.units.declared_field:
        return bad
    declared = token(source, source.units.declared_field)
    return bad.crossJoin(crash_rows(raw, source).agg(
        F.count_if(declared.isNotNull() & count_token(declared).isNull()).alias("invalid_declared_unit_count")))


def require_zero(counts: DataFrame, code: str, **details: object) -> dict[str, int]:
    """Act on a one-row count frame: any non-zero count is an error that lists all of them."""
    row = counts.first().asDict()
    wrong = {k: v for k, v in row.items() if v}
    if wrong:
        raise ContractError(code, "the snapshot breaks its contract", **wrong, **details)
    return row


def check_source(raw: DataFrame, source: Source) -> None:
    """All gates of one source. Run before projecting when a bad snapshot must stop the build."""
    require_zero(relationship_counts(raw, source), "RELATIONSHIPS", source_id=source.source_id)
    require_zero(value_counts(raw, source), "VALUES", source_id=source.source_id)
    if source.units:
        require_zero(unit_type_counts(raw, source), "UNIT_TYPES", source_id=source.source_id)


# ----------------------------------------------------------------------------------------------------------- projection

def _classified(rows: DataFrame, source: Source) -> DataFrame:
    """Adds category_code and category_fatal; an absent token takes the declared override, if any."""
    rule = source.severity
    table = contract_frame(rows.sparkSession, [(t, k.code, k.fatal) for t, k in rule.categories], CATEGORY)
    out = (rows.withColumn("__token", token(source, rule.field))
           .join(table, F.col("__token") == F.col("string_token"), "left").drop("string_token"))
    if rule.missing_override is None:
        return out
    absent, o = F.col("__token").isNull(), rule.missing_override
    return (out.withColumn("category_code", F.when(absent, F.lit(o.code)).otherwise(F.col("category_code")))
            .withColumn("category_fatal", F.when(absent, F.lit(o.fatal).cast("boolean")).otherwise(F.col("category_fatal"))))


def project_crash(raw: DataFrame, source: Source, batch_id: str, year_from: int, year_to: int) -> tuple[DataFrame, DataFrame | None]:
    """The 24-column crash frame of the analysis years, and the candidates of unresolved observation groups."""
    spec, n, loc = source.file("crash"), source.counts, source.location
    killed, total, _ = counts_of(source)
    month = month_of(source)
    day = iso_date(c(source.dates.year_field)) if source.dates.style == "date" else F.lit(None).cast("date")
    typed = within_years(crash_rows(raw, source).withColumn("year", year_of(source)), "year", year_from, year_to)
    typed = (_classified(typed, source)
             .withColumn("month", month).withColumn("day", day)
             .withColumn("killed", killed).withColumn("total", total.cast("int")))
    found = None
    enabled = loc.crs == CRS and not source.restricted
    if loc.style == "observations":
        keys = ["__parent", "__place"]
        observed = native(raw, source.file("node_raw"), [*loc.observation_key, loc.latitude_field, loc.longitude_field])
        observed = observed.withColumn("__parent", c(loc.observation_key[0])).withColumn("__place", c(loc.observation_key[1]))
        resolved = obs.resolve(observed, keys, col_name(loc.latitude_field), col_name(loc.longitude_field), enabled)
        typed = typed.withColumn("__parent", c(loc.crash_key[0])).withColumn("__place", c(loc.crash_key[1]))
        typed = obs.locate(typed, resolved, keys)
        found = obs.candidates(typed, observed, keys)
        own = F.lit(None).cast("array<string>")
    else:
        typed = _own_location(typed, source, enabled)
        own = F.array("raw_record_id")
    category = F.col("category_code")
    reasons = fields_note([
        ("fatal_crash_eligible", category.isNull(), c(source.severity.field), "missing"),
        ("fatality_count", F.col("killed").isNull(), c(n.fatality_field), "missing"),
        ("casualty_count", F.col("total").isNull(),
         c(n.total_field) if n.total == "declared" else F.lit(None), "missing"),
    ], source.contract_version)
    where = F.when(~F.col("map_eligible"), location_note(F.col("reason_code"), own, F.col("resolution"), loc.evidence_ref))
    rule = None
    if source.severity.missing_override is not None:
        rule = F.when(F.col("__token").isNull(), severity_rule_note(
            source.severity.missing_override.code, source.severity.missing_reason, source.severity.version))
    crash = typed.select(
        F.lit(batch_id).alias("batch_id"), "source_id", F.lit(source.release_scope).alias("release_scope"),
        encode_key(*[c(k) for k in spec.key_fields]).alias("crash_key"), "raw_record_id",
        F.col("year").cast("int").alias("occurrence_year"), F.col("month").cast("int").alias("occurrence_month"),
        F.col("day").alias("occurrence_date"), date_precision(F.col("month"), F.col("day")).alias("date_precision"),
        c(source.severity.field).alias("severity_raw"), F.coalesce(category, F.lit(MISSING_CODE)).alias("severity_code"),
        F.lit(source.severity.version).alias("severity_definition_version"),
        F.col("category_fatal").alias("is_fatal_crash"), F.col("killed").alias("fatality_count"),
        F.col("total").alias("casualty_count"),
        category.isNotNull().alias("fatal_crash_eligible"),
        F.col("killed").isNotNull().alias("fatality_eligible"), F.col("total").isNotNull().alias("casualty_eligible"),
        "latitude", "longitude", F.when(F.col("map_eligible"), F.lit(CRS)).alias("location_crs"), "map_eligible",
        "location_record_id", quality_notes(reasons, where, rule).alias("quality_notes"))
    return crash, found


def _own_location(rows: DataFrame, source: Source, enabled: bool) -> DataFrame:
    loc = source.location
    if loc.style == "none":
        return (rows.withColumn("map_eligible", F.lit(False)).withColumn("reason_code", F.lit("no_location"))
                .withColumn("resolution", F.lit("source_publishes_no_location"))
                .withColumn("latitude", F.lit(None).cast(SCALE7)).withColumn("longitude", F.lit(None).cast(SCALE7))
                .withColumn("location_record_id", F.lit(None).cast("string")))
    lat, lon = decimal_token(c(loc.latitude_field)), decimal_token(c(loc.longitude_field))
    usable = F.lit(enabled) & F.coalesce(within(c(loc.latitude_field), 90) & within(c(loc.longitude_field), 180), F.lit(False))
    empty = lambda f: c(f).isNull() | (c(f) == "")
    reason = (F.when(F.lit(not enabled), loc.unconfirmed_reason)
              .when(empty(loc.latitude_field) | empty(loc.longitude_field), "missing").otherwise("invalid_coordinate"))
    return (rows.withColumn("map_eligible", usable).withColumn("reason_code", reason)
            .withColumn("resolution", F.lit("coordinates_withheld_row_kept"))
            .withColumn("latitude", F.when(usable, lat.cast(SCALE7))).withColumn("longitude", F.when(usable, lon.cast(SCALE7)))
            .withColumn("location_record_id", F.when(usable, F.col("raw_record_id"))))


def project_unit(raw: DataFrame, source: Source, batch_id: str, year_from: int, year_to: int) -> DataFrame:
    """The 11-column unit frame: units whose parent lies in the analysis years. Empty where no unit file exists."""
    spark = raw.sparkSession
    if not source.has("unit"):
        return spark.createDataFrame([], UNIT_SCHEMA)
    spec, rule = source.file("unit"), source.units
    parents = within_years(native(raw, source.file("crash"), [*spec.parent_crash_fields, source.dates.year_field])
                           .withColumn("year", year_of(source)), "year", year_from, year_to)
    parents = parent_rows(parents, spec)
    # Only the parent's existence matters, so the join keeps each unit once even if a parent key repeats.
    units = unit_rows(raw, source).join(parents, col_names(spec.parent_fields), "left_semi")
    kind = token(source, rule.type_field)
    types = contract_frame(spark, list(rule.types), "native_type string, type_code string")
    units = units.withColumn("__kind", kind).join(types, F.col("__kind") == F.col("native_type"), "left")
    eligible = F.col("type_code").isNotNull() & F.lit(not rule.restricted)
    note = fields_note([("count_eligible" if rule.restricted else rule.note_field, ~eligible, c(rule.type_field),
                         "definition_unconfirmed" if rule.restricted else "missing")], source.contract_version)
    return units.select(
        F.lit(batch_id).alias("batch_id"), "source_id", F.lit(source.release_scope).alias("release_scope"),
        encode_key(*[c(k) for k in spec.key_fields]).alias("unit_key"),
        encode_key(*[c(k) for k in spec.parent_fields]).alias("crash_key"), "raw_record_id",
        c(rule.type_field).alias("unit_type_raw"), F.col("type_code").alias("unit_type_code"),
        F.lit(rule.statistical_scope).alias("statistical_scope"), eligible.alias("count_eligible"),
        quality_notes(note).alias("quality_notes"))


def project_source(raw: DataFrame, source: Source, batch_id: str, year_from: int, year_to: int) -> Projection:
    crash, found = project_crash(raw, source, batch_id, year_from, year_to)
    return Projection(crash, project_unit(raw, source, batch_id, year_from, year_to), found)


def project_all(raw: DataFrame, manifest: Manifest, batch_id: str) -> Projection:
    """One projection per selected source, stacked. The manifest has already been checked for repeats and owners."""
    manifest.validate()
    parts = [project_source(raw, s, batch_id, manifest.year_from, manifest.year_to) for s in manifest.sources]
    found = [p.candidates.withColumns({"batch_id": F.lit(batch_id), "source_id": F.lit(s.source_id), "release_scope": F.lit(s.release_scope)})
             for p, s in zip(parts, manifest.sources, strict=True) if p.candidates is not None]
    return Projection(reduce(DataFrame.unionByName, [p.crash for p in parts]),
                      reduce(DataFrame.unionByName, [p.unit for p in parts]),
                      reduce(DataFrame.unionByName, found) if found else None)


def projection_counts(crash: DataFrame, unit: DataFrame) -> DataFrame:
    """Eleven self-check counts of a projection in one row."""
    keys = ["batch_id", "source_id", "release_scope"]
    zero = F.lit(0).cast("bigint")
    c_part = crash.agg(
        F.count(F.lit(1)).alias("crash_count"),
        F.count_if(F.col("is_fatal_crash") & F.col("fatal_crash_eligible")).alias("fatal_crash_count"),
        F.sum(F.when(F.col("fatality_eligible"), F.col("fatality_count").cast("bigint"))).alias("fatality_count"),
        F.sum(F.when(F.col("casualty_eligible"), F.col("casualty_count").cast("bigint"))).alias("casualty_count"),
        F.count_if("map_eligible").alias("map_count"))
    u_part = unit.agg(
        F.count(F.lit(1)).alias("unit_count"),
        F.count_if(F.col("unit_type_code").isNull()).alias("missing_type_count"),
        F.count_if(F.col("count_eligible") & F.col("unit_type_code").isNull()).alias("eligible_without_type_count"))
    return (c_part.crossJoin(u_part)
            .crossJoin(duplicate_groups(crash, [*keys, "crash_key"]).agg(F.count(F.lit(1)).alias("duplicate_crash_key_count")))
            .crossJoin(duplicate_groups(unit, [*keys, "unit_key"]).agg(F.count(F.lit(1)).alias("duplicate_unit_key_count")))
            .crossJoin(orphans(unit, crash, [*keys, "crash_key"]).agg(F.coalesce(F.sum("n"), zero).alias("orphan_unit_count"))))
