"""Second derivation of the typed rows, used only to check the first.

It is written as SQL text over the payload so that a mistake in the Column code of the projection is not repeated here. Only
contract values are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..contracts import CRS, MISSING_CODE, Source
from ..functions.dates import MONTHS
from ..model import contract_frame
from ..session import materialize
from ..sources.records import select_file

CRASH_FIELDS = ["crash_key", "occurrence_year", "occurrence_month", "occurrence_date", "date_precision", "severity_raw",
                "severity_code", "is_fatal_crash", "fatality_count", "casualty_count", "fatal_crash_eligible",
                "fatality_eligible", "casualty_eligible"]
LOCATION_FIELDS = ["map_eligible", "latitude", "longitude", "location_crs", "location_record_id"]
NOTE_FIELDS = ["location_note", "field_notes", "rule_note"]
UNIT_FIELDS = ["unit_key", "crash_key", "unit_type_raw", "unit_type_code", "statistical_scope", "count_eligible"]


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _raw(field: str) -> str:
    return f"payload[{_q(field)}]"


def _tok(source: Source, field: str) -> str:
    return f"nullif({_raw(field)}, '')" if source.empty_is_missing else _raw(field)


def _num(source: Source, field: str) -> str:
    t = _tok(source, field)
    return f"if({t} regexp '\\\\A[0-9]+\\\\z', try_cast({t} as int), null)"


def _key(fields: tuple[str, ...]) -> str:
    return "to_json(array(" + ", ".join(_raw(f) for f in fields) + "))"


# A number as text: sign, digits before and after the point, power of ten.
_NUMBER = r"r'\A\s*[+-]?([0-9]+([.][0-9]*)?|[.][0-9]+)([eE][+-]?[0-9]{1,30})?\s*\z'"
_SPLIT = r"r'\A\s*([+-]?)([0-9]*)[.]?([0-9]*)(?:[eE]([+-]?[0-9]+))?\s*\z'"


def _part(t: str, i: int) -> str:
    return f"regexp_extract({t}, {_SPLIT}, {i})"


def _significant(t: str) -> str:
    return f"trim(both '0' from concat({_part(t, 2)}, {_part(t, 3)}))"


def _inside(t: str, limit: int) -> str:
    """At the limit itself a double cannot tell the sides apart; there the digits decide."""
    size = f"abs(try_cast({t} as double))"
    return f"({t} regexp {_NUMBER} and ({size} < {limit} or ({size} = {limit} and {_significant(t)} <= '{str(limit).rstrip('0')}')))"


def _canonical(t: str) -> str:
    """Sign, digits without outer zeros, and the power of ten behind the last of them."""
    trailing = f"length(concat({_part(t, 2)}, {_part(t, 3)})) - length(trim(trailing '0' from concat({_part(t, 2)}, {_part(t, 3)})))"
    power = f"coalesce(try_cast({_part(t, 4)} as decimal(38,0)), 0) - length({_part(t, 3)}) + {trailing}"
    return f"if({_significant(t)} = '', '0', concat_ws(' ', replace({_part(t, 1)}, '+', ''), {_significant(t)}, {power}))"


def _blank(t: str) -> str:
    return f"coalesce({t}, '') = ''"


def _seven(t: str) -> str:
    return f"cast(try_cast({t} as decimal(38,34)) as decimal(10,7))"


def _own_place(source: Source) -> list[str]:
    """Location columns of a record that carries its coordinates itself."""
    loc = source.location
    if loc.style == "none":
        return ["false as map_eligible", "cast(null as decimal(10,7)) as latitude", "cast(null as decimal(10,7)) as longitude",
                "cast(null as string) as location_record_id", "'no_location/source_publishes_no_location' as location_note"]
    la, lo = _raw(loc.latitude_field), _raw(loc.longitude_field)
    open_ = loc.crs == CRS and not source.restricted
    good = f"coalesce({_inside(la, 90)} and {_inside(lo, 180)}, false)" if open_ else "false"
    why = f"if({_blank(la)} or {_blank(lo)}, 'missing', 'invalid_coordinate')" if open_ else _q(loc.unconfirmed_reason)
    return [f"{good} as map_eligible", f"if({good}, {_seven(la)}, null) as latitude", f"if({good}, {_seven(lo)}, null) as longitude",
            f"if({good}, raw_record_id, null) as location_record_id", f"if({good}, null, concat({why}, '/coordinates_withheld_row_kept')) as location_note"]


def expected_places(raw: DataFrame, source: Source) -> DataFrame:
    """One row for each observed place (place_key): its location columns, from the least and the greatest form of either coordinate. Places
    whose least and greatest forms are equal have one pair; no list of pairs is made."""
    loc = source.location
    la, lo = _raw(loc.latitude_field), _raw(loc.longitude_field)
    defect = (f"case when not {_blank(la)} and not {la} regexp {_NUMBER} or not {_blank(lo)} and not {lo} regexp {_NUMBER} then 'invalid_coordinate_token' "
              f"when {_blank(la)} or {_blank(lo)} then 'incomplete_coordinate_observation' when not {_inside(la, 90)} then 'latitude_out_of_range' "
              f"when not {_inside(lo, 180)} then 'longitude_out_of_range' end")
    place = r"cast(regexp_extract(row_locator, r'([0-9]+)\z', 1) as decimal(38,0))"
    seen = select_file(raw, source.file("node_raw")).selectExpr(
        f"{_key(loc.observation_key)} as place_key", f"struct(file_sha256, parser_version, {place} as position, raw_record_id) as at", f"{defect} as defect",
        f"{_canonical(la)} as la", f"{_canonical(lo)} as lo", f"{_seven(la)} as latitude", f"{_seven(lo)} as longitude")
    groups = seen.groupBy("place_key").agg(
        F.expr("min(struct(at, defect)) filter (where defect is not null)").alias("bad"), F.expr("min(at)").alias("first"),
        F.expr("(min(la) <> max(la)) or (min(lo) <> max(lo))").alias("torn"), F.min("latitude").alias("lat7"), F.min("longitude").alias("lon7"))
    open_ = "true" if loc.crs == CRS and not source.restricted else "false"
    return groups.selectExpr(
        "place_key", f"bad is null and not torn and {open_} as good", "lat7", "lon7", "first.raw_record_id as first_id",
        "case when bad is not null then concat('invalid_coordinate/', bad.defect) when torn then 'location_conflict/conflicting_coordinate_observations' "
        f"when not {open_} then 'crs_unconfirmed/coordinates_agree_but_crs_is_unconfirmed' end as note")


def _with_places(rows: DataFrame, raw: DataFrame, source: Source) -> DataFrame:
    places = materialize(expected_places(raw, source), "expected_places")      # written first, so that a place of very many crashes splits
    return rows.join(places, "place_key", "left").selectExpr(
        "*", "coalesce(good, false) as map_eligible", "if(good, lat7, null) as latitude", "if(good, lon7, null) as longitude",
        "if(good, first_id, null) as location_record_id", "if(good is null, 'no_location/no_matching_observation', note) as location_note")


def stored_details(crash: DataFrame) -> DataFrame:
    """Typed crashes with their notes in the text forms that the second derivation gives."""
    return crash.selectExpr(
        "*", "concat(quality_notes.location.reason_code, '/', quality_notes.location.resolution) as location_note",
        "array_join(transform(quality_notes.fields, x -> concat_ws('/', x.field, x.reason_code, coalesce(x.raw_token, ''), x.contract_version)), ' ') as field_notes",
        "concat_ws('/', quality_notes.severity_rule.code, quality_notes.severity_rule.reason, quality_notes.severity_rule.mapping_version) as rule_note")


def expected_crash(raw: DataFrame, source: Source, year_from: int, year_to: int) -> DataFrame:
    """raw_record_id, release_scope and the comparable crash fields of the analysis years: values, location, and notes with their reasons."""
    d, n, s = source.dates, source.counts, source.severity
    if d.style == "date":
        t = _raw(d.year_field)
        day = f"if({t} regexp '\\\\A[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}\\\\z', try_cast({t} as date), null)"
        year, month = f"year({day})", f"month({day})"
    else:
        day, t = "cast(null as date)", _raw(d.year_field)
        year = f"if({t} regexp {_q(d.year_pattern)}, try_cast({t} as int), null)"
        m = _tok(source, d.month_field)
        if d.style == "month_name":
            names = " ".join(f"when {_q(name)} then {i}" for i, name in enumerate(MONTHS, 1))
            month = f"case trim({m}) {names} end"
        else:
            month = f"if({m} regexp '\\\\A[0-9]{{1,2}}\\\\z', try_cast({m} as int), null)"
    parts = " + ".join(f"cast({_num(source, f)} as bigint)" for f in n.part_fields) or "cast(null as bigint)"
    if n.total == "sum":
        total = parts
    elif n.total == "declared":
        total = _num(source, n.total_field)
    else:
        total = f"if(({parts}) is null, null, {_num(source, n.total_field)})"
    tok = _tok(source, s.field)
    table = contract_frame(raw.sparkSession, [(t, k.code, k.fatal) for t, k in s.categories],
                           "token string, code string, fatal boolean")
    o = s.missing_override
    rows = select_file(raw, source.file("crash")).selectExpr(
        "raw_record_id", f"{_key(source.file('crash').key_fields)} as crash_key", f"cast({year} as int) as occurrence_year",
        f"cast({month} as int) as occurrence_month", f"{day} as occurrence_date", f"{_raw(s.field)} as severity_raw",
        f"{tok} as token", f"{_num(source, n.fatality_field)} as fatality_count", f"cast({total} as int) as casualty_count",
        f"{_raw(n.fatality_field)} as killed_text", f"{_raw(n.total_field) if n.total == 'declared' else 'cast(null as string)'} as total_text",
        *([f"{_key(source.location.crash_key)} as place_key"] if source.location.style == "observations" else _own_place(source)))
    rows = rows.where(f"occurrence_year between {year_from} and {year_to}").join(table, "token", "left")
    if source.location.style == "observations":
        rows = _with_places(rows, raw, source)
    code = "code" if o is None else f"if(token is null, {_q(o.code)}, code)"
    fatal = "fatal" if o is None else f"if(token is null, {'null' if o.fatal is None else str(o.fatal).lower()}, fatal)"
    return rows.selectExpr(
        "raw_record_id", "crash_key", "occurrence_year", "occurrence_month", "occurrence_date",
        "case when occurrence_month is null then 'year' when occurrence_date is null then 'month' else 'day' end as date_precision",
        "severity_raw", f"coalesce({code}, '{MISSING_CODE}') as severity_code", f"{fatal} as is_fatal_crash",
        "fatality_count", "casualty_count", f"({code}) is not null as fatal_crash_eligible",
        "fatality_count is not null as fatality_eligible", "casualty_count is not null as casualty_eligible",
        f"{_q(source.release_scope)} as release_scope", "map_eligible", "latitude", "longitude", f"if(map_eligible, '{CRS}', null) as location_crs",
        "location_record_id", "location_note", f"{_notes(source, code)} as field_notes", f"{_rule(o, s)} as rule_note")


def _notes(source: Source, code: str) -> str:
    """Fields without a usable value, each with its reason and the text it had; NULL when there are none."""
    entries = [("fatal_crash_eligible", f"({code}) is null", "severity_raw"), ("fatality_count", "fatality_count is null", "killed_text"),
               ("casualty_count", "casualty_count is null", "total_text")]
    found = ", ".join(f"if({when}, concat_ws('/', {_q(field)}, 'missing', coalesce({text}, ''), {_q(source.contract_version)}), null)" for field, when, text in entries)
    return f"nullif(concat_ws(' ', {found}), '')"


def _rule(override, severity) -> str:
    if override is None:
        return "''"
    return f"if(token is null, concat_ws('/', {_q(override.code)}, {_q(severity.missing_reason)}, {_q(severity.version)}), '')"


def expected_unit(raw: DataFrame, source: Source, crash: DataFrame) -> DataFrame:
    """Units of the expected crashes."""
    spec, rule = source.file("unit"), source.units
    table = contract_frame(raw.sparkSession, list(rule.types), "token string, unit_type_code string")
    units = select_file(raw, spec).selectExpr(
        "raw_record_id", f"{_key(spec.key_fields)} as unit_key", f"{_key(spec.parent_fields)} as crash_key",
        f"{_raw(rule.type_field)} as unit_type_raw", f"{_tok(source, rule.type_field)} as token")
    units = units.join(table, "token", "left").join(crash.select("crash_key").distinct(), "crash_key", "left_semi")
    return units.select("raw_record_id", "unit_key", "crash_key", "unit_type_raw", "unit_type_code",
                        F.lit(rule.statistical_scope).alias("statistical_scope"),
                        (F.col("unit_type_code").isNotNull() & F.lit(not rule.restricted)).alias("count_eligible"))


def semantic_errors(raw: DataFrame, source: Source) -> DataFrame:
    """Records whose category token has no declared meaning, over the complete snapshot."""
    declared = ", ".join(_q(t) for t, _ in source.severity.categories)
    tok = _tok(source, source.severity.field)
    found = select_file(raw, source.file("crash")).where(f"{tok} is not null and {tok} not in ({declared})").selectExpr(
        "raw_record_id", "resource_id", f"{tok} as token")
    if not source.units:
        return found
    kinds = ", ".join(_q(t) for t, _ in source.units.types)
    kind = _tok(source, source.units.type_field)
    return found.unionByName(select_file(raw, source.file("unit")).where(
        f"{kind} is not null and {kind} not in ({kinds})").selectExpr("raw_record_id", "resource_id", f"{kind} as token"))
