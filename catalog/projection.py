"""Projection, vault and warehouse queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crashmart.model import UNIT_ID, file_frame
from crashmart.operators import observations as obs
from crashmart.plans import project as P, registry as G, vault as V, warehouse as W
from crashmart.sources import inventory, records

from . import tables as t
from .registry import query


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


@query("projected_crash", t.SQL_BASE + """SELECT source_id, crash_key, y AS occurrence_year, m AS occurrence_month, d AS occurrence_date,
 CASE WHEN m IS NULL THEN 'year' WHEN d IS NULL THEN 'month' ELSE 'day' END AS date_precision,
 CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN '' ELSE o_orderpriority END AS severity_raw, sev AS severity_code,
 fatal AS is_fatal_crash, deaths AS fatality_count, hurt AS casualty_count, fatal IS NOT NULL AS fatal_crash_eligible,
 deaths IS NOT NULL AS fatality_eligible, hurt IS NOT NULL AS casualty_eligible, lat AS latitude, lon AS longitude,
 mapped AS map_eligible, CASE WHEN mapped THEN 'EPSG:4326' END AS location_crs, reason AS location_reason
 FROM crash WHERE y BETWEEN 1995 AND 2001""")
def projected_crash(spark, sf):
    """The typed crash rows of all five sources, from native text."""
    df = t.crash(spark, sf)
    return df.select(
        "source_id", "crash_key", "occurrence_year", "occurrence_month", F.date_format("occurrence_date", "yyyy-MM-dd").alias("occurrence_date"),
        "date_precision", "severity_raw", "severity_code", "is_fatal_crash", "fatality_count", "casualty_count", "fatal_crash_eligible",
        "fatality_eligible", "casualty_eligible", F.col("latitude").cast("double").alias("latitude"),
        F.col("longitude").cast("double").alias("longitude"), "map_eligible", "location_crs",
        F.col("quality_notes.location.reason_code").alias("location_reason"))


@query("projected_unit", t.SQL_BASE + """SELECT source_id, unit_key, crash_key, kind_raw AS unit_type_raw, kind AS unit_type_code,
 scope AS statistical_scope, kind IS NOT NULL AS count_eligible, CASE WHEN kind IS NULL THEN 'missing' END AS note_reason
 FROM unit WHERE y BETWEEN 1995 AND 2001""")
def projected_unit(spark, sf):
    note = F.try_element_at("quality_notes.fields", F.lit(1))
    return t.unit(spark, sf).select("source_id", "unit_key", "crash_key", "unit_type_raw", "unit_type_code", "statistical_scope",
                                    "count_eligible", note["reason_code"].alias("note_reason"))


@query("reason_notes", t.SQL_BASE + """SELECT source_id, crash_key, field, 'missing' AS reason_code, token AS raw_token, 'v1' AS contract_version FROM (
 SELECT source_id, crash_key, 'fatal_crash_eligible' AS field, '' AS token FROM crash WHERE fatal IS NULL UNION ALL
 SELECT source_id, crash_key, 'fatality_count', '' FROM crash WHERE deaths IS NULL UNION ALL
 SELECT source_id, crash_key, 'casualty_count', CASE WHEN source_id = 'europe' THEN '' END FROM crash WHERE hurt IS NULL)""")
def reason_notes(spark, sf):
    """Every stored reason for a missing measure, one row each."""
    df = t.crash(spark, sf).select("source_id", "crash_key", F.explode("quality_notes.fields").alias("n"))
    return df.select("source_id", "crash_key", "n.field", "n.reason_code", "n.raw_token", "n.contract_version")


@query("severity_override", t.SQL_BASE + """SELECT source_id, '5-LOW' AS rule_code, 'severity-v1' AS mapping_version, count(*) AS crash_count
 FROM crash WHERE source_id = 'europe' AND o_orderpriority = '4-NOT SPECIFIED' GROUP BY ALL""")
def severity_override(spark, sf):
    """Rows whose absent category took the meaning their source declares."""
    rule = F.col("quality_notes.severity_rule")
    return (t.crash(spark, sf).filter(rule.isNotNull()).groupBy("source_id", rule["code"].alias("rule_code"), rule["mapping_version"].alias("mapping_version"))
            .agg(F.count(F.lit(1)).alias("crash_count")))


def _observations(spark, sf) -> DataFrame:
    spec = t.manifest().source("america").file("node_raw")
    pick = lambda f: F.try_element_at("payload", F.lit(f))
    return records.select_file(t.raw(spark, sf), spec).select(
        "raw_record_id", "file_sha256", "parser_version", "row_locator", pick("ACC_NO").alias("acc"), pick("NODE_ID").alias("node"),
        pick("LATITUDE").alias("lat_text"), pick("LONGITUDE").alias("lon_text"))


@query("observation_resolver", t.SQL_BASE + """SELECT CAST(k AS VARCHAR) AS acc, observations AS observation_count,
 CASE WHEN bad THEN 0 ELSE pairs END AS coordinate_pair_count,
 CASE WHEN NOT bad AND pairs = 1 THEN CAST(la AS DOUBLE) END AS latitude, CASE WHEN NOT bad AND pairs = 1 THEN CAST(lo AS DOUBLE) END AS longitude,
 NOT bad AND pairs = 1 AS map_eligible, CASE WHEN bad THEN 'invalid_coordinate' WHEN pairs > 1 THEN 'location_conflict' ELSE '' END AS reason_code
 FROM node""")
def observation_resolver(spark, sf):
    """One decision per observation group: any bad row, conflicting pairs, or an agreed pair."""
    r = obs.resolve(_observations(spark, sf), ["acc", "node"], "lat_text", "lon_text", True)
    return r.select("acc", "observation_count", "coordinate_pair_count", F.col("latitude").cast("double").alias("latitude"),
                    F.col("longitude").cast("double").alias("longitude"), "map_eligible", "reason_code")


@query("observation_first_defect", t.SQL_BASE + """, cls AS (SELECT *, CASE WHEN la NOT BETWEEN -90 AND 90 THEN 'latitude_out_of_range'
   WHEN lo NOT BETWEEN -180 AND 180 THEN 'longitude_out_of_range' END AS defect FROM (
   SELECT l_orderkey AS k, l_linenumber AS ln, CAST((l_suppkey % 200 - 95) || '.5' AS DECIMAL(18,4)) AS la,
   CAST((l_linenumber * 60 - 200) || '.25' AS DECIMAL(18,4)) AS lo FROM lineitem JOIN base ON l_orderkey = o_orderkey
   WHERE source_id = 'america' AND l_returnflag = 'A')),
 g AS (SELECT k, min(ln) FILTER (WHERE defect IS NOT NULL) AS first_ln FROM cls GROUP BY k)
 SELECT 'latitude_or_longitude' AS kind, count(*) AS group_count FROM g WHERE first_ln IS NOT NULL""")
def observation_first_defect(spark, sf):
    """Groups decided by a defect; the defect named is the one of the lowest position."""
    r = obs.resolve(_observations(spark, sf), ["acc", "node"], "lat_text", "lon_text", True)
    return r.filter(F.col("resolution").isin(obs.LATITUDE, obs.LONGITUDE)).agg(
        F.lit("latitude_or_longitude").alias("kind"), F.count(F.lit(1)).alias("group_count"))


@query("location_candidates", t.SQL_BASE + """SELECT CAST(o_orderkey AS VARCHAR) AS acc, reason AS reason_code, observations AS candidate_count
 FROM crash WHERE source_id = 'america' AND NOT mapped AND observations IS NOT NULL""")
def location_candidates(spark, sf):
    """Candidates behind unresolved locations, kept in long form and counted per crash here."""
    m = t.manifest()
    found = P.project_source(t.raw(spark, sf), m.source("america"), t.BATCH, m.year_from, m.year_to).candidates
    return found.groupBy(F.col("__parent").alias("acc"), "reason_code").agg(F.count(F.lit(1)).alias("candidate_count"))


@query("relationship_gate", t.SQL_BASE + """, du AS (SELECT source_id, count(*) AS n FROM (
   SELECT source_id, unit_key FROM unit GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)
 SELECT s.source_id, CAST(0 AS BIGINT) AS crash_blank_key_count, CAST(0 AS BIGINT) AS crash_duplicate_key_count,
 CASE WHEN has THEN CAST(0 AS BIGINT) END AS unit_blank_key_count, CASE WHEN has THEN coalesce(du.n, 0) END AS unit_duplicate_key_count,
 CASE WHEN has THEN CAST(0 AS BIGINT) END AS orphan_unit_count
 FROM (SELECT DISTINCT source_id, source_id IN ('africa', 'america', 'middle_east') AS has FROM crash) s LEFT JOIN du USING (source_id)""")
def relationship_gate(spark, sf):
    """Blank keys, duplicate keys and orphans per source over the complete snapshot (repeated line numbers are real findings)."""
    raw = t.raw(spark, sf)
    return _stack([P.relationship_counts(raw, s).withColumn("source_id", F.lit(s.source_id)) for s in t.manifest().sources])


def _spoiled(spark, sf) -> DataFrame:
    """Crash records with damaged tokens, so that the gates have something to find."""
    def put(field: str, value):
        return F.map_concat(F.map_filter("payload", lambda k, v: k != field), F.create_map(F.lit(field), value))
    raw = t.raw(spark, sf).filter(F.col("resource_id") == "asia_crash")
    month, low, fatal = F.col("payload")["Crash_Month"], F.col("payload")["Crash_Severity"], F.col("payload")["Count_Fatality"]
    raw = raw.withColumn("payload", F.when(month == "March", put("Crash_Year", F.lit("19x7"))).otherwise(F.col("payload")))
    raw = raw.withColumn("payload", F.when(month == "May", put("Crash_Month", F.lit("Mai"))).otherwise(F.col("payload")))
    raw = raw.withColumn("payload", F.when(low == "2-HIGH", put("Crash_Severity", F.lit("X"))).otherwise(F.col("payload")))
    raw = raw.withColumn("payload", F.when(fatal == "2", put("Count_Hospitalised", F.lit("-1"))).otherwise(F.col("payload")))
    return raw.withColumn("payload", F.when(fatal == "0", put("Count_Total", F.lit("2147483647"))).otherwise(F.col("payload")))


@query("value_gate", t.SQL_BASE + """, x AS (SELECT *, month(o_orderdate) AS mm FROM base WHERE source_id = 'asia')
 SELECT count(*) FILTER (WHERE o_orderstatus <> 'P' AND mm = 3) AS invalid_year_count,
 count(*) FILTER (WHERE o_orderstatus <> 'P' AND mm = 5) AS invalid_month_count,
 count(*) FILTER (WHERE o_orderpriority = '2-HIGH') AS undefined_category_count,
 count(*) FILTER (WHERE fa = 2) AS invalid_count_token_count, CAST(0 AS BIGINT) AS count_overflow_count,
 count(*) FILTER (WHERE fa = 0 AND o_orderpriority <> '5-LOW') AS component_total_mismatch_count,
 CAST(0 AS BIGINT) AS fatality_above_total_count FROM x""")
def value_gate(spark, sf):
    """Seven bad-token counts in one pass over a damaged snapshot."""
    return P.value_counts(_spoiled(spark, sf), t.manifest().source("asia"))


@query("unit_type_gate", t.SQL_BASE + """SELECT source_id, CAST(0 AS BIGINT) AS undefined_unit_type_count, CAST(0 AS BIGINT) AS invalid_declared_unit_count,
 count(*) AS unit_count FROM unit GROUP BY source_id""")
def unit_type_gate(spark, sf):
    raw = t.raw(spark, sf)
    return _stack([P.unit_type_counts(raw, s).crossJoin(P.unit_rows(raw, s).agg(F.count(F.lit(1)).alias("unit_count"))).withColumn("source_id", F.lit(s.source_id))
                   for s in t.manifest().sources if s.units])      # one row beside one row, for each source with units


@query("projection_self_check", t.SQL_BASE + """SELECT count(*) AS crash_count, count(*) FILTER (WHERE fatal) AS fatal_crash_count,
 CAST(sum(deaths) AS BIGINT) AS fatality_count, CAST(sum(hurt) AS BIGINT) AS casualty_count, count(*) FILTER (WHERE mapped) AS map_count,
 (SELECT count(*) FROM unit) AS unit_count, (SELECT count(*) FROM unit WHERE kind IS NULL) AS missing_type_count,
 CAST(0 AS BIGINT) AS eligible_without_type_count, CAST(0 AS BIGINT) AS duplicate_crash_key_count,
 (SELECT count(*) FROM (SELECT unit_key FROM unit GROUP BY 1 HAVING count(*) > 1)) AS duplicate_unit_key_count,
 CAST(0 AS BIGINT) AS orphan_unit_count FROM crash""")
def projection_self_check(spark, sf):
    return P.projection_counts(t.crash(spark, sf), t.unit(spark, sf))


@query("file_summary", t.SQL_BASE + """SELECT source_id || '_crash' AS resource_id, 'crash' AS role, count(*) AS actual_count, true AS count_match FROM crash GROUP BY source_id
 UNION ALL SELECT source_id || '_unit', 'unit', count(*), true FROM unit GROUP BY source_id
 UNION ALL SELECT 'america_node_raw', 'node_raw', count(*), true FROM seen""")
def file_summary(spark, sf):
    """Catalogue entry and observed row count of every declared file."""
    files = file_frame(spark, t.frozen(spark, sf))
    return inventory.file_summary(t.raw(spark, sf), files).select("resource_id", "role", "actual_count", "count_match")


@query("selected_snapshot", t.SQL_BASE + """SELECT source_id, 'crash' AS role, 'full' AS release_scope, count(*) AS row_count FROM crash GROUP BY ALL
 UNION ALL SELECT source_id, 'unit', 'full', count(*) FROM unit GROUP BY ALL UNION ALL SELECT 'america', 'node_raw', 'full', count(*) FROM seen""")
def selected_snapshot(spark, sf):
    sel = records.selected_snapshot(t.raw(spark, sf), file_frame(spark, t.manifest()))
    return sel.groupBy("source_id", "role", "release_scope").agg(F.count(F.lit(1)).alias("row_count"))


@query("payload_shape", """SELECT event_id, CASE WHEN event_type = 'signup' THEN 'k' ELSE '' END AS missing_fields,
 CASE WHEN event_type = 'error' THEN 'x' ELSE '' END AS extra_fields FROM events WHERE event_type IN ('signup', 'error')""")
def payload_shape(spark, sf):
    """Payloads lacking a declared field or carrying an undeclared one (JSON properties renamed for two event types)."""
    e = t.table(spark, sf, "events").select("event_id", "event_type", F.from_json("props", "map<string,string>").alias("payload"))
    e = e.withColumn("payload", F.when(F.col("event_type") == "signup", F.map_filter("payload", lambda k, v: k != "k"))
                     .when(F.col("event_type") == "error", F.map_concat("payload", F.create_map(F.lit("x"), F.lit("1"))))
                     .otherwise(F.col("payload")))
    return records.payload_shape_errors(e, ["k"]).select(
        "event_id", F.array_join("missing_fields", ",").alias("missing_fields"), F.array_join("extra_fields", ",").alias("extra_fields"))


def _native_year():
    """The year as the crash files of the four native forms hold it."""
    return F.coalesce(*[F.try_element_at("payload", F.lit(f)) for f in ("Year of crash", "Crash_Year", "YEAR")], F.substring(F.try_element_at("payload", F.lit("ACC_DATE")), 1, 4))


def _two_loads(spark, sf):
    """What was stored before and what arrives now: years up to 1997 are known, those of 1995 changed meanwhile."""
    raw = t.raw(spark, sf).filter(F.col("resource_id").endswith("_crash"))
    year = _native_year()
    changed = F.transform_values("payload", lambda k, v: F.when(k.isin("Degree", "SEVERITY", "Crash_Severity"), F.lit("changed")).otherwise(v))
    return raw.filter(year <= "1997"), raw.withColumn("payload", F.when(year == "1995", changed).otherwise(F.col("payload")))


@query("raw_load_states", t.SQL_BASE + """SELECT source_id, CASE WHEN y = 1995 THEN 'conflict' WHEN y <= 1997 THEN 'reuse' ELSE 'insert' END AS state,
 count(*) AS row_count FROM crash GROUP BY ALL""")
def raw_load_states(spark, sf):
    stored, incoming = _two_loads(spark, sf)
    return G.load_states(stored, incoming).groupBy("source_id", "state").agg(F.count(F.lit(1)).alias("row_count"))


@query("raw_rows_to_insert", t.SQL_BASE + """SELECT source_id, CAST(o_orderkey AS VARCHAR) AS crash_id, CAST(y AS VARCHAR) AS year_text FROM crash WHERE y > 1997""")
def raw_rows_to_insert(spark, sf):
    stored, incoming = _two_loads(spark, sf)
    key = F.coalesce(*[F.try_element_at("payload", F.lit(f)) for f in ("Crash ID", "ACC_NO", "Ref_Number", "CRASH_ID")])
    return G.rows_to_insert(stored, incoming).select("source_id", key.alias("crash_id"), _native_year().alias("year_text"))


@query("source_registration", """SELECT lower(replace(r_name, ' ', '_')) AS source_id, r_name AS source_name FROM region WHERE r_regionkey >= 2""")
def source_registration(spark, sf):
    """Registering all regions when two are known already inserts the other three."""
    known = t.table(spark, sf, "region").select(F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("source_id"),
                                                F.col("r_name").alias("source_name"), "r_regionkey")
    return G.register(known.filter("r_regionkey < 2").drop("r_regionkey"), known.drop("r_regionkey"), "source_id")


@query("hub_increment", t.SQL_BASE + """SELECT source_id, 'full' AS release_scope, crash_key, 'batch-1' AS first_batch_id FROM crash WHERE y >= 1999""")
def hub_increment(spark, sf):
    """Keys a second batch adds to a hub that already holds the years before 1999."""
    crash = t.crash(spark, sf)
    return V.hub_rows(crash.filter("occurrence_year < 1999"), crash, "crash_key")


@query("unit_links", t.SQL_BASE + """SELECT source_id, crash_key, count(*) AS unit_count, count(DISTINCT unit_key) AS unit_key_count FROM unit GROUP BY ALL""")
def unit_links(spark, sf):
    df = V.links(t.unit(spark, sf))
    per = df.groupBy("source_id", "crash_key", "unit_key").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("source_id", "crash_key").agg(F.sum("n").alias("unit_count"), F.count(F.lit(1)).alias("unit_key_count"))


@query("vault_round_trip", t.SQL_BASE + """SELECT source_id, count(*) AS crash_count, count(*) FILTER (WHERE mapped) AS map_count,
 CAST(sum(hurt) AS BIGINT) AS casualty_count, count(DISTINCT reason) AS reason_count FROM crash GROUP BY ALL""")
def vault_round_trip(spark, sf):
    """Typed rows read back from the attribute snapshots."""
    df = V.canonical_crash(V.crash_satellite(t.crash(spark, sf)))
    return df.groupBy("source_id").agg(
        F.count(F.lit(1)).alias("crash_count"), F.count_if("map_eligible").alias("map_count"),
        F.sum(F.col("casualty_count").cast("bigint")).alias("casualty_count"),
        F.countDistinct("quality_notes.location.reason_code").alias("reason_count"))


@query("link_conflicts", t.SQL_BASE + """SELECT DISTINCT source_id, unit_key, crash_key FROM unit""")
def link_conflicts(spark, sf):
    """Units whose stored parent disagrees with the link (all links were moved). Repeated keys are reduced first."""
    unit = t.unit(spark, sf)
    sat = V.unit_satellite(unit.dropDuplicates(UNIT_ID))
    link = V.links(unit.dropDuplicates(UNIT_ID)).withColumn("crash_key", F.lit('["moved"]'))
    return V.link_conflicts(sat, link).select("source_id", "unit_key", "crash_key")


@query("fact_rows", t.SQL_BASE + """SELECT source_id, crash_key, y AS occurrence_year, y * 100 + m AS month_id, sev AS severity_code,
 fatal AS is_fatal_crash, deaths AS fatality_count, hurt AS casualty_count, mapped AS map_eligible FROM crash""")
def fact_rows(spark, sf):
    return W.facts(t.crash(spark, sf)).select("source_id", "crash_key", "occurrence_year", "month_id", "severity_code", "is_fatal_crash",
                                              "fatality_count", "casualty_count", "map_eligible")


@query("calendar_facts", t.SQL_BASE + """SELECT CAST(yy * 100 + mm AS INTEGER) AS month_id, CAST(yy AS INTEGER) AS calendar_year,
 CAST(mm AS INTEGER) AS calendar_month, count(o_orderkey) AS crash_count
 FROM generate_series(1995, 2001) a(yy) CROSS JOIN generate_series(1, 12) b(mm) LEFT JOIN crash ON y = yy AND m = mm GROUP BY ALL""")
def calendar_facts(spark, sf):
    """Every month of the shared calendar with its facts, empty months included."""
    counts = t.fact(spark, sf).filter("month_id is not null").groupBy("month_id").agg(F.count(F.lit(1)).alias("n"))
    return (W.dim_month(spark, t.manifest()).join(counts, "month_id", "left")
            .select("month_id", "calendar_year", "calendar_month", F.coalesce("n", F.lit(0).cast("bigint")).alias("crash_count")))


@query("dimension_check", t.SQL_BASE + """SELECT source_id, severity_code, 'extra' AS state FROM (
 SELECT DISTINCT source_id, sev || '*' AS severity_code FROM crash WHERE sev = '2-HIGH')
 UNION ALL SELECT DISTINCT source_id, sev, 'missing' FROM crash WHERE sev = '2-HIGH'""")
def dimension_check(spark, sf):
    """Severity definitions recovered from the facts against the declared ones, after one code was renamed."""
    declared = W.dim_severity(spark, t.manifest(), t.BATCH).select("source_id", "severity_code", "definition_version")
    used = t.crash(spark, sf).select(
        "source_id", F.when(F.col("severity_code") == "2-HIGH", "2-HIGH*").otherwise(F.col("severity_code")).alias("severity_code"),
        F.col("severity_definition_version").alias("definition_version")).distinct()
    # Europe maps absent tokens, so its missing category never occurs in the data.
    declared = declared.filter(~((F.col("source_id") == "europe") & (F.col("severity_code") == "__MISSING__")))
    d = W.dimension_differences(used, declared, ["source_id", "severity_code"])
    return d.select("source_id", "severity_code", F.when(F.col("left_count") > 0, "extra").otherwise("missing").alias("state"))


@query("fact_preflight", t.SQL_BASE + """SELECT count(*) FILTER (WHERE source_id = 'asia' AND y = 1995) AS unknown_source_count,
 count(*) FILTER (WHERE NOT (source_id = 'asia' AND y = 1995) AND y = 1996) AS release_scope_mismatch_count,
 count(*) FILTER (WHERE sev = '3-MEDIUM' OR (source_id = 'asia' AND y = 1995)) AS unknown_severity_count,
 count(*) FILTER (WHERE sev = '2-HIGH' AND NOT (source_id = 'asia' AND y = 1995)) AS severity_version_mismatch_count,
 count(*) FILTER (WHERE m = 12) AS unknown_month_count FROM crash""")
def fact_preflight(spark, sf):
    """Five dimension-contract counts over rows with a planted error of each kind."""
    df, y, s = t.crash(spark, sf), F.col("occurrence_year"), F.col("severity_code")
    df = (df.withColumn("source_id", F.when((F.col("source_id") == "asia") & (y == 1995), "nowhere").otherwise(F.col("source_id")))
          .withColumn("release_scope", F.when(y == 1996, "other").otherwise(F.col("release_scope")))
          .withColumn("severity_definition_version", F.when(s == "2-HIGH", "old").otherwise(F.col("severity_definition_version")))
          .withColumn("severity_code", F.when(s == "3-MEDIUM", "?").otherwise(s))
          .withColumn("occurrence_month", F.when(F.col("occurrence_month") == 12, 13).otherwise(F.col("occurrence_month"))))
    m = t.manifest()
    return W.preflight(df, W.dim_source(spark, m, t.BATCH), W.dim_severity(spark, m, t.BATCH), W.dim_month(spark, m))


def damaged_facts(spark, sf) -> DataFrame:
    """Facts with rows removed, altered and added."""
    f = t.fact(spark, sf)
    kept = f.filter(~((F.col("occurrence_year") == 1996) & F.col("month_id").isNull()))
    changed = kept.withColumn("fatality_count", F.when(F.col("fatality_count") == 3, 4).otherwise(F.col("fatality_count")))
    added = f.filter("occurrence_year = 2001 and severity_code = '5-LOW'").withColumn("crash_key", F.concat("crash_key", F.lit("x")))
    return changed.unionByName(added)


DAMAGE = """SELECT *, (y = 1996 AND m IS NULL) AS lost, NOT (y = 1996 AND m IS NULL) AND deaths = 3 AS altered,
 y = 2001 AND sev = '5-LOW' AS doubled FROM crash"""


@query("fact_verification", t.SQL_BASE + f""", z AS ({DAMAGE}) SELECT source_id, count(*) AS expected_count,
 count(*) - count(*) FILTER (WHERE lost) + count(*) FILTER (WHERE doubled) AS actual_count,
 count(*) FILTER (WHERE lost OR coalesce(altered, false)) + count(*) FILTER (WHERE doubled) AS difference_count FROM z GROUP BY ALL""")
def fact_verification(spark, sf):
    return W.fact_verification(t.crash(spark, sf), damaged_facts(spark, sf))


@query("fact_differences", t.SQL_BASE + f""", z AS ({DAMAGE}) SELECT source_id, crash_key, '' AS mismatched FROM z WHERE lost
 UNION ALL SELECT source_id, crash_key || 'x', '' FROM z WHERE doubled UNION ALL SELECT source_id, crash_key, 'fatality_count' FROM z WHERE altered""")
def fact_differences(spark, sf):
    """Every missing, extra or changed fact with the fields that differ."""
    d = W.fact_differences(t.crash(spark, sf), damaged_facts(spark, sf))
    both = (F.col("left_count") > 0) & (F.col("right_count") > 0)
    return d.select("source_id", "crash_key", F.when(both, F.array_join("mismatched_fields", ",")).otherwise("").alias("mismatched"))
