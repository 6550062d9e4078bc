"""Quality checks, publication gate and release over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from crashmart.model import CRASH_ID, contract_frame
from crashmart.plans.build import quality_results
from crashmart.plans.native import read_file
from crashmart.session import materialize, scratch_path
from crashmart.plans import expectation as E, quality as Q, registry as G, release as L, vault as V, warehouse as W
from crashmart.sources import sinks

from . import tables as t
from .projection import DAMAGE, damaged_facts
from .registry import query


def _flat(results: DataFrame) -> DataFrame:
    """Result rows with one line per metric."""
    return results.select("rule_id", "object_key", "result", "affected_count", F.col("actual.evaluated_count").alias("evaluated_count"),
                          F.explode("actual.metrics").alias("metric", "actual_value"), F.col("expected.metrics").alias("w")).select(
        "rule_id", "object_key", "result", "affected_count", "evaluated_count", "metric", "actual_value",
        F.try_element_at("w", F.col("metric")).alias("expected_value"))


def _stack(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


UNIT_DUP = "(SELECT source_id, count(*) AS n FROM (SELECT source_id, unit_key FROM unit GROUP BY ALL HAVING count(*) > 1) GROUP BY ALL)"


@query("projection_check", t.SQL_BASE + f""", o AS (
 SELECT source_id || '_crash' AS k, count(*) AS n, CAST(0 AS BIGINT) AS dup FROM crash GROUP BY source_id
 UNION ALL SELECT u.source_id || '_unit', count(*), any_value(d.n) FROM unit u JOIN {UNIT_DUP} d USING (source_id) GROUP BY u.source_id)
 SELECT 'QA03_PROJECTED' AS rule_id, 'resource:' || k AS object_key, CASE WHEN dup > 0 THEN 'block' ELSE 'pass' END AS result, dup AS affected_count,
 n AS evaluated_count, v.metric, v.a AS actual_value, v.e AS expected_value FROM o, LATERAL (VALUES ('input_count', n, n), ('excluded_count', 0, 0),
 ('projected_count', n, n), ('duplicate_key_count', dup, 0), ('orphan_count', 0, 0), ('invalid_value_count', 0, 0)) v(metric, a, e)""")
def projection_check(spark, sf):
    """Projected rows against an independent second derivation; repeated line numbers block their unit files."""
    return _flat(Q.projection_results(t.raw(spark, sf), t.frozen(spark, sf), t.crash(spark, sf), t.unit(spark, sf), t.BATCH))


@query("projection_field_differences", t.SQL_BASE + """SELECT source_id, crash_key, 'fatality_count' AS fields FROM crash WHERE deaths = 1 AND sev <> '2-HIGH' UNION ALL
 SELECT source_id, crash_key, CASE WHEN deaths = 1 THEN 'severity_code,fatality_count' ELSE 'severity_code' END FROM crash WHERE sev = '2-HIGH'""")
def projection_field_differences(spark, sf):
    """Which fields of which rows disagree after two kinds of damage."""
    rows = t.crash(spark, sf)
    bad = rows.withColumn("fatality_count", F.when(F.col("fatality_count") == 1, 9).otherwise(F.col("fatality_count"))).withColumn(
        "severity_code", F.when(F.col("severity_code") == "2-HIGH", "5-LOW").otherwise(F.col("severity_code")))
    raw = t.raw(spark, sf)
    wanted = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [
        E.expected_crash(raw, s, t.YEAR_FROM, t.YEAR_TO).withColumn("source_id", F.lit(s.source_id)) for s in t.manifest().sources])
    wanted = materialize(wanted, "expected")
    d = Q.projection_differences(wanted, bad, E.CRASH_FIELDS)
    own = rows.select("raw_record_id", F.col("source_id").alias("own_source"), "crash_key")
    return d.join(own, "raw_record_id").select(F.col("own_source").alias("source_id"), "crash_key", F.array_join("mismatched_fields", ",").alias("fields"))


@query("auxiliary_check", t.SQL_BASE + f""", dv AS (SELECT source_id, abs(count(l_orderkey) - o_orderkey % 8) AS delta FROM base LEFT JOIN lineitem ON l_orderkey = o_orderkey
   WHERE source_id IN ('africa', 'america', 'middle_east') GROUP BY source_id, o_orderkey),
 dd AS (SELECT source_id, CAST(sum(delta) AS BIGINT) AS delta, count(*) FILTER (WHERE delta <> 0) AS off FROM dv GROUP BY ALL),
 ng AS (SELECT count(*) FILTER (WHERE n > 1) AS dup, count(*) FILTER (WHERE p > 1) AS conflict, CAST(sum(n) AS BIGINT) AS n FROM (SELECT k, count(*) AS n,
   count(DISTINCT CASE WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 THEN (la, lo) END) AS p FROM seen GROUP BY k)),
 o AS (SELECT source_id || '_unit' AS k, cnt AS n, 'block' AS result, du.n + dd.off AS affected, CAST(0 AS BIGINT) AS orphan, CAST(NULL AS BIGINT) AS un, dd.delta, CAST(0 AS BIGINT) AS edelta, du.n AS dup, CAST(0 AS BIGINT) AS edup, CAST(NULL AS BIGINT) AS conflict
   FROM (SELECT source_id, count(*) AS cnt FROM unit GROUP BY ALL) JOIN {UNIT_DUP} du USING (source_id) JOIN dd USING (source_id)
   UNION ALL SELECT 'america_node_raw', n, 'pass', 0, 0, NULL, NULL, NULL, dup, NULL, conflict FROM ng)
 SELECT 'QA04_AUXILIARY' AS rule_id, 'resource:' || k AS object_key, result, affected AS affected_count, n AS evaluated_count, v.metric, v.a AS actual_value, v.e AS expected_value
 FROM o, LATERAL (VALUES ('orphan_count', orphan, 0), ('nonblank_unmatched_count', un, NULL), ('declared_count_delta', delta, edelta), ('duplicate_group_count', dup, edup),
 ('coordinate_conflict_group_count', conflict, NULL)) v(metric, a, e)""")
def auxiliary_check(spark, sf):
    """Child files: orphans, duplicate groups, declared counts and coordinate conflicts."""
    return _flat(Q.auxiliary_results(t.raw(spark, sf), t.frozen(spark, sf), t.BATCH))


@query("coordinate_conflicts", t.SQL_BASE + """SELECT CAST(k AS VARCHAR) AS acc, p AS coordinate_pair_count FROM (SELECT k,
 count(DISTINCT CASE WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 THEN (la, lo) END) AS p FROM seen GROUP BY k) WHERE p > 1""")
def coordinate_conflicts(spark, sf):
    from .projection import _observations
    return Q.coordinate_conflicts(_observations(spark, sf), ["acc"], "lat_text", "lon_text")


@query("semantics_check", t.SQL_BASE + """, o AS (SELECT source_id, count(*) AS n, count(*) FILTER (WHERE source_id = 'asia' AND sev = '5-LOW') AS wrong FROM crash GROUP BY ALL),
 total AS (SELECT source_id, n + coalesce((SELECT count(*) FROM unit u WHERE u.source_id = o.source_id), 0) + CASE WHEN source_id = 'america' THEN (SELECT count(*) FROM seen) ELSE 0 END AS n, wrong FROM o)
 SELECT 'QA05_SEMANTICS' AS rule_id, 'source:' || source_id AS object_key, CASE WHEN wrong > 0 THEN 'block' ELSE 'pass' END AS result, wrong AS affected_count, n AS evaluated_count,
 v.metric, v.a AS actual_value, CAST(0 AS BIGINT) AS expected_value FROM total, LATERAL (VALUES ('undefined_category_count', CAST(0 AS BIGINT)), ('unconfirmed_definition_count', 0), ('eligibility_error_count', wrong)) v(metric, a)""")
def semantics_check(spark, sf):
    """Categories and eligibility of projected rows; one category of one source was made ineligible by mistake."""
    crash = t.crash(spark, sf)
    hit = (F.col("source_id") == "asia") & (F.col("severity_code") == "5-LOW")
    crash = crash.withColumn("fatal_crash_eligible", F.when(hit, False).otherwise(F.col("fatal_crash_eligible")))
    return _flat(Q.semantics_results(t.raw(spark, sf), t.frozen(spark, sf), crash, t.unit(spark, sf), t.BATCH))


@query("undefined_categories", t.SQL_BASE + """SELECT 'X' AS token, count(*) AS row_count FROM crash WHERE source_id = 'asia' AND o_orderpriority = '2-HIGH'""")
def undefined_categories(spark, sf):
    from .projection import _spoiled
    found = E.semantic_errors(_spoiled(spark, sf), t.manifest().source("asia"))
    return found.groupBy("token").agg(F.count(F.lit(1)).alias("row_count"))


def _reconciled(spark, sf, fact: DataFrame) -> DataFrame:
    m, crash = t.manifest(), t.crash(spark, sf)
    lineage = materialize(Q.lineage_errors(crash, Q.raw_keys(t.raw(spark, sf), m)), "lineage")
    return Q.reconcile_rows(crash, fact, W.dim_source(spark, m, t.BATCH), W.dim_severity(spark, m, t.BATCH), lineage)


@query("reconciliation", t.SQL_BASE + f""", z AS ({DAMAGE}), s AS (SELECT source_id, y, deaths, hurt, fatal, lost, coalesce(altered, false) AS altered, doubled FROM z),
 g AS (SELECT source_id, y AS occurrence_year, count(*) + count(*) FILTER (WHERE doubled) AS evaluated_count, count(*) AS expected_count,
  count(*) FILTER (WHERE lost) AS missing_fact_count, count(*) FILTER (WHERE doubled) AS extra_fact_count, count(*) FILTER (WHERE altered) AS field_mismatch_count,
  CAST(0 AS BIGINT) AS lineage_error_count, CAST(0 AS BIGINT) AS definition_error_count,
  count(*) FILTER (WHERE doubled) - count(*) FILTER (WHERE lost) AS crash_delta,
  count(*) FILTER (WHERE doubled AND fatal) - count(*) FILTER (WHERE lost AND fatal) AS fatal_crash_delta,
  CAST(coalesce(sum(deaths) FILTER (WHERE doubled), 0) - coalesce(sum(deaths) FILTER (WHERE lost), 0) + count(*) FILTER (WHERE altered) AS BIGINT) AS fatality_delta,
  CAST(coalesce(sum(hurt) FILTER (WHERE doubled), 0) - coalesce(sum(hurt) FILTER (WHERE lost), 0) AS BIGINT) AS casualty_delta,
  count(fatal) FILTER (WHERE doubled) - count(fatal) FILTER (WHERE lost) AS fatal_crash_known_delta,
  count(deaths) FILTER (WHERE doubled) - count(deaths) FILTER (WHERE lost) AS fatality_known_delta,
  count(hurt) FILTER (WHERE doubled) - count(hurt) FILTER (WHERE lost) AS casualty_known_delta,
  count(*) FILTER (WHERE lost OR altered) + count(*) FILTER (WHERE doubled) AS affected_count FROM s GROUP BY ALL)
 SELECT * FROM g UNION ALL SELECT source_id, yy, 0,0,0,0,0,0,0,0,0,0,0,0,0,0,0 FROM (SELECT DISTINCT source_id FROM crash) CROSS JOIN (SELECT CAST(unnest([2002, 2003]) AS INTEGER) AS yy)""")
def reconciliation(spark, sf):
    """Twelve metrics per source and year between typed rows and facts, empty years included.

    Altered rows exist only in doubled form where both damages meet, so the added copies carry the original values.
    """
    m = t.manifest()
    rows = _reconciled(spark, sf, damaged_facts(spark, sf))
    return Q.reconcile_metrics(rows, W.dim_source(spark, m, t.BATCH), t.YEAR_FROM, 2003)


@query("reconciliation_details", t.SQL_BASE + f""", z AS ({DAMAGE}) SELECT source_id, crash_key, true AS missing_fact, false AS extra_fact, false AS field_mismatch, '' AS fields FROM z WHERE lost
 UNION ALL SELECT source_id, crash_key || 'x', false, true, false, '' FROM z WHERE doubled UNION ALL SELECT source_id, crash_key, false, false, true, 'fatality_count' FROM z WHERE altered""")
def reconciliation_details(spark, sf):
    d = Q.reconcile_details(_reconciled(spark, sf, damaged_facts(spark, sf)))
    return d.select("source_id", "crash_key", "missing_fact", "extra_fact", "field_mismatch",
                    F.when(F.col("field_mismatch"), F.array_join("mismatched_fields", ",")).otherwise("").alias("fields"))


@query("lineage_check", t.SQL_BASE + """SELECT source_id, crash_key FROM crash WHERE (source_id = 'africa' AND sev = '1-URGENT') OR (source_id = 'america' AND mapped)""")
def lineage_check(spark, sf):
    """Rows whose raw record or location belongs to another crash: one group got the wrong key, one a foreign location."""
    crash = t.crash(spark, sf)
    wrong = (F.col("source_id") == "africa") & (F.col("severity_code") == "1-URGENT")
    keyed = crash.withColumn("__k", F.when(wrong, F.concat(F.col("crash_key"), F.lit("?"))).otherwise(F.col("crash_key")))
    moved = keyed.drop("crash_key").withColumnRenamed("__k", "crash_key").withColumn(
        "location_record_id", F.when((F.col("source_id") == "america") & F.col("map_eligible"), F.reverse("location_record_id"))
        .otherwise(F.col("location_record_id")))
    bad = Q.lineage_errors(moved, Q.raw_keys(t.raw(spark, sf), t.manifest())).filter("lineage_error")
    return bad.select("source_id", F.regexp_replace("crash_key", r"\?\z", "").alias("crash_key"))


@query("location_derivation", t.SQL_BASE + """, d AS (SELECT source_id, o_orderkey % 5 AS z, mapped, o_orderpriority = '4-NOT SPECIFIED' AS bare FROM crash)
 SELECT source_id, field, count(*) AS n FROM (
  SELECT source_id, 'latitude' AS field FROM d WHERE z = 0 AND mapped
  UNION ALL SELECT source_id, unnest(['map_eligible', 'latitude', 'longitude', 'location_crs', 'location_record_id', 'location_note']) FROM d WHERE z = 1 AND mapped
  UNION ALL SELECT source_id, 'location_note' FROM d WHERE z = 2 AND NOT mapped
  UNION ALL SELECT source_id, CASE WHEN source_id = 'europe' THEN 'rule_note' ELSE 'field_notes' END FROM d WHERE z = 3 AND bare) GROUP BY ALL""")
def location_derivation(spark, sf):
    """Locations, reasons and notes of all sources against the second derivation: a last place moved, a point withheld, a wrong reason, a lost note."""
    crash = t.crash(spark, sf)
    z = F.get_json_object("crash_key", "$[0]").cast("long") % 5
    mapped, notes = F.col("map_eligible"), F.col("quality_notes")
    withheld = (z == 1) & mapped
    odd = F.struct(F.lit("unmapped").alias("reason_code"), F.lit(None).cast("array<string>").alias("candidate_raw_record_ids"),
                   F.lit("made up").alias("resolution"), F.lit("").alias("evidence_ref"))
    bare = (z == 3) & ((F.col("severity_code") == "__MISSING__") | notes["severity_rule"].isNotNull())
    kept = F.filter(notes["fields"], lambda x: x["field"] != "fatal_crash_eligible")
    notes = (F.when(withheld | ((z == 2) & ~mapped), notes.withField("location", odd))
             .when(bare, notes.withField("fields", F.when(F.size(kept) > 0, kept)).withField("severity_rule", F.lit(None))).otherwise(notes))
    hide = {name: F.when(~withheld, F.col(name)) for name in ("longitude", "location_crs", "location_record_id")}
    moved = F.when((z == 0) & mapped, F.col("latitude") + F.lit("0.0000001").cast("decimal(10,7)")).when(~withheld, F.col("latitude"))
    crash = crash.withColumns({**hide, "latitude": moved.cast("decimal(10,7)"), "map_eligible": mapped & ~withheld, "quality_notes": notes})
    found = Q.detail_differences(materialize(Q.expected_rows(t.raw(spark, sf), t.frozen(spark, sf))[0], "expected"), crash)
    return found.select("source_id", F.explode("mismatched_fields").alias("field")).groupBy("source_id", "field").agg(F.count(F.lit(1)).alias("n"))


@query("location_check", t.SQL_BASE + """, g AS (SELECT source_id, y, count(*) AS n, count(*) FILTER (WHERE mapped) AS p,
   count(*) FILTER (WHERE mapped AND source_id = 'asia' AND sev = '1-URGENT') AS w FROM crash GROUP BY ALL)
 SELECT 'QA07_LOCATION' AS rule_id, 'source_year:' || source_id || ':' || y AS object_key, CASE WHEN w > 0 THEN 'block' WHEN n > p THEN 'limited' ELSE 'pass' END AS result,
 CASE WHEN w > 0 THEN w ELSE n - p END AS affected_count, n AS evaluated_count, v.metric, v.a AS actual_value, v.e AS expected_value
 FROM g, LATERAL (VALUES ('crash_count', n, n), ('map_count', p, p), ('unmapped_count', n - p, n - p), ('invalid_eligible_count', w, 0)) v(metric, a, e)""")
def location_check(spark, sf):
    """Mapped and unmapped rows per source and year; some facts of one source carry a shifted point."""
    m, f = t.manifest(), t.fact(spark, sf)
    hit = (F.col("source_id") == "asia") & (F.col("severity_code") == "1-URGENT") & F.col("map_eligible")
    f = f.withColumn("latitude", F.when(hit, (F.col("latitude") + 1).cast("decimal(10,7)")).otherwise(F.col("latitude")))
    expected = Q.expected_locations(Q.expected_rows(t.raw(spark, sf), t.frozen(spark, sf))[0], t.BATCH)
    metrics = Q.location_metrics(expected, f, W.dim_source(spark, m, t.BATCH), t.YEAR_FROM, t.YEAR_TO)
    return _flat(Q.location_results(metrics, t.BATCH))


@query("unmapped_reasons", t.SQL_BASE + "SELECT source_id, y AS occurrence_year, reason AS reason_code, count(*) AS crash_count FROM crash WHERE NOT mapped GROUP BY ALL")
def unmapped_reasons(spark, sf):
    return Q.unmapped_reasons(t.crash(spark, sf)).groupBy("source_id", "occurrence_year", "reason_code").agg(F.count(F.lit(1)).alias("crash_count"))


@query("invalid_raw_rows", t.SQL_BASE + """SELECT 'unknown_year:asia' AS object_key, '19x7' AS year_text, 'unknown_occurrence_year' AS reasons, count(*) AS row_count
 FROM crash WHERE source_id = 'asia' AND o_orderstatus <> 'P' AND m = 3""")
def invalid_raw_rows(spark, sf):
    from .projection import _spoiled
    rows = Q.invalid_raw_rows(_spoiled(spark, sf), t.manifest().source("asia"))
    return rows.groupBy("object_key", "year_text", F.array_join("reason_codes", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("row_count"))


@query("row_invariants", t.SQL_BASE + """SELECT CAST(0 AS BIGINT) AS year_range, count(*) FILTER (WHERE d IS NULL AND sev = '5-LOW' AND m IS NOT NULL) AS year_precision,
 count(*) FILTER (WHERE deaths = 0) AS negative_count, count(*) FILTER (WHERE fatal IS NULL) AS fatal_known, count(*) FILTER (WHERE deaths IS NULL) AS fatality_known,
 count(*) FILTER (WHERE mapped AND source_id = 'asia') AS map_complete, count(*) FILTER (WHERE NOT mapped AND source_id = 'africa') AS map_withheld FROM crash""")
def row_invariants(spark, sf):
    """Breaking rows per named rule after planting one damage per rule."""
    c, src = t.crash(spark, sf), F.col("source_id")
    c = (c.withColumn("date_precision", F.when(F.col("occurrence_date").isNull() & (F.col("severity_code") == "5-LOW"), "year").otherwise(F.col("date_precision")))
         .withColumn("fatality_eligible", F.lit(True))
         .withColumn("fatality_count", F.when(F.col("fatality_count") == 0, -1).otherwise(F.col("fatality_count")))
         .withColumn("fatal_crash_eligible", F.lit(True))
         .withColumn("location_crs", F.when(src == "asia", F.when(F.col("map_eligible"), "EPSG:7844")).otherwise(F.col("location_crs")))
         .withColumn("latitude", F.when((src == "africa") & ~F.col("map_eligible"), F.lit(1).cast("decimal(10,7)")).otherwise(F.col("latitude"))))
    counts = Q.invariant_counts(c, Q.crash_invariants())
    return counts.select("year_range", "year_precision", "negative_count", "fatal_known", "fatality_known", "map_complete", "map_withheld")


@query("projection_validation", t.SQL_BASE + f"""SELECT v.c AS "check", v.n AS affected_count FROM (SELECT (SELECT CAST(sum(n) AS BIGINT) FROM {UNIT_DUP}) AS dup,
 (SELECT count(*) FROM unit WHERE y = 1997 AND source_id = 'africa') AS orphan, (SELECT count(*) FROM crash WHERE y = 1997 AND source_id = 'africa') AS moved) x,
 LATERAL (VALUES ('crash_scope', moved), ('unit_scope', CAST(0 AS BIGINT)), ('crash_duplicate_key', 0), ('unit_duplicate_key', dup), ('unit_orphan', orphan), ('crash_values', 0),
 ('unit_values', 0), ('crash_lineage', 0), ('unit_lineage', 0), ('location_lineage', 0)) v(c, n)""")
def projection_validation(spark, sf):
    """Scope, keys, parents, values and lineage; one year of one source was moved to a foreign release scope."""
    m, crash = t.manifest(), t.crash(spark, sf)
    hit = (F.col("source_id") == "africa") & (F.col("occurrence_year") == 1997)
    crash = crash.withColumn("release_scope", F.when(hit, "other").otherwise(F.col("release_scope")))
    return Q.validate_projection(crash, t.unit(spark, sf), m, t.BATCH, Q.raw_keys(t.raw(spark, sf), m))


@query("snapshot_lineage", t.SQL_BASE + """SELECT 'crash' AS kind, count(*) AS row_count FROM crash WHERE y = 1999 UNION ALL SELECT 'unit', count(*) FROM unit WHERE kind = 'CAR'""")
def snapshot_lineage(spark, sf):
    """Snapshot rows whose key or parent is not the one re-encoded from their raw record."""
    keys = Q.raw_keys(t.raw(spark, sf), t.manifest())
    crash = t.crash(spark, sf)
    crash = crash.withColumn("crash_key", F.when(F.col("occurrence_year") == 1999, F.lit('["0"]x')).otherwise(F.col("crash_key")))
    unit = t.unit(spark, sf)
    unit = unit.withColumn("crash_key", F.when(F.col("unit_type_code") == "CAR", F.lit('["0"]x')).otherwise(F.col("crash_key")))
    n = F.count(F.lit(1)).alias("row_count")
    a = Q.snapshot_lineage(V.crash_satellite(crash), keys, "crash", "crash_key").agg(n).select(F.lit("crash").alias("kind"), "row_count")
    b = Q.snapshot_lineage(V.unit_satellite(unit), keys, "unit", "unit_key").agg(n).select(F.lit("unit").alias("kind"), "row_count")
    return a.unionByName(b)


@query("satellite_equals_typed", t.SQL_BASE + """SELECT source_id, crash_key, 'casualty_count' AS fields FROM crash WHERE hurt = 5""")
def satellite_equals_typed(spark, sf):
    """Attribute snapshots against typed rows, compared as whole structs including notes."""
    crash = t.crash(spark, sf)
    stored = V.read_crash(V.crash_satellite(crash))
    typed = crash.withColumn("casualty_count", F.when(F.col("casualty_count") == 5, 6).otherwise(F.col("casualty_count")))
    d = Q.satellite_differences(stored, typed, [*CRASH_ID, "raw_record_id"])
    return d.select("source_id", "crash_key", F.array_join("mismatched_fields", ",").alias("fields"))


@query("restriction_check", t.SQL_BASE + """SELECT layer, source_id, reason_code, n AS row_count FROM (
 SELECT 'crash' AS layer, source_id, 'restricted_location' AS reason_code, count(*) FILTER (WHERE mapped) AS n FROM crash WHERE source_id = 'africa' GROUP BY ALL
 UNION ALL SELECT 'fact', source_id, 'restricted_fact_location', count(*) FILTER (WHERE mapped) FROM crash WHERE source_id = 'africa' GROUP BY ALL
 UNION ALL SELECT 'unit', source_id, 'restricted_unit_eligibility', count(*) FROM unit WHERE source_id = 'africa' GROUP BY ALL)""")
def restriction_check(spark, sf):
    """What a restriction on one source would forbid, per layer."""
    v = Q.restriction_violations(t.crash(spark, sf), t.unit(spark, sf), t.fact(spark, sf), ["africa"])
    return v.groupBy("layer", "source_id", "reason_code").agg(F.count(F.lit(1)).alias("row_count"))


@query("unselected_rows", t.SQL_BASE + """SELECT 'crash' AS layer, source_id, count(*) AS row_count FROM crash WHERE source_id IN ('asia', 'europe') GROUP BY ALL
 UNION ALL SELECT 'fact', source_id, count(*) FROM crash WHERE source_id IN ('asia', 'europe') GROUP BY ALL""")
def unselected_rows(spark, sf):
    """Rows of sources outside a narrower manifest."""
    from dataclasses import replace
    m = t.manifest()
    m = replace(m, sources=tuple(s for s in m.sources if s.source_id not in ("asia", "europe")))
    return Q.unselected_rows({"crash": t.crash(spark, sf), "unit": t.unit(spark, sf), "fact": t.fact(spark, sf)}, m)


def _replayed(spark, sf):
    """Stored records of all crash files against native ones: some missing, some changed, some foreign."""
    from .projection import _native_year
    native, year = t.raw(spark, sf).filter(F.col("resource_id").endswith("_crash")), _native_year()
    stored = native.filter(year != "1995").withColumn("payload", F.transform_values(
        "payload", lambda k, v: F.when(k.isin("Degree", "SEVERITY", "Crash_Severity") & (v == "2-HIGH"), F.lit("changed")).otherwise(v)))
    extra = native.filter(year == "2001").withColumn("row_locator", F.concat("row_locator", F.lit("0000000")))
    return native, stored.unionByName(extra)


@query("raw_replay", t.SQL_BASE + """SELECT source_id || '_crash' AS resource_id, count(*) AS native_count, count(*) FILTER (WHERE y <> 1995) + count(*) FILTER (WHERE y = 2001) AS raw_count,
 count(*) FILTER (WHERE y <> 1995) + count(*) FILTER (WHERE y = 2001) AS distinct_locator_count, count(*) FILTER (WHERE y <> 1995 AND o_orderpriority = '2-HIGH') AS payload_mismatch_count,
 count(*) FILTER (WHERE y = 1995) AS missing_count, count(*) FILTER (WHERE y = 2001) AS extra_count, CAST(0 AS BIGINT) AS duplicate_count,
 count(*) FILTER (WHERE y = 1995 OR o_orderpriority = '2-HIGH') + count(*) FILTER (WHERE y = 2001) AS affected_count FROM crash GROUP BY source_id""")
def raw_replay(spark, sf):
    native, stored = _replayed(spark, sf)
    return G.replay_summary(G.replay_differences(native, stored)).drop("file_sha256", "parser_version")


@query("raw_result", t.SQL_BASE + """SELECT rule_id, result, evaluated_count, count(*) AS object_count FROM (SELECT 'QA02_RAW' AS rule_id, 'pass' AS result, n AS evaluated_count
 FROM (SELECT count(*) AS n FROM crash GROUP BY source_id UNION ALL SELECT count(*) FROM unit GROUP BY source_id UNION ALL SELECT count(*) FROM seen)) GROUP BY ALL""")
def raw_result(spark, sf):
    """Raw objects of an undamaged load, one per file."""
    raw = t.raw(spark, sf)
    res = Q.raw_results(G.replay_summary(G.replay_differences(raw, raw)), t.frozen(spark, sf), t.BATCH)
    return res.groupBy("rule_id", "result", F.col("actual.evaluated_count").alias("evaluated_count")).agg(F.count(F.lit(1)).alias("object_count"))


@query("input_check", t.SQL_BASE + """, f(r) AS (SELECT DISTINCT source_id || '_crash' FROM crash UNION ALL SELECT DISTINCT source_id || '_unit' FROM unit UNION ALL SELECT 'america_node_raw')
 SELECT r AS resource_id, CASE WHEN r IN ('asia_crash', 'africa_unit') THEN 'block' ELSE 'pass' END AS result, CAST(CASE WHEN r IN ('asia_crash', 'africa_unit') THEN 1 ELSE 0 END AS BIGINT) AS affected_count,
 CASE r WHEN 'asia_crash' THEN 'header_match' WHEN 'africa_unit' THEN 'NATIVE_COUNT_MISMATCH' ELSE '' END AS reasons FROM f""")
def input_check(spark, sf):
    """Observed file sets: one header is re-ordered and one file lost a row."""
    m = t.frozen(spark, sf)
    counts = t.raw(spark, sf).groupBy("resource_id").agg(F.count(F.lit(1)).alias("actual_count"))
    heads = contract_frame(spark, [(f.resource_id, f.file_sha256, list(reversed(f.header)) if f.resource_id == "asia_crash" else list(f.header))
                                   for f in m.files()], "resource_id string, actual_sha256 string, actual_header array<string>")
    observed = heads.join(counts, "resource_id").withColumn("actual_count", F.when(
        F.col("resource_id") == "africa_unit", F.col("actual_count") - 1).otherwise(F.col("actual_count")))
    res = Q.input_results(observed, m, t.BATCH)
    return res.select(F.split("object_key", ":")[1].alias("resource_id"), "result", "affected_count", F.array_join("evidence.reason_codes", ",").alias("reasons"))


def all_results(spark, sf) -> DataFrame:
    """Every result object of the batch, as a build stores them (written once per application)."""
    raw, m = t.raw(spark, sf), t.frozen(spark, sf)
    # These rows were made from the tables and never were files: the records stand in for them here; native_reread reads real ones.
    stated = contract_frame(spark, [(f.resource_id, f.file_sha256, list(f.header)) for f in m.files()], "resource_id string, actual_sha256 string, actual_header array<string>")
    observed = stated.join(raw.groupBy("resource_id").agg(F.count(F.lit(1)).alias("actual_count")), "resource_id")
    return t.staged(spark, sf, "results", lambda: quality_results(
        raw, m, t.crash(spark, sf), t.unit(spark, sf), t.fact(spark, sf), t.BATCH, raw, observed), ["rule_id"])


ROLL = t.SQL_BASE + f""", yr AS (SELECT source_id, y, count(*) FILTER (WHERE NOT mapped) AS u FROM crash GROUP BY ALL),
 files AS (SELECT count(*) AS n FROM (SELECT DISTINCT source_id FROM crash UNION ALL SELECT DISTINCT source_id FROM unit UNION ALL SELECT 'node')),
 dv AS (SELECT source_id, count(l_orderkey) <> o_orderkey % 8 AS off FROM base LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE source_id IN ('africa', 'america', 'middle_east') GROUP BY source_id, o_orderkey),
 roll(rule_id, object_count, pass_count, limited_count, block_count, affected_count) AS (
 SELECT 'QA01_INPUT', n, n, 0, 0, 0 FROM files UNION ALL SELECT 'QA02_RAW', n, n, 0, 0, 0 FROM files
 UNION ALL SELECT 'QA03_PROJECTED', 8, 5, 0, 3, sum(n) FROM {UNIT_DUP} UNION ALL SELECT 'QA04_AUXILIARY', 4, 1, 0, 3, (SELECT sum(n) FROM {UNIT_DUP}) + (SELECT count(*) FROM dv WHERE off)
 UNION ALL SELECT 'QA05_SEMANTICS', 5, 5, 0, 0, 0 UNION ALL SELECT 'QA06_RECONCILIATION', count(*), count(*), 0, 0, 0 FROM yr
 UNION ALL SELECT 'QA07_LOCATION', count(*), count(*) FILTER (WHERE u = 0), count(*) FILTER (WHERE u > 0), 0, sum(u) FROM yr)
"""


@query("result_roll_up", ROLL + """SELECT 'batch-1' AS batch_id, rule_id, CAST(object_count AS BIGINT) AS object_count, CAST(pass_count AS BIGINT) AS pass_count, CAST(limited_count AS BIGINT) AS limited_count,
 CAST(block_count AS BIGINT) AS block_count, CAST(affected_count AS BIGINT) AS affected_count, CASE WHEN block_count > 0 THEN 'block' WHEN limited_count > 0 THEN 'limited' ELSE 'pass' END AS result FROM roll""")
def result_roll_up(spark, sf):
    return Q.roll_up(all_results(spark, sf))


@query("publication_gate", ROLL + """SELECT rule_id, reason, CAST(n AS BIGINT) AS finding_count FROM (
 SELECT 'QA03_PROJECTED' AS rule_id, unnest(['block', 'violation', 'metric_mismatch']) AS reason, 3 AS n UNION ALL SELECT 'QA04_AUXILIARY', unnest(['block', 'violation', 'metric_mismatch']), 3
 UNION ALL SELECT 'QA03_PROJECTED', 'missing_summary', 1 UNION ALL SELECT 'QA01_INPUT', 'missing_summary', 1 UNION ALL SELECT 'QA02_RAW', 'missing_summary', 1 UNION ALL SELECT 'QA04_AUXILIARY', 'missing_summary', 1
 UNION ALL SELECT 'QA05_SEMANTICS', 'missing_summary', 1 UNION ALL SELECT 'QA06_RECONCILIATION', 'missing_summary', 1 UNION ALL SELECT 'QA07_LOCATION', 'missing_summary', 1)""")
def publication_gate(spark, sf):
    """Why the batch with its repeated line numbers and without summaries may not be published."""
    g = L.gate_findings(all_results(spark, sf), L.required_objects(spark, t.manifest()))
    reason = F.when((F.col("reason") == "missing") & (F.col("object_key") == "batch"), "missing_summary").otherwise(F.col("reason"))
    return g.groupBy("rule_id", reason.alias("reason")).agg(F.count(F.lit(1)).alias("finding_count"))


@query("recomputed_expectations", t.SQL_BASE + """, y AS (SELECT source_id, y, count(*) FILTER (WHERE mapped) AS m FROM crash GROUP BY ALL)
 SELECT source_id, count(*) AS edited_count, CAST(count(*) FILTER (WHERE m > 0) AS BIGINT) AS refused_count FROM y GROUP BY source_id""")
def recomputed_expectations(spark, sf):
    """Location results of all sources whose map_count was set to zero in what was expected and in what was found: the layers refuse them."""
    rows = all_results(spark, sf).filter("rule_id = 'QA07_LOCATION'")
    zero = F.create_map(F.lit("map_count"), F.lit(0).cast("bigint"))
    edit = lambda side: F.col(side).withField("metrics", F.map_concat(F.map_filter(f"{side}.metrics", lambda k, v: k != "map_count"), zero))
    edited = rows.withColumns({"expected": edit("expected"), "actual": edit("actual")})
    found = L.expectation_findings(edited, L.recomputed(spark, t.frozen(spark, sf), t.crash(spark, sf), t.unit(spark, sf))).withColumn("refused", F.lit(True))
    return (edited.join(found, ["rule_id", "object_key"], "left").groupBy(F.split("object_key", ":")[1].alias("source_id"))
            .agg(F.count(F.lit(1)).alias("edited_count"), F.count("refused").alias("refused_count")))


def _changed(field: str) -> Column:
    return F.map_concat(F.map_filter("payload", lambda k, v: k != field), F.create_map(F.lit(field), F.lit("changed")))


@query("native_reread", t.SQL_BASE + """, f AS (SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY o_orderkey) AS p, o_orderkey AS k FROM crash)
 SELECT source_id, count(*) AS actual_count, true AS header_match, count(*) FILTER (WHERE k % 7 = 0) AS missing_count, count(*) FILTER (WHERE k % 7 = 1) AS payload_mismatch_count,
 CAST(1 AS BIGINT) AS extra_count FROM f GROUP BY source_id""")
def native_reread(spark, sf):
    """Crash files of all sources written as text and read anew, against stored records of which some were lost, changed or added."""
    out, m = [], t.manifest()
    for s in m.sources:
        spec = s.file("crash")
        rows = t.raw(spark, sf).filter((F.col("source_id") == s.source_id) & (F.col("resource_id") == spec.resource_id))
        path = scratch_path(spark, spec.resource_id)
        # One native file for each source, as a publisher would give it.
        cells = rows.select(*[F.col("payload")[h].alias(h) for h in spec.header])
        cells.repartition(1).write.option("header", "true").option("emptyValue", "").option("nullValue", "").csv(path)
        observed, native = read_file(spark, path + "/*.csv", spec)
        number = F.col("payload")[spec.key_fields[0]].cast("long") % 7
        stored = native.filter(number != 0).withColumn("payload", F.when(number == 1, _changed(spec.header[-1])).otherwise(F.col("payload")))
        stored = stored.unionByName(native.filter("row_locator = 'csv:1'").withColumn("row_locator", F.lit("csv:999999999999")))
        counts = G.replay_summary(G.replay_differences(native, stored)).select("resource_id", "missing_count", "payload_mismatch_count", "extra_count")
        out.append(observed.join(counts, "resource_id").select(
            F.lit(s.source_id).alias("source_id"), "actual_count", (F.col("actual_header") == F.array(*[F.lit(h) for h in spec.header])).alias("header_match"),
            "missing_count", "payload_mismatch_count", "extra_count"))
    return reduce(DataFrame.unionByName, out)


@query("location_count_differences", t.SQL_BASE + f""", z AS ({DAMAGE}) SELECT source_id, y AS occurrence_year, count(*) FILTER (WHERE lost) - count(*) FILTER (WHERE doubled) AS row_delta,
 count(*) FILTER (WHERE lost AND mapped) - count(*) FILTER (WHERE doubled AND mapped) AS map_delta FROM z GROUP BY ALL HAVING row_delta <> 0 OR map_delta <> 0""")
def location_count_differences(spark, sf):
    return L.location_count_differences(t.crash(spark, sf), damaged_facts(spark, sf))


@query("current_release", t.SQL_BASE + """SELECT 'synthetic' AS dataset_kind, 'b3' AS batch_id, count(*) AS crash_count FROM crash WHERE y = 1997
 UNION ALL SELECT 'official', 'b2', count(*) FROM crash WHERE y = 1996""")
def current_release(spark, sf):
    """Facts of the batch each kind currently points to: the latest succeeded one, not the later failed one."""
    f = t.fact(spark, sf).withColumn("batch_id", F.concat(F.lit("b"), (F.col("occurrence_year") - 1994).cast("string")))
    rows = [("b1", "synthetic", "succeeded", 1), ("b2", "official", "succeeded", 2), ("b3", "synthetic", "succeeded", 3), ("b4", "synthetic", "failed", 4)]
    log = contract_frame(spark, rows, "batch_id string, dataset_kind string, status string, n int").withColumn("finished_at", F.timestamp_seconds("n"))
    out = sinks.current_rows(sinks.current_pointer(log), f)
    return out.groupBy("dataset_kind", "batch_id").agg(F.count(F.lit(1)).alias("crash_count"))
