"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashmart.plans import reports as R
from crashmart.plans.reports import Request

from . import tables as t
from .registry import query

NAMES = """names(source_id, source_name, jurisdiction_code) AS (VALUES ('africa', 'Africa', 'R0'), ('america', 'America', 'R1'),
 ('asia', 'Asia', 'R2'), ('europe', 'Europe', 'R3'), ('middle_east', 'Middle East', 'R4'))"""

# Declared coverage of catalog.tables.manifest, as rows.
COVER = """cov AS (
  SELECT DISTINCT * FROM (
  SELECT s AS source_id, y, m, b FROM (VALUES ('africa', 1996, 2000, 12, 'publisher table'), ('america', 1996, 1999, 12, 'publisher table'),
   ('america', 2000, 2000, 6, 'half-year note'), ('asia', 1996, 2000, 9, 'first note'), ('asia', 1997, 2001, 12, 'second note'),
   ('europe', 1995, 2001, 12, 'publisher table'), ('middle_east', 1996, 2000, 12, 'publisher table')) v(s, a, z, l, b),
   generate_series(a, z) gy(y), generate_series(1, l) gm(m))
)"""


def _trend_sql(grain: str, sources: list[str] | None, y1: int, y2: int, months: list[int] | None) -> str:
    """The dense report written as one plain SQL statement."""
    month_list = months or list(range(1, 13))
    mlist = ", ".join(map(str, month_list))
    src = "names" if sources is None else "(SELECT * FROM names WHERE source_id IN (" + ", ".join(f"'{s}'" for s in sources) + "))"
    if grain == "month":
        spine = f"SELECT source_id, py, pm FROM {src} s, generate_series({y1}, {y2}) a(py), (SELECT unnest([{mlist}]) AS pm)"
        cjoin = "c.m = p.pm"
        fjoin = "f.m = p.pm"
        requested, excl = 1, "u.n"
    else:
        spine = f"SELECT source_id, py, CAST(NULL AS INTEGER) AS pm FROM {src} s, generate_series({y1}, {y2}) a(py)"
        cjoin = f"c.m IN ({mlist})"
        fjoin = "true" if months is None else f"f.m IN ({mlist})"
        requested, excl = len(month_list), "0" if months is None else "u.n"
    return t.SQL_BASE + f""", {NAMES}, {COVER}, spine AS ({spine}),
pc AS (SELECT p.source_id, py, pm, count(DISTINCT c.m) AS cm, string_agg(DISTINCT c.b, ' | ' ORDER BY c.b) AS basis
       FROM spine p LEFT JOIN cov c ON c.source_id = p.source_id AND c.y = p.py AND {cjoin} GROUP BY ALL),
u AS (SELECT source_id, y, count(*) FILTER (WHERE m IS NULL) AS n FROM crash GROUP BY ALL),
ag AS (SELECT p.source_id, py, pm, cm, basis, count(f.o_orderkey) AS n, count(f.m) AS mk,
       count(f.fatal) AS fk, count(*) FILTER (WHERE f.fatal) AS fv, count(f.deaths) AS dk, sum(f.deaths) AS dv,
       count(f.hurt) AS hk, sum(f.hurt) AS hv
       FROM pc p LEFT JOIN crash f ON f.source_id = p.source_id AND f.y = p.py AND {fjoin} GROUP BY ALL)
SELECT 'synthetic' AS dataset_kind, 'batch-1' AS batch_id, ag.source_id, '{grain}' AS grain, CAST(py AS INTEGER) AS period_year,
  CAST(pm AS INTEGER) AS period_month,
  CASE WHEN cm = 0 THEN 'not_covered' WHEN cm = {requested} THEN 'covered' ELSE 'partial' END AS coverage_status,
  CAST({requested} AS INTEGER) AS requested_month_count, CAST(cm AS INTEGER) AS covered_month_count, basis AS coverage_basis,
  CASE WHEN cm > 0 THEN ag.n END AS crash_count, CASE WHEN cm > 0 THEN mk END AS month_known_count,
  CASE WHEN cm > 0 THEN CAST(coalesce({excl}, 0) AS BIGINT) END AS excluded_unknown_month_count,
  CASE WHEN cm > 0 AND fk > 0 THEN fv END AS fatal_crash_count, CASE WHEN cm > 0 THEN fk END AS fatal_crash_known_count,
  CASE WHEN cm > 0 AND dk > 0 THEN CAST(dv AS BIGINT) END AS fatality_count, CASE WHEN cm > 0 THEN dk END AS fatality_known_count,
  CASE WHEN cm > 0 AND hk > 0 THEN CAST(hv AS BIGINT) END AS casualty_count, CASE WHEN cm > 0 THEN hk END AS casualty_known_count
FROM ag LEFT JOIN u ON u.source_id = ag.source_id AND u.y = ag.py"""


@query("trend_year", _trend_sql("year", None, 1994, 2002, None))
def trend_year(spark, sf):
    return R.trend(t.batch(spark, sf), Request("synthetic", year_from=1994, year_to=2002))


@query("trend_year_months", _trend_sql("year", ["africa", "america"], 1996, 2001, [1, 7, 8]))
def trend_year_months(spark, sf):
    return R.trend(t.batch(spark, sf), Request("synthetic", ("africa", "america"), 1996, 2001, (1, 7, 8)))


@query("trend_month", _trend_sql("month", None, 1995, 2001, None))
def trend_month(spark, sf):
    return R.trend(t.batch(spark, sf), Request("synthetic", grain="month"))


@query("trend_month_months", _trend_sql("month", ["asia"], 1996, 2000, [2, 10]))
def trend_month_months(spark, sf):
    return R.trend(t.batch(spark, sf), Request("synthetic", ("asia",), 1996, 2000, (2, 10), "month"))


def _severity_sql(where: str, y1: int, y2: int) -> str:
    return t.SQL_BASE + f""", def(severity_code, severity_label, definition_text) AS (VALUES ('1-URGENT', 'urgent', 'handled first'),
 ('2-HIGH', 'high', 'handled early'), ('3-MEDIUM', 'medium', 'handled in turn'), ('5-LOW', 'low', 'handled last'),
 ('__MISSING__', 'unknown', 'no category stated'))
SELECT 'synthetic' AS dataset_kind, 'batch-1' AS batch_id, source_id, CAST({y1} AS INTEGER) AS filter_year_from,
 CAST({y2} AS INTEGER) AS filter_year_to, 'severity-v1' AS definition_version, severity_code, severity_label, definition_text,
 count(*) AS crash_count FROM crash JOIN def ON sev = severity_code WHERE {where} GROUP BY ALL"""


@query("severity", _severity_sql("y BETWEEN 1995 AND 2001", 1995, 2001))
def severity(spark, sf):
    return R.severity(t.batch(spark, sf), Request("synthetic")).drop("filter_months")


@query("severity_filtered", _severity_sql("y BETWEEN 1997 AND 1999 AND source_id IN ('europe', 'asia') AND m IN (3, 4)", 1997, 1999))
def severity_filtered(spark, sf):
    return R.severity(t.batch(spark, sf), Request("synthetic", ("europe", "asia"), 1997, 1999, (3, 4))).drop("filter_months")


@query("map_points", t.SQL_BASE + f""", {NAMES} SELECT 'synthetic' AS dataset_kind, 'batch-1' AS batch_id, source_id, source_name,
 jurisdiction_code, 'full' AS release_scope, crash_key, y AS occurrence_year, m AS occurrence_month, sev AS severity_code,
 lat AS latitude, lon AS longitude FROM crash JOIN names USING (source_id) WHERE mapped AND y BETWEEN 1995 AND 2001""")
def map_points(spark, sf):
    df = R.map_points(t.batch(spark, sf), Request("synthetic"))
    return df.withColumns({c: F.col(c).cast("double") for c in ("latitude", "longitude")})


def _coverage_sql(where: str, y1: int, y2: int) -> str:
    return t.SQL_BASE + f"""SELECT 'synthetic' AS dataset_kind, 'batch-1' AS batch_id, CAST({y1} AS INTEGER) AS filter_year_from,
 CAST({y2} AS INTEGER) AS filter_year_to, count(*) AS crash_count, count(*) FILTER (WHERE mapped) AS point_count,
 CASE WHEN count(*) > 0 THEN CAST((count(*) FILTER (WHERE mapped) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 100 END
 AS coverage_percentage FROM crash WHERE {where}"""


@query("map_coverage", _coverage_sql("y BETWEEN 1995 AND 2001", 1995, 2001))
def map_coverage(spark, sf):
    df = R.map_coverage(t.batch(spark, sf), Request("synthetic")).drop("filter_source_ids", "filter_months")
    return df.withColumn("coverage_percentage", F.col("coverage_percentage").cast("double"))


@query("map_coverage_filtered", _coverage_sql("y BETWEEN 1998 AND 1998 AND source_id IN ('america', 'europe') AND m = 12", 1998, 1998))
def map_coverage_filtered(spark, sf):
    df = R.map_coverage(t.batch(spark, sf), Request("synthetic", ("america", "europe"), 1998, 1998, (12,)))
    return df.drop("filter_source_ids", "filter_months").withColumn("coverage_percentage", F.col("coverage_percentage").cast("double"))


@query("map_coverage_empty", _coverage_sql("y BETWEEN 2050 AND 2051", 2050, 2051))
def map_coverage_empty(spark, sf):
    df = R.map_coverage(t.batch(spark, sf), Request("synthetic", year_from=2050, year_to=2051))
    return df.drop("filter_source_ids", "filter_months").withColumn("coverage_percentage", F.col("coverage_percentage").cast("double"))


def _units_sql(where: str) -> str:
    return t.SQL_BASE + f""", {NAMES} SELECT 'synthetic' AS dataset_kind, 'batch-1' AS batch_id, source_id, source_name, jurisdiction_code,
 scope AS statistical_scope, kind AS unit_type_code, count(*) AS unit_count FROM unit JOIN names USING (source_id)
 WHERE kind IS NOT NULL AND {where} GROUP BY ALL"""


@query("unit_counts", _units_sql("y BETWEEN 1995 AND 2001"))
def unit_counts(spark, sf):
    return R.unit_counts(t.batch(spark, sf), Request("synthetic"))


@query("unit_counts_filtered", _units_sql("y BETWEEN 1996 AND 1999 AND m IN (1, 2, 3)"))
def unit_counts_filtered(spark, sf):
    return R.unit_counts(t.batch(spark, sf), Request("synthetic", year_from=1996, year_to=1999, months=(1, 2, 3)))


@query("unit_counts_membership", _units_sql("y BETWEEN 1996 AND 1999 AND m IN (1, 2, 3)"))
def unit_counts_membership(spark, sf):
    return R.unit_counts_by_membership(t.batch(spark, sf), Request("synthetic", year_from=1996, year_to=1999, months=(1, 2, 3)))


@query("batch_context", t.SQL_BASE + f""", {NAMES} SELECT source_id, source_name, jurisdiction_code, 'r1' AS release_label,
 'full' AS release_scope, count(*) AS crash_count, min(y) AS first_year, max(y) AS last_year
 FROM names JOIN crash USING (source_id) GROUP BY ALL""")
def batch_context(spark, sf):
    """Batch sources with the years their facts actually span."""
    b = t.batch(spark, sf)
    years = b.fact.groupBy("source_id").agg(F.count(F.lit(1)).alias("crash_count"), F.min("occurrence_year").alias("first_year"),
                                            F.max("occurrence_year").alias("last_year"))
    return R.batch_sources(b, "synthetic").drop("dataset_kind", "batch_id").join(years, "source_id")


@query("source_totals", t.SQL_BASE + """SELECT source_id, count(*) AS crash_count, count(*) FILTER (WHERE fatal) AS fatal_crash_count,
 CAST(sum(deaths) AS BIGINT) AS fatality_count, CAST(sum(hurt) AS BIGINT) AS casualty_count,
 count(*) FILTER (WHERE mapped) AS map_count FROM crash GROUP BY ALL""")
def source_totals(spark, sf):
    return R.source_totals(t.crash(spark, sf))


@query("report_bundle", t.SQL_BASE + """SELECT * FROM (
 SELECT 'coverage' AS report, CAST(1 AS BIGINT) AS row_count UNION ALL
 SELECT 'points', count(*) FILTER (WHERE mapped AND y BETWEEN 1996 AND 2000) FROM crash UNION ALL
 SELECT 'severity', count(DISTINCT (source_id, sev)) FILTER (WHERE y BETWEEN 1996 AND 2000) FROM crash UNION ALL
 SELECT 'sources', 5 UNION ALL SELECT 'trend', 25 UNION ALL
 SELECT 'units', count(DISTINCT (source_id, scope, kind)) FILTER (WHERE kind IS NOT NULL AND y BETWEEN 1996 AND 2000) FROM unit)""")
def report_bundle(spark, sf):
    """All reports of one pinned batch; the result states how many rows each returned."""
    parts = R.bundle(t.batch(spark, sf), Request("synthetic", year_from=1996, year_to=2000))
    counted = [df.agg(F.lit(name).alias("report"), F.count(F.lit(1)).alias("row_count")) for name, df in sorted(parts.items())]
    out = counted[0]
    for c in counted[1:]:
        out = out.unionByName(c)
    return out


@query("limited_report", t.SQL_BASE + """SELECT 'europe' AS source_id, 'map' AS report, 'unavailable' AS status, 'maps are withheld' AS reason,
 CAST(NULL AS BIGINT) AS row_count UNION ALL
 SELECT 'europe', 'severity', 'available', NULL, count(DISTINCT sev) FROM crash WHERE source_id = 'europe'""")
def limited_report(spark, sf):
    """A withheld report is stated as unavailable with NULL rows, next to an available one of the same source."""
    from dataclasses import replace
    b = t.batch(spark, sf)
    sources = tuple(replace(s, unavailable=(("map", "maps are withheld"),)) if s.source_id == "europe" else s for s in b.manifest.sources)
    b = replace(b, manifest=replace(b.manifest, sources=sources))
    out = None
    for name in ("map", "severity"):
        a = R.limited_report(b, "europe", name, Request("synthetic"))
        count = F.count(F.lit(1)) if a.rows is not None else F.lit(None).cast("bigint")
        rows = a.rows if a.rows is not None else b.sources.limit(1)
        line = rows.agg(count.alias("row_count")).select(F.lit("europe").alias("source_id"), F.lit(name).alias("report"),
                                                          F.lit(a.status).alias("status"), F.lit(a.reason).cast("string").alias("reason"),
                                                          "row_count")
        out = line if out is None else out.unionByName(line)
    return out
