"""Source profiles over the test tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from crashmart.contracts import Source
from crashmart.functions.dates import month_number
from crashmart.model import contract_frame
from crashmart.plans import profiles as R
from crashmart.plans.links import union_findings
from crashmart.sources.records import select_file

from . import tables as t
from .registry import query

# By the key field of the crash file: parts, total and category of the four native forms.
PARTS = {"Crash ID": ("No. killed", "No. serious"), "ACC_NO": ("KILLED", "INJ_2"), "Ref_Number": ("Count_Fatality", "Count_Hospitalised", "Count_Minor"), "CRASH_ID": ("FATALITIES",)}
TOTAL = {"Crash ID": "No. of units", "ACC_NO": "NO_OF_VEHICLES", "Ref_Number": "Count_Total", "CRASH_ID": "CASUALTIES"}
WIDE = {"Crash ID": ("No. killed", "No. serious", "No. minor"), "ACC_NO": ("KILLED", "INJ_2", "INJ_3"),
        "Ref_Number": ("Count_Fatality", "Count_Hospitalised", "Count_Minor"), "CRASH_ID": ("FATALITIES", "CASUALTIES")}
CATEGORY = {"Crash ID": "Degree", "ACC_NO": "SEVERITY", "Ref_Number": "Crash_Severity", "CRASH_ID": "SEVERITY"}


def _file(spark, sf, source: Source, role: str) -> DataFrame:
    """One native file as text columns."""
    spec = source.file(role)
    return select_file(t.raw(spark, sf), spec).select("row_locator", *[F.try_element_at("payload", F.lit(h)).alias(h) for h in spec.header])


def _native(spark, sf, source: Source) -> DataFrame:
    """A crash file as text columns with year and month numbers, all years."""
    df, form = _file(spark, sf, source, "crash"), source.file("crash").header[0]
    year, month = {
        "Crash ID": lambda: (F.col("`Year of crash`"), month_number("`Month of crash`")),
        "ACC_NO": lambda: (F.substring("ACC_DATE", 1, 4), F.substring("ACC_DATE", 6, 2).try_cast("int")),
        "Ref_Number": lambda: (F.col("Crash_Year"), month_number("Crash_Month")),
        "CRASH_ID": lambda: (F.col("YEAR"), F.col("MONTH").try_cast("int"))}[form]()
    return df.withColumn("year_no", year.try_cast("int")).withColumn("month_no", month)


def _each(profile) -> DataFrame:
    """A profile of every source, stacked. profile(source, key field of its crash file)"""
    parts = [profile(s, s.file("crash").header[0]).withColumn("source_id", F.lit(s.source_id)) for s in t.manifest().sources]
    return reduce(DataFrame.unionByName, parts)


def _inside():
    return F.col("year_no").between(1996, 2000)


ALL = t.SQL_BASE + """, n AS (SELECT *, y BETWEEN 1996 AND 2000 AS inside, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority ELSE '__MISSING__' END AS native_sev,
  fa IS NULL OR (source_id = 'asia' AND o_orderpriority = '5-LOW') AS unknown, CASE source_id WHEN 'asia' THEN fa + fn + fr WHEN 'europe' THEN fa ELSE fa + fn END AS parts,
  CASE WHEN source_id IN ('asia', 'europe') THEN fa + fn + fr ELSE o_orderkey % 8 END AS total FROM crash)
"""


@query("profile_grain", ALL + """SELECT source_id, count(*) AS full_source_rows, CAST(0 AS BIGINT) AS blank_keys, count(*) AS distinct_nonblank_keys, CAST(0 AS BIGINT) AS duplicate_or_blank_keys,
 count(*) FILTER (WHERE inside) AS analysis_rows FROM n GROUP BY source_id""")
def profile_grain(spark, sf):
    return _each(lambda s, key: R.grain(_native(spark, sf, s), key, _inside()))


@query("profile_key_examples", ALL + """SELECT source_id, CAST(o_orderkey AS VARCHAR) AS crash_id, year_no FROM (
 SELECT source_id, o_orderkey, y AS year_no, row_number() OVER (PARTITION BY source_id ORDER BY o_orderkey) AS rn FROM n WHERE inside) WHERE rn <= 5""")
def profile_key_examples(spark, sf):
    """First five rows of every source in native order (a top-k report)."""
    from crashmart.functions.locators import locator_order
    return _each(lambda s, key: R.key_examples(_native(spark, sf, s).filter(_inside()).withColumn("crash_id", F.col(f"`{key}`")),
                                               [locator_order("row_locator")], ["crash_id", "year_no"]))


@query("profile_months", ALL + "SELECT source_id, y AS year_no, m AS month_no, count(*) AS row_count FROM n WHERE inside GROUP BY ALL")
def profile_months(spark, sf):
    return _each(lambda s, key: R.month_coverage(_native(spark, sf, s).filter(_inside()), "year_no", "month_no"))


@query("profile_categories", ALL + """SELECT s.source_id, c.native_value, c.display_order, count(o_orderkey) AS row_count FROM (SELECT DISTINCT source_id FROM n) s
 CROSS JOIN (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('3-MEDIUM', 3), ('5-LOW', 4), ('6-NONE', 5), ('__MISSING__', 6)) c(native_value, display_order)
 LEFT JOIN n ON n.source_id = s.source_id AND native_sev = c.native_value GROUP BY ALL""")
def profile_categories(spark, sf):
    cats = contract_frame(spark, [(v, i) for i, v in enumerate(("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW", "6-NONE", "__MISSING__"), 1)], "native_value string, display_order int")
    return _each(lambda s, key: R.category_counts(_native(spark, sf, s), CATEGORY[key], cats, "__MISSING__"))


@query("profile_count_quality", ALL + """SELECT source_id, count(*) FILTER (WHERE unknown) AS rows_with_missing_count, count(*) FILTER (WHERE unknown) AS rows_with_invalid_count,
 count(*) FILTER (WHERE NOT unknown AND parts <> total) AS component_mismatch_rows, CAST(sum(fa) FILTER (WHERE NOT unknown) AS BIGINT) AS first_part_sum,
 CAST(sum(total) FILTER (WHERE NOT unknown) AS BIGINT) AS total_sum FROM n GROUP BY source_id""")
def profile_count_quality(spark, sf):
    """Unknown, invalid and inconsistent counts of every source; an empty token is both missing and no number."""
    return _each(lambda s, key: R.count_quality(_native(spark, sf, s), list(PARTS[key]), TOTAL[key], PARTS[key][0]))


@query("profile_wide_totals", ALL + """, l AS (SELECT source_id, unnest(CASE source_id WHEN 'asia' THEN ['Count_Fatality', 'Count_Hospitalised', 'Count_Minor'] WHEN 'america' THEN ['KILLED', 'INJ_2', 'INJ_3']
   WHEN 'europe' THEN ['FATALITIES', 'CASUALTIES'] ELSE ['No. killed', 'No. serious', 'No. minor'] END) AS category,
  unnest(CASE source_id WHEN 'asia' THEN [fa, fn, CASE WHEN o_orderpriority <> '5-LOW' THEN fr END] WHEN 'europe' THEN [fa, fa + fn + fr] ELSE [fa, fn, fr] END) AS v FROM n)
 SELECT source_id, category, count(*) FILTER (WHERE v IS NULL) AS missing_rows, count(*) FILTER (WHERE v IS NULL) AS invalid_rows, CAST(sum(v) AS BIGINT) AS aggregate_sum,
 count(*) FILTER (WHERE v > 0) AS rows_above_zero FROM l GROUP BY ALL""")
def profile_wide_totals(spark, sf):
    return _each(lambda s, key: R.wide_totals(_native(spark, sf, s), list(WIDE[key])))


@query("profile_coordinates", ALL + """SELECT source_id, count(*) AS analysis_rows, count(*) FILTER (WHERE there) AS native_coordinate_rows, count(*) FILTER (WHERE NOT there) AS missing_coordinate_rows,
 'GDA2020' AS source_crs, false AS published_map_available, 'definition_unconfirmed' AS reason_code FROM (
  SELECT source_id, NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS there FROM n WHERE source_id <> 'america' UNION ALL SELECT 'america', true FROM seen) GROUP BY source_id""")
def profile_coordinates(spark, sf):
    """Native coordinates of every source, from the file that holds them: crash rows, or observations where a source has such a file."""
    def one(s: Source, key: str) -> DataFrame:
        df = _file(spark, sf, s, "node_raw" if s.location.style == "observations" else "crash")
        return R.coordinate_presence(df, s.location.latitude_field, s.location.longitude_field, "GDA2020", "definition_unconfirmed")
    return _each(one)


@query("profile_boundary", t.SQL_BASE + """SELECT count(*) AS crash_count, count(*) FILTER (WHERE mapped) AS published_map_count, count(*) FILTER (WHERE NOT mapped) AS published_unmapped_count, (SELECT count(*) FROM unit) AS canonical_unit_count FROM crash""")
def profile_boundary(spark, sf):
    return R.published_boundary(t.crash(spark, sf), t.unit(spark, sf))


@query("file_key_stats", """SELECT 'lineitem' AS file, count(*) AS row_count, CAST(0 AS BIGINT) AS blank_key_rows, count(DISTINCT (l_orderkey, l_linenumber)) AS distinct_key_count,
 (SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)) AS duplicate_key_groups, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS duplicate_extra_rows FROM lineitem
 UNION ALL SELECT 'orders', count(*), 0, count(*), 0, 0 FROM orders""")
def file_key_stats(spark, sf):
    li = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").cast("string").alias("a"), F.col("l_linenumber").cast("string").alias("b"))
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("a"))
    return R.key_stats(li, ["a", "b"]).withColumn("file", F.lit("lineitem")).unionByName(R.key_stats(o, ["a"]).withColumn("file", F.lit("orders")))


DAYS = "WITH d AS (SELECT CASE WHEN l_tax = 0 THEN NULL ELSE l_shipdate END AS v FROM lineitem)\n"


def _days(spark, sf) -> DataFrame:
    """Ship dates as text, damaged on untaxed lines."""
    day = F.date_format("l_shipdate", "yyyy-MM-dd")
    return t.table(spark, sf, "lineitem").select(F.when(F.col("l_tax") == 0, F.concat(day, F.lit("?"))).otherwise(day).alias("token"))


@query("date_profile", DAYS + "SELECT strftime(min(v), '%Y-%m-%d') AS date_min, strftime(max(v), '%Y-%m-%d') AS date_max, count(*) FILTER (WHERE v IS NULL) AS invalid_date_count FROM d")
def date_profile(spark, sf):
    return R.date_profile(_days(spark, sf), "token")


@query("rows_by_period", DAYS + """SELECT strftime(v, '%Y') AS period, count(*) AS row_count FROM d WHERE v IS NOT NULL GROUP BY 1 UNION ALL
 SELECT strftime(v, '%Y-%m'), count(*) FROM d WHERE v IS NOT NULL GROUP BY 1""")
def rows_by_period(spark, sf):
    return R.rows_by_period(_days(spark, sf), "token")


@query("token_histogram", """SELECT field, token, count(*) AS row_count FROM (SELECT unnest(['l_returnflag', 'l_linestatus', 'l_linenumber']) AS field,
 unnest([l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR)]) AS token FROM lineitem) GROUP BY ALL""")
def token_histogram(spark, sf):
    return R.token_histogram(t.table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus", "l_linenumber"])


@query("component_mismatches", t.SQL_BASE + """SELECT source_id, CAST(o_orderkey AS VARCHAR) AS crash_id FROM base WHERE source_id IN ('africa', 'america', 'middle_east') AND fa + fn <> o_orderkey % 8""")
def component_mismatches(spark, sf):
    """Killed and serious against the declared number of units, in every source that declares one."""
    p = lambda *names: F.coalesce(*[F.try_element_at("payload", F.lit(f)) for f in names])
    specs = [s.file("crash") for s in t.manifest().sources if s.units]
    df = reduce(DataFrame.unionByName, [select_file(t.raw(spark, sf), spec) for spec in specs]).select(
        "source_id", p("Crash ID", "ACC_NO").alias("crash_id"), p("No. killed", "KILLED").alias("a"), p("No. serious", "INJ_2").alias("b"),
        p("No. of units", "NO_OF_VEHICLES").alias("total"))
    return R.component_mismatches(df, ["a", "b"], "total").select("source_id", "crash_id")


@query("coordinate_groups", t.SQL_BASE + """, g AS (SELECT k, count(*) AS n, count(*) FILTER (WHERE NOT ok) AS bad, count(DISTINCT CASE WHEN ok THEN (la, lo) END) AS p
 FROM (SELECT *, la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 AS ok FROM seen) GROUP BY k)
 SELECT count(*) AS group_count, count(*) FILTER (WHERE n > 1) AS duplicate_groups, count(*) FILTER (WHERE p > 1) AS multiple_coordinate_groups, count(*) FILTER (WHERE bad > 0) AS groups_with_invalid_coordinates FROM g""")
def coordinate_groups(spark, sf):
    from .projection import _observations
    return R.coordinate_groups(_observations(spark, sf), ["acc", "node"], "lat_text", "lon_text")


def _findings(spark, sf) -> DataFrame:
    """Three kinds of findings located in the lineitems and their orders."""
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_tax", "l_discount")
    o = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").alias("year"))
    li = li.join(o, "l_orderkey", "left")
    return union_findings({"untaxed": li.filter("l_tax = 0"), "undiscounted": li.filter("l_discount = 0"), "line_seven": li.filter("l_linenumber = 7")},
                          ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "year"])


FIND = """WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_tax, l_discount, CAST(year(o_orderdate) AS INTEGER) AS year FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey),
 f AS (SELECT 'untaxed' AS finding, * FROM x WHERE l_tax = 0 UNION ALL SELECT 'undiscounted', * FROM x WHERE l_discount = 0 UNION ALL SELECT 'line_seven', * FROM x WHERE l_linenumber = 7)
"""


@query("finding_counts", FIND + "SELECT finding, year, count(*) AS row_count FROM f GROUP BY ALL")
def finding_counts(spark, sf):
    return R.finding_counts(_findings(spark, sf), "year")


@query("finding_examples", FIND + """SELECT finding, l_orderkey, l_linenumber, l_partkey, l_suppkey, year, CAST(rn AS INTEGER) AS example_no FROM (
 SELECT *, row_number() OVER (PARTITION BY finding ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM f) WHERE rn <= 5""")
def finding_examples(spark, sf):
    """Five located examples per finding (a top-k report)."""
    return R.finding_examples(_findings(spark, sf), [F.asc(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
