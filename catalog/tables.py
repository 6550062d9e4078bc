"""The test tables and their stand-in roles.

Orders play the crash records of five publishers (their customer's region), lineitems play units and observations. Native
text rows are derived from the typed tables, so every query below runs the library from raw text upwards.
"""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from crashmart.contracts import (
    CRS, MISSING_CODE, Category, CountRule, Coverage, DateRule, FileSpec, LocationRule, Manifest, SeverityRule, Source, UnitRule,
)
from crashmart.functions.dates import MONTHS
from crashmart.functions.hashing import record_id
from crashmart.model import RAW_SCHEMA
from crashmart.plans.project import project_crash, project_unit
from crashmart.plans.reports import Batch
from crashmart.plans.warehouse import dim_severity, dim_source, facts
from crashmart.session import SCRATCH, scratch_path

BATCH = "batch-1"
YEAR_FROM, YEAR_TO = 1995, 2001
SOURCES = ("africa", "america", "asia", "europe", "middle_east")
VERSION = "severity-v1"

_stages: dict[tuple[str, str, str], tuple[str, StructType]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def staged(spark: SparkSession, sf_dir: str, name: str, build, partition_by: list[str]) -> DataFrame:
    """A pipeline stage written once per application to the shared folder and read back partitioned."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _stages:
        df, path = build(), scratch_path(spark, name)
        df.write.options(**SCRATCH).partitionBy(*partition_by).parquet(path)
        _stages[key] = (path, df.schema)
    path, schema = _stages[key]
    return spark.read.schema(schema).parquet(path).select(*schema.fieldNames())


# ------------------------------------------------------------------------------------------------------------ contracts

def _sha(resource: str) -> str:
    return hashlib.sha256(resource.encode()).hexdigest()


CATEGORIES = (("1-URGENT", Category("1-URGENT", "urgent", True, "handled first")),
              ("2-HIGH", Category("2-HIGH", "high", False, "handled early")),
              ("3-MEDIUM", Category("3-MEDIUM", "medium", False, "handled in turn")),
              ("5-LOW", Category("5-LOW", "low", False, "handled last")))
MISSING = Category(MISSING_CODE, "unknown", None, "no category stated")
UNIT_TYPES = (("A", "CAR"), ("N", "BIKE"), ("R", "TRUCK"))
EVERY_MONTH = tuple(range(1, 13))

FORM_A = ("Crash ID", "Year of crash", "Month of crash", "Degree", "Latitude", "Longitude", "No. of units", "No. killed",
          "No. serious", "No. minor")
FORM_B = ("ACC_NO", "ACC_DATE", "SEVERITY", "KILLED", "INJ_2", "INJ_3", "NODE_ID", "NO_OF_VEHICLES")
FORM_C = ("Ref_Number", "Crash_Year", "Crash_Month", "Crash_Severity", "Crash_Latitude", "Crash_Longitude", "Count_Fatality",
          "Count_Hospitalised", "Count_Minor", "Count_Total")
FORM_D = ("CRASH_ID", "YEAR", "MONTH", "SEVERITY", "FATALITIES", "CASUALTIES", "LATITUDE", "LONGITUDE")
UNIT_A = ("Crash ID", "Unit ID", "Type group")
UNIT_B = ("ACC_NO", "VEHICLE_ID", "VEHICLE_TYPE")
NODE_B = ("ACC_NO", "NODE_ID", "LATITUDE", "LONGITUDE")


def _file(source: str, role: str, header: tuple[str, ...], keys: tuple[str, ...], parent: tuple[str, ...] = (),
          crash: tuple[str, ...] = ()) -> FileSpec:
    resource = f"{source}_{role}"
    return FileSpec(resource, source, role, header, keys, _sha(resource),
                    parent_resource_id=f"{source}_crash" if parent else None, parent_fields=parent, parent_crash_fields=crash)


def _severity(field: str, override: Category | None = None) -> SeverityRule:
    return SeverityRule(field, VERSION, CATEGORIES, MISSING, override)


def _cover(*parts: tuple[int, int, int, str]) -> tuple[Coverage, ...]:
    return tuple(Coverage(a, b, tuple(range(1, last + 1)), basis) for a, b, last, basis in parts)


def _form_a(source: str, place: str, crs: str | None, coverage) -> Source:
    return Source(
        source, source.replace("_", " ").title(), place, "r1", "full",
        (_file(source, "crash", FORM_A, ("Crash ID",)),
         _file(source, "unit", UNIT_A, ("Crash ID", "Unit ID"), ("Crash ID",), ("Crash ID",))),
        _severity("Degree"), DateRule("month_name", "Year of crash", "Month of crash", r"\A[0-9]{1,4}\z"),
        CountRule("No. killed", ("No. killed", "No. serious", "No. minor")),
        LocationRule("own", "Latitude", "Longitude", crs),
        UnitRule("Type group", UNIT_TYPES, f"{source}_traffic_unit", declared_field="No. of units"), coverage)


def manifest() -> Manifest:
    """Five sources in four native forms; coverage is full, partial, split over two bases, or absent at the edges."""
    africa = _form_a("africa", "R0", CRS, _cover((1996, 2000, 12, "publisher table")))
    america = Source(
        "america", "America", "R1", "r1", "full",
        (_file("america", "crash", FORM_B, ("ACC_NO",)),
         _file("america", "unit", UNIT_B, ("ACC_NO", "VEHICLE_ID"), ("ACC_NO",), ("ACC_NO",)),
         _file("america", "node_raw", NODE_B, ("ACC_NO", "NODE_ID"), ("ACC_NO", "NODE_ID"), ("ACC_NO", "NODE_ID"))),
        _severity("SEVERITY"), DateRule("date", "ACC_DATE", year_min=1, year_max=9999),
        CountRule("KILLED", ("KILLED", "INJ_2", "INJ_3")),
        LocationRule("observations", "LATITUDE", "LONGITUDE", CRS, observation_key=("ACC_NO", "NODE_ID"),
                     crash_key=("ACC_NO", "NODE_ID")),
        UnitRule("VEHICLE_TYPE", UNIT_TYPES, "america_vehicle", declared_field="NO_OF_VEHICLES"),
        _cover((1996, 1999, 12, "publisher table"), (2000, 2000, 6, "half-year note")))
    asia = Source(
        "asia", "Asia", "R2", "r1", "full", (_file("asia", "crash", FORM_C, ("Ref_Number",)),),
        _severity("Crash_Severity"), DateRule("month_name", "Crash_Year", "Crash_Month", year_min=1, year_max=9999),
        CountRule("Count_Fatality", ("Count_Fatality", "Count_Hospitalised", "Count_Minor"), "declared_with_parts", "Count_Total"),
        LocationRule("own", "Crash_Latitude", "Crash_Longitude", CRS, "definition_unconfirmed"), None,
        _cover((1996, 2000, 9, "first note"), (1997, 2001, 12, "second note")))
    europe = Source(
        "europe", "Europe", "R3", "r1", "full", (_file("europe", "crash", FORM_D, ("CRASH_ID",)),),
        _severity("SEVERITY", CATEGORIES[3][1]), DateRule("month_number", "YEAR", "MONTH", month_required=True),
        CountRule("FATALITIES", (), "declared", "CASUALTIES", fatality_within_total=True),
        LocationRule("own", "LATITUDE", "LONGITUDE", CRS), None, _cover((1995, 2001, 12, "publisher table")))
    middle = _form_a("middle_east", "R4", None, _cover((1996, 2000, 12, "publisher table")))
    return Manifest("synthetic", YEAR_FROM, YEAR_TO, (africa, america, asia, europe, middle)).validate()


# ----------------------------------------------------------------------------------------------------------- native rows

def base_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with source, line counts by flag and whole cents. Dimensions are left to Spark's own size-based choice."""
    place = (table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
             .join(table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), F.col("c_nationkey") == F.col("n_nationkey"))
             .join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
             .select("c_custkey", F.lower(F.replace("r_name", F.lit(" "), F.lit("_"))).alias("source_id")))
    flag = lambda f: F.count_if(F.col("l_returnflag") == f)
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        flag("A").alias("fa"), flag("N").alias("fn"), flag("R").alias("fr"))
    return (table(spark, sf_dir, "orders").join(place, F.col("o_custkey") == F.col("c_custkey"))
            .join(lines, "o_orderkey", "left").withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint")))


def _payload(values: dict[str, F.Column]) -> F.Column:
    return F.map_from_arrays(F.array(*[F.lit(k) for k in values]),
                             F.array(*[F.coalesce(v.cast("string"), F.lit("")) for v in values.values()]))


def _records(df: DataFrame, spec: FileSpec, number: F.Column, unique: list[F.Column], values: dict[str, F.Column]) -> DataFrame:
    assert tuple(values) == spec.header
    identity = [F.lit(spec.resource_id), F.lit(spec.file_sha256), F.lit(spec.parser_version), *unique]
    return df.select(
        record_id(*identity).alias("raw_record_id"), F.lit(spec.source_id).alias("source_id"),
        F.lit(spec.resource_id).alias("resource_id"), F.lit(spec.file_sha256).alias("file_sha256"),
        F.lit(spec.parser_version).alias("parser_version"), F.concat(F.lit("csv:"), number).alias("row_locator"),
        _payload(values).alias("payload"))


def build_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Native text records of all nine files of the five sources."""
    # Nine files are projections of the same orders: these are joined once and written.
    m, orders = manifest(), staged(spark, sf_dir, "base_orders", lambda: base_orders(spark, sf_dir), ["source_id"])
    key, status, priority = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    names = F.array(*[F.lit(n) for n in MONTHS])
    month = F.element_at(names, F.month("o_orderdate"))
    known_month = F.when(status != "P", month)
    category = F.when(priority != "4-NOT SPECIFIED", priority)
    lat = F.expr("cast(cast(cents % 2000000 as decimal(18,0)) * 0.0001 - 100 as string)")
    lon = F.expr("cast(cast(cents % 3700000 as decimal(18,0)) * 0.0001 - 185 as string)")
    place = ~((status == "F") & (priority == "5-LOW"))
    lat, lon = F.when(place, lat), F.when(place, lon)
    fa, fn, fr = F.col("fa"), F.col("fn"), F.col("fr")
    total = fa + fn + fr
    one = [key]
    of = lambda s: orders.filter(F.col("source_id") == s)
    declared = key % 8

    def form_a(s: str) -> DataFrame:
        return _records(of(s), m.source(s).file("crash"), key + 1, one, {
            "Crash ID": key, "Year of crash": F.year("o_orderdate"), "Month of crash": known_month, "Degree": category,
            "Latitude": lat, "Longitude": lon, "No. of units": declared, "No. killed": fa, "No. serious": fn, "No. minor": fr})

    lines = (table(spark, sf_dir, "lineitem")
             .join(orders.select(key.alias("l_orderkey"), "source_id"), "l_orderkey"))
    ln = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    # Line numbers repeat within an order, so the native position spells out the whole row identity.
    position = F.expr("cast(cast(l_orderkey as decimal(14,0)) * 10 + l_linenumber as decimal(15,0))")
    position = F.concat(position.cast("string"), F.lpad(F.col("l_partkey").cast("string"), 12, "0"), F.lpad(F.col("l_suppkey").cast("string"), 10, "0"))
    kind = F.when(F.col("l_linenumber") != 7, F.col("l_returnflag"))

    def units(s: str, names: tuple[str, str, str]) -> DataFrame:
        return _records(lines.filter(F.col("source_id") == s), m.source(s).file("unit"), position, ln,
                        {names[0]: F.col("l_orderkey"), names[1]: F.col("l_linenumber"), names[2]: kind})

    observed = lines.filter((F.col("source_id") == "america") & (F.col("l_returnflag") == "A"))
    parts = [
        form_a("africa"), form_a("middle_east"),
        _records(of("america"), m.source("america").file("crash"), key + 1, one, {
            "ACC_NO": key, "ACC_DATE": F.date_format("o_orderdate", "yyyy-MM-dd"), "SEVERITY": category, "KILLED": fa,
            "INJ_2": fn, "INJ_3": fr, "NODE_ID": F.lit("NA"), "NO_OF_VEHICLES": declared}),
        _records(of("asia"), m.source("asia").file("crash"), key + 1, one, {
            "Ref_Number": key, "Crash_Year": F.year("o_orderdate"), "Crash_Month": known_month, "Crash_Severity": category,
            "Crash_Latitude": lat, "Crash_Longitude": lon, "Count_Fatality": fa, "Count_Hospitalised": fn,
            "Count_Minor": F.when(priority != "5-LOW", fr), "Count_Total": total}),
        _records(of("europe"), m.source("europe").file("crash"), key + 1, one, {
            "CRASH_ID": key, "YEAR": F.year("o_orderdate"), "MONTH": F.date_format("o_orderdate", "MM"), "SEVERITY": category,
            "FATALITIES": fa, "CASUALTIES": total, "LATITUDE": lat, "LONGITUDE": lon}),
        units("africa", UNIT_A), units("middle_east", UNIT_A), units("america", UNIT_B),
        _records(observed, m.source("america").file("node_raw"), position, ln, {
            "ACC_NO": F.col("l_orderkey"), "NODE_ID": F.lit("NA"),
            "LATITUDE": F.concat((F.col("l_suppkey") % 200 - 95).cast("string"), F.lit(".5")),
            "LONGITUDE": F.concat((F.col("l_linenumber") * 60 - 200).cast("string"), F.lit(".25"))}),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*RAW_SCHEMA.fieldNames())


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "raw", lambda: build_raw(spark, sf_dir), ["source_id", "resource_id"])


def frozen(spark: SparkSession, sf_dir: str) -> Manifest:
    """The manifest with the observed row count of each of the nine files."""
    rows = raw(spark, sf_dir).groupBy("resource_id").count().collect()   # one row per declared file
    return manifest().with_counts({r["resource_id"]: r["count"] for r in rows})


def crash(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = raw(spark, sf_dir)
        return reduce(DataFrame.unionByName, [project_crash(rows, s, BATCH, YEAR_FROM, YEAR_TO)[0] for s in manifest().sources])
    return staged(spark, sf_dir, "crash", build, ["source_id"])


def unit(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build() -> DataFrame:
        rows = raw(spark, sf_dir)
        return reduce(DataFrame.unionByName, [project_unit(rows, s, BATCH, YEAR_FROM, YEAR_TO) for s in manifest().sources if s.units])
    return staged(spark, sf_dir, "unit", build, ["source_id"])


def fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "fact", lambda: facts(crash(spark, sf_dir)), ["source_id"])


def batch(spark: SparkSession, sf_dir: str) -> Batch:
    m = manifest()
    return Batch(BATCH, m.dataset_kind, "succeeded", m, fact(spark, sf_dir), unit(spark, sf_dir),
                 dim_source(spark, m, BATCH), dim_severity(spark, m, BATCH))


# --------------------------------------------------------------------------------------------------------- SQL side

SQL_BASE = """
WITH li AS (
  SELECT l_orderkey AS k, count(*) FILTER (WHERE l_returnflag = 'A') AS fa, count(*) FILTER (WHERE l_returnflag = 'N') AS fn,
         count(*) FILTER (WHERE l_returnflag = 'R') AS fr FROM lineitem GROUP BY 1
), place AS (
  SELECT c_custkey, lower(replace(r_name, ' ', '_')) AS source_id
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), base AS (
  SELECT o.*, source_id, fa, fn, fr, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
         NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW') AS placed
  FROM orders o JOIN place ON o_custkey = c_custkey LEFT JOIN li ON k = o_orderkey
), seen AS (
  SELECT l_orderkey AS k, CAST((l_suppkey % 200 - 95) || '.5' AS DECIMAL(18,4)) AS la,
         CAST((l_linenumber * 60 - 200) || '.25' AS DECIMAL(18,4)) AS lo
  FROM lineitem JOIN base ON l_orderkey = o_orderkey WHERE source_id = 'america' AND l_returnflag = 'A'
), node AS (
  SELECT k, count(*) AS observations, bool_or(la NOT BETWEEN -90 AND 90 OR lo NOT BETWEEN -180 AND 180) AS bad,
         count(DISTINCT (la, lo)) AS pairs, min(la) AS la, min(lo) AS lo FROM seen GROUP BY k
), located AS (
  SELECT base.*, node.observations, node.bad, node.pairs,
    CASE WHEN source_id = 'america' THEN la WHEN placed THEN CAST(cents % 2000000 AS DECIMAL(18,0)) * 0.0001 - 100 END AS la,
    CASE WHEN source_id = 'america' THEN lo WHEN placed THEN CAST(cents % 3700000 AS DECIMAL(18,0)) * 0.0001 - 185 END AS lo
  FROM base LEFT JOIN node ON source_id = 'america' AND k = o_orderkey
), reasoned AS (
  SELECT *, CASE
      WHEN source_id = 'america' THEN CASE WHEN observations IS NULL THEN 'no_location' WHEN bad THEN 'invalid_coordinate'
                                           WHEN pairs > 1 THEN 'location_conflict' END
      WHEN source_id = 'middle_east' THEN 'crs_unconfirmed'
      WHEN NOT placed THEN 'missing'
      WHEN la BETWEEN -90 AND 90 AND lo BETWEEN -180 AND 180 THEN NULL ELSE 'invalid_coordinate' END AS reason
  FROM located
), crash AS (
  SELECT source_id, '["' || o_orderkey || '"]' AS crash_key, o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS y,
    CASE WHEN o_orderstatus = 'P' AND source_id IN ('africa', 'asia', 'middle_east') THEN NULL
         ELSE CAST(month(o_orderdate) AS INTEGER) END AS m,
    CASE WHEN source_id = 'america' THEN strftime(o_orderdate, '%Y-%m-%d') END AS d,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority WHEN source_id = 'europe' THEN '5-LOW'
         ELSE '__MISSING__' END AS sev,
    CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority = '1-URGENT' WHEN source_id = 'europe' THEN false END AS fatal,
    CAST(fa AS INTEGER) AS deaths,
    CAST(CASE WHEN source_id = 'asia' AND o_orderpriority = '5-LOW' THEN NULL ELSE fa + fn + fr END AS INTEGER) AS hurt,
    reason IS NULL AS mapped, reason, CASE WHEN reason IS NULL THEN CAST(la AS DOUBLE) END AS lat,
    CASE WHEN reason IS NULL THEN CAST(lo AS DOUBLE) END AS lon, o_orderstatus, o_orderpriority, fa, fn, fr, cents, observations, pairs
  FROM reasoned
), unit AS (
  SELECT source_id, l_orderkey, '["' || l_orderkey || '"]' AS crash_key,
    '["' || l_orderkey || '","' || l_linenumber || '"]' AS unit_key,
    CASE WHEN l_linenumber = 7 THEN NULL WHEN l_returnflag = 'A' THEN 'CAR' WHEN l_returnflag = 'N' THEN 'BIKE' ELSE 'TRUCK' END AS kind,
    CASE WHEN l_linenumber = 7 THEN '' ELSE l_returnflag END AS kind_raw,
    CASE WHEN source_id = 'america' THEN 'america_vehicle' ELSE source_id || '_traffic_unit' END AS scope, y, m
  FROM lineitem JOIN crash ON l_orderkey = o_orderkey WHERE source_id IN ('africa', 'america', 'middle_east')
)
"""
