"""Scans and sinks: each query writes rows derived from the tables to the shared folder and reads them back."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, functions as F

from crashmart.contracts import FileSpec
from crashmart.model import FACT_SCHEMA, FILE_IDENTITY, QA_SCHEMA, file_frame
from crashmart.plans import load as N, registry as G
from crashmart.session import materialize, scratch_path
from crashmart.sources import delimited, inventory, records, sinks
from crashmart.sources.native_text import native_text

from . import tables as t
from .registry import query

ORDERS = FileSpec("orders_csv", "orders", "crash", ("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "note"), ("o_orderkey",), "orders-csv")
PAGES = FileSpec("pages_csv", "pages", "crash", ("page_id", "url", "html"), ("page_id",), "pages-csv", multi_line=True)


def _write_csv(df: DataFrame, name: str) -> str:
    path = scratch_path(df.sparkSession, name)
    df.write.option("header", "true").option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)
    return path + "/*.csv"


def _orders_csv(spark, sf) -> str:
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderstatus", "o_orderpriority")
    text = native_text(o).withColumn("note", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.concat(F.lit('said "'), F.col("o_orderpriority"), F.lit('", twice'))))
    return _write_csv(text.select(*ORDERS.header), "orders-csv")


@query("delimited_scan", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
 o_orderstatus, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'said "' || o_orderpriority || '", twice' END AS note FROM orders""")
def delimited_scan(spark, sf):
    """Orders written as native CSV and scanned back: every value text, blanks kept, quotes undone, header checked."""
    path = _orders_csv(spark, sf)
    delimited.check_headers(spark, path, ORDERS)
    return delimited.scan(spark, path, ORDERS).select(*ORDERS.header)


@query("delimited_gate", "SELECT count(*) AS raw_count, CAST(0 AS BIGINT) AS bad_count, count(*) AS locator_count, CAST(0 AS BIGINT) AS gap_count FROM orders")
def delimited_gate(spark, sf):
    """Row width, NUL and encoding gates, and locators that number each file without gaps."""
    rows = delimited.scan(spark, _orders_csv(spark, sf), ORDERS)
    gates = delimited.gate_counts(rows, ORDERS).agg(
        F.sum("raw_count").alias("raw_count"), F.sum(F.col("row_width_mismatch") + F.col("nul_character") + F.col("invalid_utf8")).alias("bad_count"),
        F.sum(F.col("last_position") - F.col("raw_count")).alias("gap_count"))
    return gates.crossJoin(rows.select("file", "position").distinct().agg(F.count(F.lit(1)).alias("locator_count")))


@query("delimited_multi_line", """SELECT CAST(page_id AS VARCHAR) AS page_id, sha256(html) AS html_hash FROM pages""")
def delimited_multi_line(spark, sf):
    """Whole HTML pages with line breaks and quotes inside one field, through the multi-line scan."""
    path = _write_csv(t.table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("page_id"), "url", "html"), "pages-csv")
    return delimited.scan(spark, path, PAGES).select("page_id", F.sha2("html", 256).alias("html_hash"))


@query("file_inventory", """SELECT doc_id, CAST(strlen(text) + 1 AS BIGINT) AS byte_size, sha256(text || chr(10)) AS file_sha256 FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL""")
def file_inventory(spark, sf):
    """Size and SHA-256 of files: every document is written as a text file of its own first."""
    path = scratch_path(spark, "files")
    sinks.write_text_files(t.table(spark, sf, "documents").filter("doc_id is not null and text is not null"), "doc_id", "text", path)
    found = inventory.inventory(spark, f"{path}/*/*.txt")
    return found.select(F.regexp_extract("path", r"doc_id=([0-9]+)", 1).cast("bigint").alias("doc_id"), "byte_size", "file_sha256")


@query("record_round_trip", t.SQL_BASE + """SELECT resource_id, n AS row_count, n AS raw_count, CAST(0 AS BIGINT) AS bad_locator_count, CAST(0 AS BIGINT) AS repeated_position_count, true AS count_match FROM (
 SELECT source_id || '_crash' AS resource_id, count(*) AS n FROM crash GROUP BY source_id UNION ALL SELECT source_id || '_unit', count(*) FROM unit GROUP BY source_id
 UNION ALL SELECT 'america_node_raw', count(*) FROM seen)""")
def record_round_trip(spark, sf):
    """Raw records as JSON lines and back; identity, positions and counts per file."""
    path = scratch_path(spark, "records")
    records.write_records(t.raw(spark, sf), path)
    back = records.read_records(spark, path)
    return records.record_checks(back, file_frame(spark, t.frozen(spark, sf))).drop("last_position", *[c for c in FILE_IDENTITY if c != "resource_id"])


@query("record_payloads", t.SQL_BASE + """SELECT resource_id, row_count, CAST(0 AS BIGINT) AS changed_count FROM (
 SELECT source_id || '_crash' AS resource_id, count(*) AS row_count FROM crash GROUP BY source_id UNION ALL SELECT source_id || '_unit', count(*) FROM unit GROUP BY source_id
 UNION ALL SELECT 'america_node_raw', count(*) FROM seen)""")
def record_payloads(spark, sf):
    """Payloads after a JSON round trip against the ones before, for all files."""
    path = scratch_path(spark, "records")
    raw = t.raw(spark, sf)
    records.write_records(raw, path)
    d = G.replay_differences(raw, records.read_records(spark, path))
    return d.groupBy("resource_id").agg(
        F.sum("native_count").alias("row_count"), F.count_if(F.size("reason_codes") > 0).alias("changed_count"))


@query("slice_overwrite", t.SQL_BASE + """SELECT source_id, count(*) AS row_count FROM crash WHERE source_id <> 'asia' OR y = 1999 GROUP BY ALL""")
def slice_overwrite(spark, sf):
    """Rewriting one (batch, source, release) slice leaves the others alone."""
    path, f = scratch_path(spark, "facts"), t.fact(spark, sf)
    sinks.write_slices(f, path)
    sinks.write_slices(f.filter("source_id = 'asia' and occurrence_year = 1999"), path)
    return sinks.read_slices(spark, path, FACT_SCHEMA).groupBy("source_id").agg(F.count(F.lit(1)).alias("row_count"))


@query("result_sink", t.SQL_BASE + """, files AS (SELECT count(*) AS n FROM (SELECT DISTINCT source_id FROM crash UNION ALL SELECT DISTINCT source_id FROM unit UNION ALL SELECT 'node')),
 yr AS (SELECT count(*) AS n FROM (SELECT DISTINCT source_id, y FROM crash))
 SELECT batch_id, rule_id, CAST(n AS BIGINT) AS object_count FROM (SELECT unnest(['batch-1', 'batch-2']) AS batch_id, * FROM (SELECT 'QA01_INPUT' AS rule_id, n FROM files UNION ALL SELECT 'QA02_RAW', n FROM files UNION ALL SELECT 'QA03_PROJECTED', 8
 UNION ALL SELECT 'QA04_AUXILIARY', 4 UNION ALL SELECT 'QA05_SEMANTICS', 5 UNION ALL SELECT 'QA06_RECONCILIATION', n FROM yr UNION ALL SELECT 'QA07_LOCATION', n FROM yr))""")
def result_sink(spark, sf):
    """Append-only result store: two batches stored, counted per rule."""
    from .checks import all_results
    path, rows = scratch_path(spark, "qa"), all_results(spark, sf)
    sinks.append_results(rows, path)
    sinks.append_results(rows.withColumn("batch_id", F.lit("batch-2")), path)
    return spark.read.schema(QA_SCHEMA).parquet(path).groupBy("batch_id", "rule_id").agg(F.count(F.lit(1)).alias("object_count"))


@query("difference_evidence", t.SQL_BASE + """SELECT source_id, count(*) FILTER (WHERE (y = 1996 AND m IS NULL) OR (NOT (y = 1996 AND m IS NULL) AND deaths = 3)) + count(*) FILTER (WHERE y = 2001 AND sev = '5-LOW') AS evidence_count
 FROM crash GROUP BY ALL""")
def difference_evidence(spark, sf):
    """Differences stored as JSON lines; the stored count must equal the reported metric."""
    from crashmart.plans import quality as Q
    from .checks import _reconciled
    from .projection import damaged_facts
    # Counted and stored: written once.
    details = materialize(Q.reconcile_details(_reconciled(spark, sf, damaged_facts(spark, sf))), "details")
    path = scratch_path(spark, "evidence")
    sinks.write_differences(details, path, details.count())
    return spark.read.schema(details.schema).json(path).groupBy("source_id").agg(F.count(F.lit(1)).alias("evidence_count"))


@query("current_views", t.SQL_BASE + "SELECT source_id, count(*) AS crash_count, count(*) FILTER (WHERE mapped) AS map_count FROM crash GROUP BY ALL")
def current_views(spark, sf):
    """Temporary views of the current release, queried with SQL."""
    log = spark.createDataFrame([(t.BATCH, "synthetic", "succeeded", 1), ("older", "synthetic", "succeeded", 0)],
                                "batch_id string, dataset_kind string, status string, n int").withColumn("finished_at", F.timestamp_seconds("n"))
    sinks.register_current_views(log, {"fact": t.fact(spark, sf), "crash": t.crash(spark, sf)})
    return spark.sql("select source_id, count(*) as crash_count, count_if(map_eligible) as map_count from current_fact group by source_id")


@query("incremental_load", t.SQL_BASE + """, n AS (SELECT source_id, count(*) AS c, count(*) FILTER (WHERE y <> 1995) AS c2 FROM crash GROUP BY 1),
 s AS (SELECT 'america' AS source_id, count(*) AS s FROM seen), r AS (SELECT source_id, c, c2, coalesce(s, 0) AS s, source_id = 'europe' AS hit FROM n LEFT JOIN s USING (source_id))
 SELECT 'first' AS batch_id, source_id, 'new' AS state, 'first' AS data_batch_id, c + s AS record_count, c AS crash_count, c AS written_count FROM r
 UNION ALL SELECT 'second', source_id, CASE WHEN hit THEN 'changed' ELSE 'same' END, CASE WHEN hit THEN 'second' ELSE 'first' END, CASE WHEN hit THEN c2 ELSE c + s END, CASE WHEN hit THEN c2 ELSE c END,
  CASE WHEN hit THEN c2 ELSE 0 END FROM r""")
def incremental_load(spark, sf):
    """Two loads of all sources; one publisher sent a shorter file before the second. Rows of each batch, and those it had to write.

    Line numbers repeat within orders, which the gate of unit files refuses, so the contract of this load has no units.
    """
    m, raw, vault = t.frozen(spark, sf), t.raw(spark, sf), N.Vault(scratch_path(spark, "vault"))
    m = replace(m, sources=tuple(replace(s, units=None, files=tuple(f for f in s.files if f.role != "unit")) for s in m.sources))
    N.load_batch(raw, m, vault, "first")
    late = "0" * 64
    hit = F.col("source_id") == "europe"
    second = raw.filter(~hit | (F.try_element_at("payload", F.lit("YEAR")) != "1995")).withColumn("file_sha256", F.when(hit, late).otherwise(F.col("file_sha256")))
    sources = tuple(replace(s, files=tuple(replace(f, file_sha256=late) for f in s.files)) if s.source_id == "europe" else s for s in m.sources)
    N.load_batch(second, replace(m, sources=sources), vault, "second")
    per = [F.count(F.lit(1)).alias("crash_count")]
    read = vault.crash(spark, "first").unionByName(vault.crash(spark, "second")).groupBy("batch_id", "source_id").agg(*per)
    written = spark.read.parquet(vault.path("sat_crash")).groupBy("batch_id", "source_id").agg(F.count(F.lit(1)).alias("written_count"))
    ledger = vault.ledger(spark).select("batch_id", "source_id", "state", "data_batch_id", F.col("row_count").alias("record_count"))
    return ledger.join(read, ["batch_id", "source_id"]).join(written, ["batch_id", "source_id"], "left").fillna(0, ["written_count"])
