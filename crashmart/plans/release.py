"""Publication: required results, the batch log and the current pointer.

The log is append-only. Tables are written under their batch_id first and one log row last, so a reader that takes the latest
succeeded row never sees half a batch.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import Manifest
from ..errors import ContractError
from ..model import BATCH_SCHEMA, contract_frame
from ..operators.relations import no_rows
from ..sources.commits import claim_next, last_number
from .quality import LIMITED_RULE, METRICS, RULES, SUMMARY, roll_up


def required_objects(spark: SparkSession, manifest: Manifest) -> DataFrame:
    """(rule_id, object_key) every batch of this manifest must answer."""
    rows: list[tuple[str, str]] = []
    for f in manifest.files():
        name = f"file:{f.resource_id}:{f.file_sha256}:{f.parser_version}"
        rows += [("QA01_INPUT", name), ("QA02_RAW", name)]
        if f.role in ("crash", "unit"):
            rows.append(("QA03_PROJECTED", f"resource:{f.resource_id}"))
        if f.role != "crash":
            rows.append(("QA04_AUXILIARY", f"resource:{f.resource_id}"))
    for s in manifest.sources:
        rows.append(("QA05_SEMANTICS", f"source:{s.source_id}"))
        for year in range(manifest.year_from, manifest.year_to + 1):
            rows += [(rule, f"source_year:{s.source_id}:{year}") for rule in ("QA06_RECONCILIATION", "QA07_LOCATION")]
    rows += [(rule, SUMMARY) for rule in RULES]
    return contract_frame(spark, rows, "rule_id string, object_key string")


def recomputed(spark: SparkSession, manifest: Manifest, crash: DataFrame, unit: DataFrame) -> DataFrame:
    """(rule_id, object_key, metric, value): what contract and layers demand of a publishable batch, without a look at stored results.

    Row counts of files come from the contract, counts of typed and mapped rows from one grouped pass over each layer, and
    everything that must not occur is zero.
    """
    fixed, layered, zeros = [], [], {rule: [(rule, k, 0) for k in METRICS[rule]] for rule in ("QA05_SEMANTICS", "QA06_RECONCILIATION")}
    for f in manifest.files():
        name = f"file:{f.resource_id}:{f.file_sha256}:{f.parser_version}"
        fixed += [("QA01_INPUT", name, k, 1) for k in METRICS["QA01_INPUT"]]
        fixed += [("QA02_RAW", name, k, v) for k, v in (("raw_count", f.raw_count), ("distinct_locator_count", f.raw_count), ("payload_mismatch_count", 0))]
        if f.role in ("crash", "unit"):
            key = f"resource:{f.resource_id}"
            fixed += [("QA03_PROJECTED", key, k, v) for k, v in (("input_count", f.raw_count), ("duplicate_key_count", 0), ("orphan_count", 0), ("invalid_value_count", 0))]
            layered.append((f.role, f.source_id, key))
    years = [(s.source_id, y) for s in manifest.sources for y in range(manifest.year_from, manifest.year_to + 1)]
    fixed += [(rule, f"source:{s.source_id}", k, v) for s in manifest.sources for rule, k, v in zeros["QA05_SEMANTICS"]]
    fixed += [(rule, f"source_year:{s}:{y}", k, v) for s, y in years for rule, k, v in zeros["QA06_RECONCILIATION"]]
    form = "rule_id string, object_key string, metric string, value bigint"
    zero = F.lit(0).cast("bigint")
    rows = (crash.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("crash"))
            .unionByName(unit.groupBy("source_id").agg(F.count(F.lit(1)).alias("n")).withColumn("role", F.lit("unit"))))
    files = contract_frame(spark, layered, "role string, source_id string, object_key string").join(rows, ["role", "source_id"], "left")
    projected = files.select(F.lit("QA03_PROJECTED").alias("rule_id"), "object_key", F.lit("projected_count").alias("metric"), F.coalesce("n", zero).alias("value"))
    mapped = crash.groupBy("source_id", "occurrence_year").agg(F.count(F.lit(1)).alias("n"), F.count_if("map_eligible").alias("m"))
    spine = contract_frame(spark, years, "source_id string, occurrence_year int").join(mapped, ["source_id", "occurrence_year"], "left")
    n, m = F.coalesce("n", zero), F.coalesce("m", zero)
    values = F.array(*[F.struct(F.lit(k).alias("metric"), v.alias("value")) for k, v in (("crash_count", n), ("map_count", m), ("unmapped_count", n - m), ("invalid_eligible_count", zero))])
    located = spine.select(F.lit("QA07_LOCATION").alias("rule_id"), F.concat_ws(":", F.lit("source_year"), "source_id", "occurrence_year").alias("object_key"), F.explode(values).alias("v"))
    return contract_frame(spark, fixed, form).unionByName(projected).unionByName(located.select("rule_id", "object_key", "v.metric", "v.value"))


def expectation_findings(results: DataFrame, wanted: DataFrame) -> DataFrame:
    """Objects whose stored expectation or stored count of some metric is not the recomputed one, in the form of gate_findings."""
    keys = ["rule_id", "object_key"]
    stored = results.select(*keys, F.col("expected.metrics").alias("e"), F.col("actual.metrics").alias("a"))
    held = wanted.join(stored, keys)
    off = lambda side: F.try_element_at(side, F.col("metric")).isNotNull() & (F.try_element_at(side, F.col("metric")) != F.col("value"))
    return held.filter(off("e") | off("a")).select(*keys, F.lit("expectation").alias("reason")).distinct()


def gate_findings(results: DataFrame, required: DataFrame) -> DataFrame:
    """Why a batch may not be published, one row per reason; empty means it may."""
    keys = ["rule_id", "object_key"]
    stored = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.struct("result", "affected_count")).alias("last"),
        F.bool_or(F.col("result") == "block").alias("blocked"),
        F.bool_or((F.col("result") == "limited") & (F.col("rule_id") != LIMITED_RULE)).alias("limited_elsewhere"),
        F.bool_or(F.col("actual.violation_count") > 0).alias("violated"),
        F.bool_or(~F.col("actual.evaluated_count").eqNullSafe(F.col("expected.evaluated_count"))).alias("uncovered"),
        F.bool_or(F.exists(F.map_keys("expected.metrics"), lambda k: (
            F.try_element_at("expected.metrics", k).isNotNull()
            & ~F.try_element_at("actual.metrics", k).eqNullSafe(F.try_element_at("expected.metrics", k))))).alias("metric_off"),
        F.bool_or(_wrong_metric_names()).alias("names_off"))
    sided = required.withColumn("needed", F.lit(True)).join(stored, keys, "full_outer")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reasons = F.array_compact(F.array(
        F.when(F.col("n").isNull(), "missing"), F.when(F.col("needed").isNull(), "extra"), F.when(F.col("n") > 1, "duplicate"),
        F.when(yes("blocked"), "block"), F.when(yes("limited_elsewhere"), "limited_not_allowed"),
        F.when(yes("violated"), "violation"), F.when(yes("uncovered"), "coverage"), F.when(yes("metric_off"), "metric_mismatch"),
        F.when(yes("names_off"), "metric_names")))
    return sided.select(*keys, F.explode(reasons).alias("reason")).distinct()


def _wrong_metric_names() -> F.Column:
    """A concrete object must report exactly the metrics of its rule."""
    out = F.lit(False)
    for rule, names in METRICS.items():
        wanted = F.array_sort(F.array(*[F.lit(n) for n in names]))
        out = F.when((F.col("rule_id") == rule) & (F.col("object_key") != SUMMARY),
                     F.array_sort(F.map_keys("actual.metrics")) != wanted).otherwise(out)
    return out


def summary_differences(results: DataFrame) -> DataFrame:
    """Summaries that disagree with their concrete objects."""
    stated = results.filter(F.col("object_key") == SUMMARY).select(
        "rule_id", F.col("result").alias("stated"), F.col("affected_count").alias("stated_affected"))
    actual = roll_up(results).select("rule_id", "result", "affected_count")
    return actual.join(stated, "rule_id", "left").filter(
        ~F.col("stated").eqNullSafe(F.col("result")) | ~F.col("stated_affected").eqNullSafe(F.col("affected_count")))


def location_count_differences(crash: DataFrame, fact: DataFrame) -> DataFrame:
    """Source-years whose rows or mapped rows differ between the typed layer and the fact."""
    side = lambda df, sign: df.select("source_id", "occurrence_year", F.lit(sign).alias("n"),
                                      F.when(F.col("map_eligible"), sign).otherwise(0).alias("m"))
    return (side(crash, 1).unionByName(side(fact, -1)).groupBy("source_id", "occurrence_year")
            .agg(F.sum("n").alias("row_delta"), F.sum("m").alias("map_delta")).filter("row_delta <> 0 or map_delta <> 0"))


def batch_row(spark: SparkSession, batch_id: str, manifest: Manifest, status: str, error: str | None = None) -> DataFrame:
    now = datetime.now(timezone.utc)
    finished = None if status == "running" else now
    return spark.createDataFrame([(batch_id, manifest.dataset_kind, status, manifest.fingerprint(), manifest.to_json(), now,
                                   finished, error)], BATCH_SCHEMA)


def log_errors(log: DataFrame) -> DataFrame:
    """Log rows breaking their own rules: running has no end, failed has a reason, status is known."""
    running, failed = F.col("status") == "running", F.col("status") == "failed"
    return log.filter(~F.col("status").isin("running", "succeeded", "failed") | (running != F.col("finished_at").isNull())
                      | (failed & F.col("error").isNull()))


def latest_status(log: DataFrame) -> DataFrame:
    """One row per batch: its last state."""
    order = F.struct(F.col("finished_at").isNotNull(), "finished_at", "started_at")
    fields = [f for f in BATCH_SCHEMA.fieldNames() if f != "batch_id"]
    picked = F.max_by(F.struct(*fields), order).alias("last")
    return log.groupBy("batch_id").agg(picked).select("batch_id", "last.*")


def commits(log_path: str) -> str:
    """Folder of the numbered commits of a log."""
    return f"{log_path.rstrip('/')}-commits"


def publish(results: DataFrame, log_path: str, batch_id: str, manifest: Manifest, crash: DataFrame, unit: DataFrame, seen: int | None = None) -> None:
    """Check the gate, then append the succeeded row. The pointer is the latest such row, so history stays readable.

    crash and unit are the batch's layers: expectations are made again from them and the contract, so a stored row cannot vouch for itself.

    seen is the last commit number before the batch began (None: read now). Whoever claims the next one publishes; a batch that began from an
    older release than the current one is refused and has to be built again.

    All findings of a refused batch are written beside the log, in a folder of their own; the message names it and shows the first.
    """
    spark = results.sparkSession
    seen = last_number(spark, commits(log_path)) if seen is None else seen
    mine = results.filter(F.col("batch_id") == batch_id)
    findings = gate_findings(mine, required_objects(spark, manifest)).unionByName(expectation_findings(mine, recomputed(spark, manifest, crash, unit)))
    first = findings.orderBy("rule_id", "object_key", "reason").limit(5).collect()   # examples for the message only
    if first:
        kept = f"{log_path.rstrip('/')}-findings/{batch_id}"
        findings.write.mode("overwrite").parquet(kept)
        raise ContractError("PUBLICATION_QA", "the batch may not be published", count=spark.read.parquet(kept).count(), table=kept, findings=[tuple(r) for r in first])
    if not no_rows(summary_differences(mine)):
        raise ContractError("PUBLICATION_QA_SUMMARY", "summaries differ from their objects")
    if not claim_next(spark, commits(log_path), seen):
        raise ContractError("PUBLICATION_CONFLICT", "another batch was published since this one began", batch_id=batch_id, seen=seen)
    batch_row(spark, batch_id, manifest, "succeeded").write.mode("append").parquet(log_path)


def fail(spark: SparkSession, log_path: str, batch_id: str, manifest: Manifest, error: str) -> None:
    batch_row(spark, batch_id, manifest, "failed", error).write.mode("append").parquet(log_path)


def unchanged(log: DataFrame, manifest: Manifest) -> str | None:
    """Batch id of the current release when it was built from the same manifest, else None."""
    last = (log.filter((F.col("status") == "succeeded") & (F.col("dataset_kind") == manifest.dataset_kind))
            .agg(F.max_by(F.struct("batch_id", "input_fingerprint"), F.struct("finished_at", "batch_id")).alias("r")).first())
    return last["r"]["batch_id"] if last["r"] and last["r"]["input_fingerprint"] == manifest.fingerprint() else None
