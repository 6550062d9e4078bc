"""Incremental load: raw registry, hubs, attribute snapshots and links kept across batches.

A slice is one (source, release scope). Its digest covers the raw records of its declared files and its part of the contract. A batch
projects the slices whose digest is new and refers to an earlier batch for the others; the ledger says which batch holds the rows of
which slice. Ledger rows are written last, in one job, so a load that died half-way is not seen, and repeating it under its
batch id writes the same rows again: registry and hubs take what they lack, snapshots and links are replaced slice by slice.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import Manifest
from ..errors import ContractError
from ..model import CRASH_SCHEMA, FILE_IDENTITY, RAW_SCHEMA, UNIT_ID, UNIT_SCHEMA, file_frame
from ..operators.digests import group_digests
from ..operators.relations import no_rows
from ..session import materialize
from ..sources.records import PARTITIONS, write_records
from ..sources.sinks import _exists, write_slices
from . import registry as G, vault as V
from .project import check_source, project_all

LEDGER = "batch_id string, source_id string, release_scope string, row_count bigint, digest string, data_batch_id string, state string, sequence int"
HUB = "source_id string, release_scope string, {key} string, first_batch_id string"


@dataclass(frozen=True)
class Vault:
    """Where the layers of the load live; all paths are below one shared root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def _read(self, spark: SparkSession, name: str, schema) -> DataFrame:
        if not _exists(spark, self.path(name)):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(self.path(name))

    def registry(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "registry", RAW_SCHEMA).select(*RAW_SCHEMA.fieldNames())

    def hub(self, spark: SparkSession, kind: str) -> DataFrame:
        return self._read(spark, f"hub_{kind}", HUB.format(key=f"{kind}_key"))

    def ledger(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "ledger", LEDGER)

    def slices(self, spark: SparkSession, name: str, batch_id: str) -> DataFrame:
        """Stored rows of a batch, wherever they were written, under its own batch id; none for a batch whose load is not complete.

        One literal filter per slice prunes the folders.
        """
        refs = self.ledger(spark).filter(F.col("batch_id") == batch_id).select("source_id", "release_scope", "data_batch_id").collect()   # one row per source
        reader = spark.read if name == "candidates" else spark.read.schema(_stored_schema(name))
        if not refs:
            return reader.parquet(self.path(name)).limit(0) if _exists(spark, self.path(name)) else spark.createDataFrame([], _stored_schema(name))
        wanted = reduce(lambda a, b: a | b, [
            (F.col("source_id") == r["source_id"]) & (F.col("release_scope") == r["release_scope"]) & (F.col("batch_id") == r["data_batch_id"]) for r in refs])
        return reader.parquet(self.path(name)).filter(wanted).withColumn("batch_id", F.lit(batch_id))

    def crash(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return V.canonical_crash(self.slices(spark, "sat_crash", batch_id))

    def unit(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return V.canonical_unit(self.slices(spark, "sat_unit", batch_id), self.slices(spark, "link_unit", batch_id))

    def candidates(self, spark: SparkSession, batch_id: str) -> DataFrame | None:
        """Candidate records of observation groups; None while no load had a source with observations."""
        return self.slices(spark, "candidates", batch_id) if _exists(spark, self.path("candidates")) else None


def _stored_schema(name: str):
    """Snapshots hold the typed rows as keys and one struct."""
    if name == "link_unit":
        return ", ".join(f"{c} string" for c in [*UNIT_ID, "crash_key"])
    schema, keys = (CRASH_SCHEMA, V.CRASH_KEYS) if name == "sat_crash" else (UNIT_SCHEMA, V.UNIT_KEYS)
    fields = ", ".join(f"{f.name}: {f.dataType.simpleString()}" for f in schema if f.name not in keys)
    return ", ".join(f"{k} string" for k in keys) + f", attributes struct<{fields}>"


def declared_records(raw: DataFrame, manifest: Manifest) -> DataFrame:
    """Records of the files that the manifest names."""
    return raw.join(file_frame(raw.sparkSession, manifest).select(*FILE_IDENTITY), FILE_IDENTITY, "left_semi")


def contract_digest(manifest: Manifest, source_id: str) -> str:
    """Everything of a contract that a projection of one source reads."""
    alone = replace(manifest, sources=(manifest.source(source_id),), provenance={})
    return hashlib.sha256(alone.to_json().encode()).hexdigest()


def slice_digests(raw: DataFrame, manifest: Manifest) -> DataFrame:
    """One row per declared slice: row_count and digest of its records and its contract. A slice without records has a digest too."""
    spark = raw.sparkSession
    declared = spark.createDataFrame([(s.source_id, s.release_scope, contract_digest(manifest, s.source_id)) for s in manifest.sources],
                                     "source_id string, release_scope string, contract string")
    rows = declared_records(raw, manifest).select("source_id", *FILE_IDENTITY, "row_locator", "raw_record_id", G.payload_text().alias("text"))
    found = group_digests(rows, ["source_id"], [*FILE_IDENTITY, "row_locator", "raw_record_id", "text"])
    return declared.join(found, "source_id", "left").select(
        "source_id", "release_scope", F.coalesce("row_count", F.lit(0).cast("bigint")).alias("row_count"),
        F.concat_ws("/", F.coalesce("digest", F.lit("0")), "contract").alias("digest"))


def load_plan(ledger: DataFrame, digests: DataFrame, batch_id: str) -> DataFrame:
    """One row per declared slice: state new, changed or same against its last load, and the batch that holds or will hold its rows."""
    last = ledger.groupBy("source_id", "release_scope").agg(
        F.max_by(F.struct("digest", "data_batch_id"), "sequence").alias("last"), F.max("sequence").alias("at"))
    number = ledger.agg((F.coalesce(F.max("sequence"), F.lit(0)) + 1).alias("sequence"))     # one row
    same = F.col("last.digest") == F.col("digest")
    state = F.when(F.col("last").isNull(), "new").when(same, "same").otherwise("changed")
    return digests.join(last, ["source_id", "release_scope"], "left").crossJoin(number).select(
        F.lit(batch_id).alias("batch_id"), "source_id", "release_scope", "row_count", "digest",
        F.when(F.coalesce(same, F.lit(False)), F.col("last.data_batch_id")).otherwise(F.lit(batch_id)).alias("data_batch_id"),
        state.alias("state"), "sequence")


def register_records(vault: Vault, raw: DataFrame) -> None:
    """Append the records the registry lacks. A stored identity with another payload or source refuses the load.

    Only files named by the incoming rows are compared: the registry is partitioned by them.
    """
    spark = raw.sparkSession
    stored = vault.registry(spark).join(raw.select(*PARTITIONS).distinct(), PARTITIONS, "left_semi")
    if not no_rows(G.load_states(stored, raw).filter("state = 'conflict'")):
        raise ContractError("RAW_CONFLICT", "a stored record was given another payload")
    write_records(materialize(G.rows_to_insert(stored, raw), "registry-rows"), vault.path("registry"), "parquet")


def _append_hub(vault: Vault, rows: DataFrame, kind: str) -> None:
    new = V.hub_rows(vault.hub(rows.sparkSession, kind), rows, f"{kind}_key")
    materialize(new, f"hub-{kind}").write.mode("append").parquet(vault.path(f"hub_{kind}"))


def load_batch(raw: DataFrame, manifest: Manifest, vault: Vault, batch_id: str) -> DataFrame:
    """Load one batch and return its ledger rows. Slices that did not change are neither projected nor written.

    raw: records of the declared files (others are left out). Empty files give slices without rows. A batch id that is complete is refused.
    """
    spark = raw.sparkSession
    manifest.validate()
    if not no_rows(vault.ledger(spark).filter(F.col("batch_id") == batch_id)):
        raise ContractError("BATCH_EXISTS", "every load needs its own batch id", batch_id=batch_id)
    mine = declared_records(raw, manifest).select(*RAW_SCHEMA.fieldNames())
    plan = materialize(load_plan(vault.ledger(spark), slice_digests(mine, manifest), batch_id), "load-plan")
    todo = {r["source_id"] for r in plan.filter("state <> 'same'").select("source_id").collect()}     # contract-sized
    if todo:
        part = replace(manifest, sources=tuple(s for s in manifest.sources if s.source_id in todo))
        rows = declared_records(mine, part)
        for s in part.sources:
            check_source(rows, s)
        register_records(vault, rows)
        projected = project_all(rows, part, batch_id)
        crash, unit = materialize(projected.crash, "crash"), materialize(projected.unit, "unit")
        _append_hub(vault, crash, "crash")
        _append_hub(vault, unit, "unit")
        write_slices(V.crash_satellite(crash), vault.path("sat_crash"))
        write_slices(V.unit_satellite(unit), vault.path("sat_unit"))
        write_slices(V.links(unit), vault.path("link_unit"))
        if projected.candidates is not None:
            write_slices(projected.candidates, vault.path("candidates"))
    plan.coalesce(1).write.mode("append").parquet(vault.path("ledger"))
    return vault.ledger(spark).filter(F.col("batch_id") == batch_id)
