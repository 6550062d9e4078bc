"""One batch from raw records to a published release.

Each layer is written under its batch before the next one reads it, so no stage recomputes another and a lost executor costs
only the running stage. The log row is written last.
"""

from __future__ import annotations

import hashlib
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..contracts import Manifest
from ..errors import ContractError
from ..model import BATCH_SCHEMA, FACT_SCHEMA, QA_SCHEMA
from ..session import materialize
from ..sources.commits import claim, last_number
from ..sources.sinks import _exists, append_results, read_slices, write_slices
from . import links as K, quality as Q, registry as G, release as L, reports as R, warehouse as W
from .load import Vault, load_batch
from .native import read_native


@dataclass(frozen=True)
class Store:
    """Where the layers live; all paths are below one shared root."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    @property
    def vault(self) -> Vault:
        return Vault(self.path("vault"))

    def crash(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return self.vault.crash(spark, batch_id)

    def unit(self, spark: SparkSession, batch_id: str) -> DataFrame:
        return self.vault.unit(spark, batch_id)

    def fact(self, spark: SparkSession) -> DataFrame:
        return read_slices(spark, self.path("fact"), FACT_SCHEMA)

    def results(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(QA_SCHEMA).parquet(self.path("qa")).select(*QA_SCHEMA.fieldNames())

    def log(self, spark: SparkSession) -> DataFrame:
        if not _exists(spark, self.path("log")):
            return spark.createDataFrame([], BATCH_SCHEMA)
        return spark.read.schema(BATCH_SCHEMA).parquet(self.path("log"))


def quality_results(raw: DataFrame, manifest: Manifest, crash: DataFrame, unit: DataFrame, fact: DataFrame, batch_id: str,
                    native: DataFrame, observed: DataFrame, deletions: DataFrame | None = None) -> DataFrame:
    """All concrete result objects of a batch. Frames hold this batch only; native and observed are what native.read_native gives."""
    spark = raw.sparkSession
    # The second derivation serves three rules: it is made once and written.
    expected = Q.written_rows(raw, manifest)
    sources, severities = W.dim_source(spark, manifest, batch_id), W.dim_severity(spark, manifest, batch_id)
    people = [K.link_counts(K.source_checks(raw, s, manifest.year_from, manifest.year_to), s.file("person_raw").resource_id)
              for s in manifest.sources if s.persons]
    lineage = materialize(Q.lineage_errors(crash, Q.raw_keys(raw, manifest)), "lineage")
    reconciled = Q.reconcile_rows(crash, fact, sources, severities, lineage)
    # The rules run one after the other, and the raw replay file by file: what one of them shuffles has gone when the next one begins.
    def replay(resource_id: str) -> DataFrame:
        mine = F.col("resource_id") == resource_id
        return materialize(G.replay_summary(G.replay_differences(native.filter(mine), raw.filter(mine))), "replay")

    replayed = reduce(DataFrame.unionByName, [replay(r) for r in dict.fromkeys(f.resource_id for f in manifest.files())])
    rules = [
        lambda: Q.input_results(observed, manifest, batch_id, deletions),
        lambda: Q.raw_results(replayed, manifest, batch_id),
        lambda: Q.projection_results(raw, manifest, crash, unit, batch_id, expected),
        lambda: Q.auxiliary_results(raw, manifest, batch_id, reduce(DataFrame.unionByName, people) if people else None),
        lambda: Q.semantics_results(raw, manifest, crash, unit, batch_id, expected),
        lambda: Q.reconcile_results(Q.reconcile_metrics(reconciled, sources, manifest.year_from, manifest.year_to), batch_id),
        lambda: Q.location_results(Q.location_metrics(Q.expected_locations(expected[0], batch_id), fact, sources, manifest.year_from, manifest.year_to), batch_id)]
    parts = [part() for part in rules]
    return reduce(DataFrame.unionByName, [materialize(p, "rule") for p in parts if p is not None])


def verify_layers(raw: DataFrame, manifest: Manifest, crash: DataFrame, unit: DataFrame, fact: DataFrame, batch_id: str) -> None:
    """Refuse stored layers that break the projection's rules, the dimension contracts, or differ from the facts of their crashes."""
    spark = raw.sparkSession
    found = {r["check"]: r["affected_count"] for r in Q.validate_projection(crash, unit, manifest, batch_id, Q.raw_keys(raw, manifest)).collect()}
    found |= W.preflight(crash, W.dim_source(spark, manifest, batch_id), W.dim_severity(spark, manifest, batch_id), W.dim_month(spark, manifest)).first().asDict()
    found["fact_differences"] = W.fact_verification(crash, fact).agg(F.coalesce(F.sum("difference_count"), F.lit(0))).first()[0]
    broken = {k: n for k, n in found.items() if n}
    if broken:
        raise ContractError("LAYERS", "stored layers break their contracts", **broken)


def build_batch(raw: DataFrame, manifest: Manifest, store: Store, batch_id: str, files: Mapping[str, str], deletions: DataFrame | None = None) -> str:
    """Project, store, check and publish. Returns the batch id, or the current one when nothing changed.

    files: the path of every declared native file. They are read anew, so that a file that was changed since it was loaded, and a stored
    record that the files don't hold or hold otherwise, refuse the batch. Only sources whose records or contract changed since their last load
    are projected (plans/load.py). Of builds that started from the same release one publishes; the others fail with PUBLICATION_CONFLICT.
    """
    spark = raw.sparkSession
    manifest.validate()
    seen = last_number(spark, L.commits(store.path("log")))
    log = store.log(spark)
    same = L.unchanged(log, manifest)
    if same:
        return same
    if log.filter(F.col("batch_id") == batch_id).limit(1).count() or not claim(spark, store.path("attempts"), hashlib.sha256(batch_id.encode()).hexdigest()):
        raise ContractError("BATCH_EXISTS", "every attempt needs its own batch id", batch_id=batch_id)
    try:
        load_batch(raw, manifest, store.vault, batch_id)
        mine = F.col("batch_id") == batch_id
        crash, unit = store.crash(spark, batch_id), materialize(store.unit(spark, batch_id), "unit")
        write_slices(W.facts(crash), store.path("fact"))
        fact = store.fact(spark).filter(mine)
        observed, native = read_native(spark, manifest, files)
        append_results(quality_results(raw, manifest, crash, unit, fact, batch_id, native, observed, deletions), store.path("qa"))
        append_results(Q.summary_results(store.results(spark).filter(mine), batch_id), store.path("qa"))
        verify_layers(raw, manifest, crash, unit, fact, batch_id)
        L.publish(store.results(spark), store.path("log"), batch_id, manifest, crash, unit, seen)
    except Exception as exc:
        L.fail(spark, store.path("log"), batch_id, manifest, str(exc))
        raise
    return batch_id


def open_batch(spark: SparkSession, store: Store, manifest: Manifest, batch_id: str) -> R.Batch | None:
    """The stored batch in report form; None when the log does not know it."""
    row = L.latest_status(store.log(spark)).filter(F.col("batch_id") == batch_id).select("dataset_kind", "status").first()
    if row is None:
        return None
    mine = F.col("batch_id") == batch_id
    return R.Batch(batch_id, row["dataset_kind"], row["status"], manifest, store.fact(spark).filter(mine), store.unit(spark, batch_id),
                   W.dim_source(spark, manifest, batch_id), W.dim_severity(spark, manifest, batch_id))
