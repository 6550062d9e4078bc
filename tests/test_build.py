"""Whole batches over the invented snapshot: golden totals, faulty variants, history."""

from __future__ import annotations

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from crashmart.contracts import Category
from crashmart.errors import ContractError
from crashmart.plans import build as B, links as K, project as P, quality as Q, release as L, reports as R, warehouse as W
from crashmart.plans.native import read_native
from crashmart.plans.reports import Request
from crashmart.session import scratch_path
from tests import small


@pytest.fixture(scope="module")
def native(tmp_path_factory):
    """Writes the native files of some rows into a folder of their own."""
    return lambda rows=None, fourth=False: small.files(tmp_path_factory.mktemp("native"), rows, fourth)


@pytest.fixture(scope="module")
def built(spark, native):
    m, store = small.manifest(), B.Store(scratch_path(spark, "store"))
    B.build_batch(small.raw(spark), m, store, "b1", native())
    return m, store


@pytest.fixture(scope="module")
def batch(spark, built):
    m, store = built
    return B.open_batch(spark, store, m, "b1")


def projected(spark, rows=None, fourth=False, m=None):
    m = m or small.manifest(rows, fourth)
    p = P.project_all(small.raw(spark, rows, fourth), m, "b")
    return m, p.crash, p.unit


def results_of(spark, rows, *rules):
    """Results of the named rules for a damaged snapshot, projected without gates."""
    m, raw = small.manifest(rows), small.raw(spark, rows)
    p = P.project_all(raw, m, "b")
    fact = W.facts(p.crash)
    make = {
        "QA03": lambda: Q.projection_results(raw, m, p.crash, p.unit, "b"),
        "QA04": lambda: Q.auxiliary_results(raw, m, "b", K.link_counts(
            K.source_checks(raw, m.source("ridge"), m.year_from, m.year_to), "ridge_person_raw")),
        "QA05": lambda: Q.semantics_results(raw, m, p.crash, p.unit, "b"),
        "QA07": lambda: Q.location_results(Q.location_metrics(p.crash, fact, W.dim_source(spark, m, "b"), m.year_from, m.year_to), "b")}
    return {(r["rule_id"], r["object_key"]): r for rule in rules for r in make[rule]().collect()}


def blocked(results):
    return {k for k, r in results.items() if r["result"] == "block"}


def test_golden_totals(spark, batch):
    totals = batch.fact.agg(
        F.count(F.lit(1)), F.count_if(F.col("is_fatal_crash")), F.sum("fatality_count"), F.sum("casualty_count"), F.count_if("map_eligible")).first()
    assert tuple(totals) == (8, 3, 4, 16, 6)
    assert batch.unit.count() == 8


def test_results_and_summaries(spark, built):
    _, store = built
    rows = store.results(spark).filter("batch_id = 'b1'")
    assert rows.count() == 63
    states = {(r["rule_id"]): r["result"] for r in rows.filter("object_key = 'batch'").collect()}
    assert states.pop("QA07_LOCATION") == "limited"
    assert set(states.values()) == {"pass"}


def test_fourth_source(spark, native):
    m, store = small.manifest(fourth=True), B.Store(scratch_path(spark, "store"))
    B.build_batch(small.raw(spark, fourth=True), m, store, "b1", native(fourth=True))
    b = B.open_batch(spark, store, m, "b1")
    totals = b.fact.agg(F.count(F.lit(1)), F.count_if("is_fatal_crash"), F.sum("fatality_count"), F.sum("casualty_count")).first()
    assert tuple(totals) == (9, 3, 4, 18)
    cover = R.map_coverage(b, Request("synthetic")).first()
    assert (cover["crash_count"], cover["point_count"], float(cover["coverage_percentage"])) == (9, 7, 77.78)
    assert store.results(spark).count() == 77


def test_trend_golden(batch):
    years = R.trend(batch, Request("synthetic")).collect()
    months = R.trend(batch, Request("synthetic", grain="month")).collect()
    assert (len(years), len(months)) == (15, 180)
    ferry = {r["period_year"]: r for r in years if r["source_id"] == "ferry"}
    assert [ferry[2022][c] for c in ("crash_count", "month_known_count", "excluded_unknown_month_count", "fatality_count", "fatality_known_count")] == [2, 2, 0, 1, 2]
    assert [ferry[2023][c] for c in ("crash_count", "month_known_count", "excluded_unknown_month_count", "fatality_count", "fatality_known_count")] == [1, 0, 0, None, 0]
    assert {r["excluded_unknown_month_count"] for r in months if r["source_id"] == "ferry" and r["period_year"] == 2023} == {1}
    empty = next(r for r in years if r["source_id"] == "delta" and r["period_year"] == 2022)
    assert (empty["coverage_status"], empty["crash_count"], empty["fatality_count"], empty["fatality_known_count"]) == ("covered", 0, None, 0)


def test_uncovered_year_is_unknown(batch):
    row = R.trend(batch, Request("synthetic", ("ferry",), 2019, 2019)).first()
    assert row["coverage_status"] == "not_covered" and row["covered_month_count"] == 0
    assert all(row[c] is None for c in ("crash_count", "month_known_count", "fatality_known_count", "casualty_count", "excluded_unknown_month_count"))


def test_severity_groups(batch):
    got = {(r["source_id"], r["severity_code"]): r["crash_count"] for r in R.severity(batch, Request("synthetic")).collect()}
    assert got == {("ferry", "K"): 1, ("ferry", "H"): 1, ("ferry", "__MISSING__"): 1, ("delta", "H"): 1, ("delta", "O"): 1, ("delta", "K"): 1, ("ridge", "K"): 1, ("ridge", "H"): 1}


def test_map_and_units(batch):
    cover = R.map_coverage(batch, Request("synthetic"))
    points = R.map_points(batch, Request("synthetic"))
    R.check_map(points, cover)
    assert float(cover.first()["coverage_percentage"]) == 75.0
    ridge = points.filter("source_id = 'ridge'").first()
    assert (str(ridge["latitude"]), str(ridge["longitude"])) == ("46.2500000", "7.5000000")
    for months in (None, (3, 9)):
        a = R.unit_counts(batch, Request("synthetic", months=months)).collect()
        assert a == R.unit_counts_by_membership(batch, Request("synthetic", months=months)).collect()
    assert {(r["source_id"], r["unit_count"]) for r in R.unit_counts(batch, Request("synthetic")).collect()} == {("ferry", 5), ("ridge", 3)}


def test_bundle_reads_one_batch(batch):
    frames = R.bundle(batch, Request("synthetic"))
    R.require_one_batch(frames, "b1")
    with pytest.raises(ContractError) as e:
        R.bundle(batch, Request("synthetic", year_from=2019))
    assert e.value.code == "YEARS_OUTSIDE_BATCH"


@pytest.mark.parametrize("request_, code", [
    (Request("other"), "DATASET_KIND"), (Request("official"), "BATCH_MODE"), (Request("synthetic", grain="day"), "GRAIN"),
    (Request("synthetic", year_from=2024, year_to=2020), "YEAR_RANGE"), (Request("synthetic", year_from=0), "YEAR_RANGE"),
    (Request("synthetic", months=()), "MONTHS"), (Request("synthetic", months=(1, 1)), "MONTHS"), (Request("synthetic", months=(13,)), "MONTHS"),
    (Request("synthetic", ()), "SOURCES"), (Request("synthetic", ("ferry", "ferry")), "SOURCES"), (Request("synthetic", (" ",)), "SOURCES"),
    (Request("synthetic", ("lagoon",)), "SOURCE")])
def test_request_rules(batch, request_, code):
    with pytest.raises(ContractError) as e:
        R.trend(batch, request_)
    assert e.value.code == code


def test_unfinished_batches_are_refused(batch):
    for state in ("running", "failed"):
        with pytest.raises(ContractError) as e:
            R.severity(replace(batch, status=state), Request("synthetic"))
        assert e.value.code == "BATCH_STATUS"
    with pytest.raises(ContractError) as e:
        R.severity(None, Request("synthetic"))
    assert e.value.code == "BATCH"


# ------------------------------------------------------------------------------------------------------- faulty variants

def gate_error(spark, rows):
    raw = small.raw(spark, rows)
    with pytest.raises(ContractError) as e:
        for s in small.manifest(rows).sources:
            P.check_source(raw, s)
    return e.value


def test_failed_build_is_logged(spark, native):
    rows = small.edit("ferry_crash", 0, Dead="-1")
    store = B.Store(scratch_path(spark, "store"))
    with pytest.raises(ContractError):
        B.build_batch(small.raw(spark, rows), small.manifest(rows), store, "b1", native(rows))
    assert [r["status"] for r in store.log(spark).collect()] == ["failed"]
    assert L.log_errors(store.log(spark)).count() == 0


@pytest.mark.parametrize(("change", "found"), [
    ("header", {("QA01_INPUT", "block"), ("QA02_RAW", "block")}), ("missing row", {("QA01_INPUT", "block"), ("QA02_RAW", "block")}),
    ("extra row", {("QA01_INPUT", "block"), ("QA02_RAW", "block")}), ("changed cell", {("QA01_INPUT", "block"), ("QA02_RAW", "block")})])
def test_a_file_changed_after_it_was_loaded_refuses_the_batch(spark, native, change, found):
    """Stored records and contract agree with each other; only the file tells."""
    m, raw, store, paths = small.manifest(), small.raw(spark), B.Store(scratch_path(spark, "store")), native()
    name = paths["delta_crash"].removeprefix("file://")
    lines = open(name).read().splitlines()
    lines = {"header": [lines[0].replace("All", "Sum"), *lines[1:]], "missing row": lines[:-1], "extra row": [*lines, lines[-1].replace("D-5", "D-6")],
             "changed cell": [*lines[:-1], lines[-1].replace("May", "June")]}[change]
    with open(name, "w") as out:
        out.write("\n".join(lines) + "\n")
    with pytest.raises(ContractError) as e:
        B.build_batch(raw, m, store, "b1", paths)
    assert e.value.code == "PUBLICATION_QA"
    refused = {(r["rule_id"], r["reason"]) for r in spark.read.parquet(e.value.details["table"]).filter("object_key <> 'batch'").collect()}
    assert (found if change != "header" else {("QA01_INPUT", "block")}) <= refused


def test_files_that_are_no_records(spark, tmp_path):
    m, paths = small.manifest(), small.files(tmp_path)
    with pytest.raises(ContractError) as e:
        read_native(spark, m, {k: v for k, v in paths.items() if k != "ridge_unit"})
    assert e.value.code == "NATIVE_FILE" and e.value.details["resource_ids"] == ["ridge_unit"]
    with open(tmp_path / "ridge_unit.csv", "a") as out:
        out.write("R6,C\n")
    with pytest.raises(ContractError) as e:
        read_native(spark, m, paths)
    assert e.value.code == "NATIVE_FORMAT" and e.value.details["row_width_mismatch"] == 1


def test_stored_rows_cannot_vouch_for_themselves(spark, built):
    """Expectation and count edited alike pass the row's own comparison; the recomputed expectation refuses them."""
    m, store = built
    rows = store.results(spark).filter("batch_id = 'b1'")
    crash, unit = store.crash(spark, "b1"), store.unit(spark, "b1")
    wanted = L.recomputed(spark, m, crash, unit)
    assert L.expectation_findings(rows, wanted).count() == 0
    for rule, key, metric in (("QA07_LOCATION", "source_year:delta:2021", "crash_count"), ("QA03_PROJECTED", "resource:ferry_unit", "projected_count"),
                              ("QA02_RAW", None, "raw_count")):
        hit = (F.col("rule_id") == rule) & (F.col("object_key") == key if key else F.col("object_key").contains("ridge_node_raw"))
        put = lambda side: F.col(side).withField("metrics", F.map_concat(F.map_filter(f"{side}.metrics", lambda k, v: k != metric), F.create_map(F.lit(metric), F.lit(9).cast("bigint"))))
        edited = rows.withColumns({side: F.when(hit, put(side)).otherwise(F.col(side)) for side in ("expected", "actual")})
        assert L.gate_findings(edited, L.required_objects(spark, m)).count() == 0
        assert [r["rule_id"] for r in L.expectation_findings(edited, wanted).collect()] == [rule]


def test_damaged_locations_reasons_and_notes(spark):
    """Each damage is made in the stored layer, past the projection; the second derivation tells it."""
    m, raw = small.manifest(), small.raw(spark)
    p = P.project_all(raw, m, "b")
    ridge, bare = F.col("source_id") == "ridge", F.col("crash_key") == '["F-18"]'
    moved = p.crash.withColumn("latitude", F.when(ridge, F.col("latitude") + F.lit("0.0000001").cast("decimal(10,7)")).otherwise(F.col("latitude")).cast("decimal(10,7)"))
    keys = lambda rows, rule: {r["object_key"] for r in rows.collect() if r["rule_id"] == rule and r["result"] == "block"}
    assert keys(Q.projection_results(raw, m, moved, p.unit, "b"), "QA03_PROJECTED") == {"resource:ridge_crash"}
    reason = F.when(bare, F.col("quality_notes").withField("location.reason_code", F.lit("unmapped"))).otherwise(F.col("quality_notes"))
    other = p.crash.withColumn("quality_notes", reason)
    assert keys(Q.projection_results(raw, m, other, p.unit, "b"), "QA03_PROJECTED") == set()
    assert keys(Q.semantics_results(raw, m, other, p.unit, "b"), "QA05_SEMANTICS") == {"source:ferry"}
    expected = Q.expected_locations(Q.expected_rows(raw, m)[0], "b")
    of = lambda crash: Q.location_results(Q.location_metrics(expected, W.facts(crash), W.dim_source(spark, m, "b"), 2020, 2024), "b")
    assert keys(of(p.crash), "QA07_LOCATION") == set()
    assert keys(of(moved), "QA07_LOCATION") == {"source_year:ridge:2021"}


def test_observations_that_differ_in_the_fortieth_place(spark):
    """Written alike they agree; one digit apart, far beyond any decimal type, they contradict each other in both derivations."""
    long = "46." + "0" * 39
    for second, place in ((f"0.46{'0' * 39}1e2", True), (f"{long}2", False)):
        rows = {**small.ROWS, "ridge_node_raw": (small.RIDGE_NODE, [("R5", "S9", f"{long}1", "7"), ("R5", "S9", second, "+7.0")])}
        m, raw = small.manifest(rows), small.raw(spark, rows)
        p = P.project_all(raw, m, "b")
        row = p.crash.filter("crash_key = '[\"R5\"]'").first()
        assert row["map_eligible"] is place
        assert Q.detail_differences(Q.expected_rows(raw, m)[0], p.crash).count() == 0


def test_build_verifies_layers_and_keeps_candidates(spark, built):
    m, store = built
    crash, unit, fact = store.crash(spark, "b1"), store.unit(spark, "b1"), store.fact(spark).filter("batch_id = 'b1'")
    B.verify_layers(small.raw(spark), m, crash, unit, fact, "b1")
    with pytest.raises(ContractError) as e:
        B.verify_layers(small.raw(spark), m, crash, unit, fact.withColumn("fatality_count", F.lit(9)), "b1")
    assert e.value.code == "LAYERS" and set(e.value.details) == {"fact_differences"}
    stored = store.vault.candidates(spark, "b1")
    expected = P.project_source(small.raw(spark), m.source("ridge"), "b1", m.year_from, m.year_to).candidates
    assert stored.count() == expected.count() > 0 and {r["source_id"] for r in stored.collect()} == {"ridge"}


def test_duplicate_crash(spark):
    rows = small.add("ferry_crash", small.ROWS["ferry_crash"][1][0])
    e = gate_error(spark, rows)
    assert e.code == "RELATIONSHIPS" and e.details["crash_duplicate_key_count"] == 1
    hit = results_of(spark, rows, "QA03")[("QA03_PROJECTED", "resource:ferry_crash")]
    assert hit["result"] == "block" and hit["actual"]["metrics"]["duplicate_key_count"] == 1


def test_orphan_unit_is_found_before_the_year_filter(spark):
    rows = small.add("ridge_unit", ("R77", "A", "BOAT"))
    assert gate_error(spark, rows).details["orphan_unit_count"] == 1
    got = results_of(spark, rows, "QA03", "QA04")
    assert {("QA03_PROJECTED", "resource:ridge_unit"), ("QA04_AUXILIARY", "resource:ridge_unit")} <= blocked(got)


def test_unmatched_person_reference(spark):
    got = results_of(spark, small.edit("ridge_person_raw", 0, SLED="Z"), "QA03", "QA04")
    assert blocked(got) == {("QA04_AUXILIARY", "resource:ridge_person_raw")}
    assert got[("QA04_AUXILIARY", "resource:ridge_person_raw")]["actual"]["metrics"]["nonblank_unmatched_count"] == 1


def test_invalid_date(spark):
    assert gate_error(spark, small.edit("ridge_crash", 1, DAY="2021-02-30")).details["invalid_year_count"] == 1


def test_negative_count(spark):
    assert gate_error(spark, small.edit("ferry_crash", 0, Dead="-1")).details["invalid_count_token_count"] == 1


def test_undefined_category(spark):
    rows = small.edit("delta_crash", 0, Harm="X")
    assert gate_error(spark, rows).details["undefined_category_count"] == 1
    assert ("QA05_SEMANTICS", "source:delta") in blocked(results_of(spark, rows, "QA05"))


def test_overflow_and_component_mismatch(spark):
    big = small.edit("ferry_crash", 0, Dead="2147483647", Badly_hurt="1")
    assert gate_error(spark, big).details["count_overflow_count"] == 1
    assert gate_error(spark, small.edit("delta_crash", 0, All="5")).details["component_total_mismatch_count"] == 1


def test_invalid_coordinate_blanks_the_location_only(spark):
    rows = small.edit("delta_crash", 0, Lat="-91")
    m, crash, _ = projected(spark, rows)
    row = crash.filter("source_id = 'delta' and crash_key = '[\"D-3\"]'").first()
    assert not row["map_eligible"] and row["latitude"] is None and row["location_crs"] is None
    assert row["quality_notes"]["location"]["reason_code"] == "invalid_coordinate"
    assert crash.count() == 8
    got = results_of(spark, rows, "QA07")
    assert not blocked(got) and got[("QA07_LOCATION", "source_year:delta:2021")]["result"] == "limited"


def test_unknown_crs(spark):
    m = small.without_crs(small.manifest(), "delta")
    _, crash, _ = projected(spark, m=m)
    reasons = {r["quality_notes"]["location"]["reason_code"] for r in crash.filter("source_id = 'delta'").collect()}
    assert reasons == {"definition_unconfirmed"}


def test_revised_batch_keeps_history(spark, built, native):
    m1, store = built
    assert B.build_batch(small.raw(spark), m1, store, "b2", native()) == "b1"          # nothing changed
    rows = small.edit("ferry_crash", 0, Dead="3")
    m2 = replace(small.manifest(rows), producer_version="v2")
    assert B.build_batch(small.raw(spark, rows), m2, store, "b3", native(rows)) == "b3"
    total = lambda b, m: tuple(B.open_batch(spark, store, m, b).fact.agg(F.sum("fatality_count"), F.sum("casualty_count")).first())
    assert total("b1", m1) == (4, 16) and total("b3", m2) == (6, 18)
    from crashmart.sources.sinks import current_pointer
    assert current_pointer(L.latest_status(store.log(spark))).first()["batch_id"] == "b3"
    with pytest.raises(ContractError) as e:
        B.build_batch(small.raw(spark), m1, store, "b1", native())
    assert e.value.code == "BATCH_EXISTS"


def test_deletion_needs_an_explanation(spark, native):
    before = small.raw(spark).filter("resource_id = 'delta_crash'").select("resource_id", F.col("payload")["No"].alias("key"))
    after = before.filter("key <> 'D-4'")
    lost = Q.snapshot_deletions(before, after, ["resource_id", "key"])
    assert [(r["key"], r["unexplained_count"]) for r in lost.collect()] == [("D-4", 1)]
    explained = before.filter("key = 'D-4'")
    assert Q.snapshot_deletions(before, after, ["resource_id", "key"], explained).count() == 0
    m = small.manifest()
    got = {r["object_key"].split(":")[1]: r for r in Q.input_results(read_native(spark, m, native())[0], m, "b", lost).collect()}
    assert got["delta_crash"]["result"] == "block" and got["ferry_crash"]["result"] == "pass"


def test_declared_meaning_of_missing_severity(spark):
    """A rule-only rebuild: one more known crash, the same totals."""
    m = small.manifest()
    known = Category("O", "no harm", False, "things alone were damaged")
    m = replace(m, sources=tuple(replace(s, severity=replace(s.severity, missing_override=known)) if s.source_id == "ferry" else s for s in m.sources))
    _, crash, _ = projected(spark, m=m)
    row = crash.agg(F.count_if("fatal_crash_eligible"), F.count_if("is_fatal_crash"), F.sum("fatality_count"), F.sum("casualty_count")).first()
    assert tuple(row) == (8, 3, 4, 16)
    ruled = crash.filter("quality_notes.severity_rule is not null").collect()
    assert [r["crash_key"] for r in ruled] == ['["F-18"]']


def test_gate_finds_missing_extra_duplicate_and_limited(spark, built):
    m, store = built
    rows = store.results(spark).filter("batch_id = 'b1'")
    need = L.required_objects(spark, m)
    assert L.gate_findings(rows, need).count() == 0
    some = rows.filter("not (rule_id = 'QA06_RECONCILIATION' and object_key = 'source_year:ridge:2022')")
    assert [r["reason"] for r in L.gate_findings(some, need).collect()] == ["missing"]
    extra = rows.unionByName(rows.filter("rule_id = 'QA01_INPUT'").limit(1).withColumn("object_key", F.lit("file:other")))
    assert [r["reason"] for r in L.gate_findings(extra, need).collect()] == ["extra"]
    one = rows.filter("rule_id = 'QA05_SEMANTICS' and object_key = 'source:ferry'")
    assert [r["reason"] for r in L.gate_findings(rows.unionByName(one), need).collect()] == ["duplicate"]
    limited = rows.withColumn("result", F.when(F.col("object_key") == "source:ferry", "limited").otherwise(F.col("result")))
    assert "limited_not_allowed" in {r["reason"] for r in L.gate_findings(limited, need).collect()}
    assert L.summary_differences(rows).count() == 0
    assert L.summary_differences(limited).count() == 1
