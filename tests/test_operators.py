"""Functions and operators: edge tokens, the location ladder, hot keys, link checks by brute force."""

from __future__ import annotations

from collections import Counter

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from crashmart import functions as fn
from crashmart.contracts import Coverage
from crashmart.operators import compare as C, observations as O, relations as rel
from crashmart.plans import links as K, quality as Q, registry as G
from tests import small


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


@pytest.mark.parametrize("token, blank", [(None, True), ("", True), ("　\u001c", True), ("\u0085 ", True), (" 0001", False), ("​", False), ("a\n", False)])
def test_blank(spark, token, blank):
    assert one(spark, token, fn.is_blank("v")) is blank


def test_key_text(spark):
    assert one(spark, "00 1", fn.encode_key("v", F.lit('x"y'))) == '["00 1","x\\"y"]'
    assert one(spark, "1", fn.spaced_key("v", F.lit("2"))) == '["1", "2"]'
    assert one(spark, " ", fn.try_encode_key("v")) is None
    with pytest.raises(Exception, match="non-blank"):
        one(spark, "　", fn.encode_key("v"))


@pytest.mark.parametrize("token, number", [("0", 0), ("007", 7), ("2147483647", 2147483647), ("2147483648", None), ("-1", None), (" 12", None), ("1.0", None), ("", None), ("5\n", None), (None, None)])
def test_count_token(spark, token, number):
    assert one(spark, token, fn.count_token("v")) == number


@pytest.mark.parametrize("token, day", [("2020-02-29", "2020-02-29"), ("2021-02-29", None), ("2021-2-3", None), ("2021-01-01 ", None), ("0000-01-01", None), (None, None)])
def test_iso_date(spark, token, day):
    assert one(spark, token, F.date_format(fn.iso_date("v"), "yyyy-MM-dd")) == day


@pytest.mark.parametrize("a, b, want", [(0, 0, None), (1, 3, 33.33), (2, 3, 66.67), (1, 800, 0.13), (5, 7, 71.43), (3, 3, 100.0)])
def test_percentage(spark, a, b, want):
    got = spark.range(1).select(fn.percentage(F.lit(a), F.lit(b))).first()[0]
    assert (None if got is None else float(got)) == want


def test_half_up_rounding(spark):
    assert str(one(spark, "-37.80000005", fn.to_scale7(fn.decimal_token("v")))) == "-37.8000001"


@pytest.mark.parametrize("text, position", [("csv:12", 12), ('["a b", 3]', 3), ("csv:0", None), ("csv:", None), ("12", None)])
def test_locators(spark, text, position):
    got = one(spark, text, fn.locator_position("v"))
    assert (None if got is None else int(got)) == position


# ------------------------------------------------------------------------------------------------------------- location

def ladder(spark, pairs, crs=True):
    rows = [("k", la, lo, f"r{i}", "h", "p", f"csv:{i}") for i, (la, lo) in enumerate(pairs, 1)]
    df = spark.createDataFrame(rows, "k string, la string, lo string, raw_record_id string, file_sha256 string, parser_version string, row_locator string")
    r = O.resolve(df, ["k"], "la", "lo", crs)
    return O.locate(spark.createDataFrame([("k",)], "k string"), r, ["k"]).first()


@pytest.mark.parametrize("pairs, crs, reason, resolution", [
    ([], True, "no_location", "no_matching_observation"),
    ([("1", "2"), (None, "2")], True, "invalid_coordinate", O.INCOMPLETE),
    ([("1", "2"), ("x", "2")], True, "invalid_coordinate", O.TOKEN),
    ([("NaN", "2")], True, "invalid_coordinate", O.TOKEN),
    ([("91", "2")], True, "invalid_coordinate", O.LATITUDE),
    ([("123456", "2")], True, "invalid_coordinate", O.LATITUDE),
    ([("90", "-181")], True, "invalid_coordinate", O.LONGITUDE),
    ([("1", "181"), ("", "2")], True, "invalid_coordinate", O.LONGITUDE),
    ([("1.00000001", "2"), ("1.00000002", "2")], True, "location_conflict", "conflicting_coordinate_observations"),
    ([("1", "2"), ("1.0", "2.00")], False, "crs_unconfirmed", "coordinates_agree_but_crs_is_unconfirmed"),
    ([("-37.8", "144.9"), ("-37.8000", "144.9000")], True, "", "equivalent_observations_resolved")])
def test_ladder(spark, pairs, crs, reason, resolution):
    r = ladder(spark, pairs, crs)
    assert (r["reason_code"], r["resolution"], r["map_eligible"]) == (reason, resolution, reason == "")
    assert (r["latitude"] is not None) == (reason == "")


def test_representative_is_the_lowest_numeric_position(spark):
    r = ladder(spark, [("1", "2")] * 12)
    assert r["location_record_id"] == "r1" and r["observation_count"] == 12
    rows = [("k", "1", "2", "late", "h", "p", "csv:10"), ("k", "1", "2", "early", "h", "p", "csv:9")]
    df = spark.createDataFrame(rows, "k string, la string, lo string, raw_record_id string, file_sha256 string, parser_version string, row_locator string")
    assert O.resolve(df, ["k"], "la", "lo", True).first()["location_record_id"] == "early"


# -------------------------------------------------------------------------------------------------------------- hot keys

def test_attach_gives_the_plain_join_with_a_hot_key(spark):
    rows = [(i, "hot" if i % 3 == 0 else None if i % 3 == 1 else f"k{i % 40}") for i in range(900)]
    detail = spark.createDataFrame(rows, "id int, k string")
    groups = detail.filter("k is not null").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    got = rel.attach(detail, groups, ["k"], ["n", "top"])
    want = detail.join(groups, "k", "left").select("id", "k", "n", "top")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_attach_splits_a_hot_key(spark):
    """A key with a third of the rows is dealt to several tasks."""
    conf = {"spark.sql.shuffle.partitions": "8", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        n = 200_000
        detail = spark.range(0, n, 1, 8).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 1000).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        groups = detail.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
        found = rel.attach(detail, groups, ["k"], ["n"])
        tasks = found.groupBy(F.spark_partition_id().alias("task")).agg(F.count("n").alias("rows"), F.max("pad")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r["rows"] for r in tasks) == n and max(r["rows"] for r in tasks) < n / 6


def test_repeated_keys_never_multiply(spark):
    left = spark.createDataFrame([("a", 1)] * 300 + [("b", 1)], "k string, v int")
    right = spark.createDataFrame([("a", 2)] * 300, "k string, v int")
    got = {r["k"]: r for r in C.pair_rows(left, right, ["k"], ["v"]).collect()}
    assert len(got) == 2 and (got["a"]["left_count"], got["a"]["right_count"]) == (300, 300)


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 2))), max_size=12),
       st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(0, 2))), max_size=12))
def test_multiset_difference_equals_counters(spark, a, b):
    kind = "k string, v int"
    got = C.multiset_difference(spark.createDataFrame(a, kind), spark.createDataFrame(b, kind), ["k", "v"]).collect()
    ca, cb = Counter(a), Counter(b)
    want = {(k, "left"): n for k, n in (ca - cb).items()} | {(k, "right"): n for k, n in (cb - ca).items()}
    assert {((r["k"], r["v"]), r["side"]): r["extra_count"] for r in got} == want


# ----------------------------------------------------------------------------------------------------------- link checks

PARENTS = [("p1", "2020-05-01", "2"), ("p2", "2019-05-01", "1"), ("p2", "2019-05-01", "1"), ("p3", "bad", "x"), (" ", "2020-01-01", "0"), ("p4", "2020-01-01", "")]
CHILDREN = [("p1", "c1", "t1"), ("p1", "c1", ""), ("p1", "c2", "t9"), ("p2", "c1", "t2"), ("p9", "c1", "t1"), ("", "c1", "t1"), ("p3", " ", "　"), ("p1", "c3", "t3")]
TARGETS = [("p1", "t1"), ("p1", "t3"), ("p1", "t3"), ("p2", "t2"), ("p8", "t1"), ("p1", "")]


def link_frames(spark):
    def frame(name, rows, cols):
        full = [("s", name, f"csv:{i}", f"{name}{i}", *r) for i, r in enumerate(rows, 1)]
        return spark.createDataFrame(full, "source_id string, resource_id string, row_locator string, raw_record_id string, " + ", ".join(f"{c} string" for c in cols))
    return (frame("parents", PARENTS, ["parent_key", "date_text", "count_text"]), frame("children", CHILDREN, ["parent_key", "child_key", "target_key"]),
            frame("targets", TARGETS, ["parent_key", "target_key"]))


def test_link_checks(spark):
    checks = K.check_links(*link_frames(spark), K.LinkRules(2020, 2024))
    p = {r["row_locator"]: r for r in checks.parents.collect()}
    assert p["csv:1"]["issues"] == ["child_count_mismatch"] and p["csv:1"]["count_delta"] == 2
    assert p["csv:2"]["issues"] == ["duplicate_parent_key"] and p["csv:2"]["count_state"] == "invalid" and p["csv:2"]["in_scope"] is False
    assert p["csv:4"]["issues"] == ["invalid_parent_date", "invalid_child_count"] and p["csv:4"]["in_scope"] is None
    assert p["csv:5"]["issues"] == ["invalid_parent_key"] and p["csv:5"]["observed_count"] is None
    assert p["csv:6"]["count_state"] == "missing" and p["csv:6"]["issues"] == []
    c = {r["row_locator"]: (r["target_reference"], r["issues"]) for r in checks.children.collect()}
    assert c["csv:1"] == ("matched", ["duplicate_child_key"])
    assert c["csv:2"] == ("allowed_blank", ["duplicate_child_key"])
    assert c["csv:3"] == ("unmatched", ["unmatched_nonblank_target_ref"])
    assert c["csv:4"] == ("matched", ["ambiguous_parent"])
    assert c["csv:5"] == ("unmatched", ["missing_parent", "unmatched_nonblank_target_ref"])
    assert c["csv:6"] == ("invalid_parent_key", ["invalid_parent_key"])
    assert c["csv:7"] == ("invalid_whitespace", ["invalid_child_key", "invalid_target_reference"])
    assert c["csv:8"] == ("ambiguous", ["ambiguous_target_reference"])
    t = {r["row_locator"]: r["issues"] for r in checks.targets.collect()}
    assert t["csv:2"] == ["duplicate_target_key"] and t["csv:5"] == ["missing_parent"] and t["csv:6"] == ["invalid_target_key"]
    s = K.summary(checks).first()
    assert (s["evaluated_count"], s["nonblank_unmatched_count"], s["declared_count_delta"]) == (20, 2, 2)
    refs = K.mismatch_references(checks, link_frames(spark)[1], K.LinkRules(2020, 2024), "child").orderBy("position").collect()
    assert [r["row_locator"] for r in refs] == ["csv:1", "csv:2", "csv:3", "csv:8"]


@pytest.mark.parametrize("rule, state", [("forbidden", "forbidden_blank"), ("unresolved", "unresolved_blank")])
def test_blank_reference_rules(spark, rule, state):
    checks = K.check_links(*link_frames(spark), K.LinkRules(2020, 2024, blank_reference=rule))
    row = checks.children.filter("row_locator = 'csv:2'").first()
    assert row["target_reference"] == state and len(row["issues"]) == 2


# ----------------------------------------------------------------------------------------------------------------- raw

def test_raw_load_is_idempotent(spark):
    raw = small.raw(spark)
    count = lambda df: {r["state"]: r["count"] for r in df.groupBy("state").count().collect()}
    assert count(G.load_states(raw.limit(0), raw)) == {"insert": 23}
    assert count(G.load_states(raw, raw)) == {"reuse": 23}
    changed = raw.withColumn("payload", F.map_concat(F.map_filter("payload", lambda k, v: k != "No"), F.create_map(F.lit("No"), F.lit("z"))))
    assert count(G.load_states(raw.filter("source_id = 'delta'"), changed.filter("source_id = 'delta'"))) == {"conflict": 3}
    assert G.rows_to_insert(raw, raw).count() == 0


def test_replay_reasons(spark):
    raw = small.raw(spark).filter("resource_id = 'ferry_unit'")
    stored = raw.filter("row_locator <> 'csv:1'").unionByName(raw.filter("row_locator = 'csv:2'"))
    got = {r["row_locator"]: r["reason_codes"] for r in G.replay_differences(raw, stored).collect()}
    assert got == {"csv:1": ["RAW_MISSING_LOCATOR"], "csv:2": ["RAW_DUPLICATE_LOCATOR"], "csv:3": [], "csv:4": [], "csv:5": []}


def test_coverage_change():
    a = (Coverage(2020, 2022, (1, 2), "x"),)
    assert Q.coverage_explained(a, (Coverage(2019, 2023, (1, 2, 3), "x"),))
    assert not Q.coverage_explained(a, (Coverage(2020, 2021, (1, 2), "x"),))
    assert not Q.coverage_explained(a, (Coverage(2020, 2022, (1, 2), "y"),))
    assert Q.coverage_explained(a, (Coverage(2020, 2021, (1, 2), "x"),), (a, (Coverage(2020, 2021, (1, 2), "x"),)))


def test_number_tokens(spark):
    """Suffixes and hexadecimal forms are no numbers; a number too large for any double is one, out of range."""
    rows = [("12.5d", "1"), ("0x1p3", "1"), ("1e400", "1"), ("NaN", "1"), ("Infinity", "1"), (" 12.5 ", "1"), ("+.5", "1"), ("5.", "1"), ("1", "12.5f")]
    got = [r["d"] for r in spark.createDataFrame(rows, "a string, b string").select(O.classify(F.col("a"), F.col("b")).alias("d")).collect()]
    assert got == [O.TOKEN, O.TOKEN, O.LATITUDE, O.TOKEN, O.TOKEN, None, None, None, O.TOKEN]
