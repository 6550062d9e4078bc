"""Incremental load, digests and commits: against the plain operators, and with writers that race."""

from __future__ import annotations

from collections import Counter
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from crashmart.errors import ContractError
from crashmart.operators import compare as C, digests as D
from crashmart.plans import load as N, project as P, registry as G
from crashmart.session import scratch_path
from crashmart.sources import commits
from tests import small


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def texts(df):
    return Counter(r[0] for r in df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect())


@pytest.mark.parametrize("buckets", [1, 3, 4096])
def test_pruned_difference(spark, buckets):
    """Repeated rows, NULLs on either place, empty text, rows of one side only: the rows of the full comparison."""
    kind = "a string, b int, more int"
    left = spark.createDataFrame([("x", 1, 1)] * 3 + [(None, 1, 1), ("1", None, 1), ("", 2, 1), ("same", 5, 1), ("same", 5, 2)], kind)
    right = spark.createDataFrame([("x", 1, 9)] * 2 + [("1", 1, 9), (None, None, 9), ("same", 5, 9), ("same", 5, 9), ("new", 7, 9)], kind)
    got, want = (f(left, right, ["a", "b"]) for f in (lambda *a: D.pruned_difference(*a, buckets=buckets), C.multiset_difference))
    assert counted(got) == counted(want) and sum(counted(want).values()) == 7
    assert D.pruned_difference(left, left.repartition(3), ["a", "b"], buckets=buckets).count() == 0
    assert counted(D.pruned_difference(left.limit(0), right, ["a", "b"], buckets=buckets)) == counted(C.multiset_difference(left.limit(0), right, ["a", "b"]))


def test_only_buckets_that_differ_are_open(spark):
    left = spark.range(20_000).select(F.col("id").alias("k"), (F.col("id") % 7).alias("v"))
    right = left.withColumn("v", F.when(F.col("k") == 77, 100).otherwise(F.col("v")))
    assert D.open_buckets(left, left.orderBy(F.desc("k")), ["k", "v"]).count() == 0
    assert D.open_buckets(left, right, ["k", "v"]).count() in (1, 2)
    assert counted(D.pruned_difference(left, right, ["k", "v"])) == {(77, 0, "left", 1): 1, (77, 100, "right", 1): 1}


def test_group_digests_tell_sets_apart(spark):
    rows = [("a", "1", "2"), ("b", "2", "1"), ("c", "1", None), ("d", None, "1"), ("e", "12", ""), ("f", "", "12")]
    found = {r["k"]: r["digest"] for r in D.group_digests(spark.createDataFrame(rows, "k string, x string, y string"), ["k"], ["x", "y"]).collect()}
    assert len(set(found.values())) == 6
    twice = D.group_digests(spark.createDataFrame([("a", "1", "2")] * 2, "k string, x string, y string"), ["k"], ["x", "y"]).first()
    assert twice["row_count"] == 2 and twice["digest"] != found["a"]


@pytest.fixture(scope="module")
def loaded(spark):
    vault = N.Vault(scratch_path(spark, "vault"))
    N.load_batch(small.raw(spark), small.manifest(), vault, "b1")
    rows = small.edit("ferry_crash", 0, Dead="7")
    N.load_batch(small.raw(spark, rows), small.manifest(rows), vault, "b2")
    return vault, rows


def test_only_the_changed_source_is_written(spark, loaded):
    vault, _ = loaded
    states = {(r["batch_id"], r["source_id"]): (r["state"], r["data_batch_id"]) for r in vault.ledger(spark).collect()}
    assert states == {**{("b1", s): ("new", "b1") for s in ("ferry", "ridge", "delta")}, ("b2", "ferry"): ("changed", "b2"),
                      ("b2", "ridge"): ("same", "b1"), ("b2", "delta"): ("same", "b1")}
    for name in ("sat_crash", "sat_unit", "link_unit"):
        written = spark.read.parquet(vault.path(name)).filter("batch_id = 'b2'").select("source_id").distinct()
        assert [r[0] for r in written.collect()] == ["ferry"]


def test_every_batch_stays_readable(spark, loaded):
    """Rows read back equal a full projection of the batch's own snapshot, reused slices included."""
    vault, rows = loaded
    for batch, given in (("b1", None), ("b2", rows)):
        m = small.manifest(given)
        p = P.project_all(small.raw(spark, given), m, batch)
        assert texts(vault.crash(spark, batch)) == texts(p.crash.select(*vault.crash(spark, batch).columns))
        assert texts(vault.unit(spark, batch)) == texts(p.unit.select(*vault.unit(spark, batch).columns))
        assert vault.candidates(spark, batch).count() == p.candidates.count()
    assert vault.crash(spark, "never").count() == 0


def test_hubs_and_registry_hold_each_identity_once(spark, loaded):
    vault, rows = loaded
    hub = vault.hub(spark, "crash")
    assert hub.count() == hub.select("source_id", "release_scope", "crash_key").distinct().count() == vault.crash(spark, "b1").count()
    assert {r[0] for r in hub.select("first_batch_id").distinct().collect()} == {"b1"}
    stored, again = vault.registry(spark), small.raw(spark, rows)
    assert G.rows_to_insert(stored, again).count() == 0 and G.rows_to_insert(stored, small.raw(spark)).count() == 0
    new_rows = len(rows["ferry_crash"][1])       # the edited file has another hash, so all its records are new
    assert stored.count() == small.raw(spark).count() + new_rows


def test_a_load_is_refused_or_repeated(spark, loaded):
    vault, rows = loaded
    with pytest.raises(ContractError) as e:
        N.load_batch(small.raw(spark), small.manifest(), vault, "b1")
    assert e.value.code == "BATCH_EXISTS"
    altered = small.raw(spark).withColumn("payload", F.when(F.col("source_id") == "delta", F.map_concat(
        F.map_filter("payload", lambda k, v: k != "Lat"), F.create_map(F.lit("Lat"), F.lit("1.5")))).otherwise(F.col("payload")))
    with pytest.raises(ContractError) as e:
        N.load_batch(altered, small.manifest(), vault, "b3")
    assert e.value.code == "RAW_CONFLICT"
    assert vault.ledger(spark).filter("batch_id = 'b3'").count() == 0


def test_of_racing_writers_one_wins(spark, tmp_path):
    folder = f"file://{tmp_path}/commits"
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda _: commits.claim_next(spark, folder, 0), range(8)))
    assert sorted(won) == [False] * 7 + [True] and commits.last_number(spark, folder) == 1
    assert commits.claim_next(spark, folder, 1) and not commits.claim_next(spark, folder, 0)
    assert commits.last_number(spark, folder) == 2 and commits.last_number(spark, f"file://{tmp_path}/none") == 0


def test_pruned_pairs_keep_every_difference(spark):
    """Rows repeated, missing, changed, NULL in keys and fields; a side whose count has another type."""
    left = [("a", str(i), i % 7, f"x{i % 5}") for i in range(400)] + [(None, "1", 1, "n"), ("b", None, None, "n"), ("c", "9", 9, None), ("c", "9", 9, None), ("d", "1", 1, "1")]
    right = [r for r in left if r[1] != "33"] + [("c", "9", 9, None), ("a", "7", 0, "x2"), ("e", "1", 1, "1")]
    right = [("a", "50", 50, None) if r[:2] == ("a", "50") else r for r in right]
    right = [(None, "1", 2, "n") if r[0] is None else r for r in right]
    one = spark.createDataFrame(left, "g string, k string, n int, t string")
    two = spark.createDataFrame(right, "g string, k string, n bigint, t string")
    fields = ["n", "t"]
    odd = (F.col("left_count") != F.col("right_count")) | C.field_mismatch(fields)
    rows = lambda df: sorted(map(str, df.collect()))
    want = rows(C.pair_rows(one, two, ["g", "k"], fields).filter(odd))
    assert len(want) == 6
    for buckets in (1, 8, 4096):
        pruned = D.pruned_pairs(one, two, ["g"], ["g", "k"], fields, buckets)
        assert rows(pruned.filter(odd)) == want
    assert pruned.count() < 30 and D.pruned_pairs(one, one, ["g"], ["g", "k"], fields).count() == 0


def test_shuffles_go_when_a_table_is_written(spark, tmp_path):
    """The shuffles of one written table were still on disk when the next one was made."""
    import time
    from pathlib import Path
    from crashmart.session import materialize
    store = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    folders = [Path(str(d)) for d in store.localDirs()]
    files = lambda: {f for d in folders for f in d.rglob("shuffle_*.data")}
    before = files()
    df = materialize(spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count().repartition(3, "count"), "counts")
    for _ in range(50):      # they are removed in the background
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before and df.count() == 100
