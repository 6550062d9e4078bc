"""Relation, comparison and filter operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashmart.model import contract_frame
from crashmart.operators import compare as C, filters, relations as rel
from crashmart.plans import quality as Q, snapshots as S

from . import tables as t
from .registry import query


@query("duplicate_groups", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_groups(spark, sf):
    return rel.duplicate_groups(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("duplicate_flags", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n,
 count(*) FILTER (WHERE l_quantity > 25) OVER (PARTITION BY l_orderkey, l_linenumber) AS big_n FROM lineitem""")
def duplicate_flags(spark, sf):
    """Every row with the size of its key group and a filtered size: grouped once, attached to each member."""
    li = t.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    key = ["l_orderkey", "l_linenumber"]
    groups = li.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("l_quantity") > 25).alias("big_n"))
    return rel.attach(li, groups, key, ["n", "big_n"]).drop("l_quantity")


@query("orphan_children", """SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL""")
def orphan_children(spark, sf):
    """Lineitems whose parent is not among the given parents, by key."""
    parents = t.table(spark, sf, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return rel.orphans(t.table(spark, sf, "lineitem"), parents, ["l_orderkey"])


@query("childless_parents", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def childless_parents(spark, sf):
    children = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.absent(t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus"), children, ["o_orderkey"])


@query("parents_with_returns", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def parents_with_returns(spark, sf):
    children = t.table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.existing(t.table(spark, sf, "orders").select("o_orderkey"), children, ["o_orderkey"])


@query("declared_vs_observed", """SELECT o_orderkey, o_orderkey % 8 AS declared_count, count(l_orderkey) AS observed_count, count(l_orderkey) - o_orderkey % 8 AS count_delta
 FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def declared_vs_observed(spark, sf):
    orders = t.table(spark, sf, "orders").select("o_orderkey")
    li = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"))
    return rel.declared_vs_observed(orders, ["o_orderkey"], F.col("o_orderkey") % 8, li)


@query("category_totals", """SELECT c.native_value, c.display_order, count(o_orderkey) AS row_count FROM (VALUES ('1-URGENT', 1), ('2-HIGH', 2), ('5-LOW', 3), ('9-NONE', 4)) c(native_value, display_order)
 LEFT JOIN orders ON o_orderpriority = c.native_value GROUP BY ALL""")
def category_totals(spark, sf):
    """Listed categories only; one that never occurs is an explicit zero."""
    cats = contract_frame(spark, [("1-URGENT", 1), ("2-HIGH", 2), ("5-LOW", 3), ("9-NONE", 4)], "native_value string, display_order int")
    return rel.category_totals(t.table(spark, sf, "orders"), F.col("o_orderpriority"), cats, "native_value", "row_count")


@query("undeclared_categories", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def undeclared_categories(spark, sf):
    return filters.undeclared(t.table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", ["1-URGENT", "2-HIGH", "3-MEDIUM"])


@query("examples_per_group", """SELECT o_orderpriority, o_orderkey, CAST(rn AS INTEGER) AS example_no FROM (
 SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 5""")
def examples_per_group(spark, sf):
    """Five traceable examples per category (a top-k report)."""
    orders = t.table(spark, sf, "orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    return rel.first_per_group(orders, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 5).drop("o_totalprice")


def _snapshots(spark, sf):
    """Two snapshots of the orders: open ones vanish later, urgent ones change price, and low ones are new."""
    o = t.table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    before = o.filter("o_orderpriority <> '5-LOW'")
    after = o.filter("o_orderstatus <> 'O'").withColumn("cents", F.when(F.col("o_orderpriority") == "1-URGENT", F.col("cents") + 1).otherwise(F.col("cents")))
    return before, after


SNAP = """WITH o AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents FROM orders),
 b AS (SELECT * FROM o WHERE o_orderpriority <> '5-LOW'),
 a AS (SELECT o_orderkey, o_orderstatus, o_orderpriority, cents + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS cents FROM o WHERE o_orderstatus <> 'O')
"""


@query("multiset_difference", """WITH b AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'F'), a AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_linestatus = 'O')
 SELECT l_suppkey, l_returnflag, 'left' AS side, count(*) AS extra_count FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) GROUP BY ALL
 UNION ALL SELECT l_suppkey, l_returnflag, 'right', count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) GROUP BY ALL""")
def multiset_difference(spark, sf):
    """Surplus rows of either side, with multiplicity."""
    li = t.table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus")
    return C.multiset_difference(li.filter("l_linestatus = 'F'"), li.filter("l_linestatus = 'O'"), ["l_suppkey", "l_returnflag"])


SNAPSHOT_ROWS = SNAP + """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(cents AS VARCHAR) AS cents, side, CAST(1 AS BIGINT) AS extra_count FROM (
 SELECT *, 'left' AS side FROM (SELECT o_orderkey, cents FROM b EXCEPT ALL SELECT o_orderkey, cents FROM a)
 UNION ALL SELECT *, 'right' FROM (SELECT o_orderkey, cents FROM a EXCEPT ALL SELECT o_orderkey, cents FROM b))"""


@query("snapshot_rows", SNAPSHOT_ROWS)
def snapshot_rows(spark, sf):
    before, after = _snapshots(spark, sf)
    return S.row_differences(before, after, ["o_orderkey", "cents"])


@query("snapshot_digest_rows", SNAPSHOT_ROWS)
def snapshot_digest_rows(spark, sf):
    """The same rows, found by digests of buckets first."""
    return S.changed_rows(*_snapshots(spark, sf), ["o_orderkey", "cents"])


@query("snapshot_deletions", SNAP + """SELECT o_orderkey, CAST(1 AS BIGINT) AS unexplained_count FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a) AND o_orderpriority <> '2-HIGH'""")
def snapshot_deletions(spark, sf):
    """Keys that disappeared, except those a declared change names (here: all of one category)."""
    before, after = _snapshots(spark, sf)
    explained = before.filter("o_orderpriority = '2-HIGH'")
    return Q.snapshot_deletions(before, after, ["o_orderkey"], explained)


@query("snapshot_count_changes", SNAP + """SELECT o_orderpriority, coalesce(x.n, 0) AS before_count, coalesce(y.n, 0) AS after_count
 FROM (SELECT o_orderpriority, count(*) AS n FROM b GROUP BY ALL) x FULL JOIN (SELECT o_orderpriority, count(*) AS n FROM a GROUP BY ALL) y USING (o_orderpriority)
 WHERE coalesce(x.n, 0) <> coalesce(y.n, 0)""")
def snapshot_count_changes(spark, sf):
    before, after = _snapshots(spark, sf)
    return S.count_changes(before, after, ["o_orderpriority"])


@query("references_still_absent", SNAP + """SELECT o_orderkey, o_orderkey NOT IN (SELECT o_orderkey FROM a) AS still_absent FROM b""")
def references_still_absent(spark, sf):
    before, after = _snapshots(spark, sf)
    return S.still_absent(before.select("o_orderkey"), after, ["o_orderkey"])


@query("coordinates_equal", """WITH l AS (SELECT l_orderkey AS k, CAST(l_suppkey % 3 AS VARCHAR) || '.50' AS v FROM lineitem), r AS (SELECT o_orderkey AS k, CAST(o_orderkey % 3 AS VARCHAR) || '.5' AS v FROM orders)
 SELECT r.k, count(l.k) AS matched_rows, coalesce(bool_and(CAST(l.v AS DECIMAL(18,6)) = CAST(r.v AS DECIMAL(18,6))), false) AS numerically_equal FROM r LEFT JOIN l ON l.k = r.k GROUP BY r.k""")
def coordinates_equal(spark, sf):
    """Numeric equality of differently written values (2.50 and 2.5), all rows of a key considered."""
    left = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.concat((F.col("l_suppkey") % 3).cast("string"), F.lit(".50")).alias("v"))
    right = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.concat((F.col("o_orderkey") % 3).cast("string"), F.lit(".5")).alias("v"))
    return S.numerically_equal(left, right, "k", ["v"])


@query("identity_difference", SNAP + """SELECT o_orderkey, 'missing' AS state FROM b WHERE o_orderkey NOT IN (SELECT o_orderkey FROM a)
 UNION ALL SELECT o_orderkey, 'unexpected' FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def identity_difference(spark, sf):
    before, after = _snapshots(spark, sf)
    return C.identity_difference(before, after, ["o_orderkey"])


@query("full_outer_pairs", SNAP + """SELECT coalesce(b.o_orderkey, a.o_orderkey) AS o_orderkey, CAST(CASE WHEN b.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS left_count,
 CAST(CASE WHEN a.o_orderkey IS NULL THEN 0 ELSE 1 END AS BIGINT) AS right_count, coalesce(b.cents <> a.cents, false) AS mismatch, b.cents AS left_cents, a.cents AS right_cents
 FROM b FULL JOIN a ON a.o_orderkey = b.o_orderkey""")
def full_outer_pairs(spark, sf):
    """Both sides of every key with presence counts and a NULL-aware mismatch flag."""
    before, after = _snapshots(spark, sf)
    p = C.pair_rows(before, after, ["o_orderkey"], ["cents", "o_orderstatus"])
    return p.select("o_orderkey", "left_count", "right_count", C.field_mismatch(["cents", "o_orderstatus"]).alias("mismatch"),
                    F.col("left_row.cents").alias("left_cents"), F.col("right_row.cents").alias("right_cents"))


@query("histogram_match", """SELECT o_orderpriority AS token, count(*) AS actual_count, CAST(CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 0 END AS BIGINT) AS expected_count
 FROM orders GROUP BY ALL UNION ALL SELECT '0-GONE', 0, 7""")
def histogram_match(spark, sf):
    """Token counts against a frozen histogram: changed, new and vanished tokens."""
    frozen = contract_frame(spark, [("1-URGENT", 1), ("0-GONE", 7)], "token string, expected_count bigint")
    return Q.histogram_differences(t.table(spark, sf, "orders"), F.col("o_orderpriority"), frozen)


@query("registered_exceptions", """WITH o AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem GROUP BY ALL HAVING count(*) > 3),
 r AS (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity >= 49)
 SELECT l_orderkey, l_linenumber, CASE WHEN o.f AND r.f THEN 'registered_native_limitation' WHEN r.f THEN 'registered_case_absent' ELSE 'unregistered_case' END AS disposition
 FROM (SELECT *, true AS f FROM o) o FULL JOIN (SELECT *, true AS f FROM r) r USING (l_orderkey, l_linenumber)""")
def registered_exceptions(spark, sf):
    """Observed anomalies against a registered case list, exact both ways."""
    li = t.table(spark, sf, "lineitem")
    observed = rel.key_sizes(li, ["l_orderkey", "l_linenumber"]).filter("n > 3")
    return Q.registered_exceptions(observed, li.filter("l_quantity >= 49"), ["l_orderkey", "l_linenumber"])


@query("filtered_facts", t.SQL_BASE + "SELECT source_id, crash_key FROM crash WHERE y BETWEEN 1996 AND 1998 AND source_id IN ('asia', 'europe') AND m IN (1, 6)")
def filtered_facts(spark, sf):
    """Year interval, optional source list and month list (unknown months drop out)."""
    df = filters.within_years(t.fact(spark, sf), "occurrence_year", 1996, 1998)
    return filters.in_months(filters.among(df, "source_id", ["asia", "europe"]), [1, 6]).select("source_id", "crash_key")


@query("null_aware_differences", t.SQL_BASE + "SELECT source_id, count(*) FILTER (WHERE deaths IS DISTINCT FROM hurt) AS differing_count FROM crash GROUP BY ALL")
def null_aware_differences(spark, sf):
    differing = filters.any_differs([(F.col("fatality_count"), F.col("casualty_count"))])
    return t.crash(spark, sf).groupBy("source_id").agg(F.count_if(differing).alias("differing_count"))


@query("attribute_struct", t.SQL_BASE + "SELECT source_id, crash_key, sev AS severity_code, mapped AS map_eligible FROM crash")
def attribute_struct(spark, sf):
    """Row to one attribute struct without its keys, and back."""
    df = filters.attributes_of(t.crash(spark, sf), ["source_id", "crash_key"])
    return df.select("source_id", "crash_key", "attributes.severity_code", "attributes.map_eligible")
