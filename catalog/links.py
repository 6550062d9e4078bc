"""Link checks and link review over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from crashmart.functions.hashing import record_id
from crashmart.plans import links as K

from . import tables as t
from .registry import query

RULES = K.LinkRules(1996, 2000)


def frames(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Orders as parents, lineitems as children naming their supplier, returned ('A') lineitems as targets.

    Some parent keys are blank, some dates and counts are damaged, and untaxed lines name no supplier.
    """
    orders, li = t.table(spark, sf, "orders"), t.table(spark, sf, "lineitem")
    key, day = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    parents = orders.select(
        F.lit("orders").alias("source_id"), F.lit("orders").alias("resource_id"), F.concat(F.lit("csv:"), key + 1).alias("row_locator"),
        record_id(F.lit("orders"), key).alias("raw_record_id"),
        F.when(F.col("o_totalprice") < 3000, F.lit("　")).otherwise(key.cast("string")).alias("parent_key"),
        F.when(F.col("o_orderstatus") == "P", F.concat(day, F.lit("x"))).otherwise(day).alias("date_text"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").when(F.col("o_orderpriority") == "2-HIGH", "-1").otherwise((key % 8).cast("string")).alias("count_text"))
    identity = [F.col(c) for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    spot = F.concat(F.lit("csv:"), F.concat_ws("", *[F.lpad(c.cast("string"), 20, "0") for c in identity]))
    base = li.select(
        F.lit("orders").alias("source_id"), spot.alias("row_locator"), record_id(F.lit("lines"), *identity).alias("raw_record_id"),
        F.when(F.col("l_quantity") > 49, F.lit("")).otherwise(F.col("l_orderkey").cast("string")).alias("parent_key"),
        F.col("l_linenumber").cast("string").alias("child_key"),
        F.when(F.col("l_tax") == 0, "").when(F.col("l_discount") == 0, " ").otherwise(F.col("l_suppkey").cast("string")).alias("target_key"),
        F.col("l_suppkey").cast("string").alias("supplier"), "l_returnflag", "l_linestatus")
    children = base.withColumn("resource_id", F.lit("children"))
    targets = base.filter("l_returnflag = 'A'").withColumn("resource_id", F.lit("targets")).withColumn("target_key", F.col("supplier"))
    return parents, children, targets


SQL_LINKS = """WITH p AS (SELECT o_orderkey, CASE WHEN o_totalprice < 3000 THEN NULL ELSE o_orderkey END AS pk,
  CASE WHEN o_orderstatus <> 'P' THEN year(o_orderdate) END AS yr, CASE WHEN o_orderpriority = '5-LOW' THEN 'missing' WHEN o_orderpriority = '2-HIGH' THEN 'invalid' ELSE 'number' END AS cs,
  o_orderkey % 8 AS declared FROM orders),
 c AS (SELECT *, CASE WHEN l_quantity > 49 THEN NULL ELSE l_orderkey END AS pk, CASE WHEN l_tax = 0 THEN 'blank' WHEN l_discount = 0 THEN 'space' ELSE 'key' END AS ts FROM lineitem),
 tg AS (SELECT pk, l_suppkey, count(*) AS n FROM c WHERE l_returnflag = 'A' AND pk IS NOT NULL GROUP BY ALL),
 cc AS (SELECT pk, count(*) AS n FROM c WHERE pk IS NOT NULL GROUP BY ALL),
 ck AS (SELECT pk, l_linenumber, count(*) AS n FROM c WHERE pk IS NOT NULL GROUP BY ALL),
 pc AS (SELECT p.o_orderkey, p.pk, p.yr, p.cs, p.declared, coalesce(cc.n, 0) AS observed,
   CASE WHEN p.pk IS NULL THEN 'invalid' WHEN cs = 'missing' THEN 'missing' WHEN cs = 'invalid' THEN 'invalid' ELSE 'compared' END AS state FROM p LEFT JOIN cc ON cc.pk = p.pk),
 ch AS (SELECT c.*, p.pk IS NOT NULL AS has_parent, p.yr, CASE WHEN p.pk IS NOT NULL THEN p.yr BETWEEN 1996 AND 2000 END AS in_scope, ck.n AS key_count,
   CASE WHEN ts = 'blank' THEN 'allowed_blank' WHEN ts = 'space' THEN 'invalid_whitespace' WHEN c.pk IS NULL THEN 'invalid_parent_key' WHEN tg.n IS NULL THEN 'unmatched'
        WHEN tg.n > 1 THEN 'ambiguous' ELSE 'matched' END AS ref
   FROM c LEFT JOIN p ON p.pk = c.pk LEFT JOIN ck ON ck.pk = c.pk AND ck.l_linenumber = c.l_linenumber LEFT JOIN tg ON tg.pk = c.pk AND tg.l_suppkey = c.l_suppkey AND ts = 'key'),
 tt AS (SELECT c.*, p.pk IS NOT NULL AS has_parent, CASE WHEN p.pk IS NOT NULL THEN p.yr BETWEEN 1996 AND 2000 END AS in_scope, tg.n AS target_count
   FROM c LEFT JOIN p ON p.pk = c.pk LEFT JOIN tg ON tg.pk = c.pk AND tg.l_suppkey = c.l_suppkey WHERE c.l_returnflag = 'A')
"""


def _checks(spark, sf) -> K.LinkChecks:
    return K.check_links(*frames(spark, sf), RULES)


@query("link_issue_counts", SQL_LINKS + """SELECT kind, issue, count(*) AS row_count FROM (
 SELECT 'parent' AS kind, unnest(list_filter([CASE WHEN pk IS NULL THEN 'invalid_parent_key' END, CASE WHEN yr IS NULL THEN 'invalid_parent_date' END,
   CASE WHEN cs = 'invalid' THEN 'invalid_child_count' END, CASE WHEN state = 'compared' AND observed <> declared THEN 'child_count_mismatch' END], lambda x: x IS NOT NULL)) AS issue FROM pc
 UNION ALL SELECT 'child', unnest(list_filter([CASE WHEN pk IS NULL THEN 'invalid_parent_key' END, CASE WHEN key_count > 1 THEN 'duplicate_child_key' END,
   CASE WHEN pk IS NOT NULL AND NOT has_parent THEN 'missing_parent' END, CASE WHEN ref = 'invalid_whitespace' THEN 'invalid_target_reference' END,
   CASE WHEN ref = 'unmatched' THEN 'unmatched_nonblank_target_ref' END, CASE WHEN ref = 'ambiguous' THEN 'ambiguous_target_reference' END], lambda x: x IS NOT NULL)) FROM ch
 UNION ALL SELECT 'target', unnest(list_filter([CASE WHEN pk IS NULL THEN 'invalid_parent_key' END, CASE WHEN target_count > 1 THEN 'duplicate_target_key' END,
   CASE WHEN pk IS NOT NULL AND NOT has_parent THEN 'missing_parent' END], lambda x: x IS NOT NULL)) FROM tt) GROUP BY ALL""")
def link_issue_counts(spark, sf):
    """Rows per kind and issue over parents, children and targets of the complete snapshot."""
    return K.issue_counts(_checks(spark, sf))


@query("link_summary", SQL_LINKS + """SELECT (SELECT count(*) FROM pc) + (SELECT count(*) FROM ch) + (SELECT count(*) FROM tt) AS evaluated_count,
 (SELECT count(*) FROM pc WHERE pk IS NULL OR yr IS NULL OR cs = 'invalid' OR (state = 'compared' AND observed <> declared))
 + (SELECT count(*) FROM ch WHERE pk IS NULL OR key_count > 1 OR NOT has_parent OR ref IN ('invalid_whitespace', 'unmatched', 'ambiguous'))
 + (SELECT count(*) FROM tt WHERE pk IS NULL OR target_count > 1 OR NOT has_parent) AS affected_count,
 (SELECT count(*) FROM pc WHERE state = 'compared') AS comparison_count, (SELECT CAST(sum(abs(observed - declared)) AS BIGINT) FROM pc WHERE state = 'compared') AS declared_count_delta,
 (SELECT count(*) FROM ch WHERE ref = 'unmatched') AS nonblank_unmatched_count, (SELECT count(*) FROM ch WHERE in_scope) AS in_scope_count,
 (SELECT count(*) FROM ch WHERE NOT in_scope) AS out_of_scope_count, (SELECT count(*) FROM ch WHERE in_scope IS NULL) AS unresolved_scope_count""")
def link_summary(spark, sf):
    return K.summary(_checks(spark, sf))


@query("link_child_rows", SQL_LINKS + """SELECT CAST(l_orderkey AS VARCHAR) AS order_text, CAST(l_linenumber AS VARCHAR) AS child_key, CAST(l_partkey AS VARCHAR) AS part_text, ref AS target_reference, in_scope,
 CASE WHEN has_parent THEN CAST(1 AS BIGINT) ELSE 0 END AS parent_match_count FROM ch""")
def link_child_rows(spark, sf):
    """Every child row with the state of its reference and whether its parent lies in the analysis years."""
    c = _checks(spark, sf).children
    part = lambda i: F.regexp_replace(F.substring("row_locator", 5 + 20 * i, 20), r"\A0+(?=[0-9])", "")
    return c.select(part(0).alias("order_text"), "child_key", part(2).alias("part_text"), "target_reference", "in_scope", "parent_match_count")


@query("link_parent_rows", SQL_LINKS + """SELECT o_orderkey, state AS count_state, CASE WHEN pk IS NOT NULL AND state = 'compared' THEN observed - declared END AS count_delta,
 CASE WHEN yr IS NOT NULL THEN yr BETWEEN 1996 AND 2000 END AS in_scope FROM pc""")
def link_parent_rows(spark, sf):
    p = _checks(spark, sf).parents
    return p.select((F.substring("row_locator", 5, 20).cast("bigint") - 1).alias("o_orderkey"), "count_state", "count_delta", "in_scope")


@query("link_evidence_rows", SQL_LINKS + """SELECT kind, count(*) AS row_count FROM (
 SELECT 'parent' AS kind FROM pc WHERE pk IS NULL OR yr IS NULL OR state <> 'compared' OR observed <> declared UNION ALL
 SELECT 'child' FROM ch WHERE pk IS NULL OR key_count > 1 OR NOT has_parent OR ref <> 'matched' UNION ALL
 SELECT 'target' FROM tt WHERE pk IS NULL OR target_count > 1 OR NOT has_parent) GROUP BY ALL""")
def link_evidence_rows(spark, sf):
    return K.retained(_checks(spark, sf)).groupBy("kind").agg(F.count(F.lit(1)).alias("row_count"))


@query("link_mismatch_references", SQL_LINKS + """SELECT CAST(c.pk AS VARCHAR) AS parent_key, 'child' AS kind, count(*) AS reference_count FROM c JOIN pc ON pc.pk = c.pk WHERE state = 'compared' AND observed <> declared GROUP BY ALL""")
def link_mismatch_references(spark, sf):
    """Children behind every mismatching parent, in long form and counted per parent here."""
    p, c, tt = frames(spark, sf)
    refs = K.mismatch_references(K.check_links(p, c, tt, RULES), c, RULES, "child")
    return refs.groupBy("parent_key", "kind").agg(F.count(F.lit(1)).alias("reference_count"))


@query("reference_states", SQL_LINKS + """, tg2 AS (SELECT DISTINCT coalesce(CAST(pk AS VARCHAR), '') AS k, l_suppkey AS s FROM c WHERE l_returnflag = 'A'),
 x AS (SELECT l_linestatus, CASE WHEN ts <> 'key' THEN 'blank' WHEN EXISTS (SELECT 1 FROM tg2 WHERE tg2.k = coalesce(CAST(ch.pk AS VARCHAR), '') AND tg2.s = ch.l_suppkey) THEN 'matched' ELSE 'unmatched' END AS reference,
   CASE WHEN NOT has_parent OR pk IS NULL THEN 'no_parent' WHEN yr BETWEEN 1996 AND 2000 THEN '1996-2000' ELSE 'outside_1996-2000' END AS scope FROM ch)
 SELECT l_linestatus, scope, reference, count(*) AS row_count FROM x GROUP BY ALL""")
def reference_states(spark, sf):
    """Blank, matched and unmatched references by role and scope."""
    p, c, tt = frames(spark, sf)
    scopes = K.scope_of(p, "parent_key", "date_text", 1996, 2000)
    return K.reference_states(c, tt, scopes, ["parent_key", "target_key"], ["l_linestatus"])


@query("level_differences", """WITH o AS (SELECT l_orderkey AS k, l_returnflag AS f, count(*) AS n FROM lineitem GROUP BY ALL),
 d AS (SELECT o_orderkey AS k, unnest(['A', 'N', 'R']) AS level, unnest([o_orderkey % 2, o_orderkey % 3, o_orderkey % 4]) AS declared_count FROM orders)
 SELECT d.k, d.level, d.declared_count, coalesce(o.n, 0) AS observed_count FROM d LEFT JOIN o ON o.k = d.k AND o.f = d.level WHERE d.declared_count <> coalesce(o.n, 0)""")
def level_differences(spark, sf):
    """Declared against observed children per level."""
    key = F.col("o_orderkey")
    parents = t.table(spark, sf, "orders").select(key.alias("k"), *[(key % i).cast("string").alias(f"d{i}") for i in (2, 3, 4)])
    li = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_returnflag")
    return K.level_differences(parents, "k", {"A": "d2", "N": "d3", "R": "d4"}, li, F.col("l_returnflag"))


@query("group_sizes", "SELECT n AS group_size, count(*) AS group_count FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey) GROUP BY ALL")
def group_sizes(spark, sf):
    return K.group_size_distribution(t.table(spark, sf, "lineitem"), ["l_orderkey"])


@query("exact_duplicates", "SELECT count(*) - count(DISTINCT (text, lang)) AS extra_row_count FROM documents")
def exact_duplicates(spark, sf):
    """Copies beyond the first of identical rows, whole texts compared by content hash."""
    docs = t.table(spark, sf, "documents").select(F.sha2("text", 256).alias("content"), "lang")
    return K.exact_duplicate_extras(docs, ["content", "lang"])


@query("varying_fields", """SELECT fields, count(*) AS group_count FROM (SELECT concat_ws(',', CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'l_returnflag' END, CASE WHEN count(DISTINCT l_linestatus) > 1 THEN 'l_linestatus' END,
 CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'l_suppkey' END) AS fields FROM lineitem GROUP BY l_orderkey, l_linenumber) WHERE fields <> '' GROUP BY ALL""")
def varying_fields(spark, sf):
    """Which fields differ within groups that share a key."""
    return K.varying_fields(t.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_returnflag", "l_linestatus", "l_suppkey"])


@query("shared_ids", "SELECT count(*) AS distinct_item_count, count(*) FILTER (WHERE n > 1) AS shared_item_count FROM (SELECT count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey)")
def shared_ids(spark, sf):
    return K.shared_ids(t.table(spark, sf, "lineitem"), "l_suppkey", "l_orderkey")


@query("missing_matches", """SELECT o.o_orderkey AS k, o.o_orderkey % 100 AS item, (SELECT count(DISTINCT l_orderkey) FROM lineitem WHERE l_suppkey = o.o_orderkey % 100) AS same_item_other_parents
 FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o.o_orderkey AND l_suppkey = o.o_orderkey % 100)""")
def missing_matches(spark, sf):
    """Parents whose own (key, item) was never observed, with how many other parents saw the item."""
    parents = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 100).alias("item"))
    seen = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("item"))
    return K.missing_matches(parents, seen, "k", "item")


@query("other_items", """SELECT l_orderkey AS k, l_suppkey AS item, count(*) AS row_count, l_orderkey % 100 AS expected_item FROM lineitem WHERE l_suppkey <> l_orderkey % 100 GROUP BY ALL""")
def other_items(spark, sf):
    parents = t.table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 100).alias("item"))
    seen = t.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_suppkey").alias("item"))
    return K.other_item(parents, seen, "k", "item")


@query("turn_references", """SELECT role, CASE WHEN turn = 0 THEN 'blank' WHEN (conv_id, turn - 1) IN (SELECT (conv_id, turn) FROM conversations) THEN 'matched' ELSE 'unmatched' END AS reference, count(*) AS row_count,
 'no_parent' AS scope FROM conversations GROUP BY ALL""")
def turn_references(spark, sf):
    """Turns referring to the turn before them; the first refers to none."""
    c = t.table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("k"), "turn", "role")
    children = c.withColumn("ref", F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).otherwise(""))
    targets = c.withColumn("ref", F.col("turn").cast("string"))
    nobody = contract_scopes(spark)
    return K.reference_states(children, targets, nobody, ["k", "ref"], ["role"])


def contract_scopes(spark) -> DataFrame:
    return spark.createDataFrame([], "k string, scope string")
