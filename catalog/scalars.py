"""Column functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from crashmart import functions as fn
from crashmart.operators.observations import resolve
from crashmart.sources.native_text import native_text

from . import tables as t
from .registry import query

SPACE_SQL = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || ' ' || chr(133) || chr(160) || chr(5760) || " + \
    " || ".join(f"chr({c})" for c in [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])


@query("business_keys", """SELECT page_id, '["' || page_id || '","' || url || '"]' AS key_text, '["' || page_id || '", "' || url || '"]' AS spaced_text FROM pages""")
def business_keys(spark, sf):
    """Ordered components as JSON array text, in the compact and the spaced form."""
    df = t.table(spark, sf, "pages")
    return df.select("page_id", fn.encode_key("page_id", "url").alias("key_text"), fn.spaced_key("page_id", "url").alias("spaced_text"))


@query("blank_tokens", f"""WITH p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS piece FROM documents),
 v AS (SELECT doc_id, trim(piece, {SPACE_SQL}) = '' AS blank, piece FROM p)
 SELECT doc_id, count(*) AS piece_count, count(*) FILTER (WHERE blank) AS blank_count,
 count(nullif(piece, '')) AS nonempty_count, count(*) FILTER (WHERE NOT blank) AS key_count FROM v GROUP BY doc_id""")
def blank_tokens(spark, sf):
    """Blank predicate, missing-token rule and key guard over every line of every document."""
    df = t.table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("piece"))
    return df.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("piece_count"), F.count_if(fn.is_blank("piece")).alias("blank_count"),
        F.count(fn.missing_token("piece")).alias("nonempty_count"), F.count(fn.try_encode_key("piece")).alias("key_count"))


@query("guarded_counts", """WITH e AS (SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events),
 x AS (SELECT event_id, CASE event_type WHEN 'view' THEN ' ' || k WHEN 'error' THEN '-' || k WHEN 'signup' THEN k || '00000000000' ELSE k END AS token FROM e)
 SELECT event_id, token, CASE WHEN regexp_full_match(token, '[0-9]+') THEN TRY_CAST(token AS INTEGER) END AS number,
 CASE WHEN regexp_full_match(token, '[0-9]+') THEN CAST(TRY_CAST(token AS INTEGER) AS BIGINT) + event_id END AS total FROM x""")
def guarded_counts(spark, sf):
    """Count tokens: blanks, signs and numbers beyond int32 are refused; sums with an unknown part stay unknown."""
    k = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    token = (F.when(kind == "view", F.concat(F.lit(" "), k)).when(kind == "error", F.concat(F.lit("-"), k))
             .when(kind == "signup", F.concat(k, F.lit("00000000000"))).otherwise(k))
    df = t.table(spark, sf, "events").select("event_id", token.alias("token"))
    return df.select("event_id", "token", fn.count_token("token").alias("number"),
                     fn.known_sum(fn.count_token("token"), F.col("event_id")).alias("total"))


@query("coordinate_tokens", """WITH x AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'n/a' WHEN 'signup' THEN '' ELSE CAST(event_id % 400 - 200 AS VARCHAR) || '.12345678' END AS la,
 CAST(event_id % 720 - 360 AS VARCHAR) || '.00000005' AS lo FROM events), d AS (SELECT *, TRY_CAST(la AS DECIMAL(38,20)) AS a, TRY_CAST(lo AS DECIMAL(38,20)) AS o FROM x)
 SELECT event_id, coalesce(a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180, false) AS usable,
 CASE WHEN a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 THEN CAST(CAST(a AS DECIMAL(10,7)) AS VARCHAR) END AS latitude,
 CASE WHEN a BETWEEN -90 AND 90 AND o BETWEEN -180 AND 180 THEN CAST(CAST(o AS DECIMAL(10,7)) AS VARCHAR) END AS longitude FROM d""")
def coordinate_tokens(spark, sf):
    """Exact pairs, range rule and half-up rounding to seven places."""
    kind = F.col("event_type")
    lat = F.when(kind == "error", "n/a").when(kind == "signup", "").otherwise(F.concat((F.col("event_id") % 400 - 200).cast("string"), F.lit(".12345678")))
    lon = F.concat((F.col("event_id") % 720 - 360).cast("string"), F.lit(".00000005"))
    df = t.table(spark, sf, "events").select("event_id", fn.exact_pair(lat, lon).alias("p"))
    return df.select("event_id", F.col("p").isNotNull().alias("usable"), fn.to_scale7(F.col("p.lat")).cast("string").alias("latitude"),
                     fn.to_scale7(F.col("p.lon")).cast("string").alias("longitude"))


# Digits beyond any decimal type: the SQL compares the text behind 34 places, which is the same for all rows but for its last digit.
@query("long_tokens", """WITH x AS (SELECT event_id % 50 AS place, event_id % 3 AS d, event_id % 7 = 0 AS far FROM events)
 SELECT place, count(*) AS observation_count, count(*) FILTER (WHERE far) > 0 AS out_of_range,
 CASE WHEN count(*) FILTER (WHERE far) > 0 THEN 0 ELSE count(DISTINCT d) END AS coordinate_pair_count FROM x GROUP BY place""")
def long_tokens(spark, sf):
    """Coordinates that differ in place 40, written in two ways, and latitudes that pass 90 in place 40: exact conflicts and range."""
    zeros = "0" * 39
    near = F.concat(F.when(F.col("event_id") % 2 == 0, f"12.{zeros}").otherwise(f"+0.12{zeros}"), (F.col("event_id") % 3 + 1).cast("string"),
                    F.when(F.col("event_id") % 2 == 0, "00").otherwise("e2"))
    lat = F.when(F.col("event_id") % 7 == 0, f"-90.{zeros}1").otherwise(near)
    rows = t.table(spark, sf, "events").select(
        (F.col("event_id") % 50).alias("place"), lat.alias("lat_text"), F.lit("1").alias("lon_text"), F.col("event_id").cast("string").alias("raw_record_id"),
        F.lit("f").alias("file_sha256"), F.lit("p").alias("parser_version"), F.concat(F.lit("csv:"), F.col("event_id") + 1).alias("row_locator"))
    found = resolve(rows, ["place"], "lat_text", "lon_text", True)
    return found.select("place", "observation_count", (F.col("resolution") == "latitude_out_of_range").alias("out_of_range"), "coordinate_pair_count")


@query("calendar_tokens", """WITH x AS (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) || '-' || CASE WHEN o_orderstatus = 'P' THEN CAST(month(o_orderdate) AS VARCHAR) ELSE lpad(CAST(month(o_orderdate) AS VARCHAR), 2, '0') END
  || '-' || lpad(CAST(o_orderkey % 32 AS VARCHAR), 2, '0') AS token, '  ' || monthname(o_orderdate) || ' ' AS name, o_orderdate FROM orders),
 d AS (SELECT *, CASE WHEN regexp_full_match(token, '[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN TRY_CAST(token AS DATE) END AS dd FROM x)
 SELECT o_orderkey, token, strftime(dd, '%Y-%m-%d') AS day_text, CAST(month(o_orderdate) AS INTEGER) AS month_no,
 CAST(year(dd) * 100 + month(dd) AS INTEGER) AS month_id, CASE WHEN dd IS NULL THEN 'year' ELSE 'day' END AS precision_name,
 CAST(month(dd) AS INTEGER) AS back_month, CAST(year(dd) AS INTEGER) AS back_year FROM d""")
def calendar_tokens(spark, sf):
    """Strict dates (30 February and unpadded months are refused), month names, precision and month ids."""
    month = F.month("o_orderdate")
    shown = F.when(F.col("o_orderstatus") == "P", month.cast("string")).otherwise(F.lpad(month.cast("string"), 2, "0"))
    token = F.concat_ws("-", F.year("o_orderdate").cast("string"), shown, F.lpad((F.col("o_orderkey") % 32).cast("string"), 2, "0"))
    df = t.table(spark, sf, "orders").select("o_orderkey", token.alias("token"), F.concat(F.lit("  "), F.date_format("o_orderdate", "MMMM"), F.lit(" ")).alias("name"))
    day = fn.iso_date("token")
    ident = fn.month_id(F.year(day), F.month(day))
    return df.select("o_orderkey", "token", F.date_format(day, "yyyy-MM-dd").alias("day_text"), fn.month_number("name").alias("month_no"),
                     ident.alias("month_id"), fn.date_precision(F.month(day), day).alias("precision_name"),
                     fn.month_of_id(ident).alias("back_month"), fn.year_of_id(ident).alias("back_year"))


@query("row_locators", """WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'csv:' || event_id WHEN 'error' THEN '["Sheet 1", ' || event_id || ']'
  WHEN 'signup' THEN 'csv:0' || event_id ELSE 'row ' || event_id END AS loc FROM events)
 SELECT event_id, loc, CASE WHEN regexp_full_match(loc, 'csv:[1-9][0-9]*') THEN CAST(substr(loc, 5) AS BIGINT)
  WHEN regexp_full_match(loc, '\\["[^"]+", [1-9][0-9]*\\]') THEN event_id END AS position,
 CAST(CASE WHEN loc LIKE '%]' THEN NULL ELSE regexp_extract(loc, '([0-9]+)$', 1) END AS BIGINT) AS sort_key FROM x""")
def row_locators(spark, sf):
    """Native positions of the two locator forms; other forms give NULL. The sort key reads trailing digits."""
    e, i = F.col("event_type"), F.col("event_id").cast("string")
    loc = (F.when(e == "view", F.concat(F.lit("csv:"), i)).when(e == "error", F.concat(F.lit('["Sheet 1", '), i, F.lit("]")))
           .when(e == "signup", F.concat(F.lit("csv:0"), i)).otherwise(F.concat(F.lit("row "), i)))
    df = t.table(spark, sf, "events").select("event_id", loc.alias("loc"))
    return df.select("event_id", "loc", fn.locator_position("loc").cast("bigint").alias("position"), fn.locator_order("loc").cast("bigint").alias("sort_key"))


@query("content_fingerprints", """SELECT c_custkey, sha256('{"account":"' || c_custkey || '","segment":"' || c_mktsegment || '"}') AS fp FROM customer""")
def content_fingerprints(spark, sf):
    """SHA-256 of normalised JSON, independent of field order."""
    df = t.table(spark, sf, "customer")
    return df.select("c_custkey", fn.fingerprint({"segment": F.col("c_mktsegment"), "account": F.col("c_custkey").cast("string")}).alias("fp"))


@query("content_inventory", """SELECT lang, count(*) AS document_count, count(DISTINCT sha256(text)) AS distinct_hash_count,
 CAST(sum(strlen(text)) AS BIGINT) AS byte_size, min(sha256(text)) AS first_hash FROM documents GROUP BY lang""")
def content_inventory(spark, sf):
    """Content hashes and byte sizes of whole texts."""
    df = t.table(spark, sf, "documents").select("lang", F.sha2("text", 256).alias("h"), F.octet_length("text").cast("bigint").alias("b"))
    per = df.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("b"))
    return per.groupBy("lang").agg(F.sum("n").alias("document_count"), F.count(F.lit(1)).alias("distinct_hash_count"),
                                   F.sum("b").alias("byte_size"), F.min("h").alias("first_hash"))


@query("native_text", """SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, CAST(o_totalprice AS VARCHAR) AS o_totalprice,
 strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS o_orderdate, o_orderpriority FROM orders""")
def native_text_orders(spark, sf):
    """Typed cells in native text form."""
    return native_text(t.table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderdate", "o_orderpriority"))


@query("native_moments", """SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE strftime(ts, '.%f') END AS ts,
 CAST(value AS VARCHAR) AS value FROM events""")
def native_moments(spark, sf):
    """Moments with none or exactly six fractional digits, and plain decimals."""
    e = t.table(spark, sf, "events")
    return native_text(e.select(F.col("event_id").cast("string").alias("id"), "ts", "value")).select(F.col("id").cast("bigint").alias("event_id"), "ts", "value")


@query("array_helpers", """SELECT user_id, string_agg(DISTINCT event_type, ' | ' ORDER BY event_type) AS kinds, count(DISTINCT event_type) AS kind_count,
 list_position(list_sort(list(DISTINCT event_type)), 'error') AS error_position FROM events GROUP BY user_id""")
def array_helpers(spark, sf):
    """Ordered distinct join and position lookup (kinds are a declared category set)."""
    g = t.table(spark, sf, "events").groupBy("user_id").agg(
        fn.ordered_distinct_text(F.col("event_type")).alias("kinds"), F.countDistinct("event_type").alias("kind_count"))
    return g.withColumn("error_position", fn.position_of(F.split("kinds", r" \| "), "error").cast("int"))


@query("sum_rules", """SELECT event_type, count(*) FILTER (WHERE value > 400) AS big_count, CAST(sum(user_id) FILTER (WHERE value > 490) AS BIGINT) AS big_sum,
 count(*) - count(DISTINCT user_id) AS extra_rows, CAST(sum(abs(user_id - event_id)) AS BIGINT) AS delta_sum,
 CAST((count(*) FILTER (WHERE value > 400) * 20000 + count(*)) // (2 * count(*)) AS DOUBLE) / 100 AS share FROM events GROUP BY event_type""")
def sum_rules(spark, sf):
    """Filtered counts and sums (NULL when nothing qualifies), rows minus distinct, absolute deltas, percentages."""
    big, all_rows = F.col("value") > 400, F.count(F.lit(1))
    return t.table(spark, sf, "events").groupBy("event_type").agg(
        fn.count_where(big).alias("big_count"), fn.sum_where(F.col("user_id"), F.col("value") > 490).alias("big_sum"),
        fn.distinct_extra(F.col("user_id")).alias("extra_rows"), fn.absolute_delta_sum(F.col("user_id"), F.col("event_id")).alias("delta_sum"),
        fn.percentage(fn.count_where(big), all_rows).cast("double").alias("share"))
