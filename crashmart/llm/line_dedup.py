"""Boilerplate lines by site-relative frequency.

A host's pages are its distinct texts, so copies of one page don't make its lines look like boilerplate. A line's ratio is the number of
pages of the host that contain it over all pages of the host; lines above `ratio` that `least` pages contain are boilerplate there.
Joins with the corpus are hinted to merge, so that plans and costs are of one kind at every size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .frames import materialize, text_key

RATIO = 0.08
LEAST = 4


def _pages(docs: DataFrame, host: str, text: str) -> DataFrame:
    """One row for each page: host, key (of host and text), lines (keys of its distinct non-blank lines)."""
    key = text_key(F.col("host"), F.col("text"))
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x) != "")
    own = docs.select(F.col(host).cast("string").alias("host"), F.col(text).cast("string").alias("text"))
    keyed = own.select("host", key.alias("page"), F.array_distinct(F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b")))).alias("lines"))
    return keyed


def boilerplate(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """(host, line, pages, host_pages): lines of a host beyond the ratio, line being a 128-bit key. A null host is a host of its own."""
    pages = _pages(docs, host, text)
    totals = pages.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("host_pages"))
    each = pages.select("host", "page", F.explode("lines").alias("line"))
    counts = each.groupBy("host", "line", "page").agg(F.lit(1).alias("one")).groupBy("host", "line").agg(F.count(F.lit(1)).alias("pages")).where(F.col("pages") >= least)
    found = counts.alias("c").join(totals.alias("t"), F.col("c.host").eqNullSafe(F.col("t.host")))
    return found.where(F.col("pages") > F.lit(ratio) * F.col("host_pages")).select("c.host", "line", "pages", "host_pages")


def drop_lines(docs: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """docs with its boilerplate lines cut from `text`; every row and column stays, rows without such a line keep their text as it is.

    Blank lines are never boilerplate. Null texts stay null; a text of boilerplate alone becomes empty. Repeated rows are cut alike.
    """
    known = materialize(boilerplate(docs, host, text, ratio, least).select("host", "line"), "boilerplate")
    lines = _pages(docs, host, text).select("host", "page", F.explode("lines").alias("line")).distinct()
    hit = lines.alias("l").join(known.hint("merge").alias("k"), F.col("l.host").eqNullSafe(F.col("k.host")) & (F.col("l.line") == F.col("k.line")))
    cuts = materialize(hit.groupBy("page").agg(F.collect_set("l.line").alias("cut")).select(F.col("page.a").alias("a"), F.col("page.b").alias("b"), "cut"), "cuts")
    key = text_key(F.col(host).cast("string"), F.col(text).cast("string"))
    keyed = docs.select(F.struct(*docs.columns).alias("whole"), key["a"].alias("a"), key["b"].alias("b")).join(cuts.hint("merge"), ["a", "b"], "left")
    own = F.col("whole").getField(text)
    kept = F.filter(F.split(own, "\n", -1), lambda x: ~F.array_contains("cut", F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"))))
    cut = F.when(F.col("cut").isNull(), own).otherwise(F.concat_ws("\n", kept))
    return keyed.select(*[cut.alias(c) if c == text else F.col("whole").getField(c).alias(c) for c in docs.columns])
