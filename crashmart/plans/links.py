"""Links between parents, secondary children and the rows they refer to.

Three frames take part: parents (one date and one declared child count each), children that name their parent and may name a
target below the same parent, and the targets. All three carry raw_record_id, resource_id, row_locator and source_id.
Group facts are aggregated first and reach the rows through `attach`; reference lists stay in long form.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..contracts import Source
from ..functions.dates import iso_date
from ..functions.locators import locator_order
from ..functions.numbers import count_token
from ..functions.text import is_blank
from ..operators.relations import attach, key_sizes
from ..session import materialize
from .project import c, native

ROW = ["source_id", "resource_id", "row_locator", "raw_record_id"]


@dataclass(frozen=True)
class LinkRules:
    """Column names of the three frames and what an empty target reference means."""

    year_from: int
    year_to: int
    parent: str = "parent_key"
    child: str = "child_key"
    target: str = "target_key"
    date: str = "date_text"
    declared: str = "count_text"
    # allowed | forbidden | unresolved
    blank_reference: str = "allowed"
    count_scope_confirmed: bool = True
    # Extra condition under which an empty reference is an accepted case (overrides blank_reference where set).
    diagnostic: bool = False
    accepted_blank: Column | None = None


def _valid(column: str) -> Column:
    return ~is_blank(column)


# Column that says how often a row's own key occurs in its frame.
MULTIPLICITY = {"parent": "parent_match_count", "child": "key_count", "target": "target_match_count"}
# Issue of a reference in each state that is one.
REFERENCE_ISSUES = {
    "invalid_whitespace": "invalid_target_reference", "unmatched": "unmatched_nonblank_target_ref", "ambiguous": "ambiguous_target_reference",
    "unresolved_blank": "blank_target_reference_unconfirmed", "forbidden_blank": "blank_target_reference_forbidden"}


def _issues(frame: str, r: LinkRules) -> Column:
    """Issue codes of a row of one frame. Keys are judged alike everywhere; parents add their count, the others their parent, children their reference."""
    key, above = F.col("__p"), F.col("parent_match_count")
    found = {"invalid_parent_key": key.isNull()}
    if frame != "parent":
        found[f"invalid_{frame}_key"] = is_blank(getattr(r, frame))
    found[f"duplicate_{frame}_key"] = F.col(MULTIPLICITY[frame]) > 1
    if frame == "parent":
        stated = F.nullif(F.col(r.declared), F.lit("")).isNotNull()
        found |= {"invalid_parent_date": F.col("occurrence_date").isNull(), "invalid_child_count": stated & F.col("declared_count").isNull(),
                  "child_count_scope_unconfirmed": F.lit(not (r.count_scope_confirmed or r.diagnostic)), "child_count_mismatch": F.col("count_delta") != 0}
    else:
        found |= {"missing_parent": key.isNotNull() & (above == 0), "ambiguous_parent": above > 1}
    if frame == "child":
        found |= {code: F.col("target_reference") == state for state, code in REFERENCE_ISSUES.items()}
    return F.array_compact(F.array(*[F.when(holds, F.lit(code)) for code, holds in found.items()]))


def _key(column: str) -> Column:
    """Join key that is NULL when blank, so blank keys never gather at one place."""
    return F.when(_valid(column), F.col(column))


@dataclass(frozen=True)
class LinkChecks:
    parents: DataFrame
    children: DataFrame
    targets: DataFrame


def check_links(parents: DataFrame, children: DataFrame, targets: DataFrame, r: LinkRules) -> LinkChecks:
    """Row-level checks of all three frames over the complete snapshot. Years only label rows (in_scope)."""
    p = parents.withColumn("__p", _key(r.parent)).withColumn("occurrence_date", iso_date(r.date)).withColumn(
        "declared_count", count_token(r.declared).cast("bigint"))
    kids = children.withColumn("__p", _key(r.parent)).withColumn("__t", F.when(_valid(r.parent), _key(r.target))).withColumn(
        "__c", F.when(_valid(r.parent), _key(r.child)))
    t = targets.withColumn("__p", _key(r.parent)).withColumn("__t", F.when(_valid(r.parent), _key(r.target)))
    scope = F.year("occurrence_date").between(r.year_from, r.year_to)

    parent_groups = p.filter(F.col("__p").isNotNull()).groupBy("source_id", "__p").agg(
        F.count(F.lit(1)).alias("parent_match_count"), F.min("occurrence_date").alias("occurrence_date"),
        F.min("row_locator").alias("parent_locator"))
    child_counts = key_sizes(kids.filter(F.col("__p").isNotNull()), ["source_id", "__p"], "observed_count")
    child_keys = key_sizes(kids.filter(F.col("__c").isNotNull()), ["source_id", "__p", "__c"], "key_count")
    target_keys = key_sizes(t.filter(F.col("__t").isNotNull()), ["source_id", "__p", "__t"], "target_match_count")
    # Both sides of a reference in one pass: targets per key, and how many children name it.
    named = (t.select("source_id", "__p", "__t", F.lit(1).alias("target"), F.lit(0).alias("naming"))
             .unionByName(kids.select("source_id", "__p", "__t", F.lit(0).alias("target"), F.lit(1).alias("naming")))
             .filter(F.col("__t").isNotNull()).groupBy("source_id", "__p", "__t")
             .agg(F.sum("target").alias("target_match_count"), F.sum("naming").alias("naming_count")))
    target_parents = key_sizes(t.filter(F.col("__p").isNotNull()), ["source_id", "__p"], "target_count")
    zero = F.lit(0).cast("bigint")

    # Parents: own multiplicity and number of children.
    info = (parent_groups.select("source_id", "__p", "parent_match_count").join(child_counts, ["source_id", "__p"], "left")
            .withColumn("observed_count", F.coalesce("observed_count", zero)))
    pc = attach(p, info, ["source_id", "__p"], ["parent_match_count", "observed_count"])
    ok = F.col("__p").isNotNull() & (F.col("parent_match_count") == 1) & F.col("declared_count").isNotNull()
    delta = F.col("observed_count") - F.col("declared_count")
    absent = F.col(r.declared).isNull() | (F.col(r.declared) == "")
    state = (F.when(F.col("__p").isNull() | (F.col("parent_match_count") != 1), "invalid").when(absent, "missing")
             .when(F.col("declared_count").isNull(), "invalid").when(F.lit(r.diagnostic), "diagnostic")
             .when(F.lit(not r.count_scope_confirmed), "unconfirmed").otherwise("compared"))
    pc = (pc.withColumn("count_state", state).withColumn("count_delta", F.when(ok & F.lit(r.count_scope_confirmed), delta))
          .withColumn("diagnostic_count_delta", F.when(ok, delta)).withColumn("in_scope", scope))
    pc = pc.withColumn("issues", _issues("parent", r))

    # Children: parent facts, own key multiplicity, matches of the reference.
    sized = parent_groups.join(child_counts, ["source_id", "__p"], "left").withColumn("observed_count", F.coalesce("observed_count", zero))
    cc = attach(kids, sized, ["source_id", "__p"], ["parent_match_count", "occurrence_date", "parent_locator"])
    cc = attach(cc, child_keys, ["source_id", "__p", "__c"], ["key_count"])
    cc = attach(cc, named, ["source_id", "__p", "__t"], ["target_match_count"])
    cc = cc.withColumn("parent_match_count", F.coalesce("parent_match_count", zero)).withColumn(
        "target_match_count", F.coalesce("target_match_count", zero))
    empty = F.col(r.target).isNull() | (F.col(r.target) == "")
    meaning = {"allowed": "allowed_blank", "forbidden": "forbidden_blank", "unresolved": "unresolved_blank"}[r.blank_reference]
    blank_state = F.lit(meaning) if r.accepted_blank is None else F.when(
        F.coalesce(r.accepted_blank, F.lit(False)), "allowed_registered_blank").otherwise("unresolved_blank")
    reference = (F.when(empty, blank_state).when(is_blank(r.target), "invalid_whitespace")
                 .when(F.col("__p").isNull(), "invalid_parent_key").when(F.col("target_match_count") == 0, "unmatched")
                 .when(F.col("target_match_count") > 1, "ambiguous").otherwise("matched"))
    cc = cc.withColumn("target_reference", reference).withColumn("in_scope", F.when(F.col("parent_match_count") == 1, scope))
    cc = cc.withColumn("issues", _issues("child", r))

    # Targets: own multiplicity and their parent.
    tt = attach(t, target_keys, ["source_id", "__p", "__t"], ["target_match_count"])
    above = target_parents.join(parent_groups, ["source_id", "__p"], "left")
    tt = attach(tt, above, ["source_id", "__p"], ["parent_match_count", "occurrence_date"])
    tt = tt.withColumn("parent_match_count", F.coalesce("parent_match_count", zero)).withColumn(
        "in_scope", F.when(F.col("parent_match_count") == 1, scope))
    tt = tt.withColumn("issues", _issues("target", r))
    drop = ["__p", "__t", "__c"]
    return LinkChecks(pc.drop(*drop), cc.drop(*drop), tt.drop(*drop))


def source_frames(raw: DataFrame, source: Source) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Parents, persons and units of a source whose persons refer to units, in the form check_links reads."""
    person, unit, crash, rule = source.file("person_raw"), source.file("unit"), source.file("crash"), source.persons

    def rows(spec, fields: dict[str, str]) -> DataFrame:
        df = native(raw, spec, list(fields.values()))
        return df.select("source_id", F.lit(spec.resource_id).alias("resource_id"), "row_locator", "raw_record_id",
                         *[c(f).alias(name) for name, f in fields.items()])

    parents = rows(crash, {"parent_key": crash.key_fields[0], "date_text": source.dates.year_field, "count_text": rule.declared_field})
    children = rows(person, {"parent_key": person.key_fields[0], "child_key": person.key_fields[-1], "target_key": rule.reference_field})
    targets = rows(unit, {"parent_key": unit.key_fields[0], "target_key": unit.key_fields[-1]})
    return parents, children, targets


def source_checks(raw: DataFrame, source: Source, year_from: int, year_to: int) -> LinkChecks:
    rule = source.persons
    return check_links(*source_frames(raw, source), LinkRules(
        year_from, year_to, blank_reference=rule.blank_reference, count_scope_confirmed=rule.count_scope_confirmed))


def link_counts(checks: LinkChecks, resource_id: str) -> DataFrame:
    """The person file's contribution to its quality object."""
    return summary(checks).select(F.lit(resource_id).alias("resource_id"), "nonblank_unmatched_count", "declared_count_delta",
                                  F.col("affected_count").alias("link_issue_count"))


def stacked(checks: LinkChecks) -> DataFrame:
    """All three kinds under one schema; columns a kind does not have are NULL."""
    common = [*ROW, "in_scope", "issues"]
    parent = checks.parents.select(F.lit("parent").alias("kind"), *common, "count_state", "declared_count", "observed_count",
                                   "count_delta", "diagnostic_count_delta")
    child = checks.children.select(F.lit("child").alias("kind"), *common, "parent_match_count", "target_match_count",
                                   "target_reference", "occurrence_date", "parent_locator")
    target = checks.targets.select(F.lit("target").alias("kind"), *common, "parent_match_count")
    return (parent.unionByName(child, allowMissingColumns=True).unionByName(target, allowMissingColumns=True))


def issue_counts(checks: LinkChecks) -> DataFrame:
    return (stacked(checks).select("kind", F.explode("issues").alias("issue")).groupBy("kind", "issue")
            .agg(F.count(F.lit(1)).alias("row_count")))


def summary(checks: LinkChecks) -> DataFrame:
    """One row: evaluated, affected, compared, absolute delta, unmatched references and scope counts."""
    rows = stacked(checks)
    child = F.col("kind") == "child"
    compared = (F.col("kind") == "parent") & (F.col("count_state") == "compared")
    return rows.agg(
        F.count(F.lit(1)).alias("evaluated_count"), F.count_if(F.size("issues") > 0).alias("affected_count"),
        F.count_if(F.coalesce(compared, F.lit(False))).alias("comparison_count"),
        F.coalesce(F.sum(F.when(compared, F.abs("count_delta"))), F.lit(0).cast("bigint")).alias("declared_count_delta"),
        F.count_if(F.coalesce(F.col("target_reference") == "unmatched", F.lit(False))).alias("nonblank_unmatched_count"),
        F.count_if(child & F.coalesce(F.col("in_scope"), F.lit(False))).alias("in_scope_count"),
        F.count_if(child & F.coalesce(~F.col("in_scope"), F.lit(False))).alias("out_of_scope_count"),
        F.count_if(child & F.col("in_scope").isNull()).alias("unresolved_scope_count"))


def retained(checks: LinkChecks) -> DataFrame:
    """Rows worth keeping as evidence: any issue, any reference that is not matched, any count that was not compared."""
    rows = stacked(checks)
    return rows.filter((F.size("issues") > 0)
                       | ((F.col("kind") == "child") & (F.col("target_reference") != "matched"))
                       | ((F.col("kind") == "parent") & (F.col("count_state") != "compared")))


def mismatch_references(checks: LinkChecks, detail: DataFrame, r: LinkRules, kind: str) -> DataFrame:
    """Detail rows (children or targets) behind each mismatching parent, one per row with their order keys.

    Long form of an ordered reference list: sorting it by parent and order key yields the list without gathering it.
    """
    off = checks.parents.filter(F.coalesce(F.col("diagnostic_count_delta") != 0, F.lit(False))).select("source_id", r.parent)
    return detail.join(materialize(off.distinct(), "parents"), ["source_id", r.parent], "left_semi").select(
        "source_id", r.parent, F.lit(kind).alias("kind"), "resource_id", locator_order("row_locator").alias("position"),
        "row_locator", "raw_record_id")


# ------------------------------------------------------------------------------------------------------------ link review

def scope_of(parents: DataFrame, key: str, date: str, year_from: int, year_to: int) -> DataFrame:
    """(key, scope) per distinct parent."""
    year = F.year(iso_date(date))
    label = F.when(year.between(year_from, year_to), f"{year_from}-{year_to}").otherwise(f"outside_{year_from}-{year_to}")
    return parents.groupBy(key).agg(F.min(label).alias("scope"))


def reference_states(children: DataFrame, targets: DataFrame, scopes: DataFrame, on: list[str], role: list[str]) -> DataFrame:
    """Rows by role, scope and state of the reference (blank, matched, unmatched).

    ``on`` is [parent, target]. Children are counted per (parent, target, role) before any join.
    """
    parent, target = on
    counted = children.groupBy(parent, target, *role).agg(F.count(F.lit(1)).alias("n"))
    known = targets.select(*on).distinct().withColumn("known", F.lit(True))
    state = F.when(is_blank(target), "blank").when(F.col("known"), "matched").otherwise("unmatched")
    return (counted.join(known, on, "left").join(materialize(scopes, "scopes"), parent, "left")
            .withColumn("scope", F.coalesce("scope", F.lit("no_parent"))).withColumn("reference", state)
            .groupBy(*role, "scope", "reference").agg(F.sum("n").alias("row_count")))


def level_differences(parents: DataFrame, key: str, declared: dict[str, str], children: DataFrame, level: Column) -> DataFrame:
    """Declared against observed children per level, one row per parent and differing level. declared: level -> field."""
    observed = children.groupBy(key, level.alias("level")).agg(F.count(F.lit(1)).alias("observed_count"))
    wide = F.array(*[F.struct(F.lit(k).alias("level"), count_token(f).cast("bigint").alias("declared_count"))
                     for k, f in declared.items()])
    long = parents.select(key, F.inline(wide)).filter(F.col("declared_count").isNotNull())
    return (long.join(observed, [key, "level"], "left")
            .withColumn("observed_count", F.coalesce("observed_count", F.lit(0).cast("bigint")))
            .filter(F.col("declared_count") != F.col("observed_count")))


def group_size_distribution(df: DataFrame, keys: list[str]) -> DataFrame:
    return key_sizes(df, keys, "group_size").groupBy("group_size").agg(F.count(F.lit(1)).alias("group_count"))


def exact_duplicate_extras(df: DataFrame, columns: list[str]) -> DataFrame:
    """Number of rows beyond the first copy of each identical row."""
    return key_sizes(df, columns).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0).cast("bigint")).alias("extra_row_count"))


def varying_fields(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Which fields differ inside a group, as (varying fields, number of groups). min and max combine map-side."""
    present = lambda f: F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("\u0000"))
    groups = df.groupBy(*keys).agg(*[x for f in fields for x in (F.min(present(f)).alias(f"lo_{f}"), F.max(present(f)).alias(f"hi_{f}"))])
    varying = F.array_compact(F.array(*[F.when(F.col(f"lo_{f}") != F.col(f"hi_{f}"), F.lit(f)) for f in fields]))
    return (groups.select(F.array_join(varying, ",").alias("fields")).filter("fields <> ''")
            .groupBy("fields").agg(F.count(F.lit(1)).alias("group_count")))


def shared_ids(df: DataFrame, item: str, parent: str) -> DataFrame:
    """One row: distinct items, and items that occur under more than one parent."""
    per = df.select(item, parent).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("parents"))
    return per.agg(F.count(F.lit(1)).alias("distinct_item_count"), F.count_if(F.col("parents") > 1).alias("shared_item_count"))


def missing_matches(parents: DataFrame, observed: DataFrame, key: str, item: str) -> DataFrame:
    """Parents whose own (key, item) was never observed, with the number of other parents the item was observed under."""
    missing = parents.join(observed.select(key, item).distinct(), [key, item], "left_anti")
    others = observed.select(item, key).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("n"))
    return missing.join(materialize(others, "others"), item, "left").withColumn("same_item_other_parents", F.coalesce("n", F.lit(0).cast("bigint"))).drop("n")


def other_item(parents: DataFrame, observed: DataFrame, key: str, item: str) -> DataFrame:
    """Observed groups whose item differs from the one their parent names: (key, expected, observed, rows)."""
    groups = observed.groupBy(key, item).agg(F.count(F.lit(1)).alias("row_count"))
    named = parents.groupBy(key).agg(F.min(item).alias("expected_item"))
    return groups.join(materialize(named, "named"), key).filter(~F.col(item).eqNullSafe(F.col("expected_item")))


def union_findings(findings: dict[str, DataFrame], columns: list[str]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("finding"), *columns) for name, df in findings.items()])
