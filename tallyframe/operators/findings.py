"""Operators on findings: deduplication, grouping, precedence, anchors, hedges, suspicions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedupe_by_axis(findings: DataFrame, keys: list[str], axes: list[str], axis_col: str = "axis", ties: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(kept, context): of each key the finding of the first axis in `axes`, then the most confident; the others are context."""
    rank = F.coalesce(*[F.when(F.col(axis_col) == a, F.lit(i)) for i, a in enumerate(axes)], F.lit(len(axes)))
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(rank, F.desc("confidence"), *ties))
    ranked = findings.withColumn("_n", n)
    return ranked.where("_n = 1").drop("_n"), ranked.where("_n > 1").drop("_n")


def finding_groups(findings: DataFrame, by: list[str], member: str, order: list[str]) -> DataFrame:
    """One row a group: members, least confidence, and a running card number in the order given."""
    groups = findings.groupBy(*by).agg(F.array_sort(F.collect_set(member)).alias("members"), F.round(F.min("confidence"), 3).alias("confidence"))
    return groups.withColumn("card", F.row_number().over(Window.orderBy(*order)))


def atomic(groups: DataFrame, member: str = "members", name: str = "member") -> DataFrame:
    """One finding for each member of a group, with the group's card."""
    return groups.select("*", F.explode(member).alias(name)).drop(member)


def sufficient(available: Column, sets: list[list[str]]) -> Column:
    """Whether any set of stages is fully available; an empty list asks for nothing."""
    if not sets:
        return F.lit(True)
    out = F.lit(False)
    for s in sets:
        out = out | (F.size(F.array_except(F.array(*[F.lit(x) for x in s]), available)) == 0)
    return out


def precedence(active: Column, enough: Column, violated: Column, missing_document: Column, unreadable: Column, verified: Column) -> Column:
    """Status of a catalog row: the first of seven rules that holds."""
    return (
        F.when(~active, "DEACTIVATED").when(violated, "VIOLATED").when(~enough, "INSUFFICIENT_DOCUMENTS").when(missing_document, "MISSING_DOCUMENT").when(unreadable, "UNREADABLE").when(verified, "VERIFIED").otherwise("UNVERIFIED")
    )


def document_status(available: Column, stages: tuple[str, ...] = ("PD", "RD", "ID")) -> Column:
    """<stages>_AVAILABLE[_<stages>_MISSING] in the stages' own order."""
    have = F.concat_ws("_", *[F.when(F.array_contains(available, s), s) for s in stages])
    lack = F.concat_ws("_", *[F.when(~F.array_contains(available, s), s) for s in stages])
    return F.concat(F.when(have != "", F.concat(have, F.lit("_AVAILABLE"))).otherwise(""), F.when((lack != "") & (have != ""), F.concat(F.lit("_"), lack, F.lit("_MISSING"))).when(lack != "", F.concat(lack, F.lit("_MISSING"))).otherwise(""))


def anchor_page(pages: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The best page of each key under a total order."""
    return pages.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def hedge_budget(groups: DataFrame, object_col: str, probability: str, order: str, is_hedge: str, share: float = 0.20) -> DataFrame:
    """Accept hedges by falling probability while accepted hedges stay within `share` of the object's other findings: adds `accepted`.

    A rejected hedge leaves room for later ones, so an object is one ordered pass; an object's findings are few.
    """
    schema = T.StructType([*groups.schema.fields, T.StructField("accepted", T.BooleanType())])

    def run(g):
        g = g.sort_values([probability, order], ascending=[False, True], kind="mergesort")
        firm, taken, out = int((~g[is_hedge]).sum()), 0, []
        for hedge in g[is_hedge]:
            good = not hedge or (taken + 1) <= share * firm
            taken += bool(hedge and good)
            out.append(good)
        return g.assign(accepted=out)

    return groups.groupBy(object_col).applyInPandas(run, schema)


def merge_suspicions(rows: DataFrame, keys: list[str], evidence: str, confidence: str, low: str, high: str) -> DataFrame:
    """Suspicions of one key become one: greatest confidence, union of evidence, widest range."""
    merged = rows.groupBy(*keys).agg(F.max(confidence).alias(confidence), F.min(low).alias(low), F.max(high).alias(high), F.count("*").alias("merged"))
    union = rows.select(*keys, F.explode(evidence).alias(evidence)).groupBy(*keys).agg(F.array_sort(F.collect_set(evidence)).alias(evidence))  # a set: repeats go before the shuffle
    return merged.join(union, keys)


def covered(suspicions: DataFrame, findings: DataFrame, keys: list[str], members: str = "members") -> DataFrame:
    """Suspicions whose members no finding of the same key covers."""
    hits = suspicions.alias("s").join(findings.select(*keys, F.col(members).alias("_have")), keys).where(F.size(F.array_except(members, "_have")) == 0).select(*keys, members)
    return suspicions.join(hits.distinct(), [*keys, members], "left_anti")


def confidence_score(base: Column, provenance: Column, cloud: Column) -> Column:
    """base * (0.5 + 0.5 * provenance), 0.08 more inside a revision cloud, at most 1."""
    return F.least(F.lit(1.0), base * (0.5 + 0.5 * provenance) + F.when(cloud, 0.08).otherwise(0.0))


def review_priority(severity: Column, confidence: Column) -> Column:
    return F.when((severity == "CRITICAL") & (confidence >= 0.8), 1).when((severity == "CRITICAL") | (confidence >= 0.8), 2).otherwise(3)


def violation_union(checks: list[tuple[str, DataFrame]], key: str) -> DataFrame:
    """(rule, key) of every violation of every rule."""
    out = None
    for rule, rows in checks:
        part = rows.select(F.lit(rule).alias("rule"), F.col(key).cast("bigint").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def rule_summary(violations: DataFrame, rules: list[str]) -> DataFrame:
    """(rule, violations, passed) with a row for every rule."""
    spark = violations.sparkSession
    every = spark.createDataFrame([(r,) for r in rules], "rule string")
    return every.join(violations.groupBy("rule").agg(F.count("*").alias("violations")), "rule", "left").select("rule", F.coalesce("violations", F.lit(0)).cast("bigint").alias("violations"), F.coalesce(F.col("violations") == 0, F.lit(True)).alias("passed"))
