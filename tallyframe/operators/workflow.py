"""Predicates, decisions and look-ups of the review workflow."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NON_CITABLE = ("EXCLUDED", "UNREADABLE", "DRAFT")
#: (status, decision, status after it); the decision table of a check.
TRANSITIONS = (
    ("PENDING", "CONFIRMED_VIOLATION", "CONFIRMED"), ("PENDING", "NEGATIVE_VERIFIED", "REJECTED"), ("PENDING", "CLARIFICATION_REQUIRED", "CLARIFICATION"),
    ("CLARIFICATION", "CONFIRMED_VIOLATION", "CONFIRMED"), ("CLARIFICATION", "NEGATIVE_VERIFIED", "REJECTED"), ("CLARIFICATION", "REVERT_TO_PENDING", "PENDING"),
    ("CONFIRMED", "REVERT_TO_PENDING", "PENDING"), ("REJECTED", "REVERT_TO_PENDING", "PENDING"),
)


def known(c: Column) -> Column:
    """A predicate with unknown taken as false."""
    return F.coalesce(c, F.lit(False))


def reviewable(state: Column, status: Column, completeness: Column) -> Column:
    return known((state == "ACTIVE") & status.isNotNull() & (completeness.isNull() | (completeness == "COMPLETE")))


def not_citable_reasons(excluded: Column, annotation: Column, pages: Column) -> Column:
    """Why a file can't be cited; empty if it can."""
    return F.array_compact(F.array(F.when(known(excluded), F.lit("EXCLUDED")), F.when(known(annotation.isin(*NON_CITABLE)), F.lit("ANNOTATION")), F.when(known(pages < 1), F.lit("NO_PAGES"))))


def stage_accepts(file_stage: Column, asked: Column) -> Column:
    """A mixed file serves both of its stages."""
    return F.when(file_stage == "RD_ID_MIXED", asked.isin("RD", "ID")).otherwise(file_stage == asked)


def page_in_range(page: Column, pages: Column) -> Column:
    return known(page.between(1, pages))


def contains_text(c: Column, q: str) -> Column:
    """Case-insensitive containment; %, _ and backslash of the question stand for themselves."""
    escaped = q.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return c.ilike(f"%{escaped}%")


def where_given(rows: DataFrame, equal: dict[str, object] | None = None, since: dict[str, object] | None = None, until: dict[str, object] | None = None) -> DataFrame:
    """Only the conditions whose value is given, all of them."""
    terms = [F.col(c) == v for c, v in (equal or {}).items() if v is not None] + [F.col(c) >= v for c, v in (since or {}).items() if v is not None] + [F.col(c) < v for c, v in (until or {}).items() if v is not None]
    return rows.where(reduce(lambda a, b: a & b, terms)) if terms else rows


def holds_object(manifest_json: Column, object_id: str) -> Column:
    """Whether a JSON manifest lists the object."""
    return known(F.exists(F.from_json(manifest_json, "struct<objects:array<struct<object_id:string>>>")["objects"], lambda o: o["object_id"] == object_id))


def same_row(statuses: Column, section: str, status: str) -> Column:
    """Section and status on one and the same element."""
    return known(F.exists(statuses, lambda s: (s["section"] == section) & (s["status"] == status)))


def decided(checks: DataFrame, decisions: DataFrame, key: str) -> DataFrame:
    """checks with allowed and next_status for the decisions made on them; the table of transitions is broadcast."""
    spark = checks.sparkSession
    table = spark.createDataFrame(list(TRANSITIONS), "status string, decision string, next_status string")
    return checks.join(decisions, key).join(F.broadcast(table), ["status", "decision"], "left").withColumn("allowed", F.col("next_status").isNotNull()).withColumn("next_status", F.coalesce("next_status", "status"))


def process_status(current: Column, pending: Column, disputes: Column) -> Column:
    return F.when(current == "FINALIZED", current).when(disputes > 0, "DISPUTED").when(pending > 0, "IN_REVIEW").otherwise("READY")


def gate(pending: Column, disputes: Column, incomplete: Column, unread: Column) -> tuple[Column, Column]:
    """(blockers, warnings) of a finalization."""
    names = lambda pairs: F.array_compact(F.array(*[F.when(known(c), F.lit(n)) for n, c in pairs]))
    return names((("PENDING", pending > 0), ("DISPUTES", disputes > 0))), names((("INCOMPLETE", incomplete > 0), ("UNREAD_PAGES", unread > 0)))


def rejection_verdict(hits: Column) -> Column:
    """Of checks (verdict, confidence) on a rejection: the first DISAGREE; else UNCERTAIN with the least confidence; else AGREE at 1 - c/2 within 0.5 and 0.95."""
    disagree = F.filter(hits, lambda h: h["verdict"] == "DISAGREE")
    unsure = F.filter(hits, lambda h: h["verdict"] == "UNCERTAIN")
    top = F.coalesce(F.array_max(F.transform(hits, lambda h: h["confidence"])), F.lit(0.0))
    agree = F.greatest(F.lit(0.5), F.least(F.lit(0.95), 1 - top / 2))
    made = lambda v, c: F.struct(F.lit(v).alias("verdict"), c.cast("double").alias("confidence"))
    return F.when(F.size(disagree) > 0, made("DISAGREE", F.get(disagree, F.lit(0))["confidence"])).when(F.size(unsure) > 0, made("UNCERTAIN", F.array_min(F.transform(unsure, lambda h: h["confidence"])))).otherwise(made("AGREE", agree))


def gold_label(status: Column, decided_by: Column) -> Column:
    """Labels come from inspectors only."""
    return F.when(decided_by == "INSPECTOR", F.when(status == "CONFIRMED", "VIOLATION").when(status == "REJECTED", "NEGATIVE"))


def title_score(title: Column, topic: str, anchor: str, layer: Column) -> Column:
    """Topic 1, the family's anchor 2, a layer of the family 1."""
    return F.when(known(title.rlike(topic)), 1).otherwise(0) + F.when(known(title.rlike(anchor)), 2).otherwise(0) + F.when(known(layer), 1).otherwise(0)


def in_discipline(marks: Column, disciplines: Column) -> Column:
    """A file without marks passes; others need a mark of the family."""
    return (F.size(F.coalesce(marks, F.array().cast("array<string>"))) == 0) | known(F.arrays_overlap(marks, disciplines))


def free_findings(candidates: DataFrame, object_col: str, order: list[str], least: float = 0.7, most: int = 5) -> DataFrame:
    """Free findings that are anchored in both stages, proven absent and sure enough; the first `most` of each object (the report's own limit)."""
    good = candidates.where((F.col("anchors") >= 2) & F.col("absence").isin("DOCUMENT", "COUNTERPART") & (F.col("confidence") >= least))
    n = F.row_number().over(Window.partitionBy(object_col).orderBy(F.desc("confidence"), *order))
    return good.withColumn("number", n).where(F.col("number") <= most)


def routed(findings: DataFrame, change_map: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(emitted, context): findings whose route says emit; the others. The map is a catalog table."""
    both = findings.join(F.broadcast(change_map), keys, "left")
    return both.where(known(F.col("emit"))), both.where(~known(F.col("emit")))


def overridden(catalog: DataFrame, overrides: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Catalog rows with the override's value where it has one."""
    renamed = overrides.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    return catalog.join(renamed, key, "left").withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def unclaimed(disk: DataFrame, files: DataFrame, path: str = "relative_path") -> DataFrame:
    plain = lambda c: F.lower(F.regexp_replace(c, r"[\\/]+", "/"))
    return disk.join(files.select(plain(F.col(path)).alias("_p")).distinct(), plain(disk[path]) == F.col("_p"), "left_anti")


def recovered(missing: DataFrame, disk: DataFrame) -> DataFrame:
    """(file_id, path): missing files found under another path by size and sha256; the lowest path of several."""
    found = missing.select("file_id", "size_bytes", "sha256").join(disk.select(F.col("relative_path").alias("path"), "size_bytes", F.col("sha256").alias("_sha")), "size_bytes").where(F.col("sha256") == F.col("_sha"))
    return found.groupBy("file_id").agg(F.min("path").alias("path"))


def shared_path_conflicts(files: DataFrame, path: str = "resolved_path") -> DataFrame:
    """Rows of different content that resolve to one path."""
    bad = files.groupBy(path).agg(F.count_distinct("sha256").alias("_n")).where("_n > 1").select(path)
    return files.join(bad, path, "left_semi")


def member_roles(members: DataFrame, files: DataFrame) -> DataFrame:
    """Archive members: DUPLICATE of the lowest file of equal content in the manifest, REPEATED within archives, else NEW."""
    first = files.where(F.col("sha256").isNotNull()).groupBy("sha256").agg(F.min("file_id").alias("twin"))
    seen = F.row_number().over(Window.partitionBy("sha256").orderBy("archive", "member"))
    marked = members.join(first, "sha256", "left").withColumn("_n", F.when(F.col("sha256").isNotNull(), seen))
    return marked.withColumn("role", F.when(F.col("twin").isNotNull(), "DUPLICATE").when(F.col("_n") > 1, "REPEATED").otherwise("NEW")).drop("_n")


def evidence_deduplicated(evidence: Column) -> Column:
    """The first of each (stage, file, page)."""
    key = lambda e: F.concat_ws("|", e["stage"], e["file_id"], e["page"].cast("string"))
    keys = F.transform(evidence, key)
    return F.filter(evidence, lambda e, i: F.array_position(keys, key(e)) == i + 1)


def twins_merged(conflicts: DataFrame, key: str, files: str, rank: str) -> DataFrame:
    """Conflicts whose files another conflict of the key all has fold into the first such host: adds `host` (its rank) where folded."""
    own = F.collect_list(F.struct(F.col(rank).alias("r"), F.col(files).alias("f"))).over(Window.partitionBy(key))
    hosts = F.filter(own, lambda h: (h["r"] != F.col(rank)) & (F.size(F.array_except(F.col(files), h["f"])) == 0) & ((F.size(h["f"]) > F.size(files)) | (h["r"] < F.col(rank))))
    return conflicts.withColumn("host", F.array_min(F.transform(hosts, lambda h: h["r"])))


def page_markup(runs: DataFrame, key: list[str]) -> DataFrame:
    """The run that shows a page: the newest with markup, else the newest with a layout."""
    n = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("has_markup"), F.desc("started_at"), "run_id"))
    return runs.where(F.col("has_layout")).withColumn("_n", n).where("_n = 1").drop("_n")


def decision_overlay(rows: DataFrame, groups: DataFrame, cards: DataFrame) -> DataFrame:
    """Effective status: that of the finding's group, else of its card, else its own."""
    g, c = groups.select("finding_group_id", F.col("status").alias("_g")), cards.select("card_ref", F.col("status").alias("_c"))
    return rows.join(g, "finding_group_id", "left").join(c, "card_ref", "left").withColumn("effective_status", F.coalesce("_g", "_c", "status")).drop("_g", "_c")


def recovered_items(items: Column, valid) -> tuple[Column, Column]:
    """(kept, dropped) items of a list by a predicate; unknown counts as invalid."""
    return F.filter(items, lambda x: known(valid(x))), F.filter(items, lambda x: ~known(valid(x)))


def weighted_progress(done: Column, total: Column, weight: Column) -> Column:
    """Aggregate: weighted share done, in percent; null without weight."""
    return F.try_divide(F.sum(weight * F.coalesce(F.try_divide(done, total), F.lit(0.0))) * 100, F.sum(weight))


def cross_check(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, side): keys that only one side has."""
    return a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("side", F.lit("left")).unionByName(b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("side", F.lit("right")))


def rules_table(document: str) -> list[dict]:
    """Rules of a JSON document {"rules": [...]}, each with id, applies, condition and expected; a rule without them stops the load."""
    rules = json.loads(document)["rules"]
    for r in rules:
        if lack := {"id", "applies", "condition", "expected"} - r.keys():
            raise ValueError(f"rule {r.get('id')} lacks {sorted(lack)}")
    return rules
