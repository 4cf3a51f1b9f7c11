"""Writers of runs: findings, submissions, score tables, indexes. Spark's commit protocol makes them atomic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, required: tuple[str, ...] = ()) -> None:
    """JSON lines; a null in a required column stops the job before anything is committed."""
    checked = rows
    for c in required:
        checked = checked.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is null"))).otherwise(F.col(c)))
    checked.write.mode("overwrite").json(path)


def write_findings(groups: DataFrame, findings: DataFrame, path: str) -> None:
    groups.write.mode("overwrite").partitionBy("object_id").json(f"{path}/groups")
    findings.write.mode("overwrite").partitionBy("object_id").json(f"{path}/findings")


def submission(findings: DataFrame, negatives: bool = False) -> DataFrame:
    """Answer rows: violations in protocol order, then catalog rows; evidence with anchors first and two pages a stage."""
    ordered = F.array_sort(F.transform("evidence", lambda e: F.struct((~e["is_anchor"]).alias("_a"), e["stage"].alias("stage"), e["file_id"].alias("file_id"), e["page"].alias("page"))))
    per_stage = F.flatten(F.transform(F.array_distinct(F.transform(ordered, lambda e: e["stage"])), lambda s: F.slice(F.filter(ordered, lambda e: e["stage"] == s), 1, 2)))
    rows = findings if negatives else findings.where("violation_label <> 'NEGATIVE'")
    return rows.withColumn("evidence", F.transform(per_stage, lambda e: F.struct(e["stage"].alias("stage"), e["file_id"].alias("file_id"), e["page"].alias("page"))))


def write_scores(total: DataFrame, per_check: DataFrame, gate: DataFrame, path: str) -> None:
    total.coalesce(1).write.mode("overwrite").json(f"{path}/score")
    for name, rows in (("per_check", per_check), ("gate", gate)):
        rows.write.mode("overwrite").option("header", True).csv(f"{path}/{name}")


#: (kind, pattern of the relative path), most telling first where several fit.
TEMPLATES = (
    ("findings", r"^findings/object_id=[^/]+/[^/]+\.json$"), ("groups", r"^groups/object_id=[^/]+/[^/]+\.json$"), ("tokens", r"^tokens/[^/]+/p\d+\.json(\.gz)?$"),
    ("values", r"^values/[^/]+\.jsonl$"), ("score", r"^score/.*\.json$"), ("json", r"\.jsonl?$"),
)


def kind_of(path: Column) -> Column:
    out = F.lit("other")
    for kind, pattern in reversed(TEMPLATES):
        out = F.when(path.rlike(pattern), kind).otherwise(out)
    return out


def artifacts_index(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, sha256, size) of a run's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    relative = F.regexp_replace("path", r"^.*?" + folder.rstrip("/").replace("file://", "").replace(".", r"\.") + "/", "")
    return files.select(relative.alias("path"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("size")).withColumn("kind", kind_of(F.col("path"))).where("kind <> 'other'")


def append_audit(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def versions(history: DataFrame, key: str, order: list[str], sha: str) -> DataFrame:
    """Versions of snapshots: a new one only where the content changed; the last is current, others superseded."""
    w = Window.partitionBy(key).orderBy(*order)
    changed = history.withColumn("_new", ~F.coalesce(F.lag(sha).over(w) == F.col(sha), F.lit(False))).where("_new").drop("_new")
    last = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return changed.withColumns({"version": F.row_number().over(w), "state": F.when(F.row_number().over(last) == 1, "CURRENT").otherwise("SUPERSEDED")})


def prometheus(metrics: DataFrame) -> DataFrame:
    """(name, text) in exposition format of rows (name, help, type, labels map, value)."""
    pairs = F.array_join(F.array_sort(F.transform(F.map_entries("labels"), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"')))), ",")
    line = F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string"))
    head = F.concat(F.lit("# HELP "), "name", F.lit(" "), "help", F.lit("\n# TYPE "), "name", F.lit(" "), "type", F.lit("\n"))
    return metrics.groupBy("name", head.alias("head")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("lines")).select("name", F.concat("head", "lines").alias("text"))


def strict_projection(rows: DataFrame, contract: str) -> DataFrame:
    """rows with the contract's columns and fields only, in its order and types; what rows lack is null."""
    from pyspark.sql import types as T

    def fit(c: Column, have: T.DataType, want: T.DataType) -> Column:
        if isinstance(want, T.StructType) and isinstance(have, T.StructType):
            parts = [(fit(c.getField(f.name), have[f.name].dataType, f.dataType) if f.name in have.names else F.lit(None).cast(f.dataType)).alias(f.name) for f in want]
            return F.when(c.isNotNull(), F.struct(*parts))
        if isinstance(want, T.ArrayType) and isinstance(have, T.ArrayType):
            return F.transform(c, lambda x: fit(x, have.elementType, want.elementType))
        return c.cast(want)

    want = T._parse_datatype_string(contract)
    return rows.select(*[(fit(F.col(f.name), rows.schema[f.name].dataType, f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)).alias(f.name) for f in want])


def gated_submission(findings: DataFrame, gates: DataFrame, negatives: bool = False) -> tuple[DataFrame, DataFrame]:
    """(answers, refused): the submission of objects that pass all their gates (object_id, gate, passed), and the objects that don't with the gates they fail."""
    failed = gates.where(~F.coalesce(F.col("passed"), F.lit(False))).groupBy("object_id").agg(F.array_sort(F.collect_set("gate")).alias("failed"))
    return submission(findings, negatives).join(failed, "object_id", "left_anti"), failed


def sidecar(spark: SparkSession, run_id: str, settings: dict[str, str], artifacts: DataFrame, started_at: str, checks_total: int) -> DataFrame:
    """One row of provenance: settings and their hash, number and hash of the artifacts (order does not matter), start and number of checks."""
    import hashlib
    import json

    text = json.dumps(settings, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    total = artifacts.agg(F.count("*").alias("artifacts"), F.coalesce(F.sum(F.conv(F.substring("sha256", 1, 15), 16, 10).cast("decimal(20,0)")).cast("string"), F.lit("0")).alias("artifacts_hash"))
    head = {"run_id": run_id, "started_at": started_at, "settings": text, "settings_sha256": hashlib.sha256(text.encode()).hexdigest()}
    return total.select(*[F.lit(v).alias(k) for k, v in head.items()], F.lit(checks_total).cast("bigint").alias("checks_total"), "artifacts", "artifacts_hash")


def write_token_cache(tokens: DataFrame, path: str, version: str) -> None:
    """Tokens keyed by content hash, in a partition of the pipeline's version; pages that the cache has already are not written again."""
    spark = tokens.sparkSession
    rows = tokens.withColumn("pipeline_version", F.lit(version)).dropDuplicates(["sha256", "page_no"])
    try:
        known = spark.read.parquet(path).where(F.col("pipeline_version") == version).select("sha256", "page_no")
        rows = rows.join(known, ["sha256", "page_no"], "left_anti")
    except Exception as e:  # noqa: BLE001  no cache yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    rows.write.mode("append").partitionBy("pipeline_version").parquet(path)


def protocol_json(objects: DataFrame, rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, protocol): one JSON document an object, its rows in order under their section; an object's protocol is one document by definition."""
    body = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rows.columns if c not in (key, *order)])
    docs = rows.groupBy(key).agg(F.array_sort(F.collect_list(body)).alias("rows"))
    return objects.join(docs, key, "left").select(key, F.to_json(F.struct(*objects.columns, "rows")).alias("protocol"))


def write_merged(target: str, changes: DataFrame, key: str, sha: str, version: int) -> DataFrame:
    """Write the next version of a table, a folder of its own: new and changed rows from `changes`, unchanged ones kept, those that changes lacks marked SUPERSEDED.

    A reader of the version before sees it until the new folder is whole; a repeated job writes the same folder again.
    """
    spark = changes.sparkSession
    new = changes.select(key, sha, F.lit("CURRENT").alias("state"), F.lit(version).alias("since"))
    if version > 1:
        old = spark.read.parquet(f"{target}/version={version - 1}").select(key, F.col(sha).alias("_sha"), F.col("since").alias("_since"))
        both = old.join(new, key, "full_outer")
        same = F.col("_sha").eqNullSafe(F.col(sha))
        new = both.select(key, F.coalesce(sha, "_sha").alias(sha), F.when(F.col("state").isNull(), "SUPERSEDED").otherwise(F.col("state")).alias("state"), F.when(F.col("state").isNull() | same, F.col("_since")).otherwise(F.lit(version)).alias("since"))
    new.write.mode("overwrite").parquet(f"{target}/version={version}")
    return spark.read.parquet(f"{target}/version={version}")


def score_summary(total: DataFrame, by: str) -> DataFrame:
    """(text): a line for each row of a score table, in order of `by`: its name and its figures as name=value."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("-"))) for c in total.columns if c != by]
    lines = total.select(F.struct(F.col(by).cast("string").alias("k"), F.concat_ws(" ", F.concat(F.col(by).cast("string"), F.lit(":")), *parts).alias("line")).alias("l"))
    return lines.agg(F.array_join(F.array_sort(F.collect_list("l"))["line"], "\n").alias("text"))
