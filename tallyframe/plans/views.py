"""The engine's entities seen in the driver's tables, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(c):
    """Rounded to 0.01 by the same double arithmetic in both engines."""
    return F.floor(c * 100 + 0.5).cast("double") / 100


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted values: parameter, location, stage, value, confidence, file, page, quality."""
    line, part = load(spark, sf_dir, "lineitem"), load(spark, sf_dir, "part")
    stage = F.when(F.col("l_returnflag") == "A", "PD").when(F.col("l_returnflag") == "N", "RD").otherwise("ID")
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(
        F.col("p_brand").alias("param_code"), (F.col("l_suppkey") % 5).cast("int").alias("location"), stage.alias("stage"),
        cents(F.col("l_extendedprice") / F.col("l_quantity")).alias("value"), cents(1 - F.col("l_discount")).alias("confidence"),
        F.col("l_orderkey").alias("file_id"), F.col("l_linenumber").alias("page_no"), F.when(F.col("l_linestatus") == "F", "OK").otherwise("LOW").alias("quality"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"), F.col("l_quantity").cast("int").alias("quantity"), F.col("p_size").alias("size"), F.col("p_type").alias("type"), F.col("l_tax").alias("tax"), F.col("l_discount").alias("discount"),
    )


VALUES = """ev AS (SELECT p_brand AS param_code, CAST(l_suppkey % 5 AS INTEGER) AS location,
 CASE l_returnflag WHEN 'A' THEN 'PD' WHEN 'N' THEN 'RD' ELSE 'ID' END AS stage,
 CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) AS DOUBLE) / 100 AS value, CAST(floor((1 - l_discount) * 100 + 0.5) AS DOUBLE) / 100 AS confidence,
 l_orderkey AS file_id, l_linenumber AS page_no, CASE l_linestatus WHEN 'F' THEN 'OK' ELSE 'LOW' END AS quality,
 l_partkey AS part, l_suppkey AS supplier, CAST(l_quantity AS INTEGER) AS quantity, p_size AS size, p_type AS type, l_tax AS tax, l_discount AS discount
 FROM lineitem JOIN part ON l_partkey = p_partkey)"""

#: Characters of a page of a document; its first page is hashed whole.
PAGE_CHARS = 1000
AXES = [("PD", "RD"), ("RD", "ID"), ("PD", "ID")]

BEST = VALUES + """, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY param_code, location, stage ORDER BY confidence DESC, file_id, page_no, value, supplier) AS rn FROM ev WHERE quality = 'OK') WHERE rn = 1),
axes(axis, a, b) AS (VALUES ('PD_RD', 'PD', 'RD'), ('RD_ID', 'RD', 'ID'), ('PD_ID', 'PD', 'ID')),
diff AS (SELECT e.param_code, e.location, axis, e.value AS expected, f.value AS actual, least(e.confidence, f.confidence) AS confidence, e.file_id AS expected_file, f.file_id AS actual_file,
 CASE WHEN abs(f.value - e.value) <= greatest(0.5, abs(e.value) * 0.25) THEN 'EQUAL' WHEN f.value - e.value < 0 THEN 'VIOLATION' ELSE 'IMPROVEMENT' END AS result
 FROM axes JOIN best e ON e.stage = a JOIN best f ON f.stage = b AND f.param_code = e.param_code AND f.location = e.location)"""


def _order() -> list:
    return [-F.col("confidence"), F.col("file_id"), F.col("page_no"), F.col("value"), F.col("supplier")]


def best(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.values import best_per_key

    return best_per_key(values(spark, sf_dir).where("quality = 'OK'"), ["param_code", "location", "stage"], _order())


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best values of the stages against each other."""
    from ..operators.values import best_pairs, pairwise_delta

    both = best_pairs(values(spark, sf_dir).where("quality = 'OK'"), ["param_code", "location"], AXES, _order(), carry=("value", "confidence", "file_id"))
    return both.select(
        "param_code", "location", "axis", F.col("expected_value").alias("expected"), F.col("actual_value").alias("actual"), F.least("expected_confidence", "actual_confidence").alias("confidence"),
        F.col("expected_file_id").alias("expected_file"), F.col("actual_file_id").alias("actual_file"), pairwise_delta(F.col("expected_value"), F.col("actual_value"), absolute=0.5, relative=0.25).alias("result"),
    )


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File manifest and probes: documents by content."""
    text = F.coalesce("text", F.lit(""))
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("file_id"), F.col("source").alias("object_id"), F.sha2(text, 256).alias("sha256"), F.ceil(F.col("n_chars") / PAGE_CHARS).cast("bigint").alias("pages"),
        F.md5(F.lower(F.substring(text, 1, PAGE_CHARS))).alias("text_hash"), F.col("lang"), F.col("n_chars"),
    )


FILES = f"""files AS (SELECT doc_id AS file_id, source AS object_id, sha256(coalesce(text, '')) AS sha256, CAST(ceil(n_chars / {PAGE_CHARS}) AS BIGINT) AS pages,
 md5(lower(substring(coalesce(text, ''), 1, {PAGE_CHARS}))) AS text_hash, lang, n_chars FROM documents)"""


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inspectors' decisions: events."""
    kind = F.when(F.col("event_type") == "purchase", "CONFIRMED_VIOLATION").when(F.col("event_type") == "error", "NEGATIVE_VERIFIED").when(F.col("event_type") == "click", "CLARIFICATION_REQUIRED").otherwise("REVERT_TO_PENDING")
    return load(spark, sf_dir, "events").select(
        "event_id", "ts", F.col("user_id").alias("check_id"), (F.col("user_id") % 7).cast("int").alias("object_id"), kind.alias("decision"), (F.get_json_object("props", "$.k").cast("int") % 8).alias("reason_code"), "value",
    )


DECISIONS = """decisions AS (SELECT event_id, ts, user_id AS check_id, CAST(user_id % 7 AS INTEGER) AS object_id,
 CASE event_type WHEN 'purchase' THEN 'CONFIRMED_VIOLATION' WHEN 'error' THEN 'NEGATIVE_VERIFIED' WHEN 'click' THEN 'CLARIFICATION_REQUIRED' ELSE 'REVERT_TO_PENDING' END AS decision,
 CAST(json_extract_string(props, '$.k') AS INTEGER) % 8 AS reason_code, value FROM events)"""


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold labels beside a plain heuristic: documents that are labelled."""
    text = F.coalesce("text", F.lit(""))
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    predicted = (F.length(text) - F.length(F.translate(text, "*#%&$|!", ""))) * 50 <= F.length(text)
    return docs.join(labels, "doc_id").select("doc_id", "lang", "source", "n_chars", (F.col("quality") == 1).alias("gold"), predicted.alias("predicted"), (F.col("toxic") == 1).alias("critical"))


JUDGED = """judged AS (SELECT doc_id, lang, source, n_chars, quality = 1 AS gold,
 (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '*#%&$|!', ''))) * 50 <= length(coalesce(text, '')) AS predicted, toxic = 1 AS critical FROM documents JOIN labels USING (doc_id))"""
