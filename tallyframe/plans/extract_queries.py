"""Queries on what texts state, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract as E
from . import views as W


def number_spans(spark, d):
    s = W.load(spark, d, "documents").select("doc_id", E.spans(F.coalesce("text", F.lit("")), "[0-9]+").alias("s"))
    return s.select("doc_id", F.size("s").cast("bigint").alias("n"), F.element_at(F.when(F.size("s") > 0, F.col("s")), -1)["at"].cast("bigint").alias("last"))


FIELDS = {"title": r"<title>([^<]*)</title>", "heading": r"<h1[^>]*>([^<]*)</h1>", "first_number": r"([0-9]+)"}


def page_fields(spark, d):
    return W.load(spark, d, "pages").select("page_id", E.fields(F.col("html"), FIELDS).alias("f")).select("page_id", "f.*")


def corrected_codes(spark, d):
    code = F.concat(F.lit("AB-1"), F.when(F.col("p_size") % 2 == 0, "O").otherwise("З"), F.col("p_size").cast("string"), F.lit("l-5"), F.lit("O"))
    return W.load(spark, d, "part").select("p_partkey", E.digits_corrected(code).alias("code"))


def read_codes(spark, d):
    known = W.load(spark, d, "supplier").select(F.concat(F.lit("AB-"), F.col("s_suppkey").cast("string")).alias("code"))
    read = W.load(spark, d, "part").select(F.concat(F.when(F.col("p_partkey") % 2 == 0, "АВ/").otherwise("AB-"), F.col("p_partkey").cast("string")).alias("code"))
    return E.read_codes(read, known, "code")


def text_shifts(spark, d):
    part = W.load(spark, d, "part")
    names = part.select("p_partkey", F.lower("p_name").alias("t"), (F.col("p_size") % 3).alias("k"))
    moved = names.select("p_partkey", F.array_join(F.transform(F.filter(F.split("t", ""), lambda s: s != ""), lambda s: F.when(s.rlike("[a-z]"), F.call_function("char", (F.ascii(s) + F.col("k")).cast("bigint"))).otherwise(s)), "").alias("t"))
    lexicon = part.select(F.explode(F.split(F.lower("p_name"), r"\s+")).alias("w")).where("w rlike '^[a-z]+$'")
    return E.best_shift(moved, lexicon, "p_partkey", "t", "w", range(-2, 1)).select("p_partkey", "shift")


def polygon_overlaps(spark, d):
    p = W.load(spark, d, "part").select("p_partkey", (F.col("p_size") % 10 / 10.0).alias("x"), (F.col("p_partkey") % 7 / 10.0).alias("y"))
    a = F.array(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(1.0))
    b = F.array("x", "y", F.col("x"), F.col("y") + 1, F.col("x") + 1, F.col("y") + 1, F.col("x") + 1, F.col("y"))
    return p.select("p_partkey", F.round(E.polygon_iou(a, b), 6).alias("iou"))


QUERIES = {f.__name__: f for f in (number_spans, page_fields, corrected_codes, read_codes, text_shifts, polygon_overlaps)}
SQL = {
    "number_spans": r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[0-9]+')) AS n, CASE WHEN regexp_matches(text, '[0-9]') THEN length(regexp_extract(text, '(?s)^(.*[^0-9]|)[0-9]+[^0-9]*$', 1)) + 1 END AS last FROM documents",
    "page_fields": "SELECT page_id, " + ", ".join(f"nullif(trim(regexp_extract(html, '{p}', 1)), '') AS {k}" for k, p in FIELDS.items()) + " FROM pages",
    "corrected_codes": "SELECT p_partkey, 'AB-1' || CASE WHEN p_size % 2 = 0 THEN '0' ELSE '3' END || p_size || '1-50' AS code FROM part",
    "read_codes": "SELECT DISTINCT CASE WHEN p_partkey % 2 = 0 THEN 'АВ/' ELSE 'AB-' END || p_partkey AS code, CASE WHEN s_suppkey IS NOT NULL THEN 'AB-' || p_partkey END AS match FROM part LEFT JOIN supplier ON s_suppkey = p_partkey",
    "text_shifts": "SELECT p_partkey, CAST(-(p_size % 3) AS INTEGER) AS shift FROM part",
    "polygon_overlaps": "WITH v AS (SELECT p_partkey, (1 - p_size % 10 / 10.0) * (1 - p_partkey % 7 / 10.0) AS i FROM part) SELECT p_partkey, round(CAST(i / (2 - i) AS DOUBLE), 6) AS iou FROM v",
}
