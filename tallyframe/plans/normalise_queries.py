"""Queries on normal forms, each over a whole table, beside SQL that states what must come out."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import normalise as N
from . import views as W

RANGES = [("AR", 1, 20), ("KR", 21, 40), ("OV", 41, 60)]


def _part(spark, d):
    return W.load(spark, d, "part")


def criticality_forms(spark, d):
    o = W.load(spark, d, "orders").select("o_orderkey", F.concat(F.lit(" «"), F.upper("o_orderpriority"), F.lit("»;  (x) ")).alias("raw"))
    return o.select("o_orderkey", N.criticality(F.col("raw")).alias("light"), N.criticality(F.col("raw"), True).alias("relaxed"))


def value_texts(spark, d):
    raw = F.concat(F.translate(F.format_number("l_extendedprice", 2), ",.", " ,"), F.when(F.col("l_linenumber") % 2 == 0, " кв. м;").otherwise(" М3"))
    return W.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", N.value_text(raw).alias("value"))


def quantities(spark, d):
    unit = F.get(F.array(*map(F.lit, (" мм", " см", "м", " км", " бочек"))), (F.col("p_size") % 5).cast("int"))
    return _part(spark, d).select("p_partkey", N.quantity(F.concat(F.col("p_size").cast("string"), F.lit(",5"), unit)).alias("q")).select("p_partkey", "q.*")


def value_matches(spark, d):
    """Sizes in centimetres beside the same in millimetres (wrong for every seventh), blanks for every eleventh."""
    cm = F.when(F.col("p_partkey") % 11 == 0, "").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(" см")))
    mm = F.when(F.col("p_partkey") % 22 == 0, " ").otherwise(F.concat((F.col("p_size") * 10 + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)).cast("string"), F.lit(",0 мм")))
    return N.matched_values(_part(spark, d), cm, mm).select("p_partkey", "score")


def parsed_codes(spark, d):
    raw = F.concat(F.get(F.array(*map(F.lit, ("ar", "KR", "OV", "M", "ZZ"))), (F.col("p_partkey") % 5).cast("int")), F.lit("–"), F.col("p_size").cast("string"))
    return _part(spark, d).select("p_partkey", N.parsed_code(raw, RANGES).alias("c"), N.normalize_code(raw, RANGES).alias("light"), N.normalize_code(raw, RANGES, True).alias("relaxed")).select("p_partkey", "c.canonical", "c.mismatch", "light", "relaxed")


def rendered_notes(spark, d):
    c = W.load(spark, d, "customer")
    values = {"name": F.col("c_name"), "segment": F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), "debt": F.when(F.col("c_acctbal") < 0, F.lit("debt"))}
    return c.select("c_custkey", N.rendered("Client {name} {segment} , {debt} .", values).alias("plain"), N.filled("Client {name} (segment {segment}; has {debt})", values).alias("grouped"))


def match_keys(spark, d):
    name = F.concat(F.lit("in\\"), F.col("p_brand"), F.lit("__"), F.col("p_name"), F.lit(".PDF"))
    return _part(spark, d).select("p_partkey", N.match_key(name).alias("key"))


def code_shapes(spark, d):
    code = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("AB-"), F.col("p_size").cast("string"), F.lit("/C.1"))).when(F.col("p_size") % 3 == 1, F.concat(F.lit("20.03."), F.col("p_size").cast("string"), F.lit("г"))).otherwise(F.col("p_brand"))
    return _part(spark, d).select("p_partkey", N.looks_like_code(code).alias("looks"), N.layout_code_key(code).alias("key"))


def codes_in_text(spark, d):
    return W.load(spark, d, "pages").select("page_id", F.size(N.document_codes(F.upper("url"))).cast("bigint").alias("n"))


def strict_texts(spark, d):
    return W.load(spark, d, "documents").select("doc_id", F.md5(N.strict_text(F.coalesce("text", F.lit("")))).alias("digest"))


def wrapped_lines(spark, d):
    known = F.array(F.lit("brandname"), F.lit("pot"))
    a = F.when(F.col("p_size") % 3 == 0, F.lit("a brand-")).when(F.col("p_size") % 3 == 1, F.lit("a part- ")).otherwise(F.lit("whole  line"))
    return _part(spark, d).select("p_partkey", N.joined_lines(a, F.concat(F.lit("name "), F.col("p_brand")), known).alias("line"))


def spec_items(spark, d):
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("Кабель ВВГнг-LS 3х"), F.col("p_size").cast("string"), F.lit(",5 в лотке"))).when(F.col("p_size") % 5 == 0, F.concat(F.lit("Труба стальная Ду "), (F.col("p_size") * 10).cast("string"))).otherwise(F.col("p_type"))
    return _part(spark, d).select("p_partkey", N.spec_item(name).alias("i")).select("p_partkey", "i.*")


def dwg_versions(spark, d):
    head = F.when(F.col("p_size") % 4 == 0, "AC1032\0\0").when(F.col("p_size") % 4 == 1, "AC1999xx").when(F.col("p_size") % 4 == 2, "AC1015??").otherwise("PK..")
    return _part(spark, d).select("p_partkey", N.dwg_version(head).alias("v")).select("p_partkey", "v.code", "v.release")


def fingerprints(spark, d):
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    group = F.when(F.col("doc_id") % 4 > 0, F.sha2("source", 256))
    return W.load(spark, d, "documents").select("doc_id", N.evidence_fingerprint(sha, group).alias("fingerprint"), N.short_digest(sha).alias("short"))


def time_ids(spark, d):
    return W.load(spark, d, "events").select("event_id", N.time_ordered_id(F.col("ts").cast("timestamp"), F.col("event_id")).alias("id"))


def log_fields(spark, d):
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("step done stage="), F.col("event_type"), F.lit(" user="), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit('{"stage": "'), F.col("event_type"), F.lit('", "user": "'), F.col("user_id").cast("string"), F.lit('"}')))
    return W.load(spark, d, "events").select("event_id", N.progress_fields(line).alias("f")).select("event_id", F.col("f")["stage"].alias("stage"), F.col("f")["user"].alias("user"))


FAMILIES = {"METAL": ["STEEL$", "TIN$"], "SMALL": ["^SMALL"], "COATED": ["ANODIZED", "PLATED"]}


def tag_classes(spark, d):
    return _part(spark, d).select("p_partkey", F.array_join(N.tag_families(F.col("p_type"), FAMILIES), "+").alias("families"))


def cue_gates(spark, d):
    text = F.coalesce("text", F.lit(""))
    return W.load(spark, d, "documents").select("doc_id", N.nearest_cue_accepts(text, F.least(F.length(text), F.lit(200)), ["the ", "de "], ["of ", "la "], 80).alias("accepted"))


def labelled_values(spark, d):
    text = F.concat(F.lit("Общая Площадь : "), F.translate(F.format_number("o_totalprice", 2), ",.", " ,"), F.lit(" м2, этажей - "), F.col("o_custkey").cast("string"))
    o = W.load(spark, d, "orders").select("o_orderkey", N.labelled_value(text, "площадь", "м2|га").alias("a"), N.labelled_value(text, "высота").alias("b"))
    return o.select("o_orderkey", F.col("a.value").alias("area"), F.col("a.unit").alias("unit"), F.col("b.value").alias("height"))


def resolved_codes(spark, d):
    s = W.load(spark, d, "supplier").select(F.col("s_nationkey").alias("block"), F.col("s_name").alias("name"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))).otherwise(F.lit("?")).alias("code"))
    known = W.load(spark, d, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_nationkey").alias("block"), F.concat(F.col("s_name"), F.lit("x")).alias("name"), F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("code"))
    return N.resolved_codes(s, known, "code", "name", "block").select("block", "name", "code", "resolved")


def repaired_tags(spark, d):
    read = W.load(spark, d, "customer").select(F.substring(F.md5(F.col("c_custkey").cast("string")), 1, 4).alias("tag"))
    known = W.load(spark, d, "supplier").select(F.substring(F.md5(F.col("s_suppkey").cast("string")), 1, 4).alias("tag"))
    return N.repaired(read, known, "tag", {"0": "8d", "8": "0b", "5": "6", "b": "8", "d": "0"})


def blocked_users(spark, d):
    return N.failures_in_window(W.load(spark, d, "events"), "user_id", "ts", F.col("event_type") == "error", 86_400, 3).select("event_id", "failures", "blocked")


def text_accuracy(spark, d):
    return N.edit_totals(_part(spark, d).withColumn("read", F.regexp_replace("p_name", "[aeo]", "")), ["p_brand"], "p_name", "read")


def metric_verdicts(spark, d):
    limits = W.load(spark, d, "region").select(F.concat(F.lit("m"), F.col("r_regionkey").cast("string")).alias("metric"), (F.col("r_regionkey") * 1000.0).alias("least"))
    metrics = W.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat(F.lit("m"), (F.col("c_nationkey") % 6).cast("string")).alias("metric"), F.when(F.col("c_custkey") % 9 > 0, F.col("c_acctbal")).alias("value"))
    return N.verdicts(metrics, limits, "k")


def nearest_parts_of_text(spark, d):
    """Errors of each brand in text that has it in small letters; tests/test_normalise.py holds the operator against brute force."""
    return _part(spark, d).select("p_partkey", N.semi_global(F.col("p_brand"), F.concat(F.lit("x"), F.col("p_name"), F.lit(" "), F.lower("p_brand"))).alias("errors"))


QUERIES = {f.__name__: f for f in (criticality_forms, value_texts, quantities, value_matches, parsed_codes, rendered_notes, match_keys, code_shapes, codes_in_text, strict_texts, wrapped_lines, spec_items, dwg_versions, fingerprints, time_ids, log_fields, tag_classes, cue_gates, labelled_values, resolved_codes, repaired_tags, blocked_users, text_accuracy, metric_verdicts, nearest_parts_of_text)}

_CODE = "CASE WHEN p_size BETWEEN 1 AND 20 THEN 'AR' WHEN p_size BETWEEN 21 AND 40 THEN 'KR' WHEN p_size BETWEEN 41 AND 60 THEN 'OV' END"
_LIKE = "regexp_matches(c, '[0-9]') AND length(c) >= 5 AND NOT contains(c, ' ') AND len(regexp_extract_all(c, '[-/.]')) >= 2 AND len(regexp_extract_all(c, '\\p{L}')) >= 2 AND len(regexp_extract_all(c, '\\p{Lu}')) * 2 >= len(regexp_extract_all(c, '\\p{L}')) AND NOT regexp_matches(c, '^[0-9.,/-]+\\p{L}{1,3}\\.?$')"

SQL = {
    "criticality_forms": "SELECT o_orderkey, lower(o_orderpriority) || ' x' AS light, regexp_extract(lower(o_orderpriority), '^([^ ]*)', 1) AS relaxed FROM orders",
    "value_texts": "SELECT l_orderkey, l_linenumber, printf('%.2f', l_extendedprice) || CASE WHEN l_linenumber % 2 = 0 THEN ' м²' ELSE ' м³' END AS value FROM lineitem",
    "quantities": "SELECT p_partkey, CASE WHEN p_size % 5 < 4 THEN 'length' END AS dimension, CASE p_size % 5 WHEN 0 THEN p_size + 0.5 WHEN 1 THEN (p_size + 0.5) * 10 WHEN 2 THEN (p_size + 0.5) * 1000 WHEN 3 THEN (p_size + 0.5) * 1000000 END::DOUBLE AS magnitude FROM part",
    "value_matches": "SELECT p_partkey, CASE WHEN p_partkey % 22 = 0 THEN 1 WHEN p_partkey % 11 = 0 OR p_partkey % 7 = 0 THEN 0 ELSE 1 END::DOUBLE AS score FROM part",
    "parsed_codes": f"""WITH c AS (SELECT p_partkey, p_size, ['AR', 'KR', 'OV', 'M', 'ZZ'][p_partkey % 5 + 1] AS prefix, {_CODE} AS own FROM part),
 k AS (SELECT *, prefix <> 'ZZ' AND own IS NOT NULL AS ok, own || '-' || lpad(CAST(p_size AS VARCHAR), 3, '0') AS canon, prefix || '–' || p_size AS raw FROM c)
 SELECT p_partkey, CASE WHEN ok THEN canon END AS canonical, CASE WHEN ok THEN prefix <> 'M' AND prefix <> own END AS mismatch, CASE WHEN ok AND (prefix = 'M' OR prefix = own) THEN canon ELSE raw END AS light, CASE WHEN ok THEN canon ELSE raw END AS relaxed FROM k""",
    "rendered_notes": """WITH v AS (SELECT c_custkey, c_name AS n, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS s, CASE WHEN c_acctbal < 0 THEN 'debt' END AS x FROM customer)
 SELECT c_custkey, 'Client ' || n || CASE WHEN s IS NULL THEN '' ELSE ' ' || s END || ',' || CASE WHEN x IS NULL THEN '' ELSE ' ' || x END || '.' AS plain,
 'Client ' || n || CASE WHEN s IS NULL AND x IS NULL THEN '' ELSE ' (' || concat_ws('; ', 'segment ' || s, 'has ' || x) || ')' END AS grouped FROM v""",
    "match_keys": rf"SELECT p_partkey, trim(regexp_replace(translate(lower(p_brand || '__' || p_name), '{N.LATIN.lower()}', '{N.CYRILLIC.lower()}'), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS key FROM part",
    "code_shapes": rf"WITH v AS (SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'AB-' || p_size || '/C.1' WHEN 1 THEN '20.03.' || p_size || 'г' ELSE p_brand END AS c FROM part) SELECT p_partkey, {_LIKE} AS looks, translate(regexp_replace(upper(c), '[\s/._-]+', '', 'g'), '{N.FOLD_FROM}', '{N.FOLD_TO}') AS key FROM v",
    "codes_in_text": rf"""WITH w AS (SELECT page_id, unnest(string_split_regex(upper(url), '[\s,;()«»"]+')) AS w FROM pages), v AS (SELECT page_id, regexp_replace(w, '[.:]+$', '') AS c FROM w) SELECT page_id, count(*) FILTER ({_LIKE}) AS n FROM v GROUP BY 1""",
    "strict_texts": r"SELECT doc_id, md5(translate(translate(regexp_replace(coalesce(text, ''), '\s+', '', 'g'), '∅⌀Ø', 'øøø'), 'x×', 'хх')) AS digest FROM documents",
    "wrapped_lines": "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a brandname ' WHEN 1 THEN 'a part-name ' ELSE 'whole line name ' END || p_brand AS line FROM part",
    "spec_items": "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'CABLE' WHEN p_size % 5 = 0 THEN 'PIPE' END AS kind, CASE WHEN p_size % 2 = 0 THEN 'ВВГНГ-LS 3×' WHEN p_size % 5 = 0 THEN 'труба стальная' END AS stem, CASE WHEN p_size % 2 = 0 THEN p_size + 0.5 WHEN p_size % 5 = 0 THEN p_size * 10 END::DOUBLE AS size FROM part",
    "dwg_versions": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'AC1032' WHEN 1 THEN 'AC1999' WHEN 2 THEN 'AC1015' END AS code, CASE p_size % 4 WHEN 0 THEN 'AutoCAD 2018+' WHEN 1 THEN 'unknown' WHEN 2 THEN 'AutoCAD 2000–2002' END AS release FROM part",
    "fingerprints": "SELECT doc_id, sha256(sha256(coalesce(text, '')) || ':' || CASE WHEN doc_id % 4 > 0 THEN sha256(source) ELSE '' END) AS fingerprint, substring(sha256(coalesce(text, '')), 1, 12) AS short FROM documents",
    "time_ids": "WITH v AS (SELECT event_id, lpad(lower(to_hex(epoch_us(ts) // 1000)), 12, '0') AS m, md5(CAST(event_id AS VARCHAR)) AS h FROM events) SELECT event_id, concat_ws('-', substring(m, 1, 8), substring(m, 9, 4), '7' || substring(h, 1, 3), '8' || substring(h, 4, 3), substring(h, 7, 12)) AS id FROM v",
    "log_fields": 'SELECT event_id, event_type AS stage, CAST(user_id AS VARCHAR) AS "user" FROM events',
    "tag_classes": "SELECT p_partkey, concat_ws('+', CASE WHEN regexp_matches(p_type, 'STEEL$|TIN$') THEN 'METAL' END, CASE WHEN p_type LIKE 'SMALL%' THEN 'SMALL' END, CASE WHEN regexp_matches(p_type, 'ANODIZED|PLATED') THEN 'COATED' END) AS families FROM part",
    "cue_gates": """WITH v AS (SELECT doc_id, coalesce(text, '') AS t, least(length(coalesce(text, '')), 200) AS a FROM documents), l AS (SELECT doc_id, reverse(substring(t, greatest(a - 80, 1), least(a - 1, 80))) AS r FROM v),
 n AS (SELECT doc_id, least(coalesce(nullif(instr(r, ' eht'), 0), 1000), coalesce(nullif(instr(r, ' ed'), 0), 1000)) AS yes, least(coalesce(nullif(instr(r, ' fo'), 0), 1000), coalesce(nullif(instr(r, ' al'), 0), 1000)) AS no FROM l) SELECT doc_id, yes < no AS accepted FROM n""",
    "labelled_values": "SELECT o_orderkey, round(o_totalprice, 2) AS area, 'м2' AS unit, CAST(NULL AS DOUBLE) AS height FROM orders",
    "resolved_codes": """WITH s AS (SELECT s_nationkey AS block, s_name AS name, CASE WHEN s_suppkey % 3 = 0 THEN 'S' || s_suppkey ELSE '?' END AS code FROM supplier), k AS (SELECT s_nationkey AS block, s_name || 'x' AS kname, 'S' || s_suppkey AS kcode FROM supplier WHERE s_suppkey % 2 = 0),
 p AS (SELECT s.block, s.name, kcode, 1 - levenshtein(name, kname) / greatest(length(name), length(kname)) AS score FROM (SELECT DISTINCT block, name FROM s WHERE code NOT IN (SELECT kcode FROM k)) s JOIN k USING (block)),
 b AS (SELECT block, name, kcode, row_number() OVER (PARTITION BY block, name ORDER BY score DESC, kcode) AS rn FROM p WHERE score >= 0.8)
 SELECT s.block, s.name, s.code, CASE WHEN s.code IN (SELECT kcode FROM k) THEN s.code ELSE b.kcode END AS resolved FROM s LEFT JOIN b ON s.block = b.block AND s.name = b.name AND rn = 1""",
    "repaired_tags": """WITH a AS (SELECT DISTINCT substring(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS tag FROM customer), b AS (SELECT DISTINCT substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 4) AS k FROM supplier), c(f, t) AS (VALUES ('0', '8'), ('0', 'd'), ('8', '0'), ('8', 'b'), ('5', '6'), ('b', '8'), ('d', '0')),
 m AS (SELECT DISTINCT tag, substring(tag, 1, i - 1) || t || substring(tag, i + 1) AS k FROM (SELECT tag, unnest(range(1, 5)) AS i FROM a WHERE tag NOT IN (FROM b)) JOIN c ON substring(tag, i, 1) = f)
 SELECT tag, min(k) AS repaired FROM m JOIN b USING (k) GROUP BY tag HAVING count(*) = 1""",
    "blocked_users": "WITH f AS (SELECT * FROM events WHERE event_type = 'error'), c AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW) AS failures FROM f) SELECT event_id, failures, failures >= 3 AS blocked FROM c",
    "text_accuracy": "WITH v AS (SELECT p_brand, levenshtein(p_name, regexp_replace(p_name, '[aeo]', '', 'g')) AS e, length(p_name) AS n FROM part) SELECT p_brand, CAST(sum(e) AS BIGINT) AS errors, CAST(sum(n) AS BIGINT) AS signs, round(1 - sum(e) / sum(n), 6) AS accuracy FROM v GROUP BY 1",
    "metric_verdicts": "WITH m AS (SELECT c_custkey AS k, 'm' || (c_nationkey % 6) AS metric, CASE WHEN c_custkey % 9 > 0 THEN c_acctbal END AS value FROM customer), l AS (SELECT 'm' || r_regionkey AS metric, r_regionkey * 1000.0 AS least FROM region) SELECT k, metric, value, CASE WHEN least IS NULL THEN 'NO_LIMIT' WHEN value IS NULL THEN 'NO_VALUE' WHEN value >= least THEN 'PASS' ELSE 'FAIL' END AS verdict FROM m LEFT JOIN l USING (metric)",
}
