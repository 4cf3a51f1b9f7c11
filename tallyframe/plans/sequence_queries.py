"""Queries on ordered rows, texts and rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as L
from ..functions import text as T
from ..operators import phrases as P
from ..operators import sequences as S
from ..operators import spatial as X
from . import views as W


def table_rows(spark, d):
    """Rows of a supplier's table in a total order; every 10th is a printed total."""
    from pyspark.sql import Window

    line = W.load(spark, d, "lineitem")
    n = F.row_number().over(Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity"))
    return line.select("l_suppkey", "l_quantity", n.cast("bigint").alias("n")).select(F.col("l_suppkey").alias("table_id"), "n", F.col("l_quantity").alias("area"), (F.col("n") % 10 == 0).alias("total"))


TABLE_ROWS = "t AS (SELECT l_suppkey AS table_id, l_quantity AS area, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n FROM lineitem), tr AS (SELECT *, n % 10 = 0 AS total FROM t)"


def sum_checks(spark, d):
    rows = table_rows(spark, d).withColumn("area", F.when(F.col("total"), F.col("area") * 9).otherwise(F.col("area")))
    out = S.sum_checks(rows, "table_id", ["n"], F.col("total"), "area", lambda n: T_AREA * F.sqrt(n))
    return out.select("table_id", "block", "n", F.col("sum"), "printed", "delta", "ok")


T_AREA = 20.0


def sum_blocks(spark, d):
    rows = table_rows(spark, d)
    out = S.sum_checks(rows, "table_id", ["n"], F.col("total"), "area")
    return out.groupBy("table_id").agg(F.count("*").alias("blocks"), F.sum("sum").alias("grand"), F.count_if("ok").alias("ok"))


def parent_child_sums(spark, d):
    orders, line = W.load(spark, d, "orders"), W.load(spark, d, "lineitem")
    parents = orders.select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") % 150).cast("double").alias("printed"))
    children = line.select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("q"))
    return S.parent_child_sums(parents, children, "k", "printed", "q", decimals=0).select("k", "printed", "children_sum", F.coalesce("children", F.lit(0)).cast("bigint").alias("children"), "ok")


def binder_segments(spark, d):
    out = S.segments(W.load(spark, d, "conversations"), "conv_id", "turn", "role", ("system",))
    return out.select("conv_id", "segment", "kind", "first_page", "last_page", "pages")


def continuation_chains(spark, d):
    c = W.load(spark, d, "conversations").withColumn("title", F.col("conv_id") % 3 + F.when(F.col("turn") >= 4, 1).otherwise(0))
    return S.chains(c, "conv_id", "turn", "title", F.col("role") != "assistant").select("conv_id", "turn", "chain")


def sheets(spark, d):
    """Pages with printed sheet numbers: unreadable on every fourth page, restarted in every third document."""
    c = W.load(spark, d, "conversations")
    sheet = F.when((F.col("turn") + F.col("conv_id")) % 4 == 0, None).otherwise(F.when((F.col("conv_id") % 3 == 0) & (F.col("turn") >= 4), F.col("turn") - 3).otherwise(F.col("turn") + 1))
    return c.select("conv_id", "turn", sheet.alias("sheet"))


SHEETS = "s AS (SELECT conv_id, turn, CASE WHEN (turn + conv_id) % 4 = 0 THEN NULL WHEN conv_id % 3 = 0 AND turn >= 4 THEN turn - 3 ELSE turn + 1 END AS sheet FROM conversations)"


def sheet_map_support(spark, d):
    return S.sequence_support(sheets(spark, d), "conv_id", "turn", "sheet", 2)


def sheet_map_smooth(spark, d):
    return S.sequence_smooth(sheets(spark, d), "conv_id", "turn", "sheet").select("conv_id", "turn", "smoothed")


def sheet_duplicates(spark, d):
    return S.duplicate_of(sheets(spark, d), "conv_id", "turn", "sheet").where("duplicate_of is not null").select("conv_id", "turn", "duplicate_of")


def code_fill(spark, d):
    c = W.load(spark, d, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 != 1, F.concat(F.lit("K"), (F.col("conv_id") % 5 + F.floor(F.col("turn") / 5)).cast("string"))).alias("code"))
    return S.code_fill(c, "conv_id", "turn", "code").select("conv_id", "turn", "filled")


def nearest_material(spark, d):
    c = W.load(spark, d, "conversations")
    marks = c.where("role = 'assistant'").select("conv_id", "turn", F.concat(F.lit("M"), F.col("turn").cast("string")).alias("material"))
    return S.nearest_before(marks, c.where("role = 'user'"), "conv_id", "turn", "material", 2)


def phrase_hits(spark, d):
    items = W.load(spark, d, "benchmark").select("item_id", "text")
    return P.phrase_hits(W.load(spark, d, "documents"), items, "doc_id", "item_id")


def absence_proof(spark, d):
    hits = phrase_hits(spark, d).groupBy("item_id").agg(F.sum("hits").alias("hits"))
    items = W.load(spark, d, "benchmark").select("item_id").join(hits, "item_id", "left")
    read, pages = F.when(F.col("item_id") % 2 == 0, 10).otherwise(9), F.lit(10)
    return items.select("item_id", P.presence(F.coalesce("hits", F.lit(0)), read, pages).alias("present"))


def topic_share(spark, d):
    docs = W.load(spark, d, "documents")
    return P.topic_share(docs, "source", F.coalesce(F.col("text").contains("tion"), F.lit(False)))


def lexicon_df(spark, d):
    docs = W.load(spark, d, "documents")
    text = docs.select("doc_id", F.regexp_replace(F.lower("text"), "[^a-z]+", " ").alias("text"))
    return P.document_frequency(text, "doc_id", "text", 20)


def text_stats(spark, d):
    return W.load(spark, d, "documents").select("doc_id", T.text_statistics(F.coalesce("text", F.lit(""))).alias("s")).select("doc_id", "s.*")


def mode_language(spark, d):
    return P.mode_of(W.load(spark, d, "documents"), ["source"], "lang").select("source", "lang", "n")


def number_parse(spark, d):
    """Prices as they are printed: groups of three, a comma; every tenth with a unit behind it."""
    line = W.load(spark, d, "lineitem")
    printed = F.translate(F.format_number("l_extendedprice", 2), ",.", " ,")
    rows = line.select("l_orderkey", "l_linenumber", F.when(F.col("l_orderkey") % 10 == 0, F.concat(printed, F.lit(" р."))).when(F.col("l_linenumber") == 2, F.concat(F.lit("−"), printed)).otherwise(printed).alias("raw"))
    return rows.select("l_orderkey", "l_linenumber", T.parse_number(F.col("raw")).alias("value"), T.decimals_of(F.col("raw")).alias("decimals"))


UNIT_NAMES = ("кв. м", "куб.м", " Га ", "м2", "штук")


def unit_norm(spark, d):
    names = F.array(*map(F.lit, UNIT_NAMES))
    return W.load(spark, d, "part").select("p_partkey", T.norm_unit(F.get(names, (F.col("p_size") % 5).cast("int"))).alias("unit"))


def code_key(spark, d):
    return W.load(spark, d, "part").select("p_partkey", T.code_key(F.concat_ws("-", "p_brand", "p_type")).alias("key"))


def natural_sort(spark, d):
    part = W.load(spark, d, "part").select("p_partkey", F.concat("p_brand", F.lit("."), F.col("p_size").cast("string")).alias("mark"))
    return S.global_order(part.withColumn("key", S.natural_key(F.col("mark"), 6)), F.col("key"), [F.col("p_partkey")]).select("mark", "key", "place")


def guarded_windows(spark, d):
    docs = W.load(spark, d, "documents").select("doc_id", T.text_windows(F.coalesce("text", F.lit("")), 2000, 200).alias("w"))
    return docs.select("doc_id", F.size("w").cast("bigint").alias("windows"), F.element_at("w", -1)["at"].alias("last"))


def parsed_dates(spark, d):
    o = W.load(spark, d, "orders")
    text = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("n/a")
    return o.select("o_orderkey", T.parse_date(text).alias("day"))


def week_starts(spark, d):
    return W.load(spark, d, "events").select("event_id", T.week_start(F.col("ts")).alias("week"), T.moscow_date(F.col("ts")).alias("day"))


RULE = {
    "applies": {"in": [{"var": "o_orderstatus"}, ["F", "O"]]},
    "condition": {"and": [{">": [{"var": "o_totalprice"}, 100000]}, {"or": [{"==": [{"var": "bal_sign"}, 1]}, {"var": "urgent"}]}]},
    "expected": {"if": [{"var": "urgent"}, {"<": [{"var": "o_totalprice"}, 250000]}, {">=": [{"var": "o_totalprice"}, 150000]}]},
}


def _facts(spark, d):
    o, c = W.load(spark, d, "orders"), W.load(spark, d, "customer")
    urgent = F.when(F.col("o_orderpriority").startswith("1"), True).when(F.col("o_orderpriority").startswith("5"), None).otherwise(False)
    sign = F.when(F.col("c_acctbal") > 5000, 1).when(F.col("c_acctbal") > 0, 0)
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select("o_orderkey", "o_orderstatus", "o_totalprice", urgent.alias("urgent"), sign.alias("bal_sign"))


_FACTS = "f AS (SELECT o_orderkey, o_orderstatus, o_totalprice, CASE WHEN o_orderpriority LIKE '1%' THEN true WHEN o_orderpriority LIKE '5%' THEN NULL ELSE false END AS urgent, CASE WHEN c_acctbal > 5000 THEN 1 WHEN c_acctbal > 0 THEN 0 END AS bal_sign FROM orders JOIN customer ON o_custkey = c_custkey)"


def rules_kleene(spark, d):
    facts = _facts(spark, d)
    return facts.select("o_orderkey", L.outcome(facts, RULE["applies"], RULE["condition"], RULE["expected"]).alias("outcome"))


def rule_outcomes(spark, d):
    return rules_kleene(spark, d).groupBy("outcome").agg(F.count("*").alias("n"))


EACH = {"some": [{"var": "lines"}, {"and": [{">": [{"var": "q"}, 45]}, {"<": [{"var": "x"}, 0.03]}]}]}
EVERY = {"all": [{"var": "lines"}, {">=": [{"var": "q"}, 3]}]}
TOTAL = {"sum": [{"filter": [{"var": "lines"}, {">": [{"var": "q"}, 40]}]}, {"var": "q"}]}


def rules_foreach(spark, d):
    line = W.load(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_quantity").alias("q"), F.when(F.col("l_linestatus") == "F", F.col("l_discount")).alias("x"))).alias("lines"))
    return line.select("l_orderkey", L.compile_rule(EACH, line).alias("some"), L.compile_rule(EVERY, line).alias("every"), L.compile_rule(TOTAL, line).alias("total"), L.compile_rule({"count": [{"var": "lines"}]}, line).alias("n"))


def boxes(spark, d):
    v = W.values(spark, d)
    x, y = (F.col("part") % 97) / 100.0, (F.col("file_id") % 89) / 100.0
    return v.select(F.col("supplier").alias("page"), F.concat_ws("-", *[F.col(c).cast("string") for c in ("file_id", "page_no", "part", "quantity", "value")]).alias("box_id"), F.array(x, y, x + F.col("quantity") / 500.0, y + 0.04).alias("box"), F.col("stage"))


def box_overlaps(spark, d):
    b = boxes(spark, d)
    out = X.overlapping(b.where("stage = 'PD'").select("page", F.col("box_id").alias("a"), F.col("box").alias("ba")), b.where("stage = 'RD'").select("page", F.col("box_id").alias("b"), F.col("box").alias("bb")), "page", "a", "b", "ba", "bb", 0.1)
    return out.select("page", "a", "b", F.round("iou", 6).alias("iou")).where("iou > 0.0001")


QUERIES = {f.__name__: f for f in (sum_checks, sum_blocks, parent_child_sums, binder_segments, continuation_chains, sheet_map_support, sheet_map_smooth, sheet_duplicates, code_fill, nearest_material, phrase_hits, absence_proof, topic_share, lexicon_df, text_stats, mode_language, number_parse, unit_norm, code_key, natural_sort, guarded_windows, parsed_dates, week_starts, rules_kleene, rule_outcomes, rules_foreach, box_overlaps)}

_BLOCKS = "b AS (SELECT table_id, n, area, total, coalesce(sum(CASE WHEN total THEN 1 ELSE 0 END) OVER (PARTITION BY table_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS block FROM tr)"
_HITS = r"""w AS (SELECT doc_id, generate_subscripts(x, 1) AS pos, unnest(x) AS word FROM (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS x FROM documents)),
 p AS (SELECT item_id, generate_subscripts(x, 1) AS k, unnest(x) AS word, len(x) AS size FROM (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS x FROM benchmark)),
 r AS (SELECT item_id, doc_id, pos - k AS s, any_value(size) AS size, count(*) AS n FROM w JOIN p USING (word) GROUP BY ALL), h AS (SELECT item_id, doc_id, count(*) AS hits FROM r WHERE n = size GROUP BY ALL)"""

SQL = {
    "sum_checks": f"WITH {TABLE_ROWS}, {_BLOCKS}, g AS (SELECT table_id, block, count(*) FILTER (NOT total) AS n, sum(area) FILTER (NOT total) AS \"sum\", max(area) FILTER (total) * 9 AS printed FROM b GROUP BY ALL HAVING max(area) FILTER (total) IS NOT NULL) SELECT table_id, CAST(block AS BIGINT) AS block, n, \"sum\", printed, coalesce(\"sum\", 0) - printed AS delta, abs(coalesce(\"sum\", 0) - printed) <= 20.0 * sqrt(n) AS ok FROM g",
    "sum_blocks": f"WITH {TABLE_ROWS}, {_BLOCKS}, g AS (SELECT table_id, block, count(*) FILTER (NOT total) AS n, sum(area) FILTER (NOT total) AS s, max(area) FILTER (total) AS printed FROM b GROUP BY ALL HAVING max(area) FILTER (total) IS NOT NULL) SELECT table_id, count(*) AS blocks, sum(s) AS grand, count(*) FILTER (abs(s - printed) <= 0.051 + 2 * 0.0289 * sqrt(n)) AS ok FROM g GROUP BY 1",
    "parent_child_sums": "WITH c AS (SELECT l_orderkey, sum(l_quantity) AS s, count(*) AS n FROM lineitem GROUP BY 1) SELECT o_orderkey AS k, CAST(o_orderkey % 150 AS DOUBLE) AS printed, s AS children_sum, coalesce(n, 0) AS children, coalesce(abs(coalesce(s, 0) - o_orderkey % 150) <= 0.5 * n, false) AS ok FROM orders LEFT JOIN c ON l_orderkey = o_orderkey",
    "binder_segments": """WITH o AS (SELECT conv_id, turn, role, CASE WHEN role <> 'system' THEN role END AS own FROM conversations), k AS (SELECT conv_id, turn, coalesce(last_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(own IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), role) AS kind FROM o),
 f AS (SELECT *, CASE WHEN lag(kind) OVER w IS NOT DISTINCT FROM kind AND row_number() OVER w > 1 THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS segment FROM f)
 SELECT conv_id, segment, min(kind) AS kind, min(turn) AS first_page, max(turn) AS last_page, count(*) AS pages FROM s GROUP BY ALL""",
    "continuation_chains": """WITH c AS (SELECT conv_id, turn, role, conv_id % 3 + CASE WHEN turn >= 4 THEN 1 ELSE 0 END AS title FROM conversations), f AS (SELECT *, CASE WHEN coalesce(lag(role) OVER w <> 'assistant' AND lag(title) OVER w = title AND turn - lag(turn) OVER w = 1, false) THEN 0 ELSE 1 END AS new FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
 SELECT conv_id, turn, CAST(sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS chain FROM f""",
    "sheet_map_support": f"WITH {SHEETS} SELECT conv_id, turn, sheet, CASE WHEN sheet IS NOT NULL THEN count(*) OVER (PARTITION BY conv_id, turn - sheet ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) - 1 END AS support FROM s",
    "sheet_map_smooth": f"""WITH {SHEETS}, n AS (SELECT *, last_value(CASE WHEN sheet IS NOT NULL THEN turn END IGNORE NULLS) OVER b AS bp, last_value(sheet IGNORE NULLS) OVER b AS bs, first_value(CASE WHEN sheet IS NOT NULL THEN turn END IGNORE NULLS) OVER a AS ap, first_value(sheet IGNORE NULLS) OVER a AS ax FROM s
 WINDOW b AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), a AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING))
 SELECT conv_id, turn, CASE WHEN sheet IS NOT NULL THEN sheet WHEN ap - bp = ax - bs THEN bs + turn - bp END AS smoothed FROM n""",
    "sheet_duplicates": f"WITH {SHEETS}, m AS (SELECT *, min(turn) OVER (PARTITION BY conv_id, sheet) AS f FROM s WHERE sheet IS NOT NULL) SELECT conv_id, turn, f AS duplicate_of FROM m WHERE f < turn",
    "code_fill": """WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 3 <> 1 THEN 'K' || CAST(conv_id % 5 + CAST(floor(turn / 5) AS BIGINT) AS VARCHAR) END AS code FROM conversations), n AS (SELECT *, last_value(code IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b, first_value(code IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS a FROM c)
 SELECT conv_id, turn, CASE WHEN code IS NOT NULL THEN code WHEN a = b THEN b END AS filled FROM n""",
    "nearest_material": "SELECT u.conv_id, u.turn, CASE WHEN u.turn - m.turn <= 2 THEN 'M' || m.turn END AS material FROM (FROM conversations WHERE role = 'user') u ASOF LEFT JOIN (FROM conversations WHERE role = 'assistant') m ON u.conv_id = m.conv_id AND u.turn >= m.turn",
    "phrase_hits": f"WITH {_HITS} SELECT item_id, doc_id, hits FROM h",
    "absence_proof": f"WITH {_HITS}, g AS (SELECT item_id, sum(hits) AS hits FROM h GROUP BY 1) SELECT b.item_id, CASE WHEN coalesce(hits, 0) > 0 THEN true WHEN b.item_id % 2 = 0 THEN false END AS present FROM benchmark b LEFT JOIN g USING (item_id)",
    "topic_share": "SELECT source, count(*) AS pages, round(avg(CAST(coalesce(contains(text, 'tion'), false) AS INTEGER)), 6) AS share FROM documents GROUP BY 1",
    "lexicon_df": "WITH w AS (SELECT DISTINCT doc_id, unnest(string_split(trim(regexp_replace(lower(text), '[^a-z]+', ' ', 'g')), ' ')) AS word FROM documents) SELECT word, count(*) AS files FROM w WHERE word <> '' GROUP BY 1 HAVING count(*) >= 20",
    "text_stats": "SELECT doc_id, length(coalesce(text, '')) AS n, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z]')) AS latin, len(regexp_extract_all(coalesce(text, ''), '[0-9]')) AS digits, CAST(len(string_split(coalesce(text, ''), chr(10))) AS BIGINT) AS lines FROM documents",
    "mode_language": "WITH c AS (SELECT source, lang, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT source, lang, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, lang) AS r FROM c) WHERE r = 1",
    "number_parse": "SELECT l_orderkey, l_linenumber, CASE WHEN l_orderkey % 10 = 0 THEN NULL WHEN l_linenumber = 2 THEN -round(l_extendedprice, 2) ELSE round(l_extendedprice, 2) END AS value, CAST(2 AS INTEGER) AS decimals FROM lineitem",
    "unit_norm": "SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'м²' WHEN 1 THEN 'м³' WHEN 2 THEN 'га' WHEN 3 THEN 'м²' END AS unit FROM part",
    "code_key": rf"SELECT p_partkey, translate(regexp_replace(upper(p_brand || '-' || p_type), '[\s._/\\-]+', '', 'g'), '{T.LATIN}', '{T.CYRILLIC}') AS key FROM part",
    "natural_sort": "WITH k AS (SELECT p_partkey, p_brand || '.' || p_size AS mark, regexp_extract(p_brand, '^([^0-9]*)', 1) || lpad(regexp_extract(p_brand, '([0-9]+)', 1), 6, '0') || '.' || lpad(CAST(p_size AS VARCHAR), 6, '0') AS key FROM part) SELECT mark, key, row_number() OVER (ORDER BY key, p_partkey) AS place FROM k",
    "guarded_windows": "SELECT doc_id, len(range(0, greatest(length(coalesce(text, '')) - 201, 0) + 1, 1800)) AS windows, CAST(greatest(length(coalesce(text, '')) - 201, 0) // 1800 * 1800 AS INTEGER) AS last FROM documents",
    "parsed_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) END AS day FROM orders",
    "week_starts": "SELECT event_id, CAST(date_trunc('week', ts) AS DATE) AS week, CAST(ts + INTERVAL 3 HOUR AS DATE) AS day FROM events",
    "rules_kleene": f"""WITH {_FACTS}, e AS (SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS a, o_totalprice > 100000 AND (bal_sign = 1 OR urgent) AS c, CASE WHEN urgent IS NULL THEN NULL WHEN urgent THEN o_totalprice < 250000 ELSE o_totalprice >= 150000 END AS x FROM f)
 SELECT o_orderkey, CASE WHEN a IS NULL OR c IS NULL THEN 'UNKNOWN' WHEN NOT a OR NOT c THEN 'NOT_APPLICABLE' WHEN x IS NULL THEN 'UNKNOWN' WHEN x THEN 'PASS' ELSE 'EMIT' END AS outcome FROM e""",
    "rule_outcomes": f"""WITH {_FACTS}, e AS (SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS a, o_totalprice > 100000 AND (bal_sign = 1 OR urgent) AS c, CASE WHEN urgent IS NULL THEN NULL WHEN urgent THEN o_totalprice < 250000 ELSE o_totalprice >= 150000 END AS x FROM f)
 SELECT CASE WHEN a IS NULL OR c IS NULL THEN 'UNKNOWN' WHEN NOT a OR NOT c THEN 'NOT_APPLICABLE' WHEN x IS NULL THEN 'UNKNOWN' WHEN x THEN 'PASS' ELSE 'EMIT' END AS outcome, count(*) AS n FROM e GROUP BY 1""",
    "rules_foreach": """WITH l AS (SELECT l_orderkey, l_quantity AS q, CASE WHEN l_linestatus = 'F' THEN l_discount END AS x FROM lineitem)
 SELECT l_orderkey, bool_or(coalesce(q > 45 AND x < 0.03, false)) OR CASE WHEN bool_or(q > 45 AND x IS NULL) THEN NULL ELSE false END AS some, bool_and(q >= 3) AS every, coalesce(sum(q) FILTER (q > 40), 0) AS total, count(*) AS n FROM l GROUP BY 1""",
    "box_overlaps": f"""WITH {W.VALUES}, b AS (SELECT supplier AS page, concat_ws('-', file_id, page_no, part, quantity, value) AS id, (part % 97) / 100.0 AS x0, (file_id % 89) / 100.0 AS y0, (part % 97) / 100.0 + quantity / 500.0 AS x1, (file_id % 89) / 100.0 + 0.04 AS y1, stage FROM ev),
 p AS (SELECT a.page, a.id AS a, c.id AS b, greatest(least(a.x1, c.x1) - greatest(a.x0, c.x0), 0) * greatest(least(a.y1, c.y1) - greatest(a.y0, c.y0), 0) AS i, (a.x1 - a.x0) * (a.y1 - a.y0) + (c.x1 - c.x0) * (c.y1 - c.y0) AS u FROM b a JOIN b c ON a.page = c.page AND a.stage = 'PD' AND c.stage = 'RD')
 SELECT page, a, b, round(i / (u - i), 6) AS iou FROM p WHERE i > 0 AND round(i / (u - i), 6) > 0.0001""",
}
