"""Queries on values and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as G
from ..operators import sequences as S
from ..operators import values as V
from . import views as W

KEY = ["param_code", "location"]


def best_values(spark, d):
    return W.best(spark, d).select(*KEY, "stage", "value", "confidence", "file_id", "page_no")


def compare_values(spark, d):
    return W.diffs(spark, d)


def candidate_sets(spark, d):
    order = [F.desc("confidence"), F.col("file_id"), F.col("page_no"), F.col("value"), F.col("supplier")]
    return V.compare_sets(W.values(spark, d).where("quality = 'OK'"), KEY, W.AXES, order, relative=0.001)


def dedupe_axis(spark, d):
    kept, context = G.dedupe_by_axis(W.diffs(spark, d).where("result = 'VIOLATION'"), KEY, ["PD_ID", "RD_ID", "PD_RD"])
    return kept.select(*KEY, "axis", "confidence", F.lit("KEPT").alias("role")).unionByName(context.select(*KEY, "axis", "confidence", F.lit("CONTEXT").alias("role")))


def catalog(spark, d):
    return W.load(spark, d, "part").select(F.col("p_brand").alias("param_code")).distinct().withColumn("number", F.regexp_extract("param_code", r"([0-9]+)", 1).cast("int"))


CATALOG = "catalog AS (SELECT DISTINCT p_brand AS param_code, CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER) AS number FROM part)"


def precedence_rows(spark, d):
    facts = W.values(spark, d).groupBy("param_code").agg(F.collect_set("stage").alias("stages"), F.count_if(F.col("quality") == "OK").alias("readable"))
    bad = W.diffs(spark, d).where("result = 'VIOLATION'").groupBy("param_code").agg(F.count("*").alias("violations"))
    rows = catalog(spark, d).join(facts, "param_code", "left").join(bad, "param_code", "left")
    have, n = F.coalesce("stages", F.array().cast("array<string>")), F.coalesce("violations", F.lit(0))
    status = G.precedence(F.col("number") % 11 != 0, G.sufficient(have, [["PD", "RD"], ["RD", "ID"]]), n > 6, ~F.array_contains(have, "ID"), F.coalesce("readable", F.lit(0)) == 0, n < 5)
    return rows.select("param_code", status.alias("status"), G.document_status(have).alias("documents"), n.alias("violations"))


def finding_groups(spark, d):
    bad = W.diffs(spark, d).where("result <> 'EQUAL'")
    groups = G.finding_groups(bad, ["axis", "param_code", "result"], "location", ["axis", "param_code", "result"])
    return G.atomic(groups, name="location").select("axis", "param_code", "result", "location", "confidence", F.col("card").cast("bigint").alias("card"))


def verified_minus_violated(spark, d):
    all_ = W.diffs(spark, d)
    return all_.select("param_code", "axis").distinct().exceptAll(all_.where("result = 'VIOLATION'").select("param_code", "axis").distinct())


def status_rollup(spark, d):
    return W.diffs(spark, d).rollup("axis", "result").agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def status_cube(spark, d):
    return W.diffs(spark, d).cube("axis", "result").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def ambiguity_dominant(spark, d):
    out = V.dominant(W.values(spark, d), ["param_code", "stage"], "quantity")
    return out.select("param_code", "stage", "quantity", "n", "runner_up", "dominates")


def agreed_readings(spark, d):
    return V.agreed_across_stages(W.values(spark, d), KEY, "quantity", least=3)


def value_conflicts(spark, d):
    return V.value_conflicts(W.values(spark, d), ["part", "location", "stage"], "quantity")


def value_clusters(spark, d):
    rows = W.best(spark, d).select("param_code", "location", "stage", "value", "file_id")
    out = V.clusters(rows, ["param_code"], ["file_id", "location", "stage"], "value", 0.05, "param_code string, location int, stage string, value double, file_id bigint, cluster int")
    return out.groupBy("param_code").agg(F.max("cluster").alias("clusters"), F.count("*").alias("n"))


def materials_minmax(spark, d):
    return V.stage_extremes(W.values(spark, d).withColumn("rank", F.struct("size", "type", "part")), KEY + ["supplier"], "RD", "ID", "PD", "rank", "size").select(*KEY, "supplier", "expected", "actual", "result")


def tolerance_breaches(spark, d):
    rows = W.values(spark, d)
    out = V.tolerance_breaches(rows, ["file_id"], F.col("tax"), F.col("discount"), "param_code", least=2)
    return out.select("param_code", "file_id", "tolerance", F.col("breaches").cast("bigint").alias("breaches"), "worst", F.round("ratio", 6).alias("ratio"))


def spec_decrease(spark, d):
    return V.spec_decrease(W.values(spark, d), ["param_code", "supplier"], "quantity", "stage", "PD", "ID")


def spec_counts(spark, d):
    return V.spec_counts(W.values(spark, d), ["part", "location"], "file_id", "stage", F.col("quantity"), "PD", "ID")


def room_outcomes(spark, d):
    rows = W.values(spark, d).withColumns({"room": F.col("part") % 50, "label": F.concat(F.lit("L"), (F.col("quantity") % 9).cast("string"))})
    return V.room_outcomes(rows, "room", "label", "supplier", "stage", "PD", "ID").withColumns({"missing": F.col("missing").cast("bigint"), "extra": F.col("extra").cast("bigint")})


def anchor_pages(spark, d):
    pages = W.values(spark, d)
    out = G.anchor_page(pages, ["param_code", "stage"], [F.when(F.col("quality") == "OK", 0).otherwise(1), F.desc("confidence"), F.col("page_no"), F.col("file_id"), F.col("value"), F.col("supplier")])
    return out.select("param_code", "stage", "file_id", "page_no")


def hedge_budget(spark, d):
    rows = W.diffs(spark, d).select("param_code", F.concat_ws("|", "axis", F.col("location").cast("string")).alias("finding"), "confidence", (F.col("result") == "EQUAL").alias("hedge"))
    return G.hedge_budget(rows, "param_code", "confidence", "finding", "hedge").groupBy("param_code").agg(F.count_if(F.col("accepted") & F.col("hedge")).alias("hedges"), F.count_if(~F.col("hedge")).alias("firm"))


def suspicion_merge(spark, d):
    rows = W.values(spark, d).select("param_code", "location", "confidence", "value", F.array("file_id").alias("files"))
    out = G.merge_suspicions(rows.withColumn("high", F.col("value")), KEY, "files", "confidence", "value", "high")
    return out.select(*KEY, "confidence", F.col("value").alias("low"), "high", "merged", F.size("files").alias("files"), F.element_at("files", 1).alias("first_file"))


def integrity_rules(spark, d):
    line, orders = W.load(spark, d, "lineitem"), W.load(spark, d, "orders")
    checks = [
        ("R1_DISCOUNT", line.where("l_discount > 0.09")),
        ("R2_SHIPPED_BEFORE_ORDER", line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).where("l_shipdate < o_orderdate")),
        ("R3_UNKNOWN_ORDER", line.join(orders, line["l_orderkey"] == orders["o_orderkey"], "left_anti")),
        ("R4_REPEATED_LINE", line.groupBy("l_orderkey", "l_linenumber").count().where("count > 1")),
        ("R5_NO_LINES", orders.join(line, line["l_orderkey"] == orders["o_orderkey"], "left_anti").withColumnRenamed("o_orderkey", "l_orderkey")),
    ]
    return G.rule_summary(G.violation_union(checks, "l_orderkey"), [n for n, _ in checks])


def status_pivot(spark, d):
    return W.diffs(spark, d).groupBy("param_code").pivot("result", ["EQUAL", "IMPROVEMENT", "VIOLATION"]).agg(F.count(F.lit(1))).na.fill(0)


def sequential_cards(spark, d):
    rows = W.diffs(spark, d).where("result = 'VIOLATION'")
    return S.queue_order(rows, ["axis"], [F.col("param_code"), F.col("location")], "card").select("axis", "param_code", "location", F.col("card").cast("bigint").alias("card"))


QUERIES = {f.__name__: f for f in (best_values, compare_values, candidate_sets, dedupe_axis, precedence_rows, finding_groups, verified_minus_violated, status_rollup, status_cube, ambiguity_dominant, agreed_readings, value_conflicts, value_clusters, materials_minmax, tolerance_breaches, spec_decrease, spec_counts, room_outcomes, anchor_pages, hedge_budget, suspicion_merge, integrity_rules, status_pivot, sequential_cards)}

SQL = {
    "best_values": f"WITH {W.BEST} SELECT param_code, location, stage, value, confidence, file_id, page_no FROM best",
    "compare_values": f"WITH {W.BEST} SELECT * FROM diff",
    "candidate_sets": f"""WITH {W.VALUES}, r AS (SELECT *, row_number() OVER (PARTITION BY param_code, location, stage ORDER BY confidence DESC, file_id, page_no, value, supplier) AS k FROM ev WHERE quality = 'OK'), c AS (FROM r WHERE k <= 8),
 axes(axis, a, b) AS (VALUES ('PD_RD', 'PD', 'RD'), ('RD_ID', 'RD', 'ID'), ('PD_ID', 'PD', 'ID')),
 p AS (SELECT e.param_code, e.location, axis, e.value AS expected, f.value AS actual, e.k AS i, f.k AS j, least(e.confidence, f.confidence) AS sure, max(e.k) OVER w AS n_expected, max(f.k) OVER w AS n_actual,
 CASE WHEN abs(f.value - e.value) <= abs(e.value) * 0.001 THEN 'EQUAL' WHEN f.value < e.value THEN 'VIOLATION' ELSE 'IMPROVEMENT' END AS result
 FROM axes JOIN c e ON e.stage = a JOIN c f ON f.stage = b AND f.param_code = e.param_code AND f.location = e.location WINDOW w AS (PARTITION BY e.param_code, e.location, axis)),
 o AS (SELECT *, row_number() OVER (PARTITION BY param_code, location, axis ORDER BY CASE result WHEN 'EQUAL' THEN 0 WHEN 'IMPROVEMENT' THEN 1 ELSE 2 END, abs(actual - expected), -sure, i, j) AS rn FROM p)
 SELECT param_code, location, axis, CAST(n_expected AS INTEGER) AS n_expected, CAST(n_actual AS INTEGER) AS n_actual, expected, actual, result FROM o WHERE rn = 1""",
    "dedupe_axis": f"""WITH {W.BEST} SELECT param_code, location, axis, confidence, CASE WHEN row_number() OVER (PARTITION BY param_code, location ORDER BY CASE axis WHEN 'PD_ID' THEN 0 WHEN 'RD_ID' THEN 1 ELSE 2 END, confidence DESC) = 1 THEN 'KEPT' ELSE 'CONTEXT' END AS role FROM diff WHERE result = 'VIOLATION'""",
    "precedence_rows": f"""WITH {W.BEST}, {CATALOG}, facts AS (SELECT param_code, list(DISTINCT stage) AS stages, count(*) FILTER (quality = 'OK') AS readable FROM ev GROUP BY 1),
 bad AS (SELECT param_code, count(*) AS violations FROM diff WHERE result = 'VIOLATION' GROUP BY 1),
 r AS (SELECT param_code, number, coalesce(stages, []) AS s, coalesce(readable, 0) AS readable, coalesce(violations, 0) AS violations FROM catalog LEFT JOIN facts USING (param_code) LEFT JOIN bad USING (param_code)),
 m AS (SELECT *, concat_ws('_', CASE WHEN list_contains(s, 'PD') THEN 'PD' END, CASE WHEN list_contains(s, 'RD') THEN 'RD' END, CASE WHEN list_contains(s, 'ID') THEN 'ID' END) AS have, concat_ws('_', CASE WHEN NOT list_contains(s, 'PD') THEN 'PD' END, CASE WHEN NOT list_contains(s, 'RD') THEN 'RD' END, CASE WHEN NOT list_contains(s, 'ID') THEN 'ID' END) AS lack FROM r)
 SELECT param_code, CASE WHEN number % 11 = 0 THEN 'DEACTIVATED' WHEN violations > 6 THEN 'VIOLATED' WHEN NOT (list_has_all(s, ['PD', 'RD']) OR list_has_all(s, ['RD', 'ID'])) THEN 'INSUFFICIENT_DOCUMENTS' WHEN NOT list_contains(s, 'ID') THEN 'MISSING_DOCUMENT' WHEN readable = 0 THEN 'UNREADABLE' WHEN violations < 5 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status,
 concat(CASE WHEN have <> '' THEN have || '_AVAILABLE' ELSE '' END, CASE WHEN lack <> '' AND have <> '' THEN '_' || lack || '_MISSING' WHEN lack <> '' THEN lack || '_MISSING' ELSE '' END) AS documents, violations FROM m""",
    "finding_groups": f"""WITH {W.BEST}, g AS (SELECT axis, param_code, result, list(DISTINCT location) AS members, round(min(confidence), 3) AS confidence FROM diff WHERE result <> 'EQUAL' GROUP BY ALL),
 n AS (SELECT *, row_number() OVER (ORDER BY axis, param_code, result) AS card FROM g) SELECT axis, param_code, result, unnest(members) AS location, confidence, card FROM n""",
    "verified_minus_violated": f"WITH {W.BEST} SELECT DISTINCT param_code, axis FROM diff EXCEPT SELECT param_code, axis FROM diff WHERE result = 'VIOLATION'",
    "status_rollup": f"WITH {W.BEST} SELECT axis, result, count(*) AS n, CAST(grouping(axis, result) AS BIGINT) AS level FROM diff GROUP BY ROLLUP (axis, result)",
    "status_cube": f"WITH {W.BEST} SELECT axis, result, count(*) AS n, round(avg(confidence), 6) AS confidence FROM diff GROUP BY CUBE (axis, result)",
    "ambiguity_dominant": f"""WITH {W.VALUES}, c AS (SELECT param_code, stage, quantity, count(*) AS n FROM ev GROUP BY ALL),
 r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(n) OVER w, 0) AS runner_up FROM c WINDOW w AS (PARTITION BY param_code, stage ORDER BY n DESC, quantity))
 SELECT param_code, stage, quantity, n, runner_up, n >= 3 AND n >= 2 * runner_up AS dominates FROM r WHERE rn = 1""",
    "agreed_readings": f"WITH {W.VALUES} SELECT param_code, location, quantity, count(DISTINCT stage) AS stages FROM ev GROUP BY ALL HAVING count(DISTINCT stage) >= 3",
    "value_conflicts": f"""WITH {W.VALUES}, s AS (SELECT part, location, stage, quantity AS v, list(DISTINCT file_id) AS f FROM ev GROUP BY ALL),
 k AS (SELECT part, location, stage, min(v) AS low, max(v) AS high, CAST(count(*) AS INTEGER) AS n_values, CAST(len(list_distinct(flatten(list(f)))) AS INTEGER) AS n_files FROM s GROUP BY ALL HAVING count(*) BETWEEN 2 AND 4),
 p AS (SELECT DISTINCT a.part, a.location, a.stage FROM s a JOIN s b ON a.part = b.part AND a.location = b.location AND a.stage = b.stage AND a.v <> b.v WHERE NOT list_has_all(b.f, a.f) AND NOT list_has_all(a.f, b.f))
 SELECT k.* FROM k SEMI JOIN p USING (part, location, stage) WHERE n_files >= 2""",
    "materials_minmax": f"""WITH {W.VALUES}, x AS (SELECT param_code, location, supplier, min(size) FILTER (stage = 'PD') AS pd, min(size) FILTER (stage = 'RD') AS rd, min(size) FILTER (stage = 'ID') AS id,
 min((size, type, part)) FILTER (stage = 'PD') AS pr, min((size, type, part)) FILTER (stage = 'RD') AS rr, min((size, type, part)) FILTER (stage = 'ID') AS ir FROM ev GROUP BY ALL)
 SELECT param_code, location, supplier, coalesce(rd, pd) AS expected, id AS actual, CASE WHEN coalesce(rr, pr) IS NULL OR ir IS NULL THEN 'ABSTAIN' WHEN ir < coalesce(rr, pr) THEN 'CLASS_DOWNGRADED' WHEN ir = coalesce(rr, pr) THEN 'EQUAL' ELSE 'CLASS_UPGRADED' END AS result FROM x""",
    "tolerance_breaches": f"""WITH {W.VALUES}, t AS (SELECT param_code, file_id, max(tax) AS tolerance, max(discount) AS worst, list(discount) AS ds FROM ev GROUP BY ALL),
 p AS (SELECT *, CAST(len(list_filter(ds, lambda x: x > tolerance)) AS BIGINT) AS breaches, worst / tolerance AS ratio FROM t WHERE tolerance > 0),
 r AS (SELECT *, row_number() OVER (PARTITION BY param_code ORDER BY ratio DESC, file_id) AS rn FROM p WHERE breaches >= 2 OR ratio >= 2.0)
 SELECT param_code, file_id, tolerance, breaches, worst, round(ratio, 6) AS ratio FROM r WHERE rn = 1""",
    "spec_decrease": f"""WITH {W.VALUES}, w AS (SELECT param_code, supplier, max(quantity) AS expected FROM ev WHERE stage = 'PD' GROUP BY ALL), g AS (SELECT param_code, supplier, max(quantity) AS actual FROM ev WHERE stage = 'ID' GROUP BY ALL)
 SELECT param_code, supplier, expected, actual FROM w JOIN g USING (param_code, supplier) WHERE actual < expected AND NOT EXISTS (SELECT 1 FROM ev e WHERE e.stage = 'ID' AND e.param_code = w.param_code AND e.supplier = w.supplier AND e.quantity = w.expected)""",
    "spec_counts": f"""WITH {W.VALUES}, s AS (SELECT part, location, stage, count(DISTINCT file_id) AS f, CAST(sum(quantity) AS BIGINT) AS n FROM ev GROUP BY ALL)
 SELECT a.part, a.location, a.n AS expected, b.n AS actual FROM s a JOIN s b USING (part, location) WHERE a.stage = 'PD' AND b.stage = 'ID' AND a.f = 1 AND b.f = 1 AND b.n < a.n""",
    "room_outcomes": f"""WITH {W.VALUES}, p AS (SELECT stage, part % 50 AS room, 'L' || (quantity % 9) AS label, supplier, count(*) AS n FROM ev GROUP BY ALL), u AS (SELECT stage, room, label, max(n) AS n FROM p GROUP BY ALL),
 j AS (SELECT coalesce(a.room, b.room) AS room, coalesce(a.label, b.label) AS label, coalesce(a.n, 0) AS ne, coalesce(b.n, 0) AS na FROM (FROM u WHERE stage = 'PD') a FULL JOIN (FROM u WHERE stage = 'ID') b ON a.room = b.room AND a.label = b.label),
 k AS (SELECT *, EXISTS (SELECT 1 FROM u WHERE u.stage = 'ID' AND u.label = j.label AND u.room <> j.room) AS found FROM j),
 o AS (SELECT room, CAST(sum(greatest(ne - na, 0)) AS BIGINT) AS missing, CAST(sum(greatest(na - ne, 0)) AS BIGINT) AS extra, bool_and(ne <= na OR found) AS moved FROM k GROUP BY 1)
 SELECT room, missing, extra, CASE WHEN missing = 0 AND extra = 0 THEN 'EQUAL' WHEN missing > 0 AND moved THEN 'RELOCATED' WHEN extra = 0 THEN 'MISSING' WHEN missing = 0 THEN 'EXTRA' ELSE 'CHANGED' END AS result FROM o""",
    "anchor_pages": f"WITH {W.VALUES} SELECT param_code, stage, file_id, page_no FROM (SELECT *, row_number() OVER (PARTITION BY param_code, stage ORDER BY CASE quality WHEN 'OK' THEN 0 ELSE 1 END, confidence DESC, page_no, file_id, value, supplier) AS rn FROM ev) WHERE rn = 1",
    "suspicion_merge": f"WITH {W.VALUES} SELECT param_code, location, max(confidence) AS confidence, min(value) AS low, max(value) AS high, count(*) AS merged, CAST(count(DISTINCT file_id) AS INTEGER) AS files, min(file_id) AS first_file FROM ev GROUP BY ALL",
    "integrity_rules": """WITH v AS (SELECT 'R1_DISCOUNT' AS rule FROM lineitem WHERE l_discount > 0.09 UNION ALL SELECT 'R2_SHIPPED_BEFORE_ORDER' FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate
 UNION ALL SELECT 'R3_UNKNOWN_ORDER' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'R4_REPEATED_LINE' FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'R5_NO_LINES' FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)),
 r(rule) AS (VALUES ('R1_DISCOUNT'), ('R2_SHIPPED_BEFORE_ORDER'), ('R3_UNKNOWN_ORDER'), ('R4_REPEATED_LINE'), ('R5_NO_LINES')) SELECT r.rule, count(v.rule) AS violations, count(v.rule) = 0 AS passed FROM r LEFT JOIN v USING (rule) GROUP BY 1""",
    "status_pivot": f"""WITH {W.BEST} SELECT param_code, count(*) FILTER (result = 'EQUAL') AS "EQUAL", count(*) FILTER (result = 'IMPROVEMENT') AS "IMPROVEMENT", count(*) FILTER (result = 'VIOLATION') AS "VIOLATION" FROM diff GROUP BY 1""",
    "sequential_cards": f"WITH {W.BEST} SELECT axis, param_code, location, row_number() OVER (PARTITION BY axis ORDER BY param_code, location) AS card FROM diff WHERE result = 'VIOLATION'",
}
