"""Queries of scoring, reports, monitoring and merging."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import scoring as C
from ..streaming import batch as B
from . import views as W



def score_detection(spark, d):
    return C.prf(C.confusion(W.judged(spark, d), ["lang"], F.col("gold"), F.col("predicted")))


def score_pooled(spark, d):
    return C.prf(C.confusion(W.judged(spark, d).withColumn("all", F.lit("all")), ["all"], F.col("gold"), F.col("predicted")))


def score_keys(spark, d):
    j = W.judged(spark, d)
    key = F.floor(F.col("n_chars") / 50).alias("size_class")
    return C.prf(C.detection(j.where("gold").select("source", key), j.where("predicted").select("source", key), ["source", "size_class"]))


def score_group(spark, d):
    j = W.judged(spark, d)
    out = C.group_detection(j.where("not gold").select("source", "lang", "doc_id"), j.where("not predicted").select("doc_id"), "source", ["doc_id"], 0.5)
    return out.select("source", "size", "hits", "found")


def score_k4(spark, d):
    """True only with a shared evidence page."""
    j = W.judged(spark, d).withColumns({"pages": F.array(F.col("n_chars") % 3, F.col("n_chars") % 5), "found": F.array(F.col("doc_id") % 3, F.col("doc_id") % 5)})
    return C.prf(C.confusion(j.withColumn("_hit", F.col("predicted") & F.arrays_overlap("pages", "found")), ["lang"], F.col("gold"), F.col("_hit")))


def score_localisation(spark, d):
    j = W.judged(spark, d)
    gold = j.select("doc_id", F.array_distinct(F.array(F.col("n_chars") % 3, F.col("n_chars") % 7, F.col("n_chars") % 5)).alias("pages"))
    found = j.where("predicted").select("doc_id", F.array_distinct(F.array(F.col("doc_id") % 3, F.col("doc_id") % 7)).alias("pages"))
    return C.localisation(gold, found, "doc_id", "pages")


def score_values(spark, d):
    j = W.judged(spark, d)
    status = F.when(F.col("gold") == F.col("predicted"), 1.0).otherwise(0.0)
    return j.groupBy("lang").agg(F.round(F.avg(0.5 * status + 0.25 * F.col("critical").cast("int") + 0.25 * (F.col("n_chars") > 1000).cast("int")), 6).alias("score"))


def score_gate(spark, d):
    j = W.judged(spark, d)
    out = j.groupBy("source").agg(F.round(100 * F.avg((F.col("gold") == F.col("predicted")).cast("double")), 4).alias("raw"), F.bool_or(F.col("critical") & (F.col("gold") != F.col("predicted"))).alias("missed"))
    return out.select("source", "raw", C.gate(F.col("raw"), F.col("missed")).alias("total"))


def score_breakdown(spark, d):
    j = W.judged(spark, d).withColumn("criticality", F.when(F.col("critical"), "HIGH").otherwise("LOW"))
    return C.breakdown(j, ["lang", "criticality", "source"], F.col("gold"), F.col("predicted"))


def score_sensitivity(spark, d):
    """F1 at each of six thresholds: the settings are exploded beside each row and counted in one aggregation."""
    j = W.judged(spark, d)
    marked = j.select("gold", "n_chars", F.explode(F.array(*[F.lit(x) for x in (200, 400, 800, 1600, 3200, 6400)])).alias("threshold"))
    return C.prf(C.confusion(marked, ["threshold"], F.col("gold"), F.col("n_chars") >= F.col("threshold")))


def kappa(spark, d):
    return C.kappa(W.judged(spark, d), "gold", "predicted")


def wilson(spark, d):
    n = W.judged(spark, d).groupBy("lang").agg(F.count_if("gold").alias("k"), F.count("*").alias("n"))
    low, high = C.wilson(F.col("k"), F.col("n"))
    return n.select("lang", "k", "n", F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))


def stratified_sample(spark, d):
    return C.stratified_sample(W.judged(spark, d), "lang", "doc_id", 60, "s7").select("lang", "doc_id")


def leave_one_out(spark, d):
    s = W.judged(spark, d).groupBy("lang", "source").agg(F.round(F.avg((F.col("gold") == F.col("predicted")).cast("double")), 6).alias("score"))
    return C.leave_one_out(s, "source", "lang", "score").select("lang", "source", "score", F.round("mean_others", 6).alias("mean_others"))


def bootstrap_f1(spark, d):
    return C.bootstrap_f1(C.confusion(W.judged(spark, d), ["source"], F.col("gold"), F.col("predicted")), "source", 200, 1)




def _c():
    return F.col("decision") == "CONFIRMED_VIOLATION", F.col("decision") == "NEGATIVE_VERIFIED"


def latest_decisions(spark, d):
    return R.latest_per_key(W.decisions(spark, d), ["check_id"], [F.desc("ts"), F.desc("event_id")]).select("check_id", "decision", "ts")


def weekly_report(spark, d):
    return R.precision_report(W.decisions(spark, d), ["object_id", "reason_code"], *_c())


def weekly_trend(spark, d):
    return R.weekly_trend(W.decisions(spark, d), "ts", "2023-12-25", 8, *_c())


def reject_reasons(spark, d):
    out = R.shares(W.decisions(spark, d).where("decision = 'NEGATIVE_VERIFIED'"), "reason_code")
    return out.select("reason_code", "n", "share", F.col("place").cast("bigint").alias("place"))


def recommendations(spark, d):
    days = W.decisions(spark, d).withColumn("day", F.date_format("ts", "yyyyMMdd").cast("bigint") * 1000 + F.col("check_id") % 40)
    return R.recommendations(R.precision_report(days, ["day"], *_c()), "day")


def group_status(spark, d):
    return R.group_status(latest_decisions(spark, d).withColumn("group_id", (F.col("check_id") % 40).cast("int")), ["group_id"])


def indicator(spark, d):
    latest = latest_decisions(spark, d).withColumn("object_id", (F.col("check_id") % 30).cast("int"))
    c, r = _c()
    n = latest.groupBy("object_id").agg(F.count_if(c).alias("confirmed"), F.count_if(F.col("decision") == "REVERT_TO_PENDING").alias("pending"), F.count_if(r).alias("rejected"))
    return n.withColumn("colour", R.indicator(F.col("confirmed") - 1, F.col("pending"), F.col("rejected")))


def dashboard_tiles(spark, d):
    return R.tiles(indicator(spark, d), "colour")


def section_summary(spark, d):
    out = indicator(spark, d).where("colour = 'RED'").groupBy((F.col("object_id") % 3).cast("int").alias("section")).agg(F.sum("confirmed").alias("confirmed"), F.sum("pending").alias("pending"))
    return out.unionByName(indicator(spark, d).agg(F.lit(-1).alias("section"), F.sum("confirmed").alias("confirmed"), F.sum("pending").alias("pending")))


def latency_window(spark, d):
    e = W.load(spark, d, "events")
    out = R.latency_windows(e, "ts", "value", F.col("event_type") == "error", "60 minutes", "30 minutes")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "n", "errors", "p50", "p95")


def latency_histogram(spark, d):
    return R.histogram(W.load(spark, d, "events"), "value", [1, 2, 5, 10, 25, 50, 100, 250, 500, 1000])


def usability(spark, d):
    return R.usability(W.load(spark, d, "events"), ["event_type"], "value", 20.0)


def alerts(spark, d):
    hours = W.load(spark, d, "events").groupBy(F.date_trunc("day", "ts").cast("date").alias("day")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.max("value").alias("worst"))
    return R.alerts(hours, [("MANY_ERRORS", F.col("errors") * 4 > F.col("n")), ("SLOW", F.col("worst") > 150), ("QUIET", F.col("n") < 320)], "day")


def merge_run(spark, d):
    """Customers as the target, parts of the same numbers (100 further on) as the run to merge."""
    sha = lambda c: F.md5(c.cast("string")).alias("sha")
    target = W.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), sha(F.col("c_nationkey") % 3), (F.col("c_custkey") % 3).cast("int").alias("row_version"))
    source = W.load(spark, d, "part").select((F.col("p_partkey") + 100).alias("k"), sha(F.col("p_size") % 3))
    return R.merge(target, source, "k", "sha")


def merge_counts(spark, d):
    return merge_run(spark, d).groupBy("action").agg(F.count("*").alias("n"))


def retention_purge(spark, d):
    e = W.load(spark, d, "events")
    return R.retained(e, "ts", "event_type", "2024-01-31", {"error": 20, "signup": 5}, 10).groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"))


def adjusted_percents(spark, d):
    n = W.decisions(spark, d).groupBy("decision").agg(F.count("*").alias("n"))
    return R.adjusted_percents(n, "decision", "n")


def verification_summary(spark, d):
    c, r = _c()
    return W.decisions(spark, d).groupBy("object_id").agg(F.count("*").alias("n"), F.count_if(c).alias("confirmed"), F.count_if(r).alias("rejected"), F.count_distinct("check_id").alias("checks"))


def partial_progress(spark, d):
    c, _ = _c()
    g = latest_decisions(spark, d).groupBy((F.col("check_id") % 25).cast("int").alias("group_id")).agg(F.count_if(c).alias("confirmed"), F.count("*").alias("n"))
    return g.where("confirmed > 0 and confirmed < n")


def ring_buffer(spark, d):
    return R.last_rows(W.load(spark, d, "events"), "event_type", [F.desc("ts"), F.desc("event_id")]).select("event_type", "event_id")


def sessions(spark, d):
    return B.sessions(W.load(spark, d, "events"), "user_id", "ts", 6 * 3600).select("user_id", "session", "first", "last", "n")


QUERIES = {f.__name__: f for f in (score_detection, score_pooled, score_keys, score_group, score_k4, score_localisation, score_values, score_gate, score_breakdown, score_sensitivity, kappa, wilson, stratified_sample, leave_one_out, bootstrap_f1, latest_decisions, weekly_report, weekly_trend, reject_reasons, recommendations, group_status, indicator, dashboard_tiles, section_summary, latency_window, latency_histogram, usability, alerts, merge_run, merge_counts, retention_purge, adjusted_percents, verification_summary, partial_progress, ring_buffer, sessions)}

_PRF = "round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision, round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1"


def _counts(gold: str = "gold", hit: str = "predicted") -> str:
    return f"count(*) FILTER ({gold} AND {hit}) AS tp, count(*) FILTER (NOT {gold} AND {hit}) AS fp, count(*) FILTER ({gold} AND NOT {hit}) AS fn"


_TN = "count(*) FILTER (NOT gold AND NOT predicted) AS tn"
_LATEST = f"{W.DECISIONS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ts DESC, event_id DESC) AS rn FROM decisions) WHERE rn = 1)"
_IND = f"""{_LATEST}, n AS (SELECT CAST(check_id % 30 AS INTEGER) AS object_id, count(*) FILTER (decision = 'CONFIRMED_VIOLATION') AS confirmed, count(*) FILTER (decision = 'REVERT_TO_PENDING') AS pending, count(*) FILTER (decision = 'NEGATIVE_VERIFIED') AS rejected FROM latest GROUP BY 1),
 ind AS (SELECT *, CASE WHEN confirmed > 1 THEN 'RED' WHEN pending > 0 THEN 'YELLOW' WHEN rejected > 0 THEN 'GREEN' ELSE 'NONE' END AS colour FROM n)"""
_REPORT = "count(*) FILTER (decision = 'CONFIRMED_VIOLATION') AS confirmed, count(*) FILTER (decision = 'NEGATIVE_VERIFIED') AS rejected"

_MERGE = """t AS (SELECT c_custkey AS k, md5(CAST(c_nationkey % 3 AS VARCHAR)) AS sha, CAST(c_custkey % 3 AS INTEGER) AS v FROM customer), s AS (SELECT p_partkey + 100 AS k, md5(CAST(p_size % 3 AS VARCHAR)) AS sha FROM part),
 j AS (SELECT coalesce(t.k, s.k) AS k, CASE WHEN t.k IS NULL THEN 'INSERT' WHEN s.k IS NULL THEN 'SUPERSEDE' WHEN t.sha = s.sha THEN 'UNCHANGED' ELSE 'UPDATE' END AS action, v, coalesce(s.sha, t.sha) AS sha FROM t FULL JOIN s ON t.k = s.k)"""

SQL = {
    "score_detection": f"WITH {W.JUDGED}, c AS (SELECT lang, {_counts()}, {_TN} FROM judged GROUP BY 1) SELECT *, {_PRF} FROM c",
    "score_pooled": f"""WITH {W.JUDGED}, c AS (SELECT 'all' AS "all", {_counts()}, {_TN} FROM judged) SELECT *, {_PRF} FROM c""",
    "score_keys": f"""WITH {W.JUDGED}, g AS (SELECT DISTINCT source, n_chars // 50 AS k FROM judged WHERE gold), p AS (SELECT DISTINCT source, n_chars // 50 AS k FROM judged WHERE predicted),
 c AS (SELECT (SELECT count(*) FROM g JOIN p USING (source, k)) AS tp, (SELECT count(*) FROM p ANTI JOIN g USING (source, k)) AS fp, (SELECT count(*) FROM g ANTI JOIN p USING (source, k)) AS fn) SELECT *, {_PRF} FROM c""",
    "score_group": f"WITH {W.JUDGED}, g AS (SELECT source, count(*) AS size, count(*) FILTER (NOT predicted) AS hits FROM judged WHERE NOT gold GROUP BY 1) SELECT source, size, hits, hits > 0 AND hits >= 0.5 * size AS found FROM g",
    "score_k4": f"WITH {W.JUDGED}, m AS (SELECT lang, gold, predicted AND list_has_any([n_chars % 3, n_chars % 5], [doc_id % 3, doc_id % 5]) AS hit FROM judged), c AS (SELECT lang, {_counts(hit='hit')}, count(*) FILTER (NOT gold AND NOT hit) AS tn FROM m GROUP BY 1) SELECT *, {_PRF} FROM c",
    "score_localisation": f"WITH {W.JUDGED}, s AS (SELECT doc_id, list_distinct([n_chars % 3, n_chars % 7, n_chars % 5]) AS g, CASE WHEN predicted THEN list_distinct([doc_id % 3, doc_id % 7]) ELSE [] END AS p FROM judged), n AS (SELECT doc_id, len(list_intersect(g, p)) AS k, len(g) AS a, len(list_distinct(list_concat(g, p))) AS u FROM s) SELECT doc_id, round(k / a, 6) AS recall, round(k / u, 6) AS jaccard, k > 0 AS any_hit FROM n",
    "score_values": f"WITH {W.JUDGED} SELECT lang, round(avg(0.5 * CAST(gold = predicted AS INTEGER) + 0.25 * CAST(critical AS INTEGER) + 0.25 * CAST(n_chars > 1000 AS INTEGER)), 6) AS score FROM judged GROUP BY 1",
    "score_gate": f"WITH {W.JUDGED}, s AS (SELECT source, round(100 * avg(CAST(gold = predicted AS INTEGER)), 4) AS raw, bool_or(critical AND gold <> predicted) AS missed FROM judged GROUP BY 1) SELECT source, raw, CASE WHEN missed THEN least(raw, 59.0) ELSE raw END AS total FROM s",
    "score_breakdown": f"WITH {W.JUDGED}, j AS (SELECT *, CASE WHEN critical THEN 'HIGH' ELSE 'LOW' END AS criticality FROM judged), c AS (SELECT lang, criticality, source, {_counts()} FROM j GROUP BY GROUPING SETS ((lang), (criticality), (source))) SELECT *, {_PRF} FROM c",
    "score_sensitivity": f"WITH {W.JUDGED}, m AS (SELECT CAST(t AS INTEGER) AS threshold, gold, n_chars >= t AS hit FROM judged, (VALUES (200), (400), (800), (1600), (3200), (6400)) AS v(t)), c AS (SELECT threshold, {_counts(hit='hit')}, count(*) FILTER (NOT gold AND NOT hit) AS tn FROM m GROUP BY 1) SELECT *, {_PRF} FROM c",
    "kappa": f"WITH {W.JUDGED}, s AS (SELECT count(*) AS n, count(*) FILTER (gold = predicted) / count(*) AS o, (count(*) FILTER (gold) * count(*) FILTER (predicted) + count(*) FILTER (NOT gold) * count(*) FILTER (NOT predicted)) / (count(*) * count(*)) AS e FROM judged) SELECT n, round(o, 6) AS observed, round(e, 6) AS expected, round(CASE WHEN e = 1 THEN 0 ELSE (o - e) / (1 - e) END, 6) AS kappa FROM s",
    "wilson": f"WITH {W.JUDGED}, s AS (SELECT lang, count(*) FILTER (gold) AS k, count(*) AS n, count(*) FILTER (gold) / count(*) AS p FROM judged GROUP BY 1) SELECT lang, k, n, round((p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS low, round((p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4 * n * n))) / (1 + 3.8416 / n), 6) AS high FROM s",
    "stratified_sample": f"""WITH {W.JUDGED}, s AS (SELECT lang, count(*) AS n FROM judged GROUP BY 1), e AS (SELECT lang, n * 60 / sum(n) OVER () AS x FROM s), f AS (SELECT lang, CAST(floor(x) AS BIGINT) AS fl, x - floor(x) AS rest FROM e),
 q AS (SELECT lang, greatest(1, fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, lang) <= 60 - sum(fl) OVER () THEN 1 ELSE 0 END) AS quota FROM f), r AS (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5('s7' || doc_id), doc_id) AS place FROM judged) SELECT r.lang, doc_id FROM r JOIN q USING (lang) WHERE place <= quota""",
    "leave_one_out": f"""WITH {W.JUDGED}, s AS (SELECT lang, source, round(avg(CAST(gold = predicted AS INTEGER)), 6) AS score FROM judged GROUP BY ALL), m AS (SELECT *, round((sum(score) OVER (PARTITION BY source) - score) / nullif(count(*) OVER (PARTITION BY source) - 1, 0), 9) AS mean_others FROM s)
 SELECT lang, source, score, round(mean_others, 6) AS mean_others FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY mean_others DESC NULLS LAST, source) AS rn FROM m) WHERE rn = 1""",
    "latest_decisions": f"WITH {_LATEST} SELECT check_id, decision, ts FROM latest",
    "weekly_report": f"WITH {W.DECISIONS}, c AS (SELECT object_id, reason_code, {_REPORT}, count(*) AS total FROM decisions GROUP BY ALL) SELECT *, CASE WHEN confirmed + rejected > 0 THEN round(confirmed / (confirmed + rejected), 3) END AS precision FROM c",
    "weekly_trend": f"""WITH {W.DECISIONS}, w AS (SELECT CAST(DATE '2023-12-25' + CAST(i * 7 AS INTEGER) AS DATE) AS week FROM range(8) AS r(i)), c AS (SELECT CAST(date_trunc('week', ts) AS DATE) AS week, {_REPORT} FROM decisions GROUP BY 1)
 SELECT week, coalesce(confirmed, 0) AS confirmed, coalesce(rejected, 0) AS rejected, CASE WHEN coalesce(confirmed, 0) + coalesce(rejected, 0) > 0 THEN round(confirmed / (confirmed + rejected), 3) END AS precision FROM w LEFT JOIN c USING (week)""",
    "reject_reasons": f"WITH {W.DECISIONS}, c AS (SELECT reason_code, count(*) AS n FROM decisions WHERE decision = 'NEGATIVE_VERIFIED' GROUP BY 1) SELECT reason_code, n, round(n / sum(n) OVER (), 3) AS share, row_number() OVER (ORDER BY n DESC, reason_code) AS place FROM c",
    "recommendations": f"WITH {W.DECISIONS}, c AS (SELECT CAST(CAST(strftime(ts, '%Y%m%d') AS BIGINT) * 1000 + check_id % 40 AS BIGINT) AS day, {_REPORT} FROM decisions GROUP BY 1), f AS (SELECT * FROM c WHERE confirmed + rejected >= 3) SELECT day, 'REVIEW_RULE' AS advice FROM f WHERE rejected / (confirmed + rejected) >= 0.6 UNION ALL SELECT day, 'KEEP_RULE' FROM f WHERE rejected = 0",
    "group_status": f"WITH {_LATEST} SELECT CAST(check_id % 40 AS INTEGER) AS group_id, CASE WHEN bool_or(decision = 'CONFIRMED_VIOLATION') THEN 'CONFIRMED' WHEN bool_or(decision = 'CLARIFICATION_REQUIRED') THEN 'CLARIFICATION' WHEN bool_and(decision = 'NEGATIVE_VERIFIED') THEN 'REJECTED' ELSE 'PENDING' END AS status, count(*) AS n FROM latest GROUP BY 1",
    "indicator": f"WITH {_IND} SELECT * FROM ind",
    "dashboard_tiles": f"WITH {_IND} SELECT count(*) AS objects, count(*) FILTER (colour = 'RED') AS red, count(*) FILTER (colour = 'YELLOW') AS yellow, count(*) FILTER (colour = 'GREEN') AS green, count(*) FILTER (colour = 'NONE') AS none FROM ind",
    "section_summary": f"WITH {_IND} SELECT CAST(object_id % 3 AS INTEGER) AS section, CAST(sum(confirmed) AS BIGINT) AS confirmed, CAST(sum(pending) AS BIGINT) AS pending FROM ind WHERE colour = 'RED' GROUP BY 1 UNION ALL SELECT -1, CAST(sum(confirmed) AS BIGINT), CAST(sum(pending) AS BIGINT) FROM ind",
    "latency_window": "WITH e AS (SELECT ts, value, event_type, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS start FROM events) SELECT start, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM e GROUP BY 1",
    "latency_histogram": "SELECT CAST(b AS DOUBLE) AS le, (SELECT count(*) FROM events WHERE value <= b) AS n FROM (VALUES (1), (2), (5), (10), (25), (50), (100), (250), (500), (1000)) AS v(b)",
    "usability": "SELECT event_type, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS median, round(quantile_cont(value, 0.9), 4) AS p90, max(value) AS most, round(avg(CAST(value <= 20 AS INTEGER)), 4) AS within FROM events GROUP BY 1",
    "alerts": "WITH h AS (SELECT CAST(ts AS DATE) AS day, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, max(value) AS worst FROM events GROUP BY 1) SELECT day, 'MANY_ERRORS' AS alert FROM h WHERE errors * 4 > n UNION ALL SELECT day, 'SLOW' FROM h WHERE worst > 150 UNION ALL SELECT day, 'QUIET' FROM h WHERE n < 320",
    "merge_run": f"WITH {_MERGE} SELECT k, action, CASE action WHEN 'INSERT' THEN 1 WHEN 'UPDATE' THEN v + 1 ELSE v END AS row_version, sha, action = 'UPDATE' AS review_required FROM j",
    "merge_counts": f"WITH {_MERGE} SELECT action, count(*) AS n FROM j GROUP BY 1",
    "retention_purge": "SELECT event_type, count(*) AS n, min(ts) AS first FROM events WHERE ts >= DATE '2024-01-31' - CAST(CASE event_type WHEN 'error' THEN 20 WHEN 'signup' THEN 5 ELSE 10 END AS INTEGER) GROUP BY 1",
    "adjusted_percents": f"""WITH RECURSIVE {W.DECISIONS}, c AS (SELECT decision, count(*) AS n FROM decisions GROUP BY 1), r AS (SELECT decision, n, n * 1000 / sum(n) OVER () AS x, CAST(floor(n * 1000 / sum(n) OVER () + 0.5) AS BIGINT) AS t, row_number() OVER (ORDER BY decision) AS i FROM c),
 s AS (SELECT 0 AS step, list({{'i': i, 'd': decision, 'n': n, 'x': x, 't': t}} ORDER BY i) AS g FROM r
 UNION ALL SELECT step + 1, list_transform(g, lambda v: {{'i': v.i, 'd': v.d, 'n': v.n, 'x': v.x, 't': CASE WHEN (pick IS NOT NULL AND v.n = pick) OR (pick IS NULL AND v.i = top) THEN v.t + sign ELSE v.t END}})
 FROM (SELECT step, g, sign, list_sort(list_transform(list_filter(g, lambda v: len(list_filter(g, lambda u: u.n = v.n)) <= abs(left_over)), lambda v: {{'a': -sign * (v.x - v.t) / v.x, 'i': v.i, 'n': v.n}}))[1].n AS pick, list_sort(list_transform(g, lambda v: {{'n': -v.n, 'i': v.i}}))[1].i AS top
 FROM (SELECT step, g, 1000 - list_sum(list_transform(g, lambda v: v.t)) AS left_over, CASE WHEN 1000 > list_sum(list_transform(g, lambda v: v.t)) THEN 1 ELSE -1 END AS sign FROM s) WHERE left_over <> 0)),
 z AS (SELECT unnest(g) AS v FROM s WHERE step = (SELECT max(step) FROM s)) SELECT v.d AS decision, v.n AS n, v.t / 10 AS percent FROM z""",
    "verification_summary": f"WITH {W.DECISIONS} SELECT object_id, count(*) AS n, {_REPORT}, count(DISTINCT check_id) AS checks FROM decisions GROUP BY 1",
    "partial_progress": f"WITH {_LATEST}, g AS (SELECT CAST(check_id % 25 AS INTEGER) AS group_id, count(*) FILTER (decision = 'CONFIRMED_VIOLATION') AS confirmed, count(*) AS n FROM latest GROUP BY 1) SELECT * FROM g WHERE confirmed > 0 AND confirmed < n",
    "ring_buffer": "SELECT event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 500",
    "sessions": "WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR date_diff('second', lag(ts) OVER w, ts) > 21600 THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS session FROM f) SELECT user_id, session, min(ts) AS first, max(ts) AS last, count(*) AS n FROM s GROUP BY ALL",
}
