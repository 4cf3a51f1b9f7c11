"""Queries on files, codes, sheets and the generic relational surface."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import findings as G
from ..operators import registry as R
from ..operators import sequences as S
from . import views as W


def exact_duplicates(spark, d):
    return R.exact_duplicates(W.files(spark, d))


def near_duplicates(spark, d):
    return R.near_duplicates(W.files(spark, d), ["pages", "text_hash"])


def first_page_matches(spark, d):
    return R.first_page_matches(W.files(spark, d), "text_hash")


def duplicate_representatives(spark, d):
    return R.representatives(W.files(spark, d), F.col("sha256"), F.col("lang") == "fr").select("file_id", "representative")


SIGNALS = (("/en/", "RD", 1), ("[.]org", "ID", 2), ("[.]com", "PD", 2), ("html", "RD", 2), ("blog", "ID", 1), ("page=", "PD", 3))


def stage_votes(spark, d):
    pages = W.load(spark, d, "pages")
    of = F.array_compact(F.array(*[F.when(F.col("url").rlike(p), F.struct(F.lit(s).alias("stage"), F.lit(w).alias("weight"))) for p, s, w in SIGNALS]))
    return R.stage_votes(pages.select("page_id", F.explode(of).alias("s")).select("page_id", "s.*"), "page_id")


def twin_links(spark, d):
    part = W.load(spark, d, "part").select(F.col("p_brand").alias("folder"), F.col("p_name").alias("name"), "p_size")
    out = R.nearest_codes(part, part.withColumn("name", F.concat_ws("_", "name", (F.col("p_size") % 10).cast("string"))), "name", "folder", 0.65)
    return out.select("folder", "name", "match", F.round("score", 6).alias("score"), "step")


def near_codes(spark, d):
    code = lambda k: F.substring(F.md5(F.col(k).cast("string")), 1, 4).alias("code")
    return R.near_codes(W.load(spark, d, "customer").select(code("c_custkey")), W.load(spark, d, "supplier").select(code("s_suppkey")), "code")


def manifest_counts(spark, d):
    f = W.files(spark, d)
    return f.groupingSets([[F.col("lang")], [F.col("object_id")], []], "lang", "object_id").agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))


def file_counts(spark, d):
    status = F.when(F.col("n_chars") > 2000, "LONG").otherwise("SHORT")
    return W.files(spark, d).withColumn("status", status).groupBy("lang", "status").agg(F.count("*").alias("n"))


def input_hash(spark, d):
    f = W.files(spark, d)
    return f.groupBy("object_id").agg(R.multiset_hash(f, [F.col("file_id"), F.col("sha256")]).alias("hash"), F.count("*").alias("n"))


def sheet_overlap(spark, d):
    rooms = W.values(spark, d).select("stage", "supplier", F.col("part").alias("room"))
    out = R.sheet_overlap(rooms, "stage", "supplier", "room", "PD", "RD")
    return out.select("page_a", "page_b", "shared", F.round("overlap", 6).alias("overlap"), F.round("jaccard", 6).alias("jaccard"))


def counterparts(spark, d):
    best = G.anchor_page(sheet_overlap(spark, d), ["page_a"], [F.desc("overlap"), F.desc("jaccard"), F.col("page_b")])
    return best.select("page_a", "page_b", "overlap")


def qr_links(spark, d):
    e = W.load(spark, d, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") % 5).alias("target"))
    return R.strict_majority(e, "user_id", "target")


def act_registry(spark, d):
    orders, customers = W.load(spark, d, "orders"), W.load(spark, d, "customer").where("c_acctbal > 0")
    acts = orders.where("o_orderstatus = 'O'").select("o_orderkey", F.col("o_custkey").alias("code"), "o_orderpriority")
    return R.in_registry(acts, customers.select(F.col("c_custkey").alias("code")), "code", F.col("o_orderpriority").startswith("1")).select("o_orderkey", "in_registry")


def queue_order(spark, d):
    orders = W.load(spark, d, "orders")
    rank = F.when(F.col("o_orderpriority").startswith("1"), 0).when(F.col("o_orderpriority").startswith("2"), 1).otherwise(2)
    return S.queue_order(orders, ["o_custkey"], [rank, F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", F.col("place").cast("bigint").alias("place"))


def next_pending(spark, d):
    q = queue_order(spark, d).join(W.load(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    return S.next_pending(q, ["o_custkey"], "place", F.col("o_orderstatus") == "O").select("o_custkey", "o_orderkey", "place", "next_place")


def paging(spark, d):
    return S.page_of(W.load(spark, d, "orders"), [F.desc("o_totalprice"), F.col("o_orderkey")], 50, 25).select("o_orderkey", "o_totalprice")


def finalized_without_delivery(spark, d):
    orders, line = W.load(spark, d, "orders").where("o_orderstatus = 'F'"), W.load(spark, d, "lineitem").where("l_shipdate >= '1997-01-01'")
    return orders.join(line, orders["o_orderkey"] == line["l_orderkey"], "left_anti").select("o_orderkey", "o_custkey")


def q1(spark, d):
    line = W.load(spark, d, "lineitem").where("l_shipdate <= '1998-09-02'")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return line.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base"), F.round(F.sum(net), 2).alias("sum_disc"), F.round(F.avg("l_quantity"), 4).alias("avg_qty"), F.count("*").alias("n"))


def q3(spark, d):
    c, o, line = (W.load(spark, d, t) for t in ("customer", "orders", "lineitem"))
    rows = c.where("c_mktsegment = 'BUILDING'").join(o.where("o_orderdate < '1995-03-15'"), c["c_custkey"] == o["o_custkey"]).join(line.where("l_shipdate > '1995-03-15'"), o["o_orderkey"] == line["l_orderkey"])
    out = rows.groupBy("o_orderkey", "o_orderdate").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    return out.orderBy(F.desc("revenue"), "o_orderkey").limit(10)


def q5(spark, d):
    r, n, c, o, line, s = (W.load(spark, d, t) for t in ("region", "nation", "customer", "orders", "lineitem", "supplier"))
    home = n.join(F.broadcast(r.where("r_name = 'ASIA'")), n["n_regionkey"] == r["r_regionkey"]).select("n_nationkey", "n_name")  # 25 nations
    sold = line.join(o, line["l_orderkey"] == o["o_orderkey"]).join(c, o["o_custkey"] == c["c_custkey"]).join(s, (line["l_suppkey"] == s["s_suppkey"]) & (c["c_nationkey"] == s["s_nationkey"]))
    return sold.join(F.broadcast(home), sold["s_nationkey"] == home["n_nationkey"]).groupBy("n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def semi_anti(spark, d):
    c, o = W.load(spark, d, "customer"), W.load(spark, d, "orders").where("o_totalprice > 200000")
    semi = c.join(o, c["c_custkey"] == o["o_custkey"], "left_semi").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("semi"))
    anti = c.join(o, c["c_custkey"] == o["o_custkey"], "left_anti").groupBy("c_mktsegment").agg(F.count("*").alias("n")).withColumn("kind", F.lit("anti"))
    return semi.unionByName(anti)


def intersect_except(spark, d):
    line = W.load(spark, d, "lineitem")
    a, r = line.where("l_returnflag = 'A'").select("l_partkey"), line.where("l_returnflag = 'R'").select("l_partkey")
    return a.intersect(r).withColumn("kind", F.lit("both")).unionByName(a.subtract(r).withColumn("kind", F.lit("only")))


QUERIES = {f.__name__: f for f in (exact_duplicates, near_duplicates, first_page_matches, duplicate_representatives, stage_votes, twin_links, near_codes, manifest_counts, file_counts, input_hash, sheet_overlap, counterparts, qr_links, act_registry, queue_order, next_pending, paging, finalized_without_delivery, q1, q3, q5, semi_anti, intersect_except)}

_SHEETS = f"""{W.VALUES}, own AS (SELECT DISTINCT stage, supplier, part AS room FROM ev), sz AS (SELECT stage, supplier, count(*) AS n FROM own GROUP BY ALL),
 p AS (SELECT a.supplier AS page_a, b.supplier AS page_b, count(*) AS shared FROM own a JOIN own b USING (room) WHERE a.stage = 'PD' AND b.stage = 'RD' GROUP BY ALL HAVING count(*) >= 3),
 o AS (SELECT page_a, page_b, shared, round(shared / least(x.n, y.n), 6) AS overlap, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM p JOIN sz x ON x.stage = 'PD' AND x.supplier = page_a JOIN sz y ON y.stage = 'RD' AND y.supplier = page_b)"""
_QUEUE = "q AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderpriority LIKE '1%' THEN 0 WHEN o_orderpriority LIKE '2%' THEN 1 ELSE 2 END, o_totalprice DESC, o_orderkey) AS place FROM orders)"

SQL = {
    "exact_duplicates": f"WITH {W.FILES}, g AS (SELECT sha256, min(file_id) AS first_file, count(*) AS n FROM files GROUP BY 1 HAVING count(*) > 1) SELECT sha256, file_id, first_file, n FROM files JOIN g USING (sha256)",
    "near_duplicates": f"WITH {W.FILES} SELECT pages, text_hash, count(*) AS n, count(DISTINCT sha256) AS contents, min(file_id) AS first_file FROM files GROUP BY ALL HAVING count(*) > 1 AND count(DISTINCT sha256) >= 2",
    "first_page_matches": f"WITH {W.FILES} SELECT text_hash, count(*) AS n, count(DISTINCT pages) AS page_counts, min(file_id) AS first_file FROM files GROUP BY ALL HAVING count(DISTINCT pages) > 1",
    "duplicate_representatives": f"WITH {W.FILES} SELECT file_id, coalesce(min(CASE WHEN lang <> 'fr' THEN file_id END) OVER (PARTITION BY sha256), file_id) AS representative FROM files",
    "stage_votes": """WITH s AS (SELECT page_id, 'RD' AS stage, 1 AS w FROM pages WHERE regexp_matches(url, '/en/') UNION ALL SELECT page_id, 'ID', 2 FROM pages WHERE regexp_matches(url, '[.]org') UNION ALL SELECT page_id, 'PD', 2 FROM pages WHERE regexp_matches(url, '[.]com')
 UNION ALL SELECT page_id, 'RD', 2 FROM pages WHERE regexp_matches(url, 'html') UNION ALL SELECT page_id, 'ID', 1 FROM pages WHERE regexp_matches(url, 'blog') UNION ALL SELECT page_id, 'PD', 3 FROM pages WHERE regexp_matches(url, 'page=')),
 g AS (SELECT page_id, stage, sum(w) AS w FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER x AS rn, coalesce(lead(w) OVER x, 0) AS nxt FROM g WINDOW x AS (PARTITION BY page_id ORDER BY w DESC, stage)), c AS (SELECT *, w >= 2 AND w - nxt >= 2 AND w >= 1.5 * nxt AS sure FROM r WHERE rn = 1)
 SELECT page_id, CASE WHEN sure THEN stage END AS stage, CASE WHEN sure THEN round(1 - exp(-CAST(w - nxt AS DOUBLE) / 3), 6) END AS confidence FROM c""",
    "twin_links": """WITH a AS (SELECT DISTINCT p_brand AS folder, p_name AS name FROM part), b AS (SELECT DISTINCT p_brand AS folder, p_name || '_' || (p_size % 10) AS match FROM part),
 p AS (SELECT folder, name, match, 1 - levenshtein(name, match) / greatest(length(name), length(match)) AS score FROM a JOIN b USING (folder)), r AS (SELECT *, row_number() OVER (PARTITION BY folder, name ORDER BY score DESC, match) AS rn FROM p WHERE score >= 0.65)
 SELECT folder, name, match, round(score, 6) AS score, CASE WHEN score >= 0.98 THEN 0 WHEN score >= 0.90 THEN 1 WHEN score >= 0.80 THEN 2 WHEN score >= 0.65 THEN 3 ELSE 4 END AS step FROM r WHERE rn = 1""",
    "near_codes": """WITH a AS (SELECT DISTINCT substring(md5(CAST(c_custkey AS VARCHAR)), 1, 4) AS code FROM customer), b AS (SELECT DISTINCT substring(md5(CAST(s_suppkey AS VARCHAR)), 1, 4) AS match FROM supplier)
 SELECT code, min(match) AS match FROM a JOIN b ON hamming(code, match) = 1 GROUP BY 1 HAVING count(*) = 1""",
    "manifest_counts": f"WITH {W.FILES} SELECT lang, object_id, count(*) AS files, CAST(sum(pages) AS BIGINT) AS pages FROM files GROUP BY GROUPING SETS ((lang), (object_id), ())",
    "file_counts": f"WITH {W.FILES} SELECT lang, CASE WHEN n_chars > 2000 THEN 'LONG' ELSE 'SHORT' END AS status, count(*) AS n FROM files GROUP BY ALL",
    "input_hash": f"WITH {W.FILES} SELECT object_id, CAST(sum(CAST(CAST('0x' || substring(sha256(CAST(file_id AS VARCHAR) || chr(31) || sha256), 1, 16) AS UBIGINT) AS HUGEINT)) AS VARCHAR) AS hash, count(*) AS n FROM files GROUP BY 1",
    "sheet_overlap": f"WITH {_SHEETS} SELECT * FROM o",
    "counterparts": f"WITH {_SHEETS} SELECT page_a, page_b, overlap FROM (SELECT *, row_number() OVER (PARTITION BY page_a ORDER BY overlap DESC, jaccard DESC, page_b) AS rn FROM o) WHERE rn = 1",
    "qr_links": """WITH h AS (SELECT user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 AS target, count(*) AS n FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS rn, coalesce(lead(n) OVER w, 0) AS nxt FROM h WINDOW w AS (PARTITION BY user_id ORDER BY n DESC, target))
 SELECT user_id, target, n FROM r WHERE rn = 1 AND n >= 2 AND n > nxt""",
    "act_registry": "SELECT o_orderkey, CASE WHEN c_custkey IS NOT NULL THEN true WHEN o_orderpriority LIKE '1%' THEN false END AS in_registry FROM orders LEFT JOIN (FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey WHERE o_orderstatus = 'O'",
    "queue_order": f"WITH {_QUEUE} SELECT o_custkey, o_orderkey, place FROM q",
    "next_pending": f"""WITH {_QUEUE}, p AS (SELECT *, CASE WHEN o_orderstatus = 'O' THEN place END AS here FROM q)
 SELECT o_custkey, o_orderkey, place, coalesce(min(here) OVER (PARTITION BY o_custkey ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), min(here) OVER (PARTITION BY o_custkey)) AS next_place FROM p""",
    "paging": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50",
    "finalized_without_delivery": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_shipdate >= '1997-01-01')",
    "q1": "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc, round(avg(l_quantity), 4) AS avg_qty, count(*) AS n FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY ALL",
    "q3": "SELECT o_orderkey, o_orderdate, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderdate < '1995-03-15' AND l_shipdate > '1995-03-15' GROUP BY ALL ORDER BY revenue DESC, o_orderkey LIMIT 10",
    "q5": "SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY 1",
    "semi_anti": "WITH o AS (SELECT o_custkey FROM orders WHERE o_totalprice > 200000) SELECT c_mktsegment, count(*) AS n, 'semi' AS kind FROM customer WHERE c_custkey IN (FROM o) GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 'anti' FROM customer WHERE c_custkey NOT IN (FROM o) GROUP BY 1",
    "intersect_except": "WITH a AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'A'), r AS (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R') SELECT l_partkey, 'both' AS kind FROM (FROM a INTERSECT FROM r) UNION ALL SELECT l_partkey, 'only' FROM (FROM a EXCEPT FROM r)",
}
