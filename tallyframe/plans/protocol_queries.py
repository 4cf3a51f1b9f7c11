"""Queries of the protocol's operators over whole tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import protocol as P
from ..operators import sequences as S
from . import views as W
from .registry_queries import sheet_overlap
from .report_queries import latest_decisions
from .sequence_queries import table_rows

KEY = ["param_code", "location"]


def bridged_pairs(spark, d):
    read = W.values(spark, d).where("quality = 'OK' and stage = 'RD' and confidence >= 0.99")
    return P.bridged(W.diffs(spark, d), read, KEY, "axis", "PD_ID").select(*KEY, "axis", "result")


def _rooms(spark, d):
    return W.values(spark, d).withColumns({"room": F.col("part") % 97, "label": F.concat(F.lit("L"), (F.col("part") % 61 + F.col("quantity")).cast("string"))})


def marks_elsewhere(spark, d):
    v = _rooms(spark, d)
    actual = v.where("stage = 'ID'")
    missing = v.where("stage = 'PD'").select("room", "label").distinct().join(actual.select("room", "label").distinct(), ["room", "label"], "left_anti")
    return P.found_on_sheets(missing, actual.select("room", F.col("supplier").alias("page")), actual.select(F.col("supplier").alias("page"), "label"), "room", "page", "label")


def attribute_changes(spark, d):
    v = W.values(spark, d)
    return P.attribute_changes(v.where("stage = 'PD'"), v.where("stage = 'ID'"), ["part", "location"], ["param_code"], "quantity")


def verified_pairs(spark, d):
    v = W.values(spark, d)
    return P.verified_pairs(v.where("stage = 'PD'"), v.where("stage = 'RD'"), "param_code", "part", "quantity")


def unreported(spark, d):
    all_ = W.diffs(spark, d)
    return P.reported_dropped(all_.where("result = 'IMPROVEMENT'"), all_.where("result = 'VIOLATION'"), KEY).select(*KEY, "axis", "confidence")


def list_pages(spark, d):
    v = W.values(spark, d)
    return P.list_pages_dropped(v, ["file_id"], "stage", "quantity").groupBy("stage").agg(F.count("*").alias("n"), F.min("file_id").alias("first"))


def units_given(spark, d):
    p = W.load(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 3 > 0, F.concat(F.lit("u"), (F.col("p_size") % 3).cast("string"))).otherwise("").alias("u"), F.when(F.col("p_size") % 4 == 0, "COUNT").when(F.col("p_size") % 4 == 1, "м²").alias("c"))
    return p.select("p_partkey", P.with_unit(F.col("u"), F.col("c")).alias("unit"))


def sub_checks(spark, d):
    v = W.load(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("code"), F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("s"), (F.col("o_orderkey") % 3).cast("string"))).alias("sub"))
    subs = W.load(spark, d, "orders").select(F.col("o_orderstatus").alias("code")).distinct().select("code", F.explode(F.array(F.lit("s1"), F.lit("s2"))).alias("sub"))
    return P.for_sub_checks(v, subs, "code", "sub").groupBy("code", "sub").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


def element_routes(spark, d):
    e = F.get(F.array(*map(F.lit, ("WALL", "FLOOR_SLAB", "FOUNDATION_SLAB", "ROOF"))), (F.col("p_partkey") % 4).cast("int"))
    kinds = F.array(F.when(F.col("p_size") % 3 == 0, "THICKNESS"), F.when(F.col("p_size") % 2 == 0, "ELEVATION"), F.when(F.col("p_size") % 5 == 0, "AXIS"))
    return W.load(spark, d, "part").select("p_partkey", P.route(e, kinds).alias("r")).select("p_partkey", "r.*")


def supported_rules(spark, d):
    kind = F.get(F.array(*map(F.lit, ("PAIRWISE_DELTA", "RATIO", "PRESENCE", "GEOMETRY"))), (F.col("p_size") % 4).cast("int"))
    return P.supported(W.load(spark, d, "part").select("p_partkey", kind.alias("kind")), "kind")


def archive_links(spark, d):
    p = W.load(spark, d, "part")
    archives = p.where("p_size % 7 = 0").select(F.col("p_brand").alias("folder"), F.substring("p_name", 1, 8).alias("stem"))
    return P.archive_links(archives, p.select(F.col("p_brand").alias("folder"), F.col("p_name").alias("stem")), "folder", "stem")


def tag_rooms(spark, d):
    at = lambda k, a, b: [(F.col(k) * a % 997 / 997.0).alias("x"), (F.col(k) * b % 991 / 991.0).alias("y")]
    part, sup = W.load(spark, d, "part"), W.load(spark, d, "supplier")
    tags = part.select((F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("tag"), *at("p_partkey", 37, 53))
    leaders = part.where("p_partkey % 5 = 0").select((F.col("p_partkey") % 20).alias("page"), F.col("p_partkey").alias("tag"), *at("p_partkey", 91, 17))
    labels = sup.select((F.col("s_suppkey") % 20).alias("page"), F.col("s_suppkey").alias("room"), *at("s_suppkey", 71, 29))
    zones = labels.where("room % 2 = 0").select("page", "room", F.array(F.col("x") - 0.05, F.col("y") - 0.05, F.col("x") + 0.05, F.col("y") + 0.05).alias("box"))
    return P.attributed(tags, leaders, zones, labels, "page", "tag", "room", 0.06, 0.1)


def box_clusters(spark, d):
    p = W.load(spark, d, "part").select((F.col("p_partkey") % 10).alias("page"), F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 997 / 997.0).alias("x"), (F.col("p_partkey") * 53 % 991 / 991.0).alias("y"))
    return P.box_clusters(p.withColumn("box", F.array("x", "y", F.col("x") + 0.04, F.col("y") + 0.04)), "page", "k", "box", "page long, k long, cluster long")


def room_inventories(spark, d):
    v = W.values(spark, d).withColumn("room", F.col("part") % 40)
    rooms = v.where("stage = 'PD' and quantity > 40").select("supplier", "room")
    tags = v.where("stage = 'ID' and quantity < 9").select("supplier", "room", F.concat(F.lit("t"), F.col("quantity").cast("string")).alias("tag"))
    return P.inventories(rooms, tags, "supplier", "room", "tag").select("supplier", "room", F.array_join("tags", ",").alias("tags"), "labelled")


def merged_readings(spark, d):
    p = W.load(spark, d, "part")
    base = p.where("p_partkey % 4 > 0").select("p_partkey", F.col("p_name").alias("text"), (F.col("p_size") / 50.0).alias("score"))
    extra = p.where("p_partkey % 3 = 0").select("p_partkey", F.col("p_type").alias("text"), ((F.col("p_size") * 7 % 50) / 50.0).alias("score"))
    return P.merged_readings(base, extra, "p_partkey", "text", "score", 0.5, 0.1, 0.8)


def agreed_elements(spark, d):
    v = W.values(spark, d)
    return P.agreed_elements(v.where("stage = 'PD'"), v.where("stage = 'RD'"), "param_code", "supplier")


def counterpart_score(spark, d):
    o = sheet_overlap(spark, d)
    best = o.groupBy("page_a").agg(F.min_by("page_b", F.struct(-F.col("overlap"), -F.col("jaccard"), "page_b")).alias("page_b"))
    cited = W.load(spark, d, "supplier").select(F.col("s_suppkey").alias("page_a"), (F.col("s_suppkey") % 10 + 1).alias("page_b"))
    return P.counterpart_score(best, cited, "page_a", "page_b")


def enriched_groups(spark, d):
    groups = W.load(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit(0)).cast("bigint").alias("page"))
    findings = W.load(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_suppkey").alias("page"))
    return P.enriched(groups, findings, ["o_orderkey"], ["page"]).select("o_orderkey", "page")


def gold_capture(spark, d):
    checks = W.load(spark, d, "customer").select(F.col("c_custkey").alias("check_id"), "c_mktsegment")
    return P.captured_gold(checks, W.decisions(spark, d), "check_id", ["ts", "event_id"], {"CONFIRMED_VIOLATION": "POSITIVE", "NEGATIVE_VERIFIED": "NEGATIVE"})


def gold_seeds(spark, d):
    c = W.load(spark, d, "nation").where("n_nationkey < 20").select(F.col("n_nationkey").alias("code"), "n_name")
    return P.seeded_gold(W.load(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("code")), c, "code", ["n_name"]).select("s_suppkey", "code", "n_name", "known")


def dispute_objects(spark, d):
    """Each clarification beside the object of its check's last decision."""
    last = latest_decisions(spark, d).select("check_id", (F.col("check_id") % 7).cast("int").alias("object_id"), F.col("decision").alias("last"))
    return W.decisions(spark, d).where("decision = 'CLARIFICATION_REQUIRED'").select("event_id", "check_id").join(last, "check_id")


def file_cards(spark, d):
    return W.files(spark, d).join(W.load(spark, d, "labels"), F.col("file_id") == F.col("doc_id")).select("file_id", "object_id", "pages", "quality")


def object_runs(spark, d):
    o = W.load(spark, d, "orders")
    last = o.groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("run"), F.count("*").alias("runs"))
    return W.load(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "run", F.coalesce("runs", F.lit(0)).alias("runs"))


def decision_history(spark, d):
    return P.history(W.decisions(spark, d), "check_id", ["ts", "event_id"], "reason_code")


def protocol_tally(spark, d):
    return P.tally(W.diffs(spark, d), "axis", "result", ["VIOLATION", "EQUAL", "IMPROVEMENT"])


def request_counters(spark, d):
    e = W.load(spark, d, "events").withColumn("status", F.when(F.col("value") > 100, 500).otherwise(200))
    return e.groupBy("event_type", (F.col("user_id") % 5).alias("route"), "status").agg(F.count("*").alias("n"))


def _blocks(spark, d):
    b = S.sum_checks(table_rows(spark, d), "table_id", ["n"], F.col("total"), "area").where("printed is not null")
    return b.select("table_id", "block", F.when(F.col("block") % 4 == 0, F.col("sum") * 5).otherwise(F.col("sum")).alias("total"), F.col("sum").alias("own"))


def block_levels(spark, d):
    return P.resolved_levels(_blocks(spark, d), "table_id", "block", "total", "own").select("table_id", "block", "level", "unresolved")


def floor_totals(spark, d):
    o = W.load(spark, d, "orders")
    return o.groupBy("o_orderstatus", (F.col("o_custkey") % 50).alias("floor")).agg(F.min_by("o_totalprice", F.struct("o_orderdate", "o_orderkey")).alias("total"))


HEDGES = {"Brand#11": "A", "Brand#12": "A", "Brand#21": "A", "Brand#13": "B", "Brand#14": "B", "Brand#31": "C", "Brand#32": "C", "Brand#33": "C"}


def hedge_groups(spark, d):
    return P.hedged(W.diffs(spark, d).where("result <> 'EQUAL'"), HEDGES, "param_code", "location", "confidence")


def label_counters(spark, d):
    return P.label_counters(W.judged(spark, d), ["lang", "source", "gold"])


def order_buckets(spark, d):
    b = P.bucket([("BIG", F.col("o_totalprice") > 300000), ("URGENT", F.col("o_orderpriority").startswith("1")), ("OLD", F.col("o_orderdate") < "1994-01-01")], "REST")
    return W.load(spark, d, "orders").groupBy(b.alias("bucket")).agg(F.count("*").alias("n"))


def row_accuracy(spark, d):
    line = W.load(spark, d, "lineitem").select("l_suppkey", "l_returnflag", F.col("l_quantity").cast("int").alias("q"))
    return P.row_accuracy(line.where("l_returnflag = 'R'"), line.where("l_returnflag = 'A'"), "l_suppkey", ["q"])


def binder_accuracy(spark, d):
    c = W.load(spark, d, "conversations")
    guess = F.when(F.col("turn") == 0, "system").when(F.col("turn") % 2 == 1, "user").otherwise("assistant")
    return c.groupBy((F.col("conv_id") % 10).alias("binder")).agg(F.round(F.avg((F.col("role") == guess).cast("double")), 6).alias("accuracy"), F.count("*").alias("pages"))


def revision_fingerprints(spark, d):
    f = W.files(spark, d).withColumn("revision", F.concat_ws("-", "object_id", (F.col("file_id") % 13).cast("string")))
    return P.revision_fingerprint(f, "revision", "file_id", "sha256")


def completeness(spark, d):
    p = W.load(spark, d, "part").select("p_partkey", "p_brand", F.when(F.col("p_size") % 5 > 0, "ACTIVE").otherwise("OFF").alias("status"), F.when(F.col("p_size") % 3 == 0, F.lit("text")).alias("evidence"))
    return p.where("status = 'ACTIVE' and evidence is null").groupBy("p_brand").agg(F.count("*").alias("open"), F.min("p_partkey").alias("first"))


def _facts(spark, d):
    r = lambda x: F.count_if(F.col("result") == x)
    return W.diffs(spark, d).groupBy("param_code").agg(F.count_distinct("axis").alias("axes"), r("VIOLATION").alias("bad"), r("EQUAL").alias("same"), r("IMPROVEMENT").alias("better"))


def protocol_tables(spark, d):
    return P.protocol_tables(_facts(spark, d), ["param_code"], F.col("axes") < 3, F.col("bad") > 6, (F.col("bad") <= 4) & (F.col("same") > 0), F.col("better") > 6)


def not_checked(spark, d):
    v = W.values(spark, d).groupBy("part", "param_code").agg(F.count_if(F.col("stage") == "ID").alias("_id"), F.count_distinct("stage").alias("stages"))
    return v.where("_id = 0").groupBy("param_code").agg(F.count("*").alias("parts"), F.sum("stages").alias("stages"))


def recommendation_rows(spark, d):
    rows = W.diffs(spark, d).where("result = 'VIOLATION'").withColumn("section", F.col("axis"))
    texts = W.load(spark, d, "part").groupBy(F.col("p_brand").alias("param_code")).agg(F.min("p_name").alias("text"))
    out = P.numbered_texts(rows, texts, "param_code", [F.col("param_code"), F.col("location")])
    return out.select("section", "param_code", "location", "text", F.col("number").cast("bigint").alias("number"))


def input_registry(spark, d):
    cited = W.diffs(spark, d).where("result = 'VIOLATION'").select(F.col("expected_file").alias("o_orderkey"), F.col("param_code").alias("code"), F.col("location").alias("ord"))
    return P.input_registry(W.load(spark, d, "orders").select("o_orderkey"), cited, "o_orderkey", "ord")


def stage_counts(spark, d):
    return W.values(spark, d).groupBy("stage").agg(F.count("*").alias("expected"), F.count_if((F.col("quality") == "OK") & (F.col("confidence") >= 0.95)).alias("loaded"))


def content_hashes(spark, d):
    return W.load(spark, d, "customer").select("c_custkey", P.content_sha(F.col("c_custkey"), F.col("c_name"), F.when(F.col("c_custkey") % 5 > 0, F.col("c_mktsegment")).alias("segment")).alias("sha"))


def counts_by_label(spark, d):
    return W.diffs(spark, d).where("result = 'VIOLATION'").groupBy("axis", "param_code").agg(F.count("*").alias("n"))


def object_scenarios(spark, d):
    return W.values(spark, d).groupBy("part").agg(F.collect_set("stage").alias("s")).select("part", P.scenario(F.col("s")).alias("scenario"))


def code_folds(spark, d):
    code = F.concat(F.get(F.array(*map(F.lit, ("AR", "KR", "OV", "VK"))), (F.col("p_size") % 4).cast("int")), F.lit("-"), F.col("p_size").cast("string"))
    return W.load(spark, d, "part").groupBy(P.fold_of(code, {"F1": ["AR"], "F2": ["KR", "OV"]}, "REST").alias("fold")).agg(F.count("*").alias("n"))


def file_summaries(spark, d):
    return P.page_summaries(W.load(spark, d, "lineitem"), "l_orderkey", F.col("l_quantity").cast("bigint"), F.col("l_discount") > 0.05)


def acceptance_gates(spark, d):
    f = _facts(spark, d)
    return P.gates(f, "param_code", [("G1_ALL_AXES", F.col("axes") == 3), ("G2_FEW_BAD", F.col("bad") < 7), ("G3_SOME_SAME", F.col("same") > 0), ("G4_BALANCE", F.col("better") <= 2 * F.col("bad"))])


def package_problems(spark, d):
    sha = lambda c: F.md5(c.cast("string")).alias("sha")
    docs = W.load(spark, d, "supplier").select("s_suppkey", sha(F.col("s_suppkey")))
    part = W.load(spark, d, "part")
    parts = part.select(F.col("p_partkey").alias("s_suppkey"), F.when(F.col("p_size") % 2 == 0, "SIDECAR").otherwise("INDEX").alias("kind"), sha(F.when(F.col("p_size") % 5 == 0, F.lit(0)).otherwise(F.col("p_partkey")))).unionByName(part.where("p_size > 30").select(F.col("p_partkey").alias("s_suppkey"), F.lit("SIDECAR").alias("kind"), sha(F.col("p_partkey"))))
    return P.companions(docs, parts, "s_suppkey", ["SIDECAR", "INDEX"])


def plan_cross_check(spark, d):
    f = W.load(spark, d, "orders").select(F.col("o_custkey").alias("k"))
    return P.cross_check(f, W.load(spark, d, "customer").where("c_custkey % 10 > 0").select(F.col("c_custkey").alias("k")), "k")


def upserted_limits(spark, d):
    t = W.load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_acctbal", (F.col("c_custkey") % 4).alias("v"))
    s = W.load(spark, d, "supplier").select((F.col("s_suppkey") * 3).alias("k"), F.col("s_acctbal").alias("c_acctbal"), (F.col("s_suppkey") % 4).alias("v"))
    return P.upserted(t, s, ["k"], "v")


def merged_sections(spark, d):
    layout = W.load(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    sections = W.load(spark, d, "supplier").select((F.col("s_suppkey") * 2).alias("c_custkey"), F.when(F.col("s_suppkey") % 3 > 0, F.col("s_name")).alias("c_mktsegment"))
    return P.merged_sections(layout, sections, "c_custkey", ["c_mktsegment"])


def distinct_words(spark, d):
    p = W.load(spark, d, "part").select((F.col("p_partkey") % 30).alias("page"), F.col("p_type").alias("text"), (F.col("p_size") / 50.0).alias("x"), (F.col("p_partkey") * 7 % 10 / 10.0).alias("y"), "p_partkey")
    return P.distinct_words(p, "page", "text", "x", "y", ["p_partkey"], 0.2).select("page", "text", "p_partkey")


def marked_totals(spark, d):
    kind = F.when(F.col("n") % 7 == 0, "SUBTOTAL").when(F.col("n") % 7 == 1, F.when(F.col("n") % 3 == 0, "SUBTOTAL").otherwise("DATA")).otherwise("DATA")
    return P.grand_totals(table_rows(spark, d).withColumn("kind", kind), "table_id", "n", "kind").groupBy("table_id", "kind").agg(F.count("*").alias("k"), F.sum("n").alias("places"))


def marked_subzones(spark, d):
    rows = table_rows(spark, d)
    return P.subzones(rows, "table_id", "n", F.col("area") == 50, F.col("area") >= 10).select("table_id", "n", "parent").where("parent is not null")


def carried_registries(spark, d):
    c = W.load(spark, d, "conversations")
    return P.carried(c, "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "system", F.col("turn")).select("conv_id", "turn", "registry")


def current_revisions(spark, d):
    return P.current_revisions(W.load(spark, d, "orders"), "o_custkey", "o_orderpriority", "o_orderdate")


def gap_segments(spark, d):
    w = W.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("a"), (F.col("l_suppkey") + F.col("l_quantity").cast("int")).alias("b"))
    return P.gap_segments(w, "l_orderkey", "a", "b", ["l_linenumber"], 5).select("l_orderkey", "l_linenumber", "segment")


def reading_order(spark, d):
    w = W.load(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_suppkey") % 3).alias("line"), "l_partkey", "l_suppkey")
    out = P.reading_order(w, "l_orderkey", "line", F.col("line") == 2, "l_partkey", "l_suppkey", ["l_linenumber"])
    return out.select("l_orderkey", "l_linenumber", F.col("place").cast("bigint").alias("place"))


def split_bands(spark, d):
    return P.split_bands(W.load(spark, d, "documents"), "doc_id", "text").groupBy("doc_id").agg(F.count("*").alias("lines"), F.max("part").cast("bigint").alias("last"))


def anchor_pools(spark, d):
    return P.anchor_pools(W.values(spark, d), ["stage", "param_code"], "location", "supplier")


QUERIES = {f.__name__: f for f in (bridged_pairs, marks_elsewhere, attribute_changes, verified_pairs, unreported, list_pages, units_given, sub_checks, element_routes, supported_rules, archive_links, tag_rooms, box_clusters, room_inventories, merged_readings, agreed_elements, counterpart_score, enriched_groups, gold_capture, gold_seeds, dispute_objects, file_cards, object_runs, decision_history, protocol_tally, request_counters, block_levels, floor_totals, hedge_groups, label_counters, order_buckets, row_accuracy, binder_accuracy, revision_fingerprints, completeness, protocol_tables, not_checked, recommendation_rows, input_registry, stage_counts, content_hashes, counts_by_label, object_scenarios, code_folds, file_summaries, acceptance_gates, package_problems, plan_cross_check, upserted_limits, merged_sections, distinct_words, marked_totals, marked_subzones, carried_registries, current_revisions, gap_segments, reading_order, split_bands, anchor_pools)}

_TR = "t AS (SELECT l_suppkey AS table_id, l_quantity AS area, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_quantity) AS n FROM lineitem)"
_ROOMS = f"{W.VALUES}, rv AS (SELECT *, part % 97 AS room, 'L' || (part % 61 + quantity) AS label FROM ev)"
_FACTS = f"{W.BEST}, fa AS (SELECT param_code, count(DISTINCT axis) AS axes, count(*) FILTER (result = 'VIOLATION') AS bad, count(*) FILTER (result = 'EQUAL') AS same, count(*) FILTER (result = 'IMPROVEMENT') AS better FROM diff GROUP BY 1)"
_LAST = f"{W.DECISIONS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY ts DESC, event_id DESC) AS rn FROM decisions) WHERE rn = 1)"
_HEDGE = ", ".join(f"('{c}', '{s}')" for c, s in HEDGES.items())

SQL = {
    "bridged_pairs": f"WITH {W.BEST}, c AS (SELECT DISTINCT param_code, location FROM ev WHERE quality = 'OK' AND stage = 'RD' AND confidence >= 0.99) SELECT param_code, location, axis, result FROM diff WHERE axis <> 'PD_ID' UNION ALL SELECT param_code, location, axis, result FROM diff d WHERE axis = 'PD_ID' AND NOT EXISTS (SELECT 1 FROM c WHERE c.param_code = d.param_code AND c.location = d.location)",
    "marks_elsewhere": f"""WITH {_ROOMS}, m AS (SELECT DISTINCT room, label FROM rv WHERE stage = 'PD' EXCEPT SELECT room, label FROM rv WHERE stage = 'ID'), s AS (SELECT DISTINCT a.room, b.label FROM (SELECT DISTINCT room, supplier FROM rv WHERE stage = 'ID') a JOIN (SELECT DISTINCT supplier, label FROM rv WHERE stage = 'ID') b USING (supplier))
 SELECT room, label FROM m SEMI JOIN s USING (room, label)""",
    "attribute_changes": f"""WITH {W.VALUES}, u AS (SELECT stage, part, location, param_code, min(quantity) AS q FROM ev GROUP BY ALL HAVING min(quantity) = max(quantity))
 SELECT e.part, e.location, e.param_code, e.q AS expected, a.q AS actual FROM u e JOIN u a USING (part, location, param_code) WHERE e.stage = 'PD' AND a.stage = 'ID' AND a.q < e.q AND NOT EXISTS (SELECT 1 FROM ev x WHERE x.stage = 'ID' AND x.param_code = e.param_code AND x.quantity = e.q)""",
    "verified_pairs": f"WITH {W.VALUES}, u AS (SELECT stage, part, param_code FROM ev GROUP BY ALL HAVING min(quantity) = max(quantity)) SELECT e.param_code, min(e.part) AS part FROM u e JOIN u a USING (part, param_code) WHERE e.stage = 'PD' AND a.stage = 'RD' GROUP BY 1",
    "unreported": f"WITH {W.BEST} SELECT param_code, location, axis, confidence FROM diff d WHERE result = 'IMPROVEMENT' AND NOT EXISTS (SELECT 1 FROM diff v WHERE v.result = 'VIOLATION' AND v.param_code = d.param_code AND v.location = d.location)",
    "list_pages": f"WITH {W.VALUES}, b AS (SELECT file_id, stage FROM ev GROUP BY ALL HAVING min(quantity) < max(quantity)) SELECT stage, count(*) AS n, min(file_id) AS first FROM ev ANTI JOIN b USING (file_id, stage) GROUP BY 1",
    "units_given": "SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 3 > 0 THEN 'u' || (p_size % 3) WHEN p_size % 4 = 1 THEN 'м²' END AS unit FROM part",
    "sub_checks": "WITH v AS (SELECT o_orderkey, o_orderstatus AS code, CASE WHEN o_orderkey % 3 > 0 THEN 's' || (o_orderkey % 3) END AS pin FROM orders) SELECT code, sub, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys FROM v, (VALUES ('s1'), ('s2')) AS s(sub) WHERE pin IS NULL OR pin = sub GROUP BY ALL",
    "element_routes": """WITH v AS (SELECT p_partkey, ['WALL', 'FLOOR_SLAB', 'FOUNDATION_SLAB', 'ROOF'][p_partkey % 4 + 1] AS e, p_size % 3 = 0 AS t, p_size % 2 = 0 AS l, p_size % 5 = 0 AS a FROM part)
 SELECT p_partkey, CASE WHEN t THEN CASE e WHEN 'WALL' THEN 'KR-061' WHEN 'FOUNDATION_SLAB' THEN 'KR-058' WHEN 'FLOOR_SLAB' THEN 'KR-059' END WHEN l AND NOT a THEN CASE e WHEN 'FOUNDATION_SLAB' THEN 'KR-058' WHEN 'FLOOR_SLAB' THEN 'KR-059' END ELSE 'KR-054' END AS code, CASE WHEN t OR (l AND NOT a) THEN 'DECREASE' ELSE 'ANY' END AS direction FROM v""",
    "supported_rules": "SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'PAIRWISE_DELTA' ELSE 'PRESENCE' END AS kind FROM part WHERE p_size % 4 IN (0, 2)",
    "archive_links": "WITH a AS (SELECT DISTINCT p_brand AS folder, substring(p_name, 1, 8) AS archive FROM part WHERE p_size % 7 = 0), f AS (SELECT DISTINCT p_brand AS folder, p_name AS file FROM part) SELECT folder, file, arg_max(archive, length(archive)) AS archive FROM f JOIN a USING (folder) WHERE starts_with(file, archive) AND length(archive) >= 4 GROUP BY ALL",
    "tag_rooms": """WITH t AS (SELECT p_partkey % 20 AS page, p_partkey AS tag, p_partkey * 37 % 997 / 997.0 AS x, p_partkey * 53 % 991 / 991.0 AS y FROM part), l AS (SELECT p_partkey % 20 AS page, p_partkey AS tag, p_partkey * 91 % 997 / 997.0 AS x, p_partkey * 17 % 991 / 991.0 AS y FROM part WHERE p_partkey % 5 = 0),
 b AS (SELECT s_suppkey % 20 AS page, s_suppkey AS room, s_suppkey * 71 % 997 / 997.0 AS x, s_suppkey * 29 % 991 / 991.0 AS y FROM supplier), z AS (FROM b WHERE room % 2 = 0),
 i AS (SELECT page, tag, min(room) AS room FROM t JOIN z USING (page) WHERE t.x BETWEEN z.x - 0.05 AND z.x + 0.05 AND t.y BETWEEN z.y - 0.05 AND z.y + 0.05 GROUP BY ALL),
 li AS (SELECT page, tag, min(room) AS room FROM l JOIN z USING (page) WHERE l.x BETWEEN z.x - 0.05 AND z.x + 0.05 AND l.y BETWEEN z.y - 0.05 AND z.y + 0.05 GROUP BY ALL),
 n AS (SELECT page, tag, arg_min(room, (sqrt(pow(t.x - b.x, 2) + pow(t.y - b.y, 2)), room)) AS room FROM t JOIN b USING (page) WHERE sqrt(pow(t.x - b.x, 2) + pow(t.y - b.y, 2)) <= 0.1 GROUP BY ALL),
 ln AS (SELECT page, tag, arg_min(room, (sqrt(pow(l.x - b.x, 2) + pow(l.y - b.y, 2)), room)) AS room FROM l JOIN b USING (page) WHERE sqrt(pow(l.x - b.x, 2) + pow(l.y - b.y, 2)) <= 0.06 GROUP BY ALL)
 SELECT t.page, t.tag, coalesce(li.room, ln.room, i.room, n.room) AS room, CASE WHEN coalesce(li.room, ln.room) IS NOT NULL THEN 'LEADER' WHEN i.room IS NOT NULL THEN 'INSIDE' WHEN n.room IS NOT NULL THEN 'NEAREST' END AS how FROM t LEFT JOIN li USING (page, tag) LEFT JOIN ln USING (page, tag) LEFT JOIN i USING (page, tag) LEFT JOIN n USING (page, tag)""",
    "box_clusters": """WITH RECURSIVE b AS (SELECT p_partkey % 10 AS page, p_partkey AS k, p_partkey * 37 % 997 / 997.0 AS x, p_partkey * 53 % 991 / 991.0 AS y FROM part), e AS (SELECT p.page, p.k, q.k AS o FROM b p JOIN b q ON p.page = q.page AND p.x <= q.x + 0.04 AND q.x <= p.x + 0.04 AND p.y <= q.y + 0.04 AND q.y <= p.y + 0.04),
 r AS (SELECT page, k, k AS o FROM b UNION SELECT r.page, r.k, e.o FROM r JOIN e ON e.page = r.page AND e.k = r.o) SELECT page, k, min(o) AS cluster FROM r GROUP BY ALL""",
    "room_inventories": f"""WITH {W.VALUES}, v AS (SELECT *, part % 40 AS room FROM ev), r AS (SELECT DISTINCT supplier, room FROM v WHERE stage = 'PD' AND quantity > 40), t AS (SELECT supplier, room, list_sort(list(DISTINCT 't' || quantity)) AS tags FROM v WHERE stage = 'ID' AND quantity < 9 GROUP BY ALL)
 SELECT coalesce(r.supplier, t.supplier) AS supplier, coalesce(r.room, t.room) AS room, coalesce(array_to_string(tags, ','), '') AS tags, r.room IS NOT NULL AS labelled FROM r FULL JOIN t ON r.supplier = t.supplier AND r.room = t.room""",
    "merged_readings": """WITH b AS (SELECT p_partkey, p_name AS t, p_size / 50.0 AS s FROM part WHERE p_partkey % 4 > 0), x AS (SELECT p_partkey, p_type AS u, p_size * 7 % 50 / 50.0 AS v FROM part WHERE p_partkey % 3 = 0),
 j AS (SELECT coalesce(b.p_partkey, x.p_partkey) AS p_partkey, t, s, u, v, CASE WHEN s IS NULL AND v >= 0.5 THEN 'ADDED' WHEN s IS NULL THEN 'DROPPED' WHEN v >= 0.5 AND v >= s + 0.1 AND length(u) >= 0.8 * length(t) THEN 'REPLACED' ELSE 'KEPT' END AS origin FROM b FULL JOIN x ON b.p_partkey = x.p_partkey)
 SELECT p_partkey, CASE WHEN origin = 'KEPT' THEN t ELSE u END AS text, CAST(CASE WHEN origin = 'KEPT' THEN s ELSE v END AS DOUBLE) AS score, origin FROM j WHERE origin <> 'DROPPED'""",
    "agreed_elements": f"WITH {W.VALUES} SELECT param_code, count(*) AS agreed FROM (SELECT param_code, supplier FROM ev WHERE stage = 'PD' INTERSECT SELECT param_code, supplier FROM ev WHERE stage = 'RD') GROUP BY 1",
    "counterpart_score": f"""WITH {W.VALUES}, own AS (SELECT DISTINCT stage, supplier, part AS room FROM ev), sz AS (SELECT stage, supplier, count(*) AS n FROM own GROUP BY ALL), p AS (SELECT a.supplier AS page_a, b.supplier AS page_b, count(*) AS shared FROM own a JOIN own b USING (room) WHERE a.stage = 'PD' AND b.stage = 'RD' GROUP BY ALL HAVING count(*) >= 3),
 o AS (SELECT page_a, page_b, round(shared / least(x.n, y.n), 6) AS ov, round(shared / (x.n + y.n - shared), 6) AS ja FROM p JOIN sz x ON x.stage = 'PD' AND x.supplier = page_a JOIN sz y ON y.stage = 'RD' AND y.supplier = page_b), b AS (SELECT page_a, arg_min(page_b, (-ov, -ja, page_b)) AS page_b FROM o GROUP BY 1),
 c AS (SELECT s_suppkey AS page_a, s_suppkey % 10 + 1 AS cited FROM supplier) SELECT count(*) AS cited, count(*) FILTER (cited = page_b) AS hits, round(count(*) FILTER (cited = page_b) / count(*), 6) AS share FROM c LEFT JOIN b USING (page_a)""",
    "enriched_groups": "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE (SELECT min(l_suppkey) FROM lineitem WHERE l_orderkey = o_orderkey) END AS page FROM orders",
    "gold_capture": f"WITH {_LAST} SELECT check_id, c_mktsegment, decision, CASE decision WHEN 'CONFIRMED_VIOLATION' THEN 'POSITIVE' ELSE 'NEGATIVE' END AS label FROM latest JOIN customer ON c_custkey = check_id WHERE decision IN ('CONFIRMED_VIOLATION', 'NEGATIVE_VERIFIED')",
    "gold_seeds": "SELECT s_suppkey, s_nationkey AS code, n_name, n_name IS NOT NULL AS known FROM supplier LEFT JOIN (FROM nation WHERE n_nationkey < 20) ON n_nationkey = s_nationkey",
    "dispute_objects": f"WITH {_LAST} SELECT d.event_id, d.check_id, (SELECT CAST(l.check_id % 7 AS INTEGER) FROM latest l WHERE l.check_id = d.check_id) AS object_id, (SELECT l.decision FROM latest l WHERE l.check_id = d.check_id) AS last FROM decisions d WHERE decision = 'CLARIFICATION_REQUIRED'",
    "file_cards": f"WITH {W.FILES} SELECT file_id, object_id, pages, quality FROM files JOIN labels ON file_id = doc_id",
    "object_runs": "WITH r AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS run, count(*) AS runs FROM orders GROUP BY 1) SELECT c_custkey, run, coalesce(runs, 0) AS runs FROM customer LEFT JOIN r ON o_custkey = c_custkey",
    "decision_history": f"WITH {W.DECISIONS} SELECT check_id, count(*) AS n, coalesce(string_agg(CAST(reason_code AS VARCHAR), '>' ORDER BY ts, event_id), '') AS history FROM decisions GROUP BY 1",
    "protocol_tally": f"WITH {W.BEST} SELECT axis, count(*) AS n, count(*) FILTER (result = 'VIOLATION') AS violation, count(*) FILTER (result = 'EQUAL') AS equal, count(*) FILTER (result = 'IMPROVEMENT') AS improvement FROM diff GROUP BY GROUPING SETS ((axis), ())",
    "request_counters": "SELECT event_type, user_id % 5 AS route, CASE WHEN value > 100 THEN 500 ELSE 200 END AS status, count(*) AS n FROM events GROUP BY ALL",
    "block_levels": f"""WITH {_TR}, m AS (SELECT *, n % 10 = 0 AS total, (n - 1) // 10 AS g FROM t), b AS (SELECT table_id, g, sum(area) FILTER (NOT total) AS own, max(area) FILTER (total) AS printed FROM m GROUP BY ALL), k AS (SELECT table_id, row_number() OVER (PARTITION BY table_id ORDER BY g) AS r, g, own FROM b WHERE printed IS NOT NULL),
 x AS (SELECT table_id, g AS block, own, CASE WHEN g % 4 = 0 THEN own * 5 ELSE own END AS total FROM k), c AS (SELECT *, count(*) OVER w AS closed FROM x WINDOW w AS (PARTITION BY table_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
 l AS (SELECT *, CASE WHEN closed > 0 AND abs(total - own) > 0.05 AND total > 1.5 * own THEN 'GRAND' ELSE 'GROUP' END AS level FROM c), s AS (SELECT *, coalesce(sum(CASE WHEN level = 'GROUP' THEN total END) OVER w, 0) AS before, count(CASE WHEN level = 'GROUP' THEN 1 END) OVER w AS kk FROM l WINDOW w AS (PARTITION BY table_id ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
 SELECT table_id, block, level, level = 'GRAND' AND abs(total - before - own) > greatest(0.05, 0.05 * kk) AS unresolved FROM s""",
    "floor_totals": "SELECT o_orderstatus, o_custkey % 50 AS floor, arg_min(o_totalprice, (o_orderdate, o_orderkey)) AS total FROM orders GROUP BY ALL",
    "hedge_groups": f"""WITH {W.BEST}, h(param_code, hedge_set) AS (VALUES {_HEDGE}), t AS (SELECT location, hedge_set, param_code, max(confidence) AS c FROM diff JOIN h USING (param_code) WHERE result <> 'EQUAL' GROUP BY ALL)
 SELECT location, hedge_set, count(*) AS codes, arg_min(param_code, (-c, param_code)) AS kept, count(*) - 1 AS dropped FROM t GROUP BY ALL HAVING count(*) >= 2""",
    "label_counters": f"WITH {W.JUDGED} SELECT 'lang' AS kind, lang AS value, count(*) AS n FROM judged GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM judged GROUP BY ALL UNION ALL SELECT 'gold', CAST(gold AS VARCHAR), count(*) FROM judged GROUP BY ALL UNION ALL SELECT 'all', NULL, count(*) FROM judged",
    "order_buckets": "SELECT CASE WHEN o_totalprice > 300000 THEN 'BIG' WHEN o_orderpriority LIKE '1%' THEN 'URGENT' WHEN o_orderdate < '1994-01-01' THEN 'OLD' ELSE 'REST' END AS bucket, count(*) AS n FROM orders GROUP BY 1",
    "row_accuracy": "WITH c AS (SELECT l_suppkey, CAST(l_quantity AS INTEGER) AS q, count(*) FILTER (l_returnflag = 'A') AS t, count(*) FILTER (l_returnflag = 'R') AS p FROM lineitem GROUP BY ALL) SELECT l_suppkey, CAST(sum(t) AS BIGINT) AS rows, CAST(sum(least(t, p)) AS BIGINT) AS exact, round(sum(least(t, p)) / sum(t), 6) AS accuracy FROM c GROUP BY 1 HAVING sum(t) > 0",
    "binder_accuracy": "SELECT conv_id % 10 AS binder, round(avg(CAST(role = CASE WHEN turn = 0 THEN 'system' WHEN turn % 2 = 1 THEN 'user' ELSE 'assistant' END AS INTEGER)), 6) AS accuracy, count(*) AS pages FROM conversations GROUP BY 1",
    "revision_fingerprints": f"WITH {W.FILES}, p AS (SELECT DISTINCT object_id || '-' || (file_id % 13) AS revision, file_id || ':' || sha256 AS pair FROM files) SELECT revision, sha256(string_agg(pair, chr(10) ORDER BY pair)) AS fingerprint FROM p GROUP BY 1",
    "completeness": "SELECT p_brand, count(*) AS open, min(p_partkey) AS first FROM part WHERE p_size % 5 > 0 AND p_size % 3 <> 0 GROUP BY 1",
    "protocol_tables": f"""WITH {_FACTS}, k AS (SELECT param_code, axes < 3 AS a, bad > 6 AS b, bad <= 4 AND same > 0 AS c, better > 6 AS e FROM fa)
 SELECT param_code, 'A.1' AS "table" FROM k WHERE a UNION ALL SELECT param_code, 'A.2' FROM k WHERE b UNION ALL SELECT param_code, 'A.3' FROM k WHERE c UNION ALL SELECT param_code, 'A.4' FROM k WHERE e UNION ALL SELECT param_code, 'A.5' FROM k WHERE NOT (a OR b OR c OR e)""",
    "not_checked": f"WITH {W.VALUES}, v AS (SELECT part, param_code, count(DISTINCT stage) AS stages FROM ev GROUP BY ALL HAVING count(*) FILTER (stage = 'ID') = 0) SELECT param_code, count(*) AS parts, CAST(sum(stages) AS BIGINT) AS stages FROM v GROUP BY 1",
    "recommendation_rows": f"WITH {W.BEST}, t AS (SELECT p_brand AS param_code, min(p_name) AS text FROM part GROUP BY 1) SELECT axis AS section, param_code, location, text, row_number() OVER (PARTITION BY axis ORDER BY param_code, location) AS number FROM diff JOIN t USING (param_code) WHERE result = 'VIOLATION'",
    "input_registry": f"WITH {W.BEST}, c AS (SELECT expected_file AS k, arg_min(param_code, (location, param_code)) AS code, count(*) AS n FROM diff WHERE result = 'VIOLATION' GROUP BY 1) SELECT o_orderkey, k IS NOT NULL AS used, code, coalesce(n, 0) AS citations FROM orders LEFT JOIN c ON k = o_orderkey",
    "stage_counts": f"WITH {W.VALUES} SELECT stage, count(*) AS expected, count(*) FILTER (quality = 'OK' AND confidence >= 0.95) AS loaded FROM ev GROUP BY 1",
    "content_hashes": "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_name\":\"' || c_name || '\",\"segment\":' || CASE WHEN c_custkey % 5 > 0 THEN '\"' || c_mktsegment || '\"' ELSE 'null' END || '}') AS sha FROM customer",
    "counts_by_label": f"WITH {W.BEST} SELECT axis, param_code, count(*) AS n FROM diff WHERE result = 'VIOLATION' GROUP BY ALL",
    "object_scenarios": f"WITH {W.VALUES}, s AS (SELECT part, list_sort(list(DISTINCT stage)) AS s FROM ev GROUP BY 1) SELECT part, CASE WHEN len(s) = 3 THEN 'FULL' ELSE array_to_string(s, '_') END AS scenario FROM s",
    "code_folds": "SELECT CASE p_size % 4 WHEN 0 THEN 'F1' WHEN 3 THEN 'REST' ELSE 'F2' END AS fold, count(*) AS n FROM part GROUP BY 1",
    "file_summaries": "SELECT l_orderkey, count(*) AS pages, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS words, count(*) FILTER (l_discount > 0.05) AS to_read, min(CAST(l_quantity AS BIGINT)) AS least, max(CAST(l_quantity AS BIGINT)) AS most FROM lineitem GROUP BY 1",
    "acceptance_gates": f"WITH {_FACTS} SELECT param_code, 'G1_ALL_AXES' AS gate, axes = 3 AS passed FROM fa UNION ALL SELECT param_code, 'G2_FEW_BAD', bad < 7 FROM fa UNION ALL SELECT param_code, 'G3_SOME_SAME', same > 0 FROM fa UNION ALL SELECT param_code, 'G4_BALANCE', better <= 2 * bad FROM fa",
    "package_problems": """WITH p AS (SELECT p_partkey AS k, CASE WHEN p_size % 2 = 0 THEN 'SIDECAR' ELSE 'INDEX' END AS kind, md5(CAST(CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_partkey END AS VARCHAR)) AS sha FROM part UNION ALL SELECT p_partkey, 'SIDECAR', md5(CAST(p_partkey AS VARCHAR)) FROM part WHERE p_size > 30),
 c AS (SELECT k, kind, count(*) AS n, min(sha) AS a, max(sha) AS b FROM p GROUP BY ALL), d AS (SELECT s_suppkey, md5(CAST(s_suppkey AS VARCHAR)) AS sha, kind FROM supplier, (VALUES ('SIDECAR'), ('INDEX')) AS v(kind)),
 r AS (SELECT s_suppkey, CASE WHEN n IS NULL THEN 'MISSING_' || d.kind WHEN n > 1 THEN 'REPEATED_' || d.kind WHEN a <> sha OR b <> sha THEN 'OTHER_' || d.kind END AS problem FROM d LEFT JOIN c ON k = s_suppkey AND c.kind = d.kind) SELECT * FROM r WHERE problem IS NOT NULL""",
    "plan_cross_check": "WITH f AS (SELECT DISTINCT o_custkey AS k FROM orders), g AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 10 > 0) SELECT k, 'NO_GROUP' AS problem FROM f WHERE k NOT IN (FROM g) UNION ALL SELECT k, 'NO_FINDING' FROM g WHERE k NOT IN (FROM f)",
    "upserted_limits": "WITH u AS (SELECT c_custkey AS k, c_acctbal, c_custkey % 4 AS v, 0 AS new FROM customer UNION ALL SELECT s_suppkey * 3, s_acctbal, s_suppkey % 4, 1 FROM supplier) SELECT k, c_acctbal, v FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY v DESC, new DESC) AS rn FROM u) WHERE rn = 1",
    "merged_sections": "SELECT c_custkey, coalesce(CASE WHEN s_suppkey % 3 > 0 THEN s_name END, c_mktsegment) AS c_mktsegment, c_acctbal FROM customer LEFT JOIN supplier ON s_suppkey * 2 = c_custkey",
    "distinct_words": "WITH w AS (SELECT p_partkey % 30 AS page, p_type AS text, CAST(round(CAST(p_size / 50.0 AS DOUBLE) / 0.2) AS BIGINT) AS cx, CAST(round(CAST(p_partkey * 7 % 10 / 10.0 AS DOUBLE) / 0.2) AS BIGINT) AS cy, p_partkey FROM part) SELECT page, text, min(p_partkey) AS p_partkey FROM w GROUP BY page, text, cx, cy",
    "marked_totals": f"""WITH {_TR}, k AS (SELECT table_id, n, CASE WHEN n % 7 = 0 OR (n % 7 = 1 AND n % 3 = 0) THEN 'SUBTOTAL' ELSE 'DATA' END AS kind FROM t), m AS (SELECT table_id, n, CASE WHEN kind = 'SUBTOTAL' AND lag(kind) OVER (PARTITION BY table_id ORDER BY n) = 'SUBTOTAL' THEN 'TOTAL' ELSE kind END AS kind FROM k)
 SELECT table_id, kind, count(*) AS k, CAST(sum(n) AS BIGINT) AS places FROM m GROUP BY ALL""",
    "marked_subzones": f"""WITH {_TR}, a AS (SELECT table_id, n, area, area = 50 AS p, coalesce(lag(area) OVER (PARTITION BY table_id ORDER BY n) = 50, false) AS f FROM t), s AS (SELECT *, p OR (NOT f AND area >= 10) AS stop FROM a), g AS (SELECT *, sum(CAST(stop AS INTEGER)) OVER (PARTITION BY table_id ORDER BY n) AS run FROM s),
 h AS (SELECT table_id, n, stop, max(CASE WHEN p THEN n END) OVER (PARTITION BY table_id, run) AS parent FROM g) SELECT table_id, n, parent FROM h WHERE NOT stop AND parent IS NOT NULL""",
    "carried_registries": """WITH e AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN -1 WHEN role = 'assistant' THEN turn END AS ev FROM conversations), l AS (SELECT conv_id, turn, last_value(ev IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM e)
 SELECT conv_id, turn, CASE WHEN last >= 0 THEN CAST(last AS VARCHAR) END AS registry FROM l""",
    "current_revisions": "WITH p AS (SELECT o_custkey, o_orderpriority, max(o_orderdate) AS o_orderdate FROM orders GROUP BY ALL) SELECT o_custkey, max(o_orderpriority) AS o_orderpriority, arg_max(o_orderdate, o_orderpriority) AS o_orderdate FROM p GROUP BY 1",
    "gap_segments": """WITH w AS (SELECT l_orderkey, l_linenumber, l_suppkey AS a, l_suppkey + CAST(l_quantity AS INTEGER) AS b FROM lineitem), g AS (SELECT *, CASE WHEN a - max(b) OVER (PARTITION BY l_orderkey ORDER BY a, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) <= 5 THEN 0 ELSE 1 END AS new FROM w)
 SELECT l_orderkey, l_linenumber, CAST(sum(new) OVER (PARTITION BY l_orderkey ORDER BY a, l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS segment FROM g""",
    "reading_order": "SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_suppkey % 3, CASE WHEN l_suppkey % 3 = 2 THEN -l_suppkey ELSE l_partkey END, l_linenumber) AS place FROM lineitem",
    "split_bands": "WITH l AS (SELECT doc_id, list_filter(string_split(coalesce(text, ''), chr(10)), lambda s: trim(s) <> '') AS lines FROM documents) SELECT doc_id, len(lines) AS lines, len(lines) - 1 AS last FROM l WHERE len(lines) > 0",
    "anchor_pools": f"WITH {W.VALUES}, p AS (SELECT DISTINCT stage, param_code, location, supplier FROM ev), a AS (SELECT stage, param_code, count(DISTINCT supplier) AS n FROM p GROUP BY ALL) SELECT stage, param_code, location, count(*) AS rooms, round(count(*) / any_value(n), 6) AS share FROM p JOIN a USING (stage, param_code) GROUP BY stage, param_code, location",
}
