"""Literal rows for the review workflow."""

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import workflow as K


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_predicates(spark):
    null = F.lit(None).cast("string")
    assert one(spark, K.reviewable(F.lit("ACTIVE"), F.lit("x"), null)) is True
    assert one(spark, K.reviewable(F.lit("ACTIVE"), null, null)) is False
    assert one(spark, K.not_citable_reasons(F.lit(True), F.lit("DRAFT"), F.lit(0))) == ["EXCLUDED", "ANNOTATION", "NO_PAGES"]
    assert one(spark, K.stage_accepts(F.lit("RD_ID_MIXED"), F.lit("ID"))) is True
    assert one(spark, K.page_in_range(F.lit(0), F.lit(3))) is False
    names = spark.createDataFrame([("50%_off",), ("50 off",), (None,)], "n string")
    assert [r["n"] for r in names.where(K.contains_text(F.col("n"), "0%_O")).collect()] == ["50%_off"]
    assert names.transform(lambda x: K.where_given(x, {"n": None})).count() == 3
    assert one(spark, K.holds_object(F.lit('{"objects":[{"object_id":"a"}]}'), "a")) is True
    assert one(spark, K.in_discipline(F.array().cast("array<string>"), F.array(F.lit("x")))) is True
    assert one(spark, K.gold_label(F.lit("CONFIRMED"), F.lit("SYSTEM"))) is None
    assert one(spark, K.process_status(F.lit("IN_REVIEW"), F.lit(0), F.lit(0))) == "READY"


def test_decisions(spark):
    checks = spark.createDataFrame([(1, "PENDING"), (2, "REJECTED")], "k int, status string")
    made = spark.createDataFrame([(1, "CONFIRMED_VIOLATION"), (2, "CONFIRMED_VIOLATION")], "k int, decision string")
    assert {r["k"]: (r["next_status"], r["allowed"]) for r in K.decided(checks, made, "k").collect()} == {1: ("CONFIRMED", True), 2: ("REJECTED", False)}
    hits = lambda *x: F.array(*[F.struct(F.lit(v).alias("verdict"), F.lit(c).alias("confidence")) for v, c in x])
    assert tuple(one(spark, K.rejection_verdict(hits(("AGREE", 0.2), ("DISAGREE", 0.9))))) == ("DISAGREE", 0.9)
    assert tuple(one(spark, K.rejection_verdict(hits(("UNCERTAIN", 0.7), ("UNCERTAIN", 0.4))))) == ("UNCERTAIN", 0.4)
    assert tuple(one(spark, K.rejection_verdict(hits(("AGREE", 0.2))))) == ("AGREE", pytest.approx(0.9))


def test_files_and_evidence(spark):
    files = spark.createDataFrame([("F1", "a", "A/x.pdf", "p"), ("F2", "b", "B/y.pdf", "p"), ("F3", "a", "c", "q")], "file_id string, sha256 string, relative_path string, resolved_path string")
    disk = spark.createDataFrame([("a\\X.pdf", 1, "a"), ("new.pdf", 5, "z")], "relative_path string, size_bytes int, sha256 string")
    assert [r["relative_path"] for r in K.unclaimed(disk, files).collect()] == ["new.pdf"]
    lost = spark.createDataFrame([("F9", 5, "z"), ("F8", 5, "y")], "file_id string, size_bytes int, sha256 string")
    assert [tuple(r) for r in K.recovered(lost, disk).collect()] == [("F9", "new.pdf")]
    assert {r["file_id"] for r in K.shared_path_conflicts(files).collect()} == {"F1", "F2"}
    members = spark.createDataFrame([("z1", "m1", "a"), ("z1", "m2", "n"), ("z2", "m3", "n"), ("z2", "m4", None)], "archive string, member string, sha256 string")
    assert {r["member"]: (r["role"], r["twin"]) for r in K.member_roles(members, files).collect()} == {"m1": ("DUPLICATE", "F1"), "m2": ("NEW", None), "m3": ("REPEATED", None), "m4": ("NEW", None)}
    e = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit("F1").alias("file_id"), F.lit(p).alias("page")) for s, p in (("PD", 1), ("PD", 1), ("RD", 1))])
    assert [x["stage"] for x in one(spark, K.evidence_deduplicated(e))] == ["PD", "RD"]
    c = spark.createDataFrame([("k", 1, ["a", "b"]), ("k", 2, ["a"]), ("k", 3, ["c"])], "k string, r int, f array<string>")
    assert {x["r"]: x["host"] for x in K.twins_merged(c, "k", "f", "r").collect()} == {1: None, 2: 1, 3: None}
    o = spark.createDataFrame([(1, "a", True), (2, "b", True)], "k int, name string, active boolean")
    assert {x["k"]: (x["name"], x["active"]) for x in K.overridden(o, spark.createDataFrame([(2, None, False)], "k int, name string, active boolean"), "k", ["name", "active"]).collect()} == {1: ("a", True), 2: ("b", False)}
    with pytest.raises(ValueError, match="lacks"):
        K.rules_table('{"rules": [{"id": 1}]}')


def test_shared_values_sentences_and_keys(spark):
    from tallyframe.functions import text as T
    from tallyframe.operators import reports, sequences, values

    v = spark.createDataFrame([("k", 1, "PD", 0.5), ("k", 1, "RD", 0.9), ("k", 2, "PD", 0.99), ("k", 2, "ID", 0.2), ("k", 3, "ID", 1.0)], "k string, value int, stage string, confidence double")
    assert [tuple(r) for r in values.shared_value(v, ["k"]).collect()] == [("k", 2, 2)]
    t = spark.createDataFrame([("OK", 1, "p", "ГПЗУ"), ("OK", 1, "p", None)], "quality string, candidate_rank int, param_code string, basis string")
    assert values.trusted(t).count() == 1 and values.trusted(t.drop("basis")).count() == 2
    assert one(spark, T.whole_sentences(F.lit("См. рис. 5 на стр. 7. Далее А. Петров. Конец!"))) == ["См. рис. 5 на стр. 7.", "Далее А. Петров.", "Конец!"]
    assert [one(spark, T.location_key(F.lit(x).cast("string"), m)) for x, m in ((" Пом. № 012-а", "light"), ("Помещение 012-а", "relaxed"), (" x", "strict"), (None, "light"))] == ["012-а", "12а", " x", "object"]
    assert one(spark, T.sorted_json_sha256(b=F.lit(1), a=F.lit(None).cast("string"))) == one(spark, F.sha2(F.lit('{"a":null,"b":1}'), 256))
    marks = spark.createDataFrame([("r", "В1.2"), ("r", "В1.3"), ("r", "В1.3"), ("r", "П2")], "r string, m string")
    assert {x["system"]: x["marks"] for x in T.system_counts(marks, ["r"], "m").collect()} == {"В1": 2, "П2": 1}
    x, y = T.cropped_point(F.lit(0.5), F.lit(0.5), (0.25, 0.0, 0.75, 1.0))
    assert (one(spark, x), one(spark, y)) == (0.5, 0.5)
    assert tuple(one(spark, reports.indicator_reason(F.lit(0), F.lit(2), F.lit(1)))) == ("YELLOW", "pending=2")
    assert tuple(one(spark, reports.indicator_reason(F.lit(0), F.lit(0), F.lit(0)))) == ("NONE", "no decisions")
    n = spark.createDataFrame([(k, k % 2) for k in range(7)], "k int, g int")
    assert [(r["k"], r["total"]) for r in sequences.page_with_total(n, [F.col("k")], 2, 2).collect()] == [(2, 7), (3, 7)]
    first, passed = sequences.first_of_key(n, ["g"], ["k"])
    assert sorted(tuple(r) for r in first.collect()) == [(0, 0), (1, 1)] and {r["g"]: r["passed_over"] for r in passed.collect()} == {0: 3, 1: 2}
    assert reports.last_rows(n, "g", [F.desc("k")], 1).count() == 2
