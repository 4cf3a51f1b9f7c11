"""Literal rows for operators, functions, readers and writers."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyframe.functions import rules, text
from tallyframe.operators import findings, phrases, registry, reports, scoring, sequences, spatial, values
from tallyframe.sources import readers, sinks
from tallyframe.streaming import streams


def one(spark, column, ddl="x int", row=(1,)):
    return spark.createDataFrame([row], ddl).select(column.alias("v")).first()[0]


@pytest.mark.parametrize(
    ("raw", "want"),
    [("23 450,75", 23450.75), ("−7", -7.0), ("88.", 88.0), ("нет данных", None), ("1/2", None), ("", None), (None, None), ("+0,25", 0.25)],
)
def test_parse_number(spark, raw, want):
    assert one(spark, text.parse_number(F.lit(raw).cast("string"))) == want


def test_units_marks_and_dates(spark):
    assert one(spark, text.norm_unit(F.lit("кв. м"))) == "м²"
    assert one(spark, text.norm_unit(F.lit("куб. м"))) == "м³"
    assert one(spark, text.norm_unit(F.lit("Га"))) == "га"
    assert one(spark, text.norm_unit(F.lit("фут"))) is None
    assert one(spark, text.expand_mark(F.lit("К4.1,3,6 (подача)"))) == ["К4.1", "К4.3", "К4.6"]
    assert one(spark, text.expand_mark(F.lit("Т9.5, 9.6"))) == ["Т9.5", "Т9.6"]
    assert one(spark, text.expand_mark(F.lit("B2.1"))) == ["В2.1"]
    assert one(spark, text.expand_mark(F.lit(""))) == []
    assert str(one(spark, text.parse_date(F.lit("05.03.2021")))) == "2021-03-05"
    assert str(one(spark, text.parse_date(F.lit("5.3.21")))) == "2021-03-05"
    assert one(spark, text.parse_date(F.lit("31.02.2021"))) is None
    assert one(spark, text.room_list(F.lit("пом. 267, 270–272"))) == [267, 270, 271, 272]
    assert [one(spark, text.plural_ru(F.lit(n), "лист", "листа", "листов")) for n in (1, 2, 5, 11, 21, 112)] == ["лист", "листа", "листов", "листов", "лист", "листов"]
    assert one(spark, text.code_key(F.lit("ab-12.3 c"))) == text_key("ab123c")
    assert one(spark, text.member_path_problems(F.lit("../x"))) == ["PARENT"]
    assert one(spark, text.member_path_problems(F.lit("/x"))) == ["ABSOLUTE"]
    assert one(spark, text.sheet_number(F.lit("Лист 12 план"))) == 12
    t = one(spark, text.parse_tolerance(F.lit("+10/-5")))
    assert (t["plus"], t["minus"]) == (10.0, 5.0)
    assert one(spark, text.sentences(F.lit("Один. Два! три? Четыре"))) == ["Один.", "Два! три?", "Четыре"]
    assert one(spark, text.box_iou(F.array(*map(F.lit, (0.0, 0.0, 2.0, 2.0))), F.array(*map(F.lit, (1.0, 1.0, 3.0, 3.0))))) == pytest.approx(1 / 7)
    windows = one(spark, text.text_windows(F.lit("a" * 50), 20, 5))
    assert windows[0]["at"] == 0 and windows[-1]["at"] + 20 >= 50


def text_key(s):
    return s.upper().translate(str.maketrans(text.LATIN, text.CYRILLIC))


T, N, U = True, False, None


@pytest.mark.parametrize(("a", "b"), [(a, b) for a in (T, N, U) for b in (T, N, U)])
def test_kleene(spark, a, b):
    rows = spark.createDataFrame([(a, b)], "a boolean, b boolean")
    got = rows.select(rules.compile_rule({"and": [{"var": "a"}, {"var": "b"}]}, rows), rules.compile_rule({"or": [{"var": "a"}, {"var": "b"}]}, rows)).first()
    assert tuple(got) == (N if N in (a, b) else U if U in (a, b) else T, T if T in (a, b) else U if U in (a, b) else N)


@pytest.fixture(scope="module")
def check(spark):
    row = spark.createDataFrame([(None, [], [1, None, 3], [1, 2], 0, "абв", "", "2,5", 0.1, 0.2, {"k": [{"x": 1.0}, {"x": 2.0}]}, ["p", "q"])], "u boolean, e array<int>, n array<int>, k array<int>, z int, t string, b string, d string, f double, g double, r struct<k: array<struct<x: double>>>, w array<string>")
    return lambda rule: row.select(rules.compile_rule(rule, row).alias("v")).first()[0]


def test_rules_where_sql_differs(check):
    assert check({"if": [{"var": "u"}, 1, 2]}) is None
    assert check({"if": [{"==": [{"var": "z"}, 0]}, 1, 2]}) == 1
    assert check({"all": [{"var": "e"}, {">": [{"var": ""}, 0]}]}) is False
    assert check({"none": [{"var": "e"}, {">": [{"var": ""}, 0]}]}) is True
    assert check({"max": [{"var": "n"}]}) is None
    assert check({"max": [{"var": "k"}]}) is None
    assert check({"max": [3, {"var": "k.1"}]}) == 3.0
    assert check({"/": [1, {"var": "z"}]}) is None
    assert check({"round": [2.5]}) == 2
    assert check({"sum": [{"var": "n"}]}) is None
    assert check({"count": [{"var": "k"}, {">": [{"var": ""}, 1]}]}) == 1
    assert check({"missing": ["u", "z", "nowhere.x"]}) == ["u", "nowhere.x"]
    assert check({"in": [2, [1, 2]]}) is True
    assert check({"filter": [{"var": "n"}, {">": [{"var": ""}, 1]}]}) is None


@pytest.mark.parametrize(
    ("rule", "want"),
    [
        ({"!!": [{"var": "t"}]}, T), ({"!!": [{"var": "b"}]}, N), ({"!!": [{"var": "k"}]}, T), ({"!!": [{"var": "e"}]}, N), ({"!!": [{"var": "absent"}]}, U), ({"!!": [{"var": "r"}]}, T),
        ({"!": [0]}, T), ({"and": [1, {"var": "t"}]}, T), ({"or": [0, {"var": "absent"}]}, U), ({"or": [0, {"var": "absent"}, {"var": "w"}]}, T),
        ({"in": [2, {"var": "k"}]}, T), ({"in": [2.0, {"var": "n"}]}, N), ({"in": ["p", {"var": "w"}]}, T), ({"in": [1, {"var": "t"}]}, N), ({"in": ["б", {"var": "t"}]}, T), ({"in": [1, {"var": "z"}]}, U), ({"in": [1, ["x", 1]]}, T),
        ({"merge": [1, {"var": "k"}, {"var": "absent"}]}, [1, 1, 2]), ({"merge": []}, []), ({"merge": [{"var": "w"}, "x"]}, ["p", "q", "x"]),
        ({"==": [{"var": "t"}, 1]}, N), ({"==": [{"+": [{"var": "f"}, {"var": "g"}]}, 0.3]}, T), ({"==": [{"+": [0.1, {"var": "g"}]}, {"+": [{"var": "f"}, 0.2]}]}, T), ({"==": [1e12, 1e12 + 0.5]}, N), ({"!=": [{"var": "absent"}, 1]}, U), ({"==": [True, 1]}, T),
        ({"<": [{"var": "d"}, 3]}, T), ({"<": [{"var": "t"}, 3]}, U), ({"<": [1, {"var": "k.1"}, 3]}, T), ({"<": ["a", "b"]}, T), ({">": [{"var": "absent"}, 0]}, U),
        ({"var": ["absent", 7]}, 7), ({"var": "k.-1"}, 2), ({"var": "k.9"}, None), ({"var": "r.k.1.x"}, 2.0), ({"missing_some": [1, ["z", "absent"]]}, []), ({"missing_some": [2, ["z", "absent"]]}, ["absent"]),
        ({"some": [{"var": "n"}, {">": [{"var": ""}, 2]}]}, T), ({"some": [{"var": "n"}, {">": [{"var": ""}, 5]}]}, U), ({"all": [{"var": "r.k"}, {"<": [{"var": "x"}, {"var": "^g"}]}]}, N), ({"some": [{"var": "z"}, True]}, U),
        ({"map": [{"var": "r.k"}, {"*": [{"var": "x"}, 2]}]}, [2.0, 4.0]), ({"sum": [{"var": "r.k"}, {"var": "x"}]}, 3.0), ({"+": [1e16, 1.0, -1e16]}, 1.0), ({"-": [{"var": "d"}]}, -2.5), ({"min": [1, {"var": "absent"}]}, None), ({"round": [1234.567, -2]}, 1200.0), ({"abs": [-3]}, 3.0),
    ],
)
def test_rule_language(check, rule, want):
    assert check(rule) == want


def test_rules_are_checked():
    assert rules.validate({"var": [1, 2, 3]}) and not rules.validate({"and": [True]}) and not rules.validate({"var": []})
    assert rules.validate({"frob": [1]}) == ["/: unknown operator frob"]
    assert rules.validate({"and": [1, {"==": [1]}]}) == ["/and/1: == with 1 arguments"]
    assert rules.validate({"a": 1, "b": 2}) == ["/: an operation has one key"]
    deep = True
    for _ in range(60):
        deep = {"!": [deep]}
    assert "deeper than 48" in rules.validate(deep)[0]
    assert "more than 20000" in rules.validate([0] * 20_001)[0]
    with pytest.raises(ValueError, match="in one place"):
        rules.compile_rule({"if": [True, 1, "x"]}, rules.T.StructType([]))


def test_comparisons(spark):
    r = spark.createDataFrame([(10.0, 10.2), (10.0, 9.0), (10.0, 12.0), (None, 1.0)], "e double, a double")
    assert [x[0] for x in r.select(values.pairwise_delta(F.col("e"), F.col("a"), relative=0.03)).collect()] == ["EQUAL", "VIOLATION", "IMPROVEMENT", "ABSTAIN"]
    assert [x[0] for x in r.select(values.outside_bounds(F.col("a"), F.lit(9.5), F.lit(11.0))).collect()] == ["WITHIN_BOUNDS", "OUTSIDE_BOUNDS", "OUTSIDE_BOUNDS", "OUTSIDE_BOUNDS"]
    d = values.dominant(spark.createDataFrame([("k", 1)] * 4 + [("k", 2)] * 2, "k string, value int"), ["k"]).first()
    assert (d["value"], d["dominates"]) == (1, True)
    rooms = spark.createDataFrame([("PD", 1, "A", 1), ("PD", 1, "B", 1), ("ID", 1, "A", 1), ("ID", 2, "B", 1)], "stage string, room int, label string, page int")
    assert {x["room"]: x["result"] for x in values.room_outcomes(rooms, "room", "label", "page", "stage", "PD", "ID").collect()} == {1: "RELOCATED", 2: "EXTRA"}
    empty = spark.createDataFrame([], "k string, value int")
    assert values.dominant(empty, ["k"]).collect() == []


def test_sum_check_finds_double_count(spark):
    rows = [("t", i, 104.95, False) for i in range(10)] + [("t", 10, 30.4, False), ("t", 11, 1079.9, True)]
    x = sequences.sum_checks(spark.createDataFrame(rows, "t string, n int, area double, total boolean"), "t", ["n"], F.col("total"), "area").first()
    assert x["ok"] and x["sum"] == pytest.approx(1079.9)


def test_findings(spark):
    assert one(spark, findings.document_status(F.array(F.lit("PD"), F.lit("ID")))) == "PD_ID_AVAILABLE_RD_MISSING"
    assert one(spark, findings.document_status(F.array().cast("array<string>"))) == "PD_RD_ID_MISSING"
    rows = spark.createDataFrame([("o", f"h{i}", 0.9 - i / 10, i % 2 == 0) for i in range(8)], "o string, f string, p double, hedge boolean")
    assert findings.hedge_budget(rows, "o", "p", "f", "hedge", 0.5).where("accepted and hedge").count() == 2
    stages = spark.createDataFrame([("a", "PD", 4), ("a", "RD", 1), ("b", "PD", 2), ("b", "RD", 1)], "k string, stage string, weight int")
    got = {r["k"]: r["stage"] for r in registry.stage_votes(stages, "k").collect()}
    assert got == {"a": "PD", "b": None}
    codes = spark.createDataFrame([("AB1",), ("XY9",), ("AAA",)], "code string")
    known = spark.createDataFrame([("AB2",), ("XY9",), ("AAB",), ("ACA",)], "code string")
    assert [tuple(r) for r in registry.near_codes(codes, known, "code").collect()] == [("AB1", "AB2")]


def test_reports_and_scores(spark):
    n = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "k string, n int")
    assert sorted(r["percent"] for r in reports.adjusted_percents(n, "k", "n").collect()) == [33.3, 33.3, 33.4]  # three rows don't fit one tenth, so the first row takes it
    assert reports.balanced([]) == [] and reports.balanced([0, 0]) == [0, 0] and reports.balanced([5]) == [1000]
    assert reports.balanced([1, 1, 4]) == [167, 167, 666]  # two wronged rows don't fit one tenth, the third does
    assert reports.balanced([1, 1, 1, 1, 1, 1, 1]) == [142, 143, 143, 143, 143, 143, 143]
    for counts in ([3, 3, 5, 7, 11, 13], [1] * 30, [997, 1, 1, 1], [2, 2, 2, 1]):
        assert sum(reports.balanced(counts)) == 1000
    many = spark.range(100_000).select(F.lit("g").alias("g"), "id")
    assert len(many.groupBy("g").agg(registry.multiset_hash(many, [F.col("id")]).alias("h")).first()["h"]) >= 23
    c = scoring.prf(spark.createDataFrame([(0, 0, 0), (10, 3, 0)], "tp int, fp int, fn int")).orderBy("tp").collect()
    assert (c[0]["f1"], c[1]["f1"]) == (0.0, pytest.approx(0.869565))
    low, high = scoring.wilson(F.lit(0), F.lit(0))
    assert (one(spark, low), one(spark, high)) == (0.0, 1.0)
    assert one(spark, scoring.gate(F.lit(92.0), F.lit(True))) == 59.0
    t = spark.createDataFrame([(1, "x", 1), (2, "y", 1), (3, "z", 2)], "k int, sha string, row_version int")
    s = spark.createDataFrame([(1, "x"), (2, "Y"), (4, "n")], "k int, sha string")
    assert {r["k"]: (r["action"], r["row_version"]) for r in reports.merge(t, s, "k", "sha").collect()} == {1: ("UNCHANGED", 1), 2: ("UPDATE", 2), 3: ("SUPERSEDE", 2), 4: ("INSERT", 1)}


def test_spatial(spark):
    p = spark.createDataFrame([(1, "p", 0.5, 0.5), (1, "far", 0.0, 0.0)], "page int, key string, x double, y double")
    names = spark.createDataFrame([(1, "near", 0.52, 0.5), (1, "off", 0.9, 0.9)], "page int, label string, x double, y double")
    assert [(r["key"], r["label"]) for r in spatial.nearest(p, names, "page", "key", "label", 0.1).collect()] == [("p", "near")]
    zones = spark.createDataFrame([(1, "z", [0.4, 0.4, 0.6, 0.6])], "page int, zone string, box array<double>")
    assert [r["key"] for r in spatial.inside(p, zones, "page", "key", "zone").collect()] == ["p"]
    cover = spark.createDataFrame([(1, "c", [0.4, 0.4, 0.5, 0.6])], "page int, c string, box array<double>")
    got = spatial.coverage(zones.withColumnRenamed("zone", "k"), cover, "page", "k", "c").first()
    assert got["covered"] == pytest.approx(0.5)


def test_phrases(spark):
    docs = spark.createDataFrame([(1, "The red fox. The red fox!"), (2, "red the fox"), (3, None)], "d int, text string")
    names = spark.createDataFrame([(7, "the RED fox")], "p int, text string")
    assert [tuple(r) for r in phrases.phrase_hits(docs, names, "d", "p").collect()] == [(7, 1, 2)]
    more = spark.createDataFrame([(1, "the the the of the"), (1, "the the"), (1, "the the"), (2, "of"), (None, "of the")], "d int, text string")
    names = spark.createDataFrame([(1, "the the"), (2, "of the"), (3, "of absent"), (4, ""), (5, None)], "p int, text string")
    got = {(r["p"], r["d"]): r["hits"] for r in phrases.phrase_hits(more, names, "d", "p").collect()}
    assert got == {(1, 1): 4, (2, 1): 1, (2, None): 1}
    stems = phrases.phrase_hits(spark.createDataFrame([(1, "walls and windows")], "d int, text string"), spark.createDataFrame([(1, "walled and window")], "p int, text string"), "d", "p", stem=4)
    assert [tuple(r) for r in stems.collect()] == [(1, 1, 1)]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join([json.dumps({"file_id": "F1", "stage": "PD", "sha256": "a", "object_id": "o", "relative_path": "x"}), "{broken", json.dumps({"file_id": "F2", "stage": "??", "object_id": "h"}), json.dumps({"file_id": "F2", "object_id": "o"})]))
    files, flags = readers.manifest(spark, str(tmp_path / "m.jsonl"), {"stage": ("PD", "RD", "ID")})
    assert files.count() == 3
    assert sorted(r["code"] for r in flags.collect()) == ["MALFORMED_ROW", "REPEATED_ID", "UNKNOWN_WORD"]
    policy = spark.createDataFrame([("TEST_HIDDEN", "h")], "split string, object_id string")
    assert readers.visible(files, policy).count() == 2
    good, bad = readers.artifacts(spark.createDataFrame([("F1", "a"), ("F1", "b"), ("F9", "a")], "file_id string, sha256 string"), files)
    assert good.count() == 1 and sorted(r["reason"] for r in bad.collect()) == ["OTHER_CONTENT", "UNKNOWN_FILE"]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "x")
        z.writestr("../two.txt", "y")
    (tmp_path / "b.zip").write_bytes(b"PK\x03\x04no")
    members = readers.archive_members(readers.binaries(spark, str(tmp_path), "*.zip")).collect()
    assert sorted((r["member"] or "", r["problem"] or "", *r["unsafe"]) for r in members) == [("", "NOT_AN_ARCHIVE"), ("../two.txt", "", "PARENT"), ("in/one.txt", "")]
    (tmp_path / "r.csv").write_text("Файл,Стадия\n A.pdf ,PD\n")
    assert tuple(readers.registry_csv(spark, str(tmp_path / "r.csv")).first()) == ("a.pdf", "PD", None)
    sinks.write_jsonl(files.select("file_id"), str(tmp_path / "run/values"), ("file_id",))
    index = sinks.artifacts_index(spark, str(tmp_path / "run")).collect()
    assert index and all(len(r["sha256"]) == 64 for r in index)
    history = spark.createDataFrame([("o", 1, "a"), ("o", 2, "a"), ("o", 3, "b")], "k string, t int, sha string")
    assert [(r["t"], r["version"], r["state"]) for r in sinks.versions(history, "k", ["t"], "sha").orderBy("t").collect()] == [(1, 1, "SUPERSEDED"), (3, 2, "CURRENT")]
    m = spark.createDataFrame([("up", "h", "gauge", {"a": "1"}, 2.0)], "name string, help string, type string, labels map<string,string>, value double")
    assert sinks.prometheus(m).first()["text"] == '# HELP up h\n# TYPE up gauge\nup{a="1"} 2.0'
    valid, rest = readers.expect(files, {"sha": F.length("sha256") == 1})
    assert valid.count() == 1 and rest.count() == 2


def test_stream_late_rows_and_retries(spark, tmp_path):
    rows = [(1, "2024-01-01 00:00:00"), (2, "2024-01-01 00:01:00"), (1, "2024-01-01 00:20:00")]
    spark.createDataFrame(rows, "k int, t string").select("k", F.to_timestamp("t").alias("ts")).write.parquet(str(tmp_path / "in"))
    stream = streams.events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 10)
    streams.run_updates(streams.window_counts(stream, "ts", "k", "5 minutes"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert streams.newest(spark, str(tmp_path / "out"), ["start", "k"]).agg(F.sum("n")).first()[0] == 3
    streams.close(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, "ts", "2024-02-01")
    streams.run_to_files(streams.window_counts(streams.events(spark, str(tmp_path / "in"), spark.read.parquet(str(tmp_path / "in")).schema, 10), "ts", "k", "5 minutes"), str(tmp_path / "closed"), str(tmp_path / "state2"))
    assert spark.read.parquet(str(tmp_path / "closed")).agg(F.sum("n")).first()[0] == 3
    failed = spark.createDataFrame([(1, "FAILED", 1, "2024-01-01 00:00:00"), (2, "FAILED", 2, "2024-01-01 00:00:00"), (3, "FAILED", 4, "2024-01-01 00:00:00")], "id int, status string, attempts int, last_attempt string")
    assert [r["id"] for r in streams.attempts_due(failed, "2024-01-01 00:02:00").collect()] == [1]
