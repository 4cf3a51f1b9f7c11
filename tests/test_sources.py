"""Readers and writers on literal files."""

import json
import zipfile

from pyspark.sql import functions as F

from tallyframe.sources import readers, sinks


def test_registry_archive_and_errors(spark, tmp_path):
    (tmp_path / "r.json").write_text(json.dumps([{"Файл": " A.pdf ", "Стадия": "PD"}, {"Файл": None, "Стадия": "RD"}]))
    assert [tuple(r) for r in readers.registry_json(spark, str(tmp_path / "r.json")).collect()] == [("a.pdf", "PD", None)]
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("in/one.txt", "hello")
    (tmp_path / "b.zip").write_bytes(b"no")
    files = readers.binaries(spark, str(tmp_path), "*.zip")
    name = lambda r: r["path"].rsplit("/", 1)[-1]
    got = {name(r): (bytes(r["content"]) if r["content"] is not None else None, r["problem"]) for r in readers.archive_member(files, "in/one.txt").collect()}
    assert got == {"a.zip": (b"hello", None), "b.zip": (None, "NOT_AN_ARCHIVE")}
    assert {r["problem"] for r in readers.archive_member(files, "../x").collect()} == {"UNSAFE_NAME"}
    assert {name(r): r["problem"] for r in readers.archive_member(files, "in/one.txt", most=3).collect()}["a.zip"] == "TOO_LARGE"
    assert {name(r): r["problem"] for r in readers.archive_member(files, "none").collect()}["a.zip"] == "NO_MEMBER"
    (tmp_path / "e.jsonl").write_text('{"a": 1, "b": "x"}\n{"a": null, "b": "y"}\nnot json\n')
    rows, errors = readers.typed_jsonl(spark, str(tmp_path / "e.jsonl"), "a int, b string", ("a",))
    assert rows.count() == 1 and sorted(r["code"] for r in errors.collect()) == ["MALFORMED", "MISSING_A"]


def test_tokens(spark, tmp_path):
    rows = [("F1", 1, 0, "two words", [0.0, 0.0, 0.4, 0.1], 100, 50, "s1"), ("F1", 1, 1, " ", [0.5, 0.5, 0.6, 0.6], 100, 50, "s1"), ("F1", 2, 2, "x", [0.5, 0.5, 0.6, 0.6], 100, 50, "s1")]
    tokens = spark.createDataFrame(rows, "file_id string, page_no int, id int, text string, bbox array<double>, width int, height int, sha256 string")
    got = [(r["text"], r["x0"], r["x1"]) for r in readers.token_words(tokens).orderBy("page_no", "id", "word_no").collect()]
    assert got == [("two", 0.0, 20.0), ("words", 20.0, 40.0), ("x", 50.0, 60.0)]
    assert [r["id"] for r in readers.region_tokens(tokens, "F1", 1, (0.1, 0.0, 0.3, 0.2)).collect()] == [0]
    for _ in range(2):
        sinks.write_token_cache(tokens.select("sha256", "page_no", "text"), str(tmp_path / "cache"), "v1")
    sinks.write_token_cache(tokens.select("sha256", "page_no", "text"), str(tmp_path / "cache"), "v2")
    cache = spark.read.parquet(str(tmp_path / "cache"))
    assert {(r["pipeline_version"], r["n"]) for r in cache.groupBy("pipeline_version").agg(F.count("*").alias("n")).collect()} == {("v1", 2), ("v2", 2)}


def test_manifest_and_index(spark, tmp_path):
    (tmp_path / "m.jsonl").write_text("\n".join(json.dumps({"file_id": f, "object_id": o, "relative_path": p, "sha256": "a"}) for f, o, p in [("F1", "o", "b"), ("F1", "o", "a"), ("F2", "h", "c"), ("F3", "o", "d")]))
    policy = spark.createDataFrame([("TEST_HIDDEN", "h")], "split string, object_id string")
    files, flags = readers.loaded_manifest(spark, str(tmp_path / "m.jsonl"), spark.createDataFrame([("F3",)], "file_id string"), policy)
    assert [(r["file_id"], r["relative_path"]) for r in files.collect()] == [("F1", "a")] and flags.count() == 1
    index = spark.createDataFrame([("a", "1", 5), ("b", "2", 5), ("c", "3", 5)], "path string, sha256 string, size bigint")
    found = spark.createDataFrame([("a", "1", 5), ("b", "9", 5), ("d", "3", 5)], "path string, sha256 string, size bigint")
    assert {tuple(r) for r in readers.checked_index(index, found).collect()} == {("b", "OTHER_CONTENT"), ("c", "MISSING"), ("d", "NOT_LISTED")}
    run = tmp_path / "run"
    (run / "x").mkdir(parents=True)
    (run / "x" / "p.json").write_text('{"k": 1}')
    (run / "x" / "p.sidecar.json").write_text('{"k": 2}')
    assert [(r["k"], r["source"]) for r in readers.run_predictions(spark, str(run), "k int").collect()] == [(1, "p.json")]
    (run / "submission").mkdir()
    (run / "submission" / "q.json").write_text('{"k": 3}')
    assert [r["k"] for r in readers.run_predictions(spark, str(run), "k int").collect()] == [3]


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, [(1, "x", 2.0)], "extra")], "a int, e array<struct<p: int, q: string, z: double>>, more string")
    out = sinks.strict_projection(rows, "e array<struct<q: string, w: int>>, a string, absent int")
    assert out.columns == ["e", "a", "absent"] and out.collect()[0].asDict(True) == {"e": [{"q": "x", "w": None}], "a": "1", "absent": None}
    ev = "evidence array<struct<stage: string, file_id: string, page: int, is_anchor: boolean>>"
    findings = spark.createDataFrame([("o1", "VIOLATION", [("PD", "F", 1, True)]), ("o2", "VIOLATION", [])], f"object_id string, violation_label string, {ev}")
    gates = spark.createDataFrame([("o1", "G1", True), ("o2", "G1", None), ("o2", "G2", False)], "object_id string, gate string, passed boolean")
    answers, refused = sinks.gated_submission(findings, gates)
    assert [r["object_id"] for r in answers.collect()] == ["o1"] and [tuple(r) for r in refused.collect()] == [("o2", ["G1", "G2"])]
    art = spark.createDataFrame([("a" * 64,), ("b" * 64,)], "sha256 string")
    a, b = (sinks.sidecar(spark, "r", {"k": "v"}, x, "2024-01-01", 3).first() for x in (art, art.orderBy(F.desc("sha256"))))
    assert a == b and a["artifacts"] == 2 and len(a["settings_sha256"]) == 64
    objects = spark.createDataFrame([("o1", "Name"), ("o2", "Other")], "object_id string, name string")
    lines = spark.createDataFrame([("o1", 2, "b"), ("o1", 1, "a")], "object_id string, n int, text string")
    got = {r["object_id"]: json.loads(r["protocol"]) for r in sinks.protocol_json(objects, lines, "object_id", ["n"]).collect()}
    assert got["o1"] == {"object_id": "o1", "name": "Name", "rows": [{"n": 1, "text": "a"}, {"n": 2, "text": "b"}]} and got["o2"] == {"object_id": "o2", "name": "Other"}
    first = spark.createDataFrame([(1, "x"), (2, "y")], "k int, sha string")
    sinks.write_merged(str(tmp_path / "t"), first, "k", "sha", 1)
    second = spark.createDataFrame([(1, "x"), (3, "z")], "k int, sha string")
    for _ in range(2):
        now = sinks.write_merged(str(tmp_path / "t"), second, "k", "sha", 2)
    assert {(r["k"], r["state"], r["since"]) for r in now.collect()} == {(1, "CURRENT", 1), (2, "SUPERSEDED", 1), (3, "CURRENT", 2)}
    scores = spark.createDataFrame([("b", 1.5), ("a", None)], "name string, f1 double")
    assert sinks.score_summary(scores, "name").first()["text"] == "a: f1=-\nb: f1=1.5"
