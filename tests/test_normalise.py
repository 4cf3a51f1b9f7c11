"""Literal rows and brute force for normal forms."""

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import normalise as N


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first()[0]


def test_semi_global_distance(spark):
    r = random.Random(3)

    def plain(a, b):
        def edit(x, y):
            row = list(range(len(y) + 1))
            for i, s in enumerate(x, 1):
                row, last = [i], row
                for j, t in enumerate(y, 1):
                    row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (s != t)))
            return row[-1]

        return min(edit(a, b[i:j]) for i in range(len(b) + 1) for j in range(i, len(b) + 1))

    rows = [("".join(r.choices("abc", k=r.randint(0, 6))), "".join(r.choices("abc", k=r.randint(0, 8)))) for _ in range(120)] + [("", ""), (None, "a"), ("a", None)]
    got = spark.createDataFrame(rows, "a string, b string").select("a", "b", N.semi_global("a", "b").alias("d")).collect()
    assert all(x["d"] == (None if x["a"] is None or x["b"] is None else plain(x["a"], x["b"])) for x in got)


def test_values(spark):
    assert one(spark, N.value_text(F.lit(" 12 500,40 КВ. М; "))) == "12500.40 м²"
    assert one(spark, N.value_text(F.lit("5 м3"))) == "5 м³"
    assert tuple(one(spark, N.quantity(F.lit("2,5 см")))) == ("length", 25.0)
    assert one(spark, N.quantity(F.lit("2,5 попугая"))) is None
    pairs = [("10 см", "100 мм", 1.0), ("10", "10 м", 0.0), ("10", "10 мм", 1.0), ("бетон B25", "бетон В25", 1.0), ("бетон", "кирпич", 0.0), (None, " ", 1.0), (None, "x", 0.0)]
    for a, b, want in pairs:
        assert one(spark, N.value_match(F.lit(a).cast("string"), F.lit(b).cast("string"))) == want, (a, b)
    rows = spark.createDataFrame([(a, b, w) for a, b, w in pairs], "a string, b string, want double")
    assert all(r["score"] == r["want"] for r in N.matched_values(rows, F.col("a"), F.col("b")).collect())
    assert N.matching_signs("abcbdab", "bdcaba") == 4 and N.matching_signs("", "x") == 0
    assert one(spark, N.approved_critical(F.lit("Критическое (требует утверждения)"))) is False
    assert one(spark, N.approved_critical(F.lit(" «Критическое»".replace("«", "").replace("»", "")))) is True


def test_patterns_and_settings():
    assert N.pattern_problems("(a+)+b") == ["NESTED_REPEAT"] and N.pattern_problems("(a|aa)*") == ["REPEATED_ALTERNATIVES"] and N.pattern_problems("[a-z]+ (x|y)") == []
    assert N.pattern_problems(r"(a)\1") == ["BACK_REFERENCE"] and N.pattern_problems("(")[0].startswith("INVALID")
    base = {"a": 1, "b": {"c": 2.0, "d": None}}
    assert N.overridden_config(base, {"b": {"c": 3, "d": "x"}}) == {"a": 1, "b": {"c": 3, "d": "x"}} and base["b"]["c"] == 2.0
    for bad in ({"z": 1}, {"b": {"z": 1}}, {"b": 1}, {"a": "x"}):
        with pytest.raises(ValueError):
            N.overridden_config(base, bad)


def test_templates_and_lines(spark):
    assert one(spark, N.rendered("{a} and {b} .", {"a": F.lit("x"), "b": F.lit(None).cast("string")})) == "x and."
    assert one(spark, N.rendered("{a}", {})) is None
    assert one(spark, N.filled("See {a} (p. {p}; fig. {f}) (always)", {"a": F.lit("A"), "p": F.lit(None).cast("string"), "f": F.lit("2")})) == "See A (fig. 2) (always)"
    assert one(spark, N.filled("See {a} (p. {p})", {"a": F.lit("A"), "p": F.lit("")})) == "See A"
    known = F.array(F.lit("насадкой"))
    assert one(spark, N.joined_lines(F.lit("с насад-"), F.lit("кой"), known)) == "с насадкой"
    assert one(spark, N.joined_lines(F.lit("юго-"), F.lit("западный"), known)) == "юго-западный"
    assert one(spark, N.joined_lines(F.lit(None).cast("string"), F.lit("b"), known)) == "b"
    assert one(spark, N.document_codes(F.lit("по листу АБ-12/3.4, дата 01.02.2024г и (АБ-12/3.5)."))) == ["АБ-12/3.4", "АБ-12/3.5"]


def test_spans_names_and_lines(spark):
    from tallyframe.operators import extract as E

    assert [tuple(x) for x in one(spark, E.spans(F.lit("a 12 b 12 c 3"), "[0-9]+"))] == [(3, "12"), (8, "12"), (13, "3")]
    assert one(spark, E.spans(F.lit(None).cast("string"), "x")) == []
    rows = spark.createDataFrame([(bytearray("план.pdf".encode("cp866")), False), (bytearray("план.pdf".encode()), False), (bytearray(b"plan.pdf"), False), (bytearray("план".encode()), True), (None, True)], "raw binary, utf8 boolean")
    assert [r[0] for r in rows.select(E.member_name("raw", "utf8")).collect()] == ["план.pdf", "план.pdf", "plan.pdf", "план", None]
    truth = spark.createDataFrame([(1, 1, "one two", [0.0, 0.0, 0.5, 0.1]), (1, 2, "lost", [0.0, 0.5, 0.5, 0.6])], "page int, line int, text string, box array<double>")
    found = spark.createDataFrame([(1, 7, "twx and more", [0.25, 0.0, 0.9, 0.1]), (1, 8, "one", [0.0, 0.0, 0.24, 0.1])], "page int, line int, text string, box array<double>")
    got = {r["line"]: (r["errors"], r["signs"]) for r in E.line_errors(truth, found, "page", "line", "text", "box").collect()}
    assert got == {1: (1, 7), 2: (4, 4)}
    layer = spark.createDataFrame([(1, 1, [0.0, 0.0, 0.5, 0.1])], "page int, line int, box array<double>")
    assert tuple(E.gap_capture(truth, layer, found, "page", "line", "box").first()) == (1, 0, 0.0)
    tri = F.array(*[F.lit(x) for x in (0.0, 0.0, 2.0, 0.0, 0.0, 2.0)])
    square = F.array(*[F.lit(x) for x in (0.0, 0.0, 1.0, 0.0, 1.0, 1.0, 0.0, 1.0)])
    assert one(spark, E.polygon_iou(tri, square)) == pytest.approx(0.5) and one(spark, E.polygon_iou(square, square)) == pytest.approx(1.0)
