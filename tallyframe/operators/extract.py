"""What texts state: spans, labelled fields, readings that a lexicon or a registry decides, lines matched by place, polygons."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import spatial
from .normalise import layout_code_key, semi_global

# Letters that are read for digits between digits, and the digits.
READ_AS, MEANT = "OОoоIlЗзБб", "0000113366"


def spans(text: Column, pattern: str) -> Column:
    """array of struct(at, raw): where each match of a pattern stands in a text, from 1; none for null."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))
    empty = F.array().cast("array<struct<at:int,raw:string>>")

    def step(acc: Column, m: Column) -> Column:
        at = F.call_function("locate", m, text, acc["after"])
        return F.struct((at + F.length(m)).alias("after"), F.concat(acc["out"], F.array(F.struct(at.alias("at"), m.alias("raw")))).alias("out"))

    return F.aggregate(found, F.struct(F.lit(1).alias("after"), empty.alias("out")), step, lambda acc: acc["out"])


def fields(text: Column, patterns: dict[str, str]) -> Column:
    """struct of the first group of each pattern in a text (an act's number, date, works; an energy passport's figures); null where it does not fit."""
    return F.struct(*[F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), p, 1)), F.lit("")).alias(k) for k, p in patterns.items()])


def digits_corrected(code: Column) -> Column:
    """Letters that stand for digits between two digits, or after a digit at the end of a part, as digits."""
    out = code
    for _ in range(2):  # neighbours of corrected signs come second
        for letter, digit in zip(READ_AS, MEANT, strict=True):
            out = F.regexp_replace(out, rf"(?<=[0-9]){letter}(?=[0-9]|[-/._]|$)", digit)
    return out


def read_codes(read: DataFrame, known: DataFrame, code: str) -> DataFrame:
    """(code, match): a code itself where the registry has it, else the one known code that looks the same; several or none give null."""
    other = known.select(F.col(code).alias("_known")).distinct()
    keyed = other.groupBy(layout_code_key(F.col("_known")).alias("_key")).agg(F.count("*").alias("_n"), F.min("_known").alias("_one"))
    own = read.select(code).distinct().join(other, F.col(code) == F.col("_known"), "left").withColumn("_key", layout_code_key(F.col(code)))
    return own.join(keyed, "_key", "left").select(code, F.coalesce("_known", F.when(F.col("_n") == 1, F.col("_one"))).alias("match"))


def best_shift(texts: DataFrame, lexicon: DataFrame, key: str, text: str, word: str, shifts: range) -> DataFrame:
    """(key, shift, hits): the shift of code points under which most words of a text are known; ties go to the smaller shift, without hits to 0.

    Only letters move. Each text is exploded once for each of the given shifts, and its distinct words meet the lexicon by an equi join.
    """
    moved = lambda c, k: F.array_join(F.transform(F.filter(F.split(c, ""), lambda s: s != ""), lambda s: F.when(s.rlike(r"\p{L}"), F.call_function("char", (F.ascii(s) + k).cast("bigint"))).otherwise(s)), "")
    words = texts.select(key, F.explode(F.array(*map(F.lit, shifts))).alias("shift"), F.explode(F.array_distinct(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"))).alias("_w")).where("_w <> ''")
    hits = words.withColumn("_w", moved(F.col("_w"), F.col("shift"))).join(lexicon.select(F.col(word).alias("_w")).distinct(), "_w").groupBy(key, "shift").agg(F.count("*").alias("hits"))
    best = hits.groupBy(key).agg(F.max_by(F.struct("shift", "hits"), F.struct("hits", -F.abs("shift"), "shift")).alias("b"))
    return texts.select(key).distinct().join(best, key, "left").select(key, F.coalesce("b.shift", F.lit(0)).alias("shift"), F.coalesce("b.hits", F.lit(0)).cast("bigint").alias("hits"))


def _convex(p: list[float]) -> list[tuple[float, float]]:
    points = list(zip(p[::2], p[1::2], strict=True))
    turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))
    return points if turn >= 0 else points[::-1]


def _surface(points: list[tuple[float, float]]) -> float:
    return abs(sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(points, points[1:] + points[:1], strict=True))) / 2 if len(points) > 2 else 0.0


@F.pandas_udf(T.DoubleType())
def polygon_iou(a: pd.Series, b: pd.Series) -> pd.Series:
    """Intersection over union of two convex polygons, arrays x1, y1, x2, y2, ...; 0 without a surface, null for a null."""

    def one(p, q) -> float | None:
        if p is None or q is None:
            return None
        left, right = _convex(list(p)), _convex(list(q))
        part = left
        for (x1, y1), (x2, y2) in zip(right, right[1:] + right[:1], strict=True):
            side = [(x2 - x1) * (y - y1) - (y2 - y1) * (x - x1) for x, y in part]
            kept: list[tuple[float, float]] = []
            for k, (x, y) in enumerate(part):
                s, t = side[k - 1], side[k]
                if (s < 0) != (t < 0):
                    px, py = part[k - 1]
                    kept.append((px + (x - px) * s / (s - t), py + (y - py) * s / (s - t)))
                if t >= 0:
                    kept.append((x, y))
            part = kept
            if not part:
                return 0.0
        common = _surface(part)
        union = _surface(left) + _surface(right) - common
        return common / union if union > 0 else 0.0

    return pd.Series([one(p, q) for p, q in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(T.StringType())
def member_name(raw: pd.Series, utf8: pd.Series) -> pd.Series:
    """An archive member's name from its bytes: UTF-8 where the flag says so or they are ASCII, else the more plausible of UTF-8 and code page 866; null for a null."""

    def plausible(s: str) -> int:
        return sum(x.isalnum() or x in " ._-/()\\№" for x in s) - 4 * sum(0x2500 <= ord(x) <= 0x259F or x == "�" for x in s)

    def one(b: bytes | None, flag: bool | None) -> str | None:
        if b is None:
            return None
        if flag or b.isascii():
            return b.decode("utf-8", "replace")
        return max(b.decode("utf-8", "replace"), b.decode("cp866"), key=plausible)

    return pd.Series([one(b, f) for b, f in zip(raw, utf8, strict=True)], dtype="object")


def line_errors(truth: DataFrame, found: DataFrame, page: str, line: str, text: str, box: str, least: float = 0.3) -> DataFrame:
    """(page, line, errors, signs): each true line against the found lines that cover `least` of the smaller box, in reading order; all its signs where none does.

    Errors are the least edit distance to a part of what was found, so neighbours' words cost nothing.
    """
    met = spatial.overlapping(truth.select(page, line, F.col(box).alias("_a")), found.select(page, F.col(line).alias("_line"), F.col(box).alias("_b")), page, line, "_line", "_a", "_b").where(F.col("of_smaller") >= least)
    parts = met.join(found.select(page, F.col(line).alias("_line"), F.col(text).alias("_t"), F.col(box).alias("_box")), [page, "_line"])
    joined = parts.groupBy(page, line).agg(F.array_join(F.array_sort(F.collect_list(F.struct(F.col("_box")[1].alias("y"), F.col("_box")[0].alias("x"), "_line", "_t")))["_t"], " ").alias("_found"))
    out = truth.join(joined, [page, line], "left")
    return out.select(page, line, F.coalesce(semi_global(F.coalesce(text, F.lit("")), F.coalesce("_found", F.lit(""))), F.lit(0)).alias("errors"), F.length(F.coalesce(text, F.lit(""))).alias("signs"))


def gap_capture(truth: DataFrame, layer: DataFrame, found: DataFrame, page: str, line: str, box: str, covered: float = 0.3) -> DataFrame:
    """One row: true lines that the text layer leaves uncovered, those of them that found lines cover, and the share."""
    cover = lambda rows, k: spatial.coverage(truth.select(page, line, F.col(box).alias("box")), rows.select(page, F.col(line).alias("_l"), F.col(box).alias("box")), page, line, "_l").withColumnRenamed("covered", k)
    gaps = cover(layer, "_by_layer").where(F.col("_by_layer") < covered).join(cover(found, "_by_found"), [page, line])
    return gaps.agg(F.count("*").alias("gaps"), F.count_if(F.col("_by_found") >= covered).alias("captured")).withColumn("share", F.round(F.try_divide("captured", "gaps"), 6))
