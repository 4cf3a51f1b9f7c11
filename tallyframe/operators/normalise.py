"""Normal forms of codes, quantities, names, texts and records before they are compared: Column expressions, and joins where a table decides."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import CYRILLIC, LATIN, base_text

# Units, their dimension and their size in the dimension's smallest unit.
UNITS = {
    "": ("", 1.0), "мм": ("length", 1.0), "см": ("length", 10.0), "м": ("length", 1000.0), "км": ("length", 1_000_000.0), "мм²": ("area", 1.0), "см²": ("area", 100.0),
    "м²": ("area", 1_000_000.0), "м³": ("volume", 1.0), "л": ("volume", 0.001), "%": ("percent", 1.0), "шт": ("count", 1.0),
}
# Signs and digits of a drawing code and the capital letters they are read as.
FOLD_FROM, FOLD_TO = "ABCEHKMOPTXY03N", "АВСЕНКМОРТХУОЗП"
# The first bytes of drawings and the release that wrote them.
RELEASES = {"AC1014": "R14", "AC1015": "AutoCAD 2000–2002", "AC1018": "AutoCAD 2004–2006", "AC1021": "AutoCAD 2007–2009", "AC1024": "AutoCAD 2010–2012", "AC1027": "AutoCAD 2013–2017", "AC1032": "AutoCAD 2018+"}
SIMILAR = 0.85


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def criticality(c: Column, first_word: bool = False) -> Column:
    """Quotes, brackets and stops off, one space, lower case; only its first word where asked. Null stays null."""
    plain = squeeze(F.regexp_replace(base_text(c), "[«»\"“”„().,;:]", " "))
    return F.split(plain, " ")[0] if first_word else plain


def approved_critical(c: Column) -> Column:
    plain = base_text(F.coalesce(c, F.lit("")))
    return plain.startswith("критическое") & ~plain.contains("требует утверждения")


def value_text(c: Column) -> Column:
    """A printed value in one form: no thousands' spaces, a decimal point, no marks, units as м², м³, ² and ³."""
    out = F.regexp_replace(base_text(c), r"(?<=\d) (?=\d{3}(?!\d))", "")
    out = F.regexp_replace(out, r"(?<=\d),(?=\d)", ".")
    out = F.regexp_replace(out, "[«»\"“”„()\\[\\];:!?,]", " ")
    out = squeeze(F.regexp_replace(out, r"(?<!\d)\.|\.(?!\d)", " "))
    for pattern, unit in ((r"(?U)\bкв\s*м\b", "м²"), (r"(?U)\bкуб\s*м\b", "м³"), (r"(?<=[мm])\^?2(?!\d)", "²"), (r"(?<=[мm])\^?3(?!\d)", "³")):
        out = F.regexp_replace(out, pattern, unit)
    return squeeze(out)


def quantity(c: Column) -> Column:
    """struct(dimension, magnitude in the smallest unit) of a number with a known unit or none; null for anything else."""
    return quantity_of(value_text(c))


def quantity_of(text: Column) -> Column:
    """The quantity of a value text in its one form."""
    number, unit = (F.regexp_extract(text, r"^([-+]?\d+(?:\.\d+)?)\s*([a-zа-я²³/%°]*)$", k) for k in (1, 2))
    known = F.create_map(*[x for k, (d, f) in UNITS.items() for x in (F.lit(k), F.struct(F.lit(d).alias("dimension"), F.lit(f).alias("factor")))])
    of = F.try_element_at(known, unit)
    return F.when((number != "") & of.isNotNull(), F.struct(of["dimension"].alias("dimension"), (number.try_cast("double") * of["factor"]).alias("magnitude")))


def matching_signs(a: str, b: str) -> int:
    """Length of the longest common subsequence of two strings, by bits."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    mask = (1 << len(a)) - 1
    free = mask
    for y in b:
        hit = free & places.get(y, 0)
        free = ((free + hit) | (free & ~hit)) & mask
    return len(a) - free.bit_count()


@F.pandas_udf(T.DoubleType())
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * common subsequence / both lengths; 1 for two empty texts, null for a null."""
    return pd.Series([None if x is None or y is None else 1.0 if not x and not y else 2 * matching_signs(x, y) / (len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype="float64")


def value_similarity(a: Column, b: Column) -> Column:
    """1 or 0 for two quantities (equal within 1e-9; no unit fits any), else the indel ratio of the normal forms."""
    x, y = quantity(a), quantity(b)
    same = (x["dimension"] == y["dimension"]) | (x["dimension"] == "") | (y["dimension"] == "")
    close = F.abs(x["magnitude"] - y["magnitude"]) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(x["magnitude"]))
    left, right = value_text(a), value_text(b)
    return F.when(x.isNotNull() & y.isNotNull(), (same & close).cast("double")).when(left == right, 1.0).otherwise(indel_ratio(left, right))


def value_match(a: Column, b: Column, least: float = SIMILAR) -> Column:
    """1.0 for two blanks, 0.0 for one, else whether they are similar enough."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    return F.when(blank(a) & blank(b), 1.0).when(blank(a) | blank(b), 0.0).otherwise((value_similarity(a, b) >= least).cast("double"))


def matched_values(rows: DataFrame, a: Column, b: Column, name: str = "score", least: float = SIMILAR) -> DataFrame:
    """rows with value_match(a, b), step by step: each normal form and each quantity is made once a row."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    steps = rows.withColumns({"_ba": blank(a), "_bb": blank(b), "_ta": value_text(a), "_tb": value_text(b)}).withColumns({"_qa": quantity_of(F.col("_ta")), "_qb": quantity_of(F.col("_tb"))})
    same = (F.col("_qa.dimension") == F.col("_qb.dimension")) | (F.col("_qa.dimension") == "") | (F.col("_qb.dimension") == "")
    close = F.abs(F.col("_qa.magnitude") - F.col("_qb.magnitude")) <= 1e-9 * F.greatest(F.lit(1.0), F.abs(F.col("_qa.magnitude")))
    like = F.when(F.col("_qa").isNotNull() & F.col("_qb").isNotNull(), same & close).when(F.col("_ta") == F.col("_tb"), True).otherwise(indel_ratio("_ta", "_tb") >= least)
    out = F.when(F.col("_ba") & F.col("_bb"), 1.0).when(F.col("_ba") | F.col("_bb"), 0.0).otherwise(like.cast("double"))
    return steps.withColumn(name, out).drop("_ba", "_bb", "_ta", "_tb", "_qa", "_qb")


def parsed_code(c: Column, ranges: list[tuple[str, int, int]]) -> Column:
    """struct(number, prefix, canonical, mismatch) of «PREFIX-number» against ranges (prefix, first, last); M-number has no prefix of its own. Null for anything else."""
    text = F.translate(F.upper(F.trim(c)), "–—", "--")
    prefix, digits = F.regexp_extract(text, r"^([A-Z0-9]+)-([0-9]+)$", 1), F.regexp_extract(text, r"^([A-Z0-9]+)-([0-9]+)$", 2)
    number, expected = digits.try_cast("int"), F.lit(None).cast("string")
    for name, low, high in ranges:
        expected = F.when(number.between(low, high), name).otherwise(expected)
    known = prefix.isin(*[r[0] for r in ranges], "M") & expected.isNotNull()
    return F.when(known, F.struct(number.alias("number"), prefix.alias("prefix"), F.concat(expected, F.lit("-"), F.lpad(number.cast("string"), 3, "0")).alias("canonical"), ((prefix != "M") & (prefix != expected)).alias("mismatch")))


def normalize_code(c: Column, ranges: list[tuple[str, int, int]], relaxed: bool = False) -> Column:
    """The canonical code; in light mode a code of another prefix than its number's, FREE codes and anything else in capitals as they are."""
    text = F.upper(F.trim(F.coalesce(c, F.lit(""))))
    parsed = parsed_code(text, ranges)
    usable = parsed.isNotNull() & ~text.startswith("FREE-")
    return F.when(usable if relaxed else usable & ~parsed["mismatch"], parsed["canonical"]).otherwise(text)


def rendered(template: str, values: dict[str, Column]) -> Column:
    """A template with {name} filled in; empty names leave nothing, spaces and spaces before stops collapse; null for an empty result."""
    parts = re.split(r"(\{[a-z_]+\})", template)
    out = F.concat(*[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") and p[1:-1] in values else F.lit("" if p.startswith("{") else p) for p in parts if p])
    return F.nullif(F.regexp_replace(F.trim(F.regexp_replace(out, r"\s{2,}", " ")), r"\s+([,.;:])", "$1"), F.lit(""))


def filled(template: str, values: dict[str, Column]) -> Column:
    """Like rendered, but of a bracketed list «(a {x}; b {y})» only the parts whose names all have values stay, and an empty bracket goes."""
    names = lambda s: re.findall(r"\{([a-z_]+)\}", s)
    has = lambda s: [F.coalesce(F.trim(values[n].cast("string")) != "", F.lit(False)) if n in values else F.lit(False) for n in names(s)]
    out: list[Column] = []
    for piece in re.split(r"(\s?\([^()]*\))", template):
        inner = re.fullmatch(r"(\s?)\(([^()]*)\)", piece)
        if not inner or not names(piece):
            out.append(_plain(piece, values))
            continue
        kept = [F.when(_all(has(p)), _plain(p, values)) for p in inner[2].split("; ")]
        some = F.concat_ws("; ", *kept)
        out.append(F.when(some == "", "").otherwise(F.concat(F.lit(inner[1] + "("), some, F.lit(")"))))
    return F.nullif(squeeze(F.concat(*out)), F.lit(""))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _plain(text: str, values: dict[str, Column]) -> Column:
    parts = [p for p in re.split(r"(\{[a-z_]+\})", text) if p]
    return F.concat(F.lit(""), *[F.coalesce(values[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") and p[1:-1] in values else F.lit("" if p.startswith("{") else p) for p in parts])


def match_key(name: Column) -> Column:
    """Key of a file name: last part of the path without extension, lower case, look-alike letters as Cyrillic, other signs as one space."""
    last = F.element_at(F.split(F.translate(name, "\\", "/"), "/"), -1)
    stem = F.regexp_replace(last, r"(?<=.)\.[^.]*$", "")
    return squeeze(F.regexp_replace(F.translate(F.lower(stem), "ё" + LATIN.lower(), "е" + CYRILLIC.lower()), r"[^\p{L}\p{N}]+", " "))


def layout_code_key(c: Column) -> Column:
    return F.translate(F.regexp_replace(F.upper(c), r"[\s/._-]+", ""), FOLD_FROM, FOLD_TO)


def looks_like_code(c: Column) -> Column:
    """Letters and digits joined by at least two of - / . in one word of five signs and more, mostly capitals, no date and no number with a unit."""
    t = F.trim(c)
    letters, capitals = F.regexp_count(t, F.lit(r"\p{L}")), F.regexp_count(t, F.lit(r"\p{Lu}"))
    shaped = (F.length(t) >= 5) & ~t.contains(" ") & (F.regexp_count(t, F.lit("[-/.]")) >= 2) & t.rlike("[0-9]")
    return F.coalesce(shaped & (letters >= 2) & (capitals * 2 >= letters) & ~t.rlike(r"^[0-9.,/-]+\p{L}{1,3}\.?$"), F.lit(False))


def document_codes(text: Column) -> Column:
    """Code-shaped words of a text, in order, without the stops behind them."""
    words = F.transform(F.split(F.coalesce(text, F.lit("")), r"[\s,;()«»\"]+"), lambda w: F.regexp_replace(w, r"[.:]+$", ""))
    return F.filter(words, looks_like_code)


def strict_text(c: Column) -> Column:
    """No white space; signs that can't be told apart in print as one. The two groups of signs."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\s+", ""), "[∅⌀Ø]", "ø"), "[x×]", "х")


def joined_lines(a: Column, b: Column, known: Column) -> Column:
    """Two lines of a cell as one: without the hyphen between them where both halves make a known word, with it before a small letter, else with a space."""
    a, b = squeeze(F.coalesce(a, F.lit(""))), squeeze(F.coalesce(b, F.lit("")))
    head, tail = F.regexp_extract(a, r"(\p{L}+)-$", 1), F.regexp_extract(b, r"^(\p{Ll}+)", 1)
    soft = a.rlike(r"(?<! )-$") & b.rlike(r"^\p{Ll}")
    word = F.array_contains(known, F.lower(F.concat(head, tail))) & (head != "") & (tail != "")
    return F.when(a == "", b).when(b == "", a).when(soft & word, F.concat(F.regexp_replace(a, "-$", ""), b)).when(soft, F.concat(a, b)).otherwise(F.concat(a, F.lit(" "), b))


def spec_item(name: Column) -> Column:
    """struct(kind, stem, size): a cable's brand with its cores and its section, or a pipe's diameter; null for other items."""
    section = r"(?<![\dxх×.,])(\d{1,2})\s*[xх×]\s*(\d{1,3}(?:[.,]\d{1,2})?)(?![\dxх×])"
    number = lambda s: F.regexp_replace(s, ",", ".").try_cast("double")
    cores, area, brand = F.regexp_extract(name, section, 1), F.regexp_extract(name, section, 2), F.regexp_extract(name, r"(?<!\p{L})(\p{Lu}{2,}\p{Ll}{0,3}(?:-\p{L}+)*)", 1)
    diameter = F.regexp_extract(name, r"(?iu)(?:ду|dn|d|ø)\s*=?\s*(\d{2,4})", 1)
    cable, pipe = name.rlike("(?iu)кабел|провод"), name.rlike("(?iu)труб")
    return F.when(cable & (cores != "") & (brand != ""), F.struct(F.lit("CABLE").alias("kind"), F.concat(F.upper(brand), F.lit(" "), cores, F.lit("×")).alias("stem"), number(area).alias("size"))).when(
        pipe & (diameter != ""), F.struct(F.lit("PIPE").alias("kind"), squeeze(F.regexp_replace(F.lower(F.regexp_replace(name, r"(?iu)(?:ду|dn|d|ø)\s*=?\s*\d{2,4}", " ")), r"[^\p{L}]+", " ")).alias("stem"), number(diameter).alias("size"))
    )


def dwg_version(head: Column) -> Column:
    """struct(code, release) of a drawing's first bytes, as text; null for other files."""
    code = F.regexp_extract(head, r"^(AC1\d{3}|AC1\.\d{1,2}|AC2\.10|MC0\.0)", 1)
    known = F.create_map(*[F.lit(x) for pair in RELEASES.items() for x in pair])
    return F.when(code != "", F.struct(code.alias("code"), F.coalesce(F.try_element_at(known, code), F.lit("unknown")).alias("release")))


def short_digest(c: Column, n: int = 12) -> Column:
    return F.substring(c, 1, n)


def evidence_fingerprint(finding: Column, group: Column) -> Column:
    """sha256 of a finding's hash and its group's, which may be null."""
    return F.sha2(F.concat_ws(":", finding, F.coalesce(group, F.lit(""))), 256)


def time_ordered_id(ts: Column, of: Column) -> Column:
    """A version 7 id: milliseconds, then bits of the md5 of `of` (so the same row has the same id)."""
    ms, h = F.lower(F.lpad(F.hex(F.unix_millis(ts)), 12, "0")), F.md5(of.cast("string"))
    return F.concat_ws("-", F.substring(ms, 1, 8), F.substring(ms, 9, 4), F.concat(F.lit("7"), F.substring(h, 1, 3)), F.concat(F.lit("8"), F.substring(h, 4, 3)), F.substring(h, 7, 12))


def progress_fields(line: Column) -> Column:
    """Fields of a log line as a map: of a JSON object, or of words key=value; other words are passed over."""
    pairs = F.filter(F.split(line, r"\s+"), lambda w: w.rlike("^[A-Za-z_]+=."))
    words = F.map_from_entries(F.transform(pairs, lambda w: F.struct(F.split_part(w, F.lit("="), F.lit(1)), F.regexp_replace(w, "^[A-Za-z_]+=", ""))))
    return F.when(line.rlike(r"^\s*\{"), F.from_json(line, "map<string,string>")).otherwise(words)


def tag_families(tag: Column, families: dict[str, list[str]]) -> Column:
    """Families of which a pattern fits a tag, in their order."""
    return F.array_compact(F.array(*[F.when(F.coalesce(tag.rlike("|".join(f"(?:{p})" for p in ps)), F.lit(False)), F.lit(name)) for name, ps in families.items()]))


def nearest_cue_accepts(text: Column, at: Column, accept: list[str], reject: list[str], reach: int = 80) -> Column:
    """Whether the cue nearest before a place (from 1) is one that accepts: false if one that rejects is nearer or there is none. Cues are plain words."""
    left = F.substr(text, F.greatest(at - reach, F.lit(1)), F.least(at - 1, F.lit(reach)))
    turned = F.reverse(left)
    near = lambda cues: F.least(*[F.nullif(F.instr(turned, c[::-1]), F.lit(0)) for c in cues], F.lit(1 << 30))
    return F.coalesce(near(accept) < near(reject), F.lit(False))


def labelled_value(text: Column, label: str, unit: str = r"\p{L}*") -> Column:
    """struct(raw, value, unit) of the first number behind a label and a colon, dash or space; null without one."""
    pattern = rf"(?iu)(?:{label})\s*[:=–-]?\s*([0-9][0-9 ]*(?:[.,][0-9]+)?)\s*({unit})"
    raw = F.trim(F.regexp_extract(text, pattern, 1))
    return F.when(raw != "", F.struct(raw.alias("raw"), F.regexp_replace(F.regexp_replace(raw, " ", ""), ",", ".").try_cast("double").alias("value"), F.regexp_extract(text, pattern, 2).alias("unit")))


def resolved_codes(rows: DataFrame, known: DataFrame, code: str, name: str, block: str, least: float = 0.8) -> DataFrame:
    """rows with `resolved`: their code where it is known, else the code of the most similar name in their block at `least` or more (ties: the lower code), else null.

    Only rows whose code is unknown meet names, and only names of their block.
    """
    longer = F.greatest(F.length(name), F.length("_name"), F.lit(1))
    exact = known.select(F.col(code).alias("_code"), F.lit(True).alias("_known")).distinct()
    marked = rows.join(exact, rows[code] == exact["_code"], "left").drop("_code")
    open_ = marked.where("_known is null").select(block, name).distinct()
    names = known.select(block, F.col(name).alias("_name"), F.col(code).alias("_code")).distinct()
    best = open_.join(names, block).withColumn("_s", 1 - F.levenshtein(F.col(name), F.col("_name")) / longer).where(F.col("_s") >= least).groupBy(block, name).agg(F.min_by("_code", F.struct(-F.col("_s"), "_code")).alias("_best"))
    return marked.join(best, [block, name], "left").withColumn("resolved", F.when(F.col("_known"), F.col(code)).otherwise(F.col("_best"))).drop("_known", "_best")


def repaired(tags: DataFrame, known: DataFrame, tag: str, confusions: dict[str, str], least: int = 1) -> DataFrame:
    """(tag, repaired): tags that are not known, with the one known tag that one confused sign away gives; several or none give no row."""
    signs = F.create_map(*[F.lit(x) for a, bs in confusions.items() for x in (a, bs)])
    other = known.select(F.col(tag).alias("repaired")).distinct()
    odd = tags.select(tag).distinct().join(other, F.col(tag) == F.col("repaired"), "left_anti").where(F.length(tag) > 0)
    spots = odd.select(tag, F.explode(F.sequence(F.lit(1), F.length(tag))).alias("_i")).withColumn("_to", F.try_element_at(signs, F.substr(F.col(tag), F.col("_i"), F.lit(1)))).where("_to is not null")
    made = spots.select(tag, "_i", F.explode(F.split("_to", "")).alias("_c")).where("_c <> ''").select(tag, F.concat(F.substr(F.col(tag), F.lit(1), F.col("_i") - 1), F.col("_c"), F.substr(F.col(tag), F.col("_i") + 1)).alias("repaired"))
    return made.distinct().join(other, "repaired").groupBy(tag).agg(F.count("*").alias("_n"), F.min("repaired").alias("repaired")).where(F.col("_n") <= least).drop("_n")


def failures_in_window(events: DataFrame, key: str, ts: str, failed: Column, seconds: int, most: int) -> DataFrame:
    """Failed events with the failures of their key in the `seconds` up to them, and whether that blocks the key."""
    at = F.unix_micros(F.col(ts).cast("timestamp"))
    w = Window.partitionBy(key).orderBy(at).rangeBetween(-(seconds * 1_000_000 - 1), 0)
    return events.where(failed).withColumn("failures", F.count("*").over(w)).withColumn("blocked", F.col("failures") >= most)


def edit_totals(rows: DataFrame, by: list[str], truth: str, found: str) -> DataFrame:
    """(by, errors, signs, accuracy): pooled character accuracy, 1 - errors / signs of the truth; null without signs."""
    out = rows.groupBy(*by).agg(F.sum(F.levenshtein(F.coalesce(truth, F.lit("")), F.coalesce(found, F.lit("")))).alias("errors"), F.sum(F.length(F.coalesce(truth, F.lit("")))).alias("signs"))
    return out.withColumn("accuracy", F.round(1 - F.try_divide("errors", "signs"), 6))


def verdicts(metrics: DataFrame, limits: DataFrame, key: str) -> DataFrame:
    """metrics (key, metric, value) with PASS or FAIL against limits (metric, least); NO_LIMIT without one, NO_VALUE for null."""
    out = metrics.join(limits, "metric", "left")
    return out.select(key, "metric", "value", F.when(F.col("least").isNull(), "NO_LIMIT").when(F.col("value").isNull(), "NO_VALUE").when(F.col("value") >= F.col("least"), "PASS").otherwise("FAIL").alias("verdict"))


@F.pandas_udf(T.IntegerType())
def semi_global(a: pd.Series, b: pd.Series) -> pd.Series:
    """Least edit distance between a and any part of b; null for a null. Whole texts: a column of the table at a time."""
    import numpy as np

    def one(x: str | None, y: str | None) -> int | None:
        if x is None or y is None:
            return None
        row = np.arange(len(x) + 1)  # distances of the beginnings of a, for parts of b that end here
        best = len(x)
        signs = np.array([ord(s) for s in x])
        steps = np.arange(len(x) + 1)
        for s in y:
            new = np.concatenate([[0], np.minimum(row[1:] + 1, row[:-1] + (signs != ord(s)))])
            row = np.minimum.accumulate(new - steps) + steps
            best = min(best, int(row[-1]))
        return best

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)], dtype="Int32")


def pattern_problems(pattern: str) -> list[str]:
    """Why a pattern may take very long: a repeated group that itself repeats or has alternatives, back references, unbounded look-behind."""
    found = []
    try:
        re.compile(pattern)
    except re.error as e:
        return [f"INVALID: {e}"]
    if re.search(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]", pattern):
        found.append("NESTED_REPEAT")
    if re.search(r"\((?:[^()\\]|\\.)*\|(?:[^()\\]|\\.)*\)[+*]", pattern):
        found.append("REPEATED_ALTERNATIVES")
    if re.search(r"\\[1-9]", pattern):
        found.append("BACK_REFERENCE")
    return found


def overridden_config(base: dict[str, Any], changes: dict[str, Any], at: str = "") -> dict[str, Any]:
    """base with changes, level by level; a key that base lacks, or a value of another kind, raises ValueError with its place."""
    out = dict(base)
    for key, value in changes.items():
        if key not in base:
            raise ValueError(f"{at}{key}: unknown")
        if isinstance(base[key], dict):
            if not isinstance(value, dict):
                raise ValueError(f"{at}{key}: a section")
            out[key] = overridden_config(base[key], value, f"{at}{key}.")
        elif base[key] is not None and not isinstance(value, type(base[key])) and not (isinstance(base[key], float) and isinstance(value, int)):
            raise ValueError(f"{at}{key}: {type(base[key]).__name__}")
        else:
            out[key] = value
    return out
