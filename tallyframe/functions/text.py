"""Scalar functions on text, numbers, dates and codes, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Latin letters and the Cyrillic ones that look like them.
LATIN = "ABCEHKMOPTXaceopx"
CYRILLIC = "АВСЕНКМОРТХасеорх"
# Printed units and their canonical form.
UNITS = {"кв. м": "м²", "кв.м": "м²", "м2": "м²", "м²": "м²", "куб. м": "м³", "куб.м": "м³", "м3": "м³", "м³": "м³", "га": "га", "мм": "мм", "см": "см", "м": "м", "шт": "шт", "шт.": "шт"}
STAGES = ("PD", "RD", "ID")


def base_text(c: Column) -> Column:
    """Dashes and spaces unified, lower case, ё as е, runs of spaces collapsed. (NFC is left to the source.)"""
    return F.trim(F.regexp_replace(F.translate(F.lower(c), "ё‐‑‒–—−  ", "е------  "), r"\s+", " "))


def parse_number(c: Column) -> Column:
    """A printed number: spaces group thousands, the decimal sign is a comma or point; null for anything else."""
    plain = F.regexp_replace(F.translate(c, "−  ", "-  "), r"\s+", "")
    shape = plain.rlike(r"^[+-]?[0-9]+([.,][0-9]*)?$")
    return F.when(shape, F.regexp_replace(F.regexp_replace(plain, ",", "."), r"\.$", "").try_cast("double"))


def first_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"[+-]?[0-9]+(?:[.,][0-9]+)?", 0), F.lit(""))


def decimals_of(c: Column) -> Column:
    """Printed decimals."""
    return F.length(F.regexp_extract(c, r"[.,]([0-9]+)", 1))


def norm_unit(c: Column) -> Column:
    key, out = F.lower(F.trim(c)), F.lit(None).cast("string")
    for printed, unit in UNITS.items():
        out = F.when(key == printed, unit).otherwise(out)
    return out


def format_number_ru(c: Column, decimals: int = 2) -> Column:
    """Spaces group thousands, a comma before the decimals."""
    return F.translate(F.format_number(c, decimals), ",.", " ,")


def plural_ru(n: Column, one: str, few: str, many: str) -> Column:
    tens, units = F.pmod(n, F.lit(100)), F.pmod(n, F.lit(10))
    return F.when(tens.between(11, 14), many).when(units == 1, one).when(units.between(2, 4), few).otherwise(many)


def format_delta(expected: Column, actual: Column, kind: str) -> Column:
    """PCT: change in percent; ABS: difference; COUNT: both counts."""
    if kind == "PCT":
        return F.concat(F.format_number(F.try_divide((actual - expected) * 100, expected), 1), F.lit(" %"))
    return F.format_number(actual - expected, 2) if kind == "ABS" else F.concat(expected.cast("string"), F.lit(" -> "), actual.cast("string"))


def parse_date(c: Column) -> Column:
    """dd.mm.yyyy, dd.mm.yy or ISO; null for anything else."""
    day = F.when(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{4}$"), F.try_to_date(c, "d.M.yyyy")).when(c.rlike(r"^\d{1,2}\.\d{1,2}\.\d{2}$"), F.try_to_date(c, "d.M.yy"))
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd")).otherwise(day)


def moscow_date(ts: Column) -> Column:
    return F.to_date(ts + F.expr("interval 3 hours"))


def week_start(ts: Column) -> Column:
    return F.to_date(F.date_trunc("week", ts))


def parse_tolerance(c: Column) -> Column:
    """struct(plus, minus) of ±12 or +10/-5."""
    both = F.regexp_extract(c, r"±\s*([0-9]+(?:\.[0-9]+)?)", 1)
    plus, minus = F.regexp_extract(c, r"\+\s*([0-9]+(?:\.[0-9]+)?)", 1), F.regexp_extract(c, r"[-−]\s*([0-9]+(?:\.[0-9]+)?)", 1)
    number = lambda s: F.when(s != "", s.try_cast("double"))
    return F.struct(F.coalesce(number(both), number(plus)).alias("plus"), F.coalesce(number(both), number(minus)).alias("minus"))


def fold_mark(c: Column) -> Column:
    """Latin letters that look like Cyrillic ones become these."""
    return F.translate(c, LATIN, CYRILLIC)


def expand_mark(c: Column) -> Column:
    """«В2.7,8,9» as its marks; an empty array for text without a mark."""
    text = fold_mark(c)
    prefix = F.regexp_extract(text, r"^\s*([А-Яа-яA-Za-z]+)", 1)
    list_ = F.regexp_extract(text, r"^\s*[А-Яа-яA-Za-z]+([0-9]+(?:\.[0-9]+)?(?:\s*,\s*[0-9]+(?:\.[0-9]+)?)*)", 1)
    items = F.regexp_extract_all(list_, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    system = F.regexp_extract(list_, r"^([0-9]+)\.", 1)
    return F.when(list_ == "", F.array().cast("array<string>")).otherwise(F.transform(items, lambda i: F.concat(prefix, F.when((system != "") & ~i.contains("."), F.concat(system, F.lit("."), i)).otherwise(i))))


def system_prefix(c: Column) -> Column:
    return F.regexp_extract(c, r"^([^0-9]*[0-9]*)", 1)


def code_key(c: Column) -> Column:
    """A code without separators, folded and in upper case."""
    return fold_mark(F.upper(F.regexp_replace(c, r"[\s._/\\-]+", "")))


def location_key(c: Column, mode: str = "light") -> Column:
    """A location in one of three strengths: strict as it is; light in base form without room words; relaxed without leading zeros and marks, too. Nothing is the whole object."""
    if mode == "strict":
        return c
    light = F.regexp_replace(base_text(c), r"^(помещение|пом\.?|комната|комн\.?|room)\s*№?\s*", "")
    out = F.regexp_replace(F.regexp_replace(light, r"[^\p{L}\p{N}]+", ""), r"^0+(?=[0-9])", "") if mode == "relaxed" else light
    return F.when(c.isNull() | (F.trim(c) == ""), "object").otherwise(out)


def normalize_location(c: Column) -> Column:
    """Room words and leading zeros off."""
    return F.regexp_replace(F.regexp_replace(base_text(c), r"^(помещение|пом\.?|комната|комн\.?|room)\s*№?\s*", ""), r"^0+(?=[0-9])", "")


def room_list(c: Column) -> Column:
    """«267, 270-272» as numbers; a range whose end is before its begin is its begin."""
    parts = F.regexp_extract_all(F.translate(c, "–—−", "---"), F.lit(r"[0-9]+(?:\s*-\s*[0-9]+)?"), F.lit(0))
    low = lambda p: F.regexp_extract(p, r"^([0-9]+)", 1).cast("int")
    high = lambda p: F.coalesce(F.regexp_extract(p, r"-\s*([0-9]+)$", 1).try_cast("int"), low(p))
    return F.flatten(F.transform(parts, lambda p: F.when(high(p) >= low(p), F.sequence(low(p), high(p))).otherwise(F.array(low(p)))))


def system_counts(rows: DataFrame, by: list[str], mark: str) -> DataFrame:
    """(by, system, marks): distinct marks of each system prefix; marks without a prefix are left out."""
    own = rows.select(*by, mark, system_prefix(F.col(mark)).alias("system")).where("system <> ''")
    return own.groupBy(*by, "system").agg(F.count_distinct(mark).alias("marks"))


#: Abbreviations that end no sentence.
ABBREVIATIONS = ("см", "рис", "табл", "стр", "п", "пп", "ст", "т", "г", "ул", "д", "кв", "им", "др", "пр", "e.g", "i.e", "no")


def whole_sentences(c: Column) -> Column:
    """Sentences of a text; a stop behind an abbreviation or a single letter ends none."""
    marked = F.regexp_replace(c, r"(?iu)(?<![\p{L}])((?:" + "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS) + r")|\p{Lu})\.(?=\s)", "$1\u0001")
    parts = F.split(marked, r"(?<=[.!?])\s+(?=[\p{Lu}\p{N}«\"])")
    return F.filter(F.transform(parts, lambda s: F.trim(F.translate(s, "\u0001", "."))), lambda s: s != "")


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, r"(?<=[.!?])\s+(?=\p{Lu})"), F.trim), lambda s: s != "")


def is_negated(c: Column) -> Column:
    return base_text(c).rlike(r"(^|[^а-я])(не|без|нет|отсутств)")


def member_path_problems(c: Column) -> Column:
    """Names of what makes an archive member's path unsafe."""
    checks = (("ABSOLUTE", c.rlike(r"^([/\\]|[A-Za-z]:)")), ("PARENT", c.rlike(r"(^|[/\\])\.\.([/\\]|$)")), ("CONTROL", c.rlike(r"[\x00-\x1f]")), ("EMPTY", F.trim(c) == ""))
    return F.array_compact(F.array(*[F.when(x, F.lit(n)) for n, x in checks]))


def sheet_number(c: Column) -> Column:
    return F.regexp_extract(c, r"(?iu)(?:лист|sheet|л\.)\s*№?\s*([0-9]+)", 1).try_cast("int")


def text_windows(c: Column, size: int = 20_000, overlap: int = 512) -> Column:
    """Windows of a text, each overlapping the one before: structs (at, part). They cover the whole text."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    return F.transform(starts, lambda s: F.struct(s.alias("at"), F.substr(c, s + 1, F.lit(size)).alias("part")))


def script_shares(c: Column) -> Column:
    """struct of shares of Cyrillic, Latin and replacement characters among all."""
    n = F.greatest(F.length(c), F.lit(1))
    return F.struct((F.regexp_count(c, F.lit("[А-Яа-яЁё]")) / n).alias("cyrillic"), (F.regexp_count(c, F.lit("[A-Za-z]")) / n).alias("latin"), (F.regexp_count(c, F.lit("�")) / n).alias("garbled"))


def text_statistics(c: Column) -> Column:
    """struct of characters, Latin letters, digits and lines; zeros and one line for an empty text."""
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("bigint")
    return F.struct(F.length(c).cast("bigint").alias("n"), count("[A-Za-z]").alias("latin"), count("[0-9]").alias("digits"), F.size(F.split(c, "\n")).cast("bigint").alias("lines"))


def magic(content: Column) -> Column:
    """Media type by first bytes. Signatures."""
    head = F.hex(F.substring(content, 1, 8))
    out = F.lit("application/octet-stream")
    for sign, kind in (("25504446", "application/pdf"), ("504B0304", "application/zip"), ("377ABCAF271C", "application/x-7z-compressed"), ("526172211A07", "application/vnd.rar"), ("89504E47", "image/png"), ("FFD8FF", "image/jpeg"), ("4143313", "image/vnd.dwg"), ("1F8B", "application/gzip")):
        out = F.when(head.startswith(sign), kind).otherwise(out)
    return out


def box_area(b: Column) -> Column:
    return F.greatest(b[2] - b[0], F.lit(0.0)) * F.greatest(b[3] - b[1], F.lit(0.0))


def box_intersection(a: Column, b: Column) -> Column:
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def box_iou(a: Column, b: Column) -> Column:
    inter = box_intersection(a, b)
    union = box_area(a) + box_area(b) - inter
    return F.when(union <= 0, 0.0).otherwise(inter / union)


def rotated_point(x: Column, y: Column, width: Column, height: Column, rotation: int) -> tuple[Column, Column]:
    """A page point in normalised coordinates after a rotation by quarter turns."""
    nx, ny = x / width, y / height
    return {0: (nx, ny), 90: (1 - ny, nx), 180: (1 - nx, 1 - ny), 270: (ny, 1 - nx)}[rotation % 360]


def cropped_point(x: Column, y: Column, crop: tuple[float, float, float, float]) -> tuple[Column, Column]:
    """A point of a page in the normalised coordinates of a part of it; outside of it below 0 or above 1."""
    return (x - crop[0]) / (crop[2] - crop[0]), (y - crop[1]) / (crop[3] - crop[1])


def sorted_json_sha256(**fields: Column) -> Column:
    """sha256 of the JSON of named fields in the order of their names, nulls included."""
    return F.sha2(F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def canonical_sha256(*columns: Column) -> Column:
    return F.sha2(F.to_json(F.struct(*columns)), 256)
