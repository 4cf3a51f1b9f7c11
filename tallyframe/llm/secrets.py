"""Secret scan: a random forest removes false positives among candidate strings. DataFrame functions only.

Candidates are all runs of 12 or more key characters in a word that have a digit or change case, and runs of any length and case
that are assigned to a name of a secret. Features: length, changes between
character classes, shares of digits, capitals, hexadecimal digits and other signs, distinct characters, dictionary coverage
(share of the candidate in runs of letters that are words of the dictionary: those that make up at least a DICTIONARYth of all words), the neighbouring
words, before and after, and the path. The forest is fitted on the driver, in plain Python, on at most FIT_FINDINGS labelled findings a class (those of
least hash; a documented bound) and compiled to one Column, so all candidates are judged inside the JVM.

Labelled findings: a table (candidate, is_secret), or, without one, findings of formats that are secrets by themselves (key ids of a
fixed prefix and length, assignments to names of secrets) and such that are none (addresses, numbers, dates, links).

At scale: texts never move; a candidate is a small row. Words are counted with partial sums; the dictionary is broadcast,
of DICTIONARY words at most by its definition. Coverage is found once for each distinct candidate and joined back, a join that Spark splits where one candidate is hot.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, least_hashed, stored

FIT_FINDINGS = 3000
DICTIONARY = 100_000
TREES, DEPTH, LEAST = 15, 6, 5
KEY = "[A-Za-z0-9+/_=.@-]"
NAMES = "(?i)(secret|token|passw|pwd|api.?key|auth|credential|private|bearer)"
#: A name and what is assigned to it, or a run of key characters; what comes off its front; an assignment to a name of a secret; words that can hold either.
HEAD = "^[\"'(]*[A-Za-z0-9_.-]*[A-Za-z_.-][\"']?[=:]+(?=[\"'(]*[A-Za-z0-9+/_.@-])"
PART = "[\"'(]*[A-Za-z0-9_.-]*[A-Za-z_.-][\"']?[=:]+[\"'(]*[A-Za-z0-9+/_.@-]" + KEY + "*|" + KEY + "+"
NAMED = "(?i)^[\"'(]*[a-z0-9_.-]*" + NAMES.replace("(?i)", "") + "[a-z0-9_.-]*[\"']?[=:]"
GATE = KEY + "{12,}|" + NAMES + ".*[=:]"
PATHS = "(?i)(test|example|sample|mock|fixture|doc)"
FEATURES = ("size", "changes", "digits", "capitals", "hexadecimal", "signs", "distinct", "covered", "named", "assigned", "quoted", "near_name", "test_path", "at", "dots", "after_name", "after_link")


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source") -> DataFrame:
    """(id, path, word_no, before, word, after, candidate) of every candidate in whole texts: of each word, in order, key runs of 12 and more with a digit or a change of
    case, and runs assigned to a name of a secret. The word of several candidates is cut: each has its own name and marks beside it.

    Words that are too short and beside no mark of an assignment are passed over by plain comparisons; the rest are rows before any pattern looks at them.
    Null and empty texts have none; repeated rows give repeated candidates; null ids and paths stay null.
    """
    words = F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")
    path = F.col(path_col).cast("string") if path_col else F.lit(None).cast("string")
    rows = docs.select(F.col(id_col).alias("id"), path.alias("path"), words.alias("w"))
    word = lambda i: F.get("w", i)
    mark = lambda x: F.coalesce(x.endswith("=") | x.endswith(":"), F.lit(False))
    gate = lambda i: (F.length(word(i)) >= 12) | word(i).contains("=") | word(i).contains(":") | mark(word(i - 1))
    hit = lambda i: F.struct(i.alias("word_no"), word(i - 2).alias("w2"), word(i - 1).alias("w1"), word(i).alias("word"), F.coalesce(word(i + 1), F.lit("")).alias("after"))
    found = rows.select("id", "path", F.explode(F.transform(F.filter(F.sequence(F.lit(0), F.size("w") - 1), gate), hit)).alias("h")).select("id", "path", "h.*")
    named = mark(F.col("w1")) & F.concat_ws("", "w2", "w1").rlike(NAMES + "[^=:]*[=:]+$") & (F.col("w1").rlike(NAMES) | F.col("w1").rlike("^[=:]+$"))
    found = found.withColumn("named", F.coalesce(named, F.lit(False))).where(F.col("named") | F.col("word").rlike(GATE))
    run = lambda x: F.regexp_replace(F.regexp_replace(x, HEAD, ""), "^[\"'(]+", "")
    found = found.withColumn("parts", F.transform(F.regexp_extract_all("word", F.lit(PART), F.lit(0)), lambda x, k: F.struct(x.alias("part"), run(x).alias("run"), k.alias("k"))))
    plain = lambda x: (F.length(x) >= 12) & (x.rlike("[0-9]") | x.rlike("[a-z][A-Z]"))
    kept = F.filter("parts", lambda s: (s["run"] != "") & (plain(s["run"]) | ((s["k"] == 0) & F.col("named")) | s["part"].rlike(NAMED)))
    found = found.withColumn("kept", kept).select("id", "path", "word_no", F.concat_ws(" ", "w2", "w1").alias("before"), "word", "after", F.size("kept").alias("n"), F.explode("kept").alias("r"))
    return found.select("id", "path", "word_no", "before", F.when(F.col("n") == 1, F.col("word")).otherwise(F.col("r.part")).alias("word"), "after", F.col("r.run").alias("candidate"))


def dictionary(docs: DataFrame, text_col: str = "text", most: int = DICTIONARY) -> DataFrame:
    """Words of three letters and more that stand at least twice and make up at least 1 / most of all such words: there can't be more than `most`."""
    words = docs.select(F.explode(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+")).alias("raw")).groupBy("raw").agg(F.count("*").alias("n"))
    plain = words.select(F.lower(F.regexp_extract("raw", r"^\P{L}*(\p{L}{3,})\P{L}*$", 1)).alias("run"), "n").where("run <> ''")
    counts = stored(plain.groupBy("run").agg(F.sum("n").alias("n")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    return counts.where(F.col("n") >= max(2, total / most)).select("run")


def _share(pattern: str) -> Column:
    return F.regexp_count("candidate", F.lit(pattern)) / F.length("candidate")


def featured(found: DataFrame, words: DataFrame) -> DataFrame:
    """found with the features of FEATURES as doubles."""
    runs = found.select("candidate").distinct().select("candidate", F.explode_outer(F.regexp_extract_all("candidate", F.lit(r"\p{L}{3,}"), F.lit(0))).alias("run")).withColumn("run", F.lower("run"))
    covered = runs.join(F.broadcast(words.withColumn("known", F.lit(True))), "run", "left").groupBy("candidate").agg((F.sum(F.when(F.col("known"), F.length("run")).otherwise(0)) / F.length("candidate")).alias("covered"))
    changes = sum((F.regexp_count("candidate", F.lit(p)) for p in ("[a-z](?=[A-Z0-9])", "[A-Z](?=[0-9])", "[0-9](?=[A-Za-z])", "[A-Z](?=[a-z])")), F.lit(0))
    own = {
        "size": F.least(F.length("candidate"), F.lit(200)),
        "changes": changes / F.length("candidate"),
        "digits": _share("[0-9]"),
        "capitals": _share("[A-Z]"),
        "hexadecimal": _share("[0-9a-fA-F]"),
        "signs": _share("[^A-Za-z0-9]"),
        "distinct": F.size(F.array_distinct(F.split("candidate", ""))) / F.length("candidate"),
        "named": F.col("word").rlike(NAMES),
        "assigned": F.col("word").rlike(r"^[\"']?[A-Za-z_.-]+[=:]") | F.col("before").rlike(r"[=:]$"),
        "quoted": F.col("word").rlike("[\"']"),
        "near_name": F.col("before").rlike(NAMES),
        "test_path": F.coalesce(F.col("path").rlike(PATHS), F.lit(False)),
        "at": F.col("candidate").contains("@"),
        "dots": F.regexp_count("candidate", F.lit("[.]")),
        "after_name": F.col("after").rlike(NAMES),
        "after_link": F.col("after").rlike("^(=|:|->|=>|[|&])"),
    }
    out = found.join(covered, "candidate").withColumns({k: v.cast("double") for k, v in own.items()})
    return out.withColumn("covered", F.coalesce("covered", F.lit(0.0)))


def format_label() -> Column:
    """1 for formats that are secrets, 0 for such that are none, else null: the findings that can be labelled without a table."""
    c, w, b = F.col("candidate"), F.col("word"), F.col("before")
    secret = c.rlike("^AKIA[0-9A-Z]{16}$") | (c.rlike("^[0-9a-f]{40}$") & b.rlike(NAMES)) | (w.rlike(NAMES.replace("(?i)", "(?i)^[\"']?\\w*") + "\\w*[=:]") & c.rlike("[0-9]"))
    none = c.rlike("^[^@]+@[^@]+[.][a-z]+[.]?$") | c.rlike(r"^[0-9.,:/T+-]+$") | c.rlike(r"^[A-Za-z]+[.]?$") | w.contains("://") | c.rlike("(?i)example|placeholder|xxxx|changeme")
    return F.when(secret & ~c.rlike("(?i)example|placeholder|xxxx|changeme"), 1).when(none, 0)


def grow(rows: list[tuple[list[float], int]], rng: random.Random, depth: int = DEPTH) -> tuple | float:
    """One tree: (feature, cut, left, right), or the share of secrets in a leaf; splits by Gini impurity over 4 random features and 8 cuts each."""
    n, ones = len(rows), sum(y for _, y in rows)
    if depth == 0 or n < 2 * LEAST or ones in (0, n):
        return (ones + 0.5) / (n + 1)
    best = (n * 2 * (ones / n) * (1 - ones / n) - 1e-9, None, None)
    for f in rng.sample(range(len(FEATURES)), 4):
        values = sorted({x[f] for x, _ in rows})
        cuts = [(a + b) / 2 for a, b in zip(values, values[1:], strict=False)]
        for cut in rng.sample(cuts, min(8, len(cuts))):
            side = [y for x, y in rows if x[f] <= cut]
            m, k = len(side), sum(side)
            if m < LEAST or n - m < LEAST:
                continue
            impurity = 2 * k * (m - k) / m + 2 * (ones - k) * (n - m - ones + k) / (n - m)
            if impurity < best[0]:
                best = (impurity, f, cut)
    if best[1] is None:
        return (ones + 0.5) / (n + 1)
    _, f, cut = best
    return (f, cut, grow([r for r in rows if r[0][f] <= cut], rng, depth - 1), grow([r for r in rows if r[0][f] > cut], rng, depth - 1))


def forest(rows: list[tuple[list[float], int]], trees: int = TREES, seed: int = 11) -> list:
    """Trees on bootstrap samples; without rows, one leaf of a half."""
    rng = random.Random(seed)
    return [grow([rng.choice(rows) for _ in rows], rng) for _ in range(trees)] if rows else [0.5]


def compiled(trees: list) -> Column:
    """The forest's mean as a Column over FEATURES."""

    def node(t: tuple | float) -> Column:
        return F.lit(float(t)) if isinstance(t, float) else F.when(F.col(FEATURES[t[0]]) <= t[1], node(t[2])).otherwise(node(t[3]))

    return sum((node(t) for t in trees), F.lit(0.0)) / len(trees)


def scan(docs: DataFrame, findings: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", path_col: str | None = "source", fit_findings: int = FIT_FINDINGS) -> DataFrame:
    """(id, word_no, candidate, score, secret) for every candidate; findings: labelled findings (candidate, is_secret), nulls left out."""
    found = stored(candidates(docs, id_col, text_col, path_col), "found")  # texts are searched once, though candidates are used twice
    rows = stored(featured(found, stored(dictionary(docs, text_col), "dictionary")), "candidates")
    if findings is None:
        known = rows.withColumn("y", format_label())
    else:
        one = findings.where("candidate is not null and is_secret is not null").groupBy("candidate").agg(F.max(F.col("is_secret").cast("int")).alias("y"))
        known = rows.join(one, "candidate")
    chosen = known.where("y is not null").select("y", *FEATURES, F.xxhash64("candidate", "word_no", "before").alias("h"))
    got = [r for y in (0, 1) for r in least_hashed(chosen.where(F.col("y") == y), "h", fit_findings, list(FEATURES)).orderBy("h", *FEATURES).collect()]
    trees = forest([([r[f] for f in FEATURES], r["y"]) for r in got])
    return rows.select(F.col("id").alias(id_col), "word_no", "candidate", compiled(trees).alias("score")).withColumn("secret", F.col("score") >= 0.5)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))
