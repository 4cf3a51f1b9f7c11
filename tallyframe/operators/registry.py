"""Operators on files: duplicates, stages, links between codes and between sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_duplicates(files: DataFrame, key: str = "sha256", file: str = "file_id") -> DataFrame:
    """(key, file, first_file, n) of each file whose content others have. Null contents are no duplicates. Groups are counted before files meet them, and no group is gathered."""
    groups = files.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(file).alias("first_file"), F.count("*").alias("n")).where("n > 1")
    return files.select(key, file).join(groups, key)


def near_duplicates(files: DataFrame, by: list[str], key: str = "sha256", file: str = "file_id") -> DataFrame:
    """Groups of equal (page count, fingerprint) with at least two contents."""
    return files.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(key).alias("contents"), F.min(file).alias("first_file")).where("n > 1 and contents >= 2")


def first_page_matches(files: DataFrame, fingerprint: str, pages: str = "pages", file: str = "file_id") -> DataFrame:
    """Fingerprints that files of different page counts share."""
    return files.groupBy(fingerprint).agg(F.count("*").alias("n"), F.count_distinct(pages).alias("page_counts"), F.min(file).alias("first_file")).where("page_counts > 1")


def representatives(files: DataFrame, group: Column, excluded: Column, file: str = "file_id") -> DataFrame:
    """Each file's representative: the lowest id of its group that is not excluded, else its own."""
    low = F.min(F.when(~excluded, F.col(file))).over(Window.partitionBy(group))
    return files.withColumn("representative", F.coalesce(low, F.col(file)))


def stage_votes(signals: DataFrame, key: str, stage: str = "stage", weight: str = "weight", least: int = 2, margin: int = 2, factor: float = 1.5) -> DataFrame:
    """(key, stage, confidence): the stage with most weight if it has `least`, leads by `margin` and by `factor`; else null. Ties go to the lower name."""
    sums = signals.groupBy(key, stage).agg(F.sum(weight).alias("w"))
    w = Window.partitionBy(key).orderBy(F.desc("w"), stage)
    top = sums.withColumns({"_n": F.row_number().over(w), "_next": F.coalesce(F.lead("w").over(w), F.lit(0))}).where("_n = 1")
    lead = F.col("w") - F.col("_next")
    sure = (F.col("w") >= least) & (lead >= margin) & (F.col("w") >= factor * F.col("_next"))
    return top.select(key, F.when(sure, F.col(stage)).alias(stage), F.when(sure, F.round(1 - F.exp(-lead / 3), 6)).alias("confidence"))


def near_codes(codes: DataFrame, known: DataFrame, code: str, most: int = 1) -> DataFrame:
    """(code, match): the one known code of equal length at distance 1 to `most`; codes with several are left out. Blocked on length.

    Distance 1 at equal length is one replaced character, so rows meet on (length, place, code without that character) instead of pairwise.
    """
    if most != 1:
        raise ValueError("one replaced character only")

    def keyed(df: DataFrame, name: str) -> DataFrame:
        places = F.transform(F.sequence(F.lit(1), F.length(name)), lambda i: F.struct(i.alias("i"), F.concat(F.substr(F.col(name), F.lit(1), i - 1), F.lit("\0"), F.substr(F.col(name), i + 1)).alias("rest")))
        return df.where(F.length(name) > 0).select(name, F.explode(places).alias("p")).select(name, "p.i", "p.rest")

    other = known.select(F.col(code).alias("match")).distinct()
    hits = keyed(codes.select(code).distinct(), code).join(keyed(other, "match"), ["i", "rest"]).where(F.col(code) != F.col("match")).select(code, "match").distinct()
    return hits.groupBy(code).agg(F.count("*").alias("n"), F.min("match").alias("match")).where("n = 1").drop("n")


def similarity(a: Column, b: Column) -> Column:
    """1 - Levenshtein distance / longer length; 1 for two empty strings."""
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(a, b) / longer)


def nearest_codes(codes: DataFrame, known: DataFrame, code: str, block: str, least: float = 0.75, ladder: tuple[float, ...] = (0.98, 0.90, 0.80, 0.65)) -> DataFrame:
    """Best known code within a block by similarity, at `least` or more, with its step of the ladder; ties take the lower code."""
    own, other = codes.select(block, code).distinct(), known.select(block, F.col(code).alias("match")).distinct()
    near = F.abs(F.length(code) - F.length("match")) <= (1 - least) * F.greatest(F.length(code), F.length("match"))  # a distance is never less than the difference of lengths
    pairs = own.join(other, block).where(near).withColumn("score", similarity(F.col(code), F.col("match"))).where(F.col("score") >= least)
    best = pairs.groupBy(block, code).agg(F.min_by(F.struct("match", "score"), F.struct(-F.col("score"), "match")).alias("_b")).select(block, code, "_b.match", "_b.score")
    step = F.lit(len(ladder))
    for i, x in reversed(list(enumerate(ladder))):
        step = F.when(F.col("score") >= x, i).otherwise(step)
    return best.withColumn("step", step)


def in_registry(acts: DataFrame, registry: DataFrame, key: str, complete: Column) -> DataFrame:
    """acts with in_registry: TRUE if found, FALSE if the registry is complete, else unknown."""
    known = registry.select(key).distinct().withColumn("_found", F.lit(True))
    return acts.join(known, key, "left").withColumn("in_registry", F.when(F.col("_found"), True).when(complete, False)).drop("_found")


def sheet_overlap(rooms: DataFrame, stage_col: str, page: str, room: str, a: str, b: str, shared: int = 3) -> DataFrame:
    """Pages of two stages that share at least `shared` rooms: shared, overlap (of the smaller page), jaccard. An equi join on the room."""
    own = rooms.select(stage_col, page, room).where(F.col(room).isNotNull()).distinct()
    sizes = own.groupBy(stage_col, page).agg(F.count("*").alias("size"))
    left, right = (own.where(F.col(stage_col) == s).select(F.col(page).alias(f"page_{k}"), room) for s, k in ((a, "a"), (b, "b")))
    pairs = left.join(right, room).groupBy("page_a", "page_b").agg(F.count("*").alias("shared")).where(F.col("shared") >= shared)
    size = lambda s, k: sizes.where(F.col(stage_col) == s).select(F.col(page).alias(f"page_{k}"), F.col("size").alias(f"size_{k}"))
    both = pairs.join(size(a, "a"), "page_a").join(size(b, "b"), "page_b")
    return both.select("page_a", "page_b", "shared", (F.col("shared") / F.least("size_a", "size_b")).alias("overlap"), (F.col("shared") / (F.col("size_a") + F.col("size_b") - F.col("shared"))).alias("jaccard"))


def strict_majority(hits: DataFrame, key: str, target: str, least: int = 2) -> DataFrame:
    """Each key's most frequent target if it has `least` hits and no tie."""
    counts = hits.groupBy(key, target).agg(F.count("*").alias("n"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), target)
    top = counts.withColumns({"_r": F.row_number().over(w), "_next": F.coalesce(F.lead("n").over(w), F.lit(0))})
    return top.where((F.col("_r") == 1) & (F.col("n") >= least) & (F.col("n") > F.col("_next"))).select(key, target, "n")


def multiset_hash(rows: DataFrame, columns: list[Column]) -> Column:
    """Order-independent hash of a group's rows, as digits: sum of 64 bits of each row's sha256, so partial sums combine, nothing is collected and 10^18 rows fit."""
    digest = F.sha2(F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("\x00")) for c in columns]), 256)
    return F.sum(F.conv(F.substring(digest, 1, 16), 16, 10).cast("decimal(20,0)")).cast("string")
