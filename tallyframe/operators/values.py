"""Operators on extracted values: selection, ambiguity, comparison between stages.

A value row: key columns (parameter, location), stage, value, confidence, file_id, page_no and whatever else; keys, stages and
orders are parameters. Every ranking ends in a total order given by the caller, so results don't depend on partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HALF_ULP = 0.5


def usable(values: DataFrame) -> DataFrame:
    """Values that findings may rest on: not ambiguous, not abstained from, normalised."""
    return values.where(~F.coalesce(F.col("is_ambiguous"), F.lit(False)) & (F.coalesce(F.col("quality"), F.lit("OK")) != "ABSTAIN") & F.col("value").isNotNull())


def trusted(values: DataFrame) -> DataFrame:
    """Values that conflicts may rest on: quality OK and first candidate; ambiguous ones count. A limit (basis ГПЗУ, where values have a basis) is no value of the design."""
    own = values.where(F.coalesce(F.col("basis"), F.lit("")) != "ГПЗУ") if "basis" in values.columns else values
    return own.where((F.col("quality") == "OK") & (F.col("candidate_rank") == 1) & F.col("param_code").isNotNull())


def without_other_subject(values: DataFrame, pattern: str, text_col: str = "context_text") -> DataFrame:
    return values.where(~F.coalesce(F.col(text_col).rlike(pattern), F.lit(False)))


def best_per_key(values: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key under a total (ascending) order: one grouped minimum, which combines before the shuffle."""
    rest = [c for c in values.columns if c not in keys]
    return values.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")).select(*keys, "_first.*").select(*values.columns)


def best_pairs(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], order: list[Column], stage_col: str = "stage", carry: tuple[str, ...] = ("value",)) -> DataFrame:
    """The best row of each stage beside that of another, for each (expected, actual) pair of stages: one grouped minimum a stage, without a sort or a self-join."""
    stages = list(dict.fromkeys(s for p in pairs for s in p))
    wide = values.groupBy(*keys).agg(*[F.min_by(F.struct(*carry), F.when(F.col(stage_col) == s, F.struct(*order))).alias(f"_{i}") for i, s in enumerate(stages)])
    at = lambda s: F.col(f"_{stages.index(s)}")
    both = F.array_compact(F.array(*[F.when(at(a).isNotNull() & at(b).isNotNull(), F.struct(F.lit(f"{a}_{b}").alias("axis"), at(a).alias("e"), at(b).alias("a"))) for a, b in pairs]))
    return wide.select(*keys, F.explode(both).alias("_p")).select(*keys, "_p.axis", *[F.col(f"_p.e.{c}").alias(f"expected_{c}") for c in carry], *[F.col(f"_p.a.{c}").alias(f"actual_{c}") for c in carry])


def candidate_lists(values: DataFrame, keys: list[str], order: list[Column], carry: tuple[str, ...] = ("value", "confidence"), most: int = 8) -> DataFrame:
    """The `most` first readings of each key under a total order, most confident first as the caller orders them, as an array of structs (the comparison's own bound).

    Rows beyond the bound are dropped before the shuffle, as far as Spark can tell.
    """
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return values.withColumn("_n", n).where(F.col("_n") <= most).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_n", *carry))).alias("candidates"))


def stage_pairs(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], stage_col: str = "stage", carry: tuple[str, ...] = ("value",)) -> DataFrame:
    """Expected and actual row of each key for each (expected, actual) stage pair: an equi join on the keys and the pair."""
    axes = F.array(*[F.struct(F.lit(f"{a}_{b}").alias("axis"), F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    sides = values.withColumn("_x", F.explode(axes)).select("*", "_x.*").drop("_x")
    expected = sides.where(F.col(stage_col) == F.col("a")).select(*keys, "axis", *[F.col(c).alias(f"expected_{c}") for c in carry])
    actual = sides.where(F.col(stage_col) == F.col("b")).select(*keys, "axis", *[F.col(c).alias(f"actual_{c}") for c in carry])
    return expected.join(actual, [*keys, "axis"])


def pairwise_delta(expected: Column, actual: Column, absolute: float = 0.0, relative: float = 0.0, half_ulp: Column | None = None, lower_is_violation: bool = True, same_unit: Column | None = None) -> Column:
    """EQUAL within the largest tolerance, else VIOLATION or IMPROVEMENT by direction; ABSTAIN for nulls and units that differ."""
    delta = actual - expected
    bound = F.greatest(F.lit(float(absolute)), F.abs(expected) * relative, F.lit(0.0) if half_ulp is None else half_ulp)
    worse = delta < 0 if lower_is_violation else delta > 0
    out = F.when(F.abs(delta) <= bound, "EQUAL").when(worse, "VIOLATION").otherwise("IMPROVEMENT")
    unknown = expected.isNull() | actual.isNull()
    return F.when(unknown if same_unit is None else unknown | ~F.coalesce(same_unit, F.lit(False)), "ABSTAIN").otherwise(out)


def ordinal_compare(expected_rank: Column, actual_rank: Column) -> Column:
    """CLASS_DOWNGRADED for a lower rank, EQUAL, CLASS_UPGRADED, ABSTAIN for an unknown rank."""
    return F.when(expected_rank.isNull() | actual_rank.isNull(), "ABSTAIN").when(actual_rank < expected_rank, "CLASS_DOWNGRADED").when(actual_rank == expected_rank, "EQUAL").otherwise("CLASS_UPGRADED")


def outside_bounds(value: Column, low: Column, high: Column) -> Column:
    """OUTSIDE_BOUNDS, WITHIN_BOUNDS or ABSTAIN; an open bound is null."""
    beyond = F.coalesce(value < low, F.lit(False)) | F.coalesce(value > high, F.lit(False))
    return F.when(value.isNull() | (low.isNull() & high.isNull()), "ABSTAIN").when(beyond, "OUTSIDE_BOUNDS").otherwise("WITHIN_BOUNDS")


def compare_sets(values: DataFrame, keys: list[str], pairs: list[tuple[str, str]], order: list[Column], most: int = 8, relative: float = 0.0, stage_col: str = "stage") -> DataFrame:
    """Set-valued comparison: EQUAL if any readings agree, else an IMPROVEMENT, and a VIOLATION only when no pair agrees; of one result the closest pair, then the surest.

    The `most` most confident readings a side stand against each other (the bound is the operator's own), so a key makes most * most pairs at most.
    """
    lists = candidate_lists(values, [*keys, stage_col], order, most=most).withColumnRenamed("candidates", "value")
    both = stage_pairs(lists, keys, pairs, stage_col)

    def pair(e: Column, a: Column) -> Column:
        result = pairwise_delta(e["value"], a["value"], relative=relative)
        rank = F.when(result == "EQUAL", 0).when(result == "IMPROVEMENT", 1).otherwise(2)
        return F.struct(rank.alias("rank"), F.abs(a["value"] - e["value"]).alias("delta"), (-F.least(e["confidence"], a["confidence"])).alias("unsure"), e["_n"].alias("i"), a["_n"].alias("j"), e["value"].alias("expected"), a["value"].alias("actual"), result.alias("result"))

    best = F.array_min(F.flatten(F.transform("expected_value", lambda e: F.transform("actual_value", lambda a: pair(e, a)))))
    return both.withColumn("_best", best).select(*keys, "axis", F.size("expected_value").alias("n_expected"), F.size("actual_value").alias("n_actual"), "_best.expected", "_best.actual", "_best.result")


def dominant(values: DataFrame, keys: list[str], value_col: str = "value", least: int = 3, factor: int = 2) -> DataFrame:
    """Each key's most printed reading, where printed at least `least` times and `factor` times as often as the next; ties take the lower value."""
    counts = values.groupBy(*keys, value_col).agg(F.count("*").alias("n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("n"), F.col(value_col))
    ranked = counts.withColumns({"_r": F.row_number().over(w), "runner_up": F.coalesce(F.lead("n").over(w), F.lit(0))})
    return ranked.where("_r = 1").drop("_r").withColumn("dominates", (F.col("n") >= least) & (F.col("n") >= factor * F.col("runner_up")))


def agreed_across_stages(values: DataFrame, keys: list[str], value_col: str = "value", stage_col: str = "stage", least: int = 2) -> DataFrame:
    """Readings of a key that at least `least` stages print."""
    return values.groupBy(*keys, value_col).agg(F.count_distinct(stage_col).alias("stages")).where(F.col("stages") >= least)


def shared_value(values: DataFrame, keys: list[str], value_col: str = "value", stage_col: str = "stage", confidence: str = "confidence", least: int = 2) -> DataFrame:
    """(keys, value, stages): of the readings that at least `least` stages print, the one of most stages, then the surest, then the lowest."""
    agreed = values.groupBy(*keys, value_col).agg(F.count_distinct(stage_col).alias("stages"), F.max(confidence).alias("_c")).where(F.col("stages") >= least)
    return agreed.groupBy(*keys).agg(F.min_by(F.struct(value_col, "stages"), F.struct(-F.col("stages"), -F.col("_c"), value_col)).alias("_r")).select(*keys, "_r.*")


def clusters(values: DataFrame, keys: list[str], order: list[str], value_col: str, tolerance: float, schema: str) -> DataFrame:
    """Greedy clusters: in order, a value joins the first cluster whose head agrees within the relative tolerance, else heads a new one.

    Order decides, so a key is one group; keys are bounded by what one object prints for one parameter. Adds `cluster` from 1.
    """

    def run(g):
        g = g.sort_values(order, kind="mergesort")
        heads, found = [], []
        for v in g[value_col]:
            k = next((i for i, h in enumerate(heads) if abs(v - h) <= tolerance * abs(h)), None)
            if k is None:
                heads.append(v)
                k = len(heads) - 1
            found.append(k + 1)
        return g.assign(cluster=found)

    return values.groupBy(*keys).applyInPandas(run, schema)


def value_conflicts(values: DataFrame, keys: list[str], value_col: str = "value", file_col: str = "file_id", most: int = 4) -> DataFrame:
    """Keys with 2 to `most` readings of which two stand in files that the other lacks: (keys, low, high, n_values, n_files).

    Readings are equal when identical; file sets of a key are compared by array functions, without a self-join.
    """
    sets = values.groupBy(*keys, value_col).agg(F.array_sort(F.collect_set(file_col)).alias("files"))
    per_key = sets.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(value_col).alias("v"), "files"))).alias("of"))
    few = per_key.where(F.size("of").between(2, most))
    own = F.exists("of", lambda a: F.exists("of", lambda b: (a["v"] != b["v"]) & (F.size(F.array_except(a["files"], b["files"])) > 0) & (F.size(F.array_except(b["files"], a["files"])) > 0)))
    files = F.size(F.array_distinct(F.flatten(F.col("of.files"))))
    return few.where(own & (files >= 2)).select(*keys, F.col("of")[0]["v"].alias("low"), F.element_at("of", -1)["v"].alias("high"), F.size("of").alias("n_values"), files.alias("n_files"))


def stage_extremes(values: DataFrame, keys: list[str], expected: str, actual: str, fallback: str, rank_col: str, value_col: str, stage_col: str = "stage") -> DataFrame:
    """Lowest value by rank of the expected and of the actual stage, taking the fallback stage where the expected one is silent, and the verdict."""
    least = lambda s: F.min_by(value_col, F.when(F.col(stage_col) == s, F.col(rank_col)))
    rank = lambda s: F.min(F.when(F.col(stage_col) == s, F.col(rank_col)))
    out = values.groupBy(*keys).agg(F.coalesce(least(expected), least(fallback)).alias("expected"), F.coalesce(rank(expected), rank(fallback)).alias("expected_rank"), least(actual).alias("actual"), rank(actual).alias("actual_rank"))
    return out.withColumn("result", ordinal_compare(F.col("expected_rank"), F.col("actual_rank")))


def tolerance_breaches(values: DataFrame, page: list[str], tolerance: Column, deviation: Column, by: str, least: int = 1, strong: float = 2.0) -> DataFrame:
    """Worst page of each `by`: deviations beyond the page's largest tolerance, where there are `least` or one is `strong` times it."""
    limits = values.groupBy(by, *page).agg(F.max(tolerance).alias("tolerance"), F.max(deviation).alias("worst"))
    counts = values.groupBy(by, *page, deviation.alias("_d")).agg(F.count("*").alias("_k"))
    pages = counts.join(limits, [by, *page]).groupBy(by, *page, "tolerance", "worst").agg(F.sum(F.when(F.col("_d") > F.col("tolerance"), F.col("_k")).otherwise(0)).alias("breaches"))
    ratio = F.try_divide("worst", "tolerance")
    hits = pages.where(((F.col("breaches") >= least) | (ratio >= strong)) & (F.col("tolerance") > 0)).withColumn("ratio", ratio)
    return best_per_key(hits, [by], [-F.col("ratio"), *map(F.col, page)])


def spec_decrease(items: DataFrame, key: list[str], size_col: str, stage_col: str, expected: str, actual: str) -> DataFrame:
    """Keys whose largest expected size is not printed by the actual stage, which prints smaller ones: (key, expected, actual)."""
    sizes = items.select(*key, size_col, stage_col).distinct()
    want = sizes.where(F.col(stage_col) == expected).groupBy(*key).agg(F.max(size_col).alias("expected"))
    have = sizes.where(F.col(stage_col) == actual).select(*key, F.col(size_col).alias("expected"))
    got = sizes.where(F.col(stage_col) == actual).groupBy(*key).agg(F.max(size_col).alias("actual"))
    return want.join(have, [*key, "expected"], "left_anti").join(got, key).where("actual < expected")


def spec_counts(items: DataFrame, key: list[str], file_col: str, stage_col: str, count: Column, expected: str, actual: str) -> DataFrame:
    """Keys that exactly one file of each stage prints, with a smaller count in the actual stage."""

    def side(stage: str, name: str) -> DataFrame:
        return items.where(F.col(stage_col) == stage).groupBy(*key).agg(F.count_distinct(file_col).alias("files"), F.sum(count).alias(name)).where("files = 1").drop("files")

    return side(expected, "expected").join(side(actual, "actual"), key).where("actual < expected")


def room_outcomes(labels: DataFrame, room: str, label: str, page: str, stage_col: str, expected: str, actual: str) -> DataFrame:
    """Label multisets of rooms of two stages (per label the largest count over pages): missing, extra, EQUAL / MISSING / EXTRA / CHANGED / RELOCATED.

    RELOCATED: every missing label is printed by the actual stage in another room.
    """
    pages = labels.groupBy(stage_col, room, label, page).agg(F.count("*").alias("n"))
    union = pages.groupBy(stage_col, room, label).agg(F.max("n").alias("n"))
    a = union.where(F.col(stage_col) == expected).select(room, label, F.col("n").alias("n_e"))
    b = union.where(F.col(stage_col) == actual).select(room, label, F.col("n").alias("n_a"))
    elsewhere = b.groupBy(label).agg(F.count("*").alias("_rooms"), F.min(room).alias("_room"))
    both = a.join(b, [room, label], "full_outer").join(elsewhere, label, "left")
    gone = F.greatest(F.coalesce("n_e", F.lit(0)) - F.coalesce("n_a", F.lit(0)), F.lit(0))
    came = F.greatest(F.coalesce("n_a", F.lit(0)) - F.coalesce("n_e", F.lit(0)), F.lit(0))
    found = F.coalesce((F.col("_rooms") > 1) | (F.col("_room") != F.col(room)), F.lit(False))
    out = both.groupBy(room).agg(F.sum(gone).alias("missing"), F.sum(came).alias("extra"), F.bool_and((gone == 0) | found).alias("_moved"))
    result = F.when((F.col("missing") == 0) & (F.col("extra") == 0), "EQUAL").when((F.col("missing") > 0) & F.col("_moved"), "RELOCATED").when(F.col("extra") == 0, "MISSING").when(F.col("missing") == 0, "EXTRA").otherwise("CHANGED")
    return out.select(room, "missing", "extra", result.alias("result"))
