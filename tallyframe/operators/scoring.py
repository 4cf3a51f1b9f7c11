"""Operators that score predictions against gold labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_wins(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def confusion(rows: DataFrame, by: list[str], gold: Column, predicted: Column) -> DataFrame:
    """tp, fp, fn and tn of each group."""
    return rows.groupBy(*by).agg(F.count_if(gold & predicted).alias("tp"), F.count_if(~gold & predicted).alias("fp"), F.count_if(gold & ~predicted).alias("fn"), F.count_if(~gold & ~predicted).alias("tn"))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def prf(counts: DataFrame, digits: int = 6) -> DataFrame:
    """precision, recall and f1, 0 where undefined."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.withColumns({"precision": F.round(ratio(tp, tp + fp), digits), "recall": F.round(ratio(tp, tp + fn), digits), "f1": F.round(ratio(2 * tp, 2 * tp + fp + fn), digits)})


def detection(gold: DataFrame, predicted: DataFrame, keys: list[str]) -> DataFrame:
    """One row tp, fp, fn over deduplicated keys."""
    g, p = gold.select(*keys).distinct().withColumn("_g", F.lit(True)), predicted.select(*keys).distinct().withColumn("_p", F.lit(True))
    both = g.join(p, keys, "full_outer")
    return both.agg(F.count_if(F.col("_g") & F.col("_p")).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_p").isNull()).alias("fn"))


def group_detection(gold: DataFrame, predicted: DataFrame, group: str, keys: list[str], least_share: float = 0.0) -> DataFrame:
    """Gold groups found: some of their keys predicted, and at least least_share of them."""
    hits = gold.select(group, *keys).distinct().join(predicted.select(*keys).distinct().withColumn("_hit", F.lit(1)), keys, "left")
    sizes = hits.groupBy(group).agg(F.count("*").alias("size"), F.count("_hit").alias("hits"))
    return sizes.withColumn("found", (F.col("hits") > 0) & (F.col("hits") >= least_share * F.col("size")))


def localisation(gold: DataFrame, predicted: DataFrame, key: str, pages: str) -> DataFrame:
    """Recall and Jaccard of evidence pages, and any hit, of each key of gold."""
    both = gold.select(key, F.col(pages).alias("_g")).join(predicted.select(key, F.col(pages).alias("_p")), key, "left")
    have = F.coalesce("_p", F.array().cast(predicted.schema[pages].dataType))
    shared = F.size(F.array_intersect("_g", have))
    return both.select(key, F.round(ratio(shared, F.size(F.array_distinct("_g"))), 6).alias("recall"), F.round(ratio(shared, F.size(F.array_union("_g", have))), 6).alias("jaccard"), (shared > 0).alias("any_hit"))


def gate(total: Column, missed_critical: Column, cap: float = 59.0) -> Column:
    """A missed critical checkpoint caps the total."""
    return F.when(missed_critical, F.least(total, F.lit(cap))).otherwise(total)


def breakdown(rows: DataFrame, keys: list[str], gold: Column, predicted: Column) -> DataFrame:
    """P, R and F1 by each single key, as GROUPING SETS in one pass."""
    marked = rows.withColumns({"_gold": gold, "_predicted": predicted})
    sets = [[F.col(k)] for k in keys]
    counts = marked.groupingSets(sets, *keys).agg(F.count_if(F.col("_gold") & F.col("_predicted")).alias("tp"), F.count_if(~F.col("_gold") & F.col("_predicted")).alias("fp"), F.count_if(F.col("_gold") & ~F.col("_predicted")).alias("fn"))
    return prf(counts)


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Cohen's kappa of two raters: n, observed, expected, kappa (0 where undefined)."""
    cells = pairs.groupBy(a, b).agg(F.count("*").alias("n"))
    rows = cells.groupBy(F.col(a).alias("_k")).agg(F.sum("n").alias("_a"))
    cols = cells.groupBy(F.col(b).alias("_k")).agg(F.sum("n").alias("_b"))
    chance = rows.join(cols, "_k").agg(F.sum(F.col("_a") * F.col("_b")).alias("_ab"))
    seen = cells.agg(F.sum("n").alias("n"), F.sum(F.when(F.col(a) == F.col(b), F.col("n")).otherwise(0)).alias("_same"))
    one = seen.crossJoin(F.broadcast(chance))  # two single rows
    out = one.select("n", (F.col("_same") / F.col("n")).alias("_o"), (F.col("_ab") / (F.col("n") * F.col("n"))).alias("_e"))
    return out.select("n", F.round("_o", 6).alias("observed"), F.round("_e", 6).alias("expected"), F.round(F.when(F.col("_e") == 1, 0.0).otherwise((F.col("_o") - F.col("_e")) / (1 - F.col("_e"))), 6).alias("kappa"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson interval of a proportion; (0, 1) without trials."""
    p, zz = k / n, z * z
    centre, spread = p + zz / (2 * n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n))
    low = F.when(n == 0, 0.0).otherwise((centre - spread) / (1 + zz / n))
    high = F.when(n == 0, 1.0).otherwise((centre + spread) / (1 + zz / n))
    return low, high


def stratified_quotas(strata: DataFrame, n_col: str, key: str, sample: int) -> DataFrame:
    """Quotas of a sample by largest remainders, at least 1 a stratum: adds `quota`."""
    exact = F.col(n_col) * sample / F.sum(n_col).over(Window.partitionBy())
    out = strata.withColumns({"_floor": F.floor(exact).cast("bigint"), "_rest": exact - F.floor(exact)})
    left = sample - F.sum("_floor").over(Window.partitionBy())
    place = F.row_number().over(Window.orderBy(F.desc("_rest"), key))
    return out.withColumn("quota", F.greatest(F.lit(1), F.col("_floor") + F.when(place <= left, 1).otherwise(0))).drop("_floor", "_rest")


def stratified_sample(rows: DataFrame, key: str, id_col: str, sample: int, seed: str) -> DataFrame:
    """The quota of each stratum, in order of a seeded hash of the id."""
    quotas = stratified_quotas(rows.groupBy(key).agg(F.count("*").alias("_size")), "_size", key, sample)
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string"))), id_col))
    return rows.withColumn("_place", place).join(F.broadcast(quotas.select(key, "quota")), key).where(F.col("_place") <= F.col("quota")).drop("_place", "quota")


def leave_one_out(scores: DataFrame, candidate: str, fold: str, score: str) -> DataFrame:
    """For each fold, the candidate of best mean over the other folds (ties: lower candidate) and its score on the fold."""
    own = Window.partitionBy(candidate)
    mean = F.try_divide(F.sum(score).over(own) - F.col(score), F.count("*").over(own) - 1)  # null for a candidate of one fold
    ranked = scores.withColumn("mean_others", F.round(mean, 9))
    n = F.row_number().over(Window.partitionBy(fold).orderBy(F.desc("mean_others"), candidate))
    return ranked.withColumn("_n", n).where("_n = 1").drop("_n")


def bootstrap_f1(objects: DataFrame, key: str, draws: int, seed: int) -> DataFrame:
    """Mean and 2.5 / 97.5 percentiles of F1 over resampled objects.

    Draw b weighs object o by a Poisson(1) variate from a hash of (seed, b, o): no shuffle of objects, one partial aggregation by draw.
    """
    u = F.pmod(F.xxhash64(F.lit(seed), F.col("b"), F.col(key)), F.lit(1 << 30)) / float(1 << 30)
    weight = F.lit(0)
    for bound, w in ((0.36787944, 1), (0.73575888, 2), (0.91969860, 3), (0.98101184, 4), (0.99634015, 5)):
        weight = F.when(u >= bound, w).otherwise(weight)
    drawn = objects.select(key, "tp", "fp", "fn", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("b")).withColumn("w", weight)
    f1 = drawn.groupBy("b").agg(F.sum(F.col("w") * F.col("tp")).alias("tp"), F.sum(F.col("w") * F.col("fp")).alias("fp"), F.sum(F.col("w") * F.col("fn")).alias("fn")).select(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"))
    return f1.agg(F.avg("f1").alias("mean"), F.percentile("f1", F.lit(0.025)).alias("low"), F.percentile("f1", F.lit(0.975)).alias("high"))
