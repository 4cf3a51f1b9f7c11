"""Near copies by the Jaccard similarity of word shingles: the corpus pipeline's stage. No pair is lost and none is taken on a hash of few bits.

1. SimHash by anchor-point covering (simhash.links) over the shingles' fingerprints gives candidates at BITS_APART or fewer differing bits; those that are
   similar at LEAST or more by their whole sets connect. Three of 64 bits reach only a part of the pairs of similarity 0.8, and a radius that reaches all of
   them (about 19 bits) would need more anchors than there are texts, so what is left is found by prefix filtering:
2. Texts whose sets of shingles are similar at LEAST or more share LEAST of either set. So with all shingles in one order, they share one among the first
   n - ceil(LEAST n) + 1 of each, and of the firsts of the one whose last first stands earlier they share all but what similar sets may lose; and no
   shared shingle stands at places so far apart that the rest could not make up for it. Texts that share too few of their firsts with anyone are left out.
   Pairs that remain are compared by their whole sets. Any order is right. This one puts shingles that are frequent in a sample last, so that passages of
   many texts seldom make pairs.

Only connections matter: where more than LARGE texts share a shingle, they are compared with four leaders (two of those that share most of their firsts
with others) before the others, and then
only pairs of texts that are not connected yet, of each text the pair that shares most first. A large group of near copies so makes few pairs.

At scale: a row of each prefix shingle (a fifth of the words) is shuffled, texts are shuffled three times; the frequent shingles are broadcast, FREQUENT at most.
Equal sets are told by 64 bits, shingles by 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import one_of_each, ordered_row, release, stored
from .components import components
from .simhash import CHUNK, SEED, links, spans

WORDS, LEAST = 5, 0.8
SAMPLE, OFTEN, FREQUENT = 16, 5, 200_000
LARGE = 32


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Distinct 64-bit hashes of the word shingles of text, ascending; none for no words or null."""
    import xxhash

    whole, starts, ends = spans(text, words)
    return np.unique(np.fromiter((xxhash.xxh64_intdigest(whole[s:e], SEED) for s, e in zip(starts, ends, strict=True)), np.uint64, len(starts)).view(np.int64))


def fingerprint(own: np.ndarray) -> int:
    """Signed 64-bit SimHash of a set of hashes; 0 for an empty one."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(own), CHUNK):
        ones += np.unpackbits(own[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(own), bitorder="little").view("<i8")[0]) if len(own) else 0


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, np.int64), *arrays])))


def _each(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(x.as_py(), words))], ["h"])

    return run


def _prefixes(words: int, least: float, shared) -> Callable:
    """row, text to row, set's name, size of set, its fingerprint, its first shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        often, rank = shared.value
        for b in batches:
            names, sizes, fps, firsts = [], [], [], []
            for x in b.column(1):
                own = shingles(x.as_py(), words)
                names.append(xxhash.xxh64_intdigest(own.tobytes(), SEED) if len(own) else 0)
                sizes.append(len(own))
                fps.append(fingerprint(own))
                if len(often):
                    at = np.minimum(np.searchsorted(often, own), len(often) - 1)
                    own = own[np.argsort(np.where(often[at] == own, rank[at], 0), kind="stable")]
                firsts.append(own[: len(own) - math.ceil(least * len(own)) + 1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), pa.array(fps, pa.int64()), _lists(firsts)], ["row", "name", "n", "fp", "firsts"])

    return run


def _sets(words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([shingles(x.as_py(), words) for x in part.column(1)])], ["name", "set"])

    return run


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """(row, root) for each row of docs: rows with one root are connected by pairs of sets similar at least or more; texts without words are copies of each other."""
    spark = docs.sparkSession
    rows = docs.select(ordered_row(id_col, text_col).alias("row"), F.col(text_col).alias("text"))
    sample = docs.where(F.pmod(F.xxhash64(text_col), F.lit(SAMPLE)) == 0).select(text_col).mapInArrow(_each(words), "h bigint")
    often = [x[0] for x in sample.groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "h").limit(FREQUENT).collect()]
    hashes = np.array(often, np.int64)
    order = np.argsort(hashes)
    shared = spark.sparkContext.broadcast((hashes[order], len(hashes) - order))  # the most frequent has the last rank
    marked = stored(rows.mapInArrow(_prefixes(words, least, shared), f"row {rows.schema['row'].dataType.simpleString()}, name bigint, n int, fp bigint, firsts array<bigint>"), "prefixes")
    kinds = stored(marked.where("n > 0").groupBy("name").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("firsts").alias("firsts")), "distinct-sets")

    def overlap(a: str, b: str) -> Column:
        """Shingles that a similar pair of sets of these sizes shares at least."""
        return F.ceil(F.lit(least / (1 + least)) * (F.col(a) + F.col(b)) - F.lit(1e-6))

    def needed(a: str, b: str) -> Column:
        """Shingles that a similar pair shares at least of its firsts: all it shares less what can stand after the firsts of one of both."""
        return overlap(a, b) - (F.ceil(F.lit(least) * F.greatest(a, b)) - 1)

    def sized(pairs: DataFrame) -> DataFrame:
        return pairs.where(F.least("an", "bn") >= F.lit(least) * F.greatest("an", "bn"))

    def similar(pairs: DataFrame) -> DataFrame:
        """Those of (a, b) that are."""
        pairs = stored(pairs, "near-candidates")
        release(spark)
        names = pairs.select(F.col("a").alias("name")).unionAll(pairs.select(F.col("b").alias("name"))).distinct()
        texts = kinds.join(names, "name").select("name", F.col("row.key").alias("key"))
        wanted = rows.select(F.col("row.key").alias("key"), "text").join(texts, "key").select("name", "text")
        sets = stored(wanted.mapInArrow(_sets(words), "name bigint, set array<bigint>").dropDuplicates(["name"]), "shingle-sets")
        whole = pairs.join(sets.select(F.col("name").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("name").alias("b"), F.col("set").alias("sb")), "b")
        common = F.size(F.array_intersect("sa", "sb"))
        return stored(whole.where(common >= F.lit(least) * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "near-pairs")

    def ordered(pairs: DataFrame, a: str, an: str, b: str, bn: str) -> DataFrame:
        """(a, an, b, bn) of pairs, the lesser name first."""
        swap = F.col(a) > F.col(b)
        side = lambda c, x, y: F.when(swap, F.col(y)).otherwise(F.col(x)).alias(c)
        return sized(pairs.where(F.col(a) != F.col(b)).select(side("a", a, b), side("an", an, bn), side("b", b, a), side("bn", bn, an))).distinct()

    one = F.struct("name", "n")
    prints = stored(kinds.groupBy("fp").agg(F.min(one).alias("first")), "fingerprints-of-sets")
    same = kinds.join(prints, "fp").select("name", "n", "first.name", "first.n").toDF("a", "an", "b", "bn")
    met = links(prints)
    of = lambda c: prints.select(F.col("fp").alias(c), F.col("first.name").alias(f"{c}_name"), F.col("first.n").alias(f"{c}_n"))
    apart = met.join(of("a"), "a").join(of("b"), "b").select("a_name", "a_n", "b_name", "b_n").toDF("a", "an", "b", "bn")
    close = ordered(same.unionAll(apart), "a", "an", "b", "bn").select("a", "b")

    entries = kinds.select("name", "n", F.posexplode("firsts").alias("i", "h"))
    stats = entries.groupBy("h").agg(F.count("*").alias("m"), F.min("n").alias("lo"), F.max("n").alias("hi")).where("m > 1")
    entries = stored(entries.join(stats, "h"), "shared-shingles")
    fewest = entries.groupBy("name", "n").agg(F.count("*").alias("c"), F.greatest(F.min("lo"), F.ceil(F.lit(least) * F.col("n"))).alias("lo"), F.least(F.max("hi"), F.floor(F.col("n") / least)).alias("hi"))
    can = fewest.where(F.col("c") >= F.least(needed("n", "lo"), needed("n", "hi") - 1)).select("name", "c")  # fewer are needed the more the sizes differ; 1 for rounding
    entries = stored(entries.select("h", "i", "name", "n").join(can, "name"), "possible-shingles")
    release(spark)

    def unconnected(roots: DataFrame) -> DataFrame:
        """Entries of the shingles that texts of several roots share, with the root."""
        classed = stored(entries.join(roots, entries["name"] == roots["node"], "left").select("h", "i", "name", "n", "c", F.coalesce("root", "name").alias("root")), "classed")
        mixed = classed.groupBy("h").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("m")).where("low < high").select("h", "m")
        return stored(classed.join(mixed, "h"), "unconnected")

    large = entries.join(stats.where(F.col("m") > LARGE).select("h"), "h")
    leader = F.struct("name", "n")
    x = F.xxhash64("name")
    heads = large.groupBy("h").agg(F.count("*").alias("k"), F.array(F.min_by(leader, x), F.max_by(leader, x), F.max_by(leader, F.struct("c", x)), F.max_by(leader, F.struct(F.col("c"), -x))).alias("heads")).where(F.col("k") > LARGE)
    led = large.join(heads, "h").select("name", "n", F.explode(F.array_distinct("heads")).alias("l")).select("name", "n", F.col("l.name").alias("l"), F.col("l.n").alias("ln"))
    firsts = kinds.select("name", "firsts")
    led = ordered(led, "name", "n", "l", "ln").join(firsts.select(F.col("name").alias("a"), F.col("firsts").alias("fa")), "a").join(firsts.select(F.col("name").alias("b"), F.col("firsts").alias("fb")), "b")
    led = led.where(F.size(F.array_intersect("fa", "fb")) >= needed("an", "bn")).select("a", "b")
    near = similar(close.unionAll(led).distinct())

    left = unconnected(components(near))
    side = lambda k: left.select("h", F.col("name").alias(k), F.col("n").alias(f"{k}n"), F.col("i").alias(f"{k}i"), F.col("root").alias(f"{k}r"))
    reach = F.least("ai", "bi") + 1 + F.least(F.col("an") - 1 - F.col("ai"), F.col("bn") - 1 - F.col("bi"))  # what both share at most, before and after
    met = sized(side("a").join(side("b"), "h").where("a < b and ar <> br").where(reach >= overlap("an", "bn"))).groupBy("a", "an", "b", "bn").agg(F.count("*").alias("met"))
    met = stored(met.where(F.col("met") >= needed("an", "bn")).select("a", "b", "met"), "near-met")
    ends = met.select("a", "b", F.explode(F.array("a", "b")).alias("end"), "met")
    near = near.unionAll(similar(ends.groupBy("end").agg(F.max(F.struct("met", "a", "b")).alias("best")).select("best.a", "best.b").distinct()))
    roots = components(near)
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}r"))
    apart = met.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("ar", "a") != F.coalesce("br", "b"))
    roots = components(near.unionAll(similar(apart.select("a", "b"))))
    return marked.join(roots, marked["name"] == roots["node"], "left").select("row", F.coalesce("root", "name").alias("root"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST) -> DataFrame:
    """docs, in its columns, with one row of each group of near copies: that of the least id."""
    return one_of_each(docs, near_copies(docs, id_col, text_col, words, least), id_col, text_col)
