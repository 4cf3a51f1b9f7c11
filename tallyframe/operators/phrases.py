"""Phrases in texts, presence under three-valued logic, lexicons, statistics of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def words_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, word): lower-case runs of letters and digits, with their places."""
    return texts.select(key, F.posexplode(_found(F.col(text))).alias("pos", "word"))


def _found(text: Column, stem: int = 0) -> Column:
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return F.transform(words, lambda w: F.substring(w, 1, stem)) if stem else words


def phrase_hits(texts: DataFrame, phrases: DataFrame, key: str, phrase: str, text: str = "text", stem: int = 0) -> DataFrame:
    """(phrase, key, hits): places where all words of a phrase stand one after another (or words that begin with the same `stem` letters).

    Only the word of a phrase that stands in the fewest texts is looked up; texts that hold it are compared with the whole phrase, place by place. A
    phrase with a word that stands nowhere is not looked up at all. Phrases without words, null texts and texts without words have no hits.
    """
    own = phrases.select(phrase, _found(F.col("text"), stem).alias("_words")).where(F.size("_words") > 0).distinct()
    rows = texts.select(F.col(key).alias("_key"), _found(F.col(text), stem).alias("_text")).where(F.size("_text") > 0).withColumn("_id", F.xxhash64("_text"))
    seen = rows.select("_key", "_id", F.explode(F.array_distinct("_text")).alias("_word"))
    parts = own.select(phrase, "_words", F.explode(F.array_distinct("_words")).alias("_word"))
    files = seen.join(parts.select("_word").distinct(), "_word").groupBy("_word").agg(F.count("*").alias("_n"))
    rarest = parts.join(files, "_word", "left").groupBy(phrase, "_words").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_word").alias("word"))).alias("_r")).where("_r.n > 0")
    pairs = seen.join(rarest.select(phrase, "_words", F.col("_r.word").alias("_word")), "_word").select(F.col("_key").alias("_k"), F.col("_id").alias("_i"), phrase, "_words").distinct()
    met = rows.join(pairs, F.col("_key").eqNullSafe(F.col("_k")) & (F.col("_id") == F.col("_i"))).where(F.size("_text") >= F.size("_words"))
    places = F.filter(F.sequence(F.lit(1), F.size("_text") - F.size("_words") + 1), lambda i: F.slice("_text", i, F.size("_words")) == F.col("_words"))
    return met.select(phrase, F.col("_key").alias(key), F.size(places).cast("bigint").alias("hits")).where("hits > 0").groupBy(phrase, key).agg(F.sum("hits").alias("hits"))


def presence(hits: Column, pages_read: Column, pages: Column) -> Column:
    """TRUE with a hit, FALSE where every page was read, else unknown."""
    return F.when(hits > 0, True).when(pages_read == pages, False)


def document_frequency(texts: DataFrame, key: str, text: str, least: int = 2) -> DataFrame:
    """(word, files): words that stand in at least `least` texts."""
    return words_of(texts, key, text).select(key, "word").distinct().groupBy("word").agg(F.count("*").alias("files")).where(F.col("files") >= least)


def lexicon_share(texts: DataFrame, lexicon: DataFrame, key: str, text: str) -> DataFrame:
    """(key, words, share of words in the lexicon)."""
    own = words_of(texts, key, text).join(lexicon.select("word", F.lit(1).alias("_hit")), "word", "left")
    return own.groupBy(key).agg(F.count("*").alias("words"), F.round(F.count("_hit") / F.count("*"), 6).alias("share"))


def topic_share(pages: DataFrame, document: str, has: Column) -> DataFrame:
    return pages.groupBy(document).agg(F.count("*").alias("pages"), F.round(F.avg(has.cast("double")), 6).alias("share"))


def mode_of(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value of each key, ties to the lower value."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    return counts.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))).where("_r = 1").drop("_r")
