"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of characters. The distinct blocks are sorted by a 128-bit reference and their
ranks, 1, 2, 3, ..., become integer names; then adjacent names are paired, the distinct pairs sorted and named again,
until one name stands for each whole text. Two texts get the same (level, name) if and only if they are equal:
a name stands for one block or one pair, and never for two. Names depend on the texts alone, not on partitions.

At scale: the contents of blocks are shuffled once, deduplicated before the shuffle. Ranks are found within BUCKETS ranges of the hash that
comes first in the order, and only the ranges' counts are summed up over all. Rows meet names by a
128-bit reference of the block; that no two distinct blocks share a reference is verified on the contents
(least and greatest block of each reference are compared; a difference stops the job), so identity never rests on a hash.
A group of copies makes one distinct block, and the join that takes names back to rows is a sort-merge join
of which Spark splits skewed partitions. Each level is a written table, so lost executors repeat one level at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, stored

BLOCK = 4096
BUCKETS = 4096


def _named(values: DataFrame, by: list[str], first: Column, name: str) -> DataFrame:
    """Distinct values with their rank, from 1, in the order of `first` (64 bits of hash) and `by`."""
    kept = stored(values.select(*by, first.alias("_x")).withColumn("_bucket", F.shiftrightunsigned("_x", 64 - BUCKETS.bit_length() + 1)), name)
    before = kept.groupBy("_bucket").agg(F.count("*").alias("_n")).select("_bucket", (F.sum("_n").over(Window.orderBy("_bucket")) - F.col("_n")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy("_x", *by))
    return kept.withColumn("_rank", rank).join(F.broadcast(before), "_bucket").select(*by, (F.col("_before") + F.col("_rank")).alias("name"))  # BUCKETS rows


def identities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, sha, copies, level, name) for each distinct row of id and text; copies counts repeated rows.

    Null texts count as empty, null ids are kept as an id of their own, empty texts are one empty block,
    an empty table gives no rows; other columns are ignored.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = (
        docs.select(F.col(id_col).alias("id"), text.alias("text"))
        .select("id", F.unhex(F.sha2("text", 256)).alias("sha"), F.regexp_extract_all("text", F.lit("(?s).{1,%d}" % block), F.lit(0)).alias("blocks"))
        .withColumn("blocks", F.when(F.size("blocks") == 0, F.array(F.lit(""))).otherwise(F.col("blocks")))
        .select("id", "sha", F.size("blocks").alias("nb"), F.posexplode("blocks").alias("pos", "block"))
        .select("id", "sha", "nb", "pos", "block", F.xxhash64("block").alias("r1"), F.xxhash64(F.lit(1), "block").alias("r2"))
    )
    same = F.when(F.col("least") != F.col("greatest"), F.raise_error(F.lit("two blocks share a 128-bit reference"))).otherwise(F.col("least"))
    blocks = rows.groupBy("r1", "r2").agg(F.min("block").alias("least"), F.max("block").alias("greatest")).select("r1", "r2", same.alias("block"))
    names = _named(blocks.where("block is not null"), ["r1", "r2"], F.col("r1"), "block-names")
    level = 0
    now = stored(rows.drop("block").join(names, ["r1", "r2"]).groupBy("id", "sha", "nb", "pos").agg(F.max("name").alias("name"), F.count("*").alias("copies")), "level-0")
    most = now.agg(F.max("nb")).first()[0] or 1
    done = [now.where("nb = 1").select("id", "sha", "copies", F.lit(0).alias("level"), "name")]
    while 2**level < most:
        pairs = (
            now.where(F.col("nb") > 2**level)
            .groupBy("id", "sha", "nb", F.shiftright("pos", 1).alias("pos"))
            .agg(F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("n1"), F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("n2"), F.max("copies").alias("copies"))
        )
        pairs = stored(pairs, f"pairs-{level + 1}")
        names = _named(pairs.select("n1", "n2").distinct(), ["n1", "n2"], F.xxhash64("n1", "n2"), f"pair-names-{level + 1}")
        level += 1
        now = stored(pairs.join(names, ["n1", "n2"]).select("id", "sha", "nb", "pos", "name", "copies"), f"level-{level}")
        done.append(now.where(F.col("nb").between(2 ** (level - 1) + 1, 2**level)).select("id", "sha", "copies", F.lit(level).alias("level"), "name"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: id, keep_id (largest id of the group), group_size, kept, text_sha256.

    Of repeated rows (same id and text) one is kept. A null id is kept only where its group has no other.
    """
    ids = identities(docs, id_col, text_col, block)
    groups = ids.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.sum("copies").alias("group_size"))
    return (
        ids.join(groups, ["level", "name"])
        .select("*", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("k"))
        .select(F.col("id").alias(id_col), "keep_id", "group_size", (F.col("id").eqNullSafe(F.col("keep_id")) & (F.col("k") == 1)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its columns, without the rows that exact_dedup drops; repeated rows leave one."""
    key = lambda sha: F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(":"), sha)
    kept = exact_dedup(docs, id_col, text_col).where("kept").select(key(F.col("text_sha256")).alias("_row"))
    marked = docs.withColumn("_row", key(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)))
    return marked.join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir))


SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY text)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.text) AS text_sha256
FROM t JOIN g ON t.text = g.text
"""
