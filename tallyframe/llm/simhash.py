"""SimHash near-dedup by anchor-point covering.

The fingerprint's two halves are covered by the perfect Hamming code [31, 26] (covering radius 1; one bit of each half
is left out, which only lowers a distance). Fingerprints at 3 or fewer differing bits differ in at most 1 bit in one half.
There the first lies within the radius of its home anchor (the nearest code word), and the second within radius plus
threshold, 2, of the same anchor. So each distinct fingerprint goes once to its home anchors and to all (1 or 16) anchors
within 2 in each half; each anchor compares its homes with what was replicated to it. No link is lost.

At scale: only distinct fingerprints are compared, so a group of copies counts as one; there are 2^26 anchors a half.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, one_of_each, ordered_row, stored
from .components import components

WORDS, SEED, BITS_APART = 3, 42, 3
CHUNK = 1 << 16


def spans(text: str | None, words: int = WORDS) -> tuple[bytes, list[int], list[int]]:
    """The words of text with a space between, and where its shingles start and end there; none for no words or null."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z, and space and 0x09 to 0x0D, only
    whole = b" ".join(parts)
    if len(parts) <= words:
        return whole, [0][: len(parts)], [len(whole)][: len(parts)]
    size = np.fromiter(map(len, parts), np.int64, len(parts))
    after = np.cumsum(size + 1) - 1
    return whole, (after - size)[: len(parts) - words + 1].tolist(), after[words - 1 :].tolist()


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Signed 64-bit SimHash of the word shingles of text; 0 for no words or null."""
    import xxhash

    whole, starts, ends = spans(text, words)
    if not starts:
        return 0
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(starts), CHUNK):
        hashes = np.array([digest(whole[s:e], SEED) for s, e in zip(starts[at : at + CHUNK], ends[at : at + CHUNK], strict=True)], "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(starts), bitorder="little").view("<i8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = pa.array([fingerprint(x.as_py()) for x in b.column(1)], pa.int64())
        yield pa.RecordBatch.from_arrays([b.column(0), found], ["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) for each row; whole texts."""
    ids = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return ids.mapInArrow(_fingerprints, f"id {ids.schema['id'].dataType.simpleString()}, fp bigint")


def _half(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32 * k).bitwiseAND(F.lit(0x7FFFFFFF))


def _syndrome(x: Column) -> Column:
    """XOR of the positions 1 to 31 of the bits that are set: 0 for a code word, else the bit to flip."""
    out = F.lit(0).cast("bigint")
    for k in range(5):
        mask = sum(1 << (p - 1) for p in range(1, 32) if p >> k & 1)
        out = out + (F.bit_count(x.bitwiseAND(F.lit(mask))) % 2).cast("bigint") * (1 << k)
    return out


def _bit(position: Column) -> Column:
    return F.when(position > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), (position - 1).cast("int"))).otherwise(F.lit(0).cast("bigint"))


def links(fps: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct fingerprints of column fp, a < b, at 3 or fewer differing bits."""
    halves = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("half"), _half(F.col("fp"), k).alias("x")) for k in (0, 1)])).alias("h")).select("fp", "h.half", "h.x").withColumn("s", _syndrome(F.col("x")))
    home = F.col("x").bitwiseXOR(_bit(F.col("s")))
    homes = halves.select("half", home.alias("anchor"), F.col("fp").alias("a"))
    other = lambda i: i.bitwiseXOR(F.col("s").cast("int"))
    pairs = F.filter(F.sequence(F.lit(1), F.lit(31)), lambda i: (F.col("s") > 0) & (i < other(i)) & (i != F.col("s")))
    near = F.concat(F.array(home), F.transform(pairs, lambda i: F.col("x").bitwiseXOR(_bit(i)).bitwiseXOR(_bit(other(i)))))
    replicas = halves.select("half", F.explode(near).alias("anchor"), F.col("fp").alias("b"))
    apart = F.bit_count(F.col("a").bitwiseXOR(F.col("b")))
    return homes.join(replicas, ["half", "anchor"]).where((F.col("a") < F.col("b")) & (apart <= BITS_APART)).select("a", "b")


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(id, fp) of each row, and (fp, least, root) of each fingerprint: its least id and its component."""
    marked = stored(fingerprints(docs, id_col, text_col), "fingerprints")
    fps = stored(marked.groupBy("fp").agg(F.min("id").alias("least")), "distinct-fingerprints")
    roots = components(links(fps))
    return marked, fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (least id reachable over links).

    Null and empty texts have fingerprint zero and link like any other; a null id is never a component_id unless
    its component has no other; repeated rows stay repeated; an empty table gives no rows; other columns are ignored.
    """
    marked, classes = _classed(docs, id_col, text_col)
    classes = classes.join(classes.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    return marked.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, in its columns, with one row of each component: that of the least id, null ids last, and of its texts that of the least hash."""
    marked, classes = _classed(docs.select(ordered_row(id_col, text_col).alias("row"), F.col(text_col).alias("text")), "row", "text")
    return one_of_each(docs, marked.join(classes, "fp").select(F.col("id").alias("row"), "root"), id_col, text_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
