"""What the operators of this subpackage share: the shared folder, written tables, defined inputs."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


_STORED: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one set here where it is unset and all runs in one process (tests)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", "tallyframe")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stored(df: DataFrame, name: str, partitioned: str | None = None, **options) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _STORED.setdefault(spark.sparkContext.applicationId, []).append(path)
    out = df.write.options(**{"compression": "zstd", **options})
    (out.partitionBy(partitioned) if partitioned else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(spark: SparkSession) -> int:
    """Delete the tables that stored() wrote in this application, once no result that is still to be read rests on them; returns their number."""
    paths = _STORED.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for path in paths:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(paths)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop the shuffle files of steps that are done and stored."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def trim() -> None:
    """Give memory that this process has freed back to the system: workers are used again, and keep what they once needed."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, UPPER, UPPER.lower())


def key(id_col: str, text_col: str) -> Column:
    """Id and text of a row in one string."""
    return F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("none")), F.lit(":"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def ordered_row(id_col: str, text_col: str) -> Column:
    """(none, id, key): its least is the least id's row; null ids come last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), key(id_col, text_col).alias("key"))


def one_of_each(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs, in its columns, with one row of each root of found (row, root): the least."""
    kept = found.groupBy("root").agg(F.min("row").alias("row")).select(F.col("row.key").alias("_row"))
    return docs.withColumn("_row", key(id_col, text_col)).join(kept, "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns)


def least_hashed(rows: DataFrame, h: str, n: int, ties: list[str]) -> DataFrame:
    """The n rows of least hash (a column of 64 bits), ties in order of `ties`; all where there are no more.

    Rows are counted, and only those under a hash that about n rows stay under are ranked, so no partition sends n rows.
    """
    count = rows.count()
    if count <= n:
        return rows
    few = n + 8 * math.isqrt(n) + 8
    under = rows if few >= count else rows.where(F.col(h) <= (few << 64) // count - (1 << 63))
    return under.orderBy(h, *ties).limit(n)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def task_count(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def runs(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[pa.Table]:
    """Rows in runs of about `most` bytes of a column of strings."""
    held, size = [], 0
    for b in batches:
        while b.num_rows:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False))
            k = min(b.num_rows, int(np.searchsorted(ends, most - size)) + 1)
            held.append(b.slice(0, k))
            size += int(ends[k - 1])
            b = b.slice(k)
            if size >= most:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)
