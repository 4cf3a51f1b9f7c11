"""Structured Streaming: sources, windows with watermarks, latest rows, sessions, idempotent jobs.

The engine's own rule for late data: rows more than `delay` behind the greatest event time are dropped (10 minutes by default).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

DELAY = "10 minutes"


def events(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def window_counts(stream: DataFrame, ts: str, by: str, width: str, slide: str | None = None, delay: str = DELAY) -> DataFrame:
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def sessions(stream: DataFrame, key: str, ts: str, gap: str, delay: str = DELAY) -> DataFrame:
    out = stream.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("first"), F.col("w.end").alias("end"), "n")


def latest(stream: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The newest row of each key, by one running aggregate."""
    return stream.groupBy(key).agg(F.max_by(tie, F.struct(ts, tie)).alias(tie), F.max(ts).alias(ts), F.count("*").alias("n"))


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str = DELAY) -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_to_files(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run what is available and append what the watermark has closed to a folder of Parquet files; state that is closed is dropped."""
    q = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def run_updates(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Run what is available and write the rows that each batch changed; a repeated batch overwrites its own folder. newest() reads the result."""

    def run(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{target}/batch={batch}")

    q = stream.writeStream.foreachBatch(run).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def newest(spark: SparkSession, target: str, keys: list[str]) -> DataFrame:
    """The last row that any batch wrote for each key."""
    rows = spark.read.parquet(target)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")


def close(spark: SparkSession, folder: str, schema, ts: str, at: str) -> None:
    """Append a row at `at`, with nulls but for its time, so that windows before it close when the stream ends here."""
    one = spark.range(1).select(*[F.lit(at).cast(f.dataType).alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in schema])
    one.write.mode("append").parquet(folder)


def jobs(stream: DataFrame, handle: Callable[[DataFrame], DataFrame], target: str, checkpoint: str) -> StreamingQuery:
    """At-least-once jobs with an idempotent target: each batch overwrites its own partition, so a repeated batch changes nothing."""

    def run(rows: DataFrame, batch: int) -> None:
        handle(rows).write.mode("overwrite").parquet(f"{target}/batch={batch}")

    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def attempts_due(attempts: DataFrame, now: str, delays: tuple[int, ...] = (60, 300, 900)) -> DataFrame:
    """Failed jobs whose next try is due: the delay grows with the attempts made; jobs out of attempts are left out."""
    n = F.col("attempts")
    wait = F.lit(delays[-1])
    for i, d in reversed(list(enumerate(delays))):
        wait = F.when(n == i + 1, d).otherwise(wait)
    due = F.col("last_attempt").cast("timestamp").cast("long") + wait <= F.lit(now).cast("timestamp").cast("long")
    return attempts.where((F.col("status") == "FAILED") & (n <= len(delays)) & due)
