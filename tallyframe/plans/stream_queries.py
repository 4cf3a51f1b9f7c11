"""Streams over the events table, each run to its end and read back."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming import streams as S
from . import views as W


#: After all events; the row at this time closes the windows before it.
END = "2999-01-01"


def _folder(spark: SparkSession) -> str:
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/tallyframe"  # one process: tests
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


def _stream(spark: SparkSession, d: str) -> tuple[DataFrame, str]:
    """The events as a stream of files in event-time order, and a row that ends it."""
    folder = _folder(spark)
    e = W.load(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartitionByRange(4, "ts").sortWithinPartitions("ts").write.parquet(f"{folder}/in")
    S.close(spark, f"{folder}/in", e.schema, "ts", END)
    return S.events(spark, f"{folder}/in", e.schema, 5), folder


def _closed(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    S.run_to_files(stream, f"{folder}/out", f"{folder}/state")
    return spark.read.parquet(f"{folder}/out")


def stream_window_counts(spark, d):
    stream, folder = _stream(spark, d)
    out = _closed(spark, S.window_counts(stream, "ts", "event_type", "1 day"), folder)
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def stream_dedupe_latest(spark, d):
    stream, folder = _stream(spark, d)
    S.run_updates(S.latest(stream, "user_id", "ts", "event_id"), f"{folder}/out", f"{folder}/state")
    return S.newest(spark, f"{folder}/out", ["user_id"]).where("user_id is not null").select("user_id", "event_id", F.col("ts").cast("timestamp_ntz").alias("ts"), "n")


def stream_sessions(spark, d):
    stream, folder = _stream(spark, d)
    out = _closed(spark, S.sessions(stream, "user_id", "ts", "6 hours"), folder)
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), "n")


QUERIES = {f.__name__: f for f in (stream_window_counts, stream_dedupe_latest, stream_sessions)}
SQL = {
    "stream_window_counts": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_dedupe_latest": "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, count(*) AS n FROM events GROUP BY 1",
    "stream_sessions": "WITH f AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS session FROM f) SELECT user_id, min(ts) AS first, count(*) AS n FROM s GROUP BY user_id, session",
}
