"""Ordered operators on fractions of seconds and on ties."""

from datetime import datetime

from tallyframe.plans import registry


def test_sessions_count_gaps_in_whole_seconds_as_their_sql_does(spark, tmp_path):
    import duckdb

    at = datetime.fromisoformat
    rows = [(805, at("2024-01-30 03:45:35.128715")), (805, at("2024-01-30 09:45:35.843098")), (805, at("2024-01-30 15:45:36.100000")), (805, at("2024-01-30 21:45:36.000000")), (7, at("2024-01-01 00:00:00.9")), (7, at("2024-01-01 06:00:01.1"))]
    rows += [(805, None), (805, None), (9, None), (None, at("2024-01-01 00:00:00")), (7, at("1969-12-31 23:59:59.9")), (7, at("1970-01-01 05:59:59.95"))]
    spark.createDataFrame(rows, "user_id bigint, ts timestamp_ntz").write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as from '{tmp_path}/events.parquet/*.parquet'")
    got = sorted(map(str, map(tuple, registry.QUERIES["sessions"](spark, str(tmp_path)).collect())))
    assert got == sorted(map(str, con.sql(registry.SQL["sessions"]).select("user_id, session, first, last, n").fetchall()))
    assert str((805, 1, rows[0][1], rows[1][1], 2)) in got
