"""Every query of the engine beside its SQL in DuckDB, on the smallest driver tables."""

import math
import os

import pytest

from tallyframe.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in os.listdir(FOLDER):
        con.execute(f"create view {f.removesuffix('.parquet')} as from '{FOLDER}/{f}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return str(v)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    if isinstance(v, float) or hasattr(v, "as_tuple"):
        return f"{float(v):.6f}" if math.isfinite(v) else str(v)
    return str(v)


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(got.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    if name in registry.SQL:
        want = duck.sql(registry.SQL[name])
        assert sorted(want.columns) == columns
        at = [want.columns.index(c) for c in columns]
        assert rows == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())
    else:
        assert rows


@pytest.mark.parametrize("name", ["compare_values", "dedupe_axis", "value_conflicts", "latest_decisions"])
def test_partitioning_changes_nothing(spark, name):
    """Other shuffle widths give the same rows."""
    rows = lambda: sorted(map(str, registry.QUERIES[name](spark, FOLDER).collect()))
    was, first = spark.conf.get("spark.sql.shuffle.partitions"), rows()
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "13")
        assert rows() == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
