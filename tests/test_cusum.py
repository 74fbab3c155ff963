"""Families over running sums: the plans that Spark runs, memory of their tasks, and odd segments against the SQL."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from breakwater.plans import engine
from breakwater.sources import series, tables

from .test_pooled import SLOW, _plans, odd  # noqa: F401

NAMES = ("cusum_features", "cusum_elbow", "cusum_error", "cusum_boundary_vol")


@pytest.mark.parametrize("name", NAMES)
def test_running_sums_are_made_a_series_at_a_time(spark, monkeypatch, odd, name):  # noqa: F811
    """No window, sort or join over scoped rows."""
    x = series.scoped(tables.staged(series.with_positions(odd), "segments"))
    assert not [p for p in _plans(spark, monkeypatch, x, [engine.SCOPED[name]]) if any(s in p for s in (*SLOW, "Join "))]


@pytest.mark.parametrize("name", NAMES)
def test_odd_segments_as_in_sql(spark, odd, name):  # noqa: F811
    x = series.scoped(series.with_positions(odd))
    got = engine.SCOPED[name].apply(spark, {"x": x}).toPandas()
    con = duckdb.connect()
    rows = x.toPandas()  # noqa: F841
    sql = engine.SCOPED[name].oracle()
    start = sql.index("x AS (") + len("x AS (")
    depth, end = 1, start
    while depth:
        depth += {"(": 1, ")": -1}.get(sql[end], 0)
        end += 1
    want = con.execute(sql[:start] + "SELECT * FROM rows" + sql[end - 1 :]).df()[list(got.columns)]
    got, want = (d.sort_values(["id", "scope"]).reset_index(drop=True) for d in (got, want))
    assert len(got) == len(want) and list(got["scope"]) == list(want["scope"])
    for c in got.columns.drop("scope"):
        np.testing.assert_allclose(got[c].to_numpy(float), want[c].to_numpy(float), atol=1.1e-4, err_msg=c)


def test_one_pass_serves_three_families(spark, monkeypatch, odd):  # noqa: F811
    names, write = [], tables.staged
    monkeypatch.setattr(tables, "staged", lambda df, name: (names.append(name), write(df, name))[1])
    engine.features(odd, NAMES)
    assert sorted(names) == ["cusum_errors", "cusums", "segments"]


def test_scans_follow_the_number_of_points(spark, monkeypatch, tmp_path):
    """A table in one file is read by as many tasks as its points call for, and the session's setting stays."""
    key = "spark.sql.files.minPartitionNum"
    rows = "id AS l_suppkey, id * 0.5D AS l_extendedprice, " + ", ".join(f"id AS {c}" for c in ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_discount"))
    spark.range(0, 40_000, 1, 1).selectExpr(*rows.split(", ")).write.option("parquet.block.size", 16_384).parquet(f"{tmp_path}/lineitem.parquet")
    monkeypatch.setattr(series, "POINTS", 500)
    before, cost = spark.conf.get(key, None), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        segs = series.segments(spark, str(tmp_path))
        assert series.scans(segs) == 20
        with tables.scans(spark, series.scans(segs)):
            assert spark.read.parquet(f"{tmp_path}/lineitem.parquet").rdd.getNumPartitions() >= 20
    finally:
        spark.conf.set("spark.sql.files.openCostInBytes", cost)
    assert spark.conf.get(key, None) == before
