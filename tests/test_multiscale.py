"""The 920 columns: one pass and one shuffle, and the values of the families' SQL for odd series."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest

from breakwater.functions import arrays
from breakwater.operators import padded
from breakwater.plans import engine, multiscale
from breakwater.plans.dialect import render
from breakwater.sources import series, tables

from .conftest import SF


@pytest.fixture(scope="module")
def odd(spark):
    """Series with ties, one value only, one segment only, few points, many, segments that alternate, and rows in no order."""
    rng, rows = np.random.default_rng(5), []
    for i, (n0, n1) in enumerate(((60, 55), (30, 30), (3, 40), (0, 9), (1, 1), (2, 2), (20, 17), (7, 0), (130, 160), (300, 101), (12, 20))):
        x = np.full(n0 + n1, 4.5) if i == 1 else rng.normal(size=n0 + n1).round(1 if i % 2 else 6) + 1
        rows += [(f"s{i}", s + 1, float(v), int(s >= n0)) for s, v in enumerate(x)]
    rows += [("alternating", s, float(v), s % 2) for s, v in enumerate(rng.normal(size=90).round(3))]
    rows += [("holes", s, v, s // 40) for s, v in enumerate([None, float("nan"), 2.0, 5.0] * 20)]
    return spark.createDataFrame([rows[k] for k in rng.permutation(len(rows))], "id string, seq long, value double, period int").repartition(3)


@pytest.fixture(scope="module")
def wide(odd):
    return multiscale.matrix(odd).toPandas().set_index("id")


@pytest.fixture(scope="module")
def con(odd):
    segs = series.with_positions(odd)
    got = duckdb.connect()
    got.register("seg", segs.toPandas())
    got.register("x", series.scoped(segs).toPandas())
    return got


def test_one_pass_and_one_shuffle(spark, monkeypatch):
    """The raw statistics are written once, from one exchange; features are expressions of their rows."""
    names, plans, write = [], [], tables.staged

    def staged(df, name):
        names.append(name)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(tables, "staged", staged)
    got = multiscale.feature_matrix_920(spark, SF)
    assert names == ["statistics"] and plans[0].split("Initial Plan")[0].count("Exchange ") == 1
    final = got._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in ("Exchange", "Join", "Aggregate", "Window", "Sort ") if word in final]
    assert len(got.columns) == 921 and got.count() == 10


@pytest.mark.parametrize("name", [f for families, _ in multiscale.GROUPS.values() for f in families if f != "compression"])
def test_values_as_in_sql(wide, con, name):
    f = engine.SCOPED[name]
    steps = ", ".join(f"{n} AS ({render(f._named(text), 1)})" for n, text, *_ in f.steps[:-1])
    want = con.execute(f"WITH RECURSIVE {steps} {render(f._named(f.steps[-1][1]), 1)}").df()
    seen = 0
    for s in series.SCOPES if "scope" in want.columns else [None]:
        rows = (want if s is None else want[want["scope"] == s]).set_index("id")
        for c in want.columns.drop(["id", "scope"], errors="ignore"):
            at = c if s is None else engine.named(c, s)
            if at in wide.columns:
                got, expected = wide[at].astype(float), rows[c].astype(float).reindex(wide.index)
                if name.startswith("transform"):  # one segment only has no distances; the SQL divides by nothing there
                    got, expected = got.drop(["s3", "s7"]), expected.drop(["s3", "s7"])
                np.testing.assert_allclose(got.to_numpy(), expected.to_numpy(), atol=1.1e-4, err_msg=at)
                seen += 1
    assert seen


def test_deflated_sizes(wide, con):
    """Rates of whole segments by the array function that the family runs."""
    for i, p, at in [(i, p, at) for i in wide.index for p, at in enumerate(("zlib_pre_w50", "zlib_post_w50"))]:
        x = con.execute("SELECT value FROM seg WHERE id = ? AND period = ? AND pos <= 50 ORDER BY seq", [i, p]).df()["value"].to_numpy()
        assert wide.loc[i, at] == pytest.approx(arrays.deflated_of(x) / (4 * len(x)) if len(x) else 1.0, abs=1e-7)


def test_compression_as_the_family_has_it(spark, odd, wide):
    got = engine.features_of(series.scoped(series.with_positions(odd)), ("compression",)).toPandas().set_index("id").reindex(wide.index)
    for c in [c for c in got.columns if not c.startswith("lz76")]:
        np.testing.assert_allclose(wide[c].to_numpy(float), got[c].to_numpy(float), atol=1e-8, err_msg=c)


def test_series_over_several_batches_and_parts(spark, monkeypatch, odd, wide):
    """Parts of a task that end in the middle of a series change nothing."""
    monkeypatch.setattr(series, "POINTS", 32)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "13")
    monkeypatch.setattr(series, "by_id", lambda rows, n: rows.repartition(2, "id"))
    try:
        got = multiscale.matrix(odd).toPandas().set_index("id").reindex(wide.index)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    for c in wide.columns:
        np.testing.assert_allclose(got[c].to_numpy(float), wide[c].to_numpy(float), atol=1.1e-4, err_msg=c)


def test_a_table_without_points(spark):
    got = multiscale.matrix(spark.createDataFrame([(1, 1, None, 0)], "id long, seq long, value double, period int"))
    assert got.count() == 0 and len(got.columns) == 921


def test_padding_is_bounded():
    """One long series among many short ones does not widen the rows of those."""
    seen, rows = [], padded.Rows.__init__

    def note(self, *args):
        rows(self, *args)
        seen.append((self.x.size, int(self.n.sum())))

    lengths = [5000] + [10] * 300
    ids = np.repeat(np.arange(301), lengths)
    table = padded.pa.table({"id": ids, "seq": np.arange(len(ids)), "period": np.arange(len(ids)) % 2, "value": np.random.default_rng(1).normal(size=len(ids))})
    padded.Rows.__init__ = note
    try:
        made = [b for b in padded._made(table, ("moments",), {"full": 1 << 30})]
    finally:
        padded.Rows.__init__ = rows
    assert sum(b.num_rows for b in made) == 301 and max(size for size, _ in seen) <= 2 * max(n for _, n in seen)
