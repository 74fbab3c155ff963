"""Files with bad lines, the store of series, user functions and the jobs, end to end."""

from __future__ import annotations

import csv
import glob
import json

import numpy as np
import pytest

from breakwater import jobs
from breakwater.functions import user
from breakwater.plans import engine
from breakwater.sources import series, store, tables

from .test_engine import breaks

LINES = ["id,seq,period,value,note", "1,1,0,0.5,fine", "1,2,1,1.5,", "1,three,0,2,bad number", "2,1,0,,empty value", "2,2,7,1.0,other period", "3,1,0,1e3,exponent", "x,y"]


def test_text_with_bad_lines(spark, tmp_path):
    path = str(tmp_path / "s.csv")
    (tmp_path / "s.csv").write_text("\n".join(LINES) + "\n")
    kept = series.read_series(spark, path, bad="keep")
    assert [f.dataType.simpleString() for f in kept.schema][:4] == ["bigint", "bigint", "int", "double"] and kept.columns[-1] == "_corrupt_record"
    rows = kept.cache().collect()
    assert len(rows) == 7 and [r._corrupt_record for r in rows if r._corrupt_record] == [LINES[3], LINES[7]]
    dropped = series.read_series(spark, path, bad="drop")
    assert sorted((r.id, r.seq, r.value) for r in dropped.collect() if r.value) == [(1, 1, 0.5), (1, 2, 1.5), (2, 2, 1.0), (3, 1, 1000.0)] and dropped.count() == 5
    assert dropped.select("id").count() == 5
    with pytest.raises(Exception):
        series.read_series(spark, path).collect()
    with pytest.raises(ValueError, match="other than 0 and 1"):
        series.read_series(spark, path, bad="drop", check=True)
    with pytest.raises(ValueError, match="missing columns"):
        (tmp_path / "t.csv").write_text("id,value\n1,2\n")
        series.read_series(spark, str(tmp_path / "t.csv"), check=True)
    with pytest.raises(ValueError, match="bad is one of"):
        series.read_series(spark, path, bad="guess")


def test_one_series_reads_one_bucket(spark, tmp_path):
    table, labels = breaks(spark, 20, 30)
    store.write_store(table, "kept_series", 8, str(tmp_path / "store"))
    one = store.read_one(spark, "kept_series", 7)
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else the plan prunes buckets without saying so
    try:
        one = store.read_one(spark, "kept_series", 7)
        plan = one._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "true")
    assert "SelectedBucketsCount: 1 out of 8" in plan
    assert "EqualTo(id,7)" in one._jdf.queryExecution().executedPlan().toString()
    assert one.count() == 60 and store.read_one(spark, "kept_series", 999).count() == 0
    bundle = engine.train(table, labels, ("quantile_deltas",))
    alone = store.score_one(spark, "kept_series", 7, bundle).collect()
    whole = {r.id: r.score for r in engine.infer(table, bundle).collect()}
    assert [(r.id, r.score) for r in alone] == [(7, pytest.approx(whole[7]))]
    store.write_store(table.where("id < 5"), "kept_series", 8, str(tmp_path / "store"))
    assert spark.table("kept_series").select("id").distinct().count() == 5
    spark.sql("DROP TABLE kept_series")


def test_user_functions_on_three_transforms(spark):
    rows = [(1, i + 1, int(i >= 4), float(v)) for i, v in enumerate([1, 2, 3, 4, 8, 9, -1])] + [(2, 1, 0, 1.0), (2, 2, 0, 2.0), (3, 1, 0, None), (3, 2, 1, 5.0), (4, 1, 0, 1.0), (4, 2, 1, float("nan")), (4, 3, 1, 3.0)]
    table = spark.createDataFrame(rows, "id long, seq long, period int, value double")
    called = []

    def ends(x0, x1):
        return {"first": x0[0], "gap": x1[-1] - x0[-1], "odd": float("inf")}

    assert called == []
    user.register(spark, "ends", ends, ("first", "gap", "odd", "never"))
    got = {r.id: r for r in user.user_features(table, "ends", ("first", "gap", "odd", "never")).collect()}
    r = got[1]
    assert (r.first_raw, r.gap_raw, r.first_diff, r.gap_diff, r.first_cumsum, r.gap_cumsum) == (1.0, -5.0, 1.0, -11.0, 1.0, 16.0)
    assert r.odd_raw is None and r.never_diff is None
    assert got[2].first_raw is None and got[4].gap_raw == 2.0
    assert spark.sql("SELECT f.* FROM VALUES (array(1D, NULL, 2D), array(3D)), (array(), array(1D)), (NULL, NULL) AS t(a, b), LATERAL ends(a, b) f").collect()[0].gap == 1.0


def test_staged_tables_are_removed(spark):
    before = list(tables._WRITTEN)
    with tables.scratch(spark):
        a = tables.staged(spark.range(5), "a")
        b = tables.staged(spark.range(6), "b")
        assert a.count() + b.count() == 11
        tables.drop(a)
        assert len(tables._WRITTEN) == len(before) + 1
    assert tables._WRITTEN == before
    with pytest.raises(Exception):
        b.count()


def _read(folder):
    return [r for f in glob.glob(f"{folder}/part-*.csv") for r in csv.DictReader(open(f))]


def test_jobs(spark, tmp_path, capsys):
    table, labels = breaks(spark, 30, 30)
    data = tmp_path / "data"
    table.write.parquet(str(data / "X_train.parquet"))
    labels.selectExpr("id", "y = 1 AS structural_breakpoint").write.parquet(str(data / "y_train.parquet"))
    table.coalesce(1).write.option("header", True).csv(str(tmp_path / "new.csv"))
    labels.coalesce(1).write.option("header", True).csv(str(tmp_path / "y.csv"))
    (tmp_path / "s.json").write_text(json.dumps({"families": ["quantile_deltas"], "aggregated": True, "top": 5}))
    model, out = str(tmp_path / "model"), str(tmp_path / "out")
    jobs.main(["train", "--data", str(data), "--model", model, "--settings", str(tmp_path / "s.json")])
    jobs.main(["infer", "--data", str(tmp_path / "new.csv"), "--output", out, "--model", model, "--labels", str(tmp_path / "y.csv")])
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["auc"] > 0.95
    rows = _read(out)
    assert len(rows) == 30 and set(rows[0]) == {"id", "prediction"}
    jobs.main(["infer", "--data", str(tmp_path / "new.csv"), "--output", out, "--families", "quantile_deltas", "--first", "4"])
    assert sorted(int(r["id"]) for r in _read(out)) == [0, 1, 2, 3]
    jobs.main(["diagnose", "--data", str(data), "--output", str(tmp_path / "d"), "--families", "quantile_deltas", "--folds", "3"])
    by_column, by_fold = _read(tmp_path / "d" / "columns"), _read(tmp_path / "d" / "folds")
    assert max(float(r["oriented_auc"]) for r in by_column) > 0.9 and len(by_fold) == 3 and sum(int(r["n"]) for r in by_fold) == 30
    jobs.main(["features", "--data", str(data / "X_train.parquet"), "--output", str(tmp_path / "f.parquet"), "--families", "quantile_deltas"])
    wide = spark.read.parquet(str(tmp_path / "f.parquet"))
    assert wide.count() == 30 and {"q10_delta", "q10_delta_w50"} <= set(wide.columns)
    for bad in (["train", "--data", "x"], ["infer", "--data", "x"]):
        with pytest.raises(SystemExit):
            jobs.main(bad)
    with pytest.raises(ValueError, match="unknown families"):
        jobs.Settings(families=["nothing"]).check()
    with pytest.raises(ValueError, match="unknown settings"):
        (tmp_path / "bad.json").write_text(json.dumps({"family": []}))
        jobs.Settings.load(spark, str(tmp_path / "bad.json"))
    assert np.isfinite(float(rows[0]["prediction"]))
