"""Tables of analyses, points from the top-level call, and tables as people have them."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import level_shift, long_table
from tests.test_panels import AT, panel, sc_table
from tidemark.operators import detect, did, series
from tidemark.plans.effects import Analysis, causal_effects, causal_points, causal_results

K = ["key"]


@pytest.mark.parametrize("rows", [4096, 7])
def test_nearest_rows_of_a_spec_table(spark, monkeypatch, rows):
    monkeypatch.setattr(series, "BLOCK_ROWS", rows)
    rng = np.random.default_rng(5)
    data = {k: np.unique(rng.integers(0, 400, n)) for k, n in (("a", 90), ("b", 31), ("c", 1))}
    start = pd.Timestamp("2020-01-01")
    table = pd.DataFrame([(k, start + pd.Timedelta(minutes=int(m)), t) for k, at in data.items() for t, m in enumerate(at)], columns=["key", "ts", "t"])
    indexed = spark.createDataFrame(table).withColumn("y", F.col("t") * 1.0)
    asked = [(f"{k}{m}", k, start + pd.Timedelta(seconds=30 * int(m))) for k in data for m in rng.integers(-50, 900, 60)] + [("nobody", "z", start)]
    specs = spark.createDataFrame(pd.DataFrame(asked, columns=["analysis_id", "key", "intervention_ts"]))
    found = {(r.analysis_id, r.key): r for r in series.locate_interventions(indexed, K, specs, min_length=None).collect()}
    assert {k for _, k in found} == set(data)
    for name, k, at in asked[:-1]:
        away = [abs((start + pd.Timedelta(minutes=int(m))) - at) for m in data[k]]
        want = max(i for i, x in enumerate(away) if x == min(away))
        assert found[name, k].idx == want and found[name, k].n == len(data[k])


def test_a_table_gives_what_a_list_gives(spark):
    table = spark.createDataFrame(sc_table(donors=4, dates=60))
    analyses = [Analysis("l", AT, "bsts"), Analysis("i", AT), Analysis("d", AT, "did", "t"), Analysis("s", AT, "synthetic_control", "t"), Analysis("w", AT, "did", "who")]
    listed = causal_results(table, "unit", "ts", "y", analyses, "day")
    units = ["t", "d00", "d01", "d02", "d03"]
    rows = [(a.analysis_id, u, AT, a.method) for a in analyses[:2] for u in units] + [(a.analysis_id, a.treatment_unit, AT, a.method) for a in analyses[2:]]
    specs = spark.createDataFrame(rows, "analysis_id string, unit string, intervention_ts string, method string")
    tabled = causal_results(table, "unit", "ts", "y", specs, "day")
    by = ["analysis_id", "series_key"]
    a, b = (r.effects.toPandas().sort_values(by).reset_index(drop=True) for r in (listed, tabled))
    assert list(a.status) == list(b.status) and list(a.series_key) == list(b.series_key)
    for c in ("effect", "p_value", "n_pre", "parallel_trends_p", "n_donors", "treated_pre_mean", "aic"):
        assert b[c].to_numpy(float) == pytest.approx(a[c].to_numpy(float), nan_ok=True), c
    p, q = (r.points.toPandas().sort_values([*by, "ts"]).reset_index(drop=True) for r in (listed, tabled))
    assert len(p) == len(q) == 5 * 60 * 2 + 60 + 60 and q.counterfactual.to_numpy() == pytest.approx(p.counterfactual.to_numpy(), nan_ok=True)


def test_rows_of_the_table_that_cannot_be_analysed(spark):
    table = spark.createDataFrame(sc_table(donors=3, dates=60))
    specs = spark.createDataFrame(
        [("a", "zz", AT, "arima"), ("b", "t", None, "arima"), ("c", None, AT, "did"), ("d", "t", AT, "magic"), ("e", "t", None, "did"), ("f", "t", AT, None)],
        "analysis_id string, unit string, intervention_ts string, method string")
    got = {r.analysis_id: (r.status, r.method) for r in causal_effects(table, "unit", "ts", "y", specs, "day").collect()}
    assert got == {"a": ("unknown_series", "arima"), "b": ("no_date", "arima"), "c": ("no_unit", "did"), "d": ("unknown_method", "magic"),
                   "e": ("no_date", "did"), "f": ("ok", "arima")}
    nothing = causal_results(table, "unit", "ts", "y", specs.where("analysis_id = 'd'"), "day")
    assert nothing.effects.count() == 1 and nothing.points.count() == 0


def test_did_of_a_table_equals_the_list(spark):
    moments = did.panel_moments(spark.createDataFrame(panel()), "unit", "ts", "y")
    specs = [(f"{u} {d}", u, f"2020-12-{d:02d}") for u in ("u0", "u3", "nobody") for d in (1, 2, 15, 31)]
    listed = spark.createDataFrame(specs, "analysis_id string, treatment_unit string, intervention_ts string")
    for what in (did.cell_means, did.parallel_trends, did.spec_check, did.did_points):
        one, two = (what(moments, s).toPandas() for s in (specs, listed))
        by = [c for c in ("analysis_id", "ts") if c in one]
        one, two = (t.sort_values(by).reset_index(drop=True)[one.columns] for t in (one, two))
        pd.testing.assert_frame_equal(one, two, check_dtype=False, rtol=1e-8)


@pytest.mark.parametrize("name", ["model", "d", "q", "u", "t", "idx", "value", "block"])
def test_the_key_may_have_any_name(spark, name):
    table = spark.createDataFrame(long_table({"a": level_shift()})).withColumnRenamed("value", "metric").withColumnRenamed("key", name)
    analyses = [Analysis("i", "2020-03-11"), Analysis("l", "2020-03-11", "bsts")] if name in ("model", "q") else [Analysis("l", "2020-03-11", "bsts")]
    assert all(r.status == "ok" and r.effect > 5 for r in causal_effects(table, name, "date", "metric", analyses, "day").collect())


def test_dates_as_people_have_them(spark):
    n = 40
    years = pd.DataFrame({"key": "a", "year": range(1980, 1980 + n), "y": np.arange(n) + np.r_[np.zeros(25), np.full(15, 30.0)]})
    rows = causal_effects(spark.createDataFrame(years), "key", "year", "y", [Analysis("x", "2005-01-01", "bsts")], "year").collect()
    assert [(r.status, r.n_pre, r.n_post) for r in rows] == [("ok", 25, 15)]
    days = pd.date_range("2021-01-05", periods=56)
    text = pd.DataFrame({"key": "a", "day": days.strftime("%d/%m/%Y"), "y": np.arange(56.0)})
    made = series.to_series(spark.createDataFrame(text), K, "day", "y", "day").orderBy("ts").toPandas()
    assert list(made.ts) == list(days)
    american = text.assign(day=days.strftime("%m/%d/%Y"))
    assert list(series.to_series(spark.createDataFrame(american), K, "day", "y", "day").orderBy("ts").toPandas().ts) == list(days)
    assert detect.day_comes_first(spark.createDataFrame(text), "day") and not detect.day_comes_first(spark.createDataFrame(american), "day")


def test_absent_columns_are_found(spark):
    table = spark.createDataFrame(long_table({"a": level_shift()}))
    rows = causal_effects(table, "key", "no such column", "value", [Analysis("x", "2020-03-11", "bsts")], "day").collect()
    assert rows[0].status == "ok" and rows[0].effect > 5
    points = causal_points(table, "key", None, None, [Analysis("x", "2020-03-11", "bsts")], "day")
    assert points.count() == 100 and points.where("is_post").count() == 30


def test_rejected_rows(spark):
    rows = [("a", "2020-01-01", "1"), (None, "x", None), ("a", None, "2"), ("a", "soon", "2"), ("a", "2020-01-02", None), ("a", "2020-01-02", "much"), ("a", "2020-01-02", "nan")]
    table = spark.createDataFrame(rows, "key string, at string, v string")
    assert {r.reason: r.n_rows for r in series.rejected_rows(table, K, "at", "v").collect()} == {"no_key": 1, "no_date": 1, "bad_date": 1, "no_value": 1, "bad_value": 2}
    assert series.to_series(table, K, "at", "v").count() == 1
