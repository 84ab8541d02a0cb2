"""Lag moments by blocks against sums over whole series; long seasons, many cuts, fits that fail, series without a key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import level_shift, long_table
from tests.test_arima import K, prepared, run
from tidemark.functions import hannan_rissanen as hr
from tidemark.operators import placebo, series
from tidemark.operators.arima import ArimaPlan, block_arrays, lag_moments


def walks(**sizes):
    return {k: np.random.default_rng(n).normal(size=n).cumsum() + 30 for k, n in sizes.items()}


@pytest.mark.parametrize(("rows", "depth"), [(4096, 30), (64, 30), (40, 39)])
def test_moments_of_every_cut(spark, monkeypatch, rows, depth):
    monkeypatch.setattr(series, "BLOCK_ROWS", rows)
    data = walks(a=300, b=41, c=129)
    indexed = series.index_series(series.to_series(spark.createDataFrame(long_table(data)), K, "date", "value", "day"), K, "day")
    blocked = series.blocks(indexed, K, 0)
    at = [(k, c, 30.0) for k, y in data.items() for c in {1, 2, 39, 40, 41, 64, 65, 128, 200, 299, 300} if c <= len(y)]
    cuts = spark.createDataFrame(at, "key string, cut long, pivot double")
    found = {(r.key, r.cut): r for r in lag_moments(block_arrays(blocked, K, depth + 1), cuts, K, depth).collect()}
    assert set(found) == {(k, c) for k, c, _ in at}
    for (k, c), r in found.items():
        x = data[k][:c] - 30
        assert r.total == pytest.approx(x.sum())
        assert r.products == pytest.approx([x[i:] @ x[: c - i] if i < c else 0.0 for i in range(depth + 1)])
        assert r.tail == pytest.approx(list(x[::-1][: depth + 1]))


@pytest.mark.parametrize("period", [24, 52, 365])
def test_long_seasons(spark, period):
    n, at = 5_000, 4_500
    noise = np.random.RandomState(period).normal(size=n)
    y = np.zeros(n)
    for t in range(n):
        y[t] = 0.3 * y[t - 1] + 0.6 * (y[t - period] if t >= period else 3 * np.sin(t)) + noise[t]
    table = long_table({"a": y + 100}, freq="h")
    when = [("x", str(pd.Timestamp("2020-01-01") + pd.Timedelta(hours=at)))]
    blocked, located = prepared(spark, table, when, grain="hour")
    located = located.withColumn("order", F.array(F.lit(1), F.lit(0), F.lit(0))).withColumn("seasonal_order", F.array(*map(F.lit, (1, 0, 0, period))))
    plan = ArimaPlan(blocked, located, K, seasonal=True, period=period)
    model = plan.models().first()
    assert model.seasonal_order == [1, 0, 0, period] and model.fit_status == "ok"
    ar = np.array(model.model.ar)
    assert ar[0] == pytest.approx(0.3, abs=0.05) and ar[period - 1] == pytest.approx(0.6, abs=0.05)
    first = hr.grid_lags(at, period)
    t = np.arange(first, at)
    x = y + 100
    b = np.linalg.lstsq(np.column_stack([np.ones(len(t)), x[t - 1], x[t - period]]), x[t], rcond=None)[0]
    assert [ar[0], ar[period - 1]] == pytest.approx(list(b[1:]), rel=1e-6)
    fitted = plan.points(plan.models()).where("not is_post").orderBy("t").toPandas().fitted.to_numpy()
    assert fitted[period:] == pytest.approx(b[0] + b[1] * x[period - 1 : at - 1] + b[2] * x[: at - period], rel=1e-6)


def test_a_period_of_a_day_is_found(spark):
    e, y = np.random.RandomState(0).normal(size=1_500), np.zeros(1_500)
    for t in range(25, 1_500):
        y[t] = y[t - 1] + y[t - 24] - y[t - 25] + e[t] - 0.4 * e[t - 1] - 0.6 * e[t - 24] + 0.24 * e[t - 25]
    blocked, located = prepared(spark, long_table({"a": y}, freq="h"), [("x", "2020-02-20")], grain="hour")
    assert ArimaPlan(blocked, located, K, seasonal=True, periods=(7, 12, 24, 52)).models().first().seasonal_order[3] == 24


def test_five_years_of_months_try_a_season_of_twelve(spark):
    e, y = np.random.RandomState(0).normal(size=72), 10 * np.random.RandomState(1).normal(size=72)
    for t in range(12, 72):
        y[t] = y[t - 12] + 0.1 * e[t]
    blocked, located = prepared(spark, long_table({"a": y}, freq="MS"), [("x", "2025-01-01")], grain="month")
    assert ArimaPlan(blocked, located, K, seasonal=True).models().first().seasonal_order[3] == 12


def test_too_few_rows_for_any_fit(spark):
    table = long_table({"noise": np.random.RandomState(3).normal(size=40), "flat": np.full(40, 2.0), "long": level_shift()})
    blocked, located = prepared(spark, table, [("x", "2020-01-05"), ("y", "2020-03-11")])
    plan = ArimaPlan(blocked, located, K)
    models = plan.models()
    status = {(r.analysis_id, r.key): r.fit_status for r in models.collect()}
    assert status == {("x", "noise"): "fit_failed", ("x", "flat"): "ok", ("y", "long"): "ok"}
    points = plan.points(models)
    assert {r.key for r in points.select("key").distinct().collect()} == {"flat", "long"}
    assert {r.key for r in plan.effects(models, points).collect()} == {"flat", "long"}


def test_placebos_that_fail_are_left_out(spark):
    blocked, located = prepared(spark, long_table({"a": level_shift()}))
    located = located.withColumn("order", F.array(F.lit(3), F.lit(0), F.lit(3))).withColumn("idx", F.lit(70).cast("long"))
    rows = placebo.placebo_effects(blocked, located, K, None).toPandas()
    fits = {c: hr.Grid(hr.Moments(c, *_moments(level_shift()[:c])), 0).fit(hr.Spec(3, 0, 3)) for c in range(20, 80)}
    assert set(rows[~rows.is_real].idx) == {c for c, fit in fits.items() if fit is not None} < set(fits)


def _moments(x):
    x = x - level_shift().mean()
    return np.array([x[i:] @ x[: len(x) - i] if i < len(x) else 0.0 for i in range(30)]), x.sum(), x[:28], x[::-1][:29]


def test_one_series_without_a_key(spark):
    keyed, _ = run(spark, long_table({"a": level_shift()}))
    table = spark.createDataFrame(long_table({"a": level_shift()})).drop("key")
    blocked = series.prepare(series.index_series(series.to_series(table, [], "date", "value", "day"), [], "day"), [])
    located = series.locate_interventions(series.own_rows(blocked), [], [("x", "2020-03-11")])
    plan = ArimaPlan(blocked, located, [])
    models = plan.models()
    row = plan.effects(models, plan.points(models)).first()
    assert row.effect == pytest.approx(keyed["a"].effect) and row.p_value == pytest.approx(keyed["a"].p_value)
