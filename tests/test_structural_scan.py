"""The local-level filter over linked blocks against a plain Kalman filter."""

import numpy as np
import pandas as pd
import pytest

from tests.conftest import long_table
from tests.test_arima import K, prepared
from tidemark.operators import series
from tidemark.operators.structural import LocalLevelPlan, gains, one_step


def plain_filter(y, q):
    """Levels before each step and the level and variance at the end, starting from the first value."""
    level, variance, before = y[0], 1.0, [y[0]]
    for v in y[1:]:
        before.append(level)
        variance = (variance + q) / (variance + q + 1)
        level += variance * (v - level)
    return np.array(before), level, variance


@pytest.mark.parametrize("q", [0.0, 1e-30, 1e-8, 1e-3, 1.0, 1e2])
@pytest.mark.parametrize("entering", [1e15, 1.0, 0.5, 1e-6])
def test_gains_and_predictions(q, entering):
    y = np.random.default_rng(0).normal(size=3_000).cumsum() + 50
    level, variance, want, spread = 3.0, entering, [], []
    for v in y:
        want.append(level)
        variance = (variance + q) / (variance + q + 1)
        spread.append(variance)
        level += variance * (v - level)
    assert gains(q, entering, len(y)) == pytest.approx(np.array(spread), rel=1e-8)
    assert one_step(y, q, 3.0, entering) == pytest.approx(np.array(want), rel=1e-8)


@pytest.mark.parametrize("q", [0.0, 1e-8, 1e-2, 1e2])
def test_blocks_are_linked_exactly(spark, q):
    y = np.random.default_rng(1).normal(size=30_000).cumsum() / 50 + 10
    table = long_table({"a": y}, freq="h")
    at = [("x", str(pd.Timestamp("2020-01-01") + pd.Timedelta(hours=25_000)))]
    blocked, located = prepared(spark, table, at, grain="hour")
    plan = LocalLevelPlan(blocked, located, K, [q])
    models = plan.models()
    before, level, variance = plain_filter(y[:25_000], q)
    row = models.first()
    assert row.level == pytest.approx(level, rel=1e-9) and row.P == pytest.approx(variance, rel=1e-9)
    fitted = plan.points(models).where("not is_post").orderBy("t").toPandas().fitted.to_numpy()
    assert fitted == pytest.approx(before, rel=1e-8)


def test_many_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 70)
    monkeypatch.setattr("tidemark.operators.structural.BLOCK_ROWS", 70)
    y = np.random.default_rng(2).normal(size=2_000).cumsum() / 20
    blocked, located = prepared(spark, long_table({"a": y, "b": y[:300]}, freq="h"), [("x", "2020-01-08"), ("y", "2020-03-01")], grain="hour")
    plan = LocalLevelPlan(blocked, located, K, [0.0, 1e-6])
    rows = plan.models().collect()
    assert {(r.analysis_id, r.key) for r in rows} >= {("x", "a"), ("x", "b"), ("y", "a")}
    for r in rows:
        assert r.level == pytest.approx(plain_filter(y[: r.n_pre], r.q)[1], rel=1e-8)
