"""Long series get the whole search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import long_table
from tidemark.operators import series
from tidemark.operators.arima import ArimaPlan

K = ["key"]


@pytest.fixture(scope="module")
def long_series(spark):
    n, noise = 10_400, np.random.RandomState(1).normal(size=10_400)
    y = 20 * np.sin(np.arange(n) * 2 * np.pi / 7) + noise.cumsum() * 0.1 + noise
    table = long_table({"a": y}, start="2000-01-01 00:00", freq="h")
    blocked = series.prepare(series.index_series(series.to_series(spark.createDataFrame(table), K, "date", "value", "hour"), K, "hour"), K)
    return blocked, series.locate_interventions(series.own_rows(blocked), K, [("x", "2000-11-01")])


def test_a_long_seasonal_series_keeps_its_season_and_its_grid(long_series):
    plan = ArimaPlan(*long_series, K, seasonal=True)
    tried = plan.candidates().select(F.inline("candidates")).agg(F.max("p").alias("p"), F.max("q").alias("q")).first()
    assert max(tried.p, tried.q) == 3
    assert plan.models().first().seasonal_order[3] == 7
    assert ArimaPlan(*long_series, K, seasonal=True, period=12).models().first().seasonal_order[3] == 12


def test_tiers_and_periods_out_of_reach(long_series):
    row = ArimaPlan(*long_series, K, seasonal=True, tiers=True).models().first()
    assert row.seasonal_order is None and max(row.arima_order[0], row.arima_order[2]) <= 2
    with pytest.raises(ValueError, match="do not fit a block"):
        ArimaPlan(*long_series, K, seasonal=True, period=2_100)
