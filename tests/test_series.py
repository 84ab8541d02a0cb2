import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import long_table
from tidemark.operators import series

K = ["key"]


def indexed(spark, table, grain="day"):
    return series.index_series(series.to_series(spark.createDataFrame(table), K, "date", "value", grain), K, grain)


def test_duplicate_dates_collapse_to_their_mean(spark):
    table = long_table({"a": np.arange(100.0)})
    table = pd.concat([table, table.head(10).assign(value=lambda d: d.value + 2)])
    rows = series.to_series(spark.createDataFrame(table), K, "date", "value").orderBy("ts").toPandas()
    assert len(rows) == 100 and rows.y.iloc[3] == 4.0 and rows.y.iloc[50] == 50.0


def test_nan_null_and_text_values_are_left_out(spark):
    rows = [("a", "2020-01-01", "1"), ("a", "2020-01-02", "x"), ("a", "nope", "3"), ("a", "2020-01-03", None), (None, "2020-01-01", "1")]
    out = series.to_series(spark.createDataFrame(rows, "key string, date string, value string"), K, "date", "value").collect()
    assert [(r.key, r.y) for r in out] == [("a", 1.0)]
    nan = spark.createDataFrame(pd.DataFrame({"key": ["a"], "date": [pd.Timestamp("2020-01-01")], "value": [float("nan")]}))
    assert series.to_series(nan, K, "date", "value").count() == 0


@pytest.mark.parametrize("grain", [None, "second", "minute", "hour", "day"])
def test_index_counts_observations_across_buckets(spark, grain):
    freq = {None: "7s", "second": "13min", "minute": "5h", "hour": "77h", "day": "3D"}[grain]
    table = pd.concat([long_table({"a": np.arange(300.0), "b": np.arange(50.0)}, freq=freq)])
    rows = indexed(spark, table, grain).orderBy("key", "ts").toPandas()
    assert (rows.t == rows.y).all()


def test_lags_do_not_depend_on_blocks(spark, monkeypatch):
    table = long_table({"a": np.arange(333.0), "b": np.arange(40.0) * 2})
    for size in (16, 64, 4096):
        monkeypatch.setattr(series, "BLOCK_ROWS", size)
        rows = series.with_lags(series.blocks(indexed(spark, table), K, 7), K, 7).orderBy("key", "t").toPandas()
        assert len(rows) == 373
        for r in rows.itertuples():
            step = 1 if r.key == "a" else 2
            assert list(r.lags) == [step * (r.t - k) for k in range(min(r.t, 7) + 1)]


def test_overlap_must_fit_a_block(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 8)
    with pytest.raises(ValueError, match="does not fit"):
        series.blocks(indexed(spark, long_table({"a": np.arange(5.0)})), K, 9)


def locate(spark, at, n=100, **kwargs):
    rows = indexed(spark, long_table({"a": np.arange(float(n))}))
    return series.locate_interventions(rows, K, [("x", at)], **kwargs).first()


@pytest.mark.parametrize("at,idx,status", [
    ("2020-03-11", 70, "ok"), ("2020-03-11 11:59:00", 70, "ok"), ("2020-03-11 12:00:00", 71, "ok"),
    ("2020-01-01", 0, "too_early"), ("2019-01-01", 0, "too_early"), ("2020-04-09", 99, "too_late"),
    ("2030-01-01", 99, "too_late"), ("2020-01-05", 4, "too_early"), ("2020-01-06", 5, "ok"),
    ("2020-04-04", 94, "ok"), ("2020-04-05", 95, "too_late"),
])
def test_nearest_date_and_window(spark, at, idx, status):
    row = locate(spark, at)
    assert (row.idx, row.status, row.n_pre, row.n_post) == (idx, status, idx, 100 - idx)


def test_short_series(spark):
    assert locate(spark, "2020-01-15", n=29).status == "too_short"
    assert locate(spark, "2020-01-15", n=30).status == "ok"
    assert locate(spark, "2020-01-15", n=29, min_length=None).status == "ok"


def test_spec_table_joins_on_shared_columns(spark):
    rows = indexed(spark, long_table({"a": np.arange(40.0), "b": np.arange(50.0)}))
    specs = spark.createDataFrame([("one", "a", "2020-01-20"), ("two", "b", "2020-01-25"), ("three", "b", "2020-02-01")], "analysis_id string, key string, at string")
    specs = specs.select("analysis_id", "key", F.col("at").cast("timestamp").alias("intervention_ts"))
    found = {r.analysis_id: (r.key, r.idx) for r in series.locate_interventions(rows, K, specs).collect()}
    assert found == {"one": ("a", 19), "two": ("b", 24), "three": ("b", 31)}
    with pytest.raises(ValueError, match="shares no column"):
        series.attach_specs(rows, specs.drop("key"))


def test_unknown_grain(spark):
    with pytest.raises(ValueError, match="unknown grain"):
        indexed(spark, long_table({"a": np.arange(5.0)}), "fortnight")
