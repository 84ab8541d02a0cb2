import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import clean, detect
from tidemark.sources import catalogue, export, tables


def text(spark, columns, rows):
    return spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns))


def test_names():
    assert clean.clean_names([" Date ", "My-Value", "a b", "Price ($)", "___", "A B", "1x", "é!"]) == [
        "date", "my_value", "a_b", "price", "col_4", "a_b_2", "1x", "é"]


def test_date_spellings(spark):
    given = ["2020-01-15", "2020-01-15 10:30:00", "2020-01-15T10:30:00", "01/15/2020", "15/01/2020", "2020/1/5", "5 Jan 2020",
             "5-Jan-2020", "Jan 5, 2020", "20200105", "2020-01", "2020", " 2020-01-15 ", "not-a-date", "", "12345", "3.5", None]
    rows = text(spark, ["x"], [(v,) for v in given]).withColumn("p", detect.parse_timestamp(F.col("x"))).collect()
    got = [None if r.p is None else r.p.strftime("%Y-%m-%d %H:%M") for r in rows]
    assert got == ["2020-01-15 00:00", "2020-01-15 10:30", "2020-01-15 10:30", "2020-01-15 00:00", "2020-01-15 00:00", "2020-01-05 00:00",
                   "2020-01-05 00:00", "2020-01-05 00:00", "2020-01-05 00:00", "2020-01-05 00:00", "2020-01-01 00:00", "2020-01-01 00:00",
                   "2020-01-15 00:00", None, None, None, None, None]


def test_numbers(spark):
    given = ["$10.50", "5.5%", "1,234", "-3", "abc", "", None, "1-2"]
    rows = clean.parse_numeric(text(spark, ["x"], [(v,) for v in given]), "x").collect()
    assert [r.x for r in rows] == [10.5, 5.5, 1234.0, -3.0, None, None, None, None]


def test_detection(spark):
    rows = [(f"{i}", f"2020-01-{i + 1:02d}" if i % 3 else "bad", f"${i}.5", "word") for i in range(20)]
    table = text(spark, ["id", "when", "price", "note"], rows)
    assert detect.detect_date_column(table) == "when"
    assert detect.detect_numeric_columns(table, ["when"]) == ["id", "price"]
    assert detect.validate_table(table) == ("when", "id")
    typed = table.withColumn("at", F.current_timestamp())
    assert detect.detect_date_column(typed) == "at"
    assert detect.detect_date_column(table.select("note", "price")) is None
    with pytest.raises(ValueError, match="No date column"):
        detect.validate_table(table.select("note", "price"))
    with pytest.raises(ValueError, match="No numeric metric"):
        detect.validate_table(table.select("when", "note"))
    with pytest.raises(ValueError, match="at least 2"):
        detect.validate_table(table.select("when"))
    with pytest.raises(ValueError, match="empty"):
        detect.validate_table(table.where("false"))


def test_half_the_dates_must_parse(spark):
    good = text(spark, ["d"], [("2020-01-01",), ("x",)])
    assert [r.d.year for r in clean.parse_dates(good, "d").collect()] == [2020]
    bad = text(spark, ["d"], [("2020-01-01",), ("x",), ("y",)])
    assert [r.d for r in clean.parse_dates(bad, "d").collect()] == ["2020-01-01", "x", "y"]
    note, parse, _ = clean.date_parsing(bad, "d")
    assert "33% success rate" in note and not parse
    huge = spark.createDataFrame([(10**19 * 1.0,), (5.0,)], "d double")
    assert "out of datetime range" in clean.date_parsing(huge, "d")[0]


def test_year_and_month(spark):
    table = spark.createDataFrame([(2020, 1, 1.0), (2021, 12, 2.0), (None, 3, 3.0)], "year int, month int, value double")
    assert clean.year_month_columns(table) == ("year", "month")
    dates = [r[clean.CONSTRUCTED].strftime("%Y-%m-%d") for r in clean.date_from_year_month(table, "year", "month").collect()]
    assert dates == ["2020-01-01", "2021-12-01"]
    fiscal = spark.createDataFrame([("2020", 13), ("2021", 1)], "fiscal_year string, month int")
    assert clean.year_month_columns(fiscal) == ("fiscal_year", None)
    assert clean.date_from_year_month(fiscal, "fiscal_year").count() == 2
    prepared = clean.preprocess(table.select("year", "month", "value"))
    assert prepared.date_col == clean.CONSTRUCTED and prepared.df.count() == 2


def test_forward_fill_carries_across_buckets(spark):
    stamps = pd.date_range("2020-01-01", periods=200, freq="7h")
    y = np.where(np.random.RandomState(0).rand(200) < 0.7, np.nan, np.arange(200.0))
    y[:5] = np.nan
    frame = pd.DataFrame({"k": ["a"] * 200, "ts": stamps, "y": y})
    frame = pd.concat([frame, frame.assign(k="b", y=-frame.y), frame.assign(k="c", y=np.nan)])
    table = spark.createDataFrame(frame).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    for grain in (None, "minute", "hour"):
        out = clean.forward_fill(table, ["k"], "ts", ["y"], grain).orderBy("k", "ts").toPandas()
        want = frame.sort_values(["k", "ts"]).groupby("k").y.transform(lambda s: s.ffill().bfill())
        assert np.allclose(out.y.to_numpy(float), want.to_numpy(), equal_nan=True)


def test_mean_fill_and_outliers(spark):
    table = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0), ("b", 10.0), ("b", None)], "k string, y double")
    assert sorted(r.y for r in clean.fill_mean(table, ["k"]).collect()) == [1, 2, 3, 10, 10]
    assert sorted(r.y for r in clean.fill_mean(table).collect())[1:3] == [3.0, 14 / 3]
    y = np.r_[np.random.RandomState(0).normal(50, 5, 98), 200, -200]
    frame = spark.createDataFrame(pd.DataFrame({"k": "a", "y": y}))
    q1, q3 = np.quantile(y, [0.25, 0.75])
    kept = y[(y >= q1 - 1.5 * (q3 - q1)) & (y <= q3 + 1.5 * (q3 - q1))]
    for keys in ([], ["k"]):
        assert sorted(r.y for r in clean.outliers_iqr(frame, "y", keys).collect()) == pytest.approx(sorted(kept))
        z = np.abs((y - y.mean()) / y.std(ddof=1))
        assert clean.outliers_zscore(frame, "y", keys).count() == (z <= 3).sum()
    flat = spark.createDataFrame([("a", 5.0)] * 4, "k string, y double")
    assert clean.outliers_zscore(flat, "y").count() == 4 and clean.outliers_iqr(flat, "y", ["k"]).count() == 4


def messy(spark):
    rows = [("2020-01-01", "10", None), ("2020-01-01", "10", None), ("", "20", None), ("2020-01-03", "bad", None), ("2020-01-04", "40", None)]
    return text(spark, [" Date ", " Value ", "Empty"], rows)


def test_pipeline_on_a_messy_table(spark):
    prepared = clean.preprocess(messy(spark))
    rows = sorted((r.date.strftime("%Y-%m-%d"), r.value) for r in prepared.df.collect())
    assert prepared.df.columns == ["date", "value"] and rows == [("2020-01-01", 10.0), ("2020-01-04", 40.0)]
    assert (prepared.date_col, prepared.metric_col) == ("date", "value")
    steps = {r.step: (r.n_rows, r.n_affected) for r in prepared.steps().collect()}
    assert steps["read"] == (5, 0) and steps["drop_duplicates"] == (4, 1) and steps["parse_dates"] == (3, 1) and steps["missing_drop"] == (2, 1)
    assert "Dropped empty columns: empty" in prepared.notes and any("Auto-detected date" in w for w in prepared.warnings)
    assert "Only 2 rows" in prepared.length_warning(2) and prepared.length_warning(30) is None


@pytest.mark.parametrize("missing", ["drop", "forward_fill", "mean"])
@pytest.mark.parametrize("outliers", [None, "iqr", "zscore"])
def test_every_strategy_runs_and_is_counted(spark, missing, outliers):
    frame = pd.DataFrame({"date": pd.date_range("2020-01-01", periods=60).astype(str), "value": [str(v) for v in range(60)]})
    frame.loc[[5, 9], "value"] = None
    frame.loc[20, "value"] = "99999"
    prepared = clean.preprocess(spark.createDataFrame(frame), "date", "value", missing, outliers)
    n = prepared.df.count()
    # the outlier pulls the mean, so that filled values lie outside the quartile fences too
    removed = {None: 0, "iqr": 3 if missing == "mean" else 1, "zscore": 1}[outliers]
    assert n == (58 if missing == "drop" else 60) - removed
    assert prepared.steps().collect()[-1].n_rows == n


def test_bad_strategies(spark):
    with pytest.raises(ValueError, match="missing-value"):
        clean.preprocess(messy(spark), missing="guess")
    with pytest.raises(ValueError, match="outlier"):
        clean.preprocess(messy(spark), outliers="guess")


def test_csv_and_catalogue(spark, tmp_path):
    (tmp_path / "website_sessions.csv").write_text("date,sessions\n2022-01-01,100\n2022-01-02,110\n")
    table = catalogue.load_dataset(spark, str(tmp_path), "website_sessions")
    assert table.dtypes == [("date", "string"), ("sessions", "string")] and table.count() == 2
    assert tables.check_input(table) is table
    with pytest.raises(ValueError, match="Unknown dataset"):
        catalogue.load_dataset(spark, str(tmp_path), "nothing")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        catalogue.load_dataset(spark, str(tmp_path), "carbon_tax").count()
    with pytest.raises(ValueError, match="at least 2 columns"):
        tables.check_input(table.select("date"))
    with pytest.raises(ValueError, match="no data rows"):
        tables.check_input(table.where("false"))
    specs = catalogue.spec_table(spark)
    assert specs.count() == 11 and specs.where("intervention_ts IS NULL").count() == 0


@pytest.mark.parametrize("fmt", ["csv", "parquet"])
def test_export(spark, tmp_path, fmt):
    points = spark.createDataFrame([("a", "2020-01-01", 1.0, 2.0), ("b", "2020-01-02", 3.0, None)], "analysis_id string, d string, observed double, counterfactual double")
    export.write_points(points.withColumn("ts", F.col("d").cast("timestamp")), str(tmp_path / fmt), fmt)
    back = spark.read.format(fmt).option("header", True).load(str(tmp_path / fmt))
    assert sorted((r.analysis_id, r.date, float(r.observed)) for r in back.collect()) == [("a", "2020-01-01 00:00:00", 1.0), ("b", "2020-01-02 00:00:00", 3.0)]
