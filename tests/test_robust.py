import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.conftest import level_shift, long_table
from tests.test_arima import prepared, run
from tidemark.operators import placebo, report, series, subgroup, whatif

K = ["key"]
BY = ["analysis_id", "key"]


def test_placebo_indices_keep_clear_of_the_ends(spark):
    sizes = spark.createDataFrame([("x", "a", 100), ("x", "b", 20), ("x", "c", 60), ("x", "d", 40_000), ("x", "e", 300)], "analysis_id string, key string, n long")
    drawn = placebo.placebo_indices(sizes, K).toPandas().groupby("key").placebo_idx.agg(list)
    assert set(drawn.index) == {"a", "c", "d", "e"}
    for key, n in (("a", 100), ("c", 60), ("d", 40_000), ("e", 300)):
        lo, hi = max(10, n // 5), min(n - 10, n - n // 5)
        assert len(set(drawn[key])) == len(drawn[key]) == min(50, hi - lo)
        assert min(drawn[key]) >= lo and max(drawn[key]) < hi
    again = placebo.placebo_indices(sizes.repartition(3), K).toPandas().groupby("key").placebo_idx.agg(list)
    assert sorted(again["e"]) == sorted(drawn["e"])
    other = placebo.placebo_indices(sizes, K, seed=7).toPandas().groupby("key").placebo_idx.agg(list)
    assert sorted(other["e"]) != sorted(drawn["e"])


def test_placebo_effects_equal_separate_runs(spark):
    y = np.random.RandomState(1).normal(0, 0.1, 100)
    y[70:] += 50
    table = long_table({"a": y})
    blocked, located = prepared(spark, table)
    effects = placebo.placebo_effects(blocked, located, K, 12)
    rows = effects.toPandas()
    assert rows.is_real.sum() == 1 and len(rows) == 13
    for r in rows.head(4).itertuples():
        alone, _ = run(spark, table, [("x", str(pd.Timestamp("2020-01-01") + pd.Timedelta(days=r.idx)))])
        assert r.effect == pytest.approx(alone["a"].effect, rel=1e-7, abs=1e-9)
    s = placebo.placebo_summary(effects, K).first()
    real = abs(rows[rows.is_real].effect.iloc[0])
    fake = rows[~rows.is_real].effect.abs()
    assert s.p_value == pytest.approx(((fake >= real).sum() + 1) / 13) and s.n_placebos == 12
    assert s.is_real_effect_extreme == bool(real > np.percentile(fake, 95))
    bins = placebo.placebo_histogram(effects, K).toPandas()
    counts, _ = np.histogram(rows[~rows.is_real].effect, bins=20)
    assert bins.n.sum() == 12 and dict(zip(bins.bin, bins.n)) == {i + 1: c for i, c in enumerate(counts) if c}


def test_too_short_for_placebos(spark):
    real = spark.createDataFrame([("x", "a", 5, True, 1.0)], "analysis_id string, key string, idx long, is_real boolean, effect double")
    s = placebo.placebo_summary(real, K).first()
    assert s.p_value == 1.0 and s.n_placebos == 0 and s.is_real_effect_extreme is False


def test_calendar_segments(spark):
    table = spark.createDataFrame(pd.DataFrame({"ts": pd.to_datetime(["2020-01-15", "2020-06-30"])}))
    got = {by: [r.segment for r in subgroup.segment_calendar(table, "ts", by).collect()] for by in ("quarter", "month", "weekday")}
    assert got == {"quarter": ["2020Q1", "2020Q2"], "month": ["2020-01", "2020-06"], "weekday": ["Wednesday", "Tuesday"]}
    with pytest.raises(ValueError, match="Unknown segment_by"):
        subgroup.segment_calendar(table, "ts", "moon")


@pytest.mark.parametrize("values", ["spread", "tied", "constant"])
def test_value_bins_follow_pandas(spark, values):
    v = {"spread": np.random.RandomState(0).normal(size=101), "tied": np.r_[np.zeros(80), np.arange(1.0, 21)], "constant": np.full(40, 3.0)}[values]
    try:
        want = pd.qcut(pd.Series(v), q=4, labels=["Q1 (Low)", "Q2", "Q3", "Q4 (High)"]).astype(str)
    except ValueError:
        want = pd.cut(pd.Series(v), bins=4, labels=["Q1", "Q2", "Q3", "Q4"]).astype(str)
    for keys in ([], ["k"]):
        out = subgroup.segment_value_bin(spark.createDataFrame(pd.DataFrame({"k": "a", "i": range(len(v)), "v": v})), "v", keys)
        assert list(out.orderBy("i").toPandas().segment) == list(want)


@pytest.mark.parametrize("sent", [True, False])
def test_rows_of_few_keys_are_not_gathered(spark, monkeypatch, sent):
    """Three keys in 200 partitions: rows stay where they lie; with more facts than are sent the result is the same."""
    if not sent:
        monkeypatch.setattr(series, "_SENT_FACTS", 2)
    v = np.random.RandomState(1).normal(size=600)
    frame = pd.DataFrame({"k": np.tile(["a", "b", None], 200), "i": range(600), "v": v})
    settings = {"spark.sql.shuffle.partitions": "200", "spark.sql.autoBroadcastJoinThreshold": "4k"}  # the rows are more, their facts less
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        out = subgroup.segment_value_bin(spark.createDataFrame(frame).repartition(5), "v", ["k"])
        got = {r.i: r.segment for r in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    final = plan.split("Initial Plan")[0]
    assert not sent or ("BroadcastHashJoin" in final and "SortMergeJoin" not in final)
    known = frame.dropna()
    want = known.groupby("k").v.transform(lambda x: pd.qcut(x, 4, labels=False))
    assert got == {i: subgroup.QUARTILE_LABELS[q] for i, q in zip(known.i, want, strict=True)}


def test_subgroups(spark):
    y = level_shift(n=420, at=210, slope=0.0, shift=20)
    table = spark.createDataFrame(long_table({"a": y}))
    rows = {r.segment: r for r in subgroup.subgroup_effects(table, K, "date", "value", [("x", "2020-07-29")], "weekday", grain="day").collect()}
    assert len(rows) == 7 and all(r.status == "ok" and r.n_points == 60 for r in rows.values())
    assert all(r.effect == pytest.approx(20, abs=5) for r in rows.values())
    months = subgroup.subgroup_effects(table, K, "date", "value", [("x", "2020-07-29")], "month", grain="day").collect()
    assert {r.status for r in months} <= {"too_small", "too_early", "too_late", "too_short"} and len(months) == 14
    level = subgroup.subgroup_effects(table, K, "date", "value", [("x", "2020-07-29")], "weekday", "bsts", "day").collect()
    assert all(r.effect == pytest.approx(20, abs=5) for r in level)
    with pytest.raises(ValueError, match="Unknown method"):
        subgroup.subgroup_effects(table, K, "date", "value", [("x", "2020-07-29")], "month", "did")


def flat_points(spark):
    rng = np.random.RandomState(0)
    rows = [("x", "a", t, bool(t >= 20), float(100 + rng.normal() + (5 if t >= 20 else 0)), 100.0, 98.0, 102.0) for t in range(30)]
    frame = pd.DataFrame(rows, columns=["analysis_id", "key", "t", "is_post", "observed", "counterfactual", "cf_lower", "cf_upper"])
    frame["ts"] = pd.date_range("2020-01-01", periods=30)
    return frame, spark.createDataFrame(frame)


def test_whatif(spark):
    frame, points = flat_points(spark)
    scenarios = [whatif.Scenario("as is"), whatif.Scenario("both", 20, 5, 99), whatif.Scenario("away", 0, 5)]
    adjusted = whatif.whatif_points(points, BY, scenarios)
    rows = adjusted.where("scenario = 'both'").orderBy("t").toPandas()
    pre_mean = frame[~frame.is_post].observed.mean()
    want = 100 + np.linspace(0, 0.2 * pre_mean * 0.5, 10) + 0.05 * pre_mean
    assert rows.adjusted[20:].to_numpy() == pytest.approx(want) and (rows.adjusted[:20] == 100).all()
    out = {r.scenario: r for r in whatif.whatif_effects(adjusted, BY).collect()}
    post = frame[frame.is_post].observed.to_numpy()
    assert out["both"].effect == pytest.approx((post - want).mean())
    assert out["both"].effect_pct == pytest.approx(((post - want) / want).mean() * 100)
    assert out["both"].ci_upper - out["both"].effect == pytest.approx(2.576 * 4 / (2 * 1.96))
    assert out["as is"].note == "" and out["as is"].significant
    assert out["away"].note.endswith("NOT statistically significant.") and not out["away"].significant


def effects(spark):
    rows = [("x", 12.345, 10.06, 1.234, 5.678, 0.0123, True, "increase", 70, 30, False), ("y", -0.5, -1.0, -1.0, 1.0, 0.5, False, "decrease", 7, 3, True)]
    return spark.createDataFrame(rows, "analysis_id string, effect double, effect_pct double, cf_ci_lower double, cf_ci_upper double, p_value double, "
                                       "significant boolean, direction string, n_pre long, n_post long, residuals_ok boolean")


def test_formats(spark):
    r = report.formatted_effects(effects(spark), ["analysis_id"]).collect()
    assert [v for v in r[0]][1:] == ["+12.35", "+10.1%", "0.0123", "[1.23, 5.68]", "70 / 30",
                                     "Effect: +12.35 (+10.1%), 95% CI [1.23, 5.68], p=0.0123"]
    assert r[1].effect_text == "-0.50" and r[1].effect_pct_text == "-1.0%"


def test_sentences(spark):
    texts = [r.text for r in report.effect_summary_text(effects(spark), ["analysis_id"], "sales").collect()]
    assert texts[0] == ("The intervention caused a **+10.1% increase** in sales (95% CI [1.23, 5.68], p=0.0123). "
                        "This effect is **statistically significant**.")
    assert texts[1] == ("The intervention did not produce a statistically significant effect on sales (p=0.5000). "
                        "The observed change (decrease) may be due to random variation.")
    rows = effects(spark).withColumn("intervention_date", F.lit("2020-03-11"))
    told = [r.narrative for r in report.effect_narrative(rows, ["analysis_id"], "sales").collect()]
    assert told[0].startswith("**On 2020-03-11**, an intervention was applied.\n\nThe sales **increased by 10.1%** compared")
    assert "- Effect size: +12.3450 (+10.1%)\n- 95% confidence interval: [1.2340, 5.6780]\n- p-value: 0.0123 (significant)\n" in told[0]
    assert "**Note:** Residual diagnostics" in told[0] and "Note" not in told[1]
    assert "(decrease of 0.50) **was not statistically significant** (p=0.5000)" in told[1]


def test_chart_and_profile(spark):
    frame, points = flat_points(spark)
    chart = report.chart_points(points, BY).orderBy("ts").toPandas()
    assert chart.is_intervention.sum() == 1 and chart.is_intervention[20]
    assert chart.fitted_pre.notna().sum() == 20 and chart.counterfactual_post.notna().sum() == chart.band_lower.notna().sum() == 10
    described = report.describe_table(points.select("key", "observed", "t")).toPandas().set_index("column_name")
    want = frame[["observed", "t"]].describe()
    for c in ("observed", "t"):
        got = described.loc[c, ["count", "mean", "std", "min", "p25", "p50", "p75", "max"]].to_numpy(float)
        assert got == pytest.approx(want[c].to_numpy())
    prints = {report.table_fingerprint(points.repartition(n)).first().fingerprint for n in (1, 3, 5)}
    assert len(prints) == 1 and report.table_fingerprint(points.limit(29)).first().fingerprint not in prints


def test_fingerprint_tells_nulls_and_borders_of_values_apart(spark):
    def fp(*rows):
        return report.table_fingerprint(spark.createDataFrame(list(rows), "a string, b string")).first().fingerprint

    assert len({fp(("ab", "c")), fp(("a", "bc")), fp(("abc", None)), fp(("abc", "")), fp((None, "abc")), fp(("ab", "c"), ("ab", "c")), fp()}) == 7
    assert fp(("a", "1"), ("b", None)) == fp(("b", None), ("a", "1"))
