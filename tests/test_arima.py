import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import level_shift, long_table
from tidemark.operators import inference, series, structural
from tidemark.operators.arima import ArimaPlan, candidate_orders, difference, seasonal_period

K = ["key"]
AT = [("x", "2020-03-11")]


def prepared(spark, table, specs=AT, grain="day", **kwargs):
    rows = series.index_series(series.to_series(spark.createDataFrame(table), K, "date", "value", grain), K, grain)
    blocked = series.prepare(rows, K)
    return blocked, series.locate_interventions(series.own_rows(blocked), K, specs, **kwargs)


def run(spark, table, specs=AT, seasonal=False, order=None, **kwargs):
    blocked, located = prepared(spark, table, specs, **kwargs)
    if order:
        located = located.withColumn("order", F.array(*[F.lit(v) for v in order]))
    plan = ArimaPlan(blocked, located, K, seasonal)
    models = plan.models()
    points = plan.points(models)
    return {r.key: r for r in plan.effects(models, points).collect()}, points


def known_series():
    noise = np.random.RandomState(42).normal(0, 2, 100)
    tiny = np.full(100, 1e-5)
    tiny[70:] += 1e-6
    return {
        "up": level_shift(), "down": level_shift(100, 0.3, -15), "none": 50 + noise, "flat": np.full(100, 50.0), "tiny": tiny,
    }


@pytest.fixture(scope="module")
def known(spark):
    return run(spark, long_table(known_series()))


def test_planted_effects_are_found(known):
    effects, _ = known
    up, down, none = effects["up"], effects["down"], effects["none"]
    assert up.effect > 5 and up.p_value < 0.05 and up.significant and up.direction == "increase"
    assert down.effect < -5 and down.p_value < 0.05 and down.direction == "decrease"
    assert abs(none.effect) < 10 and none.p_value > 0.05 and not none.significant
    assert (up.n_pre, up.n_post) == (70, 30)


def test_result_fields(known):
    for r in known[0].values():
        assert len(r.arima_order) == 3 and 0 <= r.p_value <= 1 and 0 <= r.ljung_box_pvalue <= 1
        assert r.cf_ci_lower <= r.cf_ci_upper and r.effect_ci_lower <= r.effect <= r.effect_ci_upper
        assert r.seasonal_order is None and isinstance(r.residuals_ok, bool)


def test_degenerate_series(known):
    flat, tiny = known[0]["flat"], known[0]["tiny"]
    assert flat.effect == 0 and flat.p_value >= 0.05 and flat.effect_pct == 0
    assert tiny.effect == pytest.approx(1e-6) and np.isfinite(tiny.effect_pct) and tiny.effect_pct == pytest.approx(10)


def test_every_row_has_a_counterfactual(known):
    rows = known[1].toPandas()
    assert len(rows) == 500 and rows.counterfactual.notna().all()
    post = rows[rows.is_post]
    assert (post.t >= 70).all() and post.cf_lower.notna().all() and rows[~rows.is_post].cf_lower.isna().all()
    assert (rows.effect - (rows.observed - rows.counterfactual)).abs().max() == 0


def test_fitted_values_are_one_step_predictions(spark):
    y = level_shift(shift=0)
    _, points = run(spark, long_table({"a": y}), order=(1, 1, 0))
    rows = points.orderBy("t").toPandas()
    pre = y[:70]
    dy = np.diff(pre)
    t = np.arange(21, 70)  # long autoregression of order 17, then 3 + 1 lags
    phi = dy[t - 1] @ dy[t - 2] / (dy[t - 2] @ dy[t - 2])
    assert rows.fitted[2:70].to_numpy() == pytest.approx(pre[1:-1] + phi * np.diff(pre[:-1]), abs=1e-8)
    steps = phi ** np.arange(1, 31)
    assert rows.fitted[70:].to_numpy() == pytest.approx(pre[-1] + dy[-1] * np.cumsum(steps), abs=1e-8)


def test_explicit_order_is_kept(spark):
    effects, _ = run(spark, long_table({"a": np.random.RandomState(42).randn(80)}), [("x", "2020-03-01")], order=(1, 1, 1))
    assert effects["a"].arima_order == [1, 1, 1]


def test_many_series_equal_single_series(spark, known):
    alone, _ = run(spark, long_table({"up": known_series()["up"]}))
    for name in ("effect", "effect_pct", "p_value", "aic", "ljung_box_pvalue"):
        assert alone["up"][name] == pytest.approx(known[0]["up"][name], rel=1e-9)


def test_results_do_not_depend_on_blocks_or_partitions(spark, known, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 66)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        effects, points = run(spark, long_table(known_series()))
        assert points.count() == 500
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    for key, row in known[0].items():
        for name in ("effect", "p_value", "cf_ci_lower", "ljung_box_pvalue"):
            assert effects[key][name] == pytest.approx(row[name], rel=1e-8, abs=1e-12), (key, name)


def test_several_analyses_share_one_pass(spark):
    table = long_table({"up": level_shift()})
    both, _ = prepared(spark, table, [("a", "2020-03-11"), ("b", "2020-02-20")])
    located = series.locate_interventions(series.own_rows(both), K, [("a", "2020-03-11"), ("b", "2020-02-20")])
    plan = ArimaPlan(both, located, K)
    models = plan.models()
    effects = {r.analysis_id: r for r in plan.effects(models, plan.points(models)).collect()}
    for name, at in (("a", "2020-03-11"), ("b", "2020-02-20")):
        alone, _ = run(spark, table, [(name, at)])
        assert effects[name].effect == pytest.approx(alone["up"].effect, rel=1e-9)
        assert effects[name].n_pre == alone["up"].n_pre
    quick = {r.analysis_id: r for r in plan.mean_effects(models).collect()}
    for name, r in quick.items():
        post = level_shift()[r.n_pre:].mean()
        assert post - r.forecast_mean == pytest.approx(effects[name].effect, rel=1e-8)


def test_forecast_blocks_join_up(spark, monkeypatch):
    from tidemark.operators import arima

    table = long_table({"a": level_shift(n=160)})
    whole, _ = run(spark, table)
    monkeypatch.setattr(arima, "FORECAST_ROWS", 16)
    parts, points = run(spark, table)
    assert points.count() == 160
    assert parts["a"].effect == pytest.approx(whole["a"].effect, rel=1e-9)
    assert parts["a"].p_value == pytest.approx(whole["a"].p_value, rel=1e-6)


def test_seasonal_series(spark):
    """A drifting season: (0,1,1)(0,1,1) at period 12, with a step after the intervention."""
    e = np.random.RandomState(2).normal(0, 1, 420)
    y = np.zeros(420)
    for t in range(13, 420):
        y[t] = y[t - 1] + y[t - 12] - y[t - 13] + e[t] - 0.4 * e[t - 1] - 0.6 * e[t - 12] + 0.24 * e[t - 13]
    y = y[120:] + 10 * np.sin(np.arange(300) * np.pi / 6)
    y[280:] += 30
    table = long_table({"a": y})
    at = [("x", "2020-10-07")]
    effects, points = run(spark, table, at, seasonal=True)
    row = effects["a"]
    assert row.seasonal_order[3] == 12 and sum(row.seasonal_order[:3]) > 0
    assert row.effect == pytest.approx(30, abs=8) and row.significant and row.n_post == 20
    plain, _ = run(spark, table, at)
    assert (row.cf_ci_upper - row.cf_ci_lower) < (plain["a"].cf_ci_upper - plain["a"].cf_ci_lower)
    assert points.count() == 300


def test_rejected_series_get_no_fit(spark):
    blocked, located = prepared(spark, long_table({"short": np.arange(20.0), "ok": level_shift()}), [("x", "2020-01-12"), ("y", "2020-03-11")])
    status = {(r.analysis_id, r.key): r.status for r in located.collect()}
    assert status["x", "short"] == "too_short" and status["y", "short"] == "too_late" and status["y", "ok"] == "ok"
    models = ArimaPlan(blocked, located, K).models().select("analysis_id", "key").collect()
    assert {tuple(m) for m in models} == {("x", "ok"), ("y", "ok")}


def test_candidate_tiers(spark):
    located = spark.createDataFrame([(100, 70), (3000, 1001), (6000, 10), (5000, 1000)], "n long, n_pre long")
    sizes = {(r.n, r.n_pre): r["count"] for r in candidate_orders(located).groupBy("n", "n_pre").count().collect()}
    assert sizes == {(100, 70): 30, (3000, 1001): 6, (6000, 10): 16, (5000, 1000): 30}


def test_seasonal_period_by_length(spark):
    sizes = [50, 51, 200, 201, 3000, 3001, 10000, 10001]
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select(seasonal_period(F.col("n")).alias("s")).collect()
    assert [r.s for r in rows] == [0, 4, 4, 12, 12, 7, 7, 0]


def test_difference(spark):
    y = np.random.RandomState(0).normal(size=40)
    rows = series.index_series(series.to_series(spark.createDataFrame(long_table({"a": y})), K, "date", "value", "day"), K, "day")
    z = difference(rows, K, 1, 1, 4).orderBy("t").toPandas().z.to_numpy(float)
    d = np.diff(y)
    assert np.isnan(z[:5]).all() and z[5:] == pytest.approx(d[4:] - d[:-4])


def test_ljung_box_by_hand(spark, monkeypatch):
    monkeypatch.setattr(series, "BLOCK_ROWS", 32)
    rng = np.random.RandomState(3)
    walk = np.zeros(200)
    for i in range(1, 200):
        walk[i] = 0.9 * walk[i - 1] + rng.randn() * 0.1
    white = rng.randn(200)
    cases = {"white": white, "walk": walk, "short": white[:3], "brief": white[:23], "zero": np.zeros(40)}
    rows = [(k, t, float(v)) for k, vs in cases.items() for t, v in enumerate(vs)]
    out = {r.key: r for r in inference.ljung_box(spark.createDataFrame(rows, "key string, t long, residual double"), K).collect()}
    for k in ("white", "walk", "brief"):
        r = cases[k] - cases[k].mean()
        n, lags = len(r), min(10, len(r) // 5)
        q = n * (n + 2) * sum((r[j:] @ r[:-j] / (r @ r)) ** 2 / (n - j) for j in range(1, lags + 1))
        assert out[k].n_lags == lags and out[k].q_stat == pytest.approx(q, rel=1e-9)
    assert out["walk"].ljung_box_pvalue < 0.05 and not out["walk"].residuals_ok
    assert out["short"].ljung_box_pvalue == 1.0 and out["short"].residuals_ok and out["zero"].ljung_box_pvalue == 1.0


def kalman(y, q):
    level, p, sse, logs = y[0], 1.0, 0.0, 0.0
    for v in y[1:]:
        f = p + q + 1
        k = (p + q) / f
        e = v - level
        sse, logs, level, p = sse + e * e / f, logs + np.log(f), level + k * e, k
    m = len(y) - 1
    return -0.5 * (m * (np.log(2 * np.pi * sse / m) + 1) + logs), level, p, sse / m


@pytest.mark.parametrize("block", [4096, 66])
def test_local_level_equals_a_plain_filter(spark, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK_ROWS", block)
    monkeypatch.setattr(structural, "BLOCK_ROWS", block)
    ratios = [0.3, 1.0, 3.0, 10.0]  # with small blocks only ratios that forget a block quickly
    rng = np.random.RandomState(0)
    cases = {"a": np.cumsum(rng.normal(size=250)) + rng.normal(size=250), "b": np.cumsum(rng.normal(size=250)) * 0.5}
    blocked, located = prepared(spark, long_table(cases), [("x", "2020-07-19")])
    plan = structural.LocalLevelPlan(blocked, located, K, ratios)
    models = plan.models()
    points = plan.points(models)
    for r in models.collect():
        pre = cases[r.key][:200]
        fits = {q: kalman(pre, q) for q in ratios}
        best = max(ratios, key=lambda q: fits[q][0])
        assert r.q == best and r.n_pre == 200
        assert [r.loglik, r.level, r.P, r.sigma2] == pytest.approx(list(fits[best]), rel=1e-9)
        rows = points.where(F.col("key") == r.key).orderBy("t").toPandas()
        assert len(rows) == 250
        for t in (1, 2, 65, 66, 67, 131, 132, 140, 199):
            assert rows.fitted[t] == pytest.approx(kalman(pre[:t], best)[1] if t > 1 else pre[0], rel=1e-7), t
        half = 1.959963984540054 * np.sqrt(r.sigma2 * (r.P + 1 * r.q + 1))
        assert rows.cf_upper[200] - rows.counterfactual[200] == pytest.approx(half)
    assert {r.key for r in plan.effects(models, points).collect()} == {"a", "b"}


def test_local_level_finds_a_shift_and_survives_a_constant(spark):
    y = 50 + np.random.RandomState(42).normal(0, 2, 100)
    y[70:] += 10
    blocked, located = prepared(spark, long_table({"up": y, "flat": np.full(100, 5.0)}))
    plan = structural.LocalLevelPlan(blocked, located, K)
    models = plan.models()
    rows = {r.key: r for r in plan.effects(models, plan.points(models)).collect()}
    assert rows["up"].effect == pytest.approx(10, abs=1.5) and rows["up"].significant
    assert rows["flat"].effect == 0 and rows["flat"].p_value == 1.0
