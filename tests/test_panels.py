import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidemark.functions.simplex import nearest_in_hull
from tidemark.operators import did, synth
from tidemark.plans.effects import Analysis, causal_effects, check_analyses

AT = "2021-01-01"


def panel(seed=0, units=6, dates=40, per_cell=3, effect=4.0, scale=1.0, shift=0.0):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2020-12-01", periods=dates, freq="D")
    rows = [
        (f"u{u}", d, shift + scale * (10 + u + 0.1 * i + rng.normal() + (effect if u == 0 and d >= pd.Timestamp(AT) else 0)))
        for u in range(units) for i, d in enumerate(days) for _ in range(rng.integers(1, per_cell + 1))
    ]
    return pd.DataFrame(rows, columns=["unit", "ts", "y"])


def ols(table):
    treated = (table.unit == "u0").to_numpy(float)
    post = (table.ts >= pd.Timestamp(AT)).to_numpy(float)
    x = np.column_stack([np.ones(len(table)), treated, post, treated * post])
    y = table.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    s2 = ((y - x @ beta) ** 2).sum() / (len(y) - 4)
    return beta[3], np.sqrt(s2 * np.linalg.inv(x.T @ x)[3, 3])


def did_row(spark, table):
    moments = did.panel_moments(spark.createDataFrame(table), "unit", "ts", "y")
    return did.did_effects(moments, [("a", "u0", AT)]).first()


@settings(max_examples=5, deadline=None)
@given(seed=st.integers(0, 1000), effect=st.floats(-20, 20), scale=st.floats(0.01, 1000))
def test_did_equals_least_squares(spark, seed, effect, scale):
    table = panel(seed, effect=effect, scale=scale)
    row = did_row(spark, table)
    beta, se = ols(table)
    assert row.effect == pytest.approx(beta, rel=1e-7, abs=1e-7 * scale)
    assert row.effect_se == pytest.approx(se, rel=1e-7)
    assert row.n_treated + row.n_control == len(table)


def test_did_is_blind_to_a_constant(spark):
    plain, shifted = did_row(spark, panel()), did_row(spark, panel(shift=1e7))
    assert shifted.effect == pytest.approx(plain.effect, rel=1e-6) and shifted.effect_se == pytest.approx(plain.effect_se, rel=1e-5)
    assert plain.significant and plain.direction == "increase" and plain.effect == pytest.approx(4, abs=1.5)


def test_did_points_and_missing_cells(spark):
    table = panel(per_cell=1)
    gone = table[~((table.unit == "u0") & (table.ts == pd.Timestamp("2021-01-03"))) & ~((table.unit != "u0") & (table.ts == pd.Timestamp("2021-01-04")))]
    moments = did.panel_moments(spark.createDataFrame(gone), "unit", "ts", "y")
    rows = did.did_points(moments, [("a", "u0", AT)]).orderBy("ts").toPandas().set_index("ts")
    assert len(rows) == 40
    assert rows.observed.isna().sum() == 1 and rows.counterfactual.isna().sum() == 1
    pre = rows[~rows.is_post]
    assert (pre.observed == pre.counterfactual).all()
    controls = gone[(gone.unit != "u0")]
    gap = gone[(gone.unit == "u0") & (gone.ts < AT)].y.mean() - controls[controls.ts < AT].y.mean()
    day = pd.Timestamp("2021-01-05")
    assert rows.counterfactual[day] == pytest.approx(controls[controls.ts == day].y.mean() + gap)


def test_parallel_trends_sees_a_diverging_unit(spark):
    table = panel()
    diverging = table.assign(y=table.y + np.where(table.unit == "u0", (table.ts - pd.Timestamp("2020-12-01")).dt.days * 0.5, 0))
    p = [
        did.parallel_trends(did.panel_moments(spark.createDataFrame(t), "unit", "ts", "y"), [("a", "u0", AT)]).first()
        for t in (table, diverging)
    ]
    assert p[0].parallel_trends_p > 0.05 > p[1].parallel_trends_p
    pre = diverging[diverging.ts < AT]
    days = (pre.ts - pd.Timestamp("2020-12-01")).dt.days.to_numpy(float)
    w = (pre.unit == "u0").to_numpy(float)
    x = np.column_stack([np.ones(len(pre)), w, days, w * days])
    assert p[1].slope_difference == pytest.approx(np.linalg.lstsq(x, pre.y.to_numpy(), rcond=None)[0][3], rel=1e-8)


def test_spec_check(spark):
    moments = did.panel_moments(spark.createDataFrame(panel()), "unit", "ts", "y")
    only = did.panel_moments(spark.createDataFrame(panel(units=1)), "unit", "ts", "y")
    specs = [("ok", "u0", AT), ("who", "nobody", AT), ("soon", "u0", "2019-01-01"), ("late", "u0", "2030-01-01")]
    assert {r.analysis_id: r.status for r in did.spec_check(moments, specs).collect()} == {
        "ok": "ok", "who": "unknown_unit", "soon": "no_pre_rows", "late": "no_post_rows"}
    assert did.spec_check(only, specs[:1]).first().status == "no_control"


def kkt_gap(gaps: np.ndarray, weights: np.ndarray) -> float:
    """How much the objective could still fall towards a single donor; 0 at the optimum."""
    mix = weights @ gaps
    return float(mix @ mix - (gaps @ mix).min()) / max(1.0, float((gaps * gaps).sum(axis=1).max()))


@settings(max_examples=60, deadline=None)
@given(seed=st.integers(0, 10_000), donors=st.integers(1, 40), dates=st.integers(1, 30))
def test_nearest_in_hull(seed, donors, dates):
    rng = np.random.default_rng(seed)
    gaps = rng.normal(size=(donors, dates)) + rng.normal() * rng.integers(0, 3)
    if seed % 3 == 0 and donors > 2:
        gaps[1] = gaps[0]
    weights = nearest_in_hull(gaps)
    assert weights.min() >= 0 and weights.sum() == pytest.approx(1)
    assert kkt_gap(gaps, weights) < 1e-8


def sc_table(seed=0, donors=30, dates=40):
    rng = np.random.default_rng(seed)
    days = pd.date_range("2020-12-01", periods=dates, freq="D")
    factors = rng.normal(size=(3, dates)).cumsum(axis=1)
    paths = {f"d{i:02d}": 20 + rng.normal(size=3) @ factors + rng.normal(scale=0.2, size=dates) for i in range(donors)}
    treated = 0.6 * paths["d00"] + 0.4 * paths["d01"] + rng.normal(scale=0.05, size=dates)
    treated[days >= pd.Timestamp(AT)] += 3
    paths["t"] = treated
    return pd.DataFrame([(u, d, v) for u, path in paths.items() for d, v in zip(days, path, strict=True)], columns=["unit", "ts", "y"])


@pytest.mark.parametrize("working_set", [2, 64])
def test_weights_satisfy_the_optimality_conditions(spark, working_set):
    table = sc_table()
    made = synth.sc_panel(spark.createDataFrame(table), "unit", "ts", "y")
    weights = {r.unit: r.weight for r in synth.sc_weights(made, [("a", "t", AT)], working_set).collect()}
    wide = table[table.ts < AT].pivot(index="ts", columns="unit", values="y")
    donors = [c for c in wide.columns if c != "t"]
    gaps = (wide[donors].sub(wide["t"], axis=0)).to_numpy().T
    w = np.array([weights.get(d, 0.0) for d in donors])
    assert w.min() >= 0 and w.sum() == pytest.approx(1) and kkt_gap(gaps, w) < 1e-6
    assert weights["d00"] == pytest.approx(0.6, abs=0.1) and weights["d01"] == pytest.approx(0.4, abs=0.1)


def test_synthetic_effect(spark):
    table = sc_table()
    specs = [("a", "t", AT), ("placebo", "d05", AT)]
    made = synth.sc_panel(spark.createDataFrame(table), "unit", "ts", "y")
    weights = synth.sc_weights(made, specs)
    rows = {r.analysis_id: r for r in synth.sc_effects(synth.sc_points(made, weights, specs)).collect()}
    a = rows["a"]
    assert a.effect == pytest.approx(3, abs=0.3) and a.significant and a.rmspe_ratio > 5 and (a.n_pre, a.n_post) == (31, 9)
    assert a.effect_ci_lower < a.effect < a.effect_ci_upper
    assert set(rows) == {"a", "placebo"}
    held = {r.analysis_id: r.unit_weights for r in synth.weights_map(weights).collect()}
    assert sum(held["a"].values()) == pytest.approx(1) and "t" not in held["a"]


def test_dates_missing_for_a_donor(spark):
    """A donor without one of the treated unit's pre dates is left out; without a post date it makes a hole there."""
    table = sc_table(donors=4)
    holes = table[~((table.unit == "d00") & (table.ts == pd.Timestamp("2020-12-05"))) & ~((table.unit == "d01") & (table.ts == pd.Timestamp("2021-01-03")))]
    made = synth.sc_panel(spark.createDataFrame(holes), "unit", "ts", "y")
    specs = [("a", "t", AT)]
    weights = synth.sc_weights(made, specs)
    held = {r.unit: r.weight for r in weights.collect()}
    assert "d00" not in held and held["d01"] > 0
    rows = synth.sc_points(made, weights, specs).toPandas().set_index("ts")
    assert len(rows) == 40 and rows.counterfactual.isna().sum() == 1
    assert synth.sc_effects(synth.sc_points(made, weights, specs)).first().n_pre == 31
    donors = synth.sc_donors(made, specs).first()
    assert (donors.n_dates, donors.n_donors, donors.n_donors_dropped) == (31, 3, 1)


def test_a_late_donor_costs_the_others_nothing(spark):
    table = sc_table(donors=6)
    late = pd.concat([table, table[(table.unit == "d05") & (table.ts >= AT)].assign(unit="late")])
    specs = [("a", "t", AT), ("b", "late", "2021-01-05")]
    made = synth.sc_panel(spark.createDataFrame(late), "unit", "ts", "y")
    alone = synth.sc_panel(spark.createDataFrame(table), "unit", "ts", "y")
    got, want = ({r.unit: r.weight for r in synth.sc_weights(m, specs[:1]).collect()} for m in (made, alone))
    assert got == pytest.approx(want)
    fits = synth.sc_fits(made, specs)
    assert all(r.converged for r in fits.collect()) and {r.analysis_id for r in fits.collect()} == {"a", "b"}
    assert {r.analysis_id: r.status for r in synth.sc_status(made, fits, specs).collect()} == {"a": "ok", "b": "ok"}
    capped = synth.sc_fits(made, specs[:1], working_set=1, max_rounds=1)
    assert not any(r.converged for r in capped.collect())


def test_no_donor_on_all_dates(spark):
    table = sc_table(donors=3)
    gone = table[(table.unit == "t") | (table.ts >= pd.Timestamp("2020-12-10"))]
    effects = causal_effects(spark.createDataFrame(gone), "unit", "ts", "y", [Analysis("s", AT, "synthetic_control", "t")], "day", details=True).first()
    assert effects.status == "no_overlap" and effects.effect is None and (effects.n_donors, effects.n_donors_dropped) == (0, 3)


def test_all_methods_in_one_table(spark):
    table = sc_table(donors=4, dates=60)
    analyses = [Analysis("i", AT), Analysis("l", AT, "bsts"), Analysis("d", AT, "did", "t"), Analysis("s", AT, "synthetic_control", "t"),
                Analysis("w", AT, "did", "who")]
    rows = causal_effects(spark.createDataFrame(table), "unit", "ts", "y", analyses, "day").collect()
    by = {(r.analysis_id, r.series_key): r for r in rows}
    assert len(rows) == 5 + 5 + 3
    assert by["w", "who"].status == "unknown_unit" and by["w", "who"].effect is None
    assert by["s", "t"].unit_weights and by["s", "t"].effect == pytest.approx(3, abs=0.5)
    assert by["i", "t"].arima_order and by["i", "t"].method == "arima"
    assert all(r.status == "ok" for r in rows if r.analysis_id != "w")


def test_bad_requests():
    with pytest.raises(ValueError, match="Unknown method"):
        check_analyses([Analysis("a", AT, "magic")])
    with pytest.raises(ValueError, match="requires a treatment_unit"):
        check_analyses([Analysis("a", AT, "did")])
