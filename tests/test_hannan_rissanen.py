"""The moment solves against least squares on the full design, written out row by row."""

import numpy as np
import pytest

from tidemark.functions import hannan_rissanen as hr


def moments(x: np.ndarray, lags: int) -> hr.Moments:
    n = len(x)
    products = np.array([x[k:] @ x[: n - k] if k < n else 0.0 for k in range(lags + 1)])
    return hr.Moments(n, products, float(x.sum()), x[:lags], x[::-1][: lags + 1])


def direct(x, spec, period, horizon):
    """(coefficients, sigma2, aic, forecasts) by explicit regressions and a forward recursion."""
    n = len(x)
    m = hr.long_ar_order(n - 1 - 2 * period)
    poly = hr.difference_polynomial(spec.d, spec.D, period)
    z = np.full(n, np.nan)
    for t in range(len(poly) - 1, n):
        z[t] = poly @ x[t::-1][: len(poly)]
    t = np.arange(hr.sample_lags(m, period), n)
    const = [np.ones(len(t))] if spec.constant else []
    skip = len(const)
    a = np.linalg.lstsq(np.column_stack([*const, *[z[t - k] for k in range(1, m + 1)]]), z[t], rcond=None)[0]
    e = np.full(n, np.nan)
    for i in range(len(poly) - 1 + m, n):
        e[i] = z[i] - (a[0] if skip else 0.0) - sum(a[skip + k - 1] * z[i - k] for k in range(1, m + 1))
    ar = [*range(1, spec.p + 1), *([spec.s] if spec.P else [])]
    ma = [*range(1, spec.q + 1), *([spec.s] if spec.Q else [])]
    design = np.column_stack([*const, *[z[t - k] for k in ar], *[e[t - k] for k in ma]])
    b = np.linalg.lstsq(design, z[t], rcond=None)[0]
    rest = z[t] - design @ b
    sigma2 = rest @ rest / len(t)
    xs, zs, es = list(x), list(z), list(e)
    for _ in range(horizon):
        i = len(xs)
        v = (b[0] if skip else 0.0) + sum(w * zs[i - k] for w, k in zip(b[skip:], ar, strict=False))
        v += sum(w * es[i - k] for w, k in zip(b[skip + len(ar):], ma, strict=True))
        zs.append(v)
        es.append(0.0)
        xs.append(v - sum(poly[k] * xs[i - k] for k in range(1, len(poly))))
    return b, sigma2, len(t) * (np.log(2 * np.pi * sigma2) + 1) + 2 * (design.shape[1] + 1), np.array(xs[n:])


SPECS = [
    (hr.Spec(1, 0, 0), 0), (hr.Spec(2, 1, 1), 0), (hr.Spec(3, 0, 3), 0), (hr.Spec(0, 1, 2), 0), (hr.Spec(0, 0, 1), 0),
    (hr.Spec(1, 1, 1, 1, 1, 1, 12), 12), (hr.Spec(2, 0, 1, 0, 1, 1, 4), 4), (hr.Spec(1, 1, 1, 0, 1, 1, 7), 7),
    (hr.Spec(1, 1, 1, 1, 0, 0, 12), 12),
]


@pytest.mark.parametrize("spec,period", SPECS)
@pytest.mark.parametrize("seed", [0, 1])
def test_equals_direct_least_squares(spec, period, seed):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=340).cumsum() * 3 if spec.d else rng.normal(size=340) + np.sin(np.arange(340) / 5)
    x = x - x.mean()
    mom = moments(x, hr.sample_lags(hr.MAX_LONG_AR, period))
    fit = hr.Grid(mom, period).fit(spec)
    _, sigma2, aic, ahead = direct(x, spec, period, 40)
    if fit is None:  # dropped: explosive
        return
    assert fit.sigma2 == pytest.approx(sigma2, rel=1e-9)
    assert fit.aic == pytest.approx(aic, abs=1e-6)
    mean, se = hr.forecast(fit, mom.tail, 0, 40)
    assert mean == pytest.approx(ahead, abs=1e-8)
    assert np.all(np.diff(se) >= -1e-12)
    later, later_se = hr.forecast(fit, mom.tail, 13, 27)
    assert later == pytest.approx(mean[13:], abs=1e-8) and later_se == pytest.approx(se[13:], abs=1e-8)
    assert hr.forecast_total(fit, mom.tail, 40) == pytest.approx(mean.sum(), abs=1e-7)


def test_level_moments_equal_the_cross_products():
    x = np.random.default_rng(3).normal(size=60)
    lags = 9
    design = np.column_stack([np.ones(51), *[x[lags - k : 60 - k] for k in range(lags + 1)]])
    assert hr.level_moments(moments(x, 12), lags) == pytest.approx(design.T @ design, abs=1e-9)


def test_ar1_is_recovered():
    rng = np.random.default_rng(5)
    x = np.zeros(4000)
    for t in range(1, 4000):
        x[t] = 0.7 * x[t - 1] + rng.normal()
    fit = hr.Grid(moments(x, 28), 0).fit(hr.Spec(1, 0, 0))
    assert fit.ar[0] == pytest.approx(0.7, abs=0.05) and fit.sigma2 == pytest.approx(1.0, abs=0.1)


def test_ma1_is_recovered():
    e = np.random.default_rng(6).normal(size=6001)
    fit = hr.Grid(moments(e[1:] + 0.5 * e[:-1], 28), 0).fit(hr.Spec(0, 0, 1))
    assert fit.ma[0] == pytest.approx(0.5, abs=0.06)


def test_explosive_and_flat_series_have_no_fit():
    assert hr.Grid(moments(1.05 ** np.arange(200.0), 28), 0).fit(hr.Spec(1, 0, 0)) is None
    assert hr.Grid(moments(np.zeros(100), 28), 0).fit(hr.Spec(1, 1, 1)) is None
    assert hr.Grid(moments(np.ones(4), 28), 0).fit(hr.Spec(1, 0, 0)) is None


def test_stability_matches_the_roots():
    rng = np.random.default_rng(1)
    for _ in range(300):
        c = rng.normal(size=rng.integers(1, 6)) * 0.7
        largest = np.abs(np.roots(np.r_[1.0, -c])).max()
        if abs(largest - hr.UNIT_ROOT) > 1e-6:
            assert hr._stable(c) == (largest < hr.UNIT_ROOT)
