"""Small solves on lag moments: two-stage least squares for ARMA (Hannan & Rissanen 1982).

Spark reduces a series of any length to about fifty sums (see ``operators.arima``); these helpers turn
one such row into candidate fits, one fitted model, or a block of forecasts.

Everything rests on one fact.  Residuals of the long autoregression, differences and predictions are
all linear in the vector (1, x_t, x_(t-1), ..., x_(t-L)), so each regression is a congruence of the
single matrix of cross-products of that vector.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

MAX_LONG_AR = 24  # lags of the first stage, unless the caller allows more
UNIT_ROOT, YEAR = 0.999, 12  # margin of a root for up to a year of months; a longer season has it over twelfths of its length
_REL_ZERO = 1e-13
_COLLINEAR = 1e-6
_ROWS_PER_COEFFICIENT = 3


class Moments(NamedTuple):
    """Pre-period of one series, as deviations from a pivot."""

    n: int
    products: np.ndarray  # sum over t >= k of x_t x_(t-k)
    total: float
    head: np.ndarray  # x_0, x_1, ...
    tail: np.ndarray  # x_(n-1), x_(n-2), ...


class Spec(NamedTuple):
    p: int
    d: int
    q: int
    P: int = 0
    D: int = 0
    Q: int = 0
    s: int = 0

    @property
    def constant(self) -> bool:
        return self.d + self.D == 0


class Fit(NamedTuple):
    aic: float
    sigma2: float
    const: float  # of the recursion in x
    ar: np.ndarray  # y-lags of the recursion, differencing multiplied in
    ma: np.ndarray
    last_errors: np.ndarray  # e_(n-1), e_(n-2), ...
    filter_const: float  # one-step prediction as a filter of past x only
    filter: np.ndarray


def difference_polynomial(d: int, D: int, s: int) -> np.ndarray:
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    for _ in range(D):
        poly = np.convolve(poly, np.r_[1.0, np.zeros(s - 1), -1.0])
    return poly


def long_ar_order(n: int, longest: int = MAX_LONG_AR) -> int:
    return int(max(0, min(max(6, round(10 * np.log10(max(n, 1)))), n // 4, longest)))


def sample_lags(m: int, seasonal_period: int) -> int:
    """Lags every candidate of a grid needs; fixed per grid so that all share one sample."""
    return m + max(3, seasonal_period) + 1 + seasonal_period


def grid_lags(n: int, period: int, longest: int = MAX_LONG_AR) -> int:
    """Lags that the grid of a period takes on a series of ``n`` rows."""
    return sample_lags(long_ar_order(n - 1 - 2 * period, longest), period)


def level_moments(mom: Moments, lags: int) -> np.ndarray | None:
    """Cross-products of (1, x_t, ..., x_(t-lags)) over t >= lags, from lag products and the two ends."""
    rows = mom.n - lags
    if rows < 3:
        return None
    head, tail = mom.head, mom.tail
    g = np.zeros((lags + 2, lags + 2))
    first = np.array([
        mom.products[k] - np.dot(head[k:lags], head[: lags - k]) for k in range(lags + 1)
    ])
    g[1, 1:] = g[1:, 1] = first
    mean = mom.total - head[:lags].sum()
    g[0, 0], g[0, 1], g[1, 0] = rows, mean, mean
    entering = head[:lags][::-1]
    leaving = tail[:lags]
    step = np.outer(entering, entering) - np.outer(leaving, leaving)
    for i in range(lags):
        g[i + 2, 2:] = g[i + 1, 1:-1] + step[i]
        g[2:, i + 2] = g[i + 2, 2:]
        g[0, i + 2] = g[i + 2, 0] = g[0, i + 1] + entering[i] - leaving[i]
    return g


def _solve(gram: np.ndarray, target: int, regressors: list[int]) -> tuple[np.ndarray, float] | None:
    """Least squares in moment form: (coefficients, squared error), None when the regressors are collinear."""
    spread = gram[target, target]
    if not regressors:
        return np.zeros(0), float(spread)
    square = gram[np.ix_(regressors, regressors)]
    scale = np.sqrt(np.maximum(square.diagonal(), 0.0))
    if scale.min() <= 0.0:
        return None
    square = square / np.outer(scale, scale)
    cross = gram[regressors, target] / scale
    try:
        lower = np.linalg.cholesky(square)
    except np.linalg.LinAlgError:
        return None
    if lower.diagonal().min() < _COLLINEAR:
        return None
    beta = np.linalg.solve(square, cross)
    return beta / scale, float(spread - 2 * (beta @ cross) + beta @ square @ beta)


def _stable(coefficients: np.ndarray) -> bool:
    """Roots of 1 - c1 B - c2 B^2 - ... lie safely outside the unit circle (step-down recursion)."""
    lags = np.arange(1, len(coefficients) + 1)
    c = np.asarray(coefficients, float) / UNIT_ROOT ** (lags * min(1.0, YEAR / max(lags.size, 1)))
    while c.size:
        last = c[-1]
        if abs(last) >= 1.0:
            return False
        c = (c[:-1] + last * c[-2::-1]) / (1.0 - last * last) if c.size > 1 else c[:0]
    return True


class Grid:
    """All regressions of one series that share a sample and a level-moment matrix.

    For each way of differencing, the values every candidate may use (constant, lags of the series, lags
    of the long-autoregression errors) get one cross-product matrix; a candidate is a slice of it.
    """

    def __init__(self, mom: Moments, period: int, lags: int = 0, longest: int = MAX_LONG_AR):
        """``lags``: rows left out at the start, if more than this grid needs, so that grids can share a sample."""
        self.mom = mom
        self.period = period
        self.m = long_ar_order(mom.n - 1 - 2 * period, longest)
        self.lags = max(lags, sample_lags(self.m, period))
        self.g = level_moments(mom, self.lags)
        self._bases: dict = {}

    def _basis(self, d: int, D: int):
        """(difference polynomial, rows over (1, x_t, ..., x_(t-L)), their cross-products, error filter).

        Rows: constant, z_t, z_(t-1..3), z_(t-s), e_(t-1..3), e_(t-s).
        """
        if (d, D) in self._bases:
            return self._bases[d, D]
        poly = difference_polynomial(d, D, self.period)
        size = self.lags + 2
        z = np.zeros((self.m + 1, size))
        for k in range(self.m + 1):
            z[k, 1 + k : 1 + k + poly.size] = poly
        const = np.eye(1, size)
        stage = np.vstack([const, z])
        gram = stage @ self.g @ stage.T
        found = None
        variance = gram[1, 1] - (gram[0, 1] ** 2 / gram[0, 0] if d + D == 0 else 0.0)
        if variance > _REL_ZERO * self.g[1, 1]:
            regressors = ([0] if d + D == 0 else []) + list(range(2, self.m + 2))
            fit = _solve(gram, 1, regressors)
            if fit is not None:
                error = z[0] - fit[0] @ stage[regressors]
                lags = [1, 2, 3, self.period or 1]
                rows = np.vstack([
                    const,
                    z[:1],
                    *[self._shift(z[0], k)[None] for k in lags],
                    *[self._shift(error, k)[None] for k in lags],
                ])
                found = (poly, rows, rows @ self.g @ rows.T, error)
        self._bases[d, D] = found
        return found

    @staticmethod
    def _shift(row: np.ndarray, k: int) -> np.ndarray:
        """The same value k steps earlier."""
        out = np.zeros_like(row)
        out[0] = row[0]
        out[1 + k :] = row[1 : row.size - k]
        return out

    def _attempt(self, spec: Spec):
        """(basis, regressor rows, coefficients, ar and ma polynomials, error variance, aic)."""
        basis = self._basis(spec.d, spec.D) if self.g is not None else None
        if basis is None:
            return None
        ar_lags = [*range(1, spec.p + 1), *([spec.s] if spec.P else [])]
        ma_lags = [*range(1, spec.q + 1), *([spec.s] if spec.Q else [])]
        if len(set(ar_lags)) < len(ar_lags) or len(set(ma_lags)) < len(ma_lags):
            return None
        skip = int(spec.constant)
        used = [0] * skip + [*range(2, 2 + spec.p), *([5] if spec.P else [])]
        used += [*range(6, 6 + spec.q), *([9] if spec.Q else [])]
        count = self.g[0, 0]
        solved = _solve(basis[2], 1, used) if count >= _ROWS_PER_COEFFICIENT * max(len(used), 1) else None
        if solved is None or not solved[1] > _REL_ZERO * self.g[1, 1]:
            return None
        beta, sse = solved
        phi, theta = np.zeros(max(ar_lags, default=0)), np.zeros(max(ma_lags, default=0))
        phi[[k - 1 for k in ar_lags]] = beta[skip : skip + len(ar_lags)]
        theta[[k - 1 for k in ma_lags]] = beta[skip + len(ar_lags) :]
        if not (_stable(phi) and _stable(-theta)):
            return None
        sigma2 = sse / count
        aic = count * (np.log(2 * np.pi * sigma2) + 1) + 2 * (len(used) + 1)
        return basis, used, beta, phi, theta, sigma2, float(aic)

    def aic(self, spec: Spec) -> float | None:
        attempt = self._attempt(spec)
        return attempt and attempt[-1]

    def fit(self, spec: Spec) -> Fit | None:
        attempt = self._attempt(spec)
        if attempt is None:
            return None
        (poly, rows, _, error), used, beta, phi, theta, sigma2, aic = attempt
        predict = beta @ rows[used]
        predict[1 : 1 + poly.size] -= poly
        predict[1] += 1.0
        recent = np.r_[1.0, self.mom.tail]
        errors = [error[0] + error[1 : error.size - k] @ recent[1 + k : error.size] for k in range(theta.size)]
        return Fit(
            aic, sigma2, float(beta[0]) if spec.constant else 0.0,
            -np.convolve(np.r_[1.0, -(phi if phi.size else np.zeros(1))], poly)[1:], theta, np.array(errors), float(predict[0]), predict[2:],
        )


def random_walk(mom: Moments) -> Fit:
    """What is left when no candidate can be fitted: the last value, with the spread of the differences."""
    n = mom.n
    squares = 2 * (mom.products[0] - mom.products[1] if n > 1 else 0.0) - mom.head[0] ** 2 - mom.tail[0] ** 2
    sigma2 = squares / (n - 1) if n > 1 and squares > _REL_ZERO * mom.products[0] * 10 else 0.0
    return Fit(np.nan, sigma2, 0.0, np.array([1.0]), np.zeros(0), np.zeros(0), 0.0, np.array([1.0]))


def transition(ar: np.ndarray, ma: np.ndarray, const: float) -> np.ndarray:
    """State (x lags, error lags, 1) one step ahead with a zero new error."""
    r, q = ar.size, ma.size
    step = np.zeros((r + q + 1, r + q + 1))
    step[0, :r], step[0, r : r + q], step[0, -1] = ar, ma, const
    step[range(1, r), range(r - 1)] = 1.0
    step[range(r + 1, r + q), range(r, r + q - 1)] = 1.0
    step[-1, -1] = 1.0
    return step


def leap(step: np.ndarray, impulse: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(step^n, sum over j < n of step^j impulse impulse' step'^j) by doubling."""
    power, spread = np.eye(step.shape[0]), np.zeros_like(step)
    p2, s2 = step.copy(), np.outer(impulse, impulse)
    while n:
        if n & 1:
            spread = spread + power @ s2 @ power.T
            power = power @ p2
        s2 = s2 + p2 @ s2 @ p2.T
        p2 = p2 @ p2
        n >>= 1
    return power, spread


def forecast(model: Fit, tail: np.ndarray, start: int, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and standard errors at horizons start+1 .. start+steps, as deviations from the pivot."""
    r, q = model.ar.size, model.ma.size
    past = np.zeros(r)
    past[: min(r, tail.size)] = tail[:r]
    state = np.r_[past, model.last_errors, 1.0]
    impulse = np.zeros(state.size)
    impulse[0] = 1.0
    if q:
        impulse[r] = 1.0
    step = transition(model.ar, model.ma, model.const)
    gathered = 0.0
    if start:
        power, spread = leap(step, impulse, start)
        state, impulse, gathered = power @ state, power @ impulse, spread[0, 0]
    # rows e0, e0 A, e0 A^2, ...: a stack of 2^k of them times A^(2^k) is the next 2^k
    rows, power = np.eye(1, state.size), step
    while len(rows) <= steps:
        rows = np.vstack([rows, rows @ power])
        power = power @ power
    variance = gathered + np.cumsum((rows[:steps] @ impulse) ** 2)
    return rows[1 : steps + 1] @ state, np.sqrt(model.sigma2 * variance)


def forecast_total(model: Fit, tail: np.ndarray, steps: int) -> float:
    """Sum of the first ``steps`` forecasts without walking through them (power by squaring)."""
    r = model.ar.size
    past = np.zeros(r)
    past[: min(r, tail.size)] = tail[:r]
    step = transition(model.ar, model.ma, model.const)
    size = step.shape[0]
    summing = np.zeros((size + 1, size + 1))
    summing[:size, :size] = step
    summing[size, :size] = step[0]
    summing[size, size] = 1.0
    state = np.r_[past, model.last_errors, 1.0, 0.0]
    return float((np.linalg.matrix_power(summing, steps) @ state)[-1])
