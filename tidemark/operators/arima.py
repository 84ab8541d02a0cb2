"""Interrupted time series: ARIMA and seasonal counterfactuals for many series at once.

Plan.  Every block of a series is one array, joined to the end of the block before it, so lag products at any distance up
to a block are a few matrix products.  Blocks sum them up to each requested intervention; running sums over blocks give
the moments before every cut.  Those sums plus the values next to the cut are sufficient for every candidate order, so
the order search, its refit and any number of further cuts (placebo dates) cost no further pass, and a pass costs as
much as there are rows and cuts.  A fitted model is a short filter, applied to the same arrays.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import hannan_rissanen as hr
from tidemark.functions.stats import Z_975
from tidemark.operators import series
from tidemark.operators.inference import effect_summary, ljung_box
from tidemark.operators.series import blocks, own_rows, per_block, with_lags
from tidemark.session import checkpointed

# The search grid, the default order, the seasonal periods tried, and the reference's tiers by length.
MAX_P, MAX_D, MAX_Q = 3, 1, 3
LONG_SERIES, LONG_PRE = 5000, 1000
DEFAULT_ORDER = (1, 1, 1)
SEASONAL_BASE = (1, 1, 1)
SEASONAL_PERIODS = ((10000, 0), (3000, 7), (200, 12), (50, 4))
PERIODS = (4, 7, 12)

FORECAST_ROWS = 1024
SEASONAL_ROWS = 3 * 6  # three rows for each coefficient of the largest seasonal candidate
OK, FIT_FAILED = "ok", "fit_failed"

def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


_DOUBLE, _INT, _DOUBLES = T.DoubleType(), T.IntegerType(), T.ArrayType(T.DoubleType())
_MODEL = _struct(
    aic=_DOUBLE, sigma2=_DOUBLE, const=_DOUBLE, ar=_DOUBLES, ma=_DOUBLES, last_errors=_DOUBLES,
    filter_const=_DOUBLE, filter=_DOUBLES,
)
_CANDIDATES = T.ArrayType(_struct(aic=_DOUBLE, p=_INT, d=_INT, q=_INT))
_SEASONAL_CANDIDATES = T.ArrayType(_struct(aic=_DOUBLE, P=_INT, D=_INT, Q=_INT, s=_INT))
_FORECAST = T.ArrayType(_struct(mean=_DOUBLE, se=_DOUBLE))
_SUMS = T.ArrayType(_struct(cut=T.LongType(), total=_DOUBLE, products=_DOUBLES, tail=_DOUBLES))


def max_order(n: Column, n_pre: Column) -> Column:
    """Largest p and q that the reference searches: 2 for long series, 1 for a long pre period, else 3."""
    return F.when(n > LONG_SERIES, 2).when(n_pre > LONG_PRE, 1).otherwise(MAX_P)


def seasonal_period(n: Column) -> Column:
    """The reference's period by length."""
    longest, *shorter = SEASONAL_PERIODS
    period = F.when(n > longest[0], longest[1])
    for bound, s in shorter:
        period = period.when(n > bound, s)
    return period.otherwise(0)


def candidate_orders(located: DataFrame) -> DataFrame:
    """One row per analysis and candidate (p, d, q) in the reference's tiers; ``ArimaPlan`` searches them if told to."""
    grid = [
        F.struct(F.lit(p).alias("p"), F.lit(d).alias("d"), F.lit(q).alias("q"))
        for p in range(MAX_P + 1) for d in range(MAX_D + 1) for q in range(MAX_Q + 1) if p + q > 0
    ]
    bound = max_order(F.col("n"), F.col("n_pre"))
    return located.withColumn("bound", bound).withColumn("order", F.explode(F.array(*grid))).where(
        (F.col("order.p") <= F.col("bound")) & (F.col("order.q") <= F.col("bound"))
    ).select(*located.columns, "order.p", "order.d", "order.q")


def difference(indexed: DataFrame, keys: Sequence[str], d: int = 1, D: int = 0, s: int = 0) -> DataFrame:
    """Adds ``z``, the d-times and D-times (at lag s) differenced value; null where a lag is missing."""
    poly = hr.difference_polynomial(d, D, s)
    depth = len(poly) - 1
    lagged = with_lags(blocks(indexed, keys, depth), keys, depth)
    z = F.lit(0.0)
    for k, weight in enumerate(poly):
        if weight:
            z = z + float(weight) * F.get("lags", F.lit(k))
    return lagged.withColumn("z", z).drop("lags", "block")


def block_arrays(blocked: DataFrame, keys: Sequence[str], reach: int) -> DataFrame:
    """(keys, block, rows, previous): the rows (t, ts, y) of every block in order, and the last ``reach`` values of the
    block before, which is found by a join of the blocks with themselves, one block on."""
    if reach > series.BLOCK_ROWS:
        raise ValueError(f"{reach} lags do not fit a block of {series.BLOCK_ROWS} rows")
    made = own_rows(blocked).groupBy(*keys, "block").agg(F.array_sort(F.collect_list(F.struct("t", "ts", "y"))).alias("rows"))
    last = F.slice("rows", F.greatest(F.size("rows") - reach + 1, F.lit(1)), F.lit(reach))
    ends = made.select(*keys, (F.col("block") + 1).alias("block"), F.transform(last, lambda r: r["y"]).alias("previous"))
    return made.join(ends, [*keys, "block"], "left")


@F.pandas_udf(_SUMS)
def _block_sums(values: pd.Series, previous: pd.Series, cuts: pd.Series, pivot: pd.Series, t0: pd.Series, depth: pd.Series) -> pd.Series:
    """Of every block: sums of lag products from its start up to each of its cuts, and (cut null) to its end."""
    out = []
    for y, before, at, centre, start, lags in zip(values, previous, cuts, pivot, t0, depth, strict=True):
        x = np.asarray(y, float) - centre
        known = np.zeros(0) if before is None else np.asarray(before, float) - centre
        padded = np.concatenate([np.zeros(lags + 1 - len(known)), known, x])
        windows = np.lib.stride_tricks.sliding_window_view(padded, lags + 1)[1:, ::-1]  # x_t, x_(t-1), ..., x_(t-depth)
        products, total, made, done = np.zeros(lags + 1), 0.0, [], 0
        for cut in [*(() if at is None else at), None]:
            end = len(x) if cut is None else int(cut - start)
            part = x[done:end]
            products, total, done = products + part @ windows[done:end], total + float(part.sum()), end
            tail = padded[max(lags + 1 - len(known), end) : end + lags + 1][::-1]
            made.append({"cut": cut, "total": total, "products": products, "tail": None if cut is None else tail})
        out.append(made)
    return pd.Series(out)


def lag_moments(arrays: DataFrame, cuts: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """(keys, cut, products, total, tail): sums of lag products of every series before each of its cuts.

    ``cuts``: distinct (keys, cut, pivot).  Cuts go to the block of the last row before them; a block's sums up to its
    cuts are found in one go, and running sums of whole blocks are added.
    """
    last = F.floor((F.col("cut") - 1) / series.BLOCK_ROWS)
    inside = cuts.groupBy(*keys, last.alias("block")).agg(F.array_sort(F.collect_list("cut")).alias("cuts"))
    spans = per_block(cuts.groupBy(*keys).agg(F.max("cut").alias("n"), F.max("pivot").alias("pivot")), "n").drop("n")
    parts = (
        arrays.join(spans, [*keys, "block"])
        .join(inside, [*keys, "block"], "left")
        .withColumn("sums", _block_sums(
            F.transform("rows", lambda r: r["y"]), "previous", "cuts", "pivot", F.col("block") * series.BLOCK_ROWS, F.lit(depth)
        ))
        .select(*keys, "block", F.inline("sums"))
    )
    earlier = f"OVER (PARTITION BY {', '.join([f'`{k}`' for k in keys] or ['1'])} ORDER BY block, cut NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"

    def running(value: str) -> str:
        return f"coalesce(sum(CASE WHEN cut IS NULL THEN {value} END) {earlier}, 0D)"

    before = ", ".join(running(f"get(products, {k})") for k in range(depth + 1))
    summed = parts.select(*keys, "cut", "products", "tail", F.expr(f"total + {running('total')} AS total"), F.expr(f"array({before}) AS before"))
    return summed.where("cut IS NOT NULL").select(*keys, "cut", "total", "tail", F.zip_with("products", "before", lambda a, b: a + b).alias("products"))


def _moments(located: DataFrame, arrays: DataFrame, keys: Sequence[str], depth: int) -> DataFrame:
    """Analyses with everything a fit needs: products, total, the first and the last values."""
    cuts = located.groupBy(*keys, F.col("idx").alias("cut")).agg(F.max("pivot").alias("pivot"))
    sums = lag_moments(arrays, cuts, keys, depth)
    first = F.transform(F.slice("rows", 1, depth), lambda r: r["y"])
    heads = arrays.where("block = 0").select(*keys, first.alias("first_values"))
    joined = located.withColumn("cut", F.col("idx")).join(sums, [*keys, "cut"])
    joined = series.join_per_key(joined, heads, keys)
    # A row is small but costs milliseconds to fit, so the number of tasks must not follow from the bytes.
    tasks = int(located.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    head = F.slice(F.transform("first_values", lambda v: v - F.col("pivot")), F.lit(1), F.least(F.col("cut"), F.lit(depth)).cast("int"))
    return joined.withColumn("head", head).drop("cut", "first_values").repartition(tasks, "analysis_id", *keys)


def _read(row) -> hr.Moments:
    return hr.Moments(
        int(row.n_pre), np.asarray(row.products), float(row.total), np.asarray(row.head), np.asarray(row.tail)
    )


def _frame(*columns: pd.Series, names: Sequence[str]) -> Iterator:
    return pd.concat(columns, axis=1, keys=names).itertuples(index=False)


_MOMENT_COLUMNS = ["n_pre", "products", "total", "head", "tail"]


@F.pandas_udf(_CANDIDATES)
def _fit_candidates(
    n_pre: pd.Series, products: pd.Series, total: pd.Series, head: pd.Series, tail: pd.Series, bound: pd.Series,
    longest: pd.Series,
) -> pd.Series:
    out = []
    for row in _frame(n_pre, products, total, head, tail, bound, longest, names=[*_MOMENT_COLUMNS, "bound", "longest"]):
        grid = hr.Grid(_read(row), 0, longest=row.longest)
        found = []
        for p in range(row.bound + 1):
            for d in range(MAX_D + 1):
                for q in range(row.bound + 1):
                    aic = grid.aic(hr.Spec(p, d, q)) if p + q else None
                    if aic is not None:
                        found.append({"aic": aic, "p": p, "d": d, "q": q})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(_SEASONAL_CANDIDATES)
def _fit_seasonal_candidates(
    n_pre: pd.Series, products: pd.Series, total: pd.Series, head: pd.Series, tail: pd.Series, periods: pd.Series,
    longest: pd.Series,
) -> pd.Series:
    out = []
    for row in _frame(n_pre, products, total, head, tail, periods, longest, names=[*_MOMENT_COLUMNS, "periods", "longest"]):
        mom, tried = _read(row), [int(s) for s in row.periods]
        if len(tried) > 1:  # on one sample, whose lags leave every candidate enough rows
            tried = [s for s in tried if mom.n - hr.grid_lags(mom.n, s, row.longest) >= SEASONAL_ROWS]
        lags = max((hr.grid_lags(mom.n, s, row.longest) for s in tried), default=0)
        found = []
        for s in tried:
            grid = hr.Grid(mom, s, lags, row.longest)
            for P, D, Q in ((0, 0, 1), (0, 1, 1), (1, 0, 0), (1, 1, 0), (1, 0, 1), (1, 1, 1)):
                aic = grid.aic(hr.Spec(*SEASONAL_BASE, P, D, Q, s))
                if aic is not None:
                    found.append({"aic": aic, "P": P, "D": D, "Q": Q, "s": s})
        out.append(found)
    return pd.Series(out)


@F.pandas_udf(_MODEL)
def _fit_model(
    n_pre: pd.Series, products: pd.Series, total: pd.Series, head: pd.Series, tail: pd.Series,
    order: pd.Series, seasonal: pd.Series, longest: pd.Series,
) -> pd.DataFrame:
    out = []
    for row in _frame(
        n_pre, products, total, head, tail, order, seasonal, longest, names=[*_MOMENT_COLUMNS, "order", "seasonal", "longest"]
    ):
        mom = _read(row)
        extra = [] if row.seasonal is None else [int(v) for v in row.seasonal]
        fit = hr.Grid(mom, extra[3] if extra else 0, longest=row.longest).fit(hr.Spec(*(int(v) for v in row.order), *extra))
        out.append(fit or hr.random_walk(mom))
    return pd.DataFrame(out, columns=list(hr.Fit._fields))


def _model(row) -> hr.Fit:
    arrays = [np.asarray(a, float) for a in (row.ar, row.ma, row.last_errors)]
    return hr.Fit(0.0, row.sigma2, row.const, *arrays, 0.0, np.zeros(0))


_FORECAST_COLUMNS = ["sigma2", "const", "ar", "ma", "last_errors", "tail"]


@F.pandas_udf(_DOUBLES)
def _fitted_block(
    values: pd.Series, previous: pd.Series, weights: pd.Series, const: pd.Series, pivot: pd.Series, pre_mean: pd.Series,
    differenced: pd.Series,
) -> pd.Series:
    """One-step predictions of a block: a filter of the values before each row."""
    out = []
    for y, before, w, c, centre, mean, by_first in zip(values, previous, weights, const, pivot, pre_mean, differenced, strict=True):
        x, w = np.asarray(y, float) - centre, np.asarray(w, float)
        lead = np.full(len(w), (y[0] if by_first else mean) - centre)
        if before is not None:
            lead = (np.asarray(before, float) - centre)[len(before) - len(w) :]
        out.append(centre + c + np.convolve(np.concatenate([lead, x]), np.concatenate([[0.0], w]), "full")[len(w) : len(w) + len(x)])
    return pd.Series(out)


@F.pandas_udf(_FORECAST)
def _forecast_block(
    sigma2: pd.Series, const: pd.Series, ar: pd.Series, ma: pd.Series, last_errors: pd.Series, tail: pd.Series,
    start: pd.Series, steps: pd.Series,
) -> pd.Series:
    out = []
    for row in _frame(
        sigma2, const, ar, ma, last_errors, tail, start, steps, names=[*_FORECAST_COLUMNS, "start", "steps"]
    ):
        mean, se = hr.forecast(_model(row), np.asarray(row.tail), int(row.start), int(row.steps))
        out.append([{"mean": m, "se": s} for m, s in zip(mean, se, strict=True)])
    return pd.Series(out)


@F.pandas_udf(_DOUBLE)
def _forecast_mean(
    sigma2: pd.Series, const: pd.Series, ar: pd.Series, ma: pd.Series, last_errors: pd.Series, tail: pd.Series,
    steps: pd.Series,
) -> pd.Series:
    rows = _frame(sigma2, const, ar, ma, last_errors, tail, steps, names=[*_FORECAST_COLUMNS, "steps"])
    return pd.Series([
        hr.forecast_total(_model(row), np.asarray(row.tail), int(row.steps)) / row.steps for row in rows
    ])


def _model_fields() -> list[Column]:
    return [F.col(f"model.{name}") for name in _FORECAST_COLUMNS[:-1]] + [F.col("tail")]


def best_order(candidates: Column) -> Column:
    """The lowest AIC; ties go to the smallest order."""
    best = F.array_min(candidates)
    return F.when(best.isNotNull(), F.array(best["p"], best["d"], best["q"]))


class ArimaPlan:
    """Fits, forecasts and points of a set of analyses over prepared series (``series.prepare``).

    ``located`` holds one row per analysis: analysis_id, keys, idx, n, n_pre, n_post, pivot, status and,
    optionally, ``order`` (array<int>: p, d, q) and ``seasonal_order`` (array<int>: P, D, Q, s) to bypass the searches.
    Only rows with status ``ok`` are fitted.

    The whole grid is searched at any length, and the seasonal period is ``period`` or, of ``periods``, the one of
    lowest AIC; periods and the lags of the first stage, at most ``max_long_ar``, must fit a block of rows.  ``tiers``
    limits orders and periods by length as the reference does, for comparison with it.

    A series on which nothing can be fitted has ``fit_status`` ``fit_failed`` among the models, and no points or effect.
    """

    def __init__(
        self, blocked: DataFrame, located: DataFrame, keys: Sequence[str], seasonal: bool = False,
        period: int | None = None, tiers: bool = False, periods: Sequence[int] = PERIODS, max_long_ar: int = hr.MAX_LONG_AR,
    ):
        self.keys = list(keys)
        self.by = ["analysis_id", *self.keys]
        for name in ("order", "seasonal_order"):
            if name not in located.columns:
                located = located.withColumn(name, F.lit(None).cast("array<int>"))
        self.located = checkpointed(located.where(F.col("status") == "ok"))
        self.seasonal = seasonal
        self.tiers, self.longest = tiers, max_long_ar
        self.periods = [period] if period is not None else list(periods)
        if seasonal and min(self.periods, default=2) < 2:
            raise ValueError(f"a period of {min(self.periods)} is no season")
        given = self.located.agg(F.max(F.element_at("seasonal_order", 4))).first()[0] if seasonal else None
        self.period = period
        self.depth = hr.sample_lags(max_long_ar, max([*self.periods, given or 0]) if seasonal else 0)
        self.rows = own_rows(blocked)
        self.arrays = block_arrays(blocked, self.keys, self.depth + 1)

    def candidates(self) -> DataFrame:
        """Moments of each analysis with its candidate fits (``candidates``: aic and order)."""
        moments = _moments(self.located, self.arrays, self.keys, self.depth)
        bound = max_order(F.col("n"), F.col("n_pre")) if self.tiers else F.lit(MAX_P)
        return moments.withColumn("candidates", _fit_candidates(*_MOMENT_COLUMNS, bound, F.lit(self.longest)))

    def models(self) -> DataFrame:
        """One fitted model per analysis; checkpointed, as points and forecasts both start from it."""
        chosen = self.candidates().withColumn(
            "arima_order",
            F.coalesce("order", best_order(F.col("candidates")), F.array(*[F.lit(v) for v in DEFAULT_ORDER])),
        )
        if self.seasonal:
            length = seasonal_period(F.col("n")) if self.tiers else F.lit(self.period or 0)
            periods = F.when(length > 0, F.array(length))
            if not self.tiers:
                periods = F.coalesce(periods, F.array(*map(F.lit, self.periods)))
            periods = F.coalesce(periods, F.array().cast("array<int>"))
            fallback = F.when(length > 0, F.array(F.lit(0), F.lit(1), F.lit(1), length))
            best = F.array_min("seasonal_candidates")
            known = best.isNotNull() & ((F.col("n_pre") <= LONG_SERIES) if self.tiers else F.lit(True))
            chosen = (
                chosen.withColumn("seasonal_candidates", _fit_seasonal_candidates(*_MOMENT_COLUMNS, periods, F.lit(self.longest)))
                .withColumn(
                    "seasonal_order",
                    F.coalesce("seasonal_order", F.when(known, F.array(best["P"], best["D"], best["Q"], best["s"])).otherwise(fallback)),
                )
                .drop("seasonal_candidates")
            )
        else:
            chosen = chosen.withColumn("seasonal_order", F.lit(None).cast("array<int>"))
        fitted = chosen.withColumn("model", _fit_model(*_MOMENT_COLUMNS, "arima_order", "seasonal_order", F.lit(self.longest)))
        # a constant series is its own forecast; any other without a fit has none
        unfitted = (F.col("model.aic").isNull() | F.isnan("model.aic")) & (F.col("model.sigma2") > 0)
        return checkpointed(
            fitted.withColumn("pre_mean", F.col("pivot") + F.col("total") / F.col("n_pre"))
            .withColumn("fit_status", F.when(unfitted, FIT_FAILED).otherwise(OK))
            .drop("products", "total", "head", "candidates", "order")
        )

    def forecasts(self, models: DataFrame) -> DataFrame:
        """(analysis_id, keys, t, mean, se) for every post row, in blocks of bounded length."""
        first = F.sequence(F.lit(0).cast("long"), F.col("n_post") - 1, F.lit(FORECAST_ROWS).cast("long"))
        block = models.withColumn("start", F.explode(first)).withColumn(
            "steps", F.least(F.lit(FORECAST_ROWS).cast("long"), F.col("n_post") - F.col("start"))
        )
        return (
            block.withColumn("ahead", _forecast_block(*_model_fields(), "start", "steps"))
            .select(*self.by, "idx", "pivot", "start", F.posexplode("ahead").alias("pos", "at"))
            .select(
                *self.by,
                (F.col("idx") + F.col("start") + F.col("pos")).alias("t"),
                (F.col("pivot") + F.col("at.mean")).alias("mean"),
                F.col("at.se").alias("se"),
            )
        )

    def points(self, models: DataFrame) -> DataFrame:
        """Observed, fitted and counterfactual values of every row of every fitted analysis.

        ``fit_t`` counts the pre rows from the first one with all its lags; before that values ahead of the
        series are taken to be its mean (its first value, if differenced).
        """
        models = models.where(F.col("fit_status") == OK)
        filters = per_block(
            models.select(
                *self.by, "idx", "pivot", "pre_mean", F.element_at("arima_order", 2).alias("d"),
                "model.filter_const", "model.filter", "n_pre", "seasonal_order",
            ),
            "n_pre",
        )
        differenced = (F.col("d") + F.coalesce(F.get("seasonal_order", F.lit(1)), F.lit(0))) > 0
        fitted = _fitted_block(F.transform("rows", lambda r: r["y"]), "previous", "filter", "filter_const", "pivot", "pre_mean", differenced)
        pre = (
            self.arrays.join(filters, [*self.keys, "block"])
            .withColumn("fitted", fitted)
            .select(*self.by, "idx", F.size("filter").alias("lags"), F.explode(F.arrays_zip("rows", "fitted")).alias("at"))
            .select(*self.by, "idx", "lags", "at.rows.*", "at.fitted")
            .where(F.col("t") < F.col("idx"))
            .select(*self.by, "t", "ts", F.lit(False).alias("is_post"), F.col("y").alias("observed"), "fitted",
                    F.col("fitted").alias("counterfactual"), F.lit(None).cast("double").alias("cf_lower"),
                    F.lit(None).cast("double").alias("cf_upper"), (F.col("t") - F.col("lags")).alias("fit_t"))
        )
        post = self.rows.join(self.forecasts(models), [*self.keys, "t"]).select(
            *self.by, "t", "ts", F.lit(True).alias("is_post"), F.col("y").alias("observed"),
            F.col("mean").alias("fitted"), F.col("mean").alias("counterfactual"),
            (F.col("mean") - Z_975 * F.col("se")).alias("cf_lower"),
            (F.col("mean") + Z_975 * F.col("se")).alias("cf_upper"), F.lit(None).cast("long").alias("fit_t"),
        )
        return pre.unionByName(post).withColumn("effect", F.col("observed") - F.col("counterfactual"))

    def effects(self, models: DataFrame, points: DataFrame) -> DataFrame:
        """One row per fitted analysis: effect, intervals, p-value, orders, AIC, residual check."""
        residuals = points.where("fit_t >= 0").select(*self.by, F.col("fit_t").alias("t"), F.col("effect").alias("residual"))
        checks = ljung_box(residuals, self.by).select(*self.by, "ljung_box_pvalue", "residuals_ok")
        fits = models.select(*self.by, "arima_order", "seasonal_order", F.col("model.aic").alias("aic"))
        return effect_summary(points, self.by).join(fits, self.by).join(checks, self.by)

    def mean_effects(self, models: DataFrame) -> DataFrame:
        """Only the effect (mean of observed minus forecast), with no pass over the post rows' forecasts."""
        steps = F.col("n_post")
        return models.where(F.col("fit_status") == OK).withColumn("forecast_mean", F.col("pivot") + _forecast_mean(*_model_fields(), steps))
