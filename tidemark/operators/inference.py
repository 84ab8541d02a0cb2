"""Effect size, percent, interval and p-value from observed and counterfactual values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import SIGNIFICANCE_LEVEL, Z_975, chi2_upper_p, t_two_sided_p
from tidemark.operators.series import blocks, with_lags

# Below the first a counterfactual is too close to zero to divide by; the second
# keeps the fall-back denominator away from zero.
_NEAR_ZERO = 1e-6
_TINY = 1e-10


def direction(effect: Column) -> Column:
    return F.when(effect > 0, "increase").when(effect <= 0, "decrease")


def is_significant(p_value: Column) -> Column:
    return p_value < SIGNIFICANCE_LEVEL


def percent_of_level(effect: Column, level: Column) -> Column:
    return effect / (F.abs(level) + _TINY) * 100


def t_test_p(effect: Column, se: Column, df: Column) -> Column:
    """Two-sided p of effect / se; 1 when there is no spread to test against, null when there is no effect."""
    safe = F.when(se > 0, se)
    return F.when(se > 0, t_two_sided_p(effect / safe, df)).when(effect.isNotNull(), 1.0)


def mean_effect(observed: Column, counterfactual: Column, is_post: Column) -> tuple[Column, Column]:
    """Aggregates (effect, effect_pct) over the post rows of a group."""
    gap = F.when(is_post, observed - counterfactual)
    level = F.abs(counterfactual)
    ratio = F.when(is_post & (level > _NEAR_ZERO), (observed - counterfactual) / level)
    effect = F.avg(gap)
    pre_mean = F.coalesce(F.avg(F.when(~is_post, observed)), F.lit(1.0))
    return effect, F.coalesce(F.avg(ratio) * 100, percent_of_level(effect, pre_mean))


def effect_summary(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per analysis from points (keys, is_post, observed, counterfactual, cf_lower, cf_upper).

    ``cf_ci_*`` is the mean band of the counterfactual, ``effect_ci_*`` the interval of the effect.
    One aggregate, combined map-side.
    """
    post = F.col("is_post")
    effect, effect_pct = mean_effect(F.col("observed"), F.col("counterfactual"), post)
    se = (F.col("cf_ci_upper") - F.col("cf_ci_lower")) / (2 * Z_975)
    return (
        points.groupBy(*keys)
        .agg(
            effect.alias("effect"),
            effect_pct.alias("effect_pct"),
            F.avg(F.when(post, F.col("cf_lower"))).alias("cf_ci_lower"),
            F.avg(F.when(post, F.col("cf_upper"))).alias("cf_ci_upper"),
            F.count(F.when(~post, 1)).alias("n_pre"),
            F.count(F.when(post, 1)).alias("n_post"),
        )
        .withColumn("effect_ci_lower", F.col("effect") - Z_975 * se)
        .withColumn("effect_ci_upper", F.col("effect") + Z_975 * se)
        .withColumn("p_value", t_test_p(F.col("effect"), se, F.col("n_post") - 1))
        .withColumn("significant", is_significant(F.col("p_value")))
        .withColumn("direction", direction(F.col("effect")))
    )


def pointwise_ci(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Interval and p-value from the spread of the pointwise effects (population sd over sqrt n)."""
    post = F.col("is_post")
    gap = F.when(post, F.col("observed") - F.col("counterfactual"))
    se = F.col("effect_se")
    return (
        points.groupBy(*keys)
        .agg(
            F.avg(gap).alias("effect"),
            (F.stddev_pop(gap) / F.sqrt(F.count(gap))).alias("effect_se"),
            F.count(gap).alias("n_post"),
        )
        .withColumn("effect_ci_lower", F.col("effect") - 1.96 * se)
        .withColumn("effect_ci_upper", F.col("effect") + 1.96 * se)
        .withColumn("p_value", t_test_p(F.col("effect"), se, F.col("n_post") - 1))
    )


LJUNG_BOX_LAGS = 10


def ljung_box(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Ljung-Box test per series over residuals (keys, t, residual), t counting from 0.

    Lags = min(10, n // 5); with fewer than one lag the p-value is 1.  Autocovariances are sums of lag
    products inside bounded blocks, so a long series is spread over many tasks.
    """
    lagged = with_lags(blocks(residuals, keys, LJUNG_BOX_LAGS), keys, LJUNG_BOX_LAGS, "residual")
    # sum (r_t - m)(r_{t-k} - m) expands into products, sums of either side, and the mean.
    sums = lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("residual").alias("total"),
        F.expr("sum(residual * residual) AS p0"),
        *[
            F.expr(expression.format(k=k))
            for k in range(1, LJUNG_BOX_LAGS + 1)
            for expression in (
                "sum(residual * get(lags, {k})) AS p{k}",
                "sum(CASE WHEN get(lags, {k}) IS NOT NULL THEN residual END) AS a{k}",
                "sum(get(lags, {k})) AS b{k}",
            )
        ],
    )
    n = F.col("n")
    mean = F.col("total") / n
    spread = F.col("p0") - n * mean * mean
    n_lags = F.least(F.lit(LJUNG_BOX_LAGS), F.floor(n / 5)).cast("int")
    q = F.expr(" + ".join(
        f"CASE WHEN n_lags < {k} THEN 0D ELSE "
        f"pow((p{k} - mean * (a{k} + b{k}) + (n - {k}) * mean * mean) / variance, 2) / (n - {k}) END"
        for k in range(1, LJUNG_BOX_LAGS + 1)
    ))
    untestable = (F.col("n_lags") < 1) | F.col("variance").isNull()
    return (
        sums.withColumns({
            "n_lags": n_lags, "mean": mean, "variance": F.when(spread > 1e-13 * F.col("p0"), spread),
        })
        .withColumn("q_stat", F.when(~untestable, n * (n + 2) * q))
        .withColumn(
            "ljung_box_pvalue",
            F.when(untestable, 1.0).otherwise(chi2_upper_p(F.col("q_stat"), F.col("n_lags"))),
        )
        .withColumn("residuals_ok", F.col("ljung_box_pvalue") > SIGNIFICANCE_LEVEL)
        .select(*keys, "n", "n_lags", "q_stat", "ljung_box_pvalue", "residuals_ok")
    )
