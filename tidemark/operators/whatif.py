"""What-if scenarios: shift or rotate the counterfactual and see whether the finding holds."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stats import Z_975, Z_ROUNDED
from tidemark.operators.inference import is_significant, mean_effect, t_test_p
from tidemark.operators.series import join_per_key


class Scenario(NamedTuple):
    """Slope and level in percent of the pre mean, interval level in percent."""

    name: str
    slope_pct: float = 0.0
    level_pct: float = 0.0
    ci_level: int = 95


def whatif_points(points: DataFrame, keys: Sequence[str], scenarios: Sequence[Scenario]) -> DataFrame:
    """Points of every scenario; after the intervention the counterfactual is ramped and shifted.

    The scenarios travel inside the expression, so rows fan out without a join.
    """
    post = F.col("is_post")
    facts = points.groupBy(*keys).agg(
        F.avg(F.when(~post, F.col("observed"))).alias("pre_mean"),
        F.min(F.when(post, F.col("t"))).alias("first_post"),
        F.count(F.when(post, 1)).alias("n_post"),
    )
    listed = F.array(*[
        F.struct(
            F.lit(s.name).alias("scenario"),
            F.lit(float(s.slope_pct)).alias("slope_pct"),
            F.lit(float(s.level_pct)).alias("level_pct"),
            F.lit(int(s.ci_level)).alias("ci_level"),
            F.lit(Z_ROUNDED.get(s.ci_level, Z_ROUNDED[95])).alias("multiplier"),
        )
        for s in scenarios
    ])
    step = F.when(F.col("n_post") > 1, (F.col("t") - F.col("first_post")) / (F.col("n_post") - 1)).otherwise(0.0)
    ramp = step * F.col("slope_pct") / 100 * F.col("pre_mean") * 0.5
    shift = F.col("level_pct") / 100 * F.col("pre_mean")
    return (
        join_per_key(points, facts, keys)
        .withColumn("s", F.explode(listed))
        .select("*", "s.*")
        .withColumn(
            "adjusted",
            F.when(post, F.col("counterfactual") + ramp + shift).otherwise(F.col("counterfactual")),
        )
        .select(*keys, "scenario", "t", "ts", "is_post", "observed", "counterfactual", "adjusted", "cf_lower",
                "cf_upper", "slope_pct", "level_pct", "ci_level", "multiplier")
    )


def whatif_effects(adjusted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effect, interval and p-value of every scenario, and whether it turns the original verdict."""
    by = [*keys, "scenario"]
    post = F.col("is_post")
    effect, effect_pct = mean_effect(F.col("observed"), F.col("adjusted"), post)
    original, _ = mean_effect(F.col("observed"), F.col("counterfactual"), post)
    width = F.avg(F.when(post, F.col("cf_upper"))) - F.avg(F.when(post, F.col("cf_lower")))
    df = F.col("n_post") - 1
    se = F.col("se")
    changed = (F.col("slope_pct") != 0) | (F.col("level_pct") != 0) | (F.col("ci_level") != 95)
    return (
        adjusted.groupBy(*by, "slope_pct", "level_pct", "ci_level", "multiplier")
        .agg(
            effect.alias("effect"),
            effect_pct.alias("effect_pct"),
            original.alias("original_effect"),
            (width / (2 * Z_ROUNDED[95])).alias("se"),
            F.count(F.when(post, 1)).alias("n_post"),
        )
        .withColumn("ci_lower", F.col("effect") - F.col("multiplier") * se)
        .withColumn("ci_upper", F.col("effect") + F.col("multiplier") * se)
        .withColumn("p_value", t_test_p(F.col("effect"), se, df))
        .withColumn("significant", is_significant(F.col("p_value")))
        .withColumn("original_significant", is_significant(t_test_p(F.col("original_effect"), se * (Z_ROUNDED[95] / Z_975), df)))
        .withColumn(
            "note",
            F.when(~changed | (F.col("significant") == F.col("original_significant")), "")
            .when(F.col("significant"), "The adjusted counterfactual makes the effect statistically significant.")
            .otherwise("The adjusted counterfactual makes the effect NOT statistically significant."),
        )
    )
