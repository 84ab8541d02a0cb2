"""Report-ready projections of the effects and points tables, and table profiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.quantiles import exact_quantiles_of
from tidemark.operators.series import join_per_key


def format_effect(value: Column) -> Column:
    return F.format_string("%+.2f", value)


def format_effect_pct(value: Column) -> Column:
    return F.format_string("%+.1f%%", value)


def format_p_value(value: Column, decimals: int = 4) -> Column:
    return F.format_string(f"%.{decimals}f", value)


def format_ci(lower: Column, upper: Column) -> Column:
    return F.format_string("[%.2f, %.2f]", lower, upper)


def format_sample_size(n_pre: Column, n_post: Column) -> Column:
    return F.format_string("%d / %d", n_pre.cast("long"), n_post.cast("long"))


def formatted_effects(effects: DataFrame, keys: Sequence[str], lower: str = "cf_ci_lower", upper: str = "cf_ci_upper") -> DataFrame:
    """Display strings of every effect, and a one-line summary."""
    effect, pct = format_effect(F.col("effect")), format_effect_pct(F.col("effect_pct"))
    p, ci = format_p_value(F.col("p_value")), format_ci(F.col(lower), F.col(upper))
    return effects.select(
        *keys,
        effect.alias("effect_text"),
        pct.alias("effect_pct_text"),
        p.alias("p_value_text"),
        ci.alias("ci_text"),
        format_sample_size(F.col("n_pre"), F.col("n_post")).alias("sample_text"),
        F.concat(F.lit("Effect: "), effect, F.lit(" ("), pct, F.lit("), 95% CI "), ci, F.lit(", p="), p).alias("summary"),
    )


def effect_summary_text(
    effects: DataFrame, keys: Sequence[str], metric: str = "the metric", lower: str = "cf_ci_lower",
    upper: str = "cf_ci_upper",
) -> DataFrame:
    """A sentence for readers: what the intervention did, or that nothing significant was seen."""
    p = format_p_value(F.col("p_value"))
    # Fixed wording of the two sentences.
    found = F.concat(
        F.lit("The intervention caused a **"), format_effect_pct(F.abs("effect_pct")), F.lit(" "), F.col("direction"),
        F.lit(f"** in {metric} (95% CI "), format_ci(F.col(lower), F.col(upper)), F.lit(", p="), p,
        F.lit("). This effect is **statistically significant**."),
    )
    not_found = F.concat(
        F.lit(f"The intervention did not produce a statistically significant effect on {metric} (p="), p,
        F.lit("). The observed change ("), F.col("direction"), F.lit(") may be due to random variation."),
    )
    return effects.select(*keys, F.when(F.col("significant"), found).otherwise(not_found).alias("text"))


def effect_narrative(
    effects: DataFrame, keys: Sequence[str], metric: str, on: str = "intervention_date", lower: str = "cf_ci_lower",
    upper: str = "cf_ci_upper",
) -> DataFrame:
    """The finding with its statistics, one line per item."""
    verb = F.when(F.col("direction") == "increase", "increased").otherwise("decreased")
    # Fixed wording of the narrative.
    finding = F.when(
        F.col("significant"),
        F.concat(
            F.lit(f"The {metric} **"), verb, F.lit(" by "), F.format_string("%.1f%%", F.abs("effect_pct")),
            F.lit("** compared to what would have happened without the intervention."),
        ),
    ).otherwise(
        F.concat(
            F.lit(f"The observed change in {metric} ("), F.col("direction"), F.lit(" of "),
            F.format_string("%.2f", F.abs("effect")), F.lit(") **was not statistically significant** (p="),
            format_p_value(F.col("p_value")), F.lit(")."),
        )
    )
    doubt = F.when(
        ~F.col("residuals_ok"),
        "\n\n**Note:** Residual diagnostics suggest the model fit may not be ideal. "
        "Consider trying a different method or intervention date.",
    ).otherwise("")
    text = F.concat(
        F.lit("**On "), F.col(on), F.lit("**, an intervention was applied.\n\n"), finding,
        F.lit("\n\n**Statistical details:**\n"),
        F.format_string("- Effect size: %+.4f (%+.1f%%)\n", F.col("effect"), F.col("effect_pct")),
        F.format_string("- 95%% confidence interval: [%.4f, %.4f]\n", F.col(lower), F.col(upper)),
        F.format_string("- p-value: %.4f ", F.col("p_value")),
        F.when(F.col("significant"), "(significant)\n").otherwise("(not significant)\n"),
        F.format_string("- Sample: %d pre-intervention, %d post-intervention points", F.col("n_pre"), F.col("n_post")),
        F.coalesce(doubt, F.lit("")),
    )
    return effects.select(*keys, text.alias("narrative"))


def chart_points(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """What a chart draws: observed, fitted before, counterfactual and band after, the intervention mark."""
    post = F.col("is_post")
    first_post = points.where(post).groupBy(*keys).agg(F.min("ts").alias("intervention"))
    return join_per_key(points, first_post, keys).select(
        *keys,
        "ts",
        "observed",
        F.when(~post, F.col("counterfactual")).alias("fitted_pre"),
        F.when(post, F.col("counterfactual")).alias("counterfactual_post"),
        F.when(post, F.col("cf_lower")).alias("band_lower"),
        F.when(post, F.col("cf_upper")).alias("band_upper"),
        (F.col("ts") == F.col("intervention")).alias("is_intervention"),
    )


def pointwise_effect(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    effect = F.col("observed") - F.col("counterfactual")
    return points.select(*keys, "ts", effect.alias("effect"), (effect >= 0).alias("is_positive"))


def series_profile(df: DataFrame, keys: Sequence[str], ts: str, y: str) -> DataFrame:
    """Rows, date range, mean and sample standard deviation of the metric."""
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
        F.avg(y).alias("mean"),
        F.stddev_samp(y).alias("sd"),
    )


def describe_table(df: DataFrame) -> DataFrame:
    """One row per numeric column: count, mean, std, min, exact quartiles, max."""
    numeric = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    one_row = df.agg(*[
        F.expr(
            f"struct('{c}' AS column_name, count(`{c}`) AS count, avg(`{c}`) AS mean, stddev_samp(`{c}`) AS std, "
            f"double(min(`{c}`)) AS min, double(max(`{c}`)) AS max) AS c{i}"
        )
        for i, c in enumerate(numeric)
    ])
    basics = one_row.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(numeric))])))
    quartiles = exact_quantiles_of(df, [], numeric, [0.25, 0.5, 0.75])
    return basics.join(quartiles.drop("n"), "column_name", "left").select(
        "column_name", "count", "mean", "std", "min", F.col("q0").alias("p25"), F.col("q1").alias("p50"),
        F.col("q2").alias("p75"), "max",
    )


def table_fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): the same for the same rows in any order or partitioning, and on any engine with MD5.

    A row is its values as text, each after its length so that none runs into the next, and ``-`` for a null; an instant is
    its microseconds, so the time zone of the session plays no part.  The first 60 bits of the rows' hashes are summed,
    which is combined map-side.
    """

    def told(c: str) -> Column:
        value = F.col(f"`{c}`")
        text = (F.unix_micros(value) if dict(df.dtypes)[c] == "timestamp" else value).cast("string")
        return F.coalesce(F.concat(F.length(text), F.lit(":"), text), F.lit("-"))

    row_hash = F.conv(F.substring(F.md5(F.concat(*map(told, df.columns)).cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(row_hash), F.lit(0)).cast("string").alias("fingerprint"))
