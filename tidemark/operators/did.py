"""Difference-in-differences over long panels.

The saturated regression y ~ 1 + treated + post + treated x post is fixed by the four cell means, so
everything comes from per-cell counts, means and squared deviations.  Rows are first reduced to one
moment row per unit and date, which absorbs hot units before anything is shuffled twice.  The cells of a
table of analyses are sums before their dates, over their unit and over all units, found by sorting moment
rows and analyses together: any number of analyses costs one pass, and controls are what is left.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.stats import t_quantile_975, t_two_sided_p
from tidemark.operators.asof import sums_before
from tidemark.operators.inference import direction, is_significant, percent_of_level
from tidemark.session import checkpointed

# A panel analysis: (analysis_id, treated unit, intervention date).
PanelSpec = tuple[str, str, str]

CELLS = ("treated_pre", "treated_post", "control_pre", "control_post")


def panel_moments(panel: DataFrame, unit: str, ts: str, y: str, keep: Sequence[str] = ()) -> DataFrame:
    """(keep, unit, ts, n, mean, m2): count, mean and sum of squared deviations per unit and date."""
    value = F.col(y).cast("double")
    rows = panel.select(*keep, F.col(unit).cast("string").alias("unit"), F.col(ts).cast("timestamp").alias("ts"),
                        value.alias("y")).where(F.col("y").isNotNull() & ~F.isnan("y"))
    return rows.groupBy(*keep, "unit", "ts").agg(
        F.count(F.lit(1)).alias("n"), F.avg("y").alias("mean"), (F.var_pop("y") * F.count(F.lit(1))).alias("m2")
    )


def attach_panel_specs(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """Pairs panel rows with analyses: a spec table is joined on the columns it shares with the panel."""
    if isinstance(specs, DataFrame):
        shared = [c for c in specs.columns if c in panel.columns]
        if not shared:
            raise ValueError("the spec table shares no column with the panel; give a list of triples instead")
        return panel.join(specs, shared)
    literal = F.array(*[
        F.struct(
            F.lit(name).alias("analysis_id"),
            F.lit(str(unit)).alias("treatment_unit"),
            F.lit(str(at)).cast("timestamp").alias("intervention_ts"),
        )
        for name, unit, at in specs
    ])
    return panel.withColumn("spec", F.explode(literal)).select(*panel.columns, "spec.*")


def spec_rows(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """(analysis_id, treatment_unit, intervention_ts), one row for each analysis."""
    if not isinstance(specs, DataFrame):
        listed = [(str(name), str(unit), str(at)) for name, unit, at in specs]
        specs = panel.sparkSession.createDataFrame(listed, "analysis_id string, treatment_unit string, intervention_ts string")
    return specs.select("analysis_id", F.col("treatment_unit").cast("string").alias("treatment_unit"), F.col("intervention_ts").cast("timestamp").alias("intervention_ts"))


def spec_sums(rows: DataFrame, specs: DataFrame | Sequence[PanelSpec], sums: Sequence[str]) -> DataFrame:
    """Per analysis, for each of its four cells (treated_pre, ..., control_post), a struct of sums over the rows (unit, ts, sums).

    A short list is summed as it stands, with no shuffle of rows; a table of analyses is sorted together with the rows.
    """
    if not isinstance(specs, DataFrame):
        treated, post = F.col("unit") == F.col("treatment_unit"), F.col("ts") >= F.col("intervention_ts")
        where = {"treated_pre": treated & ~post, "treated_post": treated & post, "control_pre": ~treated & ~post, "control_post": ~treated & post}
        return attach_panel_specs(rows, specs).groupBy("analysis_id").agg(*[
            F.struct(*[F.coalesce(F.sum(F.when(inside, F.col(s))), F.lit(0)).alias(s) for s in sums]).alias(name) for name, inside in where.items()
        ])
    day = F.floor(F.unix_micros("ts") / 86_400_000_000)
    cuts = spec_rows(rows, specs).select("analysis_id", F.col("treatment_unit").alias("unit"), F.col("intervention_ts").alias("ts"))
    of_unit = sums_before(rows, cuts, ["unit"], "ts", sums, day).select(
        "analysis_id", F.col("before").alias("unit_before"), F.col("whole").alias("unit_whole"))
    dates = rows.groupBy("ts").agg(*[F.sum(s).alias(s) for s in sums])
    of_all = sums_before(dates, cuts.drop("unit"), [], "ts", sums, day)

    def cell(name: str, value) -> Column:
        def known(struct: str, s: str) -> Column:
            return F.coalesce(F.col(f"{struct}.{s}"), F.lit(0))

        return F.struct(*[value(lambda struct, s=s: known(struct, s)).alias(s) for s in sums]).alias(name)

    return of_all.join(of_unit, "analysis_id").select(
        "analysis_id",
        cell("treated_pre", lambda of: of("unit_before")),
        cell("treated_post", lambda of: of("unit_whole") - of("unit_before")),
        cell("control_pre", lambda of: of("before") - of("unit_before")),
        cell("control_post", lambda of: of("whole") - of("before") - of("unit_whole") + of("unit_before")),
    )


def spec_check(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """(analysis_id, status): ok, unknown_unit, no_control, or no rows on one side of the date."""
    counts = spec_sums(panel.select("unit", "ts", F.lit(1).cast("long").alias("n")), specs, ["n"])
    return status_of(counts.select("analysis_id", *[F.col(f"{c}.n").alias(f"n_{c}") for c in CELLS]))


def status_of(means: DataFrame) -> DataFrame:
    """(analysis_id, status) from the numbers of rows in the cells."""
    pre, post = F.col("n_treated_pre"), F.col("n_treated_post")
    return means.select(
        "analysis_id",
        F.when(pre + post == 0, "unknown_unit")
        .when(F.col("n_control_pre") + F.col("n_control_post") == 0, "no_control")
        .when(pre == 0, "no_pre_rows")
        .when(post == 0, "no_post_rows")
        .otherwise("ok")
        .alias("status"),
    )


def design(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """Panel rows with ``treated``, ``post`` and their product, per analysis (exact date comparison)."""
    return (
        attach_panel_specs(panel, specs)
        .withColumn("treated", (F.col("unit") == F.col("treatment_unit")).cast("long"))
        .withColumn("post", (F.col("ts") >= F.col("intervention_ts")).cast("long"))
        .withColumn("treated_x_post", F.col("treated") * F.col("post"))
    )


def _pooled(moments: DataFrame, value: Column) -> Column:
    """Mean over all rows behind the moments; sums taken about it do not cancel."""
    return moments.agg(F.sum(F.col("n") * value) / F.sum("n")).scalar()


def _centred(moments: DataFrame) -> DataFrame:
    """Moment rows as sums about the pooled mean and the mean day: (unit, ts, n, y, yy, d, dd, dy)."""
    day = F.unix_micros("ts") / 86_400_000_000.0
    about = moments.withColumns({"y": F.col("mean") - _pooled(moments, F.col("mean")), "d": day - _pooled(moments, day)})
    n, y, d = F.col("n"), F.col("y"), F.col("d")
    return about.select(
        "unit", "ts", "n", (n * y).alias("y"), (F.col("m2") + n * y * y).alias("yy"), (n * d).alias("d"), (n * d * d).alias("dd"), (n * d * y).alias("dy"))


def _about_mean(cell: str, product: str, a: str, b: str) -> Column:
    """Sum of products of deviations from the means of a cell; null without rows."""
    n = F.col(f"{cell}.n")
    return F.when(n > 0, F.col(f"{cell}.{product}") - F.col(f"{cell}.{a}") * F.col(f"{cell}.{b}") / n)


def cell_means(moments: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """One row per analysis: the four cell means and counts, pooled squared error."""
    sums = spec_sums(_centred(moments).select("unit", "ts", "n", "y", "yy"), specs, ["n", "y", "yy"])
    sums = sums.withColumn("centre", _pooled(moments, F.col("mean")))
    errors = [F.coalesce(_about_mean(c, "yy", "y", "y"), F.lit(0.0)) for c in CELLS]
    # written, as it is one row for each analysis and intervals and p-values refer to its columns hundreds of times
    return checkpointed(sums.select(
        "analysis_id",
        *[F.when(F.col(f"{c}.n") > 0, F.col("centre") + F.col(f"{c}.y") / F.col(f"{c}.n")).alias(f"{c}_mean") for c in CELLS],
        *[F.col(f"{c}.n").alias(f"n_{c}") for c in CELLS],
        (errors[0] + errors[1] + errors[2] + errors[3]).alias("sse"),
    ))


def did_effects(moments: DataFrame, specs: DataFrame | Sequence[PanelSpec], means: DataFrame | None = None) -> DataFrame:
    """Effect, interval and p-value of the interaction, one row per analysis; ``means`` if ``cell_means`` is known already."""
    counts = [F.col(f"n_{c}") for c in CELLS]
    total = counts[0] + counts[1] + counts[2] + counts[3]
    inverse = sum((1 / F.when(n > 0, n) for n in counts[1:]), 1 / F.when(counts[0] > 0, counts[0]))
    df = F.when(total > 4, total - 4)
    effect = (F.col("treated_post_mean") - F.col("treated_pre_mean")) - (
        F.col("control_post_mean") - F.col("control_pre_mean")
    )
    se, half = F.col("effect_se"), F.col("effect_se") * F.col("t_quantile")
    return (
        (cell_means(moments, specs) if means is None else means)
        .withColumn("effect", effect)
        .withColumn("effect_pct", percent_of_level(F.col("effect"), F.col("treated_pre_mean")))
        .withColumn("df_resid", df)
        .withColumn("effect_se", F.sqrt(F.col("sse") / df * inverse))
        .withColumn("t_quantile", t_quantile_975(F.col("df_resid")))
        .withColumn("effect_ci_lower", F.col("effect") - half)
        .withColumn("effect_ci_upper", F.col("effect") + half)
        .withColumn("p_value", t_two_sided_p(F.col("effect") / F.when(se > 0, se), F.col("df_resid")))
        .withColumn("significant", is_significant(F.col("p_value")))
        .withColumn("direction", direction(F.col("effect")))
        .withColumn("n_treated", F.col("n_treated_pre") + F.col("n_treated_post"))
        .withColumn("n_control", F.col("n_control_pre") + F.col("n_control_post"))
    )


def on_every_date(dates: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """The rows (ts unique) once for each analysis; a table of analyses is joined to them by the number of the date."""
    if not isinstance(specs, DataFrame):
        return attach_panel_specs(dates, specs)
    numbered = dates.withColumn("date_no", F.row_number().over(Window.orderBy("ts")))
    count = dates.agg(F.count(F.lit(1)).cast("int").alias("last")).first()["last"]
    if not count:
        return numbered.drop("date_no").join(spec_rows(dates, specs), F.lit(False))
    asked = spec_rows(dates, specs).withColumn("date_no", F.explode(F.sequence(F.lit(1), F.lit(count))))
    return asked.join(numbered, "date_no").drop("date_no")


def did_points(moments: DataFrame, specs: DataFrame | Sequence[PanelSpec], means: DataFrame | None = None) -> DataFrame:
    """Per date: the treated value, and what it would have been had it moved with the controls.

    A date without the treated unit has no observed value, one without controls no counterfactual
    after the intervention.
    """
    dates = moments.groupBy("ts").agg(F.sum("n").alias("all_n"), F.sum(F.col("n") * F.col("mean")).alias("all_y"))
    own = moments.select(F.col("unit").alias("treatment_unit"), "ts", "n", "mean")
    n = F.col("all_n") - F.coalesce("n", F.lit(0))
    control = (F.col("all_y") - F.coalesce(F.col("n") * F.col("mean"), F.lit(0.0))) / F.when(n > 0, n)
    by_date = on_every_date(dates, specs).join(own, ["treatment_unit", "ts"], "left").select(
        "analysis_id", "ts", (F.col("ts") >= F.col("intervention_ts")).cast("long").alias("post"), F.col("mean").alias("observed"),
        control.alias("control_mean"))
    shift = (cell_means(moments, specs) if means is None else means).select(
        "analysis_id", (F.col("treated_pre_mean") - F.col("control_pre_mean")).alias("shift")
    )
    is_post = F.col("post") == 1
    counterfactual = F.when(is_post, F.col("control_mean") + F.col("shift")).otherwise(
        F.coalesce("observed", "control_mean")
    )
    return by_date.join(shift, "analysis_id").select(
        "analysis_id", "ts", is_post.alias("is_post"), "observed", counterfactual.alias("counterfactual")
    ).withColumn("effect", F.col("observed") - F.col("counterfactual"))


def parallel_trends(moments: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """Test of a differential slope before the intervention: y ~ 1 + treated + t + treated x t.

    t is in days.  Saturated in ``treated``, so the model is one simple regression per group: each
    group's slope and squared error come from a handful of sums.
    """
    sums = spec_sums(_centred(moments), specs, ["n", "y", "yy", "d", "dd", "dy"])
    sides = ("treated_pre", "control_pre")
    for c in sides:
        sxx, sxy, syy = (_about_mean(c, *of) for of in (("dd", "d", "d"), ("dy", "d", "y"), ("yy", "y", "y")))
        sxx = F.when(sxx > 0, sxx)
        sums = sums.withColumns({f"{c}_slope": sxy / sxx, f"{c}_sse": syy - sxy * sxy / sxx, f"{c}_inverse": 1 / sxx})

    def both(name: str) -> Column:
        a, b = (F.col(f"{c}_{name}") for c in sides)
        return F.coalesce(a + b, a, b)

    both = checkpointed(sums.select(
        "analysis_id", (F.col("treated_pre_slope") - F.col("control_pre_slope")).alias("slope_difference"),
        both("sse").alias("sse"), both("inverse").alias("inverse"), (F.col("treated_pre.n") + F.col("control_pre.n")).alias("n_pre_rows")))
    df = F.when(F.col("n_pre_rows") > 4, F.col("n_pre_rows") - 4)
    se = F.sqrt(F.col("sse") / df * F.col("inverse"))
    return both.withColumn("slope_se", se).select(
        "analysis_id", "n_pre_rows", "slope_difference", "slope_se",
        t_two_sided_p(F.col("slope_difference") / F.when(F.col("slope_se") > 0, F.col("slope_se")), df)
        .alias("parallel_trends_p"),
    )
