"""From a long table and analyses to one table of effects and one of points, whatever the method.

Analyses are a short list or a table of any size.  Inside, the key column has a name of its own and is text, so it may be
called anything; analyses, statuses and results are joined by it.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import detect
from tidemark.operators.arima import ArimaPlan
from tidemark.operators.did import cell_means, did_effects, did_points, panel_moments, parallel_trends, status_of
from tidemark.operators.series import index_series, locate_interventions, observed, own_rows, prepare, to_series
from tidemark.operators.structural import LocalLevelPlan
from tidemark.operators.synth import sc_donors, sc_effects, sc_fits, sc_panel, sc_points, sc_status, weights_map
from tidemark.session import checkpointed

# The names of the methods.
SERIES_METHODS = ("arima", "bsts", "sarimax")
PANEL_METHODS = ("did", "synthetic_control")
METHODS = (*SERIES_METHODS, *PANEL_METHODS)
KEY = "_k0"


class Analysis(NamedTuple):
    """One question: did the metric of every series (or of one unit of the panel) change at this date?"""

    analysis_id: str
    intervention_ts: str
    method: str = "arima"
    treatment_unit: str | None = None


EFFECT_COLUMNS = {
    "effect": "double", "effect_pct": "double", "cf_ci_lower": "double", "cf_ci_upper": "double",
    "effect_ci_lower": "double", "effect_ci_upper": "double", "p_value": "double", "significant": "boolean",
    "direction": "string", "n_pre": "bigint", "n_post": "bigint", "arima_order": "array<int>",
    "seasonal_order": "array<int>", "aic": "double", "ljung_box_pvalue": "double", "residuals_ok": "boolean",
    "parallel_trends_p": "double", "rmspe_ratio": "double", "unit_weights": "map<string,double>",
}

#: Further columns of the effects, on request: what the panel methods know besides.
DETAIL_COLUMNS = {
    "treated_pre_mean": "double", "treated_post_mean": "double", "control_pre_mean": "double", "control_post_mean": "double",
    "n_treated": "bigint", "n_control": "bigint", "pre_rmspe": "double", "post_rmspe": "double", "n_donors": "bigint",
    "n_donors_dropped": "bigint", "converged": "boolean",
}

POINT_COLUMNS = {
    "ts": "timestamp", "is_post": "boolean", "observed": "double", "counterfactual": "double", "cf_lower": "double",
    "cf_upper": "double", "effect": "double",
}


def check_analyses(analyses: Sequence[Analysis]) -> None:
    for a in analyses:
        if a.method not in METHODS:
            raise ValueError(f"Unknown method: {a.method}")
        if a.method in PANEL_METHODS and a.treatment_unit is None:
            raise ValueError(f"Analysis {a.analysis_id}: method {a.method} requires a treatment_unit.")


class Results(NamedTuple):
    effects: DataFrame
    points: DataFrame


def _unified(table: DataFrame, method: str, key: str, columns: dict[str, str], *more: str) -> DataFrame:
    made = [(F.col(name) if name in table.columns else F.lit(None)).cast(kind).alias(name) for name, kind in columns.items()]
    return table.select("analysis_id", F.col(key).alias("series_key"), F.lit(method).alias("method"), *more, *made)


def _series_results(blocked: DataFrame, specs: DataFrame | Sequence[tuple[str, str]], method: str) -> Results:
    located = checkpointed(locate_interventions(own_rows(blocked), [KEY], specs))
    plan = LocalLevelPlan(blocked, located, [KEY]) if method == "bsts" else ArimaPlan(blocked, located, [KEY], seasonal=method == "sarimax")
    models = plan.models()
    points = plan.points(models)
    effects = plan.effects(models, points).drop("n_pre", "n_post")
    by = ["analysis_id", KEY]
    joined = located.select(*by, "status", "n_pre", "n_post").join(models.select(*by, "fit_status"), by, "left").join(effects, by, "left")
    status = F.when((F.col("status") == "ok") & (F.col("fit_status") != "ok"), F.col("fit_status")).otherwise(F.col("status"))
    if isinstance(specs, DataFrame):  # analyses of series that do not exist, or of no date
        joined = specs.join(joined, by, "left")
        status = F.when(F.col("intervention_ts").isNull(), "no_date").when(F.col("status").isNull(), "unknown_series").otherwise(status)
    return Results(
        _unified(joined.withColumn("status", status), method, KEY, EFFECT_COLUMNS | DETAIL_COLUMNS, "status"),
        _unified(points, method, KEY, POINT_COLUMNS),
    )


def _panel_results(rows: DataFrame, specs: DataFrame | Sequence[tuple[str, str, str]], units: DataFrame, method: str) -> Results:
    """``units``: (analysis_id, treatment_unit), for analyses without a result too."""
    if method == "did":
        moments = checkpointed(panel_moments(rows, KEY, "ts", "y"))
        trends = parallel_trends(moments, specs).select("analysis_id", "parallel_trends_p")
        means = cell_means(moments, specs)
        effects = did_effects(moments, specs, means).join(trends, "analysis_id", "left").withColumns(
            {"n_pre": F.col("n_treated_pre"), "n_post": F.col("n_treated_post")}
        )
        checks, points = status_of(means), did_points(moments, specs, means)
    else:
        panel = checkpointed(sc_panel(rows, KEY, "ts", "y"))
        fits = checkpointed(sc_fits(panel, specs))
        weights = fits.drop("converged")
        checks, points = sc_status(panel, weights, specs), sc_points(panel, weights, specs)
        settled = fits.groupBy("analysis_id").agg(F.every("converged").alias("converged"))
        effects = sc_effects(points).join(weights_map(weights), "analysis_id", "left").join(settled, "analysis_id", "left")
        checks = checks.join(sc_donors(panel, specs), "analysis_id", "left")
    usable = checks.where("status = 'ok'").select("analysis_id")
    joined = units.join(checks, "analysis_id").join(effects.join(usable, "analysis_id", "left_semi"), "analysis_id", "left")
    drawn = points.join(usable, "analysis_id", "left_semi").join(units, "analysis_id")
    return Results(
        _unified(joined, method, "treatment_unit", EFFECT_COLUMNS | DETAIL_COLUMNS, "status"), _unified(drawn, method, "treatment_unit", POINT_COLUMNS),
    )


def _table_of(analyses: DataFrame, key: str) -> DataFrame:
    """(analysis_id, method, unit, intervention_ts) from a table with analysis_id, intervention_ts and, where they apply,
    method, treatment_unit and a column named like the key of the rows."""
    def first_of(*names: str):
        return F.coalesce(*[F.col(f"`{n}`").cast("string") for n in names if n in analyses.columns], F.lit(None).cast("string"))

    at = F.col("intervention_ts") if detect.is_time(analyses.schema["intervention_ts"].dataType) else detect.parse_timestamp(F.col("intervention_ts").cast("string"))
    method = F.coalesce("method", F.lit("arima")) if "method" in analyses.columns else F.lit("arima")
    unit = F.when(method.isin(*PANEL_METHODS), first_of("treatment_unit", key)).otherwise(first_of(key, "treatment_unit"))
    return analyses.select(F.col("analysis_id").cast("string").alias("analysis_id"), method.alias("method"), unit.alias("unit"), at.cast("timestamp").alias("intervention_ts"))


def _refused(specs: DataFrame, status: str) -> DataFrame:
    named = specs.select("analysis_id", F.col("unit").alias("series_key"), "method", F.lit(status).alias("status"))
    return named.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in (EFFECT_COLUMNS | DETAIL_COLUMNS).items()])


def causal_results(
    rows: DataFrame, key: str, ts: str | None, y: str | None, analyses: Sequence[Analysis] | DataFrame, grain: str | None = None
) -> Results:
    """Effects and points of all analyses over one long table: one plan per method, put together by name.

    ``key`` names the series for the single-series methods and the unit for the panel methods.  Without ``ts`` or ``y``,
    or where the table has no such column, the first column that reads as dates and the first other that reads as
    numbers are taken.

    ``analyses`` is a list, whose single-series analyses concern every series, or a table (analysis_id, intervention_ts
    and, where they apply, method, treatment_unit and a column named like ``key``), of which each row concerns the series
    or unit it names.  Ids are unique per method and unit; those of a panel method are unique.  Every row of the table
    has a row among the effects, whose status says why there is none: unknown_method, no_unit, no_date, unknown_series
    and those of the methods.
    """
    if ts not in rows.columns or y not in rows.columns:
        ts, y = detect.validate_table(rows.drop(key))
    stamp, value = observed(rows, ts, y)
    rows = rows.select(F.col(f"`{key}`").cast("string").alias(KEY), stamp.alias("ts"), value.alias("y"))
    cut = rows if grain is None else rows.withColumn("ts", F.date_trunc(grain, "ts"))
    cut = cut.dropna()
    parts: list[Results] = []
    refused: list[DataFrame] = []
    if isinstance(analyses, DataFrame):
        specs = checkpointed(_table_of(analyses, key))
        present = {r["method"] for r in specs.where(F.col("method").isin(*METHODS)).select("method").distinct().collect()}
        refused = [_refused(specs.where(~F.col("method").isin(*METHODS)), "unknown_method")]
        without = F.col("method").isin(*METHODS) & F.col("unit").isNull()
        refused.append(_refused(specs.where(without), "no_unit"))
        specs = specs.where(F.col("unit").isNotNull())
        refused.append(_refused(specs.where(F.col("method").isin(*PANEL_METHODS) & F.col("intervention_ts").isNull()), "no_date"))

        def of(method: str):
            chosen = specs.where(F.col("method") == method)
            if method in SERIES_METHODS:
                return chosen.select("analysis_id", F.col("unit").alias(KEY), "intervention_ts")
            return chosen.where(F.col("intervention_ts").isNotNull()).select("analysis_id", F.col("unit").alias("treatment_unit"), "intervention_ts")
    else:
        check_analyses(analyses)
        present = {a.method for a in analyses}

        def of(method: str):
            chosen = [a for a in analyses if a.method == method]
            if method in SERIES_METHODS:
                return [(a.analysis_id, a.intervention_ts) for a in chosen]
            return [(a.analysis_id, a.treatment_unit, a.intervention_ts) for a in chosen]

    if present & set(SERIES_METHODS):
        blocked = prepare(index_series(to_series(rows, [KEY], "ts", "y", grain), [KEY], grain), [KEY])
    for method in METHODS:
        if method in present and method in SERIES_METHODS:
            parts.append(_series_results(blocked, of(method), method))
        elif method in present:
            specs_of = of(method)
            units = specs_of.select("analysis_id", "treatment_unit") if isinstance(specs_of, DataFrame) else rows.sparkSession.createDataFrame(
                [(a, str(u)) for a, u, _ in specs_of], "analysis_id string, treatment_unit string")
            parts.append(_panel_results(cut, specs_of, units, method))
    effects = [p.effects for p in parts] + refused
    if not parts:
        shape = ", ".join(f"{n} {k}" for n, k in {"analysis_id": "string", "series_key": "string", "method": "string", **POINT_COLUMNS}.items())
        parts = [Results(refused[0] if refused else None, rows.sparkSession.createDataFrame([], shape))]
    return Results(reduce(DataFrame.unionByName, effects), reduce(DataFrame.unionByName, [p.points for p in parts]))


def causal_effects(
    rows: DataFrame, key: str, ts: str | None, y: str | None, analyses: Sequence[Analysis] | DataFrame, grain: str | None = None,
    details: bool = False,
) -> DataFrame:
    """The effects of ``causal_results``; ``details`` adds the cell means, sizes and fits of the panel methods."""
    effects = causal_results(rows, key, ts, y, analyses, grain).effects
    return effects if details else effects.drop(*DETAIL_COLUMNS)


def causal_points(
    rows: DataFrame, key: str, ts: str | None, y: str | None, analyses: Sequence[Analysis] | DataFrame, grain: str | None = None
) -> DataFrame:
    """The points of ``causal_results``: observed and counterfactual values of every analysis that has an effect."""
    return causal_results(rows, key, ts, y, analyses, grain).points
