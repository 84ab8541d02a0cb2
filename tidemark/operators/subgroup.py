"""Effects by segment: the segment is one more key of the series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.arima import ArimaPlan
from tidemark.operators.quantiles import exact_quantiles
from tidemark.operators.series import (
    MIN_SERIES_LENGTH, index_series, join_per_key, locate_interventions, own_rows, prepare, to_series,
)
from tidemark.operators.structural import LocalLevelPlan

# Smallest segment that is analysed, and the labels of the value bins.
MIN_SEGMENT_SIZE = MIN_SERIES_LENGTH
QUARTILE_LABELS = ("Q1 (Low)", "Q2", "Q3", "Q4 (High)")
WIDTH_LABELS = ("Q1", "Q2", "Q3", "Q4")
_METHODS = {
    "arima": lambda s, loc, keys: ArimaPlan(s, loc, keys),
    "sarimax": lambda s, loc, keys: ArimaPlan(s, loc, keys, seasonal=True),
    "bsts": lambda s, loc, keys: LocalLevelPlan(s, loc, keys),
}


def segment_calendar(df: DataFrame, ts: str, by: str) -> DataFrame:
    """Adds ``segment``: 2020Q1, 2020-01 or the weekday name."""
    at = F.col(ts)
    names = {
        "quarter": F.concat(F.year(at), F.lit("Q"), F.quarter(at)),
        "month": F.date_format(at, "yyyy-MM"),
        "weekday": F.date_format(at, "EEEE"),
    }
    if by not in names:
        raise ValueError(f"Unknown segment_by: {by}")
    return df.withColumn("segment", names[by])


def segment_value_bin(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """Adds ``segment``: quartile of the value, or one of four equal widths where quartiles coincide."""
    keys = list(keys)
    edges = exact_quantiles(df, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0]).drop("n")
    v = F.col(value)
    distinct = F.size(F.array_distinct(F.array(*[F.col(f"q{i}") for i in range(5)]))) == 5
    by_rank = F.when(v <= F.col("q1"), QUARTILE_LABELS[0]).when(v <= F.col("q2"), QUARTILE_LABELS[1]).when(
        v <= F.col("q3"), QUARTILE_LABELS[2]).otherwise(QUARTILE_LABELS[3])
    step = (F.col("q4") - F.col("q0")) / 4
    by_width = F.when(F.col("q4") == F.col("q0"), WIDTH_LABELS[1])
    for i in range(3):
        by_width = by_width.when(v <= F.col("q0") + (i + 1) * step, WIDTH_LABELS[i])
    segment = F.when(v.isNotNull(), F.when(distinct, by_rank).otherwise(by_width.otherwise(WIDTH_LABELS[3])))
    if keys:
        joined = join_per_key(df, edges, keys)
    else:
        row = edges.first()
        joined = df.select("*", *[F.lit(row[f"q{i}"]).alias(f"q{i}") for i in range(5)])
    return joined.select(*df.columns, segment.alias("segment"))


def segment_rows(df: DataFrame, ts: str, value: str, by: str, keys: Sequence[str] = ()) -> DataFrame:
    return segment_value_bin(df, value, keys) if by == "value_bin" else segment_calendar(df, ts, by)


def segment_sizes(segmented: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, segment, n_points, status): segments under 30 rows are labelled, not lost."""
    return segmented.where(F.col("segment").isNotNull()).groupBy(*keys, "segment").agg(
        F.count(F.lit(1)).alias("n_points")
    ).withColumn("status", F.when(F.col("n_points") < MIN_SEGMENT_SIZE, "too_small").otherwise("ok"))


def subgroup_effects(
    df: DataFrame, keys: Sequence[str], ts: str, y: str, specs: DataFrame | Sequence[tuple[str, str]], by: str,
    method: str = "arima", grain: str | None = None,
) -> DataFrame:
    """One row per analysis, key and segment, with a status where no effect can be given.

    Sort by ``abs(effect)`` at the sink if an order is wanted.
    """
    if method not in _METHODS:
        raise ValueError(f"Unknown method: {method}")
    inner = [*keys, "segment"]
    outer = ["analysis_id", *inner]
    segmented = segment_rows(df, ts, y, by, keys)
    sizes = segment_sizes(segmented, keys)
    blocked = prepare(index_series(to_series(segmented, inner, ts, y, grain), inner, grain), inner)
    located = locate_interventions(own_rows(blocked), inner, specs).join(
        sizes.select(*inner, "n_points", F.col("status").alias("size_status")), inner
    ).withColumn("status", F.when(F.col("size_status") != "ok", F.col("size_status")).otherwise(F.col("status"))).drop(
        "size_status"
    )
    plan = _METHODS[method](blocked, located, inner)
    models = plan.models()
    effects = plan.effects(models, plan.points(models)).select(
        *outer, "effect", "effect_pct", "cf_ci_lower", "cf_ci_upper", "effect_ci_lower", "effect_ci_upper", "p_value",
        "significant",
    )
    fits = models.select(*outer, "fit_status")
    status = F.when((F.col("status") == "ok") & (F.col("fit_status") != "ok"), F.col("fit_status")).otherwise(F.col("status"))
    joined = located.select(*outer, "n_points", "status").join(fits, outer, "left").withColumn("status", status)
    return joined.drop("fit_status").join(effects, outer, "left")
