"""Synthetic control: a weighted mix of donors that follows the treated unit before the intervention.

Weights match the whole pre path.  Finding them is the nearest point to the origin in the hull of
(donor path - treated path).  Only a handful of donors end up with weight, so the search keeps a small
working set per analysis and prices all donors against it in one distributed pass per round; it stops
when no donor anywhere can improve the fit.  No pairs of donors are ever formed outside that set, and the
set is pruned to the donors with weight before others enter, so it is bounded however long the search.

Panels have gaps.  The dates of an analysis are those on which its treated unit reports before the
intervention; a donor that lacks one of them is left out and counted, so a late or sparse donor costs the
others nothing.  Every unit's path is stored once, however many analyses use it.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.simplex import hull_weights
from tidemark.operators.did import PanelSpec, attach_panel_specs, spec_check, spec_rows
from tidemark.operators.inference import direction, is_significant, percent_of_level, t_test_p
from tidemark.session import checkpointed

WORKING_SET = 64
MAX_ROUNDS = 1_000
_ANALYSES_IN_BLOCK = 1_024
_TOLERANCE = 1e-9
_DOUBLES = T.ArrayType(T.DoubleType())


def sc_panel(panel: DataFrame, unit: str, ts: str, y: str) -> DataFrame:
    """(unit, ts, y): the mean per unit and date, kept long."""
    value = F.col(y).cast("double")
    return (
        panel.select(F.col(unit).cast("string").alias("unit"), F.col(ts).cast("timestamp").alias("ts"), value.alias("y"))
        .where(F.col("y").isNotNull() & ~F.isnan("y"))
        .groupBy("unit", "ts")
        .agg(F.avg("y").alias("y"))
    )


def complete_dates(panel: DataFrame) -> DataFrame:
    """Dates on which every unit of the panel reports."""
    n_units = panel.agg(F.count_distinct("unit")).scalar()
    return panel.groupBy("ts").agg(F.count(F.lit(1)).alias("n_reporting")).where(F.col("n_reporting") == n_units).select("ts")


def donor_products(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """Cross-products of each donor with the treated unit over complete pre dates, and both squares."""
    rows = attach_panel_specs(panel.join(complete_dates(panel), "ts"), specs).where("ts < intervention_ts")
    treated = rows.where("unit = treatment_unit").select("analysis_id", "ts", F.col("y").alias("y1"))
    donors = rows.where("unit <> treatment_unit").select("analysis_id", "unit", "ts", "y")
    return donors.join(treated, ["analysis_id", "ts"]).groupBy("analysis_id", "unit").agg(
        F.count(F.lit(1)).alias("n_dates"),
        F.sum(F.col("y") * F.col("y1")).alias("cross"),
        F.sum(F.col("y") * F.col("y")).alias("donor_square"),
        F.sum(F.col("y1") * F.col("y1")).alias("treated_square"),
    )


@F.pandas_udf(_DOUBLES)
def _dense(numbers: pd.Series, values: pd.Series, length: pd.Series) -> pd.Series:
    """Values by the number of their date, null (NaN on the way) on dates without one."""
    out = []
    for at, y, n in zip(numbers, values, length, strict=True):
        path = np.full(n, np.nan)
        path[np.asarray(at, int)] = y
        out.append(path)
    return pd.Series(out)


def unit_paths(panel: DataFrame) -> DataFrame:
    """(unit, path): one row for each unit, its values on all dates of the panel in order."""
    number = F.row_number().over(Window.orderBy("ts")) - 1  # dates at the grain of the panel, not rows
    dates = panel.select("ts").distinct().withColumn("no", number)
    count = dates.agg(F.count(F.lit(1)).cast("int")).scalar()
    listed = panel.join(dates, "ts").groupBy("unit").agg(F.collect_list("no").alias("no"), F.collect_list("y").alias("y"))
    return listed.withColumn("length", count).select("unit", _dense("no", "y", "length").alias("path"))


def _targets(panel: DataFrame, paths: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """(analysis_id, treatment_unit, target): the treated path up to the intervention."""
    asked = spec_rows(panel, specs)
    # the number of dates before each intervention: dates and interventions sorted together
    dates = panel.select("ts").distinct().withColumn("date", F.lit(1))
    cuts = asked.select(F.col("intervention_ts").alias("ts")).distinct().withColumn("date", F.lit(0))
    before = F.sum("date").over(Window.orderBy("ts", "date").rowsBetween(Window.unboundedPreceding, 0)).cast("int")
    counted = dates.unionByName(cuts).withColumn("n_before", before).where("date = 0").select(F.col("ts").alias("intervention_ts"), "n_before")
    own = paths.select(F.col("unit").alias("treatment_unit"), "path")
    return asked.join(counted, "intervention_ts").join(own, "treatment_unit").select(
        "analysis_id", "treatment_unit", F.slice("path", F.lit(1), F.col("n_before")).alias("target"))


def _pairs(paths: DataFrame, targets: DataFrame) -> DataFrame:
    """(analysis_id, unit, path, target): every donor with every analysis it is asked for, in blocks of analyses."""
    ids = targets.select("analysis_id", "treatment_unit", F.pmod(F.xxhash64("analysis_id"), F.lit(_ANALYSES_IN_BLOCK)).alias("block"))
    blocks = ids.groupBy("block").agg(F.collect_list(F.struct("analysis_id", "treatment_unit")).alias("asked")).drop("block")
    both = paths.crossJoin(blocks).select("unit", "path", F.explode("asked").alias("asked"))
    both = both.where(F.col("unit") != F.col("asked.treatment_unit")).select("asked.analysis_id", "unit", "path")
    return both.join(targets.select("analysis_id", "target"), "analysis_id")


def _gaps_of(path: np.ndarray, target: np.ndarray) -> np.ndarray | None:
    """Donor minus treated on the dates of the analysis; null if the donor lacks one, or there are none."""
    known = ~np.isnan(target)
    gaps = path[: len(target)][known] - target[known]
    return None if np.isnan(gaps).any() or not len(gaps) else gaps


@F.pandas_udf(_DOUBLES)
def _gaps(path: pd.Series, target: pd.Series) -> pd.Series:
    return pd.Series([_gaps_of(np.asarray(p, float), np.asarray(t, float)) for p, t in zip(path, target, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("price", T.DoubleType()), T.StructField("size", T.DoubleType())]))
def _price(path: pd.Series, target: pd.Series, mix: pd.Series) -> pd.DataFrame:
    """Product of a donor's gaps with the mix (with themselves, before there is one), and their own square."""
    out = []
    for p, t, m in zip(path, target, mix, strict=True):
        gaps = _gaps_of(np.asarray(p, float), np.asarray(t, float))
        out.append((None, None) if gaps is None else (gaps @ (gaps if m is None else np.asarray(m, float)), gaps @ gaps))
    return pd.DataFrame(out, columns=["price", "size"], dtype=float)


def _solve(group: pd.DataFrame) -> pd.DataFrame:
    gaps = np.stack([np.asarray(g, float) for g in group["gaps"]])
    weights, settled = hull_weights(gaps)
    held = weights > 0
    return pd.DataFrame({
        "analysis_id": group["analysis_id"][held],
        "unit": group["unit"][held],
        "gaps": group["gaps"][held],
        "weight": weights[held],
        "mix": [weights @ gaps] * int(held.sum()),
        "settled": settled,
    })


_SOLVED = "analysis_id string, unit string, gaps array<double>, weight double, mix array<double>, settled boolean"


def sc_donors(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """(analysis_id, n_dates, n_donors, n_donors_dropped): dates of the fit, donors that report on all of them, and others."""
    paths = unit_paths(panel)
    pairs = _pairs(paths, _targets(panel, paths, specs)).withColumn("gaps", _gaps("path", "target"))
    known = F.size(F.filter("target", lambda v: v.isNotNull())).cast("long")
    return pairs.groupBy("analysis_id").agg(
        F.max(known).alias("n_dates"), F.count("gaps").alias("n_donors"), F.count(F.when(F.col("gaps").isNull(), 1)).alias("n_donors_dropped"))


def sc_fits(
    panel: DataFrame, specs: DataFrame | Sequence[PanelSpec], working_set: int = WORKING_SET, max_rounds: int = MAX_ROUNDS
) -> DataFrame:
    """(analysis_id, unit, weight, converged) for donors with weight.  ``panel`` is (unit, ts, y), one row per pair.

    ``converged``: no donor can improve the fit any more.  An analysis without a donor on all its dates has no rows.
    """
    paths = checkpointed(unit_paths(panel))
    targets = checkpointed(_targets(panel, paths, specs))
    pairs = _pairs(paths, targets)
    nearest = Window.partitionBy("analysis_id").orderBy("price", "unit")

    def cheapest(priced: DataFrame) -> DataFrame:
        # row_number() <= k is pruned in every task before the shuffle
        ranked = priced.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= working_set)
        return ranked.select("analysis_id", "unit", _gaps("path", "target").alias("gaps"))

    mix = F.lit(None).cast(_DOUBLES)
    first = pairs.withColumn("at", _price("path", "target", mix)).withColumn("price", F.col("at.price")).where("price IS NOT NULL")
    working, rounds = cheapest(first), 0
    while True:
        solved = checkpointed(working.groupBy("analysis_id").applyInPandas(_solve, _SOLVED))
        mixes = solved.groupBy("analysis_id").agg(F.first("mix").alias("mix"))
        norm = F.aggregate("mix", F.lit(0.0), lambda a, v: a + v * v)
        priced = pairs.join(mixes, "analysis_id").withColumn("at", _price("path", "target", "mix")).withColumn("price", F.col("at.price"))
        better = F.col("price") < norm - _TOLERANCE * F.greatest(norm, F.col("at.size"))
        held = solved.select("analysis_id", "unit")
        entering = checkpointed(cheapest(priced.where(better).join(held, ["analysis_id", "unit"], "left_anti")))
        rounds += 1
        if rounds >= max_rounds or entering.isEmpty():
            open_ = entering.select("analysis_id").distinct().withColumn("open", F.lit(True))
            out = solved.join(open_, "analysis_id", "left")
            return out.select("analysis_id", "unit", "weight", (F.col("open").isNull() & F.col("settled")).alias("converged"))
        working = solved.select("analysis_id", "unit", "gaps").unionByName(entering)


def sc_weights(panel: DataFrame, specs: DataFrame | Sequence[PanelSpec], working_set: int = WORKING_SET) -> DataFrame:
    """(analysis_id, unit, weight) for donors with weight."""
    return sc_fits(panel, specs, working_set).drop("converged")


def sc_status(panel: DataFrame, weights: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """(analysis_id, status): that of the panel, or no_overlap where no donor reports on all dates of the treated unit."""
    fitted = weights.select("analysis_id").distinct().withColumn("fitted", F.lit(True))
    status = F.when((F.col("status") == "ok") & F.col("fitted").isNull(), "no_overlap").otherwise(F.col("status"))
    return spec_check(panel, specs).join(fitted, "analysis_id", "left").select("analysis_id", status.alias("status"))


def sc_points(panel: DataFrame, weights: DataFrame, specs: DataFrame | Sequence[PanelSpec]) -> DataFrame:
    """Observed and synthetic value per analysis and date; null where a weighted donor has no value."""
    held = weights.groupBy("analysis_id").agg(F.count(F.lit(1)).alias("n_held"))
    mixed = (
        panel.join(weights, "unit")
        .groupBy("analysis_id", "ts")
        .agg(F.sum(F.col("weight") * F.col("y")).alias("mixed"), F.count(F.lit(1)).alias("n_present"))
        .join(held, "analysis_id")
        .select("analysis_id", "ts", F.when(F.col("n_present") == F.col("n_held"), F.col("mixed")).alias("counterfactual"))
    )
    treated = panel.join(spec_rows(panel, specs).withColumnRenamed("treatment_unit", "unit"), "unit").select(
        "analysis_id", "ts", (F.col("ts") >= F.col("intervention_ts")).alias("is_post"), F.col("y").alias("observed")
    )
    return treated.join(mixed, ["analysis_id", "ts"], "left").withColumn(
        "effect", F.col("observed") - F.col("counterfactual")
    )


def sc_effects(points: DataFrame) -> DataFrame:
    """Effect, interval, p-value, and fit before and after, one row per analysis."""
    post = F.col("is_post")
    gap = F.col("effect")
    known = gap.isNotNull()
    summary = points.groupBy("analysis_id").agg(
        F.avg(F.when(post, gap)).alias("effect"),
        F.stddev_samp(F.when(post, gap)).alias("sd"),
        F.avg(F.when(~post & known, F.col("observed"))).alias("pre_mean"),
        F.sqrt(F.avg(F.when(~post, gap * gap))).alias("pre_rmspe"),
        F.sqrt(F.avg(F.when(post, gap * gap))).alias("post_rmspe"),
        F.count(F.when(~post & known, 1)).alias("n_pre"),
        F.count(F.when(post & known, 1)).alias("n_post"),
    )
    se = F.when(F.col("n_post") > 1, F.col("sd") / F.sqrt("n_post")).otherwise(0.0)
    return (
        summary.withColumn("effect_se", se)
        .withColumn("rmspe_ratio", F.when(F.col("pre_rmspe") > 0, F.col("post_rmspe") / F.col("pre_rmspe")).otherwise(0.0))
        .withColumn("effect_pct", percent_of_level(F.col("effect"), F.col("pre_mean")))
        .withColumn("effect_ci_lower", F.col("effect") - 1.96 * F.col("effect_se"))
        .withColumn("effect_ci_upper", F.col("effect") + 1.96 * F.col("effect_se"))
        .withColumn("p_value", t_test_p(F.col("effect"), F.col("effect_se"), F.col("n_post") - 1))
        .withColumn("significant", is_significant(F.col("p_value")))
        .withColumn("direction", direction(F.col("effect")))
        .drop("sd")
    )


def weights_map(weights: DataFrame) -> DataFrame:
    """(analysis_id, unit_weights): only donors that carry weight, of which there are few."""
    return weights.groupBy("analysis_id").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("unit", "weight")))).alias("unit_weights")
    )
