"""Local-level structural model: y_t = level_t + noise, level_t = level_(t-1) + shock.

The ratio q = var(shock) / var(noise) is chosen by likelihood over a fixed grid.  The filter runs inside
bounded blocks as a fold.  Its output is affine in the level that enters the block, and the filter
variance at a block start has a closed form, so blocks are folded independently; an associative scan
of their affine maps links them, for any ratio from 0 on.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.stats import Z_975
from tidemark.operators.inference import effect_summary
from tidemark.operators.series import BLOCK_ROWS, own_rows, per_block
from tidemark.session import checkpointed

# The grid of ratios, in half decades.
RATIOS = tuple(10.0 ** (k / 2) for k in range(-8, 5))


def _variance_entering(q: Column, steps: Column) -> Column:
    """Filter variance after ``steps`` updates from 1, relative to the noise.

    P -> (P + q) / (P + q + 1) is a Moebius map; between its fixed points it only scales.  The logarithm of the scale is
    kept, as the scale itself is too close to 1 for small ratios.  Without shocks the variance falls as 1 / (1 + steps).
    """
    root = F.sqrt(q * q + 4 * q)
    stable, other = 2 * q / (root + q), -(root + q) / 2
    scale = F.coalesce(F.log1p(-stable), F.lit(float("-inf"))) - F.log1p(-other) - 2 * steps * F.log1p(stable + q)
    return F.when(q > 0, other - root / F.expm1(scale)).otherwise(1 / (1 + steps))


def _fold(values: Column, q: Column, first: Column) -> Column:
    """Filter a block.  The level is u + v * (level entering); errors are split the same way."""
    start = F.struct(
        F.when(first, F.get(values, F.lit(0))).otherwise(0.0).alias("u"),
        F.when(first, 0.0).otherwise(1.0).alias("v"),
        F.when(first, 1.0).otherwise(_variance_entering(q, F.col("t0") - 1)).alias("P"),
        *[F.lit(0.0).alias(name) for name in ("uu", "uv", "vv", "logs")],
    )

    def update(acc: Column, y: Column) -> Column:
        spread = acc["P"] + q + 1
        gain = (acc["P"] + q) / spread
        eu, ev = y - acc["u"], -acc["v"]
        return F.struct(
            (acc["u"] + gain * eu).alias("u"),
            (acc["v"] + gain * ev).alias("v"),
            gain.alias("P"),
            (acc["uu"] + eu * eu / spread).alias("uu"),
            (acc["uv"] + eu * ev / spread).alias("uv"),
            (acc["vv"] + ev * ev / spread).alias("vv"),
            (acc["logs"] + F.log(spread)).alias("logs"),
        )

    rest = F.when(first, F.slice(values, F.lit(2), F.greatest(F.size(values) - 1, F.lit(0)))).otherwise(values)
    return F.aggregate(rest, start, update)


def gains(ratio: float, entering: float, steps: int) -> np.ndarray:
    """Gain of every step when the variance that enters is ``entering`` (relative to the noise)."""
    k = np.arange(1, steps + 1)
    if ratio == 0:
        return 1 / (1 / entering + k)
    root = np.sqrt(ratio * ratio + 4 * ratio)
    stable, other = 2 * ratio / (root + ratio), -(root + ratio) / 2
    fall = 2 * k * np.log1p(stable + ratio)
    if entering > stable:
        return other - root / np.expm1(np.log1p(-root / (entering - other)) - fall)
    return other + root / (1 + (stable - entering) / (entering - other) * np.exp(-fall))


def one_step(values: np.ndarray, ratio: float, level: float, entering: float) -> np.ndarray:
    """Predictions one step ahead.  Every step is an affine map of the level; their compositions from the start are
    found by doubling, so a block of n values takes log2(n) vector operations."""
    gain = gains(ratio, entering, len(values))
    keep, add, reach = 1 - gain, gain * values, 1
    while reach < len(values):
        add[reach:] = add[reach:] + keep[reach:] * add[:-reach]
        keep[reach:] = keep[reach:] * keep[:-reach]
        reach *= 2
    after = keep * level + add
    return np.concatenate([[level], after[:-1]])


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _one_step(values: pd.Series, q: pd.Series, level: pd.Series, variance: pd.Series) -> pd.Series:
    return pd.Series([one_step(np.asarray(v, float), *rest) for v, *rest in zip(values, q, level, variance, strict=True)])


class LocalLevelPlan:
    """Fits, points and effects of the local-level model for prepared series (``series.prepare``)."""

    def __init__(self, blocked: DataFrame, located: DataFrame, keys: Sequence[str], ratios: Sequence[float] = RATIOS):
        self.keys = list(keys)
        self.by = ["analysis_id", *self.keys]
        self.located = checkpointed(located.where(F.col("status") == "ok"))
        self.ratios = list(ratios)
        self.rows = own_rows(blocked)

    def _pre_blocks(self, extra: Sequence[str] = (), analyses: DataFrame | None = None) -> DataFrame:
        """(by, block, t0, values): the pre values of each block, at most ``BLOCK_ROWS`` of them."""
        analyses = self.located if analyses is None else analyses
        pre = per_block(analyses.select(*self.by, "idx", "n_pre", *extra), "n_pre")
        return (
            self.rows.join(pre, [*self.keys, "block"])
            .where(F.col("t") < F.col("idx"))
            .groupBy(*self.by, "block", "n_pre", *extra)
            .agg(F.array_sort(F.collect_list(F.struct("t", "y"))).alias("rows"))
            .withColumn("t0", F.col("block") * BLOCK_ROWS)
            .withColumn("values", F.transform("rows", lambda r: r["y"]))
            .drop("rows")
        )

    def _filtered(self) -> DataFrame:
        """Per block and ratio: the fold, and the level that enters the block.

        A block is an affine map of the level.  The maps are composed from the first block on by doubling: after k rounds
        each row holds the composition of its last 2^k blocks, so rounds grow with the logarithm of the blocks.
        """
        ratios = F.array(*[F.lit(float(q)) for q in self.ratios])
        first = F.col("block") == 0
        folds = F.transform(ratios, lambda q: F.struct(q.alias("q"), _fold(F.col("values"), q, first).alias("f")))
        folded = self._pre_blocks().select(*self.by, "n_pre", "block", F.explode(folds).alias("at"))
        folded = folded.select(*self.by, "n_pre", "block", "at.q", "at.f.*")
        order = Window.partitionBy(*self.by, "q").orderBy("block")
        longest = self.located.agg(F.max("n_pre")).first()[0] or 0
        folded, reach = folded.withColumns({"keep": F.col("v"), "add": F.col("u")}), 1
        while reach * BLOCK_ROWS < longest:
            keep, add = F.lag("keep", reach, 1.0).over(order), F.lag("add", reach, 0.0).over(order)
            folded = folded.withColumns({"keep": F.col("keep") * keep, "add": F.col("add") + F.col("keep") * add})
            reach *= 2
        return folded.withColumn("entering", F.lag("add", 1, 0.0).over(order)).drop("keep", "add")

    def models(self) -> DataFrame:
        """(by, q, level, P, sigma2, loglik, fit_status): the ratio with the highest likelihood per analysis."""
        level_in = F.col("entering")
        sse = F.col("uu") + 2 * F.col("uv") * level_in + F.col("vv") * level_in * level_in
        tried = (
            self._filtered()
            .groupBy(*self.by, "n_pre", "q")
            .agg(
                F.sum(sse).alias("sse"),
                F.sum("logs").alias("logs"),
                F.max_by(F.col("u") + F.col("v") * level_in, "block").alias("level"),
                F.max_by("P", "block").alias("P"),
            )
        )
        m = F.col("n_pre") - 1
        sigma2 = F.greatest(F.col("sse"), F.lit(0.0)) / m
        flat = sigma2 <= 0
        loglik = F.when(~flat, -0.5 * (m * (F.log(2 * math.pi * F.when(~flat, sigma2)) + 1) + F.col("logs")))
        scored = tried.withColumn("sigma2", sigma2).withColumn("loglik", loglik)
        best = F.max_by(
            F.struct("q", "level", "P", "sigma2", "loglik"),
            F.struct(F.coalesce("loglik", F.lit(float("inf"))), -F.col("q")),
        )
        chosen = scored.groupBy(*self.by).agg(best.alias("m")).select(*self.by, "m.*")
        chosen = chosen.withColumn("fit_status", F.when(F.col("level").isNull(), "fit_failed").otherwise("ok"))
        return checkpointed(chosen.join(self.located.select(*self.by, "idx", "n", "n_pre", "n_post"), self.by))

    def points(self, models: DataFrame) -> DataFrame:
        """Every row: one-step predictions before, the last level and its widening band after."""
        chosen = models.select(*self.by, "q")
        entering = self._filtered().join(chosen, [*self.by, "q"]).select(*self.by, "block", "q", "entering")
        first = F.col("block") == 0
        fitted = (
            self._pre_blocks()
            .join(entering, [*self.by, "block"])
            .withColumn("level", F.when(first, F.get("values", F.lit(0))).otherwise(F.col("entering")))
            # at the very first value nothing is known; a huge prior variance makes the level equal it
            .withColumn("P", F.when(first, 1e15).otherwise(_variance_entering(F.col("q"), F.col("t0") - 1)))
            .withColumn("fitted", _one_step("values", "q", "level", "P"))
            .select(*self.by, "t0", F.posexplode("fitted").alias("pos", "fitted"))
            .select(*self.by, (F.col("t0") + F.col("pos")).alias("t"), "fitted")
        )
        pre = self.rows.select(*self.keys, "t", "ts", "y").join(fitted, [*self.keys, "t"]).select(
            *self.by, "t", "ts", F.lit(False).alias("is_post"), F.col("y").alias("observed"), "fitted",
            F.col("fitted").alias("counterfactual"), F.lit(None).cast("double").alias("cf_lower"),
            F.lit(None).cast("double").alias("cf_upper"),
        )
        h = F.col("t") - F.col("idx") + 1
        half = Z_975 * F.sqrt(F.col("sigma2") * (F.col("P") + h * F.col("q") + 1))
        post = (
            self.rows.join(per_block(models, "n"), [*self.keys, "block"])
            .where(F.col("t") >= F.col("idx"))
            .select(
                *self.by, "t", "ts", F.lit(True).alias("is_post"), F.col("y").alias("observed"),
                F.col("level").alias("fitted"), F.col("level").alias("counterfactual"),
                (F.col("level") - half).alias("cf_lower"), (F.col("level") + half).alias("cf_upper"),
            )
        )
        return pre.unionByName(post).withColumn("effect", F.col("observed") - F.col("counterfactual"))

    def effects(self, models: DataFrame, points: DataFrame) -> DataFrame:
        fits = models.select(*self.by, F.col("q").alias("signal_ratio"), F.col("level").alias("last_level"))
        return effect_summary(points, self.by).join(fits, self.by)
