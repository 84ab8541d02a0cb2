"""Placebo dates: the same analysis at dates where nothing happened, as extra rows of one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.arima import ArimaPlan

# Number of placebo dates, seed, and the margin kept free at both ends of a series.
N_PLACEBOS, SEED, MARGIN = 50, 42, 10
_ROUNDS = 4


def shuffled_position(i: Column, width: Column, key: Column) -> Column:
    """Where a permutation of 0 .. width-1, fixed by the text ``key``, puts position ``i``.

    Four Feistel rounds over a rows x columns rectangle of at least ``width`` cells, whose halves are shifted by digests
    of each other.  A result outside the range is sent through again until it is inside; the rectangle has fewer spare
    cells than columns, so that is rare, and as many tries as there are spare cells are always enough.
    """
    rows = F.ceil(F.sqrt(width)).cast("long")
    columns = F.ceil(width / rows).cast("long")

    def shift(number: Column, half: Column) -> Column:
        return F.conv(F.substring(F.md5(F.concat_ws("|", key, number, half)), 1, 12), 16, 10).cast("long")

    def once(x: Column) -> Column:
        def turn(halves: Column, number: Column) -> Column:
            a, b = halves["a"], halves["b"]
            odd = number % 2 == 1
            return F.struct(
                F.when(odd, F.pmod(a + shift(number, b), rows)).otherwise(a).alias("a"),
                F.when(odd, b).otherwise(F.pmod(b + shift(number, a), columns)).alias("b"),
            )

        start = F.struct(F.floor(x / columns).alias("a"), F.pmod(x, columns).alias("b"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(_ROUNDS)), start, turn, lambda h: h["a"] * columns + h["b"])

    tries = F.sequence(F.lit(0).cast("long"), rows * columns - width)
    first = once(i)
    return F.aggregate(tries, first, lambda x, _: F.when(x < width, x).otherwise(once(x)))


def placebo_indices(
    located: DataFrame, keys: Sequence[str], n_placebos: int | None = N_PLACEBOS, seed: int = SEED
) -> DataFrame:
    """(analysis_id, keys, ..., placebo_idx): distinct indices clear of both ends, fixed by the seed.

    ``n_placebos=None`` takes every index in range, a number the first so many of a permutation of the range whose
    key is seed and series.  Drawn row by row, with no shuffle, at the same cost for any width.
    """
    n = F.col("n")
    fifth = F.floor(n / 5)
    lo = F.greatest(F.lit(MARGIN), fifth)
    hi = F.least(n - MARGIN, n - fifth)  # exclusive
    ranged = located.withColumn("lo", lo).withColumn("width", hi - F.col("lo")).where("width > 0")
    if n_placebos is None:
        drawn = F.sequence(F.col("lo"), F.col("lo") + F.col("width") - 1)
    else:
        key = F.concat_ws("|", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys])
        wanted = F.sequence(F.lit(0).cast("long"), F.least(F.lit(n_placebos), F.col("width")) - 1)
        drawn = F.array_sort(F.transform(wanted, lambda i: F.col("lo") + shuffled_position(i, F.col("width"), key)))
    return ranged.withColumn("placebo_idx", F.explode(drawn)).drop("lo", "width")


def placebo_effects(
    blocked: DataFrame, located: DataFrame, keys: Sequence[str],
    n_placebos: int | None = N_PLACEBOS, seed: int = SEED,
) -> DataFrame:
    """(analysis_id, keys, idx, is_real, effect) of the real and every placebo date.

    All dates of a series are cuts of the same moments: one pass over the data, however many dates.
    """
    ok = located.where(F.col("status") == "ok")
    real = ok.withColumn("is_real", F.lit(True))
    fake = (
        placebo_indices(ok, keys, n_placebos, seed)
        .withColumn("idx", F.col("placebo_idx"))
        .withColumn("n_pre", F.col("placebo_idx"))
        .withColumn("n_post", F.col("n") - F.col("placebo_idx"))
        .withColumn("is_real", F.lit(False))
        .drop("placebo_idx")
    )
    both = real.unionByName(fake).withColumn("of", F.col("analysis_id")).withColumn(
        "analysis_id", F.concat_ws("@", "of", F.when(F.col("is_real"), "real").otherwise(F.col("idx").cast("string")))
    )
    plan = ArimaPlan(blocked, both, keys)
    # The pivot is the mean of the series, so the post mean follows from the pre mean.
    post_mean = (F.col("n") * F.col("pivot") - F.col("n_pre") * F.col("pre_mean")) / F.col("n_post")
    return plan.mean_effects(plan.models()).select(
        F.col("of").alias("analysis_id"), *keys, "idx", "is_real", (post_mean - F.col("forecast_mean")).alias("effect")
    )


def placebo_summary(effects: DataFrame, keys: Sequence[str]) -> DataFrame:
    """p = (1 + number of placebos at least as large) / (1 + number of placebos), per analysis."""
    by = ["analysis_id", *keys]
    size = F.abs("effect")
    real = effects.where("is_real").select(*by, F.col("effect").alias("real_effect"))
    fake = effects.where(~F.col("is_real")).join(real, by).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_placebos"),
        F.count(F.when(size >= F.abs("real_effect"), 1)).alias("n_extreme"),
        F.percentile(size, 0.95).alias("placebo_p95"),
    )
    n, extreme = F.coalesce("n_placebos", F.lit(0)), F.coalesce("n_extreme", F.lit(0))
    return real.join(fake, by, "left").select(
        *by,
        "real_effect",
        n.alias("n_placebos"),
        extreme.alias("n_extreme"),
        "placebo_p95",
        ((extreme + 1) / (n + 1)).alias("p_value"),
        F.coalesce(F.abs("real_effect") > F.col("placebo_p95"), F.lit(False)).alias("is_real_effect_extreme"),
    )


def placebo_histogram(effects: DataFrame, keys: Sequence[str], bins: int = 20) -> DataFrame:
    """(analysis_id, keys, bin, n): equal-width bins, 1-based, from the smallest to the largest placebo effect."""
    by = ["analysis_id", *keys]
    fake = effects.where(~F.col("is_real"))
    ends = fake.groupBy(*by).agg(F.min("effect").alias("lo"), F.max("effect").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.least(
        F.lit(bins), F.floor((F.col("effect") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins) + 1
    )).otherwise(1)
    return fake.join(ends, by).withColumn("bin", bucket.cast("long")).groupBy(*by, "bin").agg(
        F.count(F.lit(1)).alias("n")
    )
