"""Exact, linearly interpolated quantiles of groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task.  Here a bounded sketch first
brackets each quantile; values below a bracket are counted where they lie, and only the few inside are
shuffled and ranked.  A group small enough for one task is ranked whole.

A bracket is never trusted: the values picked must make up the whole of a quantile.  Where they do not,
because the sketch was off by more than it promises, the groups in question are done again with wider
brackets, up to the whole range.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.series import join_per_key
from tidemark.session import checkpointed

_ACCURACY = 20_000
_MARGIN = 3 / _ACCURACY  # the sketch is off by at most 1 / accuracy in rank
_SMALL = 4 / _MARGIN  # up to this many rows a group is ranked whole
_WHOLE = -1
_WIDEN = 8


def exact_quantiles_of(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float]
) -> DataFrame:
    """(keys, column_name, n, q0, q1, ...) for several columns, all read in the same passes.

    A pass is repeated only for the groups whose brackets turned out to miss their quantiles.
    """
    out, margin, todo = [], _MARGIN, df
    while True:
        tried = checkpointed(_bracketed(todo, keys, columns, probs, margin))
        whole = tried.where("whole").drop("whole")
        missed = tried.where("NOT whole").select(*keys, F.lit(True).alias("_missed")).distinct()
        if missed.isEmpty():
            return reduce(DataFrame.unionByName, out, whole)
        # a group is done again with all its columns, so its other rows are left out here
        out.append(join_per_key(whole, missed, keys, "left").where("_missed IS NULL").drop("_missed"))
        todo, margin = join_per_key(todo, missed, keys).drop("_missed"), margin * _WIDEN


def _bracketed(df: DataFrame, keys: Sequence[str], columns: Sequence[str], probs: Sequence[float], margin: float) -> DataFrame:
    """The quantiles from brackets of ``margin`` in rank on either side, and whether their values were all inside (``whole``)."""
    keys = list(keys)
    cells = [(c, i) for c in range(len(columns)) for i in range(len(probs))]
    values = df.select(*keys, *[F.col(f"`{name}`").cast("double").alias(f"v{c}") for c, name in enumerate(columns)])
    bounds = [max(0.0, p - margin) for p in probs] + [min(1.0, p + margin) for p in probs]
    sketch = checkpointed(values.groupBy(*keys).agg(*[
        column
        for c in range(len(columns))
        for column in (F.count(f"v{c}").alias(f"n{c}"), F.percentile_approx(f"v{c}", bounds, _ACCURACY).alias(f"b{c}"))
    ]))
    # At the ends the bracket is open: a sketch may miss the extreme values themselves.
    brackets = sketch.select(
        *keys,
        *[f"n{c}" for c in range(len(columns))],
        *[F.expr(f"n{c} <= {_SMALL} AS small{c}") for c in range(len(columns))],
        *[(F.lit(float("-inf")) if probs[i] <= margin else F.get(f"b{c}", F.lit(i))).alias(f"lo{c}_{i}") for c, i in cells],
        *[(F.lit(float("inf")) if probs[i] >= 1 - margin else F.get(f"b{c}", F.lit(len(probs) + i))).alias(f"hi{c}_{i}")
          for c, i in cells],
    )
    placed = join_per_key(values, brackets, keys)
    below = placed.groupBy(*keys).agg(
        *[F.expr(f"count_if(v{c} < lo{c}_{i}) AS below{c}_{i}") for c, i in cells],
        *[F.expr(f"count_if(lo{c}_{i} = hi{c}_{i} AND v{c} = lo{c}_{i}) AS equal{c}_{i}") for c, i in cells],
    )

    def held(c: int) -> DataFrame:
        """Values of one column inside a bracket that is not settled yet, with the bracket they are in."""
        marks = ", ".join(
            f"CASE WHEN NOT small{c} AND lo{c}_{i} < hi{c}_{i} AND v{c} BETWEEN lo{c}_{i} AND hi{c}_{i} THEN {i} END"
            for i in range(len(probs))
        )
        return placed.where(f"v{c} IS NOT NULL").select(
            *keys, F.lit(c).alias("c"), F.col(f"v{c}").alias("v"),
            F.explode(F.expr(f"CASE WHEN small{c} THEN array({_WHOLE}) ELSE array_compact(array({marks})) END")).alias("i"),
        )

    # One branch per column: each reads that column only.
    inside = reduce(DataFrame.unionByName, [held(c) for c in range(len(columns))]).groupBy(*keys, "c", "i", "v").agg(
        F.count(F.lit(1)).alias("count")
    )
    running = Window.partitionBy(*keys, "c", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    # A bracket that is a single value is the quantile already, if it holds the ranks asked for; the others start empty.
    def tied(c: int, i: int) -> str:
        at = f"{float(probs[i])!r}D * (n{c} - 1)"
        return (f"CASE WHEN NOT small{c} AND lo{c}_{i} = hi{c}_{i} AND floor({at}) >= below{c}_{i} "
                f"AND ceil({at}) < below{c}_{i} + equal{c}_{i} THEN lo{c}_{i} END")

    facts = F.array(*[
        F.struct(
            F.lit(c).alias("c"), F.lit(name).alias("column_name"), F.col(f"n{c}").alias("n"),
            F.array(*[F.expr(tied(c, i)) for i in range(len(probs))]).alias("tied"),
            F.array(*[F.col(f"below{c}_{i}") for i in range(len(probs))]).alias("belows"),
        )
        for c, name in enumerate(columns)
    ])
    known = join_per_key(brackets, below, keys).select(*keys, F.inline(facts))
    asked = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(p)).alias("p")) for i, p in enumerate(probs)])
    ranked = (
        join_per_key(inside.withColumn("upto", F.sum("count").over(running)), known, [*keys, "c"])
        .withColumn("of", F.explode(F.filter(asked, lambda a: (F.col("i") == _WHOLE) | (a["i"] == F.col("i")))))
        .withColumn("below", F.when(F.col("i") == _WHOLE, 0).otherwise(F.get("belows", F.col("i"))))
    )
    at = F.col("of.p") * (F.col("n") - 1)
    last = F.col("below") + F.col("upto") - 1
    first = last - F.col("count") + 1  # the 0-based ranks a value holds are first .. last
    # A quantile is a weighted pair of neighbours; each value contributes its share.
    floor, ceil = F.floor(at), F.ceil(at)
    share = F.when(floor.between(first, last), 1 - (at - floor)).otherwise(0.0) + F.when(
        (ceil > floor) & ceil.between(first, last), at - floor
    ).otherwise(0.0)
    picked = (
        ranked.select(*keys, "c", F.col("of.i").alias("i"), (F.col("v") * share).alias("part"), share.alias("share"))
        .where("share > 0")
        .groupBy(*keys, "c")
        .agg(
            *[F.sum(F.when(F.col("i") == i, F.col("part"))).alias(f"ranked{i}") for i in range(len(probs))],
            *[F.sum(F.when(F.col("i") == i, F.col("share"))).alias(f"share{i}") for i in range(len(probs))],
        )
    )
    inside = [F.coalesce(F.abs(F.col(f"share{i}") - 1) < 1e-9, F.get("tied", F.lit(i)).isNotNull()) for i in range(len(probs))]
    whole = reduce(lambda a, b: a & b, inside, F.lit(True)) | (F.col("n") == 0)
    return join_per_key(known, picked, [*keys, "c"], "left").select(
        *keys, "column_name", "n",
        *[F.coalesce(f"ranked{i}", F.get("tied", F.lit(i))).alias(f"q{i}") for i in range(len(probs))], whole.alias("whole"),
    )


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float]) -> DataFrame:
    """(keys, n, q0, q1, ...): one column per probability, as pandas' default interpolation gives them."""
    return exact_quantiles_of(df, keys, [value], probs).drop("column_name")
