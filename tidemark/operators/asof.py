"""As-of matches of two tables in time: both are sorted together, so the cost is that of rows plus cuts, never their product.

A key may hold any share of the rows.  Rows are sorted inside bounded buckets; what lies before a bucket comes from one
row for each bucket and key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sums_before(
    rows: DataFrame, cuts: DataFrame, by: Sequence[str], at: str, sums: Sequence[str], bucket: Column
) -> DataFrame:
    """``cuts`` with ``before`` and ``whole``: structs of the sums of rows with the same ``by`` and an ``at`` smaller than
    the cut's, and of all rows with the same ``by``; null where there are none.

    ``bucket`` is a function of ``at`` that never falls; rows of one bucket and key are sorted in one task.
    """
    kept = [c for c in cuts.columns if c not in (*by, at)]
    cut = F.struct(*kept) if kept else F.struct(F.lit(1).alias("cut"))
    shape = cuts.select(*by, at, cut.alias("_cut")).schema["_cut"].dataType
    both = rows.select(*by, at, F.lit(None).cast(shape).alias("_cut"), *sums).unionAll(
        cuts.select(*by, at, cut.alias("_cut"), *[F.lit(None).cast(rows.schema[s].dataType).alias(s) for s in sums])
    ).withColumn("_bucket", bucket)
    key = [*by, "_bucket"]
    inside = Window.partitionBy(*key).orderBy(at, F.col("_cut").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    marked = both.select(*key, at, "_cut", F.struct(*[F.sum(s).over(inside).alias(s) for s in sums]).alias("_near")).where("_cut IS NOT NULL")
    earlier = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    everywhere = Window.partitionBy(*by)
    buckets = both.groupBy(*key).agg(*[F.sum(s).alias(s) for s in sums]).select(
        *key, F.struct(*[F.sum(s).over(earlier).alias(s) for s in sums]).alias("_far"),
        F.struct(*[F.sum(s).over(everywhere).alias(s) for s in sums]).alias("whole"),
    )

    def added(name: str) -> Column:
        near, far = F.col(f"_near.{name}"), F.col(f"_far.{name}")
        return F.coalesce(near + far, near, far).alias(name)

    joined = marked.join(buckets, key)
    return joined.select(*by, at, *[f"_cut.{c}" for c in kept], F.struct(*map(added, sums)).alias("before"), "whole")


def nearest_rows(indexed: DataFrame, keys: Sequence[str], cuts: DataFrame, at: str, block_rows: int) -> DataFrame:
    """``cuts`` with ``idx``, the number ``t`` of the row of the same keys that is nearest in time; of two the later.

    ``indexed`` is (keys, ts, t).  The starts of blocks of ``block_rows`` rows and the cuts are sorted together to find the
    block of each cut, then rows and cuts inside their blocks; the first row of the next block comes with the block.
    """
    kept = [c for c in cuts.columns if c not in (*keys, at)]
    rows = indexed.select(*keys, F.col("ts").alias("_at"), "t", F.floor(F.col("t") / block_rows).alias("_block"))
    starts = rows.groupBy(*keys, "_block").agg(F.min("_at").alias("_at"))
    following = F.lead("_at").over(Window.partitionBy(*keys).orderBy("_block"))
    starts = starts.select(*keys, "_at", F.struct("_block", following.alias("next")).alias("_start"))
    asked = cuts.select(*keys, F.col(at).alias("_at"), F.struct(F.col(at), *kept).alias("_cut"))
    shape = {"_cut": asked.schema["_cut"].dataType, "_start": starts.schema["_start"].dataType}

    def absent(name: str) -> Column:
        return F.lit(None).cast(shape[name]).alias(name)

    by_start = Window.partitionBy(*keys).orderBy("_at", F.col("_cut").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = starts.select(*keys, "_at", absent("_cut"), "_start").unionAll(asked.select(*keys, "_at", "_cut", absent("_start")))
    placed = both.withColumn("_start", F.last("_start", ignorenulls=True).over(by_start)).where("_cut IS NOT NULL")
    # a cut before the first row belongs to the first block
    placed = placed.select(*keys, F.coalesce("_start._block", F.lit(0).cast("long")).alias("_block"), "_at", F.col("_start.next").alias("_next"), "_cut")

    inside = [*keys, "_block"]
    stamp = rows.schema["_at"].dataType
    both = rows.select(*inside, "_at", "t", F.lit(None).cast(stamp).alias("_next"), absent("_cut")).unionAll(
        placed.select(*inside, "_at", F.lit(None).cast("long").alias("t"), "_next", "_cut"))
    row = F.when(F.col("t").isNotNull(), F.struct("t", "_at"))
    up = Window.partitionBy(*inside).orderBy("_at", F.col("t").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*inside).orderBy(F.desc("_at"), F.col("t").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = both.withColumn("_low", F.last(row, ignorenulls=True).over(up)).withColumn("_high", F.last(row, ignorenulls=True).over(down)).where("_cut IS NOT NULL")
    beyond = F.when(F.col("_next").isNotNull(), F.struct(((F.col("_block") + 1) * block_rows).alias("t"), F.col("_next").alias("_at")))
    near = near.withColumn("_high", F.coalesce("_high", beyond))

    def micros(c: str) -> Column:
        return F.unix_micros(F.col(c).cast("timestamp"))

    nearer_low = (micros("_at") - micros("_low._at")) < (micros("_high._at") - micros("_at"))
    idx = F.when(F.col("_high").isNull() | nearer_low, F.col("_low.t")).otherwise(F.col("_high.t"))
    return near.select(*keys, "_cut.*", idx.alias("idx"))
