"""Mixing sources to target weights by Pfair scheduling, in DataFrame functions alone.

Every source is a task with a share of the slots, every block of ``block_units`` characters a unit of work.  Block k of
a source with share w out of a period of H slots is released at floor(k H / w) and due at ceil((k + 1) H / w); each
slot goes to the released block with the earliest deadline.  The shares add up to one, so every block meets its
window, and after any number of slots no source is a whole block ahead of or behind its weight.  The schedule repeats
after H slots, so only one period is worked out: a fold over H slots, bounded by ``slots`` and the number of sources,
never by the data.  Documents find their slot by a join with that period.

Within a source, documents are in the order of a hash of their id and text.  Running sums of their sizes are taken in
two levels, within buckets of about ``bucket_rows`` documents of a source and over the buckets, so a source that
holds a third of all rows is spread over many tasks.  A document takes its characters and one more; a long one spans
blocks, and the slots of the blocks that it covers are its own.

When a source runs out, its later slots stay empty and the others keep their order; ``balanced`` tells whether a
slot comes before the first empty one.  No row is dropped or repeated.

Defined cases: a null text is empty; null sources are one source of their own; null ids are ordered by their text;
repeated rows get places of their own, next to each other; weights for sources without documents are not used and
sources without a weight get the least share, one slot in a period;
if no source has a weight all are alike; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import stored

PREFIX = "_mix_"


def _let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` worked out once."""
    return F.transform(F.array(value), then)[0]


def shares(totals: DataFrame, weights: dict[str, float] | None, temperature: float, slots: int) -> DataFrame:
    """(name, units, period, share): whole shares that add up to the period; every source has one slot at least."""
    if weights is None:
        target = F.pow(F.col("units").cast("double"), F.lit(float(temperature)))
    else:
        known = F.create_map(*(x for k, v in weights.items() for x in (F.lit(f"={k}"), F.lit(float(v)))))
        target = F.coalesce(known[F.col("name")], F.lit(0.0))
    every, upto = W.partitionBy(), W.orderBy("name")  # one row for each source
    out = totals.select("name", "units", target.alias("target"))
    out = out.withColumn("target", F.when(F.sum("target").over(every) > 0, F.col("target")).otherwise(1.0)).select(
        "name", "units", F.count("*").over(every).alias("n"), F.sum("target").over(every).alias("sum"), F.sum("target").over(upto).alias("upto"), "target",
    )
    out = out.withColumn("period", F.greatest(F.lit(slots).cast("long"), 4 * F.col("n")))
    end = F.round(F.col("upto") / F.col("sum") * (F.col("period") - F.col("n"))).cast("long")
    return out.select("name", "units", "period", end.alias("end")).select(
        "name", "units", "period", (1 + F.col("end") - F.coalesce(F.lag("end").over(W.orderBy("name")), F.lit(0))).alias("share"),
    )


def one_period(sources: DataFrame, block_units: int) -> DataFrame:
    """(name, turn, slot, release, deadline, share, period, balanced_slots) for one period of earliest deadline first."""
    packed = sources.groupBy().agg(F.sort_array(F.collect_list(F.struct("name", "share", "units", "period"))).alias("s"))
    packed = packed.select("s", F.try_element_at("s", F.lit(1))["period"].alias("period"), F.col("s.share").alias("w"))
    period = F.col("period")

    def step(state: Column, t: Column) -> Column:
        def window(w: Column, i: Column) -> Column:
            k = state["taken"][i]
            due = F.ceil((k + 1) * period / w)
            return F.struct(F.when((k < w) & (F.floor(k * period / w) <= t), due).alias("due"), i.alias("i"))

        def served(pick: Column) -> Column:
            taken = F.transform(state["taken"], lambda k, i: k + F.when(i == pick, 1).otherwise(0))
            return F.struct(taken.alias("taken"), F.concat(state["picks"], F.array(F.struct(pick.alias("i"), state["taken"][pick].alias("turn"), t.alias("slot")))).alias("picks"))

        return _let(F.array_min(F.filter(F.transform("w", window), lambda x: x["due"].isNotNull()))["i"], served)

    start = F.struct(
        F.transform("w", lambda _: F.lit(0)).alias("taken"),
        F.expr("cast(array() as array<struct<i: int, turn: int, slot: bigint>>)").alias("picks"),
    )
    picks = F.aggregate(F.sequence(F.lit(0).cast("long"), period - 1), start, step, lambda state: state["picks"])
    packed = packed.select("s", "period", picks.alias("picks"))
    placed = packed.select("s", "period", F.explode("picks").alias("p")).select(F.col("s")[F.col("p.i")].alias("s"), "period", F.col("p.turn").cast("long").alias("turn"), "p.slot")
    placed = placed.select("s.name", "s.share", "s.units", "period", "turn", "slot")
    blocks = F.ceil(F.col("units") / F.lit(block_units))  # the slot of the first block that a source no longer has
    empty = F.when(F.col("turn") == blocks % F.col("share"), F.floor(blocks / F.col("share")) * F.col("period") + F.col("slot"))
    return placed.select(
        "name", "turn", "slot", "share", "period", F.floor(F.col("turn") * F.col("period") / F.col("share")).alias("release"),
        F.ceil((F.col("turn") + 1) * F.col("period") / F.col("share")).alias("deadline"), F.min(empty).over(W.partitionBy()).alias("balanced_slots"),
    )


def _if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A stored table with a row for each source or slot, broadcast if it has at most ``rows`` rows; else joined by its keys."""
    return F.broadcast(df) if df.count() <= rows else df


def placed(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 0.5, block_units: int = 65_536, slots: int = 1_024, bucket_rows: int = 2_048) -> DataFrame:
    """The rows and columns of ``docs`` plus ``_mix_`` columns: slot, start, units, block, release, deadline, share, period, balanced.

    Target weights are given by source, or are the sizes of the sources to the power ``temperature``.
    """
    col = lambda name: F.col(PREFIX + name)
    own = lambda df, *names: df.select(*(F.col(x).alias(PREFIX + x) for x in names))
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumns({
        PREFIX + "name": F.coalesce(F.concat(F.lit("="), "source"), F.lit("")),
        PREFIX + "units": (F.length(text) + 1).cast("long"),
        PREFIX + "key": F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), text).cast("binary")),
    })
    totals = rows.groupBy(col("name").alias("name")).agg(F.sum(col("units")).alias("units"), F.count("*").alias("rows"))
    totals = stored(totals, "sources")
    period = stored(one_period(shares(totals, weights, temperature, slots), block_units), "period")

    counts = own(totals.select("name", F.ceil(F.col("rows") / bucket_rows).alias("buckets")), "name", "buckets")
    rows = rows.join(_if_small(counts), PREFIX + "name")
    spread = F.conv(F.substring(col("key"), 1, 8), 16, 10).cast("long")
    rows = rows.withColumn(PREFIX + "bucket", F.shiftright(spread * col("buckets"), 32)).drop(PREFIX + "buckets")
    bucket = [PREFIX + "name", PREFIX + "bucket"]
    sums = rows.groupBy(bucket).agg(F.sum(col("units")).alias(PREFIX + "sum"))
    ahead = W.partitionBy(PREFIX + "name").orderBy(PREFIX + "bucket")  # one row for each bucket
    sums = sums.select(*bucket, (F.sum(col("sum")).over(ahead) - col("sum")).alias(PREFIX + "before"))
    within = W.partitionBy(bucket).orderBy(col("key"), F.col("doc_id")).rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumn(PREFIX + "start", F.sum(col("units")).over(within) - col("units"))
    rows = rows.join(sums, bucket).withColumn(PREFIX + "start", col("start") + col("before")).drop(PREFIX + "before", PREFIX + "bucket")
    rows = rows.withColumn(PREFIX + "block", F.floor(col("start") / F.lit(block_units)))

    share = own(period.select("name", "share").distinct(), "name", "share")
    rows = rows.join(_if_small(share), PREFIX + "name").withColumn(PREFIX + "turn", col("block") % col("share"))
    slots_of = own(period.select("name", "turn", "slot", "period", "release", "deadline", "balanced_slots"), "name", "turn", "slot", "period", "release", "deadline", "balanced_slots")
    rows = rows.join(_if_small(slots_of), [PREFIX + "name", PREFIX + "turn"])
    base = F.floor(col("block") / col("share")) * col("period")
    rows = rows.withColumns({PREFIX + x: base + col(x) for x in ("slot", "release", "deadline")})
    return rows.withColumn(PREFIX + "balanced", col("slot") < col("balanced_slots")).drop(*(PREFIX + x for x in ("name", "key", "turn", "balanced_slots")))


def mix_plan(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, slot, start, units, block, release, deadline, share, period, balanced): documents go by slot, then by start."""
    rows = placed(docs.select("doc_id", "source", "text"), **options)
    names = ["slot", "start", "units", "block", "release", "deadline", "share", "period", "balanced"]
    return rows.select("doc_id", "source", *(F.col(PREFIX + x).alias(x) for x in names))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` in mixed order over its partitions, with no other columns."""
    rows = placed(docs, **options)
    order = [F.col(PREFIX + x) for x in ("slot", "start")]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).select(docs.columns)
