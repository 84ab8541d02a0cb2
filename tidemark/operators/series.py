"""Shaping long tables into series: one row per key and timestamp, an observation index, bounded blocks.

Nothing here puts a whole unbounded series into one task.  Raw rows are pre-aggregated before they
are shuffled; the index of a fine-grained series is built per calendar bucket plus an offset per
bucket; lags are taken inside blocks of ``BLOCK_ROWS`` observations that carry a short overlap.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators import detect
from tidemark.operators.asof import nearest_rows
from tidemark.session import checkpointed

BLOCK_ROWS = 4096
OVERLAP = 64  # at least the longest lag of any model
_SENT_FACTS = 20_000  # rows of facts per key that are sent to every task

# Calendar bucket used to number the observations of a series, by grain.  A series at a grain of a
# day or coarser is short enough to be numbered in one window.
_BUCKET = {
    None: "minute", "second": "hour", "minute": "day", "hour": "year",
    "day": None, "week": None, "month": None, "quarter": None, "year": None,
}

# Share and number of points needed on either side of an intervention, and the
# smallest series that is analysed.
MIN_SIDE_RATIO = 0.05
MIN_SIDE_POINTS = 3
MIN_SERIES_LENGTH = 30


def number_or_null(value: Column) -> Column:
    """NaN becomes NULL, so that averages, counts and ``dropna`` agree."""
    return F.when(~F.isnan(value), value)


def observed(df: DataFrame, ts: str, y: str) -> tuple[Column, Column]:
    """Timestamp and value of a row, null where they cannot be read.  Text and numbers (years, 20210131) are parsed by
    spelling; dates with slashes have the day first if some could not be read otherwise, which takes a look at them."""
    time, value = df.schema[ts].dataType, df.schema[y].dataType
    if detect.is_time(time):
        stamp = F.col(ts).cast("timestamp")
    else:
        day_first = isinstance(time, T.StringType) and detect.day_comes_first(df, ts)
        stamp = detect.parse_timestamp(F.col(ts).cast("string"), day_first)
    number = F.col(y).try_cast("double") if isinstance(value, T.StringType) else F.col(y).cast("double")
    return stamp, number_or_null(number)


def rejected_rows(df: DataFrame, keys: Sequence[str], ts: str, y: str) -> DataFrame:
    """(reason, n_rows) of the rows that take no part in a series; the first reason that holds, every reason listed."""
    stamp, value = observed(df, ts, y)
    reasons = {"no_key": reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys], F.lit(False)),
               "no_date": F.col(ts).isNull(), "bad_date": stamp.isNull(), "no_value": F.col(y).isNull(), "bad_value": value.isNull()}
    first = reduce(lambda chain, r: chain.when(reasons[r], r), list(reasons)[1:], F.when(reasons["no_key"], "no_key"))
    counted = df.select(first.alias("reason")).agg(*[F.count(F.when(F.col("reason") == r, 1)).alias(r) for r in reasons])
    return counted.select(F.inline(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(r).alias("n_rows")) for r in reasons])))


def to_series(df: DataFrame, keys: Sequence[str], ts: str, y: str, grain: str | None = None) -> DataFrame:
    """(keys, ts, y): rows sharing a key and a timestamp (cut to ``grain``) collapse to their mean.

    Rows without a key, a timestamp or a value take no part (``rejected_rows`` counts them).  The mean is combined
    map-side, so a hot key costs one partial row per task and timestamp.
    """
    if grain not in _BUCKET:
        raise ValueError(f"unknown grain {grain!r}; known: {[g for g in _BUCKET if g]}")
    stamp, value = observed(df, ts, y)
    if grain:
        stamp = F.date_trunc(grain, stamp)
    rows = df.select(*keys, stamp.alias("ts"), value.alias("y")).dropna()
    return rows.groupBy(*keys, "ts").agg(F.avg("y").alias("y"))


def index_series(series: DataFrame, keys: Sequence[str], grain: str | None = None) -> DataFrame:
    """Adds ``t``, the 0-based observation number of each row within its key."""
    bucket = _BUCKET[grain]
    if bucket is None:
        whole = Window.partitionBy(*keys).orderBy("ts")
        return series.withColumn("t", (F.row_number().over(whole) - 1).cast("long"))
    rows = series.withColumn("bucket", F.date_trunc(bucket, "ts"))
    inside = Window.partitionBy(*keys, "bucket").orderBy("ts")
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Counting y, which is never null here, keeps both branches on one shuffle: raw rows are read once.
    offsets = (
        rows.groupBy(*keys, "bucket").agg(F.count("y").alias("count"))
        .select(*keys, "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    )
    return (
        rows.withColumn("rank", F.row_number().over(inside))
        .join(offsets, [*keys, "bucket"])
        .withColumn("t", (F.col("offset") + F.col("rank") - 1).cast("long"))
        .drop("bucket", "offset", "rank")
    )


def blocks(indexed: DataFrame, keys: Sequence[str], overlap: int) -> DataFrame:
    """Adds ``block``: every series is cut into blocks of ``BLOCK_ROWS`` rows.

    The last ``overlap`` rows of a block are repeated, flagged ``is_overlap``, at the head of the next.
    """
    if overlap > BLOCK_ROWS:
        raise ValueError(f"an overlap of {overlap} does not fit a block of {BLOCK_ROWS}")
    own = F.floor(F.col("t") / BLOCK_ROWS)
    near_end = F.col("t") % BLOCK_ROWS >= BLOCK_ROWS - overlap
    return (
        indexed.withColumn("own", own)
        .withColumn("block", F.explode(F.when(near_end, F.array("own", F.col("own") + 1)).otherwise(F.array("own"))))
        .withColumn("is_overlap", F.col("block") > F.col("own"))
        .drop("own")
    )


def prepare(indexed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of indexed series, written once to the checkpoint folder: the raw rows are read a single time.

    Everything fitted later starts from these rows, which are as many as there are timestamps per key.
    """
    return checkpointed(blocks(indexed, keys, OVERLAP))


def own_rows(blocked: DataFrame) -> DataFrame:
    """The rows of the series, without the repeated ones."""
    return blocked.where(~F.col("is_overlap")).drop("is_overlap")


def with_lags(blocked: DataFrame, keys: Sequence[str], depth: int, value: str = "y", name: str = "lags") -> DataFrame:
    """Adds the array [v(t), v(t-1), ..., v(t-depth)], shorter at the start of a series."""
    window = Window.partitionBy(*keys, "block").orderBy("t").rowsBetween(-depth, 0)
    return (
        blocked.withColumn(name, F.reverse(F.collect_list(value).over(window)))
        .where(~F.col("is_overlap"))
        .drop("is_overlap")
    )


def per_block(table: DataFrame, n: str) -> DataFrame:
    """Repeats a per-series row once per block of its series: joins by (keys, block) have no hot key."""
    last = F.floor((F.col(n) - 1) / BLOCK_ROWS)
    return table.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), last)))


def join_per_key(rows: DataFrame, facts: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Joins a few facts per key to the rows of that key; without keys the facts are a single row.

    The facts are worked out first.  Up to ``_SENT_FACTS`` of them are sent to the rows, which stay where they lie, so
    that no task holds all rows of a key.  Left to itself, adaptive execution would not do so for few keys, as most
    partitions of their facts are empty.  Beyond that a hot key is split by the skew join of adaptive execution.  The
    extra join column lets it: with it, no later aggregate by the same keys can rely on the layout of the join.
    """
    tie = F.xxhash64(*keys) if keys else F.lit(1)
    facts = checkpointed(facts).withColumn("_tie", tie)
    if facts.count() <= _SENT_FACTS:
        facts = F.broadcast(facts)
    return rows.withColumn("_tie", tie).join(facts, [*keys, "_tie"], how).drop("_tie")


def attach_specs(series: DataFrame, specs: DataFrame | Sequence[tuple[str, str]]) -> DataFrame:
    """Pairs series rows with their analyses.

    ``specs`` is either a table (analysis_id, intervention_ts, ...) sharing columns with the series,
    on which it is joined, or a short list of (analysis_id, date) pairs for every series.
    """
    if isinstance(specs, DataFrame):
        shared = [c for c in specs.columns if c in series.columns]
        if not shared:
            raise ValueError("the spec table shares no column with the series; give a list of pairs instead")
        return series.join(specs, shared)
    literal = F.array(*[
        F.struct(F.lit(name).alias("analysis_id"), F.lit(str(at)).cast("timestamp").alias("intervention_ts"))
        for name, at in specs
    ])
    return series.withColumn("spec", F.explode(literal)).select(*series.columns, "spec.*")


def window_status(idx: Column, n: Column, min_length: int | None = MIN_SERIES_LENGTH) -> Column:
    """ok / too_early / too_late / too_short: a label, so that one bad series never fails the job."""
    needed = F.greatest(F.lit(MIN_SIDE_POINTS), F.floor(n * MIN_SIDE_RATIO))
    status = F.when(idx < needed, "too_early").when(n - idx - 1 < needed, "too_late")
    if min_length:
        status = status.when(n < min_length, "too_short")
    return status.otherwise("ok")


def locate_interventions(
    indexed: DataFrame,
    keys: Sequence[str],
    specs: DataFrame | Sequence[tuple[str, str]],
    carry: Sequence[str] = (),
    min_length: int | None = MIN_SERIES_LENGTH,
) -> DataFrame:
    """One row per (analysis_id, keys): idx of the nearest date (a tie goes to the later one), n, status.

    A short list is matched with no shuffle of rows.  A table of any size, which shares key columns with the series, is
    sorted together with them: no pairs of rows and specs are formed.  ``carry`` names further columns of it to keep.
    """
    if isinstance(specs, DataFrame):
        shared = [c for c in specs.columns if c in keys]
        if not shared:
            raise ValueError("the spec table shares no key with the series; give a list of pairs instead")
        sizes = indexed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("pivot"))
        asked = specs.select("analysis_id", *shared, F.col("intervention_ts").cast("timestamp").alias("intervention_ts"), *carry)
        asked = asked.where(F.col("intervention_ts").isNotNull()).join(sizes, shared)
        located = nearest_rows(indexed, keys, asked, "intervention_ts", BLOCK_ROWS).select("analysis_id", *keys, "idx", "n", "pivot", *carry)
    else:
        away = F.unix_micros("ts") - F.unix_micros("intervention_ts")
        # one number to order by, so that the aggregate hashes: nearest first, the later of two at a tie
        distance = 2 * F.abs(away) + (away < 0).cast("long")
        located = attach_specs(indexed, specs).groupBy("analysis_id", *keys).agg(
            F.min_by("t", distance).alias("idx"), F.count(F.lit(1)).alias("n"), F.avg("y").alias("pivot"))
    n_pre, n = F.col("idx"), F.col("n")
    return (
        located.withColumn("n_pre", n_pre)
        .withColumn("n_post", n - n_pre)
        .withColumn("status", window_status(n_pre, n, min_length))
    )


def pre_post_split(indexed: DataFrame, located: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Series rows of each analysis with ``is_post`` = at or after the intervention index."""
    return join_per_key(indexed, located.select("analysis_id", *keys, "idx"), keys).withColumn(
        "is_post", F.col("t") >= F.col("idx")
    )
