"""Approximate nearest neighbours by a hash-prefix forest.

A tree gives every vector a long string of bits, one for the side of a random hyperplane each, and keeps the strings
in a sorted array; what shares a prefix is a range of the array.  A query descends in every tree to its longest
prefix that any row shares, then all trees ascend together, one bit at a time, until the ranges hold enough rows.
The rows in the ranges are the candidates, and their inner products with the query are worked out in double precision
on the original vectors.

Largest inner product becomes largest cosine by one more dimension: rows are scaled by the largest norm of their block
and filled up to unit length, queries get a zero there.  Blocks hold rows of like norms, so that little is filled up and
the bits tell directions.

Rows are dealt to ranges of norms, no wider than a factor of ``NORM_RANGE`` and narrower where rows are many, and within
a range to blocks of about ``block_rows`` by a hash of their id.  Every block has a forest of its own;
queries meet the blocks in blocks of about ``query_rows``.  So a task holds one block of each, whatever the size of
the table, and a query takes the best of the answers of all blocks.  ``candidates`` tells at how many rows
the trees stop ascending.  The planes come from a seed; nothing is fitted.

Defined cases: vectors that are null, zero, of another length than most, or hold nulls or non-finite numbers take no
part; rows without an id take no part; a repeated row is a candidate of its own, and a query repeated is answered
once; a query has all candidates if there are fewer than ``k``; ties go to the smaller id; an empty table gives an
empty result; other columns play no part.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Norms are counted in steps of ``NORM_STEP``; the table of counts has at most some ten thousand rows, whatever the norms.
NORM_STEP, NORM_RANGE = 1.02, 1.25
FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Sorted arrays of bit strings over unit vectors."""

    def __init__(self, units: np.ndarray, planes: np.ndarray):
        self.planes = planes  # trees x bits x dimensions
        self.bits = planes.shape[1]
        strings = self.strings(units)
        self.order = np.argsort(strings, axis=1, kind="stable")
        self.sorted = np.take_along_axis(strings, self.order, axis=1)

    def strings(self, units: np.ndarray) -> np.ndarray:
        """trees x rows: the bits of a string as a number, the first bit highest."""
        weights = 1 << np.arange(self.bits - 1, -1, -1, dtype=np.int64)
        return np.stack([(units @ tree.T > 0) @ weights for tree in self.planes])

    def candidates(self, units: np.ndarray, wanted: int) -> list[np.ndarray]:
        """For every query the rows in the ranges at the first level, from the longest prefix up, that hold ``wanted``."""
        keys = self.strings(units)
        n = len(units)
        low, high = np.zeros((len(keys), n), np.int64), np.zeros((len(keys), n), np.int64)
        open_ = np.arange(n)
        for dropped in range(self.bits + 1):
            for t, rows in enumerate(self.sorted):
                prefix = keys[t, open_] >> dropped
                low[t, open_] = np.searchsorted(rows, prefix << dropped)
                high[t, open_] = np.searchsorted(rows, (prefix + 1) << dropped)
            open_ = open_[(high - low)[:, open_].sum(0) < wanted]
            if not len(open_):
                break
        out = []
        for q in range(n):
            seen = np.zeros(self.sorted.shape[1], bool)
            for t, (a, b) in enumerate(zip(low[:, q].tolist(), high[:, q].tolist())):
                seen[self.order[t, a:b]] = True
            out.append(np.flatnonzero(seen))
        return out


def _planes(trees: int, bits: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.RandomState(seed).normal(size=(trees, bits, dimensions))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector, norm) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")).where("vec_id is not null")
    fine = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(fine).withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))).where("norm > 0 and norm < double('inf')")
    size = rows.groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").limit(1).collect()
    return rows.where(F.size("vector") == (size[0]["d"] if size else 0))


def norm_ranges(counts: dict[int, int], block_rows: int) -> list[tuple[int, int, int]]:
    """(level, first block, blocks): the blocks of every level of norms.  Neighbouring levels share a range until it is wide or full."""
    span, out, first, open_, held = int(np.log(NORM_RANGE) / np.log(NORM_STEP)), [], 0, [], 0

    def close() -> int:
        blocks = -(-held // block_rows)
        out.extend((level, first, blocks) for level in open_)
        return first + blocks

    for level in sorted(counts, reverse=True):
        if open_ and (open_[0] - level > span or held >= block_rows):
            first, open_, held = close(), [], 0
        open_.append(level)
        held += counts[level]
    if open_:
        close()
    return out


def nearest(
    vectors: DataFrame, queries: str = "vec_id % 20 = 0", k: int = 20, trees: int = 64, bits: int = 24, candidates: float = 0.7,
    block_rows: int = 8_192, query_rows: int = 1_024, seed: int = 11,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for the rows that ``queries`` selects, nearest first.

    The trees ascend until their ranges hold ``candidates`` times the rows of the block, and 64 rows for each neighbour
    that is asked for; a row counts once for every tree, so about half as many are distinct.
    """
    rows = usable(vectors)
    level = F.round(F.log("norm") / float(np.log(NORM_STEP))).cast("int")
    facts = rows.groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.sum(F.expr(f"cast({queries} as int)")).alias("q")).collect()
    ranges = norm_ranges({r["level"]: r["n"] for r in facts}, block_rows)
    blocks, query_blocks = max([1, *(first + n for _, first, n in ranges)]), max(1, -(-sum(r["q"] or 0 for r in facts) // query_rows))
    dealt = lambda n, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), n).cast("int")
    of_level = F.broadcast(rows.sparkSession.createDataFrame(ranges, "level int, first_block int, blocks int"))
    index = rows.withColumn("level", level).join(of_level, "level").withColumn("block", F.col("first_block") + dealt(F.col("blocks"), 1))
    index = index.select(F.col("vec_id").alias("vec_id"), F.col("vector").alias("vector"), "block", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    asked = rows.where(queries).dropDuplicates(["vec_id"])
    asked = asked.select("vec_id", "vector", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), dealt(F.lit(query_blocks), 2).alias("query_block"))

    def search(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        if not len(mine) or not len(theirs):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        x, q = np.stack(mine["vector"].to_numpy()), np.stack(theirs["vector"].to_numpy())
        ids, query_ids = mine["vec_id"].to_numpy(), theirs["vec_id"].to_numpy()
        norms = np.linalg.norm(x, axis=1)
        scaled = x / norms.max()
        filled = np.column_stack([scaled, np.sqrt(np.maximum(0, 1 - (scaled**2).sum(1)))])
        turned = np.column_stack([q / np.linalg.norm(q, axis=1, keepdims=True), np.zeros(len(q))])
        forest = Forest(filled, _planes(trees, bits, filled.shape[1], seed))
        out = []
        for one, near in enumerate(forest.candidates(turned, max(64 * k, int(np.ceil(candidates * len(x)))))):
            near = near[ids[near] != query_ids[one]]
            scores = x[near] @ q[one]
            best = np.lexsort((ids[near], -scores))[:k]
            out.append(pd.DataFrame({"query_id": query_ids[one], "vec_id": ids[near][best], "score": scores[best]}))
        return pd.concat(out)

    pair = ["block", "query_block"]
    found = index.groupBy(pair).cogroup(asked.groupBy(pair)).applyInPandas(search, FOUND)
    first = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
