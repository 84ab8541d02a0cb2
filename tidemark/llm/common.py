"""Helpers shared by the operators: reading, hand-over of tables between jobs, and linked components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import shared_folder

#: Words are separated by these bytes and no others: space, tab to carriage return.  ``bytes.split()`` does the same.
SPACE = b" \t\n\x0b\x0c\r"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as Parquet to the shared checkpoint folder and read it back: lineage is cut, and any executor
    can read the files of any other.  Unlike a checkpoint the table is columnar and pruned when read."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def per_batch(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | pa.Table | None], schema: str) -> DataFrame:
    """Apply ``function`` to every Arrow batch; no state is kept between batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = function(batch)
            if isinstance(out, pa.Table):
                yield from out.to_batches()
            elif out is not None:
                yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow column as UTF-8 bytes; null is the empty text."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node that can be reached from each node named in ``links`` (a, b).

    Alternates large-star and small-star rounds: every node points its larger neighbours, then itself and its
    smaller neighbours, at the smallest node in sight.  The number of rounds grows with the logarithm of the
    longest chain.  Minima are taken map-side, so a node with very many links is no hot group; the join with the
    minima is an ordinary shuffle join, whose large partitions adaptive execution splits.
    """
    links = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    edges = stored(links.distinct(), "links")
    before = None
    while True:
        both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.where("a <> b").distinct(), "links")  # every link points from the larger node to the smaller one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionAll(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
