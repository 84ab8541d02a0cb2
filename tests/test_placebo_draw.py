"""The keyed permutation behind the placebo draw."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import placebo


def plain_position(i, width, key):
    rows = math.ceil(math.sqrt(width))
    columns = math.ceil(width / rows)

    def shift(number, half):
        return int(hashlib.md5(f"{key}|{number}|{half}".encode()).hexdigest()[:12], 16)

    while True:
        a, b = divmod(i, columns)
        for number in range(1, 5):
            if number % 2:
                a = (a + shift(number, b)) % rows
            else:
                b = (b + shift(number, a)) % columns
        i = a * columns + b
        if i < width:
            return i


@pytest.mark.parametrize("width", [1, 2, 10, 17, 100, 601])
def test_it_is_a_permutation(spark, width):
    at = spark.range(width).select(placebo.shuffled_position(F.col("id"), F.lit(width).cast("long"), F.lit("42|a")).alias("x"), "id")
    got = {r.id: r.x for r in at.collect()}
    assert sorted(got.values()) == list(range(width))
    assert got == {i: plain_position(i, width, "42|a") for i in range(width)}


def test_as_many_dates_as_asked_at_any_width(spark):
    widths = [10, 49, 50, 51, 4_095, 4_097, 100_003, 1_000_000]
    sizes = spark.createDataFrame([("x", f"k{w}", math.ceil(w / 0.6) + 40) for w in widths], "analysis_id string, key string, n long")
    rows = placebo.placebo_indices(sizes, ["key"]).collect()
    for w in widths:
        n = math.ceil(w / 0.6) + 40
        lo, hi = max(10, n // 5), min(n - 10, n - n // 5)
        drawn = [r.placebo_idx for r in rows if r.key == f"k{w}"]
        assert len(drawn) == len(set(drawn)) == min(50, hi - lo)
        assert drawn == sorted(lo + plain_position(i, hi - lo, f"42|k{w}") for i in range(len(drawn)))
    spread = [r.placebo_idx for r in rows if r.key == "k1000000"]
    assert min(spread) < 500_000 + 200_000 and max(spread) > 600_000  # all over the range, not at its start
