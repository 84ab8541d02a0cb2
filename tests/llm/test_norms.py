"""Recall of the prefix forest where norms differ."""

import numpy as np
import pytest

from tidemark.llm import prefix_forest


@pytest.mark.parametrize("norms", ["log-normal", "outlier", "unit"])
def test_recall_does_not_hang_on_the_norms(spark, norms):
    random = np.random.RandomState(7)
    x = random.normal(size=(8_192, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if norms == "log-normal":
        x *= np.exp(0.5 * random.normal(size=(len(x), 1)))
    elif norms == "outlier":
        x[4_321] *= 3
    vectors = spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<double>").repartition(4)
    got = prefix_forest.nearest(vectors, queries="vec_id % 40 = 0").collect()
    hits = 0
    for one in range(0, len(x), 40):
        scores = x @ x[one]
        scores[one] = -np.inf
        hits += len(set(np.argsort(-scores)[:20].tolist()) & {r.vec_id for r in got if r.query_id == one})
    print(norms, hits / len(got))
    assert len(got) == 20 * len(range(0, len(x), 40)) and hits >= 0.95 * len(got)


def test_ranges_are_narrow_and_every_level_has_blocks():
    ranges = {level: (first, n) for level, first, n in prefix_forest.norm_ranges({0: 20_000, 1: 5, 40: 1, -5: 30, -200: 8_192}, 8_192)}
    assert ranges == {40: (0, 1), 1: (1, 3), 0: (1, 3), -5: (4, 1), -200: (5, 1)}
    assert prefix_forest.norm_ranges({}, 8_192) == []
