"""Whitening against dense linear algebra on the whole table."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.whitening import Spectrum, rank_one, secular_roots, whitened


def plain(rows, k=16):
    """{vec_id: deviation}, eigenvalues, and |whitened| by vec_id, from the whole matrix."""
    fine = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in fine})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    centred = np.array([[(n * a - s) / n for a, s in zip(x, sums)] for x in fit])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = {i: (np.array([(n * a - s) / n for a, s in zip(x, sums)]) @ vectors)[:k] / np.sqrt(values[:k]) for i, x in fine}
    return n, {i: sum((n * a - s) ** 2 for a, s in zip(x, sums)) for i, x in fine}, values, white


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_secular_roots_are_eigenvalues():
    random_ = np.random.default_rng(1)
    for size in (1, 2, 5, 30):
        poles = np.sort(random_.exponential(size=size)).cumsum()
        weights = random_.exponential(size=size) * 10.0 ** random_.integers(-9, 3, size)
        origin, distance = secular_roots(poles, weights)
        want = np.linalg.eigvalsh(np.diag(poles) + np.outer(np.sqrt(weights), np.sqrt(weights)))
        assert np.allclose(poles[origin] + distance, want, rtol=1e-12, atol=1e-13 * want.max())


@pytest.mark.parametrize("case", ["plain", "zeros", "equal", "sparse", "tiny", "axis"])
def test_rank_one_updates(case):
    random_ = np.random.default_rng(2)
    d = 24
    values = {"zeros": np.zeros(d), "equal": np.repeat([1.0, 2.0, 2.0 + 1e-15, 5.0], 6)}.get(case, np.sort(random_.exponential(size=d)))
    vectors = np.linalg.qr(random_.normal(size=(d, d)))[0]
    matrix = vectors @ np.diag(values) @ vectors.T
    for _ in range(40):
        row = random_.normal(size=d) * {"tiny": 1e-9}.get(case, 1.0)
        row = {"sparse": row * (random_.random(d) < 0.2), "axis": vectors[:, 3] * 2}.get(case, row)
        matrix = matrix + np.outer(row, row)
        values, vectors = rank_one(values, vectors, row)
        assert np.abs(vectors.T @ vectors - np.eye(d)).max() < 1e-12
        assert np.abs(vectors @ np.diag(values) @ vectors.T - matrix).max() < 1e-12 * np.abs(matrix).max()


def test_spectra_combine():
    random_ = np.random.default_rng(3)
    x = np.floor(random_.normal(size=(500, 12)) * np.arange(1, 13) * 20).astype(np.int64) + 1_000_000
    parts = []
    for a, b in ((0, 1), (1, 7), (7, 300), (300, 500)):
        spectrum = Spectrum.empty(12)
        for c in range(a, b, 50):
            spectrum.add(x[c : min(b, c + 50)])
        parts.append(spectrum)
    first, *rest = parts
    for other in rest:
        first.merge(other)
    centred = x - x.mean(axis=0)
    assert first.n == 500 and first.sums.tolist() == x.sum(axis=0).tolist()
    assert np.allclose(first.vectors @ np.diag(first.values) @ first.vectors.T, centred.T @ centred, rtol=1e-10, atol=1e-8)


def check(found, rows, k):
    n, deviations, values, white = plain(rows, k)
    assert sorted({(r.vec_id, r.deviation) for r in found}) == sorted(deviations.items())
    assert {r.n for r in found} == {n}
    explained = {r.component: r.explained for r in found}
    assert sorted(explained) == list(range(1, k + 1))
    assert np.allclose([explained[c] for c in sorted(explained)], values[:k] / values.sum(), rtol=1e-9)
    got = np.zeros((len(white), k))
    order = {v: i for i, v in enumerate(white)}
    for r in found:
        got[order[r.vec_id], r.component - 1] = r.whitened
    want = np.array(list(white.values()))
    signs = np.sign((got * want).sum(axis=0))
    assert np.abs(got * signs - want).max() < 1e-7
    assert len({r.identity_error for r in found}) == 1 and 0 <= found[0].identity_error < 1e-9


def test_table_by_brute_force(spark):
    random_ = np.random.default_rng(4)
    mix = random_.normal(size=(20, 20)) / 4
    vectors = [(i, [float(c) for c in np.float32(random_.normal(size=20) @ mix)]) for i in range(600)]
    rows = vectors + [(1_000 + i, vectors[0][1]) for i in range(300)]  # a third of all rows is one vector
    rows += [(2_000, None), (2_001, []), (2_002, [float("nan")] * 20), (2_003, [None] + [0.0] * 19), (2_004, [float("inf")] + [0.0] * 19)]
    df = table(spark, rows).repartition(7).withColumns({n: F.lit(1) for n in ("x", "part", "n", "component")})
    found = whitened(df).collect()
    assert len(found) == 900 * 16
    check(found, rows, 16)


def test_table_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    check(whitened(table(spark, rows).repartition(20)).collect(), rows, 16)


def test_few_dimensions_and_repeated_ids(spark):
    rows = [(1, [0.5, 1.0]), (1, [0.5, 1.0]), (None, [0.25, 3.0]), (3, [2.0, -1.0]), (4, [2.0, -1.0, 7.0]), (5, [1e30, 0.0])]
    found = whitened(table(spark, rows)).collect()
    assert sorted((r.vec_id is None, r.vec_id, r.component) for r in found) == [(False, 1, 1), (False, 1, 1), (False, 1, 2), (False, 1, 2), (False, 3, 1), (False, 3, 2), (True, None, 1), (True, None, 2)]
    assert {r.n for r in found} == {3}


def test_tables_without_variance(spark):
    assert whitened(table(spark, [])).collect() == []
    assert whitened(table(spark, [(1, None)])).collect() == []
    found = whitened(table(spark, [(1, [0.5, 1.0]), (2, [0.5, 1.0])])).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in found] == [(1, 0, None, None, None)] * 4
    flat = whitened(table(spark, [(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [2.0, 1.0])])).collect()
    assert {r.component for r in flat if r.whitened is None} == {2}
    assert all(abs(r.explained - (1.0 if r.component == 1 else 0.0)) < 1e-12 for r in flat)


def test_large_deviation_is_null(spark):
    found = whitened(table(spark, [(1, [3e14, 1.0]), (2, [-3e14, 1.0]), (3, [0.0, 1.0])])).collect()
    assert {r.vec_id: r.deviation for r in found}[1] is None
