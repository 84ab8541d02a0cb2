import numpy as np
import pandas as pd
import pytest

from tidemark.operators import quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.95, 1.0]


def groups():
    rng = np.random.default_rng(0)
    return {
        "normal": rng.normal(size=5001), "heavy": rng.standard_cauchy(3000), "ties": rng.integers(0, 4, 4000).astype(float),
        "one": np.array([3.0]), "two": np.array([1.0, 2.0]), "constant": np.full(77, 5.0), "narrow": 1e6 + rng.random(2500),
    }


@pytest.mark.parametrize("whole", [True, False])
def test_exact_quantiles_equal_numpy(spark, monkeypatch, whole):
    if not whole:  # bracket even the small groups, as for groups of millions of rows
        monkeypatch.setattr(quantiles, "_ACCURACY", 1000)
        monkeypatch.setattr(quantiles, "_MARGIN", 3 / 1000)
        monkeypatch.setattr(quantiles, "_SMALL", 2000)
    table = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in groups().items()])).repartition(7)
    got = {r.g: r for r in quantiles.exact_quantiles(table, ["g"], "v", PROBS).collect()}
    for g, v in groups().items():
        assert got[g].n == len(v)
        assert [got[g][f"q{i}"] for i in range(len(PROBS))] == pytest.approx(list(np.quantile(v, PROBS)), rel=1e-12), g


@pytest.mark.parametrize("small", [10, 10_000])
def test_without_keys(spark, monkeypatch, small):
    monkeypatch.setattr(quantiles, "_SMALL", small)
    v = np.random.default_rng(2).exponential(size=9999)
    row = quantiles.exact_quantiles(spark.createDataFrame(pd.DataFrame({"v": v})), [], "v", [0.25, 0.75]).first()
    assert [row.q0, row.q1] == pytest.approx(list(np.quantile(v, [0.25, 0.75])))


def test_a_sketch_that_is_off_is_noticed(spark, monkeypatch):
    """Brackets far too narrow for the accuracy of the sketch: groups are done again until their quantiles are inside."""
    monkeypatch.setattr(quantiles, "_ACCURACY", 5)
    monkeypatch.setattr(quantiles, "_MARGIN", 1e-4)
    monkeypatch.setattr(quantiles, "_SMALL", 10)
    data = {k: v for k, v in groups().items() if len(v) > 2}
    table = spark.createDataFrame(pd.concat([pd.DataFrame({"g": g, "v": v}) for g, v in data.items()])).repartition(5)
    got = {r.g: r for r in quantiles.exact_quantiles(table, ["g"], "v", [0.1, 0.5, 0.95]).collect()}
    for g, v in data.items():
        assert [got[g].q0, got[g].q1, got[g].q2] == pytest.approx(list(np.quantile(v, [0.1, 0.5, 0.95])), rel=1e-12), g
