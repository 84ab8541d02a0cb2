import math

import pytest
from pyspark.sql import functions as F

from tidemark.functions import stats
from tidemark.functions.stats import chi2_upper_p, t_quantile_975, t_two_sided_p

# Textbook quantiles: two-sided 5 % points of t, upper 5 % points of chi-square.
T_975 = {1: 12.7062047362, 2: 4.3026527297, 3: 3.1824463053, 5: 2.5705818356, 10: 2.2281388520, 30: 2.0422724563, 120: 1.9799304051, 1000: 1.9623390808}
CHI2_95 = {1: 3.8414588207, 2: 5.9914645471, 3: 7.8147279033, 4: 9.4877290368, 7: 14.0671404493, 9: 16.9189776046, 10: 18.3070380533}


def test_t_tail_at_known_quantiles(spark):
    rows = spark.createDataFrame(list(T_975.items()), "df long, t double")
    for r in rows.select("df", t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-9), r.df


def test_t_tail_edges(spark):
    rows = spark.createDataFrame([(0, 2.0), (5, 0.0), (5, 1e6), (5, -2.5705818356)], "df long, t double")
    p = [r.p for r in rows.select(t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[0] is None and p[1] == 1.0 and 0 <= p[2] < 1e-12 and p[3] == pytest.approx(0.05, abs=1e-9)


def test_t_tail_folds_long_series_without_a_step(spark):
    rows = spark.createDataFrame([(19_999, 1.7), (20_000, 1.7), (20_001, 1.7), (10_000_000, 1.7)], "df long, t double")
    p = [r.p for r in rows.select(t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()]
    assert p[0] > p[1] > p[2] > p[3]
    assert p[0] - p[2] < 1e-8
    assert p[3] == pytest.approx(math.erfc(1.7 / math.sqrt(2)), abs=1e-7)


def test_t_quantile_inverts_the_tail(spark):
    rows = spark.createDataFrame([(n,) for n in (1, 2, 4, 29, 399, 400, 401, 5000)], "df long").withColumn("q", t_quantile_975(F.col("df")))
    for r in rows.select("df", t_two_sided_p(F.col("q"), F.col("df")).alias("p")).collect():
        assert r.p == pytest.approx(0.05, abs=1e-10), r.df


def test_chi2_tail(spark):
    rows = spark.createDataFrame([*CHI2_95.items(), (4, 0.0), (4, 500.0)], "df long, x double")
    p = [r.p for r in rows.select(chi2_upper_p(F.col("x"), F.col("df")).alias("p")).collect()]
    assert p[:-2] == pytest.approx([0.05] * len(CHI2_95), abs=1e-9)
    assert p[-2:] == pytest.approx([1.0, 0.0], abs=1e-12)


def test_chi2_tail_of_many_degrees(spark):
    def exact(x, df):  # the finite sums for even and odd df, in log space
        h = x / 2
        if df % 2 == 0:
            return math.fsum(math.exp(k * math.log(h) - h - math.lgamma(k + 1)) for k in range(df // 2))
        return math.erfc(math.sqrt(h)) + math.fsum(math.exp((k + 0.5) * math.log(h) - h - math.lgamma(k + 1.5)) for k in range(df // 2))

    pairs = [(201.0, 200), (1100.0, 1000), (190.0, 200), (201.0, 201), (3.0, 1), (0.01, 3), (30.0, 7), (5000.0, 5001), (10500.0, 10000), (9.0, 10), (12.0, 10), (1e-9, 2)]
    rows = spark.createDataFrame(pairs, "x double, df long").withColumn("p", chi2_upper_p(F.col("x"), F.col("df"))).collect()
    for r in rows:
        assert r.p == pytest.approx(exact(r.x, r.df), abs=1e-8), (r.x, r.df)


@pytest.mark.parametrize("df", [1, 2, 3, 10, 31, 399, 401, 19_999, 20_001])
def test_t_tail_equals_the_finite_series(spark, df):
    """Abramowitz & Stegun 26.7.3 and 26.7.4, summed term by term."""
    def series(t):
        angle, cos2, odd = math.atan(t / math.sqrt(df)), df / (df + t * t), df % 2
        total = 1.0
        for k in range((df - 2 - odd) // 2, 0, -1):
            total = 1 + total * cos2 * (2 * k - 1 + odd) / (2 * k + odd)
        if df == 1:
            return 1 - 2 * angle / math.pi
        return 1 - ((angle + math.sin(angle) * math.sqrt(cos2) * total) * 2 / math.pi if odd else math.sin(angle) * total)

    at = [1e-9, 0.01, 0.5, 1.0, 1.7, 1.74, 1.8, 2.5, 4.0, 9.0]
    rows = spark.createDataFrame([(t, df) for t in at], "t double, df long").select("t", stats.t_two_sided_p(F.col("t"), F.col("df")).alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([series(r.t) for r in rows], abs=2e-12)


def test_t_at_very_many_degrees_of_freedom(spark):
    row = spark.createDataFrame([(10_000_000,)], "df long").select(
        stats.t_two_sided_p(F.lit(1.96), F.col("df")).alias("p"), stats.t_quantile_975(F.col("df")).alias("q"), stats.t_two_sided_p(F.lit(0.0), F.col("df")).alias("one"),
        stats.t_two_sided_p(F.lit(1.0), F.lit(0)).alias("none"), stats.t_two_sided_p(F.lit(1.0), F.lit(2.5)).alias("part")).first()
    # beyond the normal: the first terms of the expansions in 1 / df
    z = stats.Z_975
    assert row.p == pytest.approx(math.erfc(1.96 / math.sqrt(2)) + math.exp(-1.96**2 / 2) / math.sqrt(2 * math.pi) * (1.96**3 + 1.96) / 2e7, abs=1e-11)
    assert row.q == pytest.approx(z + (z**3 + z) / 4e7, abs=1e-9)
    assert row.one == 1.0 and row.none is None and 0.39 < row.part < 0.43
