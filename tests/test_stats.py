import math

from pyspark.sql import functions as F

from lexispark.functions import stats


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def expected_ll(k11, k12, k21, k22):
    n = k11 + k12 + k21 + k22
    out = 0.0
    for k, r, c in ((k11, k11 + k12, k11 + k21), (k12, k11 + k12, k12 + k22), (k21, k21 + k22, k11 + k21), (k22, k21 + k22, k12 + k22)):
        e = r * c / n
        if k > 0 and e > 0:
            out += k * math.log(k / e)
    return 2 * out


def test_log_likelihood(spark):
    for cells in ((10, 20, 30, 940), (5, 0, 0, 95), (12, -3, 4, 100)):
        got = one(spark, stats.log_likelihood(*[F.lit(c) for c in cells]))
        assert math.isclose(got, expected_ll(*cells), rel_tol=1e-12)
    assert one(spark, stats.log_likelihood(*[F.lit(0)] * 4)) == 0


def test_mutual_information(spark):
    assert math.isclose(one(spark, stats.mutual_information(F.lit(8), F.lit(10), F.lit(20), F.lit(1000))), math.log2(8 / 0.2))
    assert one(spark, stats.mutual_information(F.lit(0), F.lit(10), F.lit(20), F.lit(1000))) == 0


def test_significance_edges(spark):
    for ll, mark in ((15.13, "*** (p<0.001)"), (15.12, "** (p<0.01)"), (10.83, "** (p<0.01)"), (3.84, " * (p<0.05)"), (3.83, "ns")):
        assert one(spark, stats.significance(F.lit(ll))) == mark


def test_zipf_bands(spark):
    assert one(spark, stats.zipf(F.lit(0.0))) is None
    assert one(spark, stats.zipf(F.lit(1000.0))) == 6.0
    for score, band in ((7.0, 1), (6.99, 2), (4.0, 4), (3.99, 5)):
        assert one(spark, stats.zipf_band(F.lit(score))) == band


def test_relative_frequency_reference_factor(spark):
    assert one(spark, stats.relative_frequency(F.lit(1), F.lit(3), 1_000_100)) == 333366.6667
