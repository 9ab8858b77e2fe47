import math

import pytest
from pyspark.sql import functions as F

from skein.functions import native_histogram as nh
from skein.plans.grid import Grid

S = 10**9


def make(schema=0, zero=0.0, pos=None, neg=None, total=0.0):
    pos, neg = pos or {}, neg or {}
    return (schema, 0.001, zero, zero + sum(pos.values()) + sum(neg.values()), total, pos, neg)


@pytest.fixture(scope="module")
def two(spark):
    rows = [(make(0, 2.0, {1: 4.0, 2: 6.0}, {1: 1.0}, 20.0), make(1, 1.0, {1: 1.0, 2: 2.0, 3: 3.0}, None, 9.0))]
    return spark.createDataFrame(rows, f"a {nh.TYPE}, b {nh.TYPE}")


def value(df, column):
    return df.select(column.alias("x")).first().x


def test_combining_schemas(two):
    a, b = F.col("a"), F.col("b")
    total = value(two, nh.combined(a, b))
    assert total.pos == {1: 7.0, 2: 9.0} and total.neg == {1: 1.0}
    back = value(two, nh.combined(nh.combined(a, b), b, -1))
    assert back.pos == {1: 4.0, 2: 6.0} and back.sum == 20.0
    assert value(two, nh.scaled(a, F.lit(0.5))).pos == {1: 2.0, 2: 3.0}


def test_quantiles_and_fractions(two):
    a = F.col("a")
    # 13 observations: 1 in (-2, -1], 2 around zero, 4 in (1, 2], 6 in (2, 4].
    assert value(two, nh.quantile(F.lit(5 / 13), a)) == pytest.approx(2**0.5)
    assert value(two, nh.quantile(F.lit(1.0), a)) == pytest.approx(4)
    assert value(two, nh.quantile(F.lit(-1.0), a)) == -math.inf
    assert value(two, nh.fraction(F.lit(2.0), F.lit(4.0), a)) == pytest.approx(6 / 13)
    assert value(two, nh.fraction(F.lit(-math.inf), F.lit(math.inf), a)) == pytest.approx(1)
    assert value(two, nh.average(a)) == pytest.approx(20 / 13)
    assert value(two, nh.variance(a)) > 0
    assert value(two, nh.trimmed(a, F.lit(2.0)))["count"] == pytest.approx(7)


def test_increase_with_a_reset(spark):
    rows = [("k", t * S, make(0, 0.0, {1: float(n)}, None, float(n))) for t, n in [(0, 1), (60, 3), (120, 2), (180, 5)]]
    samples = spark.createDataFrame(rows, f"key string, ts long, h {nh.TYPE}")
    out = nh.increase(samples, Grid(180 * S, 180 * S, S), 200 * S).first().h
    # Gains of 2, then 2 after the reset, then 3; the window begins 20 s before the first sample.
    assert out["count"] == pytest.approx(7 * 200 / 180) and out.pos[1] == pytest.approx(7 * 200 / 180)


def test_sum_by_bucket(spark):
    rows = [("g", make(1, 1.0, {2: 1.0}, None, 1.0)), ("g", make(0, 1.0, {1: 2.0}, {3: 1.0}, 2.0)), ("e", make(0))]
    out = {r.g: r.h for r in nh.summed(spark.createDataFrame(rows, f"g string, h {nh.TYPE}"), ["g"]).collect()}
    assert out["g"].pos == {1: 3.0} and out["g"].neg == {3: 1.0} and out["g"].sum == 3.0 and out["e"].pos == {}
