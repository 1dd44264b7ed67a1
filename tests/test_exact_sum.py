from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tarn.functions import rounded_sum


def total(spark, values, partitions=3, places=6):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    return df.repartition(partitions).agg(rounded_sum(F.col("v"), places).alias("s")).first().s


@settings(
    max_examples=25,
    deadline=None,
    suppress_health_check=[HealthCheck.function_scoped_fixture],
)
@given(
    st.lists(
        st.decimals(
            min_value=-1_000_000, max_value=1_000_000, places=6, allow_nan=False
        ),
        min_size=1,
        max_size=40,
    )
)
def test_equals_decimal_arithmetic(spark, values):
    assert total(spark, [float(v) for v in values]) == sum(values)


def test_same_for_any_order_and_partitioning(spark):
    rng = random.Random(7)
    values = [rng.randrange(-(10**14), 10**14) / 100 for _ in range(2_000)]
    expected = sum(round(Decimal(v), 6) for v in values)
    for partitions in (1, 7, 40):
        rng.shuffle(values)
        assert total(spark, values, partitions) == expected


def test_small_values_survive_large_ones(spark):
    assert 1e16 + 0.01 - 1e16 == 0
    assert total(spark, [1e16, 0.01, -1e16]) == Decimal("0.01")


def test_total_beyond_the_whole_cents_of_a_double(spark):
    df = spark.range(2_000, numPartitions=4).select(F.lit(90_000_000_000_000.01).alias("v"))
    assert df.agg(rounded_sum(F.col("v"), 6).alias("s")).first().s == (
        round(Decimal(90_000_000_000_000.01), 6) * 2_000
    )


def test_nulls_are_skipped(spark):
    assert total(spark, [1.5, None, 2.25]) == Decimal("3.75")


def test_no_values_give_null(spark):
    assert total(spark, [None, None]) is None
    assert total(spark, []) is None


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield request.param
    spark.conf.set("spark.sql.ansi.enabled", before)


@pytest.mark.parametrize("bad", [math.nan, math.inf, -math.inf, 2.0**63])
def test_values_that_cannot_be_added_exactly_raise(spark, ansi, bad):
    with pytest.raises(SparkRuntimeException, match="rounded_sum"):
        total(spark, [1.0, bad])


def test_same_total_in_both_ansi_modes(spark, ansi):
    assert total(spark, [-0.25, 1e12, None, 0.1]) == Decimal("999999999999.85")


@pytest.mark.parametrize("partitions", [1, 2])
def test_sums_that_are_too_large_raise(spark, ansi, partitions):
    with pytest.raises(SparkRuntimeException, match="rounded_sum"):
        total(spark, [9e18, 9e18], partitions)


def test_null_groups_stay_null_in_both_ansi_modes(spark, ansi):
    assert total(spark, [None, None], 2) is None


def test_small_values_count_if_the_places_are_asked_for(spark):
    df = spark.range(1_000_000).select(F.lit(4e-7).alias("v"))
    assert df.agg(rounded_sum(F.col("v"), 7).alias("s")).first().s == Decimal("0.4")
    assert df.agg(rounded_sum(F.col("v"), 6).alias("s")).first().s == 0


def test_places_out_of_range_are_refused():
    with pytest.raises(ValueError):
        rounded_sum(F.lit(1.0), 16)
