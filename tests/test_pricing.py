from __future__ import annotations

import re
from datetime import datetime
from decimal import Decimal
from fractions import Fraction

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from tarn.operators import summarize_pricing
from tarn.plans import PRICING_SUMMARY_SQL, pricing_summary
from tarn.sources import read_table
from tests.conftest import TESTDATA, rows_by_name

CUTOFF = datetime(2000, 9, 2)
SCHEMA = (
    "l_returnflag string, l_linestatus string, l_quantity double,"
    " l_extendedprice double, l_discount double, l_shipdate timestamp_ntz"
)


def lines(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


def plan_text(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(
            "formatted"
        )
    )


def test_totals_of_a_group(spark):
    day = datetime(1999, 1, 1)
    df = lines(
        spark,
        ("A", "F", 3.0, 100.10, 0.10, day),
        ("A", "F", 4.0, 200.00, 0.00, day),
        ("A", "F", 0.5, 50.00, 0.05, day),
        ("N", "O", 1.0, -20.00, 0.50, day),
    )
    assert sorted(map(tuple, summarize_pricing(df, CUTOFF).collect())) == [
        ("A", "F", Decimal("7.5"), Decimal("337.59"), Decimal("0.05"), 3),
        ("N", "O", Decimal("1"), Decimal("-10.00"), Decimal("0.5"), 1),
    ]


def test_cutoff_is_inclusive_and_undated_lines_are_left_out(spark):
    df = lines(
        spark,
        ("A", "F", 1.0, 10.0, 0.0, CUTOFF),
        ("A", "F", 2.0, 10.0, 0.0, datetime(2000, 9, 2, 0, 0, 1)),
        ("A", "F", 4.0, 10.0, 0.0, None),
    )
    (row,) = summarize_pricing(df, CUTOFF).collect()
    assert (row.sum_qty, row.count_order) == (Decimal("1"), 1)


def test_nulls_group_together_and_drop_out_of_sums(spark):
    day = datetime(1999, 1, 1)
    df = lines(
        spark,
        (None, "F", 1.0, 10.0, None, day),
        (None, "F", None, None, 0.1, day),
        ("A", None, None, None, None, day),
    )
    got = rows_by_name(
        summarize_pricing(df, CUTOFF).columns, summarize_pricing(df, CUTOFF).collect()
    )
    assert got == rows_by_name(
        summarize_pricing(df, CUTOFF).columns,
        [
            (None, "F", Decimal("1"), None, Decimal("0.1"), 2),
            ("A", None, None, None, None, 1),
        ],
    )


def test_no_lines_give_no_groups(spark):
    assert summarize_pricing(lines(spark), CUTOFF).count() == 0


def test_one_group_holding_most_lines(spark, duck, tmp_path):
    hot = F.col("l_linenumber") <= 5
    path = str(tmp_path / "lineitem.parquet")
    (
        read_table(spark, f"{TESTDATA}/sf0.01", "lineitem")
        .withColumn("l_returnflag", F.when(hot, "N").otherwise(F.col("l_returnflag")))
        .withColumn("l_linestatus", F.when(hot, "O").otherwise(F.col("l_linestatus")))
        .repartition(5)
        .write.parquet(path)
    )
    result = pricing_summary(spark, str(tmp_path))
    expected = duck(PRICING_SUMMARY_SQL, lineitem=f"{path}/*.parquet")
    got = rows_by_name(result.columns, result.collect())
    assert got == rows_by_name(expected.columns, expected.fetchall())
    counts = [row.count_order for row in result.collect()]
    assert max(counts) > sum(counts) / 2


@pytest.mark.parametrize("shipdate_type", ["timestamp_ntz", "timestamp", "date"])
def test_filter_and_columns_reach_the_scan(spark, tmp_path, shipdate_type):
    path = str(tmp_path / "lineitem.parquet")
    (
        read_table(spark, f"{TESTDATA}/sf0.001", "lineitem")
        .withColumn("l_shipdate", F.col("l_shipdate").cast(shipdate_type))
        .write.parquet(path)
    )
    plan = plan_text(pricing_summary(spark, str(tmp_path)))
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "LessThanOrEqual(l_shipdate,2000-09-02" in pushed
    read = re.search(r"ReadSchema: struct<(.*)>", plan).group(1)
    assert {column.split(":")[0] for column in read.split(",")} == {
        "l_returnflag",
        "l_linestatus",
        "l_quantity",
        "l_extendedprice",
        "l_discount",
        "l_shipdate",
    }
    got = rows_by_name(*columns_and_rows(pricing_summary(spark, str(tmp_path))))
    same = pricing_summary(spark, f"{TESTDATA}/sf0.001")
    assert got == rows_by_name(*columns_and_rows(same))


def columns_and_rows(df):
    return df.columns, df.collect()


def test_one_shuffle_after_partial_aggregation(spark):
    plan = plan_text(pricing_summary(spark, f"{TESTDATA}/sf0.01"))
    tree = plan.split("\n\n")[0]
    assert re.findall(r"\b(HashAggregate|Exchange|Scan parquet)", tree) == [
        "HashAggregate",
        "Exchange",
        "HashAggregate",
        "Scan parquet",
    ]
    assert not re.search(r"Sort|Join|Python|Window|Single", tree)


@pytest.fixture(params=["true", "false"])
def ansi(spark, request):
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", request.param)
    yield
    spark.conf.set("spark.sql.ansi.enabled", before)


def both_ways(spark, duck, tmp_path, rows):
    """The one group of ``rows`` from Spark and from the SQL."""
    day = datetime(1999, 1, 1)
    path = str(tmp_path / "lineitem.parquet")
    lines(spark, *(("A", "F", 1.0, price, disc, day) for price, disc in rows)).write.parquet(path)
    (got,) = pricing_summary(spark, str(tmp_path)).collect()
    (expected,) = duck(PRICING_SUMMARY_SQL, lineitem=f"{path}/*.parquet").fetchall()
    assert tuple(got) == expected
    return got


@pytest.mark.parametrize(
    ("rows", "disc_price", "mean"),
    [
        ([(100.0, 0.05)] * 198 + [(100.0, 0.04)], 18906.0, 0.0499),
        ([(100.0, 0.05)] * 199 + [(100.0, 0.04)], 19001.0, 0.05),
        ([(10.005, 0.0)] * 3, 30.02, 0.0),
        ([(100.0, 0.125)] * 3, 262.5, 0.125),
    ],
)
def test_values_at_rounding_steps(spark, duck, tmp_path, ansi, rows, disc_price, mean):
    got = both_ways(spark, duck, tmp_path, rows)
    assert (got.sum_disc_price, got.avg_disc) == (disc_price, mean)


def test_discounts_too_large_for_the_average_raise(spark, ansi):
    df = lines(spark, ("A", "F", 1.0, 1.0, 1e16, datetime(1999, 1, 1)))
    with pytest.raises(SparkRuntimeException, match="summarize_pricing"):
        summarize_pricing(df, CUTOFF).collect()


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(
        st.tuples(
            st.sampled_from("AN"),
            st.one_of(st.none(), st.integers(-(10**9), 10**9)),
            st.one_of(st.none(), st.integers(0, 125)),
        ),
        min_size=1,
        max_size=60,
    )
)
def test_equals_decimal_arithmetic(spark, rows):
    """Prices in tenths of a cent and discounts in thousandths, against fractions."""
    day = datetime(1999, 1, 1)
    df = lines(
        spark,
        *((f, "F", 1.0, p if p is None else p / 1000, d if d is None else d / 1000, day) for f, p, d in rows),
    )
    for got in summarize_pricing(df, CUTOFF).collect():
        mine = [(p, d) for f, p, d in rows if f == got.l_returnflag]
        prices = [Fraction(p, 1000) * (1 - Fraction(d, 1000)) for p, d in mine if None not in (p, d)]
        discounts = [Fraction(d, 1000) for _, d in mine if d is not None]
        assert got.sum_disc_price == (half_up(sum(prices), 2) if prices else None)
        assert got.avg_disc == (half_up(sum(discounts) / len(discounts), 4) if discounts else None)


def half_up(value: Fraction, places: int) -> Decimal:
    scaled = abs(value) * 10**places
    whole = int(scaled + Fraction(1, 2))
    return Decimal(whole if value >= 0 else -whole).scaleb(-places)
