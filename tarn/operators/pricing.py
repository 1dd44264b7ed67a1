"""Pricing roll-up of order lines."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.functions import rounded_sum

# Decimal places to which each value is rounded before it is added.
PLACES = 6

def summarize_pricing(lineitem: DataFrame, shipped_by: datetime) -> DataFrame:
    """Totals per return flag and line status of lines shipped by a date.

    The cutoff takes the type of ``l_shipdate``, so that the comparison stays
    on the bare column and reaches the scan. Every aggregate has a partial
    form: the shuffle carries one row per group and map task, whatever share
    of the lines one group holds. Every value is rounded to ``PLACES`` places and
    the sums are exact; the average is rounded once. It raises an error if the
    discounts of a group add up to 1e16 or more.
    """
    shipdate_type = lineitem.schema["l_shipdate"].dataType
    cutoff = F.lit(shipped_by.isoformat(sep=" ")).cast(shipdate_type)
    discounted = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    # As decimal(22,6) the sum leaves the quotient 22 places, so it is rounded once.
    total = rounded_sum(F.col("l_discount"), PLACES)
    fits = total.isNull() | (F.abs(total) < 10**16)
    narrow = F.when(fits, total).otherwise(
        F.raise_error(F.lit("summarize_pricing: the discounts add up to too much"))
    )
    mean = narrow.cast("decimal(22,6)") / F.count("l_discount")
    return (
        lineitem.filter(F.col("l_shipdate") <= cutoff)
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            rounded_sum(F.col("l_quantity"), PLACES).alias("sum_qty"),
            F.round(rounded_sum(discounted, PLACES), 2).alias("sum_disc_price"),
            F.round(mean, 4).alias("avg_disc"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )
