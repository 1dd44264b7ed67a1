"""Pricing summary of the lines shipped by 2 September 2000."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarn.operators import summarize_pricing
from tarn.sources import read_table

SHIPPED_BY = datetime(2000, 9, 2)

# Written apart from the plan: its own date, and the precision that the operator states.
PRICING_SUMMARY_SQL = """
SELECT l_returnflag,
       l_linestatus,
       CAST(sum(CAST(l_quantity AS DECIMAL(18, 6))) AS DOUBLE) AS sum_qty,
       CAST(round(sum(CAST(l_extendedprice AS DECIMAL(18, 6))
                      * (1 - CAST(l_discount AS DECIMAL(18, 6)))), 2)
            AS DOUBLE) AS sum_disc_price,
       CAST(round(CAST(sum(CAST(l_discount AS DECIMAL(18, 6))) AS DECIMAL(38, 22))
                  / count(l_discount), 4) AS DOUBLE) AS avg_disc,
       count(*) AS count_order
FROM lineitem
WHERE l_shipdate <= TIMESTAMP '2000-09-02 00:00:00'
GROUP BY l_returnflag, l_linestatus
"""


def pricing_summary(spark: SparkSession, folder: str) -> DataFrame:
    """``summarize_pricing`` over ``lineitem``, its decimals shown as doubles."""
    summary = summarize_pricing(read_table(spark, folder, "lineitem"), SHIPPED_BY)
    return summary.select(
        "l_returnflag",
        "l_linestatus",
        F.col("sum_qty").cast("double").alias("sum_qty"),
        F.col("sum_disc_price").cast("double").alias("sum_disc_price"),
        F.col("avg_disc").cast("double").alias("avg_disc"),
        "count_order",
    )
