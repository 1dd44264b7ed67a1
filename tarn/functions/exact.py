"""Sums of doubles that do not depend on the order of addition."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Sums are carried as whole parts and fractions, each a bigint.
MOST_PLACES = 15


def rounded_sum(value: Column, places: int) -> Column:
    """Aggregate: the exact sum of a double column, each value rounded first.

    Every value is rounded to ``places`` decimal places, 0 to 15, half to even;
    the rounded values are then added without any error. The result is
    ``decimal(38, places)``. A plain ``sum`` over doubles drifts with the number
    of rows and changes with the order in which partial results meet. Here the
    whole part and the fraction of each value are added as ``bigint``, which is
    exact in any order and stays inside whole-stage codegen; decimals appear
    only once per group, at the end.

    Nulls are skipped and a group without values gives null, as with ``sum``.
    NaN, infinity and values from 2**63 on raise an error, and so does a sum of
    whole parts from 2**63 on, or one of fractions, which holds at least
    ``9.2e18 / 10**places`` rows per group: 9.2e12 with six places. All of this
    is the same with Spark's ANSI mode on and off.
    """
    if not 0 <= places <= MOST_PLACES:
        raise ValueError(f"places must be 0 to {MOST_PLACES}")
    fits = value.isNull() | (F.abs(value) < 2.0**63)
    value = F.when(fits, value).otherwise(
        F.raise_error(F.lit("rounded_sum: value is not finite or too large"))
    )
    whole = F.floor(value)
    fraction = F.rint((value - whole) * 10**places).cast("bigint")
    parts = [F.try_sum(part) for part in (whole, fraction)]
    whole_sum, fraction_sum = (
        F.when(part.isNotNull() | (F.count(value) == 0), part).otherwise(
            F.raise_error(F.lit("rounded_sum: the sum is too large"))
        )
        for part in parts
    )
    return (
        whole_sum.cast("decimal(20,0)")
        + fraction_sum.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-places))
    ).cast(f"decimal(38,{places})")
