"""Rounded arithmetic on exact decimals.

Averages divide an exact decimal sum by its count: the result does not depend on the order in which
partitions are merged, and at least 12 decimals are kept before the reported rounding.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(numerator: Column, denominator: Column, digits: int) -> Column:
    """numerator / denominator, rounded half up; NULL where the denominator is 0."""
    divisor = F.nullif(denominator, F.lit(0).cast("int"))
    return F.round(numerator.cast("decimal(28,4)") / divisor, digits)


def mean_of_parts(total: Column, count: Column, digits: int) -> Column:
    """Average from a sum and a non-null count that were added up beforehand."""
    return ratio(total, count, digits)


def mean(value: Column, digits: int) -> Column:
    """AVG as an aggregate, exact until the reported rounding."""
    return mean_of_parts(F.sum(value), F.count(value), digits)


def half_up(value: Column, digits: int) -> Column:
    """Round a DOUBLE half away from zero, by way of a 10-decimal value."""
    return F.round(value.cast("decimal(28,10)"), digits)
