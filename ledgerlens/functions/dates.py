"""Date expressions. Text dates are day-first unless their second part cannot be a month."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens.constants import DATE_DAY_FIRST, DATE_MONTH_FIRST


def month_first(text: Column) -> Column:
    """True where the second part of a slashed date exceeds 12, so the first must be the month."""
    return F.split_part(text, F.lit("/"), F.lit(2)).try_cast("int") > 12


def parse_mixed_date(text: Column) -> Column:
    """DATE from slashed text; unparseable or missing text gives NULL."""
    return F.when(month_first(text), F.try_to_date(text, DATE_MONTH_FIRST)).otherwise(
        F.try_to_date(text, DATE_DAY_FIRST)
    )


def days_between(start: Column, end: Column) -> Column:
    """Whole days from ``start`` to ``end`` as an INT."""
    return F.date_diff(end, start)


def year_month(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")
