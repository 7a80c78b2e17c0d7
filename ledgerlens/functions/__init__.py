"""Column expressions shared by the operators."""

from ledgerlens.functions.dates import days_between, month_first, parse_mixed_date, year_month
from ledgerlens.functions.numbers import half_up, mean, mean_of_parts, ratio
from ledgerlens.functions.text import blank_to_null, negative_to_null, normalise_case

__all__ = [
    "blank_to_null",
    "days_between",
    "half_up",
    "mean",
    "mean_of_parts",
    "month_first",
    "negative_to_null",
    "normalise_case",
    "parse_mixed_date",
    "ratio",
    "year_month",
]
