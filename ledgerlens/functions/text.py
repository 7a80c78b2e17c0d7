"""Cleaning expressions of the staging layer."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def normalise_case(text: Column) -> Column:
    return F.lower(text)


def negative_to_null(number: Column) -> Column:
    return F.when(number >= 0, number)
