"""Seed tables and the calendar."""

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.constants import FX_TO_USD
from ledgerlens.functions import year_month


def fx_rates(spark: SparkSession, rates: dict | None = None) -> DataFrame:
    """One row per currency; the dict guarantees that a currency appears once."""
    rows = list((rates or FX_TO_USD).items())
    return spark.createDataFrame(rows, "currency string, rate_to_usd decimal(10,4)")


def _calendar(days: DataFrame) -> DataFrame:
    day = F.col("date_actual")
    return days.select(
        day,
        F.month(day).alias("month_number"),
        F.quarter(day).alias("quarter_number"),
        F.year(day).alias("year_number"),
        year_month(day).alias("year_month"),
    )


def date_spine(
    spark: SparkSession,
    start: dt.date = dt.date(2024, 1, 1),
    end: dt.date = dt.date(2024, 12, 31),
) -> DataFrame:
    """One row per day from ``start`` to ``end`` with its month, quarter, year and YYYY-MM."""
    days = F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date_actual")
    return _calendar(spark.range(1).select(days))


def date_spine_over(df: DataFrame, column: str) -> DataFrame:
    """The spine between the first and last date found in ``column``."""
    span = df.agg(F.min(column).alias("first"), F.max(column).alias("last"))
    days = span.where(F.col("first").isNotNull()).select(
        F.explode(F.sequence("first", "last")).alias("date_actual")
    )
    return _calendar(days)
