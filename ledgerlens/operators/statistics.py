"""Mean and deviation tests. Population statistics travel as one-row scalar subqueries."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.days import events_on


def spread(value: Column, k: float = 2) -> Column:
    """Struct of mean, sample deviation and the limit mean + k deviations, as an aggregate."""
    mean = F.sum(value).cast("double") / F.nullif(F.count(value), F.lit(0))
    sd = F.stddev_samp(value.cast("double"))
    return F.struct(mean.alias("mean"), sd.alias("sd"), (mean + k * sd).alias("limit"))


def sigma_outliers(
    df: DataFrame,
    value: str,
    population: Column,
    k: float = 2,
    also: Column | None = None,
) -> DataFrame:
    """Rows above mean + k deviations of the ``population`` rows, with ``_stats`` attached.

    ``also`` admits further rows whatever their distance from the mean.
    """
    stats = df.where(population).agg(spread(F.col(value), k).alias("stats")).scalar()
    above = F.col(value) > F.col("_stats.limit")
    return df.withColumn("_stats", stats).where(above if also is None else above | also)


def sigma_outliers_by(
    df: DataFrame, value: str, by: str, population: Column, k: float = 2
) -> DataFrame:
    """Rows above the limit of their own group, with ``_stats`` attached.

    Adaptive execution broadcasts the statistics where they turn out small and splits hot groups where not.
    """
    stats = df.where(population).groupBy(by).agg(spread(F.col(value), k).alias("_stats"))
    return df.join(stats, by).where(F.col(value) > F.col("_stats.limit"))


def baseline_ratio(
    events: DataFrame, days: DataFrame, metric: str, rows: str, high: str = "2", low: str = "0.25"
) -> DataFrame:
    """Events far from their own account's mean, with ``_sum`` and ``_n`` behind that mean.

    ``rows`` names the account-day count the mean divides by. Comparisons multiply out the division
    (value * count against factor * sum), so they are exact. The same test on a day's smallest and
    largest value tells which account-days hold such events at all; only those are looked up.
    """
    top, bottom = F.lit(high).cast("decimal(6,2)"), F.lit(low).cast("decimal(6,2)")

    def above(value: str) -> Column:
        return F.col(value) * F.col("_n") > F.col("_sum") * top

    def below(value: str) -> Column:
        return F.col(value) * F.col("_n") < F.col("_sum") * bottom

    concerned = (
        days.where(F.col("account_id").isNotNull())
        .withColumn("_sum", F.col(f"_account_sum_{metric}"))
        .withColumn("_n", F.col(f"_account{rows}"))
        .where((F.col("_n") > 0) & (above(f"_max_{metric}") | below(f"_min_{metric}")))
        .select("account_id", "event_date", "_sum", "_n")
    )
    return (
        events_on(events, concerned)
        .withColumn("_high", above(metric))
        .withColumn("_low", below(metric))
        .where(F.col("_high") | F.col("_low"))
    )
