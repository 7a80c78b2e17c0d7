"""Product-market fit: usage by segment and the most engaged accounts."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import mean
from ledgerlens.operators.ordered import with_tile
from ledgerlens.operators.rules import not_flagged
from ledgerlens.plans.health import features_adopted
from ledgerlens.plans.kpi import all_features


def _trusted(fct: DataFrame) -> DataFrame:
    trusted = not_flagged(F.col("data_quality_flag"), C.USAGE_OUTLIER_FLAGS)
    return fct.where(F.col("subscription_id").isNotNull() & trusted)


def usage_by_segment(fct: DataFrame) -> DataFrame:
    """Average engagement per customer segment."""
    rows = _trusted(fct).where(F.col("customer_segment").isNotNull())
    return rows.groupBy("customer_segment").agg(
        F.count(F.lit(1)).alias("accounts"),
        mean(F.col("avg_active_users"), 1).alias("avg_active_users"),
        mean(F.col("avg_session_duration_mins"), 1).alias("avg_session_mins"),
        mean(F.col("avg_integrations_used"), 1).alias("avg_integrations"),
        mean(F.col("usage_event_count"), 1).alias("avg_usage_events"),
        mean(all_features(), 1).alias("avg_total_feature_usage"),
        mean(features_adopted(), 2).alias("avg_features_adopted"),
    )


def power_quartile(fct: DataFrame) -> DataFrame:
    """Live, trusted lifecycles with their usage quartile, 4 being the most engaged.

    The measure is users + session minutes / 60 + events. Both averages carry one decimal, so 600
    times the measure is a whole number, which orders the rows exactly.
    """
    live = _trusted(fct).where(F.col("status").isin("active", "trial"))
    users = F.coalesce("avg_active_users", F.lit(0)) * 600
    session = F.coalesce("avg_session_duration_mins", F.lit(0)) * 10
    units = (users + session + F.col("usage_event_count") * 600).cast("long")
    return with_tile(live, units, tiles=4, out="usage_quartile", coarse=600)


def power_users(fct: DataFrame) -> DataFrame:
    """The top usage quartile."""
    return power_quartile(fct).where(F.col("usage_quartile") == 4).select(
        "account_id", "plan_type", "customer_segment", "status", "avg_active_users",
        "avg_session_duration_mins", features_adopted().alias("features_adopted"), "usage_event_count",
    )


def power_user_profile(fct: DataFrame) -> DataFrame:
    """The top quartile counted by segment and plan."""
    top = power_quartile(fct).where(F.col("usage_quartile") == 4)
    return top.groupBy("customer_segment", "plan_type").agg(F.count(F.lit(1)).alias("power_users"))
