"""Anomaly reports: statistical, business-logic and behavioural. Anomalies are flagged, not fixed."""

import datetime as dt
from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import days_between, half_up, mean_of_parts, ratio
from ledgerlens.operators.days import events_on
from ledgerlens.operators.ordered import day_rank, with_previous
from ledgerlens.operators.rules import classify
from ledgerlens.operators.statistics import baseline_ratio, sigma_outliers, sigma_outliers_by
from ledgerlens.sources.schemas import SEQ


# --- statistical --------------------------------------------------------------------------------
def mrr_sigma_by_plan(lifecycles: DataFrame, k: float = 2) -> DataFrame:
    """MRR above the limit of its own plan."""
    found = sigma_outliers_by(lifecycles, "mrr_amount", "plan_type", F.col("mrr_amount") > 0, k)
    return found.select(
        "subscription_id", "account_id", "plan_type", "mrr_amount",
        half_up(F.col("_stats.mean"), 2).alias("plan_avg_mrr"),
        half_up(F.col("_stats.sd"), 2).alias("plan_stddev_mrr"),
        half_up(F.col("_stats.limit"), 2).alias("plan_upper_threshold"),
        F.lit(C.ISSUE_PLAN_SIGMA).alias("issue"),
    )


def _metric_sigma(events: DataFrame, metric: str, short: str, issue: str, k: float) -> DataFrame:
    found = sigma_outliers(events, metric, F.col(metric) > 0, k)
    return found.select(
        "event_id", "account_id", "event_date", metric,
        half_up(F.col("_stats.mean"), 2).alias(f"avg_{short}"),
        half_up(F.col("_stats.sd"), 2).alias(f"stddev_{short}"),
        half_up(F.col("_stats.limit"), 2).alias("upper_threshold"),
        F.lit(issue).alias("issue"),
    )


def api_sigma(events: DataFrame, k: float = 2) -> DataFrame:
    return _metric_sigma(events, "api_calls", "api_calls", C.ISSUE_API_SIGMA, k)


def users_sigma(events: DataFrame, k: float = 2) -> DataFrame:
    return _metric_sigma(events, "active_users", "active_users", C.ISSUE_USERS_SIGMA, k)


def _spike_drop(
    events: DataFrame, days: DataFrame, metric: str, rows: str, average: str, spike: str, drop: str
) -> DataFrame:
    found = baseline_ratio(events, days, metric, rows)
    return found.select(
        "event_id", "account_id", "event_date", metric,
        mean_of_parts(F.col("_sum"), F.col("_n"), 2).alias(average),
        ratio(F.col(metric) * F.col("_n"), F.col("_sum"), 2).alias("ratio_to_avg"),
        classify([(F.col("_high"), spike), (F.col("_low"), drop)]).alias("issue"),
    )


def api_spike_drop(events: DataFrame, days: DataFrame) -> DataFrame:
    """api_calls more than twice, or less than a quarter of, the account's own average.

    The averages come from ``days``, the events added up per account and day.
    """
    return _spike_drop(
        events, days, "api_calls", "_count_api_calls", "account_avg_api_calls",
        C.ISSUE_API_SPIKE, C.ISSUE_API_DROP,
    )


def users_spike_drop(events: DataFrame, days: DataFrame) -> DataFrame:
    """The same for active_users, against the average of the positive values."""
    return _spike_drop(
        events, days, "active_users", "_positive_active_users", "account_avg_users",
        C.ISSUE_USER_SPIKE, C.ISSUE_USER_DROP,
    )


# --- business logic -----------------------------------------------------------------------------
def end_before_start(lifecycles: DataFrame) -> DataFrame:
    start, end = F.col("start_date"), F.col("end_date")
    return lifecycles.where(end < start).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date", "end_date",
        days_between(start, end).alias("days_difference"),
        F.lit(C.ISSUE_INVERTED).alias("issue"),
    )


def terminal_without_end(
    lifecycles: DataFrame, terminal: Sequence[str] = ("churned", "cancelled")
) -> DataFrame:
    open_end = F.col("status").isin(*terminal) & F.col("end_date").isNull()
    return lifecycles.where(open_end).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date", "end_date",
        F.lit(C.ISSUE_TERMINAL).alias("issue"),
    )


def active_past_end(lifecycles: DataFrame, as_of: dt.date) -> DataFrame:
    passed = (F.col("status") == "active") & (F.col("end_date") < F.lit(as_of))
    return lifecycles.where(passed).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date", "end_date",
        F.lit(C.ISSUE_ACTIVE_PAST_END).alias("issue"),
    )


def expired_trials(lifecycles: DataFrame, as_of: dt.date) -> DataFrame:
    passed = (F.col("status") == "trial") & (F.col("trial_end_date") < F.lit(as_of))
    return lifecycles.where(passed).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date", "trial_end_date",
        days_between(F.col("trial_end_date"), F.lit(as_of)).alias("days_since_trial_ended"),
        F.lit(C.ISSUE_EXPIRED_TRIAL).alias("issue"),
    )


def zero_users_activity(events: DataFrame) -> DataFrame:
    busy = (F.col("api_calls") > 0) | (F.col("session_duration_mins") > 0)
    return events.where((F.col("active_users") == 0) & busy).select(
        "event_id", "account_id", "event_date", "active_users", "api_calls", "session_duration_mins",
        F.lit(C.ISSUE_ZERO_USERS).alias("issue"),
    )


# --- patterns -----------------------------------------------------------------------------------
def all_zero_events(
    events: DataFrame,
    columns: Sequence[str] = ("active_users", "api_calls", "storage_gb", "session_duration_mins"),
) -> DataFrame:
    return events.where(reduce(and_, [F.col(c) == 0 for c in columns])).select(
        "event_id", "account_id", "event_date", *columns, F.lit(C.ISSUE_ALL_ZERO).alias("issue")
    )


def high_discount(lifecycles: DataFrame, pct: int = C.HIGH_DISCOUNT_PCT) -> DataFrame:
    """Discounts above ``pct`` with the MRR left and the MRR given away."""
    share = F.col("discount_percentage") * F.lit("0.01").cast("decimal(3,2)")
    return lifecycles.where(F.col("discount_percentage") > pct).select(
        "subscription_id", "account_id", "plan_type", "status", "customer_segment", "mrr_amount",
        "discount_percentage",
        F.round(F.col("mrr_amount") * (1 - share), 2).alias("effective_mrr"),
        F.round(F.col("mrr_amount") * share, 2).alias("revenue_lost"),
        F.lit(C.ISSUE_DISCOUNT).alias("issue"),
    )


def start_date_clusters(lifecycles: DataFrame, more_than: int = 2) -> DataFrame:
    """Lifecycles whose start date is shared by more than ``more_than``, one row each, with their number."""
    totals = (
        lifecycles.groupBy(F.col("start_date").alias("_date"))
        .agg(F.count(F.lit(1)).alias("subscriptions_started"))
        .where(F.col("subscriptions_started") > more_than)
    )
    return lifecycles.join(totals, F.col("start_date").eqNullSafe(F.col("_date"))).select(
        "start_date", "subscriptions_started", "subscription_id", F.lit(C.ISSUE_START_CLUSTER).alias("issue")
    )


def drop_to_zero(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events at zero whose account was active at its preceding event.

    Only account-days with an event at zero are looked up. Within such a day the preceding event is
    found among the day's own, which are split into cells of sequence numbers, so that a day with many
    events is not one task; for a day's first event it is the last one of the account's previous day.
    """
    columns = ["api_calls", "active_users"]
    concerned = days.where(F.col("_zero_rows") > 0)
    narrow = events.select("event_id", "account_id", "event_date", "active_users", "api_calls", SEQ)
    found = events_on(narrow, concerned.select("account_id", "event_date", "_day_before"))
    at_zero = (F.col("api_calls") == 0) | (F.col("active_users") == 0)
    within = with_previous(
        found, ["account_id"], day_rank(F.col("event_date")), columns,
        out="_same_day", keep=at_zero, across=False,
    )
    before = within.withColumn("_before", F.coalesce("_same_day", "_day_before"))
    was_active = (F.col("_before.api_calls") > 0) | (F.col("_before.active_users") > 0)
    return before.where(was_active).select(
        "event_id", "account_id", "event_date", "active_users", "api_calls",
        F.col("_before.active_users").alias("prev_active_users"),
        F.col("_before.api_calls").alias("prev_api_calls"),
        F.lit(C.ISSUE_DROP_TO_ZERO).alias("issue"),
    )


def long_pending(lifecycles: DataFrame, as_of: dt.date, max_days: int = C.PENDING_DAYS) -> DataFrame:
    waited = days_between(F.col("start_date"), F.lit(as_of))
    return lifecycles.where((F.col("status") == "pending") & (waited > max_days)).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date",
        waited.alias("days_pending"), F.lit(C.ISSUE_PENDING).alias("issue"),
    )


def event_date_clusters(days: DataFrame, k: int = 2) -> DataFrame:
    """Days with more than k times the mean daily events; the mean shown is that of the days found.

    ``days`` holds events added up per account and day; the windows see one row per day.
    """
    daily = days.groupBy("event_date").agg(
        F.sum("_rows").alias("events_on_day"), F.count("account_id").alias("distinct_accounts")
    )
    every = Window.partitionBy()
    of_all = F.struct(
        F.sum("events_on_day").over(every).alias("events"), F.count(F.lit(1)).over(every).alias("days")
    )
    found = daily.withColumn("_all", of_all).where(
        F.col("events_on_day") * F.col("_all.days") > k * F.col("_all.events")
    )
    found_mean = mean_of_parts(
        F.sum("events_on_day").over(every), F.count("events_on_day").over(every), 1
    )
    return found.select(
        "event_date", "events_on_day", "distinct_accounts",
        found_mean.alias("avg_events_per_day"),
        F.lit(C.ISSUE_EVENT_CLUSTER).alias("issue"),
    )
