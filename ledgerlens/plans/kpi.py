"""Revenue, churn and engagement KPIs over the subscription fact and the account-days of usage.

Monthly figures never pair every month with every row: a lifecycle gives one event where it begins and
one where it is over, and running sums over an account's months, and then over the months, add them up.
"""

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import mean, mean_of_parts, ratio, year_month
from ledgerlens.operators.rules import classify, not_flagged


class Spine:
    """The calendar range that reports cover, both ends included."""

    def __init__(self, start: dt.date = dt.date(2024, 1, 1), end: dt.date = dt.date(2024, 12, 31)):
        self.start, self.end = start, end
        self.last_month = end.replace(day=1)
        month_start = start.replace(day=1)
        if start.day > 1:
            month_start = (month_start + dt.timedelta(days=32)).replace(day=1)
        self.first_month = month_start

    def days(self, like: DataFrame) -> DataFrame:
        days = F.explode(F.sequence(F.lit(self.start), F.lit(self.end)))
        return like.sparkSession.range(1).select(days.alias("day"))

    def months(self, like: DataFrame) -> DataFrame:
        months = month_range(F.lit(self.first_month), F.lit(self.last_month))
        return like.sparkSession.range(1).select(F.explode(months).alias("month"))

    def clipped(self, first: Column, last: Column) -> Column:
        """The month starts from ``first`` to ``last`` that lie in the spine."""
        inside = month_range(
            F.greatest(first, F.lit(self.first_month)), F.least(last, F.lit(self.last_month))
        )
        return F.when(first.isNotNull() & last.isNotNull(), inside).otherwise(no_months())


def no_months() -> Column:
    return F.array().cast("array<date>")


def month_range(first: Column, last: Column) -> Column:
    """Array of month starts; empty where ``first`` is after ``last``."""
    months = F.sequence(first, last, F.expr("interval 1 month"))
    return F.when(first <= last, months).otherwise(no_months())


def _month(day: Column) -> Column:
    return F.trunc(day, "MM")


def _revenue_clean() -> Column:
    return not_flagged(F.col("data_quality_flag"), C.REVENUE_FLAGS)


def _live_revenue(fct: DataFrame) -> DataFrame:
    return fct.where((F.col("status") == "active") & _revenue_clean())


# --- sweep over months --------------------------------------------------------------------------
def _swept(lifecycles: DataFrame, spine: Spine, sums: list[str]) -> DataFrame:
    """Per spine month, what lies over it: ``lifecycles``, ``accounts`` (distinct) and the named sums.

    ``lifecycles`` have account_id, ``first`` and ``last`` month. Each gives two events, one that opens its
    first spine month and one that closes the month after its last, so rows do not grow with the spine.
    An account's events are added up by month, and running sums tell in which months it turns live or
    not; the months' own running sums see one row per month. A sum is null where nothing is known.
    """
    first = F.greatest("first", F.lit(spine.first_month))
    last = F.least("last", F.lit(spine.last_month))
    steps = F.array(
        F.struct(first.alias("month"), F.lit(1).alias("step")),
        F.struct(F.add_months(last, 1).alias("month"), F.lit(-1).alias("step")),
    )
    known = F.col("first").isNotNull() & F.col("last").isNotNull()
    events = lifecycles.where(known & (first <= last)).select("account_id", *sums, F.inline(steps))
    signed = [F.sum(F.col(c) * F.col("step")).alias(c) for c in sums]
    counted = [F.sum(F.when(F.col(c).isNotNull(), F.col("step"))).alias(f"_n_{c}") for c in sums]
    by_account = events.groupBy("account_id", "month").agg(F.sum("step").alias("step"), *signed, *counted)
    so_far = Window.partitionBy("account_id").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    live = F.sum("step").over(so_far)
    turned = (live > 0).cast("int") - (live - F.col("step") > 0).cast("int")
    turns = by_account.withColumn("_turned", F.when(F.col("account_id").isNotNull(), turned))
    added = ["step", "_turned", *sums, *[f"_n_{c}" for c in sums]]
    by_month = turns.groupBy("month").agg(*[F.sum(c).alias(c) for c in added])
    every = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    running = spine.months(lifecycles).join(by_month, "month", "left").select(
        "month", *[F.coalesce(F.sum(c).over(every), F.lit(0)).alias(c) for c in added]
    )
    return running.select(
        "month", F.col("step").alias("lifecycles"), F.col("_turned").alias("accounts"),
        *[F.when(F.col(f"_n_{c}") > 0, F.col(c)).alias(c) for c in sums],
    )


# --- revenue ------------------------------------------------------------------------------------
def monthly_mrr(fct: DataFrame, spine: Spine) -> DataFrame:
    """Per month start: accounts and MRR of the lifecycles that cover it and are active today."""
    start, end = F.col("start_date"), F.col("end_date")
    covers_start = F.when(_month(start) == start, start).otherwise(F.add_months(_month(start), 1))
    last = F.when(end.isNull(), F.lit(spine.last_month)).otherwise(_month(end))
    covering = fct.where((F.col("status") == "active") & start.isNotNull()).select(
        "account_id",
        F.col("effective_mrr_usd").alias("_all"),
        F.when(_revenue_clean(), F.col("effective_mrr_usd")).alias("_clean"),
        covers_start.alias("first"), last.alias("last"),
    )
    return _swept(covering, spine, ["_clean", "_all"]).where(F.col("lifecycles") > 0).select(
        year_month(F.col("month")).alias("year_month"),
        F.col("accounts").alias("active_accounts"),
        F.round("_clean", 2).alias("mrr_usd_clean"),
        F.round("_all", 2).alias("mrr_usd_all_rows"),
    )


def mrr_growth(fct: DataFrame, spine: Spine) -> DataFrame:
    """Month-over-month change of clean MRR; the window sees one row per spine month."""
    now = F.col("mrr_usd_clean")
    previous = F.lag(now).over(Window.orderBy("year_month"))
    months = monthly_mrr(fct, spine).select("year_month", now, previous.alias("prev_month_mrr"))
    change = (now - F.col("prev_month_mrr")).cast("decimal(26,2)") * 100
    return months.withColumn("mrr_growth_pct", ratio(change, F.col("prev_month_mrr").cast("decimal(28,2)"), 2))


def arpa(fct: DataFrame) -> DataFrame:
    """Average revenue per active account."""
    total, accounts = F.sum("effective_mrr_usd"), F.count_distinct("account_id")
    return _live_revenue(fct).agg(
        accounts.alias("active_accounts"),
        F.round(total, 2).alias("total_mrr_usd"),
        ratio(total, accounts, 2).alias("arpa_usd"),
    )


def revenue_by_plan_segment(fct: DataFrame) -> DataFrame:
    return _live_revenue(fct).groupBy("plan_type", "customer_segment").agg(
        F.count_distinct("account_id").alias("account_count"),
        F.round(F.sum("effective_mrr_usd"), 2).alias("total_effective_mrr_usd"),
        mean(F.col("effective_mrr_usd"), 2).alias("avg_effective_mrr_usd"),
    )


# --- churn --------------------------------------------------------------------------------------
def _live(fct: DataFrame, spine: Spine, sums: list[str]) -> DataFrame:
    """Per spine month, the lifecycles that were live at its start."""
    start, end = F.col("start_date"), F.col("end_date")
    last = F.when(end.isNull(), F.lit(spine.last_month)).otherwise(_month(end))
    return _swept(fct.select("account_id", *sums, F.add_months(_month(start), 1).alias("first"), last.alias("last")), spine, sums)


def _churned(fct: DataFrame) -> DataFrame:
    """Lifecycles that churned, with the month of their end."""
    return fct.where((F.col("status") == "churned") & F.col("end_date").isNotNull()).withColumn("month", _month(F.col("end_date")))


def logo_churn(fct: DataFrame, spine: Spine) -> DataFrame:
    """Accounts live at each month start, accounts churned within the month, and their share."""
    usable = fct.where(not_flagged(F.col("data_quality_flag"), [C.INVERTED]) & F.col("account_id").isNotNull())
    lost = _churned(usable).select("month", "account_id").distinct().groupBy("month").agg(F.count(F.lit(1)).alias("_churned"))
    live, churned = F.col("accounts"), F.coalesce("_churned", F.lit(0))
    return _live(usable, spine, []).join(lost, "month", "left").select(
        year_month(F.col("month")).alias("year_month"),
        live.alias("active_at_start"),
        churned.alias("churned_in_month"),
        ratio(churned * 100, live, 2).alias("logo_churn_pct"),
    )


def revenue_churn(fct: DataFrame, spine: Spine) -> DataFrame:
    """The same on MRR, without the lifecycles whose MRR or dates cannot be trusted."""
    usable = fct.where(not_flagged(F.col("data_quality_flag"), [*C.REVENUE_FLAGS, C.INVERTED]))
    lost = _churned(usable).groupBy("month").agg(F.sum("effective_mrr_usd").alias("_churned"))
    zero = F.lit(0).cast("decimal(26,2)")
    live = F.coalesce(F.col("effective_mrr_usd").cast("decimal(26,2)"), zero)
    churned = F.coalesce(F.col("_churned").cast("decimal(26,2)"), zero)
    return _live(usable, spine, ["effective_mrr_usd"]).join(lost, "month", "left").select(
        year_month(F.col("month")).alias("year_month"),
        F.round(live, 2).alias("mrr_active_at_start"),
        F.round(churned, 2).alias("mrr_churned"),
        ratio(churned * 100, live, 2).alias("revenue_churn_pct"),
    )


def cohort_retention(fct: DataFrame) -> DataFrame:
    """Lifecycles by start month: how many there are, churned and retained."""
    flag, status = F.col("data_quality_flag"), F.col("status")
    retained = F.count_if(status != "churned")
    cohorts = fct.where(F.col("start_date").isNotNull() & (flag.isNull() | (flag == C.SUSPECT_TRIAL)))
    return cohorts.groupBy(year_month(F.col("start_date")).alias("cohort_month")).agg(
        F.count(F.lit(1)).alias("cohort_size"),
        F.count_if(status == "churned").alias("churned"),
        retained.alias("retained"),
        ratio(retained * 100, F.count(F.lit(1)), 1).alias("retention_pct"),
    )


def churn_by_plan(fct: DataFrame) -> DataFrame:
    usable = F.col("plan_type").isNotNull() & not_flagged(F.col("data_quality_flag"), [C.INVERTED])
    churned = F.count_if(F.col("status") == "churned")
    return fct.where(usable).groupBy("plan_type").agg(
        F.count(F.lit(1)).alias("total_subscriptions"),
        churned.alias("churned_subscriptions"),
        ratio(churned * 100, F.count(F.lit(1)), 2).alias("churn_rate_pct"),
    )


def customer_lifetime(fct: DataFrame, exclude_orphans: bool = False) -> DataFrame:
    """Mean days from first start to last end of accounts that churned and have nothing open.

    Usage rows outside every lifecycle have no end date and so keep their account open, unless
    ``exclude_orphans`` leaves them out.
    """
    rows = fct.where(not_flagged(F.col("data_quality_flag"), [C.INVERTED]))
    if exclude_orphans:
        rows = rows.where(F.col("subscription_id").isNotNull())
    accounts = rows.groupBy("account_id").agg(
        F.date_diff(F.max("end_date"), F.min("start_date")).alias("_days"),
        F.bool_or(F.col("end_date").isNull()).alias("_open"),
        F.bool_or(F.col("status") == "churned").alias("_churned"),
    )
    gone = F.col("_churned") & ~F.col("_open")
    days = F.when(gone, F.col("_days"))
    return accounts.agg(
        F.count_if(gone).alias("churned_customers"),
        mean(days, 1).alias("avg_lifetime_days"),
        mean_of_parts(F.sum(days), F.count(days) * 30, 2).alias("avg_lifetime_months"),
    )


# --- engagement ---------------------------------------------------------------------------------
_PERIODS = {
    "day": ("date_actual", lambda day: day),
    "week": ("week_start", lambda day: F.date_trunc("week", day).cast("date")),
    "month": ("year_month", year_month),
}


def active_units(days: DataFrame, spine: Spine, period: str) -> DataFrame:
    """Distinct accounts and summed daily user maxima per day, week or month of the spine.

    ``days`` holds events added up per account and day. Periods without events report 0. Spiked user
    counts are left out, missing ones kept.
    """
    name, of_day = _PERIODS[period]
    day = F.col("event_date")
    inside = day.between(F.lit(spine.start), F.lit(spine.end)) & (F.col("_unspiked_rows") > 0)
    daily = days.where(inside).select(of_day(day).alias(name), "account_id", "_unspiked_users")
    if period != "day":
        daily = daily.groupBy(name, "account_id").agg(F.sum("_unspiked_users").alias("_unspiked_users"))
    totals = daily.groupBy(name).agg(
        F.count("account_id").alias("_accounts"), F.sum("_unspiked_users").alias("_users")
    )
    periods = spine.days(days).select(of_day(F.col("day")).alias(name)).distinct()
    return periods.join(totals, name, "left").select(
        name,
        F.coalesce("_accounts", F.lit(0)).alias("active_accounts"),
        F.round(F.coalesce("_users", F.lit(0)), 0).alias("active_users"),
    )


def dau(days: DataFrame, spine: Spine) -> DataFrame:
    return active_units(days, spine, "day")


def wau(days: DataFrame, spine: Spine) -> DataFrame:
    return active_units(days, spine, "week")


def mau(days: DataFrame, spine: Spine) -> DataFrame:
    return active_units(days, spine, "month")


def feature_adoption(fct: DataFrame) -> DataFrame:
    """Share of lifecycles with usage that used each feature."""
    used = fct.where(F.col("has_usage") & F.col("subscription_id").isNotNull())
    rows = F.count(F.lit(1))
    shares = [
        ratio(F.count_if(F.col(f"total_feature_{f}_usage") > 0) * 100, rows, 1).alias(f"feature_{f}_pct")
        for f in "abc"
    ]
    return used.agg(rows.alias("subscriptions_with_usage"), *shares)


def all_features() -> Column:
    return (
        F.col("total_feature_a_usage") + F.col("total_feature_b_usage") + F.col("total_feature_c_usage")
    )


def usage_by_tier(fct: DataFrame) -> DataFrame:
    """Average engagement per plan, over lifecycles with usage."""
    used = fct.where(F.col("has_usage") & F.col("plan_type").isNotNull())
    return used.groupBy("plan_type").agg(
        F.count(F.lit(1)).alias("subscriptions"),
        mean(F.col("avg_active_users"), 1).alias("avg_active_users"),
        mean(F.col("total_api_calls"), 0).alias("avg_total_api_calls"),
        mean(F.col("avg_session_duration_mins"), 1).alias("avg_session_mins"),
        mean(F.col("total_projects_created"), 1).alias("avg_projects_created"),
        mean(F.col("avg_integrations_used"), 1).alias("avg_integrations"),
        mean(F.col("total_support_tickets"), 1).alias("avg_support_tickets"),
    )


def usage_vs_retention(fct: DataFrame) -> DataFrame:
    """Average engagement of active against churned lifecycles with usage."""
    status = F.col("status")
    group = classify([(status == "active", C.RETAINED), (status == "churned", C.CHURNED)])
    used = fct.where(F.col("has_usage") & status.isin("active", "churned"))
    return used.groupBy(group.alias("retention_status")).agg(
        F.count(F.lit(1)).alias("subscriptions"),
        mean(F.col("avg_active_users"), 1).alias("avg_active_users"),
        mean(F.col("total_api_calls"), 0).alias("avg_total_api_calls"),
        mean(F.col("avg_session_duration_mins"), 1).alias("avg_session_mins"),
        mean(F.col("usage_event_count"), 1).alias("avg_usage_events"),
        mean(all_features(), 1).alias("avg_total_feature_usage"),
    )
