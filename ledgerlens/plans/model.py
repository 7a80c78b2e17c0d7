"""The dimensional model: intermediate lifecycles, the subscription fact and its dimensions."""

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import days_between
from ledgerlens.operators.rules import Limits, classify, not_flagged
from ledgerlens.sources.schemas import SEQ


# --- derived lifecycle columns ------------------------------------------------------------------
def mrr_usd() -> Column:
    return F.round(F.col("mrr_amount") * F.col("rate_to_usd"), 2)


def effective_mrr_usd() -> Column:
    """MRR in USD after discount; a missing discount counts as none."""
    share = F.coalesce("discount_percentage", F.lit(0)) * F.lit("0.01").cast("decimal(3,2)")
    return F.round(F.col("mrr_amount") * F.col("rate_to_usd") * (1 - share), 2)


def is_active() -> Column:
    return F.coalesce(F.col("status") == "active", F.lit(False))


def subscription_length_days(as_of: dt.date) -> Column:
    start, end = F.col("start_date"), F.col("end_date")
    until = F.coalesce(end, F.lit(as_of))
    return F.when(end.isNull() | (end >= start), days_between(start, until))


def trial_length_days(max_days: int = C.SUSPECT_TRIAL_DAYS) -> Column:
    length = days_between(F.col("start_date"), F.col("trial_end_date"))
    return F.when(length.between(0, max_days), length)


def billing_cycle_days() -> Column:
    period = F.col("billing_period")
    cycle = F.lit(None).cast("int")
    for name, days in C.BILLING_DAYS.items():
        cycle = F.when(period == name, days).otherwise(cycle)
    return cycle


def data_quality_flag(limits: Limits = Limits()) -> Column:
    """The first defect that applies, most damaging first."""
    mrr, active = F.col("mrr_amount"), F.col("status") == "active"
    trial = days_between(F.col("start_date"), F.col("trial_end_date"))
    above_plan = F.lit(False)
    for plan, ceiling in limits.ceilings.items():
        above_plan = above_plan | ((F.col("plan_type") == plan) & (mrr > ceiling))
    return classify(
        [
            (F.col("end_date") < F.col("start_date"), C.INVERTED),
            (trial > limits.trial_days, C.SUSPECT_TRIAL),
            (active & (mrr == 0), C.ZERO_MRR),
            (F.col("rate_to_usd").isNull(), C.UNKNOWN_CURRENCY),
            (active & mrr.isNull(), C.NULL_MRR),
            (F.col("discount_percentage") == 100, C.FULL_DISCOUNT),
            (mrr > limits.extreme, C.OUTLIER_EXTREME),
            (mrr > limits.high, C.OUTLIER_HIGH),
            (above_plan, C.ANOMALY_VS_PLAN),
        ]
    )


def int_subscriptions(staged: DataFrame, rates: DataFrame, as_of: dt.date, limits: Limits = Limits()) -> DataFrame:
    """Staged lifecycles with USD amounts, lengths and their quality flag.

    ``rates`` has one row per currency code, hence the broadcast.
    """
    priced = staged.join(F.broadcast(rates), "currency", "left")
    return priced.select(
        "subscription_sk", "subscription_id", "account_id", "plan_type", "status", "mrr_amount",
        "currency", "rate_to_usd",
        mrr_usd().alias("mrr_usd"),
        effective_mrr_usd().alias("effective_mrr_usd"),
        "discount_percentage", "billing_period", "customer_segment", "payment_method",
        "start_date", "end_date", "trial_end_date", "created_at", "updated_at",
        is_active().alias("is_active"),
        subscription_length_days(as_of).alias("subscription_length_days"),
        trial_length_days(limits.trial_days).alias("trial_length_days"),
        billing_cycle_days().alias("billing_cycle_days"),
        data_quality_flag(limits).alias("data_quality_flag"),
        SEQ,
    )


# --- fact ---------------------------------------------------------------------------------------
_ATTRIBUTES = (
    "subscription_id", "plan_type", "status", "mrr_amount", "currency", "rate_to_usd", "mrr_usd",
    "effective_mrr_usd", "discount_percentage", "billing_period", "customer_segment",
    "payment_method", "start_date", "end_date", "trial_end_date", "created_at", "updated_at",
    "is_active", "subscription_length_days", "trial_length_days", "billing_cycle_days",
)
_USAGE = (
    "usage_event_count", "total_api_calls", "avg_api_calls", "avg_active_users",
    "max_active_users", "total_projects_created", "avg_integrations_used",
    "total_support_tickets", "avg_session_duration_mins", "avg_mobile_usage_mins",
    "total_feature_a_usage", "total_feature_b_usage", "total_feature_c_usage",
)


def fct_subscriptions(
    usage: DataFrame,
    lifecycles: DataFrame,
    on: Sequence[str] = ("subscription_sk", "account_id"),
) -> DataFrame:
    """One row per lifecycle, or per account for usage outside any lifecycle.

    The lifecycle key numbers lifecycles per id and account, so it is unique within an account only.
    Joining on both keeps the grain when two accounts share an id; ``on=["subscription_sk"]`` instead
    pairs every such lifecycle with the usage of all of them. The orphan flag outranks the quality flag.
    """
    owned = usage.select("subscription_sk", "account_id", *_USAGE, "orphan_flag")
    known = lifecycles.select(*on, *_ATTRIBUTES, "data_quality_flag", SEQ)
    reported = [
        F.round(F.col(c), 1).alias(c) if c.startswith("avg_") else F.col(c) for c in _USAGE
    ]
    return owned.join(known, list(on), "left").select(
        "subscription_sk", "account_id", *_ATTRIBUTES, *reported,
        (F.col("usage_event_count") > 0).alias("has_usage"),
        F.coalesce("orphan_flag", "data_quality_flag").alias("data_quality_flag"),
        SEQ,
    )


# --- dimensions ---------------------------------------------------------------------------------
_CURRENT = {
    "subscription_id": "current_subscription_id",
    "plan_type": "current_plan_type",
    "status": "current_status",
    "mrr_amount": "current_mrr_amount",
    "currency": "current_currency",
    "mrr_usd": "current_mrr_usd",
    "effective_mrr_usd": "current_effective_mrr_usd",
    "customer_segment": "customer_segment",
    "payment_method": "payment_method",
    "billing_period": "billing_period",
    "start_date": "current_subscription_start",
    "end_date": "current_subscription_end",
    "trial_end_date": "trial_end_date",
    "data_quality_flag": "data_quality_flag",
}


def dim_account(fct: DataFrame) -> DataFrame:
    """One row per account with its latest lifecycle, plus accounts known from usage alone."""
    flag = F.col("data_quality_flag")
    # start day and sequence as one number: a plain hash aggregate finds the largest, which leads back to its row
    day = (F.coalesce(F.unix_date("start_date"), F.lit(-(2**31))) + F.lit(2**31)).cast("decimal(11,0)")
    age = day * F.lit(str(2**63)).cast("decimal(20,0)") + F.coalesce(SEQ, F.lit(-1)).cast("decimal(20,0)")
    own = fct.where(not_flagged(flag, [C.NO_RECORD])).withColumn("_age", age)
    newest = own.groupBy(F.col("account_id").alias("_account")).agg(F.max("_age").alias("_newest"))
    same = F.col("account_id").eqNullSafe(F.col("_account")) & (F.col("_age") == F.col("_newest"))
    latest = own.join(newest, same).select("account_id", *[F.col(c).alias(name) for c, name in _CURRENT.items()])
    unknown = fct.where(flag == C.NO_RECORD).select("account_id", "data_quality_flag")
    return latest.unionByName(unknown, allowMissingColumns=True)


def dim_plan(fct: DataFrame) -> DataFrame:
    """The plans that occur, with tier and list price; a missing plan is 'unknown', tier 0."""
    plan = F.col("plan_type")
    tier, price = F.lit(0), F.lit(None).cast("decimal(6,2)")
    for name in C.PLAN_TIER:
        tier = F.when(plan == name, C.PLAN_TIER[name]).otherwise(tier)
        price = F.when(plan == name, F.lit(C.PLAN_LIST_PRICE[name]).cast("decimal(6,2)")).otherwise(price)
    named = F.coalesce(plan, F.lit("unknown")).alias("plan_type")
    return fct.select(
        named, tier.alias("plan_tier"), price.alias("list_price_usd_monthly")
    ).distinct()
