"""Typed staging of the raw tables. Dirty values are nulled or kept, rows are never dropped."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import blank_to_null, negative_to_null, normalise_case, parse_mixed_date
from ledgerlens.operators.ordered import day_rank, numbered
from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS, RAW_USAGE_EVENTS, SEQ


def stage_subscriptions(raw: DataFrame) -> DataFrame:
    """The staged columns without the lifecycle key: a projection, no shuffle."""
    staged = {
        "mrr_amount": negative_to_null(F.col("mrr_amount")),
        "currency": blank_to_null(F.col("currency")),
        "start_date": parse_mixed_date(F.col("start_date")),
        "end_date": parse_mixed_date(F.col("end_date")),
        "trial_end_date": parse_mixed_date(F.col("trial_end_date")),
        "billing_period": normalise_case(blank_to_null(F.col("billing_period"))),
        "customer_segment": blank_to_null(F.col("customer_segment")),
        "payment_method": blank_to_null(F.col("payment_method")),
    }
    names = RAW_SUBSCRIPTIONS.names
    return raw.select(*[staged.get(c, F.col(c)).alias(c) for c in names], SEQ)


def lifecycle_key(staged: DataFrame) -> DataFrame:
    """Add ``subscription_sk``: the id and the lifecycle's number by start date in its account."""
    keys = ["subscription_id", "account_id"]
    counted = numbered(staged, keys, day_rank(F.col("start_date")), "_lifecycle")
    key = F.concat("subscription_id", F.lit("-"), F.col("_lifecycle").cast("string"))
    return counted.select(key.alias("subscription_sk"), *staged.columns)


def stg_subscriptions(raw: DataFrame) -> DataFrame:
    return lifecycle_key(stage_subscriptions(raw))


def stg_usage_events(raw: DataFrame) -> DataFrame:
    staged = {
        "event_date": parse_mixed_date(F.col("event_date")),
        "active_users": negative_to_null(F.col("active_users")),
    }
    names = RAW_USAGE_EVENTS.names
    return raw.select(*[staged.get(c, F.col(c)).alias(c) for c in names], SEQ)
