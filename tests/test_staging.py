import datetime as dt

from pyspark.sql import functions as F

from ledgerlens.functions import parse_mixed_date
from ledgerlens.operators.staging import stg_subscriptions, stg_usage_events


def test_dates_are_day_first_unless_impossible(spark):
    texts = ["15/01/2024", "03/20/2024", "1/2/2024", "", None, "abc", "31/02/2024", "13/13/2024", "15/01"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = [r.d for r in rows.orderBy("i").select(parse_mixed_date(F.col("t")).alias("d")).collect()]
    assert parsed == [
        dt.date(2024, 1, 15), dt.date(2024, 3, 20), dt.date(2024, 2, 1), None, None, None, None, None, None,
    ]


def test_subscriptions_are_cleaned_and_never_dropped(raw_subs):
    staged = stg_subscriptions(
        raw_subs(
            dict(mrr_amount=-49, currency=" ", billing_period="MONTHLY", customer_segment="", payment_method=None),
            dict(subscription_id="SUB-2", account_id="ACC-2", mrr_amount=0, billing_period=""),
        )
    )
    first, second = staged.orderBy("subscription_id").collect()
    assert first.mrr_amount is None and first.currency is None and first.customer_segment is None
    assert first.billing_period == "monthly" and first.payment_method is None
    assert second.mrr_amount == 0 and second.billing_period is None


def test_lifecycle_key_numbers_by_start_within_id_and_account(raw_subs):
    staged = stg_subscriptions(
        raw_subs(
            dict(start_date="01/06/2024"),
            dict(start_date="05/13/2024"),
            dict(start_date=None),
            dict(start_date="13/05/2024"),
            dict(account_id="ACC-2"),
        )
    )
    keys = {r._seq: r.subscription_sk for r in staged.collect()}
    assert keys == {0: "SUB-1-3", 1: "SUB-1-1", 2: "SUB-1-4", 3: "SUB-1-2", 4: "SUB-1-1"}


def test_events_null_negative_users_only(raw_events):
    staged = stg_usage_events(raw_events(dict(active_users=-5, api_calls=-1), dict(active_users=0)))
    rows = staged.orderBy("_seq").collect()
    assert rows[0].active_users is None and rows[0].api_calls == -1
    assert rows[1].active_users == 0 and rows[1].event_date == dt.date(2024, 2, 10)
