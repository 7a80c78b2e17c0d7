import datetime as dt
import random
from decimal import Decimal

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.operators import anomaly
from ledgerlens.operators.days import account_days
from ledgerlens.sources.schemas import SEQ

AS_OF = dt.date(2024, 6, 30)


def ids(df, column="subscription_id"):
    return sorted(r[column] for r in df.collect())


def test_sigma_within_plan(staged_subs):
    rows = staged_subs(
        *[dict(subscription_id=f"s{i}") for i in range(12)], dict(subscription_id="high", mrr_amount=490),
        *[dict(subscription_id=f"e{i}", plan_type="Enterprise", mrr_amount=999) for i in range(3)],
        dict(subscription_id="free", mrr_amount=0),
    )
    (row,) = anomaly.mrr_sigma_by_plan(rows).collect()
    assert row.subscription_id == "high" and row.plan_avg_mrr == Decimal("82.92")


def test_metric_sigma(staged_events):
    rows = staged_events(
        *[dict(event_id=f"n{i}", api_calls=100, active_users=10) for i in range(20)],
        dict(event_id="x", api_calls=50000, active_users=0), dict(event_id="y", api_calls=None, active_users=900),
    )
    assert ids(anomaly.api_sigma(rows), "event_id") == ["x"]
    assert ids(anomaly.users_sigma(rows), "event_id") == ["y"]


def test_spikes_and_drops_against_own_account(staged_events, staged_subs):
    rows = staged_events(
        dict(event_id="spike", api_calls=300), *[dict(event_id=f"n{i}", api_calls=100) for i in range(4)],
        dict(event_id="drop", api_calls=10),
        dict(event_id="twice", account_id="ACC-2", api_calls=200), dict(event_id="none", account_id="ACC-2", api_calls=0),
        dict(event_id="zeros", account_id="ACC-3", api_calls=0),
    )
    got = {r.event_id: (r.ratio_to_avg, r.issue) for r in anomaly.api_spike_drop(rows, account_days(rows, staged_subs({}))).collect()}
    assert got == {
        "spike": (Decimal("2.54"), C.ISSUE_API_SPIKE), "drop": (Decimal("0.08"), C.ISSUE_API_DROP),
        "none": (Decimal("0.00"), C.ISSUE_API_DROP),
    }


def test_user_baseline_ignores_zero_rows(staged_events, staged_subs):
    rows = staged_events(
        dict(event_id="a", active_users=8), dict(event_id="b", active_users=0), dict(event_id="c", active_users=None),
        dict(event_id="d", account_id="ACC-2", active_users=0),
    )
    (row,) = anomaly.users_spike_drop(rows, account_days(rows, staged_subs({}))).collect()
    assert (row.event_id, row.account_avg_users, row.issue) == ("b", 8, C.ISSUE_USER_DROP)


def test_business_rules(staged_subs):
    rows = staged_subs(
        dict(subscription_id="inverted", end_date="31/01/2024"),
        dict(subscription_id="open", status="cancelled"),
        dict(subscription_id="trial", status="trial", trial_end_date="20/06/2024"),
        dict(subscription_id="pending", status="pending", start_date="30/05/2024"),
        dict(subscription_id="fresh", status="pending", start_date="31/05/2024"),
    )
    assert [(r.subscription_id, r.days_difference) for r in anomaly.end_before_start(rows).collect()] == [("inverted", -1)]
    assert ids(anomaly.terminal_without_end(rows)) == ["open"]
    assert ids(anomaly.active_past_end(rows, AS_OF)) == ["inverted"]
    assert [(r.subscription_id, r.days_since_trial_ended) for r in anomaly.expired_trials(rows, AS_OF).collect()] == [("trial", 10)]
    assert [(r.subscription_id, r.days_pending) for r in anomaly.long_pending(rows, AS_OF).collect()] == [("pending", 31)]


def test_zero_rows(staged_events):
    zero = dict(active_users=0, api_calls=0, storage_gb=0, session_duration_mins=0)
    rows = staged_events(
        dict(event_id="all", **zero), dict(event_id="busy", active_users=0), dict(event_id="ok"),
        dict(event_id="session", **{**zero, "session_duration_mins": 5}), dict(event_id="null", **{**zero, "api_calls": None}),
    )
    assert ids(anomaly.all_zero_events(rows), "event_id") == ["all"]
    assert ids(anomaly.zero_users_activity(rows), "event_id") == ["busy", "session"]


def test_discount_amounts(staged_subs):
    rows = staged_subs(
        dict(subscription_id="a", mrr_amount="299.99", discount_percentage="33.33"),
        dict(subscription_id="b", discount_percentage=30), dict(subscription_id="c", discount_percentage=None),
    )
    (row,) = anomaly.high_discount(rows).collect()
    assert (row.effective_mrr, row.revenue_lost) == (Decimal("200.00"), Decimal("99.99"))


def test_start_clusters_list_every_lifecycle_whatever_its_number(staged_subs):
    rows = staged_subs(
        *[dict(subscription_id=f"s{i:02d}") for i in range(10)],
        *[dict(subscription_id=f"t{i}", start_date="02/02/2024") for i in range(2)],
    )
    sparse = rows.withColumn(SEQ, F.monotonically_increasing_id() * 2**20)
    for frame in (rows, sparse.repartition(5)):
        got = anomaly.start_date_clusters(frame).collect()
        assert sorted(r.subscription_id for r in got) == [f"s{i:02d}" for i in range(10)]
        assert {r.subscriptions_started for r in got} == {10}


def test_drop_to_zero_runs_no_job_while_it_is_built(spark, staged_events, staged_subs):
    rows = staged_events({}, dict(event_id="b", api_calls=0))
    days = account_days(rows, staged_subs({}))
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "no job may run")
    anomaly.drop_to_zero(rows, days)
    assert not tracker.getJobIdsForGroup("building")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_drop_to_zero_looks_at_the_preceding_event(staged_events, staged_subs):
    rows = staged_events(
        dict(event_id="a", event_date="01/02/2024"),
        dict(event_id="b", event_date="02/02/2024", api_calls=0, active_users=None),
        dict(event_id="c", event_date="02/02/2024", api_calls=0, active_users=0),
        dict(event_id="d", account_id="ACC-2", api_calls=0),
        dict(event_id="e", account_id="ACC-3", active_users=2, api_calls=0),
        dict(event_id="f", account_id="ACC-3", active_users=0, api_calls=None),
    )
    got = {r.event_id: (r.prev_active_users, r.prev_api_calls) for r in anomaly.drop_to_zero(rows, account_days(rows, staged_subs({}))).collect()}
    assert got == {"b": (5, 100), "f": (2, 0)}


def test_event_clusters_show_the_mean_of_the_days_found(staged_events, staged_subs):
    rows = staged_events(
        *[dict(event_date="01/02/2024", account_id=f"ACC-{i % 3}") for i in range(10)],
        *[dict(event_date=f"{d:02d}/02/2024") for d in range(2, 8)],
    )
    (row,) = anomaly.event_date_clusters(account_days(rows, staged_subs({}))).collect()
    assert (row.events_on_day, row.distinct_accounts, row.avg_events_per_day) == (10, 3, 10)


@pytest.mark.parametrize("spread", [1, 2**19])
def test_drop_to_zero_equals_a_plain_lag_under_skew(staged_events, staged_subs, spread):
    rng = random.Random(3)
    rows = staged_events(
        *[
            dict(
                event_id=f"e{i}", account_id="hot" if i % 3 == 0 else f"a{rng.randrange(9)}",
                event_date=rng.choice([None, "01/02/2024", "02/02/2024", "05/02/2024"]),
                api_calls=rng.choice([None, 0, 5]), active_users=rng.choice([None, 0, 5]),
            )
            for i in range(300)
        ]
    ).withColumn(SEQ, F.col(SEQ) * spread)
    order = Window.partitionBy("account_id").orderBy(F.asc_nulls_last("event_date"), "_seq")
    want = (
        rows.withColumn("pa", F.lag("api_calls").over(order))
        .withColumn("pu", F.lag("active_users").over(order))
        .where("(api_calls = 0 or active_users = 0) and (pa > 0 or pu > 0)")
        .select("event_id", "pu", "pa")
    )
    got = anomaly.drop_to_zero(rows, account_days(rows, staged_subs({}))).select(
        "event_id", "prev_active_users", "prev_api_calls"
    )
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_baselines_equal_a_plain_join(staged_events, staged_subs):
    rng = random.Random(5)
    rows = staged_events(
        *[
            dict(
                event_id=f"e{i}", account_id=rng.choice(["hot", "hot", "a", "b", None]),
                event_date=rng.choice([None, "01/02/2024", "02/02/2024"]), active_users=rng.choice([None, 0, 1, 4, 30]),
            )
            for i in range(200)
        ]
    )
    mean = rows.where("active_users > 0").groupBy("account_id").agg(F.avg("active_users").alias("m"))
    want = rows.join(mean, "account_id").where("active_users > 2 * m or active_users < 0.25 * m")
    assert ids(anomaly.users_spike_drop(rows, account_days(rows, staged_subs({}))), "event_id") == ids(want, "event_id")
