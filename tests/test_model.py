import datetime as dt
import os
from decimal import Decimal

import pytest

from ledgerlens import constants as C
from ledgerlens.operators import quality
from ledgerlens.operators.rules import Limits
from ledgerlens.plans import model
from ledgerlens.plans.warehouse import Warehouse

AS_OF = dt.date(2024, 12, 31)


def flags(make_warehouse, *subs):
    rows = make_warehouse(subs, [{}], AS_OF).build_int_subscriptions().collect()
    return {r.subscription_id: r.data_quality_flag for r in rows}


def test_limits_of_the_flag_are_parameters(spark, raw_subs, raw_events):
    rows = raw_subs(
        dict(subscription_id="high", mrr_amount=20), dict(subscription_id="extreme", mrr_amount=31),
        dict(subscription_id="plan", mrr_amount=8), dict(subscription_id="trial", mrr_amount=1, trial_end_date="12/02/2024"),
        dict(subscription_id="clean", mrr_amount=7),
    )
    limits = Limits(high=10, extreme=30, ceilings={"Starter": 7}, trial_days=9)
    found = Warehouse(spark, rows, raw_events({}), AS_OF, limits=limits).build_int_subscriptions().collect()
    assert {r.subscription_id: r.data_quality_flag for r in found} == {
        "high": C.OUTLIER_HIGH, "extreme": C.OUTLIER_EXTREME, "plan": C.ANOMALY_VS_PLAN, "trial": C.SUSPECT_TRIAL, "clean": None,
    }
    issues = {r.subscription_id: r.issue for r in quality.mrr_rule_classes(rows, limits).collect()}
    assert issues == {"extreme": C.ISSUE_MRR_EXTREME, **dict.fromkeys(["high", "plan"], C.ISSUE_ABOVE_PLAN["Starter"])}


def test_flag_priority(make_warehouse):
    inverted = dict(end_date="01/01/2024", trial_end_date="01/01/2025", mrr_amount=99900)
    got = flags(
        make_warehouse,
        dict(subscription_id="clean"),
        dict(subscription_id="inverted", **inverted),
        dict(subscription_id="trial", trial_end_date="02/05/2024", mrr_amount=0),
        dict(subscription_id="ninety", trial_end_date="01/05/2024"),
        dict(subscription_id="zero", mrr_amount=0, currency=""),
        dict(subscription_id="currency", currency="XXX", mrr_amount=None),
        dict(subscription_id="null", mrr_amount=-5, discount_percentage=100),
        dict(subscription_id="full", discount_percentage=100, mrr_amount=99900),
        dict(subscription_id="extreme", mrr_amount="50000.01"),
        dict(subscription_id="high", mrr_amount=50000),
        dict(subscription_id="plan", mrr_amount="100.01"),
        dict(subscription_id="ceiling", mrr_amount=100),
        dict(subscription_id="churned zero", mrr_amount=0, status="churned"),
    )
    assert got == {
        "clean": None, "inverted": C.INVERTED, "trial": C.SUSPECT_TRIAL, "ninety": None, "zero": C.ZERO_MRR,
        "currency": C.UNKNOWN_CURRENCY, "null": C.NULL_MRR, "full": C.FULL_DISCOUNT, "extreme": C.OUTLIER_EXTREME,
        "high": C.OUTLIER_HIGH, "plan": C.ANOMALY_VS_PLAN, "ceiling": None, "churned zero": None,
    }


def test_derived_columns(make_warehouse):
    subs = [
        dict(subscription_id="eur", currency="EUR", mrr_amount="99.99", discount_percentage="12.5", billing_period="ANNUAL"),
        dict(subscription_id="open", discount_percentage=None, trial_end_date="31/01/2024", billing_period="weekly"),
        dict(subscription_id="ended", end_date="01/03/2024", status="churned", trial_end_date="08/02/2024"),
        dict(subscription_id="inverted", end_date="31/01/2024", currency=None),
    ]
    rows = {r.subscription_id: r for r in make_warehouse(subs, [{}], AS_OF).build_int_subscriptions().collect()}
    assert rows["eur"].mrr_usd == Decimal("107.99") and rows["eur"].effective_mrr_usd == Decimal("94.49")
    assert rows["eur"].billing_cycle_days == 365 and rows["open"].billing_cycle_days is None
    assert rows["open"].effective_mrr_usd == 49 and rows["open"].trial_length_days is None
    assert [rows[k].subscription_length_days for k in ("open", "ended", "inverted")] == [334, 29, None]
    assert rows["ended"].trial_length_days == 7 and rows["ended"].is_active is False and rows["eur"].is_active
    assert rows["inverted"].mrr_usd is None


@pytest.fixture(scope="module")
def small(make_warehouse):
    subs = [
        dict(subscription_id="one", start_date="01/02/2024", end_date="20/02/2024", status="churned"),
        dict(subscription_id="one", start_date="01/04/2024"),
        dict(subscription_id="late", account_id="ACC-2", start_date="01/05/2024", mrr_amount=99900),
    ]
    events = [
        dict(event_id="a", api_calls="2.24"), dict(event_id="b", api_calls="2.25"),
        dict(event_id="c", account_id="ACC-2"), dict(event_id="d", account_id="ACC-9", active_users=None),
    ]
    return make_warehouse(subs, events, AS_OF)


def test_fact_keeps_lifecycles_and_orphans(small):
    rows = {r.subscription_sk: r for r in small.fct.collect()}
    assert set(rows) == {"one-1", "one-2", "late-1", "NO_SUB_ACC-2", "NO_SUB_ACC-9"}
    assert rows["one-1"].usage_event_count == 2 and rows["one-1"].has_usage
    assert rows["one-1"].avg_api_calls == Decimal("2.3")  # 2.245 -> 2.25 -> 2.3
    assert rows["one-2"].usage_event_count == 0 and not rows["one-2"].has_usage
    assert rows["late-1"].data_quality_flag == C.OUTLIER_EXTREME
    assert rows["NO_SUB_ACC-2"].data_quality_flag == C.OUTSIDE_WINDOW
    assert rows["NO_SUB_ACC-9"].data_quality_flag == C.NO_RECORD
    assert rows["NO_SUB_ACC-2"].plan_type is None and rows["NO_SUB_ACC-2"].start_date is None


def test_dimensions(small):
    accounts = {r.account_id: r for r in model.dim_account(small.fct).collect()}
    assert set(accounts) == {"ACC-1", "ACC-2", "ACC-9"}
    assert accounts["ACC-1"].current_subscription_start == dt.date(2024, 4, 1)
    assert accounts["ACC-2"].current_subscription_id == "late"
    assert accounts["ACC-9"].data_quality_flag == C.NO_RECORD and accounts["ACC-9"].current_status is None
    plans = [tuple(r) for r in model.dim_plan(small.fct).orderBy("plan_tier").collect()]
    assert plans == [("unknown", 0, None), ("Starter", 2, Decimal("49.00"))]


def test_shared_id_keeps_one_row_per_lifecycle(make_warehouse):
    subs = [dict(account_id="ACC-1"), dict(account_id="ACC-2")]
    w = make_warehouse(subs, [{}, dict(account_id="ACC-2")], AS_OF)
    assert w.fct.count() == 2
    assert w.build_fct(("subscription_sk",)).count() == 4


def test_published_tables_answer_sql(spark, small, tmp_path):
    for _ in range(2):  # publishing again replaces the tables
        tables = small.publish(str(tmp_path), dt.date(2024, 1, 1), dt.date(2024, 12, 31))
    assert {name: df.count() for name, df in tables.items()} == {
        "int_subscriptions": 3, "int_usage_per_subscription": 5, "fct_subscriptions": 5,
        "dim_account": 3, "dim_date": 366, "dim_plan": 2,
    }
    (row,) = spark.sql(
        """SELECT count(*) AS n FROM fct_subscriptions f JOIN dim_account a USING (account_id)
        JOIN stg_subscriptions s USING (subscription_sk) JOIN dim_date d ON d.date_actual = f.start_date"""
    ).collect()
    assert row.n == 3
    base = "SELECT (SELECT count(*) FROM subscriptions) s, (SELECT count(*) FROM usage_events) e, (SELECT count(*) FROM seed_exchange_rates) r"
    assert all(spark.sql(base).first())


def test_own_rates_and_close(spark, make_warehouse):
    made = make_warehouse([dict(currency="CHF", mrr_amount=100)], [{}])
    own = Warehouse(spark, made.raw_subscriptions, made.raw_events, made.as_of, rates={"CHF": Decimal("1.1000")})
    assert [float(r.mrr_usd) for r in own.int_subscriptions.collect()] == [110.0]
    stored = own.int_subscriptions.inputFiles()[0].removeprefix("file:")
    assert os.path.exists(stored)
    own.close()
    assert not os.path.exists(stored)
    assert own.int_subscriptions.count() == 1  # built anew
    own.close()
