import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens import constants as C
from ledgerlens.operators.days import account_days
from ledgerlens.plans import fit, health, kpi

AS_OF = dt.date(2024, 12, 31)
SPINE = kpi.Spine(dt.date(2024, 1, 15), dt.date(2024, 5, 10))


def table(df, key):
    return {r[key]: tuple(v for k, v in r.asDict().items() if k != key) for r in df.collect()}


@pytest.fixture(scope="module")
def w(make_warehouse):
    subs = [
        dict(subscription_id="a", account_id="ACC-1", start_date="01/02/2024"),
        dict(subscription_id="b", account_id="ACC-1", start_date="02/02/2024", mrr_amount=50),
        dict(subscription_id="c", account_id="ACC-2", start_date="10/01/2024", end_date="15/03/2024", status="churned"),
        dict(subscription_id="d", account_id="ACC-3", start_date="01/03/2024", mrr_amount=99900),
        dict(subscription_id="e", account_id="ACC-4", start_date="01/03/2024", end_date="01/02/2024", status="churned"),
        dict(subscription_id="f", account_id="ACC-5", plan_type=None, start_date=None, status="trial", mrr_amount=0),
    ]
    events = [
        dict(event_id="1", account_id="ACC-1", event_date="05/02/2024"),
        dict(event_id="2", account_id="ACC-1", event_date="05/02/2024", active_users=9),
        dict(event_id="3", account_id="ACC-2", event_date="05/02/2024", active_users=None),
        dict(event_id="4", account_id="ACC-3", event_date="06/03/2024", active_users=999),
        dict(event_id="5", account_id="ACC-2", event_date="20/03/2024", active_users=4),
    ]
    return make_warehouse(subs, events, AS_OF)


def test_monthly_mrr_and_growth(w):
    months = table(kpi.monthly_mrr(w.fct, SPINE), "year_month")
    assert months == {
        "2024-02": (1, 49, 49), "2024-03": (2, 99, 99999), "2024-04": (2, 99, 99999), "2024-05": (2, 99, 99999),
    }
    growth = table(kpi.mrr_growth(w.fct, SPINE), "year_month")
    assert growth["2024-02"] == (49, None, None)
    assert growth["2024-03"] == (99, 49, Decimal("102.04")) and growth["2024-04"][2] == 0


def test_arpa_and_breakdown_agree(w):
    (total,) = kpi.arpa(w.fct).collect()
    assert (total.active_accounts, total.total_mrr_usd, total.arpa_usd) == (1, 99, 99)
    groups = kpi.revenue_by_plan_segment(w.fct).collect()
    assert sum(r.total_effective_mrr_usd for r in groups) == total.total_mrr_usd
    assert groups[0].avg_effective_mrr_usd == Decimal("49.50")


def test_churn_covers_every_spine_month(w):
    logo = table(kpi.logo_churn(w.fct, SPINE), "year_month")
    assert logo == {
        "2024-02": (1, 0, 0), "2024-03": (2, 1, 50), "2024-04": (2, 0, 0), "2024-05": (2, 0, 0),
    }
    revenue = table(kpi.revenue_churn(w.fct, SPINE), "year_month")
    assert revenue["2024-02"] == (49, 0, 0) and revenue["2024-03"] == (148, 49, Decimal("33.11"))


def test_cohorts_and_plans(w):
    assert table(kpi.cohort_retention(w.fct), "cohort_month") == {
        "2024-01": (1, 1, 0, 0), "2024-02": (2, 0, 2, 100),
    }
    assert table(kpi.churn_by_plan(w.fct), "plan_type") == {"Starter": (4, 1, 25)}


def test_lifetime_counts_orphan_usage_as_open(w):
    (as_written,) = kpi.customer_lifetime(w.fct).collect()
    assert (as_written.churned_customers, as_written.avg_lifetime_days) == (0, None)
    (without,) = kpi.customer_lifetime(w.fct, exclude_orphans=True).collect()
    assert tuple(without) == (1, 65, Decimal("2.17"))


def test_active_units(w):
    day = table(kpi.dau(w.days, SPINE), "date_actual")
    assert len(day) == 117
    assert day[dt.date(2024, 2, 5)] == (2, 9) and day[dt.date(2024, 3, 6)] == (0, 0)
    week = table(kpi.wau(w.days, SPINE), "week_start")
    assert len(week) == 17 and week[dt.date(2024, 2, 5)] == (2, 9) and week[dt.date(2024, 3, 18)] == (1, 4)
    month = table(kpi.mau(w.days, SPINE), "year_month")
    assert month == {
        "2024-01": (0, 0), "2024-02": (2, 9), "2024-03": (1, 4), "2024-04": (0, 0), "2024-05": (0, 0),
    }


def test_null_date_events_do_not_count(staged_events, staged_subs):
    events = staged_events(dict(event_date=None), dict(event_date="01/01/2023"))
    assert {r.active_accounts for r in kpi.mau(account_days(events, staged_subs({})), SPINE).collect()} == {0}


def test_engagement_groups(w):
    (adoption,) = kpi.feature_adoption(w.fct).collect()
    assert tuple(adoption) == (4, 100, 0, 0)
    assert table(kpi.usage_by_tier(w.fct), "plan_type")["Starter"][0] == 4
    groups = table(kpi.usage_vs_retention(w.fct), "retention_status")
    assert groups[C.RETAINED][0] == 3 and groups[C.CHURNED][0] == 1
    assert table(fit.usage_by_segment(w.fct), "customer_segment")["SMB"][0] == 5


def test_health(make_warehouse):
    subs = [
        dict(subscription_id="top", account_id="ACC-1", start_date="01/01/2024"),
        dict(subscription_id="half", account_id="ACC-2", start_date="01/07/2024", discount_percentage=50),
        dict(subscription_id="idle", account_id="ACC-3", start_date="01/07/2024"),
        dict(subscription_id="out", account_id="ACC-4", mrr_amount=99900),
        dict(subscription_id="gone", account_id="ACC-5", status="churned"),
    ]
    used = dict(feature_b_usage=1, feature_c_usage=1, active_users=10, session_duration_mins=100, integrations_used=4)
    events = [
        dict(account_id="ACC-1", **used),
        dict(account_id="ACC-2", event_date="01/08/2024", active_users=5, session_duration_mins=50, integrations_used=2, support_tickets=1),
        dict(account_id="ACC-4", active_users=900),
    ]
    w = make_warehouse(subs, events, AS_OF)
    got = {r.subscription_sk[:-2]: r for r in health.health_score(w.fct).collect()}
    assert set(got) == {"top", "half", "idle", "out"}
    assert (got["top"].health_score, got["top"].health_band) == (100, C.BAND_HEALTHY)
    half = got["half"]
    assert (half.usage_score, half.tenure_score, half.feature_score, half.support_score) == (
        Decimal("0.5"), Decimal("0.251"), Decimal("0.333"), 0,
    )
    assert (half.health_score, half.health_band) == (Decimal("34.2"), C.BAND_AT_RISK)
    assert got["idle"].support_score == Decimal("0.5") and got["idle"].health_band == C.BAND_ZERO_USAGE
    assert got["out"].health_score is None and got["out"].health_band == C.BAND_UNSCOREABLE
    whole = {r.subscription_sk[:-2]: r for r in health.health_score(w.fct, int_ratio=True).collect()}
    assert whole["top"].tenure_score == 1 and whole["half"].tenure_score == 0


def test_power_users_are_the_top_quartile(make_warehouse):
    subs = [dict(subscription_id=f"s{i}", account_id=f"ACC-{i}") for i in range(9)]
    events = [dict(account_id=f"ACC-{i}", active_users=i, session_duration_mins=60 * (i % 3)) for i in range(9)]
    w = make_warehouse(subs, events, AS_OF)
    tiles = {r.account_id: r.usage_quartile for r in fit.power_quartile(w.fct).collect()}
    assert sorted(tiles.values()) == [1, 1, 1, 2, 2, 3, 3, 4, 4]
    assert {r.account_id for r in fit.power_users(w.fct).collect()} == {a for a, t in tiles.items() if t == 4} == {"ACC-7", "ACC-8"}
    assert [tuple(r) for r in fit.power_user_profile(w.fct).collect()] == [("SMB", "Starter", 2)]
