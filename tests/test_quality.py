import datetime as dt
from decimal import Decimal

import pytest

from ledgerlens import constants as C
from ledgerlens.operators import quality

AS_OF = dt.date(2024, 6, 30)


def ids(df, column="subscription_id"):
    return sorted(r[column] for r in df.collect())


def test_duplicates(staged_subs):
    rows = staged_subs({}, {}, dict(subscription_id="SUB-2"))
    assert [tuple(r) for r in quality.duplicate_keys(rows, "subscription_id").collect()] == [("SUB-1", 2)]
    both = quality.duplicate_keys(rows, "subscription_id", "account_id", count_name="n")
    assert [tuple(r) for r in both.collect()] == [("SUB-1", "ACC-1", 2)]


def test_null_profile_is_one_pass_and_counts_each_column(staged_subs):
    rows = staged_subs({}, dict(currency=""), dict(currency=None, end_date="01/03/2024"))
    profile = {r.column_name: (r.null_count, r.pct_null) for r in quality.null_profile(rows, ["currency", "end_date"]).collect()}
    assert profile == {"currency": (2, Decimal("66.7")), "end_date": (2, Decimal("66.7"))}


def test_critical_missing(staged_subs):
    rows = staged_subs({}, dict(subscription_id="a", mrr_amount=-1), dict(subscription_id="b", billing_period=" "))
    found = quality.missing_any(rows, ["mrr_amount", "currency", "billing_period"], ["subscription_id"])
    assert ids(found) == ["a", "b"]


def test_mixed_dates(raw_subs):
    rows = raw_subs({}, dict(subscription_id="a", end_date="03/20/2024"), dict(subscription_id="b", end_date="x"))
    assert ids(quality.mixed_date_rows(rows, ["start_date", "end_date"], ["subscription_id"])) == ["a"]


def test_impossible_dates_and_long_trials(staged_subs):
    rows = staged_subs(
        dict(subscription_id="same", end_date="01/02/2024"),
        dict(subscription_id="inverted", end_date="31/01/2024"),
        dict(subscription_id="sixty", trial_end_date="01/04/2024"),
        dict(subscription_id="sixty-one", trial_end_date="02/04/2024"),
    )
    assert ids(quality.impossible_dates(rows)) == ["inverted"]
    assert [(r.subscription_id, r.day_difference) for r in quality.long_trials(rows).collect()] == [("sixty-one", 61)]


def test_nonpositive_mrr_labels(raw_subs):
    rows = raw_subs(
        dict(subscription_id="neg", mrr_amount=-1), dict(subscription_id="null", mrr_amount=None),
        dict(subscription_id="zero", mrr_amount=0), dict(subscription_id="trial", mrr_amount=0, status="trial"), {},
    )
    assert {r.subscription_id: r.issue for r in quality.nonpositive_mrr(rows).collect()} == {
        "neg": C.ISSUE_MRR_NEGATIVE, "null": C.ISSUE_MRR_NULL, "zero": C.ISSUE_MRR_ZERO,
    }


def test_global_sigma_reports_statistics_of_the_rows_found(raw_subs):
    rows = raw_subs(*[dict(subscription_id=f"n{i}", mrr_amount=50) for i in range(20)], dict(subscription_id="big", mrr_amount=9000))
    (row,) = quality.mrr_sigma_global(rows).collect()
    assert row.subscription_id == "big" and row.avg_mrr == 9000 and row.stddev_mrr is None


def test_rule_classes(raw_subs):
    rows = raw_subs(
        dict(subscription_id="extreme", mrr_amount=99900),
        dict(subscription_id="annual", plan_type="Enterprise", billing_period="annual", mrr_amount=11988),
        dict(subscription_id="enterprise", plan_type="Enterprise", mrr_amount=2001),
        dict(subscription_id="edge", plan_type="Enterprise", mrr_amount=2000),
        dict(subscription_id="starter", mrr_amount=490),
        dict(subscription_id="none", mrr_amount=None),
    )
    assert {r.subscription_id: r.issue for r in quality.mrr_rule_classes(rows).collect()} == {
        "extreme": C.ISSUE_MRR_EXTREME, "annual": C.ISSUE_MRR_ANNUAL,
        "enterprise": C.ISSUE_ABOVE_PLAN["Enterprise"], "starter": C.ISSUE_ABOVE_PLAN["Starter"],
    }


def test_user_checks(raw_events, staged_events):
    assert quality.negative_users(raw_events(dict(active_users=-5), {})).count() == 1
    rows = staged_events(
        *[dict(event_id=f"n{i}", active_users=10) for i in range(20)],
        dict(event_id="high", active_users=60), dict(event_id="spike", active_users=999), dict(event_id="none", active_users=None),
    )
    found = {r.event_id: r.issue for r in quality.users_sigma_trimmed(rows).collect()}
    assert found == {"high": C.ISSUE_USERS_HIGH, "spike": C.ISSUE_USERS_SPIKE}


def test_stale_trials_and_casing(staged_subs, raw_subs):
    rows = (
        dict(subscription_id="late", status="trial", trial_end_date="29/06/2024"),
        dict(subscription_id="today", status="trial", trial_end_date="30/06/2024"),
        dict(subscription_id="active", trial_end_date="29/06/2024", billing_period="MONTHLY"),
    )
    assert ids(quality.stale_trials(staged_subs(*rows), AS_OF)) == ["late"]
    assert ids(quality.case_inconsistent(raw_subs(*rows))) == ["active"]


@pytest.mark.parametrize("bad", ["acc-1", "ACC-", "ACC-1x", "xACC-1", "ACC-1\n"])
def test_account_format_is_matched_as_a_whole(staged_subs, staged_events, bad):
    found = quality.bad_account_format({"s": staged_subs(dict(account_id=bad)), "e": staged_events({})})
    assert [tuple(r) for r in found.collect()] == [("s", bad)]
