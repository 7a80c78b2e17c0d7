"""Interval matching against brute force over every event and lifecycle."""

import datetime as dt
import random
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.operators import intervals
from ledgerlens.operators.days import account_days, events_on, listed
from ledgerlens.operators.staging import lifecycle_key

BASE = dt.date(2024, 1, 1)


def text(day):
    return None if day is None else day.strftime("%d/%m/%Y")


@pytest.fixture(scope="module")
def world():
    """One account holds a third of all rows, others have no name; windows overlap, invert, miss their
    start or never end.
    """
    rng = random.Random(11)

    def account(n):
        return "hot" if rng.random() < 0.34 else rng.choice([None, *[f"a{i}" for i in range(n)]])

    subs, events = [], []
    for i in range(60):
        start = None if rng.random() < 0.05 else BASE + dt.timedelta(rng.randrange(40))
        length = rng.choice([-3, 0, 2, 5, 20])
        end = None if start is None or rng.random() < 0.15 else start + dt.timedelta(length)
        subs.append(
            dict(subscription_id=f"s{i % 50}", account_id=account(12), start_date=text(start), end_date=text(end),
                 status=rng.choice(["active", "churned"]))
        )
    for i in range(300):
        day = None if rng.random() < 0.03 else BASE + dt.timedelta(rng.randrange(60))
        events.append(
            dict(event_id=f"e{i}", account_id=account(16), event_date=text(day),
                 api_calls=rng.choice([None, 0, 7, 13, 100]), active_users=rng.choice([None, -5, 0, 3, 999]),
                 support_tickets=rng.randrange(2))
        )
    return subs, events


@pytest.fixture(scope="module")
def frames(world, staged_subs, staged_events):
    subs, events = staged_subs(*world[0]).cache(), staged_events(*world[1]).cache()
    return subs, events, account_days(events, subs).cache()


@pytest.fixture(scope="module")
def matched(frames):
    """(lifecycles, events, set of matching (event seq, lifecycle seq))."""
    subs, events = frames[0].collect(), frames[1].collect()
    pairs = {
        (e._seq, s._seq)
        for e in events
        for s in subs
        if e.account_id is not None and e.account_id == s.account_id
        and e.event_date is not None and s.start_date is not None
        and s.start_date <= e.event_date and (s.end_date is None or e.event_date <= s.end_date)
    }
    return subs, events, pairs


def test_unmatched_events(frames, matched):
    subs, events, pairs = matched
    known = {s.account_id for s in subs} - {None}
    hit = {e for e, _ in pairs}
    lost = [e for e in events if e._seq not in hit]
    got = intervals.events_no_window(frames[1], frames[2]).collect()
    assert sorted(r.event_id for r in got) == sorted(e.event_id for e in lost)
    assert {(r.subscription_id, r.start_date, r.status) for r in got} == {(None, None, None)}
    orphaned = intervals.orphan_events(frames[1], frames[2]).collect()
    assert sorted(r.event_id for r in orphaned) == sorted(e.event_id for e in events if e.account_id not in known)


def test_events_outside_window_list_every_lifecycle_of_the_account(frames, matched):
    subs, events, pairs = matched
    hit = {e for e, _ in pairs}

    def reason(e, s):
        if e.event_date and s.start_date and e.event_date < s.start_date:
            return C.ISSUE_BEFORE_START
        if e.event_date and s.end_date and e.event_date > s.end_date:
            return C.ISSUE_AFTER_END
        return C.ISSUE_OUTSIDE

    want = [
        (e.event_id, s.subscription_id, reason(e, s))
        for e in events if e._seq not in hit for s in subs if s.account_id == e.account_id is not None
    ]
    got = intervals.events_outside_window(frames[1], frames[2], frames[0]).collect()
    assert sorted((r.event_id, r.subscription_id, r.issue) for r in got) == sorted(want)


def test_summary_of_events_outside_windows_adds_up_the_pairs(frames, matched):
    subs, events, pairs = matched
    hit = {e for e, _ in pairs}

    def summary(e):
        own = [s for s in subs if s.account_id == e.account_id]
        day = e.event_date
        later = [s for s in own if day and s.start_date and s.start_date > day]
        ended = [s for s in own if day and s.end_date and s.end_date < day and s not in later]
        return (
            e.event_id, len(later), len(ended), len(own) - len(later) - len(ended),
            max((s.end_date for s in ended), default=None), min((s.start_date for s in later), default=None),
        )

    known = {s.account_id for s in subs} - {None}
    want = [summary(e) for e in events if e._seq not in hit and e.account_id in known]
    got = intervals.events_outside_window_summary(frames[1], frames[2], frames[0]).collect()
    fields = ("event_id", "starting_later", "ended_before", "undecided", "previous_end", "next_start")
    assert sorted(map(str, [tuple(r[f] for f in fields) for r in got])) == sorted(map(str, want)) != []


def test_lifecycles_without_events(frames, matched):
    subs, events, pairs = matched
    hit = {s for _, s in pairs}
    got = intervals.unmatched_lifecycles(frames[0], frames[2]).collect()
    assert sorted(r._seq for r in got) == sorted(s._seq for s in subs if s._seq not in hit)
    seen = {e.account_id for e in events} - {None}
    silent = intervals.subscriptions_without_events(frames[0], frames[2]).collect()
    assert sorted(r.subscription_id for r in silent) == sorted(s.subscription_id for s in subs if s.account_id not in seen)


def average(values, digits=Decimal("0.01")):
    values = [v for v in values if v is not None]
    return (sum(values) / len(values)).quantize(digits, ROUND_HALF_UP) if values else None


def test_rollup_attributes_every_event(frames, matched):
    subs, events, pairs = matched
    keyed = lifecycle_key(frames[0]).cache()
    keys = {r._seq: (r.subscription_sk, r.account_id) for r in keyed.collect()}
    known = {s.account_id for s in subs} - {None}
    groups = defaultdict(list)
    for s in subs:
        groups[(*keys[s._seq], None)] = []
    for e in events:
        owners = [s for s in subs if (e._seq, s._seq) in pairs]
        for s in owners:
            groups[(*keys[s._seq], None)].append(e)
        if not owners:
            flag = C.OUTSIDE_WINDOW if e.account_id in known else C.NO_RECORD
            sk = None if e.account_id is None else f"NO_SUB_{e.account_id}"
            groups[(sk, e.account_id, flag)].append(e)
    want = {
        key: (
            len(es),
            sum((e.api_calls for e in es if e.api_calls is not None), Decimal(0)) if any(e.api_calls is not None for e in es) else None,
            average([e.api_calls for e in es]),
            average([e.active_users for e in es]),
            max((e.active_users for e in es if e.active_users is not None), default=None),
            sum(e.support_tickets for e in es) if es else None,
        )
        for key, es in groups.items()
    }
    rows = intervals.int_usage_per_subscription(keyed, frames[2]).collect()
    got = {
        (r.subscription_sk, r.account_id, r.orphan_flag): (
            r.usage_event_count, r.total_api_calls, r.avg_api_calls, r.avg_active_users, r.max_active_users,
            r.total_support_tickets,
        )
        for r in rows
    }
    assert len(rows) == len(got) and got == want


def test_interval_ends_are_inclusive(staged_subs, staged_events):
    subs = staged_subs(dict(start_date="01/02/2024", end_date="05/02/2024"))
    events = staged_events(*[dict(event_id=d, event_date=f"{d}/02/2024") for d in ("01", "05", "06")])
    lost = intervals.events_no_window(events, account_days(events, subs))
    assert [r.event_id for r in lost.collect()] == ["06"]


def test_repartitioning_changes_nothing(frames):
    keyed = lifecycle_key(frames[0])
    one = intervals.int_usage_per_subscription(keyed, frames[2]).collect()
    other = intervals.int_usage_per_subscription(
        lifecycle_key(frames[0].repartition(7)), account_days(frames[1].repartition(5), frames[0].repartition(3))
    ).collect()
    assert sorted(map(str, one)) == sorted(map(str, other))


def test_crowded_account_reads_borders_not_days(spark, staged_subs, staged_events):
    """100 000 windows of one account over 400 days: rows handled stay near windows plus days."""
    windows = spark.range(100_000).select(
        F.lit("hot").alias("account_id"), F.col("id").cast("string").alias("subscription_sk"),
        F.date_add(F.lit(BASE), (F.col("id") % 397).cast("int")).alias("start_date"),
        F.date_add(F.lit(BASE), (F.col("id") % 397 + F.col("id") % 211).cast("int")).alias("end_date"),
    )
    values = [(k * 37) % 101 for k in range(400)]
    events = staged_events(*[dict(event_id=f"e{k}", account_id="hot", event_date=text(BASE + dt.timedelta(k)), active_users=v, api_calls=v) for k, v in enumerate(values)])
    days = account_days(events, windows).where("covered").cache()
    borders = intervals.window_borders(days, windows)
    assert borders.count() <= 2 * 620
    rows = intervals.int_usage_per_subscription(windows, days).collect()
    assert len(rows) == 100_000
    for r in rows[::997]:
        i = int(r.subscription_sk)
        held = values[i % 397 : i % 397 + i % 211 + 1]
        assert (r.usage_event_count, r.total_api_calls, r.max_active_users) == (len(held), sum(held), max(held))
    plan = intervals.window_usage(days, windows)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan


def test_lookup_filter_thins_events_before_the_shuffle(spark, frames):
    events = spark.range(200_000).select(F.concat(F.lit("a"), F.col("id") % 5000).alias("account_id"), F.date_add(F.lit(BASE), (F.col("id") % 40).cast("int")).alias("event_date"), "id")
    asked = events.where("id % 4000 = 7").select("account_id", "event_date").distinct()
    thin = listed(events, asked)
    wanted = events.join(asked, ["account_id", "event_date"], "left_semi").count()
    assert wanted <= thin.count() < wanted + 2000
    assert events_on(events, asked).count() == wanted
    # a filter too small for the days lets more through, and loses nothing
    assert listed(events, asked, words=1).join(asked, ["account_id", "event_date"], "left_semi").count() == wanted
    none = frames[1].select("account_id", "event_date").limit(0)
    assert listed(frames[1], none).count() == 0
    nulls = frames[1].where("account_id is null or event_date is null")
    assert events_on(frames[1], nulls.select("account_id", "event_date").distinct()).count() == nulls.count() > 0


def test_borders_double_narrow_rows_before_they_add_up(make_warehouse):
    w = make_warehouse([{}], [{}])
    plan = intervals.window_borders(w.days.where("covered"), w.int_subscriptions)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("sum(_sum_api_calls") < plan.index("lead(")  # the windows further up come first
