"""What the plans must look like at scale: no needless shuffles, pruned scans, shared work."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import anomaly, intervals, quality
from ledgerlens.operators.staging import stage_subscriptions, stg_usage_events
from ledgerlens.plans import fit, kpi, model
from ledgerlens.sources.lookups import fx_rates
from ledgerlens.sources.sinks import materialise


@pytest.fixture(scope="module")
def w(make_warehouse, spark, raw_subs, raw_events, tmp_path_factory):
    """A warehouse over stored raw tables, so that scans show what they read."""
    folder = str(tmp_path_factory.mktemp("raw"))
    built = make_warehouse([{}, dict(subscription_id="SUB-2", account_id="ACC-2")], [{}, dict(account_id="ACC-3")])
    built.raw_subscriptions = materialise(built.raw_subscriptions, folder + "/subs")
    built.raw_events = materialise(built.raw_events, folder + "/events")
    return built


def plan(df, run=False):
    if run:
        df.write.format("noop").mode("overwrite").save()
        df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def read_columns(text):
    return [set(re.findall(r"(\w+):", schema)) for schema in re.findall(r"ReadSchema: struct<([^>]*)>", text)]


def test_staging_is_a_projection(w):
    for staged in (stage_subscriptions(w.raw_subscriptions), stg_usage_events(w.raw_events)):
        assert "Exchange" not in plan(staged) and "Window" not in plan(staged)


def test_fx_join_is_broadcast_without_a_shuffle(spark, w):
    keyed = w.lifecycles.withColumn("subscription_sk", F.lit("x"))
    text = plan(model.int_subscriptions(keyed, fx_rates(spark), w.as_of))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text


def test_null_profile_scans_once(w):
    text = plan(quality.null_profile(w.lifecycles, ["currency", "end_date", "status"]))
    assert text.count("FileScan") == 1 and read_columns(text) == [{"currency", "end_date", "status"}]


def test_row_checks_read_only_what_they_report(w):
    text = plan(quality.negative_users(w.raw_events))
    assert read_columns(text) == [{"event_id", "account_id", "event_date", "active_users"}]
    assert "GreaterThan" in text or "LessThan(active_users" in text
    assert "Exchange" not in text


def test_rollup_shuffles_covered_days_by_account_only(w):
    text = plan(w.build_int_usage(), run=True)
    # days are read for the uncovered rows alone, windows read the stored borders
    assert len(re.findall(r"DataFilters: \[[^]]*covered", text)) == 1 and text.count("_ahead") > 0
    assert "SortMergeJoin FullOuter" not in text and "Window" not in text
    borders = plan(intervals.window_borders(w.days.where("covered"), w.int_subscriptions), run=True)
    assert len(re.findall(r"DataFilters: \[[^]]*covered", borders)) == 1
    assert len(re.findall(r"Exchange hashpartitioning\(account_id#\d+, \d+\)", borders)) == 1


def test_baselines_need_no_shuffle_by_account(w):
    text = plan(anomaly.api_spike_drop(w.events, w.days), run=True)
    assert "hashpartitioning(account_id" not in text and "Window" not in text


def test_few_unmatched_days_are_broadcast_to_the_events(w):
    text = plan(intervals.events_no_window(w.events, w.days), run=True)
    outer = text.split("InMemoryRelation")[0]
    assert "BroadcastHashJoin" in outer
    # only the filter's words are dealt out, neither events nor days
    assert not re.search(r"hashpartitioning\((?!w#)", outer)


def test_kpis_prune_and_push_down(w):
    text = plan(kpi.arpa(w.fct))
    assert read_columns(text) == [{"account_id", "status", "effective_mrr_usd", "data_quality_flag"}]
    assert "EqualTo(status,active)" in text


def test_labelling_tiles_neither_sorts_nor_shuffles_the_rows(w):
    own = []  # the nodes from the result down to its scan, without those of subqueries
    for line in plan(fit.power_quartile(w.fct)).splitlines():
        indent, _, node = line.partition("+- ")
        if node and ":" not in indent:
            own.append(node.split()[0])
            if own[-1] == "FileScan":
                break
    assert own[-1] == "FileScan" and "Project" in own
    assert not {"Exchange", "Sort", "Window"} & set(own)


def test_a_range_of_days_reads_its_own_months(make_warehouse):
    events = [dict(event_id=f"e{m}", event_date=f"05/{m:02}/2024") for m in range(1, 7)] + [dict(event_id="none", event_date="?")]
    w = make_warehouse([dict(start_date="01/01/2024")], events)
    first, last = dt.date(2024, 2, 3), dt.date(2024, 3, 5)
    for df, n in ((w.events_between(first, last), 2), (w.days_between(first, last), 2)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(_event_month" in plan
        read = {f for f in df.select(F.input_file_name().alias("f")).distinct().toPandas()["f"]}
        assert {f.split("_event_month=")[1][:7] for f in read} == {"2024-02", "2024-03"}
        assert df.count() == n
    assert w.events.count() == 7 and w.days.count() == 7 and "_event_month" not in w.events.columns + w.days.columns
    w.close()


def test_latest_rows_are_hash_aggregated(make_warehouse):
    w = make_warehouse([dict(start_date="01/01/2024"), dict(start_date="05/01/2024", subscription_id="b")], [])
    df = model.dim_account(w.fct)
    assert [r.current_subscription_start for r in df.collect()] == [dt.date(2024, 1, 5)]
    assert "SortAggregate" not in df._jdf.queryExecution().executedPlan().toString()
    w.close()


def test_swept_months_do_not_expand(make_warehouse):
    w = make_warehouse([dict(subscription_id=str(i), start_date="01/01/2024") for i in range(40)], [])
    spine = kpi.Spine(dt.date(2000, 1, 1), dt.date(2039, 12, 31))
    rows = kpi.logo_churn(w.fct, spine).collect()
    assert len(rows) == 480 and sum(r.active_at_start for r in rows) == 16 * 12 - 1
    plan = kpi._live(w.fct, spine, [])._jdf.queryExecution().analyzed().toString()
    assert plan.count("sequence(") == 1  # the spine's own months
    w.close()
