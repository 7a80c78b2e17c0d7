"""Every registered report against its SQL counterpart, and the shape of its plan."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry_points
from ledgerlens.plans import reports

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_oracle_shares_nothing_with_the_engine():
    """Labels, rates and thresholds stand in the SQL as literals, so a wrong one in the engine shows."""
    sources = glob.glob(os.path.join(os.path.dirname(entry_points.__file__), "oracle", "*.py"))
    assert sources and not any("ledgerlens" in open(path).read() for path in sources)


def test_every_report_has_an_oracle():
    assert set(reports.REPORTS) <= set(entry_points.queries())
    assert set(reports.REPORTS) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", list(reports.REPORTS))
def test_report_matches_oracle(spark, sql, name):
    df = entry_points.queries()[name](spark, SF)
    relation = sql.sql(entry_points.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    got = [tuple(row[c] for c in columns) for row in df.collect()]
    want = [tuple(row[i] for i in places) for row in relation.fetchall()]
    assert sorted(map(str, got)) == sorted(map(str, want))

    plan = df._jdf.queryExecution().executedPlan().toString()
    for operator in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "BatchEvalPython", "ArrowEvalPython"):
        assert operator not in plan


def test_copies_are_written_once_and_removed(spark):
    reports.close()
    names = ("src1_scan_subscriptions", "src2_scan_usage_events", "snk1_materialise")
    files = [reports.report(name, spark, SF).inputFiles() for name in names]
    assert files == [reports.report(name, spark, SF).inputFiles() for name in names]
    places = {os.path.dirname(path.removeprefix("file:")) for found in files for path in found}
    assert len(places) == 3 and all(map(os.path.isdir, places))
    reports.close()
    assert not any(map(os.path.exists, places))


def test_entry_runs(spark):
    assert entry_points.entry(spark).count() > 0


def test_presentation_order(spark):
    name = "kp04_revenue_by_plan_segment"
    rows = reports.ordered(name, reports.report(name, spark, SF)).collect()
    totals = [r.total_effective_mrr_usd for r in rows]
    assert totals == sorted(totals, reverse=True)
    tiers = reports.ordered("kp14_usage_by_tier", reports.report("kp14_usage_by_tier", spark, SF)).collect()
    assert [r.plan_type for r in tiers] == ["Basic", "Starter", "Professional", "Enterprise"]


def test_order_names_reports_and_their_columns(spark):
    for name, keys in reports.ORDER.items():
        assert {column for column, _ in keys} <= set(reports.report(name, spark, SF).columns)
