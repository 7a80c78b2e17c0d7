import datetime as dt
import os
import sys
from decimal import Decimal

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS, RAW_USAGE_EVENTS, SEQ  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _frame(spark, schema, defaults, rows):
    names = [*schema.names, SEQ]
    filled = []
    for i, row in enumerate(rows):
        full = {**defaults, **row}
        full.setdefault(SEQ, i)
        filled.append(
            tuple(
                Decimal(str(full[c])) if full.get(c) is not None and "decimal" in schema[c].dataType.simpleString()
                else full.get(c)
                for c in schema.names
            )
            + (full[SEQ],)
        )
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema) + f", {SEQ} long"
    assert names
    return spark.createDataFrame(filled, fields)


@pytest.fixture(scope="session")
def raw_subs(spark):
    """Raw lifecycles from dicts; unset columns describe a clean, active, monthly Starter."""
    defaults = dict(
        subscription_id="SUB-1", account_id="ACC-1", plan_type="Starter", status="active", mrr_amount=49,
        currency="USD", start_date="01/02/2024", end_date=None, trial_end_date=None,
        created_at="01/02/2024 10:30", updated_at="01/02/2024 10:30", billing_period="monthly",
        customer_segment="SMB", payment_method="paypal", discount_percentage=0,
    )
    return lambda *rows: _frame(spark, RAW_SUBSCRIPTIONS, defaults, rows)


@pytest.fixture(scope="session")
def raw_events(spark):
    """Raw events from dicts; unset columns describe an ordinary event of ACC-1 on 2024-02-10."""
    defaults = dict(
        event_id="EVT-1", account_id="ACC-1", event_date="10/02/2024", active_users=5, api_calls=100,
        storage_gb=1, projects_created=1, integrations_used=2, support_tickets=0, feature_a_usage=1,
        feature_b_usage=0, feature_c_usage=0, session_duration_mins=60, mobile_usage_mins=6,
    )
    return lambda *rows: _frame(spark, RAW_USAGE_EVENTS, defaults, rows)


@pytest.fixture(scope="session")
def staged_subs(raw_subs):
    from ledgerlens.operators.staging import stage_subscriptions

    return lambda *rows: stage_subscriptions(raw_subs(*rows))


@pytest.fixture(scope="session")
def staged_events(raw_events):
    from ledgerlens.operators.staging import stg_usage_events

    return lambda *rows: stg_usage_events(raw_events(*rows))


@pytest.fixture(scope="session")
def make_warehouse(spark, raw_subs, raw_events):
    from ledgerlens.plans.warehouse import Warehouse

    def build(subs, events, as_of=dt.date(2024, 12, 31)):
        return Warehouse(spark, raw_subs(*subs), raw_events(*events), as_of)

    return build
