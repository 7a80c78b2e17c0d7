import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgerlens.sources import files, sinks
from ledgerlens.sources.lookups import date_spine, date_spine_over, fx_rates
from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS

SUBS = """subscription_id,account_id,plan_type,status,mrr_amount,currency,start_date,end_date,trial_end_date,\
created_at,updated_at,billing_period,customer_segment,payment_method,discount_percentage
SUB-1,ACC-1,Starter,active,49,USD,01/02/2024,NULL,08/02/2024,01/02/2024 10:30,01/02/2024 10:30,monthly,,paypal,
SUB-2,ACC-2,Basic,trial,,,01/02/2024,05/02/2024,NULL,a,b,MONTHLY,SMB,NULL,12.5
"""


def test_csv_scan_reads_null_words_and_blanks_as_null(spark, tmp_path):
    path = tmp_path / "subs.csv"
    path.write_text(SUBS)
    one, two = files.scan_subscriptions(spark, str(path)).orderBy("subscription_id").collect()
    assert one.end_date is None and one.customer_segment is None and one.discount_percentage is None
    assert two.mrr_amount is None and two.currency is None and two.payment_method is None
    assert float(two.discount_percentage) == 12.5 and two.billing_period == "MONTHLY"
    loaded = files.load_raw(files.scan_subscriptions(spark, str(path)), str(tmp_path / 'raw'))
    assert [r._seq for r in loaded.orderBy('subscription_id').collect()] == [0, 1]


def test_fx_and_spine(spark):
    assert {r.currency: float(r.rate_to_usd) for r in fx_rates(spark).collect()} == {
        "USD": 1.0, "EUR": 1.08, "GBP": 1.27,
    }
    days = date_spine(spark).collect()
    assert len(days) == 366
    assert days[59].date_actual == dt.date(2024, 2, 29) and days[59].year_month == "2024-02"
    assert (days[59].month_number, days[59].quarter_number, days[59].year_number) == (2, 1, 2024)


def test_spine_over_observed_dates(spark, staged_events):
    events = staged_events(dict(event_date="28/02/2024"), dict(event_date="02/03/2024"), dict(event_date="x"))
    assert date_spine_over(events, "event_date").count() == 4
    assert date_spine_over(events.limit(0), "event_date").count() == 0


def test_materialise_is_idempotent(spark, staged_events):
    path = sinks.scratch_path(spark, "t")
    events = staged_events({}, {})
    assert sinks.materialise(events, path).count() == 2
    again = sinks.materialise(events, path)
    assert again.count() == 2 and again.schema == events.schema


def test_view_is_queryable(spark, staged_events):
    sinks.register_view(staged_events({}), "some_events")
    assert spark.sql("select count(*) as n from some_events").first().n == 1


def test_failed_rebuild_leaves_the_old_table(spark, tmp_path):
    path = str(tmp_path / "model" / "t")
    sinks.materialise(spark.range(3), path)
    broken = spark.range(4, numPartitions=4).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no"))).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        sinks.materialise(broken, path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1, 2]
    assert [p.name for p in (tmp_path / "model").iterdir()] == ["t"]
    again = sinks.materialise(spark.range(7), path)
    assert again.count() == 7
    # reading and replacing the same table
    assert sinks.materialise(again.where("id > 4"), path).count() == 2
    # a swap that was cut off is made good by the next build, failing or not
    (tmp_path / "model" / "t").rename(tmp_path / "model" / "_t.old-9")
    with pytest.raises(Exception, match="no"):
        sinks.materialise(broken, path)
    assert spark.read.parquet(path).count() == 2
    sinks.remove(spark, path)
    assert list((tmp_path / "model").iterdir()) == []


def test_bad_records_are_kept_apart(spark, tmp_path):
    path = tmp_path / "subs.csv"
    path.write_text(SUBS + "SUB-3,ACC-3,Starter,active,many,USD,01/02/2024,NULL,NULL,a,b,monthly,SMB,paypal,5\nSUB-4,ACC-4,Starter\nSUB-5,ACC-5,\"two\nlines\",active,1,USD,x,NULL,NULL,a,b,monthly,SMB,paypal,5\n")
    sound, rejected = files.load_checked(spark, str(path), RAW_SUBSCRIPTIONS, str(tmp_path / "raw"), multi_line=True)
    rows = {r.subscription_id: r for r in sound.collect()}
    assert set(rows) == {"SUB-1", "SUB-2", "SUB-5"} and rows["SUB-5"].plan_type == "two\nlines"
    assert rows["SUB-1"].end_date is None and len({r._seq for r in rows.values()}) == 3
    records = sorted(r._record for r in rejected.collect())
    assert [r.split(",")[0] for r in records] == ["SUB-3", "SUB-4"] and "many" in records[0]
    assert all(r._file.endswith("subs.csv") for r in rejected.collect())
    assert sound.columns == [*RAW_SUBSCRIPTIONS.names, "_seq"]
