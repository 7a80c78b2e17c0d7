"""Every report by name, over the star-schema tables in one folder."""

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.constants import PLAN_TIER
from ledgerlens.functions import blank_to_null, negative_to_null, normalise_case, parse_mixed_date
from ledgerlens.operators import anomaly, intervals, quality
from ledgerlens.plans import fit, health, kpi, model
from ledgerlens.plans.warehouse import Warehouse
from ledgerlens.session import bound_tasks, fit_shuffles, report_partitions
from ledgerlens.sources import files, sinks, star
from ledgerlens.sources.lookups import date_spine_over
from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS, RAW_USAGE_EVENTS, SEQ

AS_OF = dt.date(2024, 6, 30)
SPINE_START, SPINE_END = dt.date(2023, 10, 1), AS_OF

Report = Callable[[Warehouse], DataFrame]

_PROFILED_SUBS = [c for c in RAW_SUBSCRIPTIONS.names if c not in ("created_at", "updated_at")]
_DATES = ("start_date", "end_date", "trial_end_date")

_warehouses: dict[tuple[str, str], Warehouse] = {}


def warehouse(spark: SparkSession, sf_dir: str) -> Warehouse:
    """One warehouse per application and input folder, so that stored tables are built once.

    The tables in the folder are taken not to change while the application runs.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _warehouses:
        tables = [f"{sf_dir}/{name}.parquet" for name in star.TABLES]
        fit_shuffles(spark, *tables, partitions=report_partitions)
        bound_tasks(spark, *tables)
        _warehouses[key] = Warehouse(
            spark, star.raw_subscriptions(spark, sf_dir), star.raw_usage_events(spark, sf_dir), AS_OF
        )
    return _warehouses[key]


def close() -> None:
    """Delete what the reports' warehouses have stored and forget them."""
    while _warehouses:
        _warehouses.popitem()[1].close()


def _spine() -> kpi.Spine:
    return kpi.Spine(SPINE_START, SPINE_END)


# --- sources, sinks and staging steps -----------------------------------------------------------
def _csv_round_trip(w: Warehouse, raw: DataFrame, scan: Callable, name: str) -> DataFrame:
    written = raw.drop(SEQ).write.option("header", True).option("nullValue", "NULL").option("emptyValue", "")
    return scan(w.spark, w.written_once(name, written.csv))


def _fx_rates(w: Warehouse) -> DataFrame:
    used = w.lifecycles.groupBy("currency").agg(F.count(F.lit(1)).alias("lifecycles"))
    return w.rates.join(used, "currency", "left").select(
        "currency", "rate_to_usd", F.coalesce("lifecycles", F.lit(0)).alias("lifecycles")
    )


def _register_view(w: Warehouse) -> DataFrame:
    sinks.register_view(w.events, "stg_usage_events")
    return w.spark.sql("select * from stg_usage_events")


def _materialise(w: Warehouse) -> DataFrame:
    path = w.written_once("staged_lifecycles", lambda target: sinks.materialise(w.lifecycles, target))
    return w.spark.read.schema(w.lifecycles.schema).parquet(path)


def _parsed_dates(w: Warehouse) -> DataFrame:
    raw = w.raw_subscriptions
    parsed = [parse_mixed_date(F.col(c)).alias(f"{c}_parsed") for c in _DATES]
    return raw.select("subscription_id", "account_id", *_DATES, *parsed)


def _blanks(w: Warehouse) -> DataFrame:
    columns = ("currency", "billing_period", "customer_segment", "payment_method")
    return w.raw_subscriptions.select(
        "subscription_id", "account_id", *[blank_to_null(F.col(c)).alias(c) for c in columns]
    )


def _derived(name: str, value: Callable, *inputs: str) -> Report:
    """One derived lifecycle column next to its inputs, computed from staged rows and rates."""

    def report(w: Warehouse) -> DataFrame:
        priced = w.lifecycles.join(F.broadcast(w.rates), "currency", "left")
        return priced.select("subscription_id", "account_id", *inputs, value(w).alias(name))

    return report


REPORTS: dict[str, Report] = {
    "src1_scan_subscriptions": lambda w: _csv_round_trip(
        w, w.raw_subscriptions, files.scan_subscriptions, "subscriptions_csv"
    ),
    "src2_scan_usage_events": lambda w: _csv_round_trip(
        w, w.raw_events, files.scan_usage_events, "usage_events_csv"
    ),
    "src3_fx_rates": _fx_rates,
    "src4_date_spine": lambda w: date_spine_over(w.lifecycles, "start_date"),
    "snk1_materialise": _materialise,
    "snk2_register_view": _register_view,
    "stg1_parse_mixed_date": _parsed_dates,
    "stg2_blank_to_null": _blanks,
    "stg3_normalise_case": lambda w: w.raw_subscriptions.select(
        "subscription_id", "account_id", normalise_case(F.col("billing_period")).alias("billing_period")
    ),
    "stg4_negative_to_null": lambda w: w.raw_events.select(
        "event_id", "account_id", negative_to_null(F.col("active_users")).alias("active_users")
    ),
    "stg5_lifecycle_key": lambda w: w.stg_subscriptions.select(
        "subscription_sk", "subscription_id", "account_id", "start_date", "created_at"
    ),
    "stg6_stg_subscriptions": lambda w: w.stg_subscriptions,
    "stg7_stg_usage_events": lambda w: w.events,
    # completeness
    "dq01a_dup_subscription_quick": lambda w: quality.duplicate_keys(
        w.lifecycles, "subscription_id", count_name="count"
    ),
    "dq01b_dup_event_quick": lambda w: quality.duplicate_keys(
        w.events, "event_id", count_name="count"
    ),
    "dq02_null_profile_subs": lambda w: quality.null_profile(w.lifecycles, _PROFILED_SUBS),
    "dq03_critical_missing_subs": lambda w: quality.missing_any(
        w.lifecycles,
        ["mrr_amount", "currency", "billing_period"],
        ["subscription_id", "account_id", "plan_type", "status", "mrr_amount", "currency", "billing_period"],
    ),
    "dq04_null_profile_usage": lambda w: quality.null_profile(w.events, RAW_USAGE_EVENTS.names),
    "dq05_critical_missing_usage": lambda w: quality.missing_any(
        w.events,
        ["active_users", "api_calls"],
        ["event_id", "account_id", "event_date", "active_users", "api_calls"],
    ),
    # validity
    "dq06_mixed_dates_subs": lambda w: quality.mixed_date_rows(
        w.raw_subscriptions, _DATES, ["subscription_id", "account_id", *_DATES]
    ),
    "dq07_mixed_dates_usage": lambda w: quality.mixed_date_rows(
        w.raw_events, ["event_date"], ["event_id", "account_id", "event_date"]
    ),
    "dq08_impossible_dates": lambda w: quality.impossible_dates(w.lifecycles),
    "dq09_long_trials": lambda w: quality.long_trials(w.lifecycles),
    "dq10_nonpositive_mrr": lambda w: quality.nonpositive_mrr(w.raw_subscriptions),
    "dq11_mrr_sigma_global": lambda w: quality.mrr_sigma_global(w.raw_subscriptions),
    "dq12_mrr_rule_classes": lambda w: quality.mrr_rule_classes(w.raw_subscriptions),
    "dq13_negative_users": lambda w: quality.negative_users(w.raw_events),
    "dq14_users_sigma_trimmed": lambda w: quality.users_sigma_trimmed(w.events),
    "dq15_stale_trials": lambda w: quality.stale_trials(w.lifecycles, w.as_of),
    "dq16_case_inconsistent": lambda w: quality.case_inconsistent(w.raw_subscriptions),
    # consistency
    "dq17_dup_subscription_ids": lambda w: quality.duplicate_keys(w.lifecycles, "subscription_id"),
    "dq18_orphan_events": lambda w: intervals.orphan_events(w.events, w.days),
    "dq19_subs_without_events": lambda w: intervals.subscriptions_without_events(w.lifecycles, w.days),
    "dq20_bad_account_format": lambda w: quality.bad_account_format(
        {"stg_subscriptions": w.lifecycles, "stg_usage_events": w.events}
    ),
    "dq21_events_outside_window": lambda w: intervals.events_outside_window(
        w.events, w.days, w.lifecycles
    ),
    "dq21_events_outside_window_summary": lambda w: intervals.events_outside_window_summary(
        w.events, w.days, w.lifecycles
    ),
    # statistical anomalies
    "an01_mrr_sigma_by_plan": lambda w: anomaly.mrr_sigma_by_plan(w.lifecycles),
    "an02_api_sigma": lambda w: anomaly.api_sigma(w.events),
    "an03_users_sigma": lambda w: anomaly.users_sigma(w.events),
    "an04_api_spike_drop": lambda w: anomaly.api_spike_drop(w.events, w.days),
    "an05_users_spike_drop": lambda w: anomaly.users_spike_drop(w.events, w.days),
    # business-logic anomalies
    "an06_end_before_start": lambda w: anomaly.end_before_start(w.lifecycles),
    "an07_events_no_window": lambda w: intervals.events_no_window(w.events, w.days),
    "an08_terminal_without_end": lambda w: anomaly.terminal_without_end(w.lifecycles),
    "an09_active_past_end": lambda w: anomaly.active_past_end(w.lifecycles, w.as_of),
    "an10_expired_trials": lambda w: anomaly.expired_trials(w.lifecycles, w.as_of),
    "an11_orphan_events_metrics": lambda w: intervals.orphan_events_metrics(w.events, w.days),
    "an12_zero_users_activity": lambda w: anomaly.zero_users_activity(w.events),
    # pattern anomalies
    "an13_active_zero_usage": lambda w: intervals.active_zero_usage(w.lifecycles, w.days),
    "an14_all_zero_events": lambda w: anomaly.all_zero_events(w.events),
    "an15_high_discount": lambda w: anomaly.high_discount(w.lifecycles),
    "an16_start_date_clusters": lambda w: anomaly.start_date_clusters(w.lifecycles),
    "an17_drop_to_zero": lambda w: anomaly.drop_to_zero(w.events, w.days),
    "an18_long_pending": lambda w: anomaly.long_pending(w.lifecycles, w.as_of),
    "an19_event_date_clusters": lambda w: anomaly.event_date_clusters(w.days),
    # model
    "md01_int_subscriptions": lambda w: w.build_int_subscriptions(),
    "md01a_mrr_usd": _derived(
        "mrr_usd", lambda w: model.mrr_usd(), "mrr_amount", "rate_to_usd"
    ),
    "md01b_effective_mrr_usd": _derived(
        "effective_mrr_usd", lambda w: model.effective_mrr_usd(),
        "mrr_amount", "rate_to_usd", "discount_percentage",
    ),
    "md01c_is_active": _derived("is_active", lambda w: model.is_active(), "status"),
    "md01d_subscription_length_days": _derived(
        "subscription_length_days", lambda w: model.subscription_length_days(w.as_of),
        "start_date", "end_date",
    ),
    "md01e_trial_length_days": _derived(
        "trial_length_days", lambda w: model.trial_length_days(), "start_date", "trial_end_date"
    ),
    "md01f_billing_cycle_days": _derived(
        "billing_cycle_days", lambda w: model.billing_cycle_days(), "billing_period"
    ),
    "md01g_data_quality_flag": _derived(
        "data_quality_flag", lambda w: model.data_quality_flag(), "status", "mrr_amount", "plan_type"
    ),
    "md02_int_usage_per_subscription": lambda w: w.build_int_usage(),
    "md02a_orphan_flag": lambda w: w.int_usage.where(F.col("orphan_flag").isNotNull()).select(
        "account_id", "orphan_flag", "usage_event_count"
    ),
    "md02b_no_sub_key": lambda w: w.int_usage.select("subscription_sk", "account_id"),
    "md03_fct_subscriptions": lambda w: w.build_fct(),
    "md03_fct_subscriptions_on_key_only": lambda w: w.build_fct(("subscription_sk",)),
    "md04_dim_account": lambda w: model.dim_account(w.fct),
    "md05_dim_date": lambda w: date_spine_over(w.events, "event_date"),
    "md06_dim_plan": lambda w: model.dim_plan(w.fct),
    # revenue and churn
    "kp01_monthly_mrr": lambda w: kpi.monthly_mrr(w.fct, _spine()),
    "kp02_mrr_growth": lambda w: kpi.mrr_growth(w.fct, _spine()),
    "kp03_arpa": lambda w: kpi.arpa(w.fct),
    "kp04_revenue_by_plan_segment": lambda w: kpi.revenue_by_plan_segment(w.fct),
    "kp05_logo_churn": lambda w: kpi.logo_churn(w.fct, _spine()),
    "kp06_revenue_churn": lambda w: kpi.revenue_churn(w.fct, _spine()),
    "kp07_cohort_retention": lambda w: kpi.cohort_retention(w.fct),
    "kp08_churn_by_plan": lambda w: kpi.churn_by_plan(w.fct),
    "kp09_customer_lifetime": lambda w: kpi.customer_lifetime(w.fct),
    "kp09_customer_lifetime_without_orphans": lambda w: kpi.customer_lifetime(w.fct, exclude_orphans=True),
    # engagement
    "kp10_dau": lambda w: kpi.dau(w.days_between(SPINE_START, SPINE_END), _spine()),
    "kp11_wau": lambda w: kpi.wau(w.days_between(SPINE_START, SPINE_END), _spine()),
    "kp12_mau": lambda w: kpi.mau(w.days_between(SPINE_START, SPINE_END), _spine()),
    "kp13_feature_adoption": lambda w: kpi.feature_adoption(w.fct),
    "kp14_usage_by_tier": lambda w: kpi.usage_by_tier(w.fct),
    "kp15_usage_vs_retention": lambda w: kpi.usage_vs_retention(w.fct),
    "kp16_health_score": lambda w: health.health_score(w.fct),
    "kp16a_health_base": lambda w: health.health_base(w.fct),
    "kp16b_health_bounds": lambda w: health.health_bounds(health.health_base(w.fct)),
    "kp16c_health_components": lambda w: health.health_components(
        health.health_base(w.fct), health.health_bounds(health.health_base(w.fct))
    ),
    "kp16d_health_score_int_ratio": lambda w: health.health_score(w.fct, int_ratio=True),
    # product fit
    "pm01_usage_by_segment": lambda w: fit.usage_by_segment(w.fct),
    "pm02_power_users": lambda w: fit.power_users(w.fct),
    "pm03_power_user_profile": lambda w: fit.power_user_profile(w.fct),
}


# Presentation order of a report: (column, descending). Sets are compared and stored unordered.
ORDER: dict[str, tuple[tuple[str, bool], ...]] = {
    "dq02_null_profile_subs": (("null_count", True),),
    "dq03_critical_missing_subs": (("subscription_id", False),),
    "dq04_null_profile_usage": (("null_count", True),),
    "dq05_critical_missing_usage": (("event_id", False),),
    "dq06_mixed_dates_subs": (("subscription_id", False),),
    "dq07_mixed_dates_usage": (("event_id", False),),
    "dq10_nonpositive_mrr": (("mrr_amount", False),),
    "dq11_mrr_sigma_global": (("mrr_amount", True),),
    "dq12_mrr_rule_classes": (("mrr_amount", True),),
    "dq14_users_sigma_trimmed": (("active_users", True),),
    "dq17_dup_subscription_ids": (("occurrences", True),),
    "dq18_orphan_events": (("account_id", False),),
    "dq19_subs_without_events": (("plan_type", False), ("mrr_amount", True)),
    "dq20_bad_account_format": (("source_table", False), ("account_id", False)),
    "dq21_events_outside_window": (("account_id", False), ("event_date", False)),
    "dq21_events_outside_window_summary": (("account_id", False), ("event_date", False)),
    "an01_mrr_sigma_by_plan": (("plan_type", False), ("mrr_amount", True)),
    "an02_api_sigma": (("api_calls", True),),
    "an03_users_sigma": (("active_users", True),),
    "an04_api_spike_drop": (("ratio_to_avg", True),),
    "an05_users_spike_drop": (("ratio_to_avg", True),),
    "an06_end_before_start": (("days_difference", False),),
    "an07_events_no_window": (("account_id", False), ("event_date", False)),
    "an08_terminal_without_end": (("status", False), ("subscription_id", False)),
    "an09_active_past_end": (("end_date", False),),
    "an10_expired_trials": (("days_since_trial_ended", True),),
    "an11_orphan_events_metrics": (("account_id", False), ("event_date", False)),
    "an12_zero_users_activity": (("account_id", False), ("event_date", False)),
    "an13_active_zero_usage": (("mrr_amount", True),),
    "an14_all_zero_events": (("account_id", False), ("event_date", False)),
    "an15_high_discount": (("discount_percentage", True),),
    "an16_start_date_clusters": (("subscriptions_started", True), ("start_date", False)),
    "an17_drop_to_zero": (("account_id", False), ("event_date", False)),
    "an18_long_pending": (("days_pending", True),),
    "an19_event_date_clusters": (("events_on_day", True),),
    "md06_dim_plan": (("plan_tier", False),),
    "kp01_monthly_mrr": (("year_month", False),),
    "kp02_mrr_growth": (("year_month", False),),
    "kp04_revenue_by_plan_segment": (("total_effective_mrr_usd", True),),
    "kp05_logo_churn": (("year_month", False),),
    "kp06_revenue_churn": (("year_month", False),),
    "kp07_cohort_retention": (("cohort_month", False),),
    "kp08_churn_by_plan": (("churn_rate_pct", True),),
    "kp10_dau": (("date_actual", False),),
    "kp11_wau": (("week_start", False),),
    "kp12_mau": (("year_month", False),),
    "kp15_usage_vs_retention": (("retention_status", False),),
    "pm01_usage_by_segment": (("avg_usage_events", True),),
    "pm02_power_users": (("usage_event_count", True), ("avg_active_users", True)),
    "pm03_power_user_profile": (("power_users", True),),
}


def ordered(name: str, df: DataFrame) -> DataFrame:
    """``df`` in the report's presentation order; missing values sort as the largest."""
    if name == "kp14_usage_by_tier":
        tier = F.lit(None).cast("int")
        for plan, number in PLAN_TIER.items():
            tier = F.when(F.col("plan_type") == plan, number).otherwise(tier)
        return df.orderBy(tier.asc_nulls_last())
    keys = [F.desc_nulls_first(c) if down else F.asc_nulls_last(c) for c, down in ORDER.get(name, ())]
    return df.orderBy(*keys) if keys else df


def plain(df: DataFrame) -> DataFrame:
    """Without the internal sequence, and with decimals as DOUBLE for clients of any kind."""
    return df.select(
        *[
            F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)
            for f in df.schema
            if f.name != SEQ
        ]
    )


def report(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain(REPORTS[name](warehouse(spark, sf_dir)))
