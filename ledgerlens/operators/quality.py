"""Data-quality checks: completeness, validity, consistency. They report rows and change none."""

import datetime as dt
from collections.abc import Mapping, Sequence
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import days_between, half_up, month_first, ratio
from ledgerlens.operators.rules import Limits, classify
from ledgerlens.operators.statistics import sigma_outliers, spread


# --- completeness -------------------------------------------------------------------------------
def duplicate_keys(df: DataFrame, *keys: str, count_name: str = "occurrences") -> DataFrame:
    """Key values held by more than one row."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias(count_name))
    return counts.where(F.col(count_name) > 1)


def null_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NULL count and share per column, from one pass over the rows."""
    counted = df.agg(
        F.count(F.lit(1)).alias("_rows"), *[F.count(c).alias(c) for c in columns]
    )
    filled = counted.unpivot("_rows", list(columns), "column_name", "_filled")
    missing = F.col("_rows") - F.col("_filled")
    return filled.select(
        "column_name",
        missing.alias("null_count"),
        ratio(missing * 100, F.col("_rows"), 1).alias("pct_null"),
    )


def missing_any(df: DataFrame, columns: Sequence[str], report: Sequence[str]) -> DataFrame:
    """Rows with a NULL in any of ``columns``."""
    return df.where(reduce(or_, [F.col(c).isNull() for c in columns])).select(*report)


# --- validity -----------------------------------------------------------------------------------
def mixed_date_rows(raw: DataFrame, columns: Sequence[str], report: Sequence[str]) -> DataFrame:
    """Raw rows with a date text that can only be month-first."""
    found = raw.where(reduce(or_, [month_first(F.col(c)) for c in columns]))
    return found.select(*report, F.lit(C.ISSUE_MIXED_DATE).alias("issue"))


def impossible_dates(lifecycles: DataFrame) -> DataFrame:
    return lifecycles.where(F.col("start_date") > F.col("end_date")).select(
        "subscription_id", "account_id", "start_date", "end_date",
        F.lit(C.ISSUE_INVERTED).alias("issue"),
    )


def long_trials(lifecycles: DataFrame, max_days: int = C.LONG_TRIAL_DAYS) -> DataFrame:
    start, end = F.col("start_date"), F.col("trial_end_date")
    return lifecycles.where(end > F.date_add(start, max_days)).select(
        "subscription_id", "account_id", "start_date", "trial_end_date",
        days_between(start, end).alias("day_difference"),
        F.lit(C.ISSUE_LONG_TRIAL).alias("issue"),
    )


def nonpositive_mrr(raw: DataFrame) -> DataFrame:
    """Raw rows outside trial whose MRR is missing, zero or negative."""
    mrr = F.col("mrr_amount")
    label = classify(
        [(mrr < 0, C.ISSUE_MRR_NEGATIVE), (mrr.isNull(), C.ISSUE_MRR_NULL)], C.ISSUE_MRR_ZERO
    )
    return raw.where((mrr.isNull() | (mrr <= 0)) & (F.col("status") != "trial")).select(
        "subscription_id", "account_id", "plan_type", "status", "mrr_amount", label.alias("issue")
    )


def mrr_sigma_global(raw: DataFrame, k: float = 2) -> DataFrame:
    """MRR above the global limit. The reported mean and deviation are those of the rows found."""
    found = sigma_outliers(raw, "mrr_amount", F.col("mrr_amount").isNotNull(), k)
    of_found = found.agg(spread(F.col("mrr_amount"), k).alias("stats")).scalar()
    return found.withColumn("_found", of_found).select(
        "subscription_id", "account_id", "plan_type", "mrr_amount",
        half_up(F.col("_found.mean"), 2).alias("avg_mrr"),
        half_up(F.col("_found.sd"), 1).alias("stddev_mrr"),
        F.lit(C.ISSUE_MRR_SIGMA).alias("issue"),
    )


def mrr_rule_classes(raw: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """MRR outside what its plan charges, named by the first rule that explains it."""
    mrr, plan = F.col("mrr_amount"), F.col("plan_type")
    annual = (
        (plan == "Enterprise")
        & (F.col("billing_period") == "annual")
        & mrr.between(limits.high, limits.extreme)
    )
    rules = [(mrr > limits.extreme, C.ISSUE_MRR_EXTREME), (annual, C.ISSUE_MRR_ANNUAL)]
    rules += [
        ((plan == p) & (mrr > limits.ceilings[p]), label) for p, label in C.ISSUE_ABOVE_PLAN.items() if p in limits.ceilings
    ]
    labelled = raw.withColumn("issue", classify(rules)).where(F.col("issue").isNotNull())
    return labelled.select(
        "subscription_id", "account_id", "plan_type", "billing_period", "mrr_amount", "issue"
    )


def negative_users(raw: DataFrame) -> DataFrame:
    return raw.where(F.col("active_users") < 0).select(
        "event_id", "account_id", "event_date", "active_users",
        F.lit(C.ISSUE_USERS_NEGATIVE).alias("issue"),
    )


def users_sigma_trimmed(events: DataFrame, trim: int = C.USER_SPIKE, k: float = 2) -> DataFrame:
    """Users above the limit of the rows below ``trim``; the value ``trim`` itself always counts."""
    users = F.col("active_users")
    found = sigma_outliers(events, "active_users", users < trim, k, also=users == trim)
    return found.select(
        "event_id", "account_id", "active_users",
        half_up(F.col("_stats.limit"), 1).alias("threshold"),
        classify([(users == trim, C.ISSUE_USERS_SPIKE)], C.ISSUE_USERS_HIGH).alias("issue"),
    )


def stale_trials(lifecycles: DataFrame, as_of: dt.date) -> DataFrame:
    late = (F.col("status") == "trial") & (F.col("trial_end_date") < F.lit(as_of))
    return lifecycles.where(late).select(
        "subscription_id", "account_id", "plan_type", "status", "start_date", "trial_end_date",
        F.lit(C.ISSUE_STALE_TRIAL).alias("issue"),
    )


def case_inconsistent(raw: DataFrame, column: str = "billing_period") -> DataFrame:
    return raw.where(F.col(column) != F.lower(column)).select(
        "subscription_id", "account_id", column, F.lit(C.ISSUE_CASING).alias("issue")
    )


# --- consistency --------------------------------------------------------------------------------
def bad_account_format(
    tables: Mapping[str, DataFrame],
    column: str = "account_id",
    pattern: str = C.ACCOUNT_ID_PATTERN,
) -> DataFrame:
    """Values that do not match ``pattern`` as a whole, with the table they came from."""
    found = [
        df.where(~F.col(column).rlike(rf"\A(?:{pattern})\z")).select(
            F.lit(name).alias("source_table"), column
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, found)
