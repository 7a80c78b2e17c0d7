"""Customer health score, 0 to 100, for live lifecycles."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import half_up
from ledgerlens.operators.rules import classify

# fixed weights and band limits
WEIGHTS = {"usage": 0.45, "tenure": 0.20, "feature": 0.20, "support": 0.15}
AT_RISK_BELOW = 40
MODERATE_BELOW = 70

_BOUNDS = {
    "max_users": "avg_active_users",
    "max_session": "avg_session_duration_mins",
    "max_integrations": "avg_integrations_used",
    "max_tickets": "total_support_tickets",
    "max_tenure_days": "subscription_length_days",
}


def features_adopted() -> Column:
    used = [F.coalesce(F.col(f"total_feature_{f}_usage") > 0, F.lit(False)).cast("int") for f in "abc"]
    return used[0] + used[1] + used[2]


def health_base(fct: DataFrame) -> DataFrame:
    """Live lifecycles with adopted features, the unscoreable mark and the zero-usage mark."""
    flag, status = F.col("data_quality_flag"), F.col("status")
    live = fct.where(F.col("subscription_id").isNotNull() & status.isin("active", "trial"))
    return live.select(
        "subscription_sk", "account_id", "plan_type", "status", "effective_mrr_usd",
        "subscription_length_days", "discount_percentage", "avg_active_users",
        "avg_session_duration_mins", "avg_integrations_used", "total_support_tickets",
        "usage_event_count",
        features_adopted().alias("features_adopted"),
        "data_quality_flag",
        F.coalesce(flag.isin(*C.USAGE_OUTLIER_FLAGS), F.lit(False)).alias("is_outlier"),
        ((status == "active") & (F.col("usage_event_count") == 0)).alias("active_zero_usage"),
    )


def health_bounds(base: DataFrame) -> DataFrame:
    """One row: the largest value of each scored metric among scoreable rows, 0 becoming NULL."""
    tops = [
        F.nullif(F.max(column), F.lit(0).cast(base.schema[column].dataType)).alias(name)
        for name, column in _BOUNDS.items()
    ]
    return base.where(~F.col("is_outlier")).agg(*tops)


def _share(column: str, top: str, whole: bool) -> Column:
    """Value over its bound as DOUBLE, or cut to a whole number; 0 where either is missing."""
    value, bound = F.col(column), F.col(f"_bounds.{top}")
    if whole:
        share = F.call_function("div", value, bound).cast("double")
    else:
        share = value.cast("double") / bound.cast("double")
    return F.coalesce(share, F.lit(0.0))


def health_components(base: DataFrame, bounds: DataFrame, int_ratio: bool = False) -> DataFrame:
    """Usage, tenure, feature and support scores, each at most 1.

    ``int_ratio`` divides the two whole-number metrics, tenure and tickets, without a remainder.
    """
    row = bounds.select(F.struct(*_BOUNDS).alias("bounds")).scalar()
    one = F.lit(1.0)
    usage = (
        _share("avg_active_users", "max_users", False)
        + _share("avg_session_duration_mins", "max_session", False)
        + _share("avg_integrations_used", "max_integrations", False)
    ) / 3
    paid = one - F.coalesce(F.col("discount_percentage").cast("double"), F.lit(0.0)) / 100
    tenure = _share("subscription_length_days", "max_tenure_days", int_ratio) * paid
    support = one - _share("total_support_tickets", "max_tickets", int_ratio) * 2
    return base.withColumn("_bounds", row).select(
        *base.columns,
        *[F.col(f"_bounds.{name}").alias(name) for name in _BOUNDS],
        F.least(usage, one).alias("usage_score"),
        F.least(tenure, one).alias("tenure_score"),
        F.least(F.col("features_adopted") / F.lit(3.0), one).alias("feature_score"),
        F.when(F.col("usage_event_count") == 0, F.lit(0.5))
        .otherwise(F.greatest(support, F.lit(0.0)))
        .alias("support_score"),
    )


def health_score(
    fct: DataFrame, int_ratio: bool = False, weights: Mapping[str, float] = WEIGHTS
) -> DataFrame:
    """Component scores, weighted score and band per live lifecycle."""
    base = health_base(fct)
    scored = health_components(base, health_bounds(base), int_ratio)
    points = 100 * (
        weights["usage"] * F.col("usage_score")
        + weights["tenure"] * F.col("tenure_score")
        + weights["feature"] * F.col("feature_score")
        + weights["support"] * F.col("support_score")
    )
    score = F.when(~F.col("is_outlier"), half_up(points, 1))
    band = classify(
        [
            (F.col("is_outlier"), C.BAND_UNSCOREABLE),
            (F.col("active_zero_usage"), C.BAND_ZERO_USAGE),
            (score < AT_RISK_BELOW, C.BAND_AT_RISK),
            (score < MODERATE_BELOW, C.BAND_MODERATE),
        ],
        C.BAND_HEALTHY,
    )
    return scored.select(
        "subscription_sk", "account_id", "plan_type", "status",
        *[half_up(F.col(f"{name}_score"), 3).alias(f"{name}_score") for name in WEIGHTS],
        score.alias("health_score"),
        band.alias("health_band"),
    )
