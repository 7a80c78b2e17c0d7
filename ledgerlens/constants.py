"""Result labels, lookup tables and thresholds that reports must carry verbatim."""

from decimal import Decimal

# --- fixed lookup values ------------------------------------------------------------------------
FX_TO_USD = {"USD": Decimal("1.0000"), "EUR": Decimal("1.0800"), "GBP": Decimal("1.2700")}
PLAN_TIER = {"Basic": 1, "Starter": 2, "Professional": 3, "Enterprise": 4}
PLAN_LIST_PRICE = {
    "Basic": Decimal("29.00"),
    "Starter": Decimal("49.00"),
    "Professional": Decimal("299.00"),
    "Enterprise": Decimal("999.00"),
}
PLAN_CEILING = {"Basic": 50, "Starter": 100, "Professional": 500, "Enterprise": 2000}
BILLING_DAYS = {"monthly": 30, "quarterly": 90, "annual": 365}
ACCOUNT_ID_PATTERN = "ACC-[0-9]+"
DATE_DAY_FIRST = "d/M/yyyy"
DATE_MONTH_FIRST = "M/d/yyyy"
FAR_DATE = "9999-12-31"

# --- fixed thresholds ---------------------------------------------------------------------------
MRR_EXTREME = 50000
MRR_HIGH = 5000
USER_SPIKE = 999
LONG_TRIAL_DAYS = 60
SUSPECT_TRIAL_DAYS = 90
HIGH_DISCOUNT_PCT = 30
PENDING_DAYS = 30

# --- fixed data-quality flags -------------------------------------------------------------------
INVERTED = "inverted_dates"
SUSPECT_TRIAL = "suspect_trial_date"
ZERO_MRR = "zero_mrr_active"
UNKNOWN_CURRENCY = "unknown_currency"
NULL_MRR = "null_mrr_active"
FULL_DISCOUNT = "full_discount_zero_revenue"
OUTLIER_EXTREME = "mrr_outlier_extreme"
OUTLIER_HIGH = "mrr_outlier_high"
ANOMALY_VS_PLAN = "mrr_anomaly_vs_plan"
NO_RECORD = "no_subscription_record"
OUTSIDE_WINDOW = "usage_outside_subscription_window"
ORPHAN_KEY_PREFIX = "NO_SUB_"

REVENUE_FLAGS = (OUTLIER_EXTREME, OUTLIER_HIGH, ANOMALY_VS_PLAN)
USAGE_OUTLIER_FLAGS = (OUTLIER_EXTREME, OUTLIER_HIGH)

# --- fixed issue labels, by report --------------------------------------------------------------
ISSUE_MIXED_DATE = "Likely MM/DD/YYYY format"
ISSUE_INVERTED = "end_date is before start_date"
ISSUE_LONG_TRIAL = "Trial end date more than 60 days after start"
ISSUE_MRR_NEGATIVE = "Negative MRR"
ISSUE_MRR_NULL = "Zero MRR on non-trial subscription"
ISSUE_MRR_ZERO = "MRR is valid"
ISSUE_MRR_SIGMA = "MRR exceeds mean + 2 standard deviations"
ISSUE_MRR_EXTREME = "Extreme outlier — likely data entry error"
ISSUE_MRR_ANNUAL = "Annual value stored as MRR — should be monthly (999)"
ISSUE_ABOVE_PLAN = {
    "Basic": "Above standard Basic rate (29)",
    "Starter": "Above standard Starter rate (49)",
    "Professional": "Above standard Professional rate (299)",
    "Enterprise": "Above standard Enterprise rate (999)",
}
ISSUE_USERS_NEGATIVE = "Negative active_users — impossible value"
ISSUE_USERS_SPIKE = "Spurious spike — inconsistent with other metrics"
ISSUE_USERS_HIGH = "High but consistent — likely genuine large account"
ISSUE_STALE_TRIAL = "Trial period expired but status still shows trial"
ISSUE_CASING = "billing_period has inconsistent casing"
ISSUE_ORPHAN_EVENT = "Account exists in usage_events but not in subscriptions"
ISSUE_NO_EVENTS = "Subscription has no usage events recorded"
ISSUE_BEFORE_START = "Usage event before subscription start"
ISSUE_AFTER_END = "Usage event after subscription end"
ISSUE_OUTSIDE = "Outside subscription window"
ISSUE_PLAN_SIGMA = "MRR is an outlier within its plan type"
ISSUE_API_SIGMA = "api_calls exceeds mean + 2 standard deviations"
ISSUE_USERS_SIGMA = "active_users exceeds mean + 2 standard deviations"
ISSUE_API_SPIKE = "Spike — api_calls more than 2x account average"
ISSUE_API_DROP = "Drop — api_calls less than 25% of account average"
ISSUE_USER_SPIKE = "Spike — active_users more than 2x account average"
ISSUE_USER_DROP = "Drop — active_users less than 25% of account average"
ISSUE_NO_WINDOW = "No valid subscription window for this event"
ISSUE_TERMINAL = "Terminal status with no end_date"
ISSUE_ACTIVE_PAST_END = "Active status but end_date has passed"
ISSUE_EXPIRED_TRIAL = "Trial expired but status unchanged"
ISSUE_NO_RECORD = "No matching subscription record"
ISSUE_ZERO_USERS = "Zero active users but positive activity (api_calls/session)"
ISSUE_ACTIVE_NO_USAGE = "Active subscription with no usage events"
ISSUE_ALL_ZERO = "All metrics are zero — likely failed data collection"
ISSUE_DISCOUNT = "High discount — over 30%"
ISSUE_START_CLUSTER = "Unusual clustering of start dates"
ISSUE_DROP_TO_ZERO = "Usage dropped to zero after previous activity"
ISSUE_PENDING = "Subscription has been pending for over 30 days"
ISSUE_EVENT_CLUSTER = "Unusually high event volume on this date"

# --- fixed group and band labels ----------------------------------------------------------------
RETAINED = "Retained (active)"
CHURNED = "Churned"
BAND_UNSCOREABLE = "Unscoreable: data quality issue"
BAND_ZERO_USAGE = "HIGH RISK: active but no usage"
BAND_AT_RISK = "At risk"
BAND_MODERATE = "Moderate"
BAND_HEALTHY = "Healthy"
