"""Column layout of the two raw tables. Dates stay text because their formats are mixed."""

from pyspark.sql import types as T

_TEXT = T.StringType()
_INT = T.IntegerType()

RAW_SUBSCRIPTIONS = T.StructType(
    [
        T.StructField("subscription_id", _TEXT),
        T.StructField("account_id", _TEXT),
        T.StructField("plan_type", _TEXT),
        T.StructField("status", _TEXT),
        T.StructField("mrr_amount", T.DecimalType(12, 2)),
        T.StructField("currency", _TEXT),
        T.StructField("start_date", _TEXT),
        T.StructField("end_date", _TEXT),
        T.StructField("trial_end_date", _TEXT),
        T.StructField("created_at", _TEXT),
        T.StructField("updated_at", _TEXT),
        T.StructField("billing_period", _TEXT),
        T.StructField("customer_segment", _TEXT),
        T.StructField("payment_method", _TEXT),
        T.StructField("discount_percentage", T.DecimalType(10, 2)),
    ]
)

RAW_USAGE_EVENTS = T.StructType(
    [
        T.StructField("event_id", _TEXT),
        T.StructField("account_id", _TEXT),
        T.StructField("event_date", _TEXT),
        T.StructField("active_users", T.DecimalType(10, 2)),
        T.StructField("api_calls", T.DecimalType(10, 2)),
        T.StructField("storage_gb", T.DecimalType(8, 2)),
        T.StructField("projects_created", _INT),
        T.StructField("integrations_used", _INT),
        T.StructField("support_tickets", _INT),
        T.StructField("feature_a_usage", _INT),
        T.StructField("feature_b_usage", _INT),
        T.StructField("feature_c_usage", _INT),
        T.StructField("session_duration_mins", T.DecimalType(10, 2)),
        T.StructField("mobile_usage_mins", T.DecimalType(10, 2)),
    ]
)

# Unique per row, never reported: the last sort column wherever an order would otherwise be undefined.
SEQ = "_seq"
