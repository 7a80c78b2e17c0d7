"""Oracles of the dimensional model."""

from oracle.base import doubles, fact, over
from oracle.quality import _calendar

_MONEY = ("mrr_amount", "rate_to_usd", "mrr_usd", "effective_mrr_usd", "discount_percentage")
_AVERAGES = (
    "total_api_calls", "avg_api_calls", "avg_active_users", "max_active_users", "avg_integrations_used",
    "avg_session_duration_mins", "avg_mobile_usage_mins",
)


def _column(name: str, *inputs: str, number: tuple = ()) -> str:
    shown = ", ".join(f"{c}::DOUBLE AS {c}" if c in number else c for c in (*inputs, name))
    return over("lc", f"SELECT subscription_id, account_id, {shown} FROM lc")


ORACLES = {
    "md01_int_subscriptions": over("lc", f"SELECT * EXCLUDE (_seq) {doubles(*_MONEY)} FROM lc"),
    "md01a_mrr_usd": _column(
        "mrr_usd", "mrr_amount", "rate_to_usd", number=("mrr_usd", "mrr_amount", "rate_to_usd")
    ),
    "md01b_effective_mrr_usd": _column(
        "effective_mrr_usd", "mrr_amount", "rate_to_usd", "discount_percentage",
        number=("effective_mrr_usd", "mrr_amount", "rate_to_usd", "discount_percentage"),
    ),
    "md01c_is_active": _column("is_active", "status"),
    "md01d_subscription_length_days": _column("subscription_length_days", "start_date", "end_date"),
    "md01e_trial_length_days": _column("trial_length_days", "start_date", "trial_end_date"),
    "md01f_billing_cycle_days": _column("billing_cycle_days", "billing_period"),
    "md01g_data_quality_flag": _column(
        "data_quality_flag", "status", "mrr_amount", "plan_type", number=("mrr_amount",)
    ),
    "md02_int_usage_per_subscription": over("usage", "SELECT * FROM usage"),
    "md02a_orphan_flag": over(
        "usage", "SELECT account_id, orphan_flag, usage_event_count FROM usage WHERE orphan_flag IS NOT NULL"
    ),
    "md02b_no_sub_key": over("usage", "SELECT subscription_sk, account_id FROM usage"),
    "md03_fct_subscriptions": over(
        "fct", f"SELECT * EXCLUDE (_seq) {doubles(*_MONEY, *_AVERAGES)} FROM fct"
    ),
    "md03_fct_subscriptions_on_key_only": over(
        "usage",
        f"""SELECT * EXCLUDE (_seq) {doubles(*_MONEY, *_AVERAGES)}
FROM ({fact("u.subscription_sk = l.subscription_sk")})""",
    ),
    "md04_dim_account": over(
        "fct",
        """SELECT account_id, subscription_id AS current_subscription_id, plan_type AS current_plan_type,
  status AS current_status, mrr_amount::DOUBLE AS current_mrr_amount, currency AS current_currency,
  mrr_usd::DOUBLE AS current_mrr_usd, effective_mrr_usd::DOUBLE AS current_effective_mrr_usd, customer_segment,
  payment_method, billing_period, start_date AS current_subscription_start, end_date AS current_subscription_end,
  trial_end_date, data_quality_flag
FROM fct
QUALIFY data_quality_flag IS NOT DISTINCT FROM 'no_subscription_record' OR row_number() OVER (
  PARTITION BY account_id, data_quality_flag IS NOT DISTINCT FROM 'no_subscription_record'
  ORDER BY start_date DESC NULLS LAST, _seq DESC NULLS LAST) = 1""",
    ),
    "md05_dim_date": over("ev", _calendar("ev", "event_date")),
    "md06_dim_plan": over(
        "fct",
        """SELECT DISTINCT coalesce(plan_type, 'unknown') AS plan_type, coalesce(tier, 0) AS plan_tier,
  price::DOUBLE AS list_price_usd_monthly FROM fct LEFT JOIN plans USING (plan_type)""",
        "plans(plan_type, tier, price) AS (VALUES "
        + "('Basic', 1, 29.00), ('Starter', 2, 49.00), ('Professional', 3, 299.00), ('Enterprise', 4, 999.00)"
        + ")",
    ),
}
