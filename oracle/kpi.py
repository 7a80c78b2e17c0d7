"""Oracles of the KPIs and the product-fit reports."""

from oracle.base import FAR, SPINE, avg, near, over, pct

_MONTHS = f"""months AS (
  SELECT d::DATE AS m, strftime(d, '%Y-%m') AS year_month, (d + INTERVAL 1 MONTH)::DATE AS next
  FROM (SELECT unnest(generate_series({SPINE[0]}, {SPINE[1]}, INTERVAL 1 DAY)) AS d) WHERE day(d) = 1
)"""
_CLEAN = "coalesce(data_quality_flag, '') NOT IN ('mrr_outlier_extreme', 'mrr_outlier_high', 'mrr_anomaly_vs_plan')"
_TRUSTED = "coalesce(data_quality_flag, '') NOT IN ('mrr_outlier_extreme', 'mrr_outlier_high')"
_DATED = "data_quality_flag IS DISTINCT FROM 'inverted_dates'"
_OPEN = "start_date < m AND coalesce(end_date, m) >= m"
_LEFT = "status = 'churned' AND end_date >= m AND end_date < next"
_FEATURES = "total_feature_a_usage + total_feature_b_usage + total_feature_c_usage"
_BREADTH = " + ".join(f"coalesce((total_feature_{f}_usage > 0)::INTEGER, 0)" for f in "abc")

_MRR = f"""{_MONTHS},
mrr AS (
  SELECT year_month, count(DISTINCT account_id) AS active_accounts,
    sum(if({_CLEAN}, effective_mrr_usd, NULL))::DOUBLE AS mrr_usd_clean, sum(effective_mrr_usd)::DOUBLE AS mrr_usd_all_rows
  FROM fct JOIN months ON m BETWEEN start_date AND coalesce(end_date, {FAR})
  WHERE status = 'active' GROUP BY year_month
)"""


def _units(period: str, name: str) -> str:
    return over(
        "ev",
        f"""SELECT {period} AS {name}, count(DISTINCT account_id) AS active_accounts,
  round(coalesce(sum(top), 0), 0)::DOUBLE AS active_users
FROM days LEFT JOIN tops ON event_date = d GROUP BY 1""",
        f"""days AS (SELECT unnest(generate_series({SPINE[0]}, {SPINE[1]}, INTERVAL 1 DAY))::DATE AS d),
tops AS (SELECT event_date, account_id, max(active_users) AS top FROM ev
  WHERE coalesce(active_users, 0) < 999 GROUP BY ALL)""",
    )


_HEALTH_BASE = f"""base AS (
  SELECT subscription_sk, account_id, plan_type, status, effective_mrr_usd::DOUBLE AS effective_mrr_usd,
    subscription_length_days, discount_percentage::DOUBLE AS discount_percentage,
    avg_active_users::DOUBLE AS avg_active_users, avg_session_duration_mins::DOUBLE AS avg_session_duration_mins,
    avg_integrations_used::DOUBLE AS avg_integrations_used, total_support_tickets, usage_event_count,
    {_BREADTH} AS features_adopted, data_quality_flag, NOT ({_TRUSTED}) AS is_outlier,
    status = 'active' AND usage_event_count = 0 AS active_zero_usage
  FROM fct WHERE status IN ('trial', 'active') AND subscription_id IS NOT NULL
),
tops AS (
  SELECT nullif(max(avg_active_users), 0) AS max_users, nullif(max(avg_session_duration_mins), 0) AS max_session,
    nullif(max(avg_integrations_used), 0) AS max_integrations, nullif(max(total_support_tickets), 0) AS max_tickets,
    nullif(max(subscription_length_days), 0) AS max_tenure_days
  FROM base WHERE NOT is_outlier
)"""


def _components(divide: str) -> str:
    return f"""{_HEALTH_BASE},
parts AS (
  SELECT *,
    least((coalesce(avg_active_users / max_users, 0) + coalesce(avg_session_duration_mins / max_session, 0)
      + coalesce(avg_integrations_used / max_integrations, 0)) / 3, 1) AS usage_score,
    least(coalesce((subscription_length_days {divide} max_tenure_days)::DOUBLE, 0)
      * (1 - coalesce(discount_percentage, 0) / 100), 1) AS tenure_score,
    least(features_adopted / 3.0::DOUBLE, 1) AS feature_score,
    if(usage_event_count = 0, 0.5, greatest(
      1 - coalesce((total_support_tickets {divide} max_tickets)::DOUBLE, 0) * 2, 0))::DOUBLE AS support_score
  FROM base, tops
)"""


def _health(divide: str) -> str:
    return over(
        "fct",
        f"""SELECT subscription_sk, account_id, plan_type, status, {near("usage_score", 3)} AS usage_score,
  {near("tenure_score", 3)} AS tenure_score, {near("feature_score", 3)} AS feature_score,
  {near("support_score", 3)} AS support_score, if(is_outlier, NULL, points) AS health_score,
  CASE WHEN is_outlier THEN 'Unscoreable: data quality issue' WHEN active_zero_usage THEN 'HIGH RISK: active but no usage'
    WHEN points >= 70 THEN 'Healthy' WHEN points >= 40 THEN 'Moderate'
    ELSE 'At risk' END AS health_band
FROM scored""",
        f"""{_components(divide)},
scored AS (SELECT *, round((100 * (0.45::DOUBLE * usage_score + 0.2::DOUBLE * tenure_score
  + 0.2::DOUBLE * feature_score + 0.15::DOUBLE * support_score))::DECIMAL(28,10), 1)::DOUBLE AS points FROM parts)""",
    )


_POWER = f"""ranked AS (
  SELECT *, {_BREADTH} AS features_adopted, ntile(4) OVER (ORDER BY
    600 * coalesce(avg_active_users, 0) + 10 * coalesce(avg_session_duration_mins, 0) + 600 * usage_event_count, _seq
  ) AS quartile
  FROM fct WHERE status IN ('trial', 'active') AND subscription_id IS NOT NULL AND {_TRUSTED}
)"""


def _lifetime(where: str) -> str:
    return over(
        "fct",
        f"""SELECT count(*) AS churned_customers, {avg("days", 1)} AS avg_lifetime_days,
  {near("sum(days)::DOUBLE / (30 * count(days))", 2)} AS avg_lifetime_months
FROM (SELECT date_diff('day', min(start_date), max(end_date)) AS days FROM fct WHERE {where}
  GROUP BY account_id HAVING bool_and(end_date IS NOT NULL) AND bool_or(status = 'churned'))""",
    )


ORACLES = {
    "kp01_monthly_mrr": over("fct", "SELECT * FROM mrr", _MRR),
    "kp02_mrr_growth": over(
        "fct",
        f"""SELECT year_month, mrr_usd_clean, lag(mrr_usd_clean) OVER (ORDER BY year_month) AS prev_month_mrr,
  {near("(mrr_usd_clean - prev_month_mrr) / nullif(prev_month_mrr, 0) * 100", 2)} AS mrr_growth_pct FROM mrr""",
        _MRR,
    ),
    "kp03_arpa": over(
        "fct",
        f"""SELECT count(DISTINCT account_id) AS active_accounts, sum(effective_mrr_usd)::DOUBLE AS total_mrr_usd,
  {near("sum(effective_mrr_usd)::DOUBLE / nullif(count(DISTINCT account_id), 0)", 2)} AS arpa_usd
FROM fct WHERE status = 'active' AND {_CLEAN}""",
    ),
    "kp04_revenue_by_plan_segment": over(
        "fct",
        f"""SELECT plan_type, customer_segment, count(DISTINCT account_id) AS account_count,
  sum(effective_mrr_usd)::DOUBLE AS total_effective_mrr_usd, {avg("effective_mrr_usd", 2)} AS avg_effective_mrr_usd
FROM fct WHERE status = 'active' AND {_CLEAN} GROUP BY ALL""",
    ),
    "kp05_logo_churn": over(
        "fct",
        f"""SELECT year_month, active_at_start, churned_in_month,
  {pct("churned_in_month", "active_at_start", 2)} AS logo_churn_pct
FROM (SELECT year_month, count(DISTINCT if({_OPEN}, account_id, NULL)) AS active_at_start,
    count(DISTINCT if({_LEFT}, account_id, NULL)) AS churned_in_month
  FROM months, fct WHERE {_DATED} GROUP BY year_month)""",
        _MONTHS,
    ),
    "kp06_revenue_churn": over(
        "fct",
        f"""SELECT year_month, mrr_active_at_start, mrr_churned,
  {pct("mrr_churned", "mrr_active_at_start", 2)} AS revenue_churn_pct
FROM (SELECT year_month, coalesce(sum(if({_OPEN}, effective_mrr_usd, 0)), 0)::DOUBLE AS mrr_active_at_start,
    coalesce(sum(if({_LEFT}, effective_mrr_usd, 0)), 0)::DOUBLE AS mrr_churned
  FROM months, fct WHERE {_DATED} AND {_CLEAN} GROUP BY year_month)""",
        _MONTHS,
    ),
    "kp07_cohort_retention": over(
        "fct",
        f"""SELECT strftime(start_date, '%Y-%m') AS cohort_month, count(*) AS cohort_size,
  count_if(status = 'churned')::BIGINT AS churned, count_if(status <> 'churned')::BIGINT AS retained,
  {pct("count_if(status <> 'churned')", "count(*)", 1)} AS retention_pct
FROM fct WHERE start_date IS NOT NULL AND coalesce(data_quality_flag, 'suspect_trial_date') = 'suspect_trial_date'
GROUP BY 1""",
    ),
    "kp08_churn_by_plan": over(
        "fct",
        f"""SELECT plan_type, count(*) AS total_subscriptions, count_if(status = 'churned')::BIGINT AS churned_subscriptions,
  {pct("count_if(status = 'churned')", "count(*)", 2)} AS churn_rate_pct
FROM fct WHERE plan_type IS NOT NULL AND {_DATED} GROUP BY plan_type""",
    ),
    "kp09_customer_lifetime": _lifetime(_DATED),
    "kp09_customer_lifetime_without_orphans": _lifetime(f"{_DATED} AND subscription_id IS NOT NULL"),
    "kp10_dau": _units("d", "date_actual"),
    "kp11_wau": _units("date_trunc('week', d)::DATE", "week_start"),
    "kp12_mau": _units("strftime(d, '%Y-%m')", "year_month"),
    "kp13_feature_adoption": over(
        "fct",
        "SELECT count(*) AS subscriptions_with_usage, "
        + ", ".join(
            f"{pct(f'count_if(total_feature_{f}_usage > 0)', 'count(*)', 1)} AS feature_{f}_pct" for f in "abc"
        )
        + " FROM fct WHERE usage_event_count > 0 AND subscription_id IS NOT NULL",
    ),
    "kp14_usage_by_tier": over(
        "fct",
        f"""SELECT plan_type, count(*) AS subscriptions, {avg("avg_active_users", 1)} AS avg_active_users,
  {avg("total_api_calls", 0)} AS avg_total_api_calls, {avg("avg_session_duration_mins", 1)} AS avg_session_mins,
  {avg("total_projects_created", 1)} AS avg_projects_created, {avg("avg_integrations_used", 1)} AS avg_integrations,
  {avg("total_support_tickets", 1)} AS avg_support_tickets
FROM fct WHERE usage_event_count > 0 AND plan_type IS NOT NULL GROUP BY plan_type""",
    ),
    "kp15_usage_vs_retention": over(
        "fct",
        f"""SELECT if(status = 'active', 'Retained (active)', 'Churned') AS retention_status, count(*) AS subscriptions,
  {avg("avg_active_users", 1)} AS avg_active_users, {avg("total_api_calls", 0)} AS avg_total_api_calls,
  {avg("avg_session_duration_mins", 1)} AS avg_session_mins, {avg("usage_event_count", 1)} AS avg_usage_events,
  {avg(_FEATURES, 1)} AS avg_total_feature_usage
FROM fct WHERE usage_event_count > 0 AND status IN ('churned', 'active') GROUP BY 1""",
    ),
    "kp16_health_score": _health("/"),
    "kp16a_health_base": over("fct", "SELECT * FROM base", _HEALTH_BASE),
    "kp16b_health_bounds": over("fct", "SELECT * FROM tops", _HEALTH_BASE),
    "kp16c_health_components": over("fct", "SELECT * FROM parts", _components("/")),
    "kp16d_health_score_int_ratio": _health("//"),
    "pm01_usage_by_segment": over(
        "fct",
        f"""SELECT customer_segment, count(*) AS accounts, {avg("avg_active_users", 1)} AS avg_active_users,
  {avg("avg_session_duration_mins", 1)} AS avg_session_mins, {avg("avg_integrations_used", 1)} AS avg_integrations,
  {avg("usage_event_count", 1)} AS avg_usage_events, {avg(_FEATURES, 1)} AS avg_total_feature_usage,
  {avg(_BREADTH, 2)} AS avg_features_adopted
FROM fct WHERE customer_segment IS NOT NULL AND subscription_id IS NOT NULL AND {_TRUSTED} GROUP BY customer_segment""",
    ),
    "pm02_power_users": over(
        "fct",
        """SELECT account_id, plan_type, customer_segment, status, avg_active_users::DOUBLE AS avg_active_users,
  avg_session_duration_mins::DOUBLE AS avg_session_duration_mins, features_adopted, usage_event_count
FROM ranked WHERE quartile = 4""",
        _POWER,
    ),
    "pm03_power_user_profile": over(
        "fct",
        "SELECT customer_segment, plan_type, count(*) AS power_users FROM ranked WHERE quartile = 4 GROUP BY ALL",
        _POWER,
    ),
}
