"""Common table expressions, in DuckDB SQL, that the oracle queries start from."""

AS_OF = "DATE '2024-06-30'"
SPINE = ("DATE '2023-10-01'", "DATE '2024-06-30'")
FAR = "DATE '9999-12-31'"


def text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def avg(x: str, digits: int) -> str:
    return f"round((sum({x})::DOUBLE / count({x}))::DECIMAL(28,10), {digits})::DOUBLE"


def pct(part: str, whole: str, digits: int) -> str:
    return f"round((({part})::DOUBLE * 100 / nullif(({whole})::DOUBLE, 0))::DECIMAL(28,10), {digits})::DOUBLE"


def near(x: str, digits: int) -> str:
    return f"round(({x})::DECIMAL(28,10), {digits})::DOUBLE"


def _slashed(day: str, swap: str) -> str:
    return (
        f"CASE WHEN ({swap}) AND day({day}) > 12 THEN strftime({day}, '%m/%d/%Y') "
        f"ELSE strftime({day}, '%d/%m/%Y') END"
    )


def parsed(x: str) -> str:
    return (
        f"(CASE WHEN TRY_CAST(split_part({x}, '/', 2) AS INTEGER) > 12 "
        f"THEN try_strptime({x}, '%m/%d/%Y') ELSE try_strptime({x}, '%d/%m/%Y') END)::DATE"
    )


_LAYERS = {
    "raw_subs": f"""
o AS (
  SELECT o_orderkey AS k, o_custkey * 5 + o_orderkey % 5 AS a, o_custkey % 29 = 7 AS lone, c_nationkey AS n, c_mktsegment AS seg, o_orderstatus AS os,
    CASE o_orderpriority WHEN '1-URGENT' THEN 'Enterprise' WHEN '2-HIGH' THEN 'Professional'
      WHEN '4-NOT SPECIFIED' THEN 'Basic' ELSE 'Starter' END AS plan,
    CASE o_orderpriority WHEN '1-URGENT' THEN 999 WHEN '2-HIGH' THEN 299
      WHEN '4-NOT SPECIFIED' THEN 29 ELSE 49 END AS price,
    DATE '2023-10-01' + (k * 7 % 110)::INTEGER AS s,
    CASE WHEN k % 37 = 2 THEN 'trial' WHEN k % 47 = 5 THEN 'paused' WHEN k % 53 = 6 THEN 'suspended'
      WHEN os = 'F' THEN 'churned' WHEN k % 41 = 3 THEN 'pending' WHEN k % 43 = 4 THEN 'cancelled'
      ELSE 'active' END AS st,
    CASE WHEN k % 113 = 23 THEN NULL WHEN k % 97 = 10 THEN s - 31
      WHEN st IN ('churned', 'cancelled') THEN s + (k % 75 + 5)::INTEGER
      WHEN k % 59 = 9 THEN s + 20 END AS e,
    CASE WHEN plan = 'Enterprise' THEN NULL WHEN k % 83 = 11 THEN s + 372 ELSE s + 7 END AS t
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey
),
raw_subs AS (
  SELECT k AS _seq,
    CASE WHEN k % 10 = 0 THEN 'SUB-A' || a ELSE 'SUB-' || k END AS subscription_id,
    CASE WHEN k % 389 = 5 THEN 'acc-' ELSE 'ACC-' END
      || CASE WHEN lone THEN a + 1000000000 ELSE a END AS account_id,
    plan AS plan_type, st AS status,
    (CASE WHEN st = 'trial' THEN 0 WHEN k % 61 = 12 THEN -price WHEN k % 67 = 13 THEN NULL
      WHEN k % 211 = 14 THEN 99900 WHEN k % 223 = 15 THEN 11988 WHEN k % 71 = 16 THEN price * 10
      ELSE price END)::DECIMAL(12,2) AS mrr_amount,
    CASE WHEN k % 79 = 17 THEN '' WHEN n % 3 = 0 THEN 'USD' WHEN n % 3 = 1 THEN 'EUR' ELSE 'GBP' END AS currency,
    {_slashed("s", "k % 13 = 0")} AS start_date,
    {_slashed("e", "k % 13 = 0")} AS end_date,
    {_slashed("t", "k % 13 = 0")} AS trial_end_date,
    strftime(s, '%d/%m/%Y') || ' 10:30' AS created_at,
    strftime(s, '%d/%m/%Y') || ' 10:30' AS updated_at,
    CASE WHEN k % 73 = 18 THEN '' WHEN k % 31 = 4 THEN 'MONTHLY' WHEN k % 7 = 0 THEN 'annual'
      WHEN k % 7 = 1 THEN 'quarterly' ELSE 'monthly' END AS billing_period,
    CASE WHEN k % 101 = 19 THEN '' ELSE seg END AS customer_segment,
    CASE WHEN k % 89 = 20 THEN NULL WHEN k % 3 = 0 THEN 'credit_card' WHEN k % 3 = 1 THEN 'paypal'
      ELSE 'invoice' END AS payment_method,
    (CASE WHEN k % 103 = 21 THEN NULL WHEN k % 107 = 22 THEN 100 ELSE k % 11 * 5 END)::DECIMAL(10,2)
      AS discount_percentage
  FROM o
)""",
    "raw_ev": f"""
v AS (
  SELECT event_id AS e, user_id AS u, e % 101 = 4 AND e % 2 = 0 AS z,
    CASE WHEN e % 10 = 3 THEN DATE '2024-01-15' ELSE ts::DATE END AS d
  FROM events
),
raw_ev AS (
  SELECT e AS _seq, 'EVT-' || CASE WHEN e % 1009 = 7 THEN e - 1 ELSE e END AS event_id,
    'ACC-' || (u * 5 + e % 5) AS account_id, {_slashed("d", "e % 17 = 0")} AS event_date,
    (CASE WHEN e % 997 = 1 THEN -5 WHEN e % 991 = 2 THEN 999 WHEN e % 983 = 3 THEN NULL
      WHEN e % 101 = 4 THEN 0 ELSE 1 + u % 25 + e % 3 END)::DECIMAL(10,2) AS active_users,
    (CASE WHEN e % 977 = 5 THEN NULL WHEN z THEN 0 WHEN e % 971 = 6 THEN 50000
      ELSE (u % 20 + 1) * 100 + e % 50 END)::DECIMAL(10,2) AS api_calls,
    (CASE WHEN z THEN 0.0 ELSE (e % 500)::DECIMAL(8,1) * 0.1 END)::DECIMAL(8,2) AS storage_gb,
    (CASE WHEN z THEN 0 ELSE e % 4 END)::INTEGER AS projects_created,
    (CASE WHEN z THEN 0 ELSE u % 10 END)::INTEGER AS integrations_used,
    (CASE WHEN NOT z AND e % 6 = 0 THEN 1 ELSE 0 END)::INTEGER AS support_tickets,
    (CASE WHEN z THEN 0 ELSE u % 8 * (e % 5) END)::INTEGER AS feature_a_usage,
    (CASE WHEN z THEN 0 ELSE u % 4 * (e % 5) END)::INTEGER AS feature_b_usage,
    (CASE WHEN z THEN 0 ELSE u % 3 * (e % 5) END)::INTEGER AS feature_c_usage,
    (CASE WHEN z THEN 0.0 ELSE 5.5 + (e % 480)::DECIMAL(8,1) END)::DECIMAL(10,2) AS session_duration_mins,
    (CASE WHEN z THEN 0 ELSE e % 120 END)::DECIMAL(10,2) AS mobile_usage_mins
  FROM v
)""",
    "subs": f"""
typed AS (
  SELECT * REPLACE (
    CASE WHEN mrr_amount >= 0 THEN mrr_amount END AS mrr_amount,
    nullif(trim(currency), '') AS currency,
    {parsed("start_date")} AS start_date, {parsed("end_date")} AS end_date,
    {parsed("trial_end_date")} AS trial_end_date,
    lower(nullif(trim(billing_period), '')) AS billing_period,
    nullif(trim(customer_segment), '') AS customer_segment,
    nullif(trim(payment_method), '') AS payment_method)
  FROM raw_subs
),
subs AS (
  SELECT concat(subscription_id, '-', row_number() OVER (
      PARTITION BY subscription_id, account_id ORDER BY start_date NULLS LAST, _seq)) AS subscription_sk, *
  FROM typed
)""",
    "ev": f"""
ev AS (
  SELECT * REPLACE ({parsed("event_date")} AS event_date,
    CASE WHEN active_users >= 0 THEN active_users END AS active_users)
  FROM raw_ev
)""",
    "lc": f"""
fx(currency, rate_to_usd) AS (
  VALUES ('USD', 1.0000::DECIMAL(10,4)), ('EUR', 1.0800::DECIMAL(10,4)), ('GBP', 1.2700::DECIMAL(10,4))
),
ceilings(plan_type, top) AS (VALUES ('Basic', 50), ('Starter', 100), ('Professional', 500), ('Enterprise', 2000)),
lc AS (
  SELECT subs.*, fx.rate_to_usd,
    round(mrr_amount * fx.rate_to_usd, 2) AS mrr_usd,
    round(mrr_amount * fx.rate_to_usd * (1 - coalesce(discount_percentage, 0) * 0.01), 2) AS effective_mrr_usd,
    coalesce(status = 'active', false) AS is_active,
    CASE WHEN end_date >= start_date OR end_date IS NULL
      THEN date_diff('day', start_date, coalesce(end_date, {AS_OF}))::INTEGER END AS subscription_length_days,
    CASE WHEN date_diff('day', start_date, trial_end_date) BETWEEN 0 AND 90
      THEN date_diff('day', start_date, trial_end_date)::INTEGER END AS trial_length_days,
    CASE billing_period WHEN 'monthly' THEN 30 WHEN 'quarterly' THEN 90 WHEN 'annual' THEN 365 END
      AS billing_cycle_days,
    CASE WHEN start_date > end_date THEN 'inverted_dates'
      WHEN date_diff('day', start_date, trial_end_date) > 90 THEN 'suspect_trial_date'
      WHEN status = 'active' AND mrr_amount = 0 THEN 'zero_mrr_active'
      WHEN fx.rate_to_usd IS NULL THEN 'unknown_currency'
      WHEN status = 'active' AND mrr_amount IS NULL THEN 'null_mrr_active'
      WHEN discount_percentage = 100 THEN 'full_discount_zero_revenue'
      WHEN mrr_amount > 50000 THEN 'mrr_outlier_extreme'
      WHEN mrr_amount > 5000 THEN 'mrr_outlier_high'
      WHEN mrr_amount > ceilings.top THEN 'mrr_anomaly_vs_plan' END AS data_quality_flag
  FROM subs LEFT JOIN fx USING (currency) LEFT JOIN ceilings USING (plan_type)
)""",
    "usage": f"""
hits AS (
  SELECT lc.subscription_sk, lc.account_id AS owner, NULL AS orphan_flag, ev.*
  FROM lc LEFT JOIN ev ON ev.account_id = lc.account_id
    AND ev.event_date BETWEEN lc.start_date AND coalesce(lc.end_date, {FAR})
  UNION ALL BY NAME
  SELECT 'NO_SUB_' || ev.account_id AS subscription_sk, ev.account_id AS owner,
    CASE WHEN ev.account_id IN (SELECT account_id FROM lc) THEN 'usage_outside_subscription_window'
      ELSE 'no_subscription_record' END AS orphan_flag, ev.*
  FROM ev ANTI JOIN lc ON ev.account_id = lc.account_id
    AND ev.event_date BETWEEN lc.start_date AND coalesce(lc.end_date, {FAR})
),
usage AS (
  SELECT subscription_sk, owner AS account_id, count(event_id) AS usage_event_count,
    sum(api_calls)::DOUBLE AS total_api_calls, {avg("api_calls", 2)} AS avg_api_calls,
    {avg("active_users", 2)} AS avg_active_users, max(active_users)::DOUBLE AS max_active_users,
    sum(projects_created)::BIGINT AS total_projects_created,
    {avg("integrations_used", 2)} AS avg_integrations_used,
    sum(support_tickets)::BIGINT AS total_support_tickets,
    {avg("session_duration_mins", 2)} AS avg_session_duration_mins,
    {avg("mobile_usage_mins", 2)} AS avg_mobile_usage_mins,
    sum(feature_a_usage)::BIGINT AS total_feature_a_usage,
    sum(feature_b_usage)::BIGINT AS total_feature_b_usage,
    sum(feature_c_usage)::BIGINT AS total_feature_c_usage,
    orphan_flag
  FROM hits GROUP BY subscription_sk, owner, orphan_flag
)""",
}

_ATTRIBUTES = """l.subscription_id, l.plan_type, l.status, l.mrr_amount, l.currency, l.rate_to_usd,
    l.mrr_usd, l.effective_mrr_usd, l.discount_percentage, l.billing_period, l.customer_segment,
    l.payment_method, l.start_date, l.end_date, l.trial_end_date, l.created_at, l.updated_at,
    l.is_active, l.subscription_length_days, l.trial_length_days, l.billing_cycle_days"""


def fact(on: str) -> str:
    rounded = ", ".join(
        f"round(u.{c}::DECIMAL(28,10), 1) AS {c}"
        for c in (
            "avg_api_calls", "avg_active_users", "avg_integrations_used",
            "avg_session_duration_mins", "avg_mobile_usage_mins",
        )
    )
    return f"""
  SELECT u.* EXCLUDE (orphan_flag) REPLACE ({rounded}), {_ATTRIBUTES}, l._seq,
    u.usage_event_count > 0 AS has_usage,
    coalesce(u.orphan_flag, l.data_quality_flag) AS data_quality_flag
  FROM usage u LEFT JOIN lc l ON {on}"""


_LAYERS["fct"] = f"""
fct AS ({fact("u.subscription_sk = l.subscription_sk AND u.account_id = l.account_id")}
)"""

_NEEDS = {
    "raw_subs": (),
    "raw_ev": (),
    "subs": ("raw_subs",),
    "ev": ("raw_ev",),
    "lc": ("raw_subs", "subs"),
    "usage": ("raw_subs", "subs", "lc", "raw_ev", "ev"),
    "fct": ("raw_subs", "subs", "lc", "raw_ev", "ev", "usage"),
}


def over(layers: str, body: str, extra: str = "") -> str:
    """``body`` preceded by the named layers and what they need."""
    chosen: list[str] = []
    for layer in layers.split():
        for name in (*_NEEDS[layer], layer):
            if name not in chosen:
                chosen.append(name)
    parts = [_LAYERS[name].strip() for name in chosen] + ([extra.strip()] if extra else [])
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


def doubles(*columns: str) -> str:
    return "REPLACE (" + ", ".join(f"{c}::DOUBLE AS {c}" for c in columns) + ")"
