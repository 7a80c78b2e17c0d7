"""Raw subscription and usage tables derived from the star-schema test tables.

Every order becomes one lifecycle and every event row one usage event. The rules are integer
arithmetic on the keys, so that another engine can derive the very same rows; they plant each kind
of dirty record the checks look for. A customer or user owns five accounts and its rows are spread
over them by key, so that accounts have few lifecycles and some events fall between those. Customers
with ``key % 29 = 7`` get account numbers that no event uses, which leaves their users' events
without a lifecycle.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS, RAW_USAGE_EVENTS, SEQ

TABLES = ("orders", "customer", "events")
FIRST_START = "2023-10-01"
CLUSTER_DAY = "2024-01-15"
ORPHAN_SHIFT = 1_000_000_000
ACCOUNTS_PER_OWNER = 5

# fixed values: order priority -> (plan, list price); any other priority is Starter at 49
PRIORITY_PLAN = {
    "1-URGENT": ("Enterprise", 999),
    "2-HIGH": ("Professional", 299),
    "4-NOT SPECIFIED": ("Basic", 29),
}
CURRENCIES = ("USD", "EUR", "GBP")
METHODS = ("credit_card", "paypal", "invoice")


def _first(rules: list, default) -> Column:
    """Value of the first (condition, value) pair that holds."""
    chain = None
    for condition, value in rules:
        value = value if isinstance(value, Column) else F.lit(value)
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain.otherwise(default if isinstance(default, Column) else F.lit(default))


def _pick(number: Column, values: tuple) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def _date_text(day: Column, month_first: Column) -> Column:
    swapped = month_first & (F.dayofmonth(day) > 12)
    return F.when(swapped, F.date_format(day, "MM/dd/yyyy")).otherwise(
        F.date_format(day, "dd/MM/yyyy")
    )


def _shift(day: Column, days) -> Column:
    return F.date_add(day, days.cast("int") if isinstance(days, Column) else days)


def raw_subscriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"
    )
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        "c_custkey", "c_nationkey", "c_mktsegment"
    )
    joined = orders.join(customer, orders.o_custkey == customer.c_custkey, "left")

    k, owner, n = F.col("o_orderkey"), F.col("o_custkey"), F.col("c_nationkey")
    null_text = F.lit(None).cast("string")
    a = owner * ACCOUNTS_PER_OWNER + k % ACCOUNTS_PER_OWNER
    account = F.when(owner % 29 == 7, a + ORPHAN_SHIFT).otherwise(a).cast("string")
    plan = _first([(F.col("o_orderpriority") == p, v[0]) for p, v in PRIORITY_PLAN.items()], "Starter")
    price = _first([(F.col("o_orderpriority") == p, v[1]) for p, v in PRIORITY_PLAN.items()], 49)

    shaped = joined.select(
        k.alias(SEQ),
        F.when(k % 10 == 0, F.concat(F.lit("SUB-A"), a.cast("string")))
        .otherwise(F.concat(F.lit("SUB-"), k.cast("string")))
        .alias("subscription_id"),
        F.concat(F.when(k % 389 == 5, "acc-").otherwise("ACC-"), account).alias("account_id"),
        plan.alias("plan_type"),
        price.alias("price"),
        _first(
            [
                (k % 37 == 2, "trial"),
                (k % 47 == 5, "paused"),
                (k % 53 == 6, "suspended"),
                (F.col("o_orderstatus") == "F", "churned"),
                (k % 41 == 3, "pending"),
                (k % 43 == 4, "cancelled"),
            ],
            "active",
        ).alias("status"),
        _shift(F.to_date(F.lit(FIRST_START)), k * 7 % 110).alias("start"),
        _first([(k % 79 == 17, "")], _pick(n, CURRENCIES)).alias("currency"),
        _first(
            [
                (k % 73 == 18, ""),
                (k % 31 == 4, "MONTHLY"),
                (k % 7 == 0, "annual"),
                (k % 7 == 1, "quarterly"),
            ],
            "monthly",
        ).alias("billing_period"),
        _first([(k % 101 == 19, "")], F.col("c_mktsegment")).alias("customer_segment"),
        _first([(k % 89 == 20, null_text)], _pick(k, METHODS)).alias("payment_method"),
        _first(
            [(k % 103 == 21, F.lit(None).cast("int")), (k % 107 == 22, 100)],
            (k % 11 * 5).cast("int"),
        ).alias("discount"),
    )

    k, start, status, price = (F.col(c) for c in (SEQ, "start", "status", "price"))
    no_date = F.lit(None).cast("date")
    end = _first(
        [
            (k % 113 == 23, no_date),
            (k % 97 == 10, _shift(start, -31)),
            (status.isin("churned", "cancelled"), _shift(start, k % 75 + 5)),
            (k % 59 == 9, _shift(start, 20)),
        ],
        no_date,
    )
    trial_end = _first(
        [(F.col("plan_type") == "Enterprise", no_date), (k % 83 == 11, _shift(start, 372))],
        _shift(start, 7),
    )
    mrr = _first(
        [
            (status == "trial", 0),
            (k % 61 == 12, -price),
            (k % 67 == 13, F.lit(None).cast("int")),
            (k % 211 == 14, 99900),
            (k % 223 == 15, 11988),
            (k % 71 == 16, price * 10),
        ],
        price,
    )
    swapped = k % 13 == 0
    stamp = F.concat(F.date_format(start, "dd/MM/yyyy"), F.lit(" 10:30"))
    values = {
        "mrr_amount": mrr,
        "start_date": _date_text(start, swapped),
        "end_date": _date_text(end, swapped),
        "trial_end_date": _date_text(trial_end, swapped),
        "created_at": stamp,
        "updated_at": stamp,
        "discount_percentage": F.col("discount"),
    }
    return shaped.select(
        *[values.get(f.name, F.col(f.name)).cast(f.dataType).alias(f.name) for f in RAW_SUBSCRIPTIONS],
        SEQ,
    )


def raw_usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id")
    e, u = F.col("event_id"), F.col("user_id")
    account = u * ACCOUNTS_PER_OWNER + e % ACCOUNTS_PER_OWNER
    all_zero = (e % 101 == 4) & (e % 2 == 0)
    null_int = F.lit(None).cast("int")

    def unless_zero(value: Column) -> Column:
        return F.when(all_zero, F.lit(0)).otherwise(value)

    day = F.when(e % 10 == 3, F.to_date(F.lit(CLUSTER_DAY))).otherwise(F.to_date("ts"))
    values = {
        "event_id": F.concat(F.lit("EVT-"), F.when(e % 1009 == 7, e - 1).otherwise(e).cast("string")),
        "account_id": F.concat(F.lit("ACC-"), account.cast("string")),
        "event_date": _date_text(day, e % 17 == 0),
        "active_users": _first(
            [(e % 997 == 1, -5), (e % 991 == 2, 999), (e % 983 == 3, null_int), (e % 101 == 4, 0)],
            1 + u % 25 + e % 3,
        ),
        "api_calls": _first(
            [(e % 977 == 5, null_int), (all_zero, 0), (e % 971 == 6, 50000)],
            (u % 20 + 1) * 100 + e % 50,
        ),
        "storage_gb": unless_zero((e % 500).cast("decimal(8,2)") * F.lit("0.1").cast("decimal(2,1)")),
        "projects_created": unless_zero(e % 4),
        "integrations_used": unless_zero(u % 10),
        "support_tickets": unless_zero(F.when(e % 6 == 0, 1).otherwise(0)),
        "feature_a_usage": unless_zero(u % 8 * (e % 5)),
        "feature_b_usage": unless_zero(u % 4 * (e % 5)),
        "feature_c_usage": unless_zero(u % 3 * (e % 5)),
        "session_duration_mins": unless_zero((e % 480).cast("decimal(10,2)") + F.lit("5.5").cast("decimal(2,1)")),
        "mobile_usage_mins": unless_zero(e % 120),
    }
    return events.select(
        *[values[f.name].cast(f.dataType).alias(f.name) for f in RAW_USAGE_EVENTS],
        e.alias(SEQ),
    )
