"""Account-days: events added up per account and day, seen against the account's lifecycles.

Most reports on events ask first which account-days are concerned. An account-day knows what its
events add up to, what the account adds up to, how the account's previous day ended, and whether a
lifecycle covers it. That takes one pass over the events and one shuffle by account of the added-up
rows, in which no account has more rows than the calendar has days. Stored, the table serves the usage
rollup, the interval reports, the per-account baselines, drop detection and the activity KPIs without
shuffling by account again.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.session import lookup_words
from ledgerlens.sources.schemas import SEQ

# (event column, parts the usage rollup needs)
_ROLLUP = (
    ("api_calls", ("sum", "count")),
    ("active_users", ("sum", "count", "max")),
    ("projects_created", ("sum",)),
    ("integrations_used", ("sum", "count")),
    ("support_tickets", ("sum",)),
    ("session_duration_mins", ("sum", "count")),
    ("mobile_usage_mins", ("sum", "count")),
    ("feature_a_usage", ("sum",)),
    ("feature_b_usage", ("sum",)),
    ("feature_c_usage", ("sum",)),
)


def _parts() -> dict[str, Column]:
    parts = {"_count_events": F.count("event_id")}  # rows without an id do not count as events
    for column, kept in _ROLLUP:
        for part in kept:
            parts[f"_{part}_{column}"] = getattr(F, part)(column)
    return parts


def part_names() -> list[str]:
    return list(_parts())


def merged_parts() -> list[Column]:
    """The parts of the usage rollup, added up over account-days."""
    return [
        (F.max(name) if name.startswith("_max_") else F.sum(name)).alias(name) for name in _parts()
    ]


def until(end: Column) -> Column:
    """The last day of a window; open windows last forever."""
    return F.coalesce(end, F.lit(C.FAR_DATE).cast("date"))


def _added_up(events: DataFrame, spike: int) -> DataFrame:
    """One row per account and day.

    Next to the parts of the usage rollup: all rows, rows at zero, the smallest and largest values
    behind spike and drop checks, the day's last values by sequence, the rows with users, and those
    whose user count is not a spike with the largest count among them.
    """
    users, calls = F.col("active_users"), F.col("api_calls")
    return events.groupBy("account_id", "event_date").agg(
        *[part.alias(name) for name, part in _parts().items()],
        F.count(F.lit(1)).alias("_rows"),
        F.count_if((calls == 0) | (users == 0)).alias("_zero_rows"),
        F.min(calls).alias("_min_api_calls"),
        F.max(calls).alias("_max_api_calls"),
        F.min(users).alias("_min_active_users"),
        F.max_by(calls, SEQ).alias("_last_api_calls"),
        F.max_by(users, SEQ).alias("_last_active_users"),
        F.count_if(users > 0).alias("_positive_active_users"),
        F.count_if(users.isNull() | (users < spike)).alias("_unspiked_rows"),
        F.max(F.when(users < spike, users)).alias("_unspiked_users"),
    )


def _starts(lifecycles: DataFrame) -> DataFrame:
    """Per account and start date, the furthest end among the lifecycles begun that day."""
    start, end = F.col("start_date"), until(F.col("end_date"))
    return (
        lifecycles.where(F.col("account_id").isNotNull())
        .groupBy("account_id", start.alias("event_date"))
        .agg(F.max(F.when(end >= start, end)).alias("_reach"))
    )


def account_days(events: DataFrame, lifecycles: DataFrame, spike: int = C.USER_SPIKE) -> DataFrame:
    """One row per account and day with events, in the context of its account.

    ``covered`` tells whether a lifecycle of the account holds the day: the furthest end among the
    lifecycles begun by then has not passed, which is a running maximum over starts and days.
    ``known`` tells whether the account has any lifecycle. ``_account_*`` are sums over all days of the
    account, ``_day_before`` holds the last values of its previous day. Missing dates come last.
    """
    days = _added_up(events, spike)
    marks = days.withColumn("_is_day", F.lit(True)).unionByName(
        _starts(lifecycles).withColumn("_is_day", F.lit(False)), allowMissingColumns=True
    )
    account = Window.partitionBy("account_id")
    in_order = account.orderBy(F.asc_nulls_last("event_date"), "_is_day")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    reached = F.max("_reach").over(so_far) >= F.col("event_date")
    ending = F.struct(
        F.col("_last_api_calls").alias("api_calls"), F.col("_last_active_users").alias("active_users")
    )
    totals = ("_sum_api_calls", "_count_api_calls", "_sum_active_users", "_positive_active_users")
    return (
        marks.select(
            *days.columns,
            "_is_day",
            F.coalesce(reached, F.lit(False)).alias("covered"),
            (~F.min("_is_day").over(account)).alias("known"),
            F.last(F.when(F.col("_is_day"), ending), ignorenulls=True).over(earlier).alias("_day_before"),
            *[F.sum(c).over(account).alias(f"_account{c}") for c in totals],
        )
        .where("_is_day")
        .drop("_is_day")
    )


def listed(events: DataFrame, days: DataFrame, words: int | None = None) -> DataFrame:
    """Events that may lie on the listed account-days, by a Bloom filter of two hashes.

    The filter is an array of ``words`` numbers of 64 bits (``session.lookup_words``), whatever the number
    of days, built by one aggregate and held by every task that scans events. So most events not asked for
    are gone before the shuffle; none that is asked for is.
    """
    words = words or lookup_words(events.sparkSession)
    if words & (words - 1):
        raise ValueError("words must be a power of two")
    # the lower 32 bits of a hash and the upper ones are two hashes
    mixed = F.xxhash64("account_id", "event_date")
    places = F.array(*[F.shiftrightunsigned(mixed, k).bitwiseAND(F.lit(64 * words - 1)) for k in (0, 32)])
    word, bit = (lambda p: F.shiftrightunsigned(p, 6).cast("int")), (lambda p: p.bitwiseAND(F.lit(63)).cast("int"))
    marked = days.select(F.explode(places).alias("p")).select(word(F.col("p")).alias("w"), F.call_function("shiftleft", F.lit(1).cast("long"), bit(F.col("p"))).alias("b"))
    every = events.sparkSession.range(words).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("long").alias("b"))
    held = marked.unionByName(every).groupBy("w").agg(F.bit_or("b").alias("b"))
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("w", "b"))), lambda x: x["b"])
    table = held.agg(in_order.alias("bits")).scalar()
    found = F.forall(places, lambda p: F.shiftrightunsigned(F.get(F.col("_bits"), word(p)), 0).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), bit(p))) != 0)
    return events.withColumn("_bits", table).where(found).drop("_bits")


def events_on(events: DataFrame, days: DataFrame) -> DataFrame:
    """The events of the listed account-days, with whatever else ``days`` carries.

    ``days`` has one row per account and day. Events are first thinned out by a Bloom filter where they are
    scanned; what is left and the days are dealt by account and day, or adaptive execution broadcasts the
    days found if they turn out small.
    """
    carried = [c for c in days.columns if c not in ("account_id", "event_date")]
    keys = days.select(F.col("account_id").alias("_account"), F.col("event_date").alias("_day"), *carried)
    same_account = F.col("account_id").eqNullSafe(F.col("_account"))
    same_day = F.col("event_date").eqNullSafe(F.col("_day"))
    return listed(events, days).join(keys, same_account & same_day).drop("_account", "_day")
