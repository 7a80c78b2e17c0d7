"""Matching events to lifecycles by account and inclusive date interval.

Whether and how an event matches depends on its account and day alone. ``days`` below are the
account-days of :mod:`ledgerlens.operators.days`, which stand for the events; a lifecycle reads two rows
of its account, at the borders of its window, and never its days. Full event rows are only touched again for
reports that list them.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.functions import mean_of_parts
from ledgerlens.operators.days import events_on, merged_parts, part_names, until
from ledgerlens.operators.rules import classify


# --- unmatched rows -----------------------------------------------------------------------------
def unmatched_events(events: DataFrame, days: DataFrame, known: bool | None = None) -> DataFrame:
    """Events in no lifecycle window; ``known`` limits them to accounts with (or without) lifecycles."""
    lost = days.where(~F.col("covered"))
    if known is not None:
        lost = lost.where(F.col("known") == known)
    return events_on(events, lost.select("account_id", "event_date"))


def unmatched_lifecycles(lifecycles: DataFrame, days: DataFrame) -> DataFrame:
    """Lifecycles without an event inside their window.

    The account's first event day at or after a start decides: it is missing or past the end.
    """
    seen = days.select("account_id", F.col("event_date").alias("_day"))
    begun = lifecycles.select("account_id", F.col("start_date").alias("_day")).distinct()
    marks = seen.withColumn("_is_day", F.lit(True)).unionByName(begun.withColumn("_is_day", F.lit(False)))
    onwards = (
        Window.partitionBy("account_id")
        .orderBy(F.desc("_day"), F.desc("_is_day"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    first = (
        marks.where(F.col("account_id").isNotNull() & F.col("_day").isNotNull())
        .withColumn("_next", F.min(F.when(F.col("_is_day"), F.col("_day"))).over(onwards))
        .where(~F.col("_is_day") & F.col("_next").isNotNull())
        .select("account_id", F.col("_day").alias("start_date"), "_next")
    )
    return (
        lifecycles.join(first, ["account_id", "start_date"], "left")
        .where(F.col("_next").isNull() | (F.col("_next") > until(F.col("end_date"))))
        .select(*lifecycles.columns)
    )


# --- reports on unmatched rows ------------------------------------------------------------------
def orphan_events(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events of accounts without any lifecycle."""
    return unmatched_events(events, days, known=False).select(
        "event_id", "account_id", "event_date", F.lit(C.ISSUE_ORPHAN_EVENT).alias("issue")
    )


def orphan_events_metrics(events: DataFrame, days: DataFrame) -> DataFrame:
    return unmatched_events(events, days, known=False).select(
        "event_id", "account_id", "event_date", "active_users", "api_calls",
        F.lit(C.ISSUE_NO_RECORD).alias("issue"),
    )


def subscriptions_without_events(lifecycles: DataFrame, days: DataFrame) -> DataFrame:
    """Lifecycles of accounts without any event."""
    return lifecycles.join(days.select("account_id"), "account_id", "left_anti").select(
        "subscription_id", "account_id", "plan_type", "status", "mrr_amount",
        F.lit(C.ISSUE_NO_EVENTS).alias("issue"),
    )


def events_outside_window(events: DataFrame, days: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Each event outside every window of its account, against each lifecycle of that account.

    The report is defined on such pairs; only the unmatched events take part in the join.
    """
    lost = unmatched_events(events, days, known=True)
    own = lifecycles.select("account_id", "subscription_id", "start_date", "end_date", "status")
    day = F.col("event_date")
    reason = classify(
        [(day < F.col("start_date"), C.ISSUE_BEFORE_START), (day > F.col("end_date"), C.ISSUE_AFTER_END)],
        C.ISSUE_OUTSIDE,
    )
    return lost.select("event_id", "account_id", "event_date").join(own, "account_id").select(
        "event_id", "account_id", "event_date", "subscription_id", "start_date", "end_date", "status",
        reason.alias("issue"),
    )


def events_outside_window_summary(events: DataFrame, days: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """Each event outside every window of its account, once, against the account's lifecycles as a whole.

    ``starting_later`` lifecycles begin after the event, ``ended_before`` ended before it without
    beginning after it, the rest (missing dates) are ``undecided``. ``previous_end`` is the last end
    before the event, ``next_start`` the first start after it. Running sums over the account's calendar
    give all of them, so an account's events are never paired with its lifecycles. For an event without
    a date all lifecycles are undecided.
    """
    start, end = F.col("start_date"), F.col("end_date")
    own = lifecycles.where(F.col("account_id").isNotNull())
    totals = own.groupBy("account_id").agg(F.count(F.lit(1)).alias("_all"), F.count(start).alias("_dated"))
    begun = own.where(start.isNotNull()).groupBy("account_id", start.alias("event_date")).agg(
        F.count(F.lit(1)).alias("_begun"), F.lit(None).cast("long").alias("_ended"), F.lit(None).cast("date").alias("_end"),
    )
    # a lifecycle counts as ended from the day after its end, or from its start where that is later
    over = F.greatest(F.date_add(end, 1), start)
    ended = own.where(end.isNotNull()).groupBy("account_id", over.alias("event_date")).agg(
        F.lit(None).cast("long").alias("_begun"), F.count(F.lit(1)).alias("_ended"), F.max(end).alias("_end"),
    )
    lost = days.where(~F.col("covered") & F.col("known")).select("account_id", "event_date")
    asked = F.max("_asked").alias("_asked")
    added = [F.sum("_begun").alias("_begun"), F.sum("_ended").alias("_ended"), F.max("_end").alias("_end"), asked]
    marks = (
        lost.where(F.col("event_date").isNotNull()).withColumn("_asked", F.lit(True))
        .unionByName(begun, allowMissingColumns=True).unionByName(ended, allowMissingColumns=True)
        .groupBy("account_id", "event_date").agg(*added)
    )
    calendar = Window.partitionBy("account_id").orderBy("event_date")
    so_far = calendar.rowsBetween(Window.unboundedPreceding, 0)
    onwards = calendar.rowsBetween(1, Window.unboundedFollowing)
    dated = marks.select(
        "account_id", "event_date", "_asked",
        F.coalesce(F.sum("_begun").over(so_far), F.lit(0)).alias("_so_far"),
        F.coalesce(F.sum("_ended").over(so_far), F.lit(0)).alias("ended_before"),
        F.max("_end").over(so_far).alias("previous_end"),
        F.min(F.when(F.col("_begun").isNotNull(), F.col("event_date"))).over(onwards).alias("next_start"),
    ).where("_asked").drop("_asked")
    undated = lost.where(F.col("event_date").isNull())
    seen = dated.unionByName(undated, allowMissingColumns=True).join(totals, "account_id")
    later = F.when(F.col("event_date").isNull(), 0).otherwise(F.col("_dated") - F.col("_so_far"))
    before = F.coalesce("ended_before", F.lit(0))
    context = seen.select(
        "account_id", "event_date", later.alias("starting_later"), before.alias("ended_before"),
        (F.col("_all") - later - before).alias("undecided"), "previous_end", "next_start",
    )
    return events_on(events, context).select(
        "event_id", "account_id", "event_date", "starting_later", "ended_before", "undecided", "previous_end", "next_start"
    )


def events_no_window(events: DataFrame, days: DataFrame) -> DataFrame:
    """Events in no window, orphans included; the lifecycle columns are empty by definition."""
    return unmatched_events(events, days).select(
        "event_id", "account_id", "event_date",
        F.lit(None).cast("string").alias("subscription_id"),
        F.lit(None).cast("date").alias("start_date"),
        F.lit(None).cast("date").alias("end_date"),
        F.lit(None).cast("string").alias("status"),
        F.lit(C.ISSUE_NO_WINDOW).alias("issue"),
    )


def active_zero_usage(lifecycles: DataFrame, days: DataFrame) -> DataFrame:
    active = lifecycles.where(F.col("status") == "active")
    return unmatched_lifecycles(active, days).select(
        "subscription_id", "account_id", "plan_type", "status", "mrr_amount", "customer_segment",
        "start_date", F.lit(C.ISSUE_ACTIVE_NO_USAGE).alias("issue"),
    )


# --- rollup -------------------------------------------------------------------------------------
_BEGIN, _DAY, _END = 0, 1, 2
_KEY = ["account_id", "_day", "_side"]


def _valid(lifecycles: DataFrame) -> DataFrame:
    """account_id, start_date, _until of lifecycles whose window can hold a day."""
    ends = lifecycles.select("account_id", "start_date", until(F.col("end_date")).alias("_until"))
    return ends.where(F.col("account_id").isNotNull() & (F.col("start_date") <= F.col("_until")))


def window_borders(days: DataFrame, lifecycles: DataFrame) -> DataFrame:
    """What is known at each first and last day of a window: one row per account, ``_day`` and ``_side``.

    An account's days and the distinct borders of its windows stand in one order: a begin before its day,
    an end after it. Running sums up to a border give the sum of any window by subtraction. For the maximum
    a sparse table is doubled row by row: ``_ahead[l]`` is the maximum of the 2^l rows from here on,
    ``_back[l]`` that of the 2^l rows up to here. No account has more rows than three to a calendar day,
    however many lifecycles it has.
    """
    windows = _valid(lifecycles)
    borders = F.array(
        F.struct(F.col("start_date").alias("_day"), F.lit(_BEGIN).alias("_side")),
        F.struct(F.col("_until").alias("_day"), F.lit(_END).alias("_side")),
    )
    edges = windows.select("account_id", F.inline(borders)).distinct()
    own = days.where(F.col("account_id").isNotNull() & F.col("event_date").isNotNull())
    marks = (
        own.withColumnRenamed("event_date", "_day").select("account_id", "_day", *part_names(), F.lit(_DAY).alias("_side"))
        .unionByName(edges, allowMissingColumns=True)
    )
    # the longest order, as far as counts tell, sets how often the table is doubled
    counted = own.select("account_id", F.lit(1).alias("n")).unionByName(windows.select("account_id", F.lit(2).alias("n")))
    longest = counted.groupBy("account_id").agg(F.sum("n").alias("n")).agg(F.max("n").alias("n")).first().n or 0
    in_order = Window.partitionBy("account_id").orderBy("_day", "_side")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    peak = "_max_active_users"
    summed = [c for c in part_names() if c != peak]
    # doubled first, while rows are narrow: each level passes all columns through a window
    table = marks.withColumnRenamed(peak, "_l0")
    levels = max(1, longest.bit_length())
    for level in range(1, levels):
        reached = F.greatest(f"_l{level - 1}", F.lead(f"_l{level - 1}", 1 << (level - 1)).over(in_order))
        table = table.withColumn(f"_l{level}", reached)
    kept = table.select(
        *_KEY, F.row_number().over(in_order).alias("_row"),
        F.count(summed[0]).over(so_far).alias("_days"),
        *[F.sum(c).over(so_far).alias(c) for c in summed],
        *[F.count(c).over(so_far).alias(f"_n{c}") for c in summed],
        F.array(*[F.col(f"_l{k}") for k in range(levels)]).alias("_ahead"),
        F.array(*[F.lag(f"_l{k}", (1 << k) - 1).over(in_order) for k in range(levels)]).alias("_back"),
    ).where(F.col("_side") != _DAY)
    return kept.select(*_KEY, "_row", "_days", *summed, *[f"_n{c}" for c in summed], "_ahead", "_back")


def window_usage(days: DataFrame, lifecycles: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """Lifecycles with the event parts added up over their window, from the two border rows of each."""
    borders = window_borders(days, lifecycles) if borders is None else borders
    values = [c for c in borders.columns if c not in _KEY]

    def at(day: Column, side: int, name: str, to: DataFrame) -> DataFrame:
        found = borders.select(F.struct(*values).alias(name), *[F.col(c).alias(f"_k{c}") for c in _KEY])
        same = (F.col("account_id") == F.col("_kaccount_id")) & (day == F.col("_k_day")) & (F.col("_k_side") == side)
        return to.join(found, same, "left").drop(*[f"_k{c}" for c in _KEY])

    ends = lifecycles.withColumn("_until", until(F.col("end_date")))
    both = at(F.col("_until"), _END, "_to", at(F.col("start_date"), _BEGIN, "_from", ends))
    holds = F.col("start_date") <= F.col("_until")

    def between(column: str) -> Column:
        seen = F.col(f"_to._n{column}") > F.col(f"_from._n{column}")
        total = (F.col(f"_to.{column}") - F.coalesce(f"_from.{column}", F.lit(0))).cast(borders.schema[column].dataType)
        return F.when(holds & seen, total).alias(column)

    level = F.floor(F.log2(F.col("_to._row") - F.col("_from._row") + 1)).cast("int")
    peak = F.greatest(F.get("_from._ahead", level), F.get("_to._back", level))
    summed = [c for c in part_names() if c != "_max_active_users"]
    return both.select(*lifecycles.columns, *[between(c) for c in summed], F.when(holds, peak).alias("_max_active_users"))


def _finished(flag: Column) -> list[Column]:
    """Reported columns from added-up parts."""

    def total(column: str) -> Column:
        return F.col(f"_sum_{column}").alias(f"total_{column}")

    def average(column: str) -> Column:
        value = mean_of_parts(F.col(f"_sum_{column}"), F.col(f"_count_{column}"), 2)
        return value.alias(f"avg_{column}")

    return [
        F.coalesce("_count_events", F.lit(0)).cast("long").alias("usage_event_count"),
        total("api_calls"),
        average("api_calls"),
        average("active_users"),
        F.col("_max_active_users").alias("max_active_users"),
        total("projects_created"),
        average("integrations_used"),
        total("support_tickets"),
        average("session_duration_mins"),
        average("mobile_usage_mins"),
        total("feature_a_usage"),
        total("feature_b_usage"),
        total("feature_c_usage"),
        flag.alias("orphan_flag"),
    ]


def int_usage_per_subscription(lifecycles: DataFrame, days: DataFrame, borders: DataFrame | None = None) -> DataFrame:
    """Usage per lifecycle, plus one row per account for its events outside every lifecycle.

    This is a full outer interval join followed by a rollup, taken apart: lifecycles read the two border
    rows of their window (``borders``, where the caller has stored them), and the account-days that no
    window covers are added up per account.
    """
    own = lifecycles.select("subscription_sk", "account_id", "start_date", "end_date")
    usage = window_usage(days.where("covered"), own, borders)
    matched = usage.select("subscription_sk", "account_id", *_finished(F.lit(None).cast("string")))
    lost = days.where(~F.col("covered")).groupBy("account_id", "known").agg(*merged_parts())
    flag = F.when(F.col("known"), C.OUTSIDE_WINDOW).otherwise(C.NO_RECORD)
    key = F.concat(F.lit(C.ORPHAN_KEY_PREFIX), F.col("account_id"))
    return matched.unionByName(
        lost.select(key.alias("subscription_sk"), "account_id", *_finished(flag))
    )
