"""The tables every report reads: raw, staged and modelled, over one pair of raw tables."""

import datetime as dt
from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens import constants as C
from ledgerlens.operators.days import account_days
from ledgerlens.operators.intervals import int_usage_per_subscription, window_borders
from ledgerlens.operators.rules import Limits
from ledgerlens.operators.staging import lifecycle_key, stage_subscriptions, stg_usage_events
from ledgerlens.plans import model
from ledgerlens.sources.lookups import date_spine, fx_rates
from ledgerlens.sources.schemas import SEQ
from ledgerlens.sources.sinks import materialise, register_view, remove, scratch_path


MONTH = "_event_month"


def _within(by_month: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    months = F.col(MONTH).between(f"{first:%Y-%m}", f"{last:%Y-%m}")
    return by_month.where(months & F.col("event_date").between(F.lit(first), F.lit(last))).drop(MONTH)


class Warehouse:
    """Raw frames as given; staged and modelled tables that are written once on first use.

    Staged lifecycles and events and four modelled tables are read by many reports, so they are stored
    as Parquet in the session's shared folder: dates are parsed once, readers prune columns and push
    filters down, events are added up and shuffled by account only once, and a lost executor does not
    rebuild the interval rollup. Events and account-days lie in a folder for each month, so a range of days
    reads its own months. ``close`` deletes what was stored. ``rates`` (currency to USD) replaces
    the built-in exchange rates, ``spike`` the user count above which activity KPIs leave an event out, ``limits``
    those of the quality flag.
    """

    def __init__(
        self,
        spark: SparkSession,
        subscriptions: DataFrame,
        events: DataFrame,
        as_of: dt.date,
        rates: dict | None = None,
        spike: int = C.USER_SPIKE,
        limits: Limits = Limits(),
    ):
        self.spark = spark
        self.raw_subscriptions = subscriptions
        self.raw_events = events
        self.as_of = as_of
        self.rates = fx_rates(spark, rates)
        self.spike = spike
        self.limits = limits
        self._paths: dict[str, str] = {}

    @cached_property
    def lifecycles(self) -> DataFrame:
        """Staged subscriptions without the lifecycle key, for checks that do not need it."""
        return self._stored(stage_subscriptions(self.raw_subscriptions), "lifecycles")

    @cached_property
    def stg_subscriptions(self) -> DataFrame:
        return self._stored(lifecycle_key(self.lifecycles), "stg_subscriptions")

    @cached_property
    def _events_by_month(self) -> DataFrame:
        return self._by_month(stg_usage_events(self.raw_events), "events")

    @property
    def events(self) -> DataFrame:
        return self._events_by_month.drop(MONTH)

    def events_between(self, first: dt.date, last: dt.date) -> DataFrame:
        """Staged events of a range of days, from the folders of its months alone."""
        return _within(self._events_by_month, first, last)

    def build_int_subscriptions(self) -> DataFrame:
        return model.int_subscriptions(self.stg_subscriptions, self.rates, self.as_of, self.limits)

    def build_int_usage(self) -> DataFrame:
        return int_usage_per_subscription(self.int_subscriptions, self.days, self.borders)

    def build_fct(self, on: tuple[str, ...] = ("subscription_sk", "account_id")) -> DataFrame:
        return model.fct_subscriptions(self.int_usage, self.int_subscriptions, on)

    def publish(self, folder: str, spine_start: dt.date, spine_end: dt.date) -> dict[str, DataFrame]:
        """Write the six model tables under ``folder``, replacing older ones, and name all for SQL.

        The raw tables, the exchange rates and the staged tables are named as well.
        """
        register_view(self.raw_subscriptions.drop(SEQ), "subscriptions")
        register_view(self.raw_events.drop(SEQ), "usage_events")
        register_view(self.rates, "seed_exchange_rates")
        register_view(self.stg_subscriptions.drop(SEQ), "stg_subscriptions")
        register_view(self.events.drop(SEQ), "stg_usage_events")
        tables = {
            "int_subscriptions": self.int_subscriptions.drop(SEQ),
            "int_usage_per_subscription": self.int_usage,
            "fct_subscriptions": self.fct.drop(SEQ),
            "dim_account": model.dim_account(self.fct),
            "dim_date": date_spine(self.spark, spine_start, spine_end),
            "dim_plan": model.dim_plan(self.fct),
        }
        return {
            name: register_view(materialise(df, f"{folder}/{name}"), name) for name, df in tables.items()
        }

    def _stored(self, df: DataFrame, name: str) -> DataFrame:
        self._paths[name] = scratch_path(self.spark, name)
        return materialise(df, self._paths[name])

    def _by_month(self, df: DataFrame, name: str) -> DataFrame:
        """Stored in a folder for each month of the event date; rows without a date have one of their own."""
        self._paths[name] = scratch_path(self.spark, name)
        return materialise(df.withColumn(MONTH, F.date_format("event_date", "yyyy-MM")), self._paths[name], [MONTH])

    def written_once(self, name: str, write: Callable[[str], object]) -> str:
        """The path of a copy that ``write`` makes at the first call; later calls read the same one."""
        if name not in self._paths:
            path = scratch_path(self.spark, name)
            write(path)
            self._paths[name] = path
        return self._paths[name]

    def close(self) -> None:
        """Delete the stored tables; those asked for later are built anew."""
        names = {"events": "_events_by_month", "account_days": "_days_by_month", "window_borders": "borders", "int_usage_per_subscription": "int_usage", "fct_subscriptions": "fct"}
        while self._paths:
            name, path = self._paths.popitem()
            self.__dict__.pop(names.get(name, name), None)
            remove(self.spark, path)

    @cached_property
    def _days_by_month(self) -> DataFrame:
        return self._by_month(account_days(self.events, self.lifecycles, self.spike), "account_days")

    @property
    def days(self) -> DataFrame:
        return self._days_by_month.drop(MONTH)

    def days_between(self, first: dt.date, last: dt.date) -> DataFrame:
        """Account-days of a range of days, from the folders of its months alone."""
        return _within(self._days_by_month, first, last)

    @cached_property
    def borders(self) -> DataFrame:
        """Running sums and maxima of usage at the first and last days of windows."""
        return self._stored(window_borders(self.days.where("covered"), self.int_subscriptions), "window_borders")

    @cached_property
    def int_subscriptions(self) -> DataFrame:
        return self._stored(self.build_int_subscriptions(), "int_subscriptions")

    @cached_property
    def int_usage(self) -> DataFrame:
        return self._stored(self.build_int_usage(), "int_usage_per_subscription")

    @cached_property
    def fct(self) -> DataFrame:
        return self._stored(self.build_fct(), "fct_subscriptions")
