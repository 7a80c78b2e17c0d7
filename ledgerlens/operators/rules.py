"""Ordered rule tables: the first rule that holds names the row."""

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerlens import constants as C

Rule = tuple[Column, str]


@dataclass(frozen=True)
class Limits:
    """Above what an amount or a trial is suspect: high and extreme MRR, the most each plan charges, days of a trial."""

    high: float = C.MRR_HIGH
    extreme: float = C.MRR_EXTREME
    ceilings: Mapping[str, float] = field(default_factory=lambda: dict(C.PLAN_CEILING))
    trial_days: int = C.SUSPECT_TRIAL_DAYS


def classify(rules: Sequence[Rule], otherwise: str | None = None) -> Column:
    """Label of the first rule that holds, else ``otherwise``."""
    label = F.when(rules[0][0], F.lit(rules[0][1]))
    for condition, name in rules[1:]:
        label = label.when(condition, F.lit(name))
    return label.otherwise(F.lit(otherwise))


def not_flagged(flag: Column, names: Sequence[str]) -> Column:
    """True for rows without a flag as well, which a bare NOT IN would lose."""
    return flag.isNull() | ~flag.isin(*names)
