"""Tables written to the shared folder, and small expression helpers."""

import sys
import types
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.session import fit_shuffles
from ledgerlens.sources.sinks import materialise, scratch_path

#: Paths written outside any scope; ``close`` deletes them.
_loose: list[str] = []
_written: ContextVar[list[str]] = ContextVar("written", default=_loose)
_fitted: set[tuple[str, str]] = set()


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the folder; at its first reading shuffles are widened to suit its size."""
    path = f"{sf_dir}/{name}.parquet"
    if (spark.sparkContext.applicationId, path) not in _fitted:
        fit_shuffles(spark, path)
        _fitted.add((spark.sparkContext.applicationId, path))
    return spark.read.parquet(path)


def width(spark: SparkSession) -> int:
    """How many partitions an explicit shuffle gets: as many as others start with."""
    initial = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(initial or 0), int(spark.conf.get("spark.sql.shuffle.partitions")))


def lower_batches(spark: SparkSession, most: int = 1_000) -> None:
    """Send Python workers at most ``most`` rows at a time.

    A batch of whole texts is held in a task's JVM and in its worker, and what it took stays with both afterwards.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= most:
        spark.conf.set(key, most)


def tokenizer(name: str) -> str:
    """Place of a public tokenizer file, the same on every executor."""
    import public_tokenizers

    return public_tokenizers.path(name)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the folder all executors share and read it back.

    A lost executor then costs a re-read, and the planner knows the true size of what it joins.
    """
    return materialise(df, noted_path(df.sparkSession, name))


def noted_path(spark: SparkSession, name: str) -> str:
    """A new path that the end of the scope (or ``close``) deletes."""
    path = scratch_path(spark, name)
    _written.get().append(path)
    return path


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """What is stored inside is deleted at the end, so results must have been written or counted by then."""
    paths: list[str] = []
    token = _written.set(paths)
    try:
        yield
    finally:
        _written.reset(token)
        _delete(spark, paths)


def settled(spark: SparkSession, name: str, make: Callable[[], DataFrame]) -> DataFrame:
    """``make()`` stored; the tables it stored on its way are deleted."""
    path = scratch_path(spark, name)
    with scope(spark):
        out = materialise(make(), path)
    _written.get().append(path)
    return out


def close(spark: SparkSession) -> None:
    """Delete all that was stored outside a scope; frames that read it can no longer be used."""
    _delete(spark, _loose)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    while paths:
        remove(spark, paths.pop())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``stored`` or a run store wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def text_of(column: str) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def text_column(df: DataFrame, text: str, also: list[str]) -> tuple[list[Column], int]:
    """What to select after a key and ``also`` so that a task sees the text, and its place; a text among ``also`` goes once."""
    if text in also and df.schema[text].dataType.simpleString() == "string":
        return [], 1 + list(also).index(text)
    return [F.col(text).cast("string").alias("__text")], 1 + len(also)


def kept_in_worker(make, *args):
    """``make(*args)``, made once for each Python worker and kept until the worker makes another or ends.

    Functions travel by value, so their globals do not outlive a task; a module of its own does. Only what
    is bounded and does not change results (a tokenizer with its memo) may be kept so.
    """
    kept = sys.modules.setdefault("__ledgerlens_kept__", types.ModuleType("__ledgerlens_kept__")).__dict__
    name = (make.__module__, make.__qualname__, args)
    if kept.get("name") != name:
        kept.pop("value", None)
        kept.update(name=name, value=make(*args))
    return kept["value"]
