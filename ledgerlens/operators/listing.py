"""Ordered string aggregation."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ordered_string_agg(df: DataFrame, by: list[str], value: str, order: list[str], separator: str = ", ", out: str = "listed") -> DataFrame:
    """Per group, its non-null values as one string in the given order; equal places go by value.

    Rows are dealt by ranges of group, order and value, so a group that holds a large part of the rows is
    spread over many tasks; each puts its own cell in order, and a last step joins one string per cell.
    Only the result itself has to fit a task. A group without values gets null, null keys are a group.
    """
    place = [*order, value]
    ranged = df.select(*by, *[F.col(c).alias(f"__o{i}") for i, c in enumerate(place)])
    ranged = ranged.repartitionByRange(*by, *[f"__o{i}" for i in range(len(place))]).withColumn("__cell", F.spark_partition_id())
    last = f"__o{len(place) - 1}"

    def joined(key: list[Column], text: str) -> Column:
        rows = F.filter(F.collect_list(F.struct(*key, F.col(text).alias("__text"))), lambda x: x["__text"].isNotNull())
        return F.when(F.size(rows) > 0, F.array_join(F.transform(F.array_sort(rows), lambda x: x["__text"]), separator))

    keys = [F.col(f"__o{i}") for i in range(len(place) - 1)]
    nulls_last = [c for k in keys for c in (k.isNull().alias("n"), k)]
    cells = ranged.withColumn(last, F.col(last).cast("string")).groupBy(*by, "__cell").agg(joined(_named(nulls_last), last).alias("__text"))
    return cells.groupBy(*by).agg(joined([F.col("__cell")], "__text").alias(out))


def _named(columns: list[Column]) -> list[Column]:
    return [c.alias(f"k{i}") for i, c in enumerate(columns)]
