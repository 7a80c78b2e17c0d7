"""Bounded samples of labelled documents; nothing about the label enters a score but through a fitted model."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(key: str, modulus: int) -> Column:
    """crc32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus))


def sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, text, label of at most ``rows`` labelled documents for which ``usable`` holds, spread by hash.

    A document labelled more than once has its largest label; of several rows with one key one counts,
    the one with the smallest hash of its text. ``rows`` bounds what is broadcast to the one pass over
    the documents, and the sample.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull() & usable)
    one = known.groupBy(key).agg(F.max(label).cast("double").alias("label"))
    chosen = one.orderBy(F.xxhash64(key), key).limit(rows)
    found = docs.select(key, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), key)
    first = F.min_by("text", F.struct(F.xxhash64("text"), F.col("text"))).alias("text")
    return found.groupBy(key).agg(first, F.first("label").alias("label")).select(key, "text", "label")
