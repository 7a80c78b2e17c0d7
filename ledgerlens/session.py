"""Session settings that depend on the size of the input."""

from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

BYTES_PER_PARTITION = 128 * 1024 * 1024
#: For reports, whose added-up rows take about six times the bytes of the files they come from, up to a bound.
BYTES_PER_REPORT_PARTITION, MOST_REPORT_PARTITIONS = 4 * 1024 * 1024, 20_000
#: What a task of a report reads of a shuffle, and of files; its rows in memory are 10 to 40 times that.
BYTES_READ, BYTES_SCANNED = 16 * 1024 * 1024, 8 * 1024 * 1024
ADVISORY, SCANNED = "spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.files.maxPartitionBytes"
#: Name and bounds of the setting that sizes Bloom filters, in words of 64 bits (128 KB to 32 MB).
LOOKUP_WORDS = "spark.ledgerlens.lookupWords"
FEWEST_WORDS, MOST_WORDS = 1 << 14, 1 << 22


def input_bytes(spark: SparkSession, *paths: str) -> int:
    """Total length of the files under ``paths``, from their listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(paths))
    return files.agg(F.sum("length").alias("bytes")).first().bytes or 0


def shuffle_partitions(total_bytes: int, at_least: int) -> int:
    wanted = -(-total_bytes // BYTES_PER_PARTITION)
    return max(at_least, wanted)


def lookup_words(spark: SparkSession) -> int:
    """Words of a Bloom filter, as set for the input by ``fit_shuffles``."""
    return int(spark.conf.get(LOOKUP_WORDS, str(FEWEST_WORDS)))


def report_partitions(total_bytes: int, at_least: int) -> int:
    """Partitions that hold about ``BYTES_READ`` each, as long as they do not become too many."""
    fine = min(MOST_REPORT_PARTITIONS, -(-total_bytes // BYTES_PER_REPORT_PARTITION))
    return max(shuffle_partitions(total_bytes, at_least), fine)


def bound_tasks(spark: SparkSession, *paths: str) -> None:
    """Let no task read more than a fixed share, so that its memory does not grow with the input.

    Adaptive execution merges partitions up to ``BYTES_READ`` and scans take ``BYTES_SCANNED`` of a file (more only
    where that made more than ``MOST_REPORT_PARTITIONS`` tasks). Smaller settings of the session stay.
    """
    scanned = max(BYTES_SCANNED, -(-input_bytes(spark, *paths) // MOST_REPORT_PARTITIONS))
    for key, most in ((ADVISORY, BYTES_READ), (SCANNED, scanned)):
        if most < _bytes(spark, key):
            spark.conf.set(key, str(most))


def _bytes(spark: SparkSession, key: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))


def fit_shuffles(spark: SparkSession, *paths: str, partitions: Callable[[int, int], int] = shuffle_partitions) -> int:
    """Start shuffles with partitions of a size a task can hold, given the input.

    Adaptive execution merges partitions that turn out small but never makes more of them than it
    started with (200 by default, half a terabyte each at 100 TB), so only a larger number is set.
    The size of Bloom filters grows with the input as well, up to a bound.
    """
    fixed = "spark.sql.shuffle.partitions"
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    key = initial if spark.conf.get("spark.sql.adaptive.enabled") == "true" else fixed
    current = int(spark.conf.get(key, None) or spark.conf.get(fixed))
    total = input_bytes(spark, *paths)
    words = min(MOST_WORDS, max(lookup_words(spark), 1 << (total >> 20).bit_length()))
    spark.conf.set(LOOKUP_WORDS, str(words))
    fitted = partitions(total, current)
    if fitted > current:
        spark.conf.set(key, fitted)
    return fitted
