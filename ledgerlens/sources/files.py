"""Raw CSV files: scanned as they are, or loaded into a stored raw table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.sources.schemas import RAW_SUBSCRIPTIONS, RAW_USAGE_EVENTS, SEQ
from ledgerlens.sources.sinks import materialise


def _scan(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("nullValue", "NULL").csv(path)


def scan_subscriptions(spark: SparkSession, path: str) -> DataFrame:
    """Raw lifecycles; the word NULL and empty fields load as NULL, nothing is rejected."""
    return _scan(spark, path, RAW_SUBSCRIPTIONS)


def scan_usage_events(spark: SparkSession, path: str) -> DataFrame:
    """Raw usage events, loaded as permissively."""
    return _scan(spark, path, RAW_USAGE_EVENTS)


def load_checked(spark: SparkSession, path: str, schema: T.StructType, table_path: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """Store a CSV scan and give its sound rows (with a sequence number) and its rejected records.

    A record is rejected when a field does not fit its type or the number of fields is wrong; it is kept as
    it stood in the file, with the file's name, and none of its fields counts as missing. ``multi_line``
    lets quoted fields hold line feeds, for which a file cannot be split among tasks.
    """
    record = "_record"
    layout = T.StructType([*schema.fields, T.StructField(record, T.StringType())])
    reader = spark.read.schema(layout).option("header", True).option("nullValue", "NULL").option("multiLine", multi_line)
    read = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", record).csv(path)
    numbered = read.withColumn("_file", F.input_file_name()).withColumn(SEQ, F.monotonically_increasing_id())
    stored = materialise(numbered, table_path)
    sound = stored.where(F.col(record).isNull()).drop(record, "_file")
    return sound, stored.where(F.col(record).isNotNull()).select("_file", record, SEQ)


def load_raw(scanned: DataFrame, table_path: str) -> DataFrame:
    """Store a scan as a raw table with a sequence number in file order.

    The number is only fixed once written: a second scan may split the files differently.
    """
    return materialise(scanned.withColumn(SEQ, F.monotonically_increasing_id()), table_path)
