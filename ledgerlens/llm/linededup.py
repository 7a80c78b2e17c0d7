"""Line dedup: levelled sorted runs of line hashes.

A line's key is the line stripped of ASCII white space at both ends, A-Z lower-cased, kept as two
64-bit hashes. A run is a table of (key, number of documents), bucketed and sorted by key, so that
merging runs and joining a batch with them needs no shuffle of what is stored. Each batch is
pre-aggregated, merge-anti-joined with the runs (keys that a run already settles are not stored
again) and added as a run of level 0; a level that has ``fanout`` runs is compacted into one run of
the next.

Null texts count as one empty line. Repeated rows are documents of their own. A text of which all
lines go becomes empty.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ledgerlens.llm.tables import let, noted_path, remove, stored, text_of, width

WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["k1", "k2"]


def line_keys(text: Column) -> Column:
    """The normalised lines of a text, in order."""
    plain = F.octet_length(text) == F.length(text)
    lowered = F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.transform(F.split(lowered, "\n", -1), lambda line: F.btrim(line, F.lit(WHITE)))


def hashes(key: Column) -> list[Column]:
    """128 bits of a line key; the second hash starts from another seed."""
    return [F.xxhash64(key).alias("k1"), F.xxhash64(F.lit(1), key).alias("k2")]


def keys_of(docs: DataFrame, text: str, least: int) -> DataFrame:
    """k1, k2, docs: in how many rows of ``docs`` a key of at least ``least`` code points stands."""
    lines = docs.select(F.explode(F.array_distinct(line_keys(text_of(text)))).alias("__line"))
    kept = lines.filter(F.length("__line") >= least).select(*hashes(F.col("__line")))
    return kept.groupBy(*KEY).agg(F.count(F.lit(1)).alias("docs"))


class LineRuns:
    """The stored runs; ``threshold`` is the number of documents that settles a key."""

    def __init__(self, spark: SparkSession, threshold: int, fanout: int = 4):
        self.spark, self.threshold, self.fanout = spark, threshold, fanout
        self.buckets = width(spark)
        self.levels: list[list[tuple[str, str]]] = []

    def _write(self, counts: DataFrame) -> tuple[str, str]:
        name, path = f"llm_run_{uuid.uuid4().hex}", noted_path(self.spark, "run")
        dealt = counts.repartition(self.buckets, *KEY).sortWithinPartitions(*KEY)
        dealt.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", path).saveAsTable(name)
        return name, path

    def _drop(self, run: tuple[str, str]) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run[0]}")
        remove(self.spark, run[1])

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name, _ in level]

    def merged(self, runs: list[DataFrame]) -> DataFrame:
        """Runs added up, key by key: each holds a key once, so a merge join adds two of them.

        A union of the runs must not be grouped: the planner takes a union of bucketed tables for
        bucketed and leaves out the shuffle, though a key's rows then lie in several partitions.
        """
        out = runs[0]
        for run in runs[1:]:
            joined = out.join(run.withColumnRenamed("docs", "__more"), KEY, "full_outer")
            out = joined.select(*KEY, (F.coalesce("docs", F.lit(0)) + F.coalesce("__more", F.lit(0))).alias("docs"))
        return out

    def unseen(self, counts: DataFrame) -> DataFrame:
        """Keys of a batch that no run holds."""
        for run in self.runs():
            counts = counts.join(run, KEY, "left_anti")
        return counts

    def add(self, counts: DataFrame) -> None:
        """Anti-join a batch with the settled keys of the runs, store the rest as a run, compact full levels."""
        for run in self.runs():
            counts = counts.join(run.filter(F.col("docs") >= self.threshold), KEY, "left_anti")
        new, level = self._write(counts), 0
        while True:
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            full, self.levels[level] = self.levels[level], []
            new = self._write(self.merged([self.spark.table(name) for name, _ in full]))
            for run in full:
                self._drop(run)
            level += 1

    def settled(self) -> DataFrame:
        """k1, k2 of all keys in at least ``threshold`` documents."""
        return self.merged(self.runs()).filter(F.col("docs") >= self.threshold).select(*KEY)

    def close(self) -> None:
        for level in self.levels:
            for run in level:
                self._drop(run)
        self.levels = []


def id_batches(docs: DataFrame, key: str, batches: int) -> list[DataFrame]:
    """``docs`` in ranges of ``key`` with about as many rows each; a table laid out by key is read once, each batch its own row groups.

    Keys that are no numbers are dealt by a hash.
    """
    if batches < 2:
        return [docs]
    if not isinstance(docs.schema[key].dataType, NumericType):
        place = F.pmod(F.xxhash64(key), F.lit(batches))
        return [docs.filter(place == i) for i in range(batches)]
    shares = [i / batches for i in range(1, batches)]
    cuts = sorted(set(docs.agg(F.percentile_approx(key, shares)).first()[0] or []))
    if not cuts:
        return [docs]
    first = docs.filter((F.col(key) < cuts[0]) | F.col(key).isNull())
    middle = [docs.filter((F.col(key) >= a) & (F.col(key) < b)) for a, b in zip(cuts, cuts[1:])]
    return [first, *middle, docs.filter(F.col(key) >= cuts[-1])]


def drop_frequent_lines(docs: DataFrame, threshold: int = 10, least: int = 1, batches: int = 4, fanout: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the lines whose key stands in ``threshold`` documents or more.

    ``text`` holds the other lines; n_lines (before) and n_dropped are added, replacing columns of
    these names. Only (row, line) numbers of lines that go are grouped; texts are shuffled once, to
    meet them.
    """
    runs = LineRuns(docs.sparkSession, threshold, fanout)
    try:
        for batch in id_batches(docs, key, batches):
            runs.add(keys_of(batch, text, least))
        frequent = stored(runs.settled(), "frequent_lines")
    finally:
        runs.close()

    row = [F.xxhash64(F.col(key), F.col(text)).alias("__r1"), F.xxhash64(F.lit(1), F.col(text), F.col(key)).alias("__r2")]
    lines = docs.select(*row, F.posexplode(line_keys(text_of(text))).alias("__at", "__line"))
    lines = lines.filter(F.length("__line") >= least).select("__r1", "__r2", "__at", *hashes(F.col("__line")))
    going = lines.join(frequent, KEY, "left_semi").groupBy("__r1", "__r2").agg(F.collect_set("__at").alias("__going"))

    joined = docs.select("*", *row).join(going, ["__r1", "__r2"], "left").drop("__r1", "__r2")
    n_lines = F.length(text_of(text)) - F.length(F.replace(text_of(text), F.lit("\n"), F.lit(""))) + 1

    def rest(lines: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col("__going"))
        return F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n")

    kept = F.when(F.col("__going").isNull(), text_of(text)).otherwise(let(F.split(text_of(text), "\n", -1), rest))
    return joined.withColumns({
        "n_lines": n_lines.cast("bigint"), "n_dropped": F.coalesce(F.when(F.col("__going").isNotNull(), F.size("__going")), F.lit(0)).cast("bigint"), text: kept,
    }).drop("__going")
