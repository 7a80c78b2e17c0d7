"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.tables import noted_path, remove
from ledgerlens.sources.sinks import materialise


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is linked to the smallest node around."""
    both = edges.union(edges.select("b", "a")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    others = down.join(least, "u").filter(F.col("v") != F.col("m")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    return others.union(least.select("u", "m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) for every node of ``edges`` (a, b: long).

    Loops, repeated edges and either direction are fine; null ends are ignored. Stars are found by
    aggregates and equi-joins, so the neighbours of a hub are never gathered in one task. Each round
    is written to the shared folder and the one before it is removed; rounds grow with the logarithm
    of the longest path.
    """
    spark = edges.sparkSession
    path = noted_path(spark, "components")
    current = materialise(edges.select("a", "b").filter(F.col("a") != F.col("b")).distinct(), path)
    seen = None
    while True:
        checks = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(checks) == seen or checks[0] == 0:
            break
        seen = tuple(checks)
        following = noted_path(spark, "components")
        rounded = _small_star(_large_star(current).filter(F.col("a") != F.col("b")).distinct()).distinct()
        current = materialise(rounded.filter(F.col("a") != F.col("b")), following)
        remove(spark, path)
        path = following
    # only stars are left: every edge leads from a node to the smallest one
    roots = current.select(F.col("b").alias("node")).distinct()
    leaves = current.select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("component")).distinct()
    return leaves.unionByName(roots.select("node", F.col("node").alias("component")))
