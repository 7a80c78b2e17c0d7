"""Cell-wise numbering, look-back and tiles against plain windows, with hot keys and tiny cells."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ledgerlens.operators.ordered import day_rank, numbered, with_previous, with_tile


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one key, and many of those one day; some keys and days are missing."""
    rng = random.Random(7)
    rows = []
    for seq in rng.sample(range(5000), 1500):
        key = "hot" if rng.random() < 0.34 else rng.choice(["a", "b", "c", None])
        day = rng.choice([None, *range(1, 6)]) if rng.random() < 0.6 else 3
        value = rng.choice([None, 0, 1, 2])
        rows.append((seq, key, day, value))
    frame = spark.createDataFrame(rows, "_seq long, k string, n int, v int")
    return frame.withColumn("d", F.date_add(F.lit("2024-01-01").cast("date"), F.col("n"))).cache()


def in_order(*keys):
    return Window.partitionBy(*keys).orderBy(F.asc_nulls_last("d"), "_seq")


@pytest.mark.parametrize("bits", [3, 20])
def test_numbered_equals_row_number(skewed, bits):
    got = numbered(skewed, ["k"], day_rank(F.col("d")), "rn", bits=bits)
    want = skewed.withColumn("rn", F.row_number().over(in_order("k")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_no_window_holds_all_cells_of_a_key(skewed):
    """With numbers dealt by input split every row may be a cell; windows then run by rank value first."""
    sparse = skewed.withColumn("_seq", F.col("_seq") * (1 << 33))
    got = numbered(sparse, ["k"], day_rank(F.col("d")), "rn")
    want = sparse.withColumn("rn", F.row_number().over(in_order("k")))
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    text = got._jdf.queryExecution().optimizedPlan().toString()
    specs = [line for line in text.splitlines() if "Window [" in line]
    assert specs and all("_block" not in line.split("], [")[-1] or "_rank" in line.split("], [")[-2] for line in specs)


@pytest.mark.parametrize("bits", [3, 20])
@pytest.mark.parametrize("across", [True, False])
def test_previous_equals_lag(skewed, bits, across):
    keep = F.col("v") == 0
    got = with_previous(skewed, ["k"], day_rank(F.col("d")), ["v"], "p", keep, across, bits=bits)
    order = in_order("k") if across else in_order("k", "d")
    want = skewed.withColumn("p", F.lag(F.struct("v")).over(order)).where(keep)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("bits", [2, 20])
@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 37, 1001])
def test_tile_equals_ntile(spark, n, bits):
    rng = random.Random(n)
    # a third of the rows share one score
    rows = [(i, 40 if rng.random() < 0.34 else rng.randrange(200)) for i in rng.sample(range(4000), n)]
    frame = spark.createDataFrame(rows, "_seq long, s long")
    got = with_tile(frame, F.col("s"), tiles=4, out="t", coarse=16, bits=bits)
    want = frame.withColumn("t", F.ntile(4).over(Window.orderBy("s", "_seq")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
