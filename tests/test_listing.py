import random

from pyspark.sql import functions as F

from ledgerlens.operators.listing import ordered_string_agg


def test_shuffled_rows_come_out_in_order(spark):
    rng = random.Random(5)
    rows = [("hot" if rng.random() < 0.4 else rng.choice(["a", "b", None]), rng.choice([None, *range(40)]), rng.choice([None, *[f"v{i}" for i in range(30)]])) for _ in range(3000)]
    rows += [("empty", 1, None)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(6)
    want = {}
    for k, o, v in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[2] or "")):
        want.setdefault(k, []).extend([] if v is None else [v])
    got = {r.k: r.listed for r in ordered_string_agg(df, ["k"], "v", ["o"], "; ").collect()}
    assert got == {k: "; ".join(v) if v else None for k, v in want.items()}
    assert ordered_string_agg(df.limit(0), ["k"], "v", ["o"]).count() == 0


def test_several_keys_and_numbers_as_values(spark):
    df = spark.range(20).select((F.col("id") % 2).alias("x"), (F.col("id") % 3).alias("y"), (-F.col("id")).alias("o"), "id")
    got = {(r.x, r.y): r.ids for r in ordered_string_agg(df, ["x", "y"], "id", ["o"], ",", out="ids").collect()}
    assert got[(0, 0)] == "18,12,6,0"
