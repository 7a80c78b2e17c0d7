import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import neighbours, queries

SF = "/root/testdata/sf0.1"


def _exact(rows, query, k):
    q = np.array(rows[query], dtype=np.float32).astype(float)
    scored = [(-float((np.array(v, dtype=np.float32).astype(float) * q).sum()), i) for i, v in rows.items() if i != query]
    return [(i, -s) for s, i in sorted(scored)[:k]]


def test_recall_and_scores(spark):
    rnd = np.random.default_rng(1)
    centres = rnd.normal(size=(12, 16))
    rows = {i: (centres[i % 12] + 0.5 * rnd.normal(size=16)).astype(np.float32).tolist() for i in range(3000)}
    df = spark.createDataFrame(list(rows.items()), "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") % 50 == 0, k=10, share=0.3, least=100, block=400).collect()
    hits = 0
    for query in range(0, 3000, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == query)
        assert [r for r, _, _ in own] == list(range(1, 11))
        best = _exact(rows, query, 10)
        hits += len({i for _, i, _ in own} & {i for i, _ in best})
        for _, i, s in own:
            assert s == pytest.approx(float(np.dot(np.array(rows[i], np.float64), np.array(rows[query], np.float64))), abs=1e-12)
        assert own == sorted(own, key=lambda x: (-x[2], x[1]))
    assert hits / 600 >= 0.9


def test_odd_vectors_and_ties(spark):
    same = [[1.0, 2.0, 0.5]] * 40
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [float("nan"), 1.0, 1.0], [float("inf"), 1.0, 1.0], [1.0, 2.0], []]
    rows = list(enumerate([*same, *odd, [1.0, 1.0, 1.0]])) + [(None, [1.0, 1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = neighbours.search(df, F.col("vec_id") % 20 == 0, k=5, block=8).collect()
    assert sorted((r.query_id, r.rank, r.vec_id) for r in got) == [
        *[(0, k, v) for k, v in enumerate([1, 2, 3, 4, 5], 1)], *[(20, k, v) for k, v in enumerate([0, 1, 2, 3, 4], 1)],
    ]
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    few = neighbours.search(df.filter("vec_id in (0, 3, 47)"), F.col("vec_id") % 20 == 0).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few, key=lambda r: r.rank)] == [(0, 1, 3), (0, 2, 47)]


def test_queries_are_dealt_over_the_sessions_partitions(spark):
    df = spark.createDataFrame([(i, [1.0 + i, 2.0, 3.0, 4.0, 5.0]) for i in range(6)], "vec_id long, embedding array<float>")
    got = neighbours.search(df, F.col("vec_id") == 0, k=2)
    assert [(r.query_id, r.rank, r.vec_id) for r in got.orderBy("rank").collect()] == [(0, 1, 5), (0, 2, 4)]
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


def test_walk_goes_by_falling_sums():
    rnd = np.random.default_rng(2)
    for _ in range(50):
        a, b = rnd.normal(size=5), rnd.normal(size=7)
        counts = rnd.integers(0, 3, size=35)
        order = neighbours.walk(a, b, counts.tolist(), int(counts.sum()))
        sums = [a[c // 7] + b[c % 7] for c in order]
        assert sums == sorted(sums, reverse=True)
        assert sorted(order) == np.flatnonzero(counts).tolist()


@pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")
@pytest.mark.parametrize("size", [2000, 2500, 3000])
def test_recall_of_the_registered_query(spark, tmp_path, size):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").toPandas()
    x = np.stack(table["embedding"].to_numpy()).astype(np.float64)
    if size > len(x):  # more vectors with the table's mean and covariance
        more = np.random.default_rng(8).multivariate_normal(x.mean(axis=0), np.cov(x.T), size - len(x))
        x = np.concatenate([x, more / np.linalg.norm(more, axis=1, keepdims=True)])
    x = x[:size].astype(np.float32)
    spark.createDataFrame(list(enumerate(x.tolist())), "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {}
    for r in queries.op10_neighbours(spark, str(tmp_path)).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hits, wide = 0, x.astype(np.float64)
    for query in range(0, size, 20):
        scores = wide @ wide[query]
        scores[query] = -np.inf
        hits += len(got[query] & set(np.argsort(-scores, kind="stable")[:20].tolist()))
    recall = hits / (size / 20 * 20)
    print("recall", size, recall)
    assert recall >= 0.91
