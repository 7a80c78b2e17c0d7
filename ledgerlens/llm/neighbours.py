"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves; k-means on a bounded sample gives each half its centroids, and every
vector is filed under its pair of nearest centroids (cell). A query sorts the centroids of each half
by inner product with its own half and walks over the pairs by falling sum with a heap, until the
cells passed hold ``share`` of the distinct vectors (``least`` at least). All vectors of the cells
passed are then reranked by the exact inner product.

The vectors given in the test tables are close to random, where no index finds most of the nearest
20 without looking at a good part of the table; ``share`` is set for that.

Queries and vectors meet in blocks: centroids of the first half form groups of cells with about
``block`` vectors (a group that holds more, as with many copies of one vector, is dealt over several
blocks), and queries come in blocks of about ``query_block``; each pair of blocks gives at most ``k`` rows
for each query, so no group grows with the data.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take
no part, nor do rows without an id. A query id in several rows is searched once, with its smallest vector; every
row is a candidate but those with the query's own id. Ties go to the smaller id.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import stored, width

SAMPLE = 20_000
MOST_CENTROIDS = 128
SHARE = 0.5
LEAST = 1_000
BLOCK = 8_192
QUERY_BLOCK = 1_024


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """vec_id, v of rows that take part."""
    wide = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v"))
    sound = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    kept = wide.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & sound)
    lengths = kept.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return kept.filter(F.size("v") == (lengths.d if lengths else 0))


def k_means(points: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Centroids of a bounded sample."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        near = nearest(points, centres)
        for c in range(len(centres)):
            if len(own := points[near == c]):
                centres[c] = own.mean(axis=0)
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres**2).sum(axis=1) - 2 * points @ centres.T, axis=1)


def walk(first: np.ndarray, second: np.ndarray, counts: np.ndarray, wanted: int) -> list[int]:
    """Cells by falling sum of both halves' products until they hold ``wanted`` vectors."""
    rows, columns = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    a, b, width = first[rows].tolist(), second[columns].tolist(), len(second)
    rows, columns = rows.tolist(), columns.tolist()
    heap, reached, passed, held = [(-(a[0] + b[0]), 0, 0)], [0] * (len(a) + 1), [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = rows[i] * width + columns[j]
        if counts[cell]:
            passed.append(cell)
            held += counts[cell]
        reached[i] = j + 1
        # a pair enters once both its left and its upper neighbour have been passed
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (-(a[i] + b[j + 1]), i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (-(a[i + 1] + b[j]), i + 1, j))
    return passed


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(vectors: DataFrame, is_query: Column, k: int = 20, key: str = "vec_id", vector: str = "embedding", share: float = SHARE, least: int = LEAST, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest found of every row for which ``is_query`` (of vec_id) holds."""
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    sound = stored(usable(vectors, key, vector), "vectors")
    total = sound.count()
    if not total:
        return spark.createDataFrame([], schema)
    drawn = sound.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    points = _matrix(drawn)
    half, wanted = points.shape[1] // 2, max(1, min(MOST_CENTROIDS, math.isqrt(total)))
    # a vector of one component has an empty first half and then one centroid for it
    centres = [k_means(points[:, :half], wanted), k_means(points[:, half:], wanted)]
    columns = len(centres[1])

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1))
            cells = nearest(x[:, :half], centres[0]) * columns + nearest(x[:, half:], centres[1]) if len(x) else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "v", "cell"])

    index = stored(sound.mapInArrow(file, "vec_id long, v array<double>, cell int"), "index")
    # one number for each pair of centroids, at most MOST_CENTROIDS squared
    counts = np.zeros(len(centres[0]) * columns, dtype=np.int64)
    for r in index.select("cell", F.xxhash64("v").alias("h")).distinct().groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    budget = max(least, math.ceil(share * int(counts.sum())))
    n_groups = max(1, min(len(centres[0]), -(-total // block)))
    per_group = len(centres[0]) / n_groups
    group_of = F.least(F.floor(F.floor(F.col("cell") / columns) / per_group), F.lit(n_groups - 1)).cast("int")
    rows_of = [0] * n_groups
    for r in index.groupBy(group_of.alias("g")).count().collect():
        rows_of[r["g"]] = r["count"]
    slices = F.array(*[F.lit(-(-n // block) or 1) for n in rows_of])

    asked = index.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    n_blocks = max(1, -(-int(index.filter(is_query).count()) // query_block))
    shared = spark.sparkContext.broadcast((centres, counts))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centres, counts = shared.value
        counts = counts.tolist()
        for batch in batches:
            out = {"vec_id": [], "v": [], "g": [], "cells": []}
            x = _matrix(batch.column(1))
            for i, query in enumerate(batch.column(0).to_pylist()):
                passed = np.array(walk(centres[0] @ x[i, :half], centres[1] @ x[i, half:], counts, budget))
                of = np.minimum(passed // columns // per_group, n_groups - 1).astype(int)
                for g in np.unique(of):
                    for name, value in zip(out, (query, x[i], int(g), np.sort(passed[of == g]).astype(np.int32)), strict=True):
                        out[name].append(value)
            types = [pa.int64(), pa.list_(pa.float64()), pa.int32(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out.values(), types, strict=True)], names=list(out))

    def rerank(key: tuple, queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or entries.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        entries = entries.sort_values(["cell", "vec_id"], kind="stable")
        e, ids, cells = np.stack(entries["v"].to_numpy()), entries["vec_id"].to_numpy(), entries["cell"].to_numpy()
        q = np.stack(queries["v"].to_numpy())
        own, starts = np.unique(cells, return_index=True)
        ends = np.append(starts[1:], len(cells))
        visited = np.stack([np.isin(own, c, assume_unique=True) for c in queries["cells"]])
        scores = np.full((len(q), len(e)), -np.inf)
        for c, (a, b) in enumerate(zip(starts, ends, strict=True)):
            who = np.flatnonzero(visited[:, c])
            if len(who):
                scores[who, a:b] = q[who] @ e[a:b].T
        out = []
        for i, query in enumerate(queries["vec_id"].to_numpy()):
            row = scores[i]
            row[ids == query] = -np.inf
            seen = np.flatnonzero(row > -np.inf)
            if len(seen) > k:
                bar = -np.partition(-row[seen], k - 1)[k - 1]
                seen = seen[row[seen] >= bar - 1e-9 * max(1.0, abs(bar))]
            exact = (e[seen] * q[i]).sum(axis=1)
            best = np.lexsort((ids[seen], -exact))[:k]
            out.append(pd.DataFrame({"query_id": query, "vec_id": ids[seen][best], "score": exact[best]}))
        return pd.concat(out)

    # walking is the dearest step for a query, so queries are spread whatever their size in bytes
    asked = asked.repartition(width(spark), F.xxhash64("vec_id"))
    queries = asked.mapInArrow(visit, "vec_id long, v array<double>, g int, cells array<int>")
    queries = queries.withColumn("s", F.explode(F.sequence(F.lit(0), F.get(slices, F.col("g")) - 1))).withColumn("b", F.pmod(F.xxhash64(F.lit("q"), "vec_id"), F.lit(n_blocks)))
    entries = index.withColumn("g", group_of).withColumn("s", F.pmod(F.xxhash64(F.lit("e"), "vec_id", F.monotonically_increasing_id()), F.get(slices, F.col("g"))))
    entries = entries.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)).cast("array<bigint>")))
    found = (
        queries.withColumn("s", F.col("s").cast("long")).groupBy("g", "s", "b")
        .cogroup(entries.groupBy("g", "s", "b")).applyInPandas(rerank, "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
