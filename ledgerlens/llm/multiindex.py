"""Near-duplicate vectors by an inverted multi-index.

Vectors of one label link when their cosine is ``threshold`` (0.98) or more, which for unit vectors is
a distance of at most ``sqrt(2 - 2 * threshold)``. Each half of the unit vectors has a codebook of its
own (k-means on a sample of at most ``SAMPLE`` rows); the pairs of centroids are the cells of a product
grid, under which every vector is filed.

A query knows, for each half, how far its half at least is from anything filed under a centroid: the
distance to the planes between that centroid and its own nearest ones, and the distance to the centroid
less the largest radius found there. A multi-sequence traversal with a heap visits cells by the rising
sum of both squared bounds. The target recall is one: it ends when the sum passes the squared distance,
since no cell beyond can hold a link. All entries of the cells visited are verified by the exact cosine
of the original vectors, so no link is lost and none is added, whatever the codebooks are worth.

Equal vectors of a label are one node with a weight. Nodes are grouped by label, length and a range of
first centroids, and groups are cut into slices of about ``block`` nodes; a query goes to the slices
that its first half cannot rule out and is streamed against a slice, which alone is held in memory. From
a slice and its queries come one weighted count for each query and a spanning forest of the links, never
the pairs themselves.

Vectors that are null, zero or hold null or non-finite components, and rows without a label, link with
nothing; vectors of different lengths do not link with one another. Each row counts as one vector, also
when its id occurs twice. A row without an id is linked and counted, and gets the smallest id reachable;
alone, it keeps a null component and stays. Extra columns are ignored.
"""

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.components import components
from ledgerlens.llm.tables import stored, width

THRESHOLD = 0.98
SAMPLE = 20_000
MOST_CENTROIDS = 256
NEAR_PLANES = 8
BLOCK = 16_384
QUERY_BLOCK = 131_072
SLACK = 1e-9


def codebook(points: np.ndarray, k: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most ``k`` centroids of the points by k-means."""
    own = np.unique(points, axis=0)
    centres = own[np.random.default_rng(seed).permutation(len(own))[:k]].copy()
    for _ in range(rounds):
        near = distances(points, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, points)
        counts = np.bincount(near, minlength=len(centres))
        centres[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return centres


def distances(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of all points to all centres."""
    return np.maximum((points**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1) - 2 * points @ centres.T, 0)


def bounds(points: np.ndarray, centres: np.ndarray, radii: np.ndarray) -> np.ndarray:
    """Squared distance that each point at least has from everything filed under each centre."""
    squared = distances(points, centres)
    best = np.maximum(np.sqrt(squared) - radii, 0)
    apart = np.sqrt(distances(centres, centres))
    near = np.argpartition(squared, min(NEAR_PLANES, len(centres)) - 1, axis=1)[:, :NEAR_PLANES]
    for k in range(near.shape[1]):
        other = near[:, k]
        gap = 2 * apart[other]
        plane = (squared - np.take_along_axis(squared, other[:, None], axis=1)) / np.where(gap > 1e-6, gap, np.inf)
        np.maximum(best, plane, out=best)
    return np.maximum(best - SLACK, 0) ** 2


def traverse(first: np.ndarray, second: np.ndarray, limit: float) -> Iterator[tuple[int, int]]:
    """Pairs (i, j) by rising ``first[i] + second[j]`` until the sum passes ``limit``."""
    rows, columns = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    a, b = first[rows].tolist(), second[columns].tolist()
    rows, columns = rows.tolist(), columns.tolist()
    heap, reached = [(a[0] + b[0], 0, 0)], [0] * (len(a) + 1)
    while heap:
        total, i, j = heapq.heappop(heap)
        if total > limit:
            return
        yield rows[i], columns[j]
        reached[i] = j + 1
        # a pair enters once the pairs before it in both sequences have been visited
        if j + 1 < len(b) and (i == 0 or reached[i - 1] > j + 1):
            heapq.heappush(heap, (a[i] + b[j + 1], i, j + 1))
        if i + 1 < len(a) and reached[i + 1] == j:
            heapq.heappush(heap, (a[i + 1] + b[j], i + 1, j))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Divided by a power of two, so that cosines stay exactly what they are but squares neither overflow nor vanish."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def _units(x: np.ndarray) -> np.ndarray:
    scaled = _scaled(x)
    return scaled / np.sqrt((scaled**2).sum(axis=1, keepdims=True))


def _fitted(x: np.ndarray, width: int) -> np.ndarray:
    """Cut or padded to ``width``; distances do not grow by that, so bounds stay bounds."""
    return x[:, :width] if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


class Slice:
    """The nodes of one slice by cell, and the links found so far."""

    def __init__(self, nodes: np.ndarray, weights: np.ndarray, x: np.ndarray, cells: np.ndarray, columns: int, threshold: float):
        order = np.argsort(cells, kind="stable")
        self.nodes, self.weights, cells = nodes[order], weights[order], cells[order]
        self.scaled, self.units = _scaled(x[order]), _units(x[order])
        own, starts = np.unique(cells, return_index=True)
        self.place = dict(zip(own.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(cells)], strict=True), strict=True))
        self.rows, self.columns, self.threshold = np.unique(own // columns), columns, threshold
        self.every = np.arange(len(cells))
        self.forest = self.every.copy()

    def links(self, node: int, q: np.ndarray, unit: np.ndarray, first: np.ndarray, second: np.ndarray, limit: float) -> tuple[int, list]:
        """Weighted number of nodes linked to a query, and the edges that are new to the forest."""
        spans = [self.place[c] for i, j in traverse(first[self.rows], second, limit) if (c := int(self.rows[i]) * self.columns + j) in self.place]
        if not spans:
            return 0, []
        seen = np.concatenate([self.every[a:b] for a, b in spans]) if len(spans) > 1 else slice(*spans[0])
        cosine = self.units[seen] @ unit
        picked = np.flatnonzero(cosine >= self.threshold - SLACK)
        found = picked + seen.start if isinstance(seen, slice) else seen[picked]
        found = found[self.nodes[found] != node]
        if not len(found):
            return 0, []
        e = self.scaled[found]
        exact = (e * q).sum(axis=1) / (np.sqrt((e * e).sum(axis=1)) * np.sqrt((q * q).sum()))
        found = found[exact >= self.threshold]
        if not len(found):
            return 0, []
        roots = np.unique(self.forest[found])
        edges = [(node, int(self.nodes[roots[0]]))]
        if len(roots) > 1:
            edges += [(int(self.nodes[r]), int(self.nodes[roots[0]])) for r in roots[1:]]
            self.forest[np.isin(self.forest, roots[1:])] = roots[0]
        return int(self.weights[found].sum()), edges


def _sound(v: Column) -> Column:
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & finite & F.exists(v, lambda x: x != 0)


def near_duplicates(
    vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD, block: int = BLOCK, query_block: int = QUERY_BLOCK
) -> DataFrame:
    """key, n_links (other rows linked), component_id (smallest key reachable), kept (the key is that one), for every row."""
    spark = vectors.sparkSession
    v = F.col(vector).cast("array<double>")
    kind = F.when(F.col(label).isNotNull() & _sound(v), F.concat_ws("|", F.col(label).cast("string"), F.size(v)))
    # two hashes stand for a vector and its label wherever rows meet their node
    rows = vectors.select(F.col(key).alias("id"), kind.alias("kind"), v.alias("v"))
    hashes = [F.xxhash64("kind", "v").alias("h1"), F.xxhash64(F.lit(1), "v", "kind").alias("h2")]
    sound = rows.filter(F.col("kind").isNotNull()).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).select("*", *hashes)
    nodes = sound.groupBy("h1", "h2", "kind", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vector_nodes")
    total = nodes.count()
    counted = _linked(nodes, total, threshold, block, query_block) if total else spark.createDataFrame([], "node long, links long, component long")
    least = counted.join(nodes.select("node", "first"), "node").groupBy("component").agg(F.min("first").alias("smallest"))
    of_node = nodes.select("node", "h1", "h2", "n", "first").join(counted, "node", "left").join(least, "component", "left")
    of_node = of_node.select(
        "h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.when(F.col("component").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id")
    )
    of_node = stored(of_node, "vector_classes")
    linked = sound.select("id", "h1", "h2").join(of_node, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.filter(F.col("kind").isNull()).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    both = linked.unionByName(alone)
    return both.select(F.col("id").alias(key), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def _linked(nodes: DataFrame, total: int, threshold: float, block: int, query_block: int) -> DataFrame:
    """node, links (weighted), component (smallest node) of nodes with a link."""
    spark = nodes.sparkSession
    length = nodes.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first().d
    drawn = nodes.filter(F.size("v") == length).orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    points = _units(_matrix(drawn))
    # cells are as many as the vectors that a vector is usually compared with
    usual = nodes.groupBy("kind").count().agg((F.sum(F.col("count") * F.col("count").cast("double")) / F.sum("count")).alias("n")).first().n
    half, k = length // 2, max(1, min(MOST_CENTROIDS, math.isqrt(int(usual))))
    books = [codebook(points[:, :half], k), codebook(points[:, half:], k)]
    columns = len(books[1])
    limit = max(0.0, 2 - 2 * threshold) + SLACK

    def by_length(batch: pa.RecordBatch, at: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors (cut or padded) of the rows of each length."""
        sizes = np.diff(batch.column(at).offsets.to_numpy())
        for d in np.unique(sizes):
            own = np.flatnonzero(sizes == d)
            yield own, _fitted(_units(_matrix(batch.column(at).take(pa.array(own)))), length)

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, batch.num_rows))
            for own, x in by_length(batch, 3):
                for side, part in enumerate((x[:, :half], x[:, half:])):
                    squared = distances(part, books[side])
                    near = squared.argmin(axis=1)
                    out[0, own] += near * (columns if side == 0 else 1)
                    out[1 + side, own] = np.sqrt(squared[np.arange(len(own)), near])
            arrays = [pa.array(out[0].astype(np.int32)), pa.array(out[1]), pa.array(out[2])]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=["node", "n", "kind", "v", "cell", "r1", "r2"])

    index = stored(nodes.select("node", "n", "kind", "v").mapInArrow(file, "node long, n long, kind string, v array<double>, cell int, r1 double, r2 double"), "multi_index")
    radii = [np.zeros(len(b)) for b in books]  # one number for each centroid
    for side, (c, r) in enumerate(((F.floor(F.col("cell") / columns), "r1"), (F.pmod("cell", F.lit(columns)), "r2"))):
        for x in index.groupBy(c.cast("int").alias("c")).agg(F.max(r).alias("r")).collect():
            radii[side][x.c] = x.r + SLACK
    n_groups = max(1, min(len(books[0]), -(-total // block)))
    group_of_centre = np.arange(len(books[0])) * n_groups // len(books[0])
    group = F.get(F.array(*[F.lit(int(g)) for g in group_of_centre]), F.floor(F.col("cell") / columns).cast("int"))
    filed = index.drop("r1", "r2").withColumn("g", group)
    sizes = stored(filed.groupBy("kind", "g").agg(F.count(F.lit(1)).alias("held")), "slices")
    slices, parts = F.ceil(F.col("held") / block).cast("int"), F.ceil(F.col("held") / query_block).cast("int")

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups that the first half of a query cannot rule out."""
        for batch in batches:
            out: list = [None] * batch.num_rows
            for own, x in by_length(batch, 3):
                open_to = bounds(x[:, :half], books[0], radii[0]) <= limit
                for i, row in zip(own, open_to, strict=True):
                    out[i] = np.unique(group_of_centre[row]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.int32()))], names=["node", "n", "kind", "v", "cell", "gs"])

    asked = index.drop("r1", "r2").mapInArrow(route, "node long, n long, kind string, v array<double>, cell int, gs array<int>")
    asked = asked.withColumn("g", F.explode("gs")).drop("gs").join(sizes, ["kind", "g"])
    asked = asked.withColumn("s", F.explode(F.sequence(F.lit(0), slices - 1))).withColumn("p", F.pmod(F.xxhash64("node"), parts).cast("int"))
    held = filed.join(sizes, ["kind", "g"]).withColumn("p", F.explode(F.sequence(F.lit(0), parts - 1)))
    held = held.withColumn("s", F.pmod(F.xxhash64(F.lit("s"), "node"), slices).cast("int"))
    columns_sent = ["kind", "g", "s", "p", F.lit(0).alias("asks"), "node", "n", "v", "cell"]
    met = held.select(*columns_sent).unionByName(asked.select(*[F.lit(1).alias("asks") if i == 4 else c for i, c in enumerate(columns_sent)]))
    met = met.repartition(width(spark), "kind", "g", "s", "p").sortWithinPartitions("kind", "g", "s", "p", "asks")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, entries, now = None, [], None
        for batch in batches:
            table = [batch.column(i).to_pylist() for i in range(4)]
            keys = list(zip(*table, strict=True))
            asks, ids, weights, cells = (batch.column(i).to_numpy() for i in (4, 5, 6, 8))
            edges, counts = [], []
            at = 0
            while at < len(keys):
                end = at + 1
                while end < len(keys) and keys[end] == keys[at] and asks[end] == asks[at]:
                    end += 1
                x = _matrix(batch.column(7).slice(at, end - at))
                if keys[at] != current:
                    current, entries, now = keys[at], [], None
                if asks[at] == 0:
                    entries.append((ids[at:end], weights[at:end], x, cells[at:end]))
                elif entries:
                    if now is None:
                        now = Slice(*(np.concatenate(c) for c in zip(*entries, strict=True)), columns, threshold)
                    for a in range(0, len(x), 1024):
                        part = x[a : a + 1024]
                        units, scaled = _units(part), _scaled(part)
                        fitted = _fitted(units, length)
                        first, second = bounds(fitted[:, :half], books[0], radii[0]), bounds(fitted[:, half:], books[1], radii[1])
                        for i in range(len(part)):
                            node = int(ids[at + a + i])
                            n, found = now.links(node, scaled[i], units[i], first[i], second[i], limit)
                            if n:
                                counts.append((node, n))
                                edges += found
                at = end
            both = [*((a, n, None) for a, n in counts), *((a, None, b) for a, b in edges)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in both], pa.int64()) for i in range(3)], names=["node", "links", "other"])

    found = stored(met.mapInArrow(verify, "node long, links long, other long"), "vector_links")
    classes = components(found.filter("other is not null").select(F.col("node").alias("a"), F.col("other").alias("b")))
    counts = found.filter("links is not null").groupBy("node").agg(F.sum("links").alias("links"))
    return counts.join(classes, "node")
