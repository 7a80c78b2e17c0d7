import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import multiindex

SCHEMA = "vec_id long, embedding array<float>, label int"


def _expected(rows, threshold=0.98):
    """Number of links and smallest id reachable of every row, by comparing all pairs."""
    def sound(v, label):
        return label is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0)

    n, links = len(rows), [[] for _ in rows]
    for i in range(n):
        for j in range(n):
            (_, a, x), (_, b, y) = rows[i], rows[j]
            if i != j and x == y and sound(a, x) and sound(b, y) and len(a) == len(b):
                a, b = np.array(a, np.float32).astype(float), np.array(b, np.float32).astype(float)
                if a @ b / (np.linalg.norm(a) * np.linalg.norm(b)) >= threshold:
                    links[i].append(j)
    least = [r[0] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in links[i]:
                if least[j] is not None and (least[i] is None or least[j] < least[i]):
                    least[i], changed = least[j], True
    return sorted(((r[0], len(links[i]), least[i], r[0] == least[i]) for i, r in enumerate(rows)), key=str)


def _got(df):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect()), key=str)


def test_against_all_pairs(spark):
    rnd = np.random.default_rng(4)
    rows = []
    for i in range(700):
        if i % 3 == 0 and rows:  # near and exact copies in chains, some of them of the other label
            v = (np.array(rows[rnd.integers(len(rows))][1]) + rnd.choice([0, 0.02, 0.05]) * rnd.normal(size=12)).tolist()
        else:
            v = rnd.normal(size=12).tolist()
        rows.append((int(i * 7 % 700), v, int(rnd.random() < 0.3)))
    df = spark.createDataFrame(rows, SCHEMA)
    assert any(n for _, n, _, _ in _expected(rows))
    assert _got(multiindex.near_duplicates(df)) == _expected(rows)
    # the same in many small slices and query blocks
    assert _got(multiindex.near_duplicates(df, block=40, query_block=90)) == _expected(rows)
    assert _got(multiindex.near_duplicates(df, threshold=0.8)) == _expected(rows, 0.8)


def test_one_group_of_copies_holds_a_third(spark):
    rnd = np.random.default_rng(5)
    base = rnd.normal(size=16)
    rows = [(i, base.tolist(), 1) for i in range(150)] + [(i, (base + 0.01 * rnd.normal(size=16)).tolist(), 1) for i in range(150, 350)]
    rows += [(i, rnd.normal(size=16).tolist(), int(i % 2)) for i in range(350, 500)]
    got = multiindex.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=64)
    assert _got(got) == _expected(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0, 0.0, 0.0], [1.0, None, 2.0], [nan, 1.0, 1.0], [inf, 1.0, 1.0], [], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0], [3.0], [1e30, 2e30, 0.5e30]]
    rows = [(i, v, 1) for i, v in enumerate(odd)] + [(20, [1.0, 2.0, 0.5], 1), (21, [1.0, 2.0, 0.5], None), (22, [1.0, 2.0, 0.5], 2), (20, [1.0, 2.0, 0.5], 1), (23, [-1.0, -2.0, -0.5], 1)]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in ("node", "kind", "n", "cell", "g", "component", "h1")])
    assert _got(multiindex.near_duplicates(df)) == _expected(rows)
    nameless = spark.createDataFrame([(None, [1.0, 0.0], 1), (None, [1.0, 0.0], 1), (5, [1.0, 0.01], 1), (None, [0.0, 1.0], 1)], SCHEMA)
    assert _got(multiindex.near_duplicates(nameless)) == sorted([(None, 2, 5, False), (None, 2, 5, False), (5, 2, 5, True), (None, 0, None, True)], key=str)
    assert multiindex.near_duplicates(df.limit(0)).count() == 0
    assert _got(multiindex.near_duplicates(df.filter("vec_id = 1"))) == [(1, 0, 1, True)]


def test_nodes_are_dealt_over_the_sessions_partitions(spark):
    rows = [(1, [1.0, 0.0, 0.0], 1), (2, [1.0, 0.01, 0.0], 1), (3, [0.0, 1.0, 0.0], 1), (4, [1.0, 0.0, 0.0], 2)]
    got = _got(multiindex.near_duplicates(spark.createDataFrame(rows, SCHEMA)))
    assert got == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True), (4, 0, 4, True)]


def test_traversal_goes_by_rising_sums():
    rnd = np.random.default_rng(6)
    for _ in range(50):
        a, b = rnd.random(6), rnd.random(9)
        visited = list(multiindex.traverse(a, b, 1.1))
        sums = [a[i] + b[j] for i, j in visited]
        assert sums == sorted(sums)
        assert set(visited) == {(i, j) for i in range(6) for j in range(9) if a[i] + b[j] <= 1.1}


def test_bounds_never_pass_the_distance():
    rnd = np.random.default_rng(7)
    x, y = rnd.normal(size=(300, 5)), rnd.normal(size=(200, 5))
    centres = multiindex.codebook(y, 20)
    near = multiindex.distances(y, centres).argmin(axis=1)
    radii = np.array([np.sqrt(multiindex.distances(y, centres)[near == c, c].max(initial=0)) for c in range(len(centres))])
    bound = multiindex.bounds(x, centres, radii)
    assert (bound[:, near] <= multiindex.distances(x, y) + 1e-9).all()
    assert (bound > 0).mean() > 0.5
