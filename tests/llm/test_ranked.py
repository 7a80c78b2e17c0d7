import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from ledgerlens.llm import ranked

TERM = re.compile("[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+")


def _terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def _expected(docs, items, k):
    """Every document scored for every item, from the definition."""
    own = [(i, _terms(t)) for i, t in docs]
    big_n, words = sum(1 for _, t in own if t), max(1, sum(len(t) for _, t in own))
    df = Counter(t for _, terms in own for t in set(terms))
    out = []
    for item, text in items:
        scored = []
        for doc, terms in own:
            tf, m = Counter(terms), 100 - 50 + (50 * len(terms) * big_n) // words
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * ((1000000000 * tf[t]) // (1000 * tf[t] + 20 * m)) for t in set(_terms(text)) if tf[t])
            if score > 0:
                scored.append((-score, doc is None, doc or 0, doc))
        out += [(item, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


def _got(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


def _tables(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_against_scoring_all(spark):
    rnd = np.random.default_rng(3)
    vocabulary = [f"w{int(x)}" for x in rnd.zipf(1.3, 400) % 300] + ["Été", "été", "STRASSE", "straße", "l'eau", "a_b"]
    docs = [(int(i), " ".join(rnd.choice(vocabulary, rnd.integers(1, 60)))) for i in rnd.permutation(900)]
    docs += [(1000 + i, docs[0][1]) for i in range(120)]  # more ties than results
    items = [(i, " ".join(rnd.choice(vocabulary, rnd.integers(1, 25)))) for i in range(30)] + [(99, docs[0][1])]
    expected = _expected(docs, items, 50)
    assert _got(ranked.search(*_tables(spark, docs, items))) == expected
    # many blocks of documents and of items
    assert _got(ranked.search(*_tables(spark, docs, items), block=300, item_chars=400)) == expected
    assert _got(ranked.search(*_tables(spark, docs, items), k=3, block=50)) == _expected(docs, items, 3)


def test_messy_rows(spark, messy, nothing):
    items = [(1, "shared LINE one idiot"), (2, None), (3, ""), (4, "...!"), (5, "öther a long"), (None, "two"), (5, "Σας ΣΑΣ")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("score", F.lit("clash"))
    docs = [(r.doc_id, r.text) for r in messy.collect()]
    clashing = messy.select("*", *[F.lit("clash").alias(c) for c in ("n", "terms", "tfs", "id", "score", "rank", "part", "item_id")])
    got = _got(ranked.search(clashing, table))
    single = [x for x in items if x[0] != 5]
    assert [g for g in got if g[0] != 5] == _expected(docs, single, 50)
    both = [g for g in got if g[0] == 5]
    assert sorted(g[1] for g in both) == list(range(1, len(both) + 1))
    assert sorted(g[2:] for g in both) == sorted(g[2:] for i in items if i[0] == 5 for g in _expected(docs, [i], 50))
    assert ranked.search(nothing, table).count() == 0
    assert ranked.search(messy, table.limit(0)).count() == 0


def test_search_scores_few_documents_of_a_skewed_block():
    rnd = np.random.default_rng(8)
    n = 4000
    owners, of_term = np.repeat(np.arange(n), 3), np.tile([0, 1, 2], n)
    value = rnd.integers(1, 100, 3 * n)
    value[owners < 5] = 10_000
    block = ranked.Postings(np.arange(n), np.full(n, 3), owners, of_term, value)
    best = ranked.Best(5)
    assert ranked.search_block(block, np.array([0, 1, 2]), np.ones(3, dtype=np.int64), best, at_once=4) < 100
    assert best.ids.tolist() == [0, 1, 2, 3, 4]


def test_range_maxima():
    rnd = np.random.default_rng(9)
    owners, of_term = np.divmod(np.flatnonzero(rnd.random(200 * 4) < 0.4), 4)
    value = rnd.integers(1, 50, len(owners))
    block = ranked.Postings(np.arange(200), np.full(200, 1), owners, of_term, value)
    _, places = block.lists(np.arange(4))
    low = rnd.integers(0, 200, 300)
    high = np.minimum(200, low + rnd.integers(0, 120, 300))
    got, _ = block.maxima(places, low, high)
    for t in range(4):
        own = {o: v for o, v, x in zip(owners, value, of_term, strict=True) if x == t}
        assert got[t].tolist() == [max([v for o, v in own.items() if a <= o < b], default=0) for a, b in zip(low, high, strict=True)]
