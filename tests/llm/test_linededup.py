import hashlib
from collections import Counter

from pyspark.sql import functions as F

from ledgerlens.llm import linededup

WHITE = " \t\n\x0b\x0c\r"


def _key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(WHITE))


def _expected(texts, threshold):
    seen = Counter(k for t in texts for k in {_key(x) for x in (t or "").split("\n")} - {""})
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (_key(x) and seen[_key(x)] >= threshold)]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_against_python(messy):
    rows = messy.collect()
    for batches in (1, 3, 4):
        got = linededup.drop_frequent_lines(messy, threshold=3, batches=batches, fanout=2)
        assert got.columns == [*messy.columns, "n_dropped"]
        found = sorted((r.n_lines, r.n_dropped, r.text) for r in got.collect())
        assert found == sorted(_expected([r.text for r in rows], 3))


def test_hot_line(spark):
    texts = [f"own {i % 40}\nALL rights reserved \nlast {i}" for i in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in linededup.drop_frequent_lines(df, threshold=15).collect()}
    for i, (lines, dropped, kept) in enumerate(_expected(texts, 15)):
        assert (got[i].n_lines, got[i].n_dropped, got[i].text) == (lines, dropped, kept)


def test_runs_are_compacted_and_removed(spark):
    runs = linededup.LineRuns(spark, threshold=2, fanout=2)
    batch = lambda *pairs: spark.createDataFrame([(a, a, n) for a, n in pairs], "k1 long, k2 long, docs long")
    runs.add(batch((1, 1), (2, 5)))
    assert sorted(r.k1 for r in runs.unseen(batch((1, 1), (3, 1))).collect()) == [3]
    runs.add(batch((1, 1), (2, 1), (3, 1)))
    assert [len(level) for level in runs.levels] == [0, 1]
    runs.add(batch((3, 1)))
    assert sorted(r.k1 for r in runs.settled().collect()) == [1, 2, 3]
    assert {r.k1: r.docs for r in runs.merged(runs.runs()).collect()} == {1: 2, 2: 5, 3: 2}
    runs.close()
    assert runs.runs() == [] and not [t for t in spark.catalog.listTables() if t.name.startswith("llm_run_")]


def test_nothing(nothing):
    assert linededup.drop_frequent_lines(nothing).count() == 0


def test_batches_have_rows_alike_whatever_the_keys(spark):
    far = spark.range(400).union(spark.createDataFrame([(10**15,), (None,)], "id long"))
    sizes = [b.count() for b in linededup.id_batches(far, "id", 4)]
    assert sum(sizes) == 402 and len(sizes) == 4 and min(sizes) > 80
    hot = spark.createDataFrame([(7,)] * 90 + [(i,) for i in range(10)], "id long")
    assert sum(b.count() for b in linededup.id_batches(hot, "id", 4)) == 100


def test_keys_that_are_no_numbers(messy):
    named = messy.withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    want = sorted(map(str, linededup.drop_frequent_lines(messy.withColumn("doc_id", F.lit(None).cast("long")), threshold=3).drop("doc_id").collect()))
    assert sorted(map(str, linededup.drop_frequent_lines(named, threshold=3).drop("doc_id").collect())) == want


def test_native_plan(messy):
    plan = linededup.drop_frequent_lines(messy)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    row = linededup.drop_frequent_lines(messy).filter(F.col("doc_id") == 10).select(F.sha2("text", 256).alias("h")).first()
    assert row.h == hashlib.sha256(b"a").hexdigest()
