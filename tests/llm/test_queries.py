"""Every registered query at the smallest scale: against its SQL, or whole and without crossing rows."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from ledgerlens.llm import linededup, quality, simhash, toxicity
from ledgerlens.llm.oracle import ORACLES
from ledgerlens.llm.queries import QUERIES
from ledgerlens.llm.tables import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not mounted")


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    df, relation = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    places = [relation.columns.index(c) for c in columns]
    assert sorted(str(tuple(r[c] for c in columns)) for r in df.collect()) == sorted(str(tuple(r[i] for i in places)) for r in relation.fetchall())
    plan = df._jdf.queryExecution().executedPlan().toString()
    native = ("Python", "Pandas", "Arrow") if name in ("op1_fingerprints", "op2_line_dedup") else ()
    for node in (*native, "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_packing", "op5_html", "op10_neighbours", "op11_vector_dedup", "op12_ranked_search")])
def test_one_row_for_each_document(spark, name):
    ids = sorted(r.doc_id for r in QUERIES[name](spark, SF).select("doc_id").collect())
    assert ids == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = {r.doc_id: r for r in out.collect()}
        if name in ("toxicity", "quality"):
            labels = spark.read.parquet(f"{SF}/labels.parquet")
            module = toxicity if name == "toxicity" else quality
            scored = {r.doc_id: r.predicted for r in module.score(docs, labels).collect()}
            assert rows == {i: r for i, r in before.items() if scored[i] == (0 if name == "toxicity" else 1)}
        elif name == "line_dedup":
            kept = {r.doc_id: r.text for r in linededup.drop_frequent_lines(docs).collect()}
            assert {i: r.text for i, r in rows.items()} == kept
            assert all(r.n_chars == len(r.text) for r in rows.values())
        else:
            assert set(rows) == {r.component_id for r in simhash.near_duplicates(docs).collect()}
        docs = spark.createDataFrame(list(rows.values()), docs.schema)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    whole = corpus_pipeline.run(spark, SF)
    assert packed.columns == whole.columns
    assert {r.doc_id for r in whole.collect()} == {r.doc_id for r in docs.collect()}


def test_pipeline_over_messy_rows(spark, messy):
    docs = messy.select("doc_id", "text", "lang", "source", "n_chars")
    for start in (docs, docs.limit(0)):
        current = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            current = stage(spark, current, SF)
            assert current.columns == start.columns
        assert corpus_pipeline.STAGES[-1][1](spark, current, SF).count() >= 0


def test_pipeline_keeps_columns_of_any_name(spark):
    names = ["score", "probability", "prediction", "rawPrediction", "x", "fp", "label", "features", "n_lines", "n_dropped", "__r1", "a.b"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    clashing = docs.select("*", *[F.concat(F.lit(n), F.col("doc_id")).alias(n) for n in names])
    plain = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        clashing, plain = stored(stage(spark, clashing, SF), f"clash_{name}"), stored(stage(spark, plain, SF), f"plain_{name}")
        assert clashing.columns == [*docs.columns, *names]
        rows = clashing.collect()
        assert all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
        assert sorted((r.doc_id, r.text, r.n_chars) for r in rows) == sorted((r.doc_id, r.text, r.n_chars) for r in plain.collect()) != []
    packed, other = (corpus_pipeline.pack(spark, d, SF) for d in (clashing, plain))
    assert sorted(map(str, packed.collect())) == sorted(map(str, other.collect()))


@pytest.mark.parametrize(("module", "stage"), [(toxicity, corpus_pipeline.drop_toxic), (quality, corpus_pipeline.drop_poor)])
def test_filters_keep_all_without_a_model(spark, monkeypatch, module, stage):
    docs = spark.createDataFrame([(i, f"clean text {i}", "en", "s", 12) for i in range(20)] + [(None, None, "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    same = [(i, 0, 1) for i in range(20)]
    for rows in ([], same, [(i, 1 - q, 1 - t) for i, q, t in same], [(500, 0, 1), (501, 1, 0)]):
        monkeypatch.setattr(corpus_pipeline, "read", lambda *_, rows=rows: spark.createDataFrame(rows, "doc_id long, quality int, toxic int"))
        with pytest.warns(UserWarning, match="nothing to learn from"):
            out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect()))
    few = spark.createDataFrame([(i, f"w{i}" if i else "v", "en", "s", 2) for i in range(4)], docs.schema)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(4)], "doc_id long, quality int, toxic int")
    assert quality.fit(few, labels, F.lit(True), least=9).learned is False
    assert module.fit(few, labels.limit(0), F.lit(True)).learned is False
