import pathlib

import pytest

from ledgerlens import session
from ledgerlens.llm import linededup, quality, simhash, tables, tokencount
from ledgerlens.llm.tables import kept_in_worker
from ledgerlens.sources.sinks import shared_folder


def test_only_the_last_made_is_kept():
    made = []

    def make(name):
        made.append(name)
        return [name]

    first = kept_in_worker(make, "a")
    assert kept_in_worker(make, "a") is first and made == ["a"]
    assert kept_in_worker(make, "b") == ["b"] and kept_in_worker(make, "a") is not first
    assert made == ["a", "b", "a"]


def _folders(spark):
    root = pathlib.Path(shared_folder(spark).removeprefix("file:")) / "ledgerlens"
    return {p for p in root.rglob("*") if p.is_dir() and list(p.glob("*.parquet"))}


def test_a_scope_and_close_leave_no_folder(spark, messy):
    tables.close(spark)
    before = _folders(spark)
    with tables.scope(spark):
        simhash.near_duplicates(messy).count()
        assert len(_folders(spark)) > len(before)
    assert _folders(spark) == before
    kept = tables.settled(spark, "kept", lambda: linededup.drop_frequent_lines(messy, threshold=3))
    assert len(_folders(spark) - before) == 1 and kept.count() == messy.count()
    tables.close(spark)
    assert _folders(spark) == before


def test_a_scope_ends_with_the_error_inside(spark, messy):
    before = _folders(spark)
    with pytest.raises(ZeroDivisionError), tables.scope(spark):
        tables.stored(messy, "lost")
        1 / 0
    assert _folders(spark) == before


def test_reading_widens_shuffles(spark, tmp_path, monkeypatch):
    initial = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    spark.range(5).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(session, "input_bytes", lambda *_: 300 * session.BYTES_PER_PARTITION)
    assert tables.width(spark) < 300
    try:
        assert tables.read(spark, str(tmp_path), "documents").count() == 5
        assert spark.conf.get(initial) == "300" == str(tables.width(spark)) == str(linededup.LineRuns(spark, 2).buckets)
    finally:
        spark.conf.unset(initial)


def test_memos_do_not_keep_long_entries():
    counter, shapes = tokencount.Counter(tables.tokenizer("byte_bpe_50k.tiktoken")), quality.Shapes()
    for i in range(100):
        long = f"w{i}" + "abcdefghij" * 1_000
        assert counter[long] == len(counter.encoding.encode_ordinary(long))
        assert shapes[long] == quality.shape(long)
    assert not counter and not shapes
    assert counter["word"] and shapes["word"] == "x" and list(counter) == list(shapes) == ["word"]


def test_the_pipelines_classifiers_send_texts_to_workers_in_small_batches(spark, messy, monkeypatch):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "read", lambda *_: spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    try:
        for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_poor):
            spark.conf.set(key, 10_000)
            with pytest.warns(UserWarning):
                stage(spark, messy, "")
            assert spark.conf.get(key) == "1000"
            spark.conf.set(key, 50)  # smaller ones stay
            with pytest.warns(UserWarning):
                stage(spark, messy, "")
            assert spark.conf.get(key) == "50"
    finally:
        spark.conf.set(key, before)
