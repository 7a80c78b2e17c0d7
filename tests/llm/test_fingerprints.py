import hashlib

from pyspark.sql import functions as F

from ledgerlens.llm import fingerprints


def _root(text):
    sha = lambda mark, s: hashlib.sha256((mark + s).encode()).hexdigest()
    nodes, inside = [], []
    paragraphs = text.split("\n")
    for i, p in enumerate(paragraphs):
        inside.append(sha("p", p))
        if i == len(paragraphs) - 1 or inside[-1].startswith("0") or p == "":
            nodes.append(sha("s", "".join(inside)))
            inside = []
    return sha("r", "".join(nodes))


def test_roots_and_edits_against_python(messy):
    docs = messy.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = sorted(fingerprints.against_edit(docs).collect(), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    ids = sorted(texts)
    for r, following in zip(rows, ids[1:] + ids[:1], strict=True):
        text, n = texts[r.doc_id], len(texts[r.doc_id])
        edited = text[: n - n // 2] + texts[following][: n // 2]
        assert r.n_chars == n
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        assert r.fingerprint == _root(text) and r.edited_fingerprint == _root(edited)
        assert 0 <= r.near_edited <= 1 and (r.near_edited == 1.0) >= (text == edited)
        assert (r.changed_from is None) == (text == edited)
        if text != edited:
            a, b = text.split("\n"), edited.split("\n")
            assert a[: r.changed_from] == b[: r.changed_from]
            assert len(b) == r.changed_to or a[-(len(b) - r.changed_to) :] == b[r.changed_to :]


def test_rows_are_kept(messy, nothing):
    assert fingerprints.against_edit(messy).count() == messy.count()
    assert fingerprints.against_edit(nothing).count() == 0
    grown = fingerprints.fingerprints(messy)
    assert grown.columns == [*messy.columns, "n_sections", "n_paragraphs"]
    assert grown.filter(F.col("text").isNull() | (F.col("text") == "")).select("fingerprint").distinct().count() == 1


def test_next_row_over_many_cells(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "DOCS_PER_CELL", 3)
    ids = [1, 2, 3, 50, 51, 52, 53, 54, 1000, 1001, -7, 10**12]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], "id long, t string")
    got = {r.id: r.n for r in fingerprints.with_next(df, "id", "t", "n").collect()}
    order = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(order, order[1:] + order[:1], strict=True)}


def test_cells_follow_uneven_keys(spark, monkeypatch):
    """A few far outliers do not bring the other rows into one cell."""
    monkeypatch.setattr(fingerprints, "DOCS_PER_CELL", 4)
    ids = [*range(3_000), 2**62, -(2**62), None]
    df = spark.createDataFrame([(i,) for i in ids], "id long")
    placed = fingerprints.with_cell(df, "id").withColumnRenamed("__cell", "cell")
    rows = sorted(placed.filter("id is not null").collect())
    assert [r.cell for r in rows] == sorted(r.cell for r in rows)
    sizes = [r["count"] for r in placed.groupBy("cell").count().collect()]
    assert len(sizes) > 300 and max(sizes) < 100
    assert placed.filter("id is null").first().cell == -1


def test_single_row_follows_itself(spark):
    df = spark.createDataFrame([(5, "abcd")], "doc_id long, text string")
    row = fingerprints.against_edit(df).first()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1.0
