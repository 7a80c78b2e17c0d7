"""From raw documents to packed sequences: drop toxic and poor documents, frequent lines and near copies, then pack.

A stage whose model found nothing to learn from (no labels, or of one kind only) warns and keeps all documents.
Extra columns of any name go through unchanged, up to packing.
"""

import warnings
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import labelled, linededup, packing, quality, simhash, toxicity
from ledgerlens.llm.tables import lower_batches, read, settled, tokenizer


KEYS = ("doc_id", "text")


def _aside(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """doc_id, text and the other columns under names of their own, which no operator uses; and how to name them back."""
    other = [c for c in docs.columns if c not in KEYS]
    names = {c: f"__c{i}" for i, c in enumerate(other)}
    own = docs.select(*KEYS, *[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    return own, [F.col(names.get(c, c)).alias(c) for c in docs.columns]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject."""
    lower_batches(spark)
    usable = labelled.remainder("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"), usable)
    if not model.learned:
        warnings.warn("toxicity: nothing to learn from, all documents are kept", stacklevel=2)
        return docs
    own, back = _aside(docs)
    return model.scores(own, also=own.columns[1:]).filter("score < 0.5").select(back)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model does not reject."""
    lower_batches(spark)
    usable = labelled.remainder("doc_id", quality.FOLDS) != quality.HELD_OUT
    model = quality.fit(docs, read(spark, sf_dir, "labels"), usable)
    if not model.learned:
        warnings.warn("quality: nothing to learn from, all documents are kept", stacklevel=2)
        return docs
    own, back = _aside(docs)
    return model.scores(own, also=own.columns[1:]).filter(F.col("score") >= quality.THRESHOLD).select(back)


def drop_frequent_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents share; n_chars is that of the rest."""
    own, back = _aside(docs)
    kept = linededup.drop_frequent_lines(own)
    place = [c for c in docs.columns if c not in KEYS].index("n_chars") if "n_chars" in docs.columns else None
    return (kept if place is None else kept.withColumn(f"__c{place}", F.length("text").cast("bigint"))).select(back)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    own, back = _aside(docs)
    return simhash.one_of_each(own).select(back)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences, one row for each piece of a document."""
    return packing.pack(docs.select(*KEYS), tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("quality", drop_poor),
    ("line_dedup", drop_frequent_lines),
    ("simhash", drop_near_copies),
    ("packing", pack),
]

#: Models and token ids are beyond SQL; tests compare run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again, and its own tables are deleted."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = settled(spark, f"pipeline_{name}", partial(stage, spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
