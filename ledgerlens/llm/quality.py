"""Quality classifier: naive Bayes support vectors.

Indicators of n-grams are scaled by the log ratio of their counts in good and poor documents; a linear
model with hinge loss is fitted to them by dual coordinate descent; a logistic curve over margins
of documents the model has not seen turns margins into scores. N-grams are single words, and runs of
one to three word shapes (case, digits and punctuation of a word; a word equal to the one before it
has a shape of its own).

The sample has at most ``rows`` labelled documents and n-grams found in fewer than ``least`` of them
are left out, which bounds the model; every document is scored over its whole text. Null and empty
texts have no n-grams and get the score of the bias alone. Without labels of both kinds, or n-grams
that enough documents share, the score is the share of label 1 (0 without labels).
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import labelled
from ledgerlens.llm.tables import stored, text_column

ROWS = 8_000
LEAST = 5
FOLDS = 4
HELD_OUT = 2
THRESHOLD = 0.7
KEPT_SHAPES = 300_000
LONGEST = 64
SHAPE = 24

LETTERS = re.compile(r"[^\W\d_]+")
DIGITS = re.compile(r"\d+")
REPEATED = re.compile(r"(.)\1+")


def shape(word: str) -> str:
    """Letters as x, X or Xx, digits as 9, punctuation as it is, repeated characters twice; longer shapes are cut to ``SHAPE`` characters."""

    def letters(m: re.Match) -> str:
        run = m[0]
        return "x" if run.islower() else "X" if run.isupper() and len(run) > 1 else "Xx" if run[1:].islower() or len(run) == 1 else "xX"

    return REPEATED.sub(r"\1\1", DIGITS.sub("9", LETTERS.sub(letters, word)))[:SHAPE]


class Shapes(dict):
    """Shapes of the words met last of at most ``LONGEST`` characters."""

    def __missing__(self, word: str) -> str:
        out = shape(word)
        if len(word) <= LONGEST:
            if len(self) >= KEPT_SHAPES:
                self.clear()
            self[word] = out
        return out


def ngrams(text: str, shapes: Shapes) -> set:
    """The distinct n-grams of a text: words as str, shapes as tuples."""
    words = text.split()
    seen = [s if a != b else "=" for s, a, b in zip(map(shapes.__getitem__, words), words, ["", *words])]
    return {*words, *zip(seen), *zip(seen, seen[1:]), *zip(seen, seen[1:], seen[2:])}


def _flat(gram) -> str:
    return gram if isinstance(gram, str) else "\t".join(gram) + "\t"


def _grams(sample: DataFrame, key: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            grams = [sorted(map(_flat, ngrams(t.as_py() or "", shapes))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(grams, pa.list_(pa.string()))], names=["label", "grams"])

    return sample.select("label", "text").mapInArrow(run, "label double, grams array<string>")


def dual_descent(rows: list[np.ndarray], signs: np.ndarray, scales: np.ndarray, cost: np.ndarray, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise |w|^2 / 2 + cost * hinge loss, one dual variable at a time."""
    w, bias, duals = np.zeros(len(scales)), 0.0, np.zeros(len(rows))
    squares = np.array([1.0 + float((scales[r] ** 2).sum()) for r in rows])
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in order.permutation(len(rows)):
            r = rows[i]
            gradient = signs[i] * (float(w[r] @ scales[r]) + bias) - 1.0
            new = min(max(duals[i] - gradient / squares[i], 0.0), cost[i])
            step = (new - duals[i]) * signs[i]
            if step:
                w[r] += step * scales[r]
                bias += step
                duals[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-4:
            break
    return w, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the curve from margins to probabilities (Newton steps, smoothed targets)."""
    positives = float(labels.sum())
    high, low = (positives + 1) / (positives + 2), 1 / (len(labels) - positives + 2)
    target, a, b = np.where(labels > 0, high, low), 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g, h = p - target, np.maximum(p * (1 - p), 1e-6)
        m = np.array([[float((h * margins**2).sum()) + 1e-3, float((h * margins).sum())], [float((h * margins).sum()), float(h.sum()) + 1e-3]])
        da, db = np.linalg.solve(m, [float((g * margins).sum()), float(g.sum())])
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 1e-3), b


class Model:
    """Weights by n-gram, with bias and curve; ``constant`` where there is nothing to learn from."""

    def __init__(self, weights: dict, bias: float = 0.0, slope: float = 1.0, offset: float = 0.0, constant: float | None = None):
        self.weights, self.bias, self.slope, self.offset, self.constant = weights, bias, slope, offset, constant
        self.learned = constant is None

    def scores(self, docs: DataFrame, key: str = "doc_id", text: str = "text", also: list[str] = ()) -> DataFrame:
        """key, ``also``, score of every row."""
        kept, texts, place = [key, *also], *text_column(docs, text, also)
        if self.constant is not None:
            return docs.select(*kept, F.lit(self.constant).alias("score"))
        schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", score double"
        shared = docs.sparkSession.sparkContext.broadcast(self.weights)
        bias, slope, offset = self.bias, self.slope, self.offset

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weights, shapes = shared.value, Shapes()
            for batch in batches:
                margins = [bias + math.fsum(weights.get(g, 0.0) for g in ngrams(t.as_py() or "", shapes)) for t in batch.column(place)]
                values = [1 / (1 + math.exp(-min(30.0, max(-30.0, slope * m + offset)))) for m in margins]
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(values, pa.float64())], names=[*kept, "score"])

        return docs.select(*kept, *texts).mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, least: int = LEAST, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled documents for which ``usable`` holds."""
    sampled = labelled.sample(docs, labels, "quality", usable, rows, key, text)
    grams = stored(_grams(sampled, key), "quality_ngrams")
    kinds = grams.agg(F.sum("label"), F.sum(1 - F.col("label")), F.avg("label")).first()
    if not kinds[0] or not kinds[1]:
        return Model({}, constant=float(kinds[2] or 0.0))
    counts = grams.select("label", F.explode("grams").alias("gram")).groupBy("gram").agg(F.sum("label").alias("good"), F.count(F.lit(1)).alias("n"))
    table = stored(counts.filter(F.col("n") >= least), "quality_counts")
    # bounded by the sample: rows of at most ``rows`` documents, n-grams that ``least`` of them share
    known = {r.gram: (i, r.good, r.n - r.good) for i, r in enumerate(table.orderBy("gram").toLocalIterator())}
    if not known:
        return Model({}, constant=float(kinds[2]))
    good, poor = (np.array([k[j] for k in known.values()]) + 1.0 for j in (1, 2))
    ratios = np.log((good / good.sum()) / (poor / poor.sum()))
    usable_rows = grams.select("label", F.array_sort("grams").alias("grams"), F.xxhash64("grams").alias("h")).orderBy("h", "label")
    labels_, vectors = [], []
    for r in usable_rows.toLocalIterator():
        labels_.append(r.label)
        vectors.append(np.array([known[g][0] for g in r.grams if g in known], dtype=np.int32))
    y = np.array(labels_)
    signs = np.where(y > 0, 1.0, -1.0)
    norm = float(np.mean([np.sqrt((ratios[v] ** 2).sum()) for v in vectors])) or 1.0
    scales = ratios / norm
    cost = np.where(y > 0, 1.0, max(1.0, float(kinds[0]) / float(kinds[1])) ** 0.5)
    margins = np.zeros(len(y))
    parts = np.arange(len(y)) % 5
    for part in range(5):
        inside = np.flatnonzero(parts != part)
        w, bias = dual_descent([vectors[i] for i in inside], signs[inside], scales, cost[inside])
        for i in np.flatnonzero(parts == part):
            margins[i] = float(w[vectors[i]] @ scales[vectors[i]]) + bias
    slope, offset = logistic(margins, y)
    w, bias = dual_descent(vectors, signs, scales, cost)
    final = w * scales
    weights = {(tuple(g[:-1].split("\t")) if g.endswith("\t") else g): float(final[i]) for g, (i, _, _) in known.items()}
    return Model(weights, bias, slope, offset)


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with remainder 2 are never learned from."""
    model = fit(docs, labels, labelled.remainder("doc_id", FOLDS) != HELD_OUT, rows)
    held = F.coalesce(labelled.remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return model.scores(docs).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
