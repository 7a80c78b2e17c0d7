"""Ranked lexical search by range-maximum queries over posting lists.

A term is a run of ASCII letters and digits and of all characters beyond ASCII; A-Z count as a-z. A
document's score for an item sums, over the item's distinct terms, the weight of the term times a factor
of its count and of the document's length, all in whole numbers (``factors``, ``weights``).

One pass over the texts keeps the counts of the terms that items ask for. Documents are then taken in
blocks of about ``block`` such counts. In a block every term has a posting list by ascending document, and
a sparse table over all lists answers where the largest factor in a stretch of a list stands. For an item,
the sum over its terms of weight times largest factor bounds the score of every document of an interval.
The search is best-first: the intervals with the highest bounds are split at the document that has the
largest contribution of one term there, that document is scored, and both remaining parts get bounds of
their own. What cannot beat the item's k-th best document so far is dropped: a lower bound, or an equal
one when all its documents have larger ids. A task carries the best documents on from block to block.

Each task gives at most ``k`` rows an item; they are merged in two steps, so that no item is gathered
from all tasks at once. Items come in blocks of about ``item_chars`` characters, one search each, which
bounds the terms, weights and items that tasks hold.

Null texts and those without a term have no terms, and neither are results. Rows that share a document
id are documents of their own; a null id comes after all others and is returned as null. Items with null
or no terms have no results; rows that share an item id are searched one by one and their results merged
by score, so rank stays unique. Extra columns are ignored.
"""

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.llm.tables import stored

K = 50
BLOCK = 1_000_000
ITEM_CHARS = 8_000_000
AT_ONCE = 512
SCALE = 1_000_000_000
NO_ID = np.iinfo(np.int64).max

_TERM_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    """Terms of a text in order, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TERM_BYTES).split()


def weights(df: np.ndarray, documents: int) -> np.ndarray:
    """Weight of terms that so many of the documents hold."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * n + 1))) for n in df.tolist()], dtype=np.int64)


def factors(tf: np.ndarray, n: np.ndarray, documents: int, words: int) -> np.ndarray:
    """What ``tf`` occurrences count in documents of ``n`` terms; below a thousand million thousandths."""
    m = 100 - 50 + (50 * n * documents) // words
    return (SCALE * tf) // (1000 * tf + 20 * m)


class Postings:
    """Posting lists of one block of documents, with a sparse table of range maxima over each."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray, owners: np.ndarray, of_term: np.ndarray, value: np.ndarray):
        """Documents are numbered by ascending id (a later row after an earlier one)."""
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), dtype=np.int64)
        place[order] = np.arange(len(ids))
        self.ids, self.size = ids[order], len(ids)
        by_list = np.lexsort((place[owners], of_term))
        self.docs, self.value = place[owners][by_list].astype(np.int32), value[by_list]
        self.terms, starts = np.unique(of_term[by_list], return_index=True)
        self.starts = np.append(starts, len(by_list))
        longest = int(np.diff(self.starts).max(initial=1))
        # row l has, for every place, where the largest of the 2^l values from there on stands; lists may run over, reads do not
        best = np.arange(len(by_list), dtype=np.int32)
        self.table = [best]
        width = 1
        while 2 * width <= longest:
            ahead = np.concatenate([best[width:], best[len(best) - width :]])
            best = np.where(self.value[ahead] > self.value[best], ahead, best)
            self.table.append(best)
            width *= 2
        self.table = np.stack(self.table)

    def lists(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the wanted terms (sorted) occur here, and for each the place in its list of every document."""
        here = np.searchsorted(self.terms, wanted)
        held = (here < len(self.terms)) & (self.terms[np.minimum(here, len(self.terms) - 1)] == wanted)
        places = np.empty((int(held.sum()), self.size + 1), dtype=np.int32)
        for row, term in zip(places, here[held], strict=True):
            start, end = self.starts[term], self.starts[term + 1]
            row[:] = start + np.searchsorted(self.docs[start:end], np.arange(self.size + 1))
        return held, places

    def maxima(self, places: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For every term and every interval [low, high) of documents, the largest value (0: none) and where it stands."""
        a, b = places[:, low], places[:, high]
        some = b > a
        level = _LOG[np.minimum(b - a, len(_LOG) - 1)]
        long = b - a >= len(_LOG)
        if long.any():
            level[long] = np.frexp((b - a)[long])[1] - 1
        a = np.where(some, a, 0)
        left, right = self.table[level, a], self.table[level, np.where(some, b - (1 << level), 0)]
        at = np.where(self.value[right] > self.value[left], right, left)
        return np.where(some, self.value[at], 0), at


_LOG = np.frexp(np.maximum(np.arange(4096), 1))[1].astype(np.int64) - 1


class Best:
    """The best ``k`` documents of one item so far: score falling, id rising."""

    def __init__(self, k: int):
        self.k, self.scores, self.ids = k, np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        first = np.lexsort((ids, -scores))[: self.k]
        self.scores, self.ids = scores[first], ids[first]

    def beaten_by(self, bounds: np.ndarray, first_ids: np.ndarray) -> np.ndarray:
        """Where a document with that bound, and no smaller id, could still enter."""
        if len(self.scores) < self.k:
            return bounds > 0
        return (bounds > self.scores[-1]) | ((bounds == self.scores[-1]) & (first_ids < self.ids[-1]))


def search_block(block: Postings, wanted: np.ndarray, weight: np.ndarray, best: Best, at_once: int = AT_ONCE) -> int:
    """Add to ``best`` what the block holds for the wanted terms; the number of documents scored."""
    held, places = block.lists(wanted)
    if not len(places):
        return 0
    weight = weight[held][:, None]

    def bounded(low: np.ndarray, high: np.ndarray) -> tuple:
        value, at = block.maxima(places, low, high)
        value *= weight
        top = value.argmax(axis=0)
        return value.sum(axis=0), low, high, block.docs[at[top, np.arange(len(low))]]

    scored = 0
    queue = bounded(np.array([0]), np.array([block.size]))
    while len(queue[0]):
        open_ = best.beaten_by(queue[0], block.ids[queue[1]])
        queue = tuple(c[open_] for c in queue)
        if len(queue[0]) > at_once:
            order = np.argpartition(-queue[0], at_once)
            now, queue = tuple(c[order[:at_once]] for c in queue), tuple(c[order[at_once:]] for c in queue)
        else:
            now, queue = queue, tuple(c[:0] for c in queue)
        _, low, high, split = now
        if not len(low):
            continue
        # the split documents' own scores are the sums over intervals of one document
        value, _ = block.maxima(places, split, split + 1)
        scores = (value * weight).sum(axis=0)
        scored += len(split)
        kept = best.beaten_by(scores, block.ids[split])
        if kept.any():
            best.add(scores[kept], block.ids[split[kept]])
        left, right = split > low, high > split + 1
        parts = bounded(np.concatenate([low[left], split[right] + 1]), np.concatenate([split[left], high[right]])) if left.any() or right.any() else None
        if parts:
            queue = tuple(np.concatenate([a, b]) for a, b in zip(queue, parts, strict=True))
    return scored


def _items(items: DataFrame, item: str, text: str, item_chars: int) -> list[list[tuple[int, list[bytes]]]]:
    """Blocks of items: (id, sorted distinct terms). A block has about ``item_chars`` characters."""
    kept = items.select(F.col(item).alias("id"), F.col(text).cast("string").alias("text"))
    size = kept.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(size) // item_chars))
    dealt = kept.withColumn("b", F.pmod(F.xxhash64("id", "text"), F.lit(n)))
    for b in range(n):
        yield [(r.id, sorted(set(terms(r.text)))) for r in dealt.filter(F.col("b") == b).collect()]


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", block: int = BLOCK, item_chars: int = ITEM_CHARS) -> DataFrame:
    """item, rank, key, score: the ``k`` best documents of every item."""
    found = None
    for asked in _items(items, item, item_text, item_chars):
        one = _search(docs, asked, k, key, text, item, block)
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy(item).orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    near = Window.partitionBy(item, "part").orderBy(F.desc("score"), F.col(key).asc_nulls_last())
    first = found.withColumn("__n", F.row_number().over(near)).filter(F.col("__n") <= k)
    ranked = first.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(item, F.col("rank").cast("int").alias("rank"), key, "score")


def _search(docs: DataFrame, asked: list[tuple[int, list[bytes]]], k: int, key: str, text: str, item: str, block: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, own in asked for t in own})
    number = {t: i for i, t in enumerate(vocabulary)}
    shared_words = spark.sparkContext.broadcast(number)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared_words.value
        for batch in batches:
            lengths, found, often, ends = [], [], [], [0]
            for value in batch.column(1):
                words = terms(value.as_py())
                lengths.append(len(words))
                counts = Counter(map(number.get, words))
                counts.pop(None, None)
                found.extend(counts)
                often.extend(counts.values())
                ends.append(len(found))
            ends = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(c, t)) for c, t in ((found, pa.int32()), (often, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lengths, pa.int64()), *lists], names=["id", "n", "terms", "tfs"])

    # each row of documents and counts once: the statistics and the search read this table
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    counted = stored(rows.mapInArrow(count, "id long, n long, terms array<int>, tfs array<long>"), "term_counts")
    whole = counted.agg(F.count(F.when(F.col("n") > 0, 1)).alias("documents"), F.sum("n").alias("words")).first()
    documents, words = whole.documents, max(1, whole.words or 0)
    df = np.zeros(len(vocabulary), dtype=np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        df[r.t] = r["count"]
    weight = weights(df, documents)
    queries = [(i, np.array([number[t] for t in own], dtype=np.int64)) for i, own in asked if own]
    shared = spark.sparkContext.broadcast((queries, weight))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, weight = shared.value
        best = [Best(k) for _ in queries]
        waiting, held = [], 0

        def searched() -> None:
            columns = [np.concatenate(c) for c in zip(*waiting, strict=True)]
            ids, lengths, sizes, of_term, tf = columns
            owners = np.repeat(np.arange(len(ids)), sizes)
            if len(owners):
                postings = Postings(ids, lengths, owners, of_term, factors(tf, lengths[owners], documents, words))
                for (_, wanted), own in zip(queries, best, strict=True):
                    search_block(postings, wanted, weight[wanted], own)

        for batch in batches:
            ids = batch.column(0).fill_null(NO_ID).to_numpy()
            sizes = np.diff(batch.column(2).offsets.to_numpy())
            for part in _cuts(sizes, block):
                own = batch.slice(part.start, part.stop - part.start)
                waiting.append((ids[part], own.column(1).to_numpy(), sizes[part], own.column(2).flatten().to_numpy().astype(np.int64), own.column(3).flatten().to_numpy()))
                held += int(sizes[part].sum())
                if held >= block:
                    searched()
                    waiting, held = [], 0
        if waiting:
            searched()
        results = [(q, None if d == NO_ID else d, s) for (q, _), own in zip(queries, best, strict=True) for d, s in zip(own.ids.tolist(), own.scores.tolist(), strict=True)]
        columns = [[r[i] for r in results] for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[item, key, "score"])

    found = counted.filter(F.size("terms") > 0).mapInArrow(look, f"`{item}` long, `{key}` long, score long")
    return found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(64)))


def _cuts(sizes: np.ndarray, block: int) -> Iterator[slice]:
    """Stretches of rows with about ``block`` counts, none empty."""
    start, held = 0, 0
    for i, n in enumerate(sizes.tolist()):
        held += n
        if held >= block:
            yield slice(start, i + 1)
            start, held = i + 1, 0
    if start < len(sizes):
        yield slice(start, len(sizes))
