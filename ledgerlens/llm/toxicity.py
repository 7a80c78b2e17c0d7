"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are densities and counts of words from lexicons (a fixed list of insults, and words and word
beginnings that mark toxic documents in the labelled sample), how often such words stand near a
second-person pronoun, capitals, punctuation, and obfuscation (letters broken by digits or symbols,
also after undoing that). Lexicon features of training rows come from a lexicon learned on the other
half of the sample, so that trees see them as they will be on new documents. Isotonic regression is
fitted on a fifth of the sample that the trees have not seen. A sign inside a word is undone with at most
``AROUND`` characters on each side of it.

The sample has at most ``rows`` labelled documents; every document is scored over its whole text.
Null and empty texts have no hits and get the score of such a row. Without labels of both kinds the
score is the share of label 1 (0 without labels).
"""

import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm import labelled
from ledgerlens.llm.tables import stored, text_column

ROWS = 20_000
TERMS = 4_000
STEM = 5
NEAR = 4
AROUND = 24
FOLDS = 5
HELD_OUT = 0

#: Common insults.
INSULTS = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb fool fools loser losers pathetic worthless scum trash garbage clown clowns"
    " disgusting imbecile cretin jerk creep pig pigs filth filthy vermin coward liar ugly useless hate kill die shut hell damn"
    " idiota imbécil estúpido estúpida tonto basura asqueroso inútil idiote imbécile stupide crétin ordure dégoûtant nul minable"
    " dummkopf trottel arschloch blöd dumm abschaum ekelhaft wertlos versager".split()
)
#: Second-person pronouns.
YOU = frozenset("you your yours yourself u ur tu te ti tus usted ustedes vos toi ton ta tes vous votre vos du dich dir dein deine deiner ihr euch sie ihnen".split())
#: Characters that stand for letters.
PLAIN = str.maketrans("01345789@$!|+€", "oieastbgasilte")

WORD = re.compile(r"[^\W\d_]+")
INNER = re.compile(r"(?<=[^\W\d_])[0-9@$!|+€*._\-]{1,3}(?=[^\W\d_])")
SPACE = re.compile(r"\s")
RUNS = re.compile(r"[!?]{2,}")
FEATURES = 14


def features(text: str, terms: frozenset[str], stems: frozenset[str]) -> list[float]:
    """The dense features of one text."""
    lowered = text.lower()
    words = WORD.findall(lowered)
    n = max(1, len(words))
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    marked = [i for i, w in enumerate(words) if w in terms]
    begun = [i for i, w in enumerate(words) if w[:STEM] in stems]
    hits = sorted({*insults, *marked, *begun})
    near = sum(any(w in YOU for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits)
    crowd = max((sum(1 for j in hits[k : k + 50] if j - i < 50) for k, i in enumerate(hits)), default=0)
    letters = sum(map(len, words)) or 1
    capitals = sum(map(str.isupper, text))
    shouted = sum(len(w) > 1 and w.isupper() for w in WORD.findall(text)) if capitals > len(words) else 0
    broken = undone = 0
    for m in INNER.finditer(lowered):
        broken += 1
        around = lowered[max(0, m.start() - AROUND) : m.end() + AROUND]
        token = SPACE.split(around[: m.start() - max(0, m.start() - AROUND)])[-1] + SPACE.split(lowered[m.start() : m.end() + AROUND])[0]
        plain = "".join(WORD.findall(token.translate(PLAIN)))
        undone += plain in INSULTS or plain in terms
    size = max(1, len(text))
    return [
        len(insults) / n, math.log1p(len(insults)), len(marked) / n, math.log1p(len(marked)), len(begun) / n, math.log1p(len(begun)),
        near / max(1, len(hits)), crowd / 50, capitals / letters, shouted / n, sum(map(text.count, "!?")) / size, len(RUNS.findall(text)) / n,
        broken / n, math.log1p(undone),
    ]


def with_features(docs: DataFrame, key: str, text: str, lexicon: tuple[list[str], list[str]], also: list[str] = ()) -> DataFrame:
    """key, ``also`` and x: array<double>, in one pass over the texts."""
    terms, stems = map(frozenset, lexicon)
    kept, texts, place = [key, *also], *text_column(docs, text, also)
    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in kept) + ", x array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py() or "", terms, stems) for t in batch.column(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(rows, pa.list_(pa.float64()))], names=[*kept, "x"])

    return docs.select(*kept, *texts).mapInArrow(run, schema)


def lexicon(sample: DataFrame, terms: int = TERMS) -> tuple[list[str], list[str]]:
    """Words and word beginnings that stand in toxic documents eight times as often as in others; at most ``terms`` of each."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0)))
    stems = F.array_distinct(F.transform(F.filter(words, lambda w: F.length(w) > STEM), lambda w: F.substring(w, F.lit(1), F.lit(STEM))))
    found = sample.select("label", words.alias("w"), stems.alias("s"))
    totals = sample.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    if not totals.toxic or not totals.clean:
        return [], []

    def best(column: str) -> list[str]:
        counts = found.select("label", F.explode(column).alias("term")).groupBy("term").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
        odds = F.log((F.col("t") + 0.5) / F.lit(totals.toxic)) - F.log((F.col("c") + 0.5) / F.lit(totals.clean))
        return [r.term for r in counts.filter((F.col("t") >= 3) & (odds >= math.log(8))).orderBy(F.desc(odds * F.sqrt("t")), "term").limit(terms).collect()]

    return best("w"), best("s")


class Model:
    """A fitted lexicon, forest and calibration; ``constant`` where there is nothing to learn from."""

    def __init__(self, lexicon, trees=None, isotonic=None, constant: float = 0.0):
        self.lexicon, self.trees, self.isotonic, self.constant = lexicon, trees, isotonic, constant
        self.learned = trees is not None

    def scores(self, docs: DataFrame, key: str = "doc_id", text: str = "text", also: list[str] = ()) -> DataFrame:
        """key, ``also``, score of every row."""
        kept = [key, *also]
        if self.trees is None:
            return docs.select(*kept, F.lit(self.constant).alias("score"))
        rows = with_features(docs, key, text, self.lexicon, also).withColumn("x", array_to_vector("x"))
        out = self.isotonic.transform(self.trees.transform(rows))
        return out.select(*kept, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score"))).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from at most ``rows`` labelled documents for which ``usable`` holds."""
    sampled = stored(labelled.sample(docs, labels, "toxic", usable, rows, key, text), "toxicity_sample")
    half = F.pmod(F.xxhash64(F.lit("half"), key), F.lit(2)) == 0
    learned = [lexicon(sampled.filter(half)), lexicon(sampled.filter(~half))]
    parts = [with_features(sampled.filter(~half), key, "text", learned[0], ["label"]), with_features(sampled.filter(half), key, "text", learned[1], ["label"])]
    table = stored(parts[0].unionByName(parts[1]).withColumn("x", array_to_vector("x")), "toxicity_features")
    last = F.pmod(F.xxhash64(F.lit("last"), key), F.lit(5)) == 0
    train, rest = table.filter(~last), table.filter(last)
    kinds = train.agg(F.sum("label"), F.sum(1 - F.col("label")), F.avg("label")).first()
    if not kinds[0] or not kinds[1]:
        return Model(learned[0], constant=float(kinds[2] or 0.0))
    trees = GBTClassifier(featuresCol="x", labelCol="label", maxIter=20, maxDepth=3, stepSize=0.3, minInstancesPerNode=2, seed=7).fit(train)
    # where the fifth lacks a kind, the calibration sees the whole sample
    seen = rest.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    calibrated = trees.transform(rest if seen[0] and seen[1] else table)
    # one weighted row for each probability, of which a forest has few
    steps = calibrated.groupBy(vector_to_array("probability")[1].alias("p")).agg(F.avg("label").alias("label"), F.count(F.lit(1)).cast("double").alias("n"))
    isotonic = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="n", predictionCol="score").fit(steps)
    return Model(lexicon(sampled), trees, isotonic.setFeaturesCol("probability").setFeatureIndex(1))


def score(docs: DataFrame, labels: DataFrame, rows: int = ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; rows with remainder 0 are never learned from."""
    model = fit(docs, labels, labelled.remainder("doc_id", FOLDS) != HELD_OUT, rows)
    out = model.scores(docs)
    held = F.coalesce(labelled.remainder("doc_id", FOLDS) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
