"""The registered queries of this package; each applies its operator to the whole table."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import crosstokens, fingerprints, linededup, multiindex, nbest, neighbours, packing, pages, quality, ranked, simhash, tokencount, toxicity
from ledgerlens.llm.tables import read, stored, tokenizer


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.against_edit(read(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = linededup.drop_frequent_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages"), ["page_id", "url"])


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.summary(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_edits(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multiindex.near_duplicates(read(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op13_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    aligned = crosstokens.align(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    kept = stored(aligned.select("doc_id", "n_a", "n_b", F.size("ends").cast("long").alias("n_groups"), digest, "pairs", "links"), "aligned")
    return crosstokens.agreement(kept).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_fingerprints": op1_fingerprints,
    "op2_line_dedup": op2_line_dedup,
    "op3_packing": op3_packing,
    "op4_simhash": op4_simhash,
    "op5_html": op5_html,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_token_counts": op7_token_counts,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_neighbours": op10_neighbours,
    "op11_vector_dedup": op11_vector_dedup,
    "op12_ranked_search": op12_ranked_search,
    "op13_cross_tokens": op13_cross_tokens,
}
