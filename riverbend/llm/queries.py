"""The queries and oracle SQL of the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riverbend.llm import ann, decontam, langid, linededup, mixing, neardup, oracles, quality, tokens, urls, warc
from riverbend.llm.shared import table

WORD_BPE = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_BPE) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.train(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's class id (the smallest doc_id of its class) and links, the spanning links found at its text.

    Pairs that are in one class already are not compared, so links is no count of like texts and depends on hashes and rounds.
    """
    return neardup.classes(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.allocation(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines, dropped lines, and the SHA-256 of the text that is left."""
    found = linededup.drop_recurring(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("text_sha256"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match")


def url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What op1 says by rule alone: every page's host and path, the rule that fits and its verdict."""
    found = urls.judge(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("ruled"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sizes and targets of op7's mix, which its thresholds have to meet."""
    found = mixing.allocation(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"))


QUERIES = {
    f.__name__: f
    for f in (op1_url_filter, op2_language_id, op3_nearest_neighbours, op4_token_files, op5_near_dedup, op6_warc, op7_mixing, op8_quality, op9_line_dedup, op10_decontaminate, url_rules, mix_targets)
}

ORACLE_SQL: dict[str, str] = oracles.ORACLE_SQL
