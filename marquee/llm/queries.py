"""The registered queries of this package, each over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, conversations, extract, fim, jaccard, mixing, neighbours, packing, quality, rules, sharding, suffixes, toxicity
from .common import table

SHARDS = 40


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.repeats(table(spark, sf_dir, "documents")))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.linked(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = rules.ledger(table(spark, sf_dir, "documents"))
    base, kept = rules.passes(rules.BASE), rules.passes(rules.CURRENT)
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~base).alias("base_failed"), (base & kept).alias("kept"), "failures",
    )


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.severity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transformed(table(spark, sf_dir, "documents")))


def op12_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    vocab = bpe.vocabulary(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return bpe.digest(bpe.encoded(table(spark, sf_dir, "documents"), vocab), vocab)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.digest(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_best_fit_packing, op3_ngram_jaccard, op4_quality_rules, op5_toxicity, op6_sharding, op7_quality_classifier, op8_nearest_neighbours, op9_source_mixing, op10_html_extraction, op11_fill_in_middle, op12_byte_level_bpe, op13_conversation_repair)}

ORACLE = {
    "op11_fill_in_middle": fim.DIGEST_SQL,
    "op13_conversation_repair": conversations.DIGEST_SQL,
    "op4_quality_rules": "WITH " + rules.LEDGER_CTES.format(src="documents") + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & {rules.BASE.mask}) <> 0 AS base_failed,
  (failures & {rules.CURRENT.mask}) = 0 AS kept, failures FROM ({rules.LEDGER_SQL})
""",
    "op9_source_mixing": "WITH " + mixing.MIXED_CTES.format(src="documents") + "SELECT doc_id, size, source_size, target, taken FROM mixed",
}
