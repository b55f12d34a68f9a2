"""A corpus pipeline of five stages over ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marquee.llm import jaccard, mixing, packing, rules, suffixes
from marquee.llm.common import cut_lineage, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the current policy of the rule ledger rejects go."""
    return rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by word 5-grams at 0.8 the one with the smallest id stays."""
    return jaccard.representatives(docs, n=5, least=80)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words under a passage of over 50 words, and bytes under a string of 400, that occur twice go; a document of which no word is left goes."""
    return suffixes.cleaned(docs, (suffixes.WORDS, suffixes.BYTES))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.resampled(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", near_duplicates),
    ("suffix-array dedup", repeated_passages),
    ("mixing to target weights", source_mix),
    ("best-fit packing", sequences),
]
#: Components of links, byte spans and token ids have no SQL form; tests/llm compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = cut_lineage(docs, f"pipeline-{i}")
    return docs
