"""The corpus pipeline: known languages, one of each near-duplicate class, no benchmark passages, no
secrets, packed sequences. Each stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm import decontaminate as decontamination
from tidegauge.llm import langid, near_dedup, packing, secrets
from tidegauge.llm.common import distilled, read_table, small_batches


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is one of the learned ones stay; a null text, and one without letters, has none
    and goes."""
    small_batches(spark)
    return langid.keep_known(docs, langid.train(langid.train_split(docs)))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays: the one with the least doc_id (a null one last); of rows
    with that id and text the least by all their columns."""
    small_batches(spark)
    return near_dedup.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of a benchmark item go; texts without words stay."""
    return decontamination.keep_clean(docs, read_table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked; every document stays, null texts too."""
    small_batches(spark)
    return secrets.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences; an empty or null text is one end token."""
    import public_tokenizers

    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", known_language),
    ("near_dedup", near_duplicates),
    ("decontaminate", without_benchmark),
    ("secret_scan", without_secrets),
    ("packing", packed),
]

#: Language scores, alignments and token ids have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's table; a stage's input, and what it wrote on the way, go once its output is whole."""

    def after(n: int) -> DataFrame:
        if n == 0:
            return read_table(spark, sf_dir, "documents")
        name, stage = STAGES[n - 1]
        return distilled(spark, lambda: stage(spark, after(n - 1), sf_dir), name)

    return after(len(STAGES))
