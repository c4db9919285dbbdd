"""From documents to token ids: stages that each take what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import decontaminate, jaccard, mixing, quality, token_ids
from prosegauge.llm.shared import written
from prosegauge.sources.tables import table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is good with a probability of 0.7 or more."""
    labels = table(spark, sf_dir, "labels")
    scored = quality.score(docs, quality.fit(docs, labels, "quality", F.lit(True)), "_score")
    return scored.filter(F.col("_score") >= 0.7).select(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of similar ones."""
    return jaccard.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows that the production mix takes, each as often as it is taken."""
    return mixing.mixed(docs, mixing.PRODUCTION)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all rows, written to files and read back: doc_id, start, n_tokens, ids_crc32."""
    return token_ids.written_ids(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality", quality_classifier),
    ("jaccard", jaccard_join),
    ("decontamination", decontamination),
    ("mixing", source_mixing),
    ("token_ids", token_output),
]

#: A classifier is fitted and a tokenizer runs, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over the whole table of documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
