"""One registered query per operator, and check SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prosegauge.llm import (
    collocations,
    decontaminate,
    jaccard,
    mixing,
    neighbours,
    quality,
    ranking,
    shards,
    substrings,
    token_counts,
    token_ids,
    toxicity,
    warc,
)
from prosegauge.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, Callable[[], str]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest of every fiftieth vector among all vectors."""
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


@query
def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_rows(table(spark, sf_dir, "documents"))


@query
def op3_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(table(spark, sf_dir, "documents"))


@query
def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of similar documents."""
    return jaccard.joined(table(spark, sf_dir, "documents")).drop("text_hash")


@query
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item."""
    return decontaminate.leaking(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.deduplicated(table(spark, sf_dir, "documents"))


@query
def op9_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.written_ids(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


ORACLES["op2_mixing"] = mixing.sql
ORACLES["op6_decontaminate"] = lambda: decontaminate.SQL


@query
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2000 phrases of each language."""
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_collocations"] = lambda: collocations.SQL


@query
def op12_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best documents for every benchmark item."""
    return ranking.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op12_ranking"] = lambda: ranking.SQL


@query
def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written to archives and read back."""
    return warc.archived(table(spark, sf_dir, "pages"))


ORACLES["op13_warc"] = lambda: warc.SQL
