"""A corpus pipeline: quality, toxicity, near duplicates, source mix and packing, each on all that the last one kept.

Every stage reads the columns of ``documents`` and all but the last return them; each is written as Parquet in the
shared folder and read again.

Defined cases: null or empty texts are rejected by the first stage; very long texts are read whole and cut in pieces by
the last stage only; of rows that repeat a text, or an id and a text, one stays after the third stage, and of a tie the
least id (null ids last); different texts under null or equal ids are kept; null sources are one source; columns named as
those of a stage pass through; an empty table goes through as one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from episodica.llm import common, mixing, ngram_join, packing, quality, toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps."""
    return quality.keep_good(docs)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, trained on ``labels``, leaves alone."""
    return toxicity.keep_clean(docs, common.read(spark, sf_dir, "labels"))


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: the one of least id."""
    return ngram_join.one_of_each(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of their sources takes them."""
    return mixing.mix_sources(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the mix in sequences; a document taken twice has its pieces twice."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_classifier", good_quality),
    ("toxicity", not_toxic),
    ("ngram_jaccard_join", one_of_near_duplicates),
    ("source_mix", mixed_sources),
    ("best_fit_packing", packed),
]

#: The models, the near-duplicate classes and the tokenizer are beyond SQL; tests hold each stage to a brute-force form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
