"""From raw documents to a training mixture, stage by stage.

Each stage reads what the one before has written. All but the last return the columns
of ``documents``; the last adds where each copy stands in the mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from capledger.llm.decontaminate import without_contaminated
from capledger.llm.mixing import mix_sources
from capledger.llm.order_minhash import without_near_duplicates
from capledger.llm.queries import MOST_REPETITIONS, SURROGATE_KEY, table
from capledger.llm.surrogates import replace_entities
from capledger.llm.toxicity import fit_toxicity, fold, with_toxicity
from capledger.sources.scratch import stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_SCORE = "__toxicity_score"


def drop_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents with a toxicity score below 0.5; learned from the labelled ones among them."""
    labels = table(spark, folder, "labels")
    model = fit_toxicity(docs, labels.where(fold("doc_id", 5) != 0))
    return with_toxicity(docs, model, score_col=_SCORE).where(F.col(_SCORE) < 0.5).drop(_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each near-duplicate class: that with the least id."""
    return without_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return without_contaminated(docs, table(spark, folder, "benchmark"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Entities replaced by surrogates; n_chars follows the new text."""
    replaced = replace_entities(docs, SURROGATE_KEY)
    return replaced.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else replaced


def mix(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The copies of documents that the weights of their sources call for."""
    return mix_sources(docs, repetitions=MOST_REPETITIONS)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("surrogates", replace_personal_data),
    ("mixing", mix),
]

#: Classifier, alignment and keyed hashes have no counterpart in SQL; tests compare small inputs with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, folder), name)
    return docs
