"""A training corpus from documents: reject, identify, deduplicate, mix, pack.

Each stage takes the documents its predecessor kept; all but the last return the columns of
`documents`. run() writes every stage to the shared folder and rereads it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.llm import language, mixing, near_dedup, packing, toxicity
from clickloom.llm.common import saved, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, fitted on the labelled ones among them.

    Null and empty texts are scored as texts without windows; without labels of both kinds all stay.
    """
    policy, score = toxicity.ToxicityPolicy(), unused(docs.columns, "_toxicity")
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"), policy)
    return toxicity.score_toxicity(docs, model, score).where(F.col(score) < policy.threshold).select(*docs.columns)


def drop_unknown_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language the model knows: not `und`, like that language, and not less sure than the policy's score.

    Null texts, texts without a letter, and all texts where no language is labelled go.
    """
    policy, column = language.LanguagePolicy(), unused(docs.columns, "_language")
    found = language.identify_language(docs, language.fitted(docs, policy), column=column)
    said = F.col(column)
    return found.where((said["lang_pred"] != "und") & said["known"] & (said["score"] >= policy.min_score)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates; null texts are empty texts, so copies of each other."""
    return near_dedup.without_near_duplicates(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of 2048 tokens."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language", drop_unknown_language),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix),
    ("packing", pack),
]

#: Compression lengths and tokenizers aren't SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the documents of a data directory."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
