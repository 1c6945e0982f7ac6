"""A corpus-cleaning pipeline of five of the operators; each stage's result is written and read again.

Texts without letters or in no learned language go; one document of each near-duplicate group stays; documents
contaminated by the benchmark go; personal data and the terms that give it away are replaced; what is left is
tokenised and packed.  The last stage returns the packed pieces, the others documents with all their columns.

Defined cases: null, empty and letterless texts go at the first stage, so later stages see none; rows with null ids are
judged by their texts and never taken for copies; rows with one id are one document to the near duplicates, which go
together, and documents of their own to the other stages; very long texts are read whole; a benchmark without
items takes nothing out; empty tables give empty results; columns of any other names are carried along.
"""

from __future__ import annotations

from collections.abc import Callable

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession

from quarrystone.llm import decontaminate, language, minhash, packing, pii
from quarrystone.llm.base import table, written

#: A document whose predicted language has a lower score is in none of the learned ones.
LANGUAGE_SCORE = 0.2


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language.known_language(docs, language.fit(language.training_rows(docs)), LANGUAGE_SCORE)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, tokenizer_path(packing.TOKENIZER))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The stages fit a model and pack sequences, which SQL can't express; a test holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
