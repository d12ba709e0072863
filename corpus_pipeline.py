"""The corpus pipeline: stages over ``documents``, each written and read again.

Every stage returns the columns of ``documents`` (the last one token ids), takes an
empty table for an empty one, works on whole texts however long, judges repeated
rows each by itself and passes other columns through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clausework.llm import bpe, decontaminate, jaccard, language, pii
from clausework.llm.common import cut, spent, table
from clausework.llm.queries import word_bpe


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language evidence accepts none go.

    A null or empty text, or one without letters, is not accepted whatever its declared language; a null doc_id,
    language or source is a value like any other; of languages with equal posteriors the first by code counts.
    """
    return language.drop_unidentified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates the smallest doc_id stays.

    Null and empty texts are near nothing and stay, as does a row without doc_id; rows that share a doc_id stay or go together.
    """
    return jaccard.drop_near_duplicates(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark windows in a twentieth of their words go.

    Each row by its own text, also where doc_ids repeat or are null; a null text has no words and stays; an empty benchmark removes nothing.
    """
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars follows the text, null for a null text."""
    columns = docs.columns
    changed = pii.pseudonymise(docs, pii.key_of(spark))
    if "n_chars" in columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is kept, as token ids; a null text has none."""
    return bpe.encode_documents(docs, word_bpe(), with_ids=True)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", pseudonymise),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each on what its predecessor wrote."""
    docs = table(spark, sf_dir, "documents")
    last: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
        spent(*last)  # what the stage before has written is read by nothing now
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)


ORACLE_SQL = None  # language models and a BPE are not SQL; tests compare with plain Python
