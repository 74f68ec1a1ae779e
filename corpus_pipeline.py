"""A training corpus from raw documents: quality rules, near-duplicates, personal data, mixing, packing.

Each stage reads what the one before wrote. A document that the quality rules reject goes; of each class of
near-duplicates one document stays; personal data is replaced by its kind; sources are taken as often as their
targets ask, a row for each time; what is left is packed into sequences.

Defined results, of every stage: a null or blank text has no words, so the first stage rejects it; where a later stage is
given one, it is a document like any other, null texts stay null, and the last stage packs the end id alone. Null ids and
repeated ids are borne: rows are told apart by themselves, never by their ids; of a class of near-duplicates without any
id one row stays too. A null source is a source of its own. Repeated rows are near-duplicates of each other; an empty
table gives no rows; further columns, whatever their names, are kept by all stages but the last, which reads none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitrine.llm import mixing, packing, pii, quality, simhash
from vitrine.llm.common import table, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the current policy keeps."""
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class, with or without an id."""
    return simhash.keep_one(docs, unnamed=True)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced in their texts."""
    return pii.redact(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document."""
    return packing.pack_documents(docs, with_ids=False)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither fingerprints nor the field nor the tokenizer; tests/llm holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
