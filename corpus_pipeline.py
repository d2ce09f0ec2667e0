"""A training-data pipeline over ``documents``: five stages, each an operator of ``folio.llm`` on what the one before kept.

Every stage is written as Parquet to the shared folder and read again, so a lost executor costs one stage at most; what a
stage kept for itself is deleted after it. All but the last stage return the columns of ``documents``, extra ones too,
whatever their names. Null and empty texts have no words and go at the first stage, as do texts of under 50 words; repeated
rows and rows of one doc_id meet in the second, where one stays; ties fall to the smaller doc_id. Texts may have any
length. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folio.llm import line_cleaning, mixing, packing, simhash_dedup, suffix_dedup
from folio.llm.common import drop, keep, own_tables, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, then documents that fail or lost too much."""
    return line_cleaning.clean_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest doc_id."""
    return simhash_dedup.one_of_each(docs)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of 200 bytes that occur twice go from all texts; every document stays, even if nothing of its text does."""
    return suffix_dedup.cleaned_documents(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not, once or twice."""
    return mixing.mixed_documents(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("source_mix", source_mix),
    ("sequences", sequences),
]

#: SimHash needs XXH64 and transitive links, so SQL can't express the whole; tests hold it against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        with own_tables() as wanted:
            docs = keep(stage(spark, docs, sf_dir), name)
            wanted.append(docs)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
