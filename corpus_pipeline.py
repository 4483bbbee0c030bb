"""A training corpus from documents, stage by stage.

Quality rules, one document of each group of near copies, personal data masked, sources mixed to their weights, packed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from latewing.llm import jaccard, mixing, packing, pii, quality, shared
from latewing.session import ship


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and the compression bands."""
    ship(spark)
    return quality.keep_good(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of five-word shingles at similarity 0.8 or more join."""
    ship(spark)
    return jaccard.keep_one(docs, shared.shared_folder(spark), width=5, similarity=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked by its kind."""
    ship(spark)
    return pii.mask_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them, repeats as rows of their own."""
    ship(spark)
    return mixing.mixed_documents(docs, shared.shared_folder(spark))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their place in sequences of 4096 tokens."""
    ship(spark)
    return packing.pack_documents(docs, shared.shared_folder(spark))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and reread in the shared folder."""
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    folder = shared.shared_folder(spark)
    for i, (name, stage) in enumerate(STAGES):
        docs = shared.stored(stage(spark, docs, sf_dir), folder, f"{i}-{name}")
    return docs


#: SQL has no tokenizers, compression or expectation-maximisation; tests/llm/test_pipeline.py follows every stage by brute
#: force where its outcome is determined, and by its invariants where a model decides.
ORACLE_SQL = None

QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
