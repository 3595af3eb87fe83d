"""Stages from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), where docs are what its predecessor kept, and returns a DataFrame; ``run`` writes
each result as Parquet to the shared folder and reads it again as the next stage's docs.  All stages but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tablescope.llm import jaccard, language, mixing, packing, secrets
from tablescope.llm.common import documents, prepared, stored


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays in doubt, go; the model is fitted on the docs' own labels."""
    prepared(spark)
    return language.in_known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles and a similarity of 0.8, the smallest doc_id stays."""
    prepared(spark)
    return jaccard.one_of_each(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; every document stays."""
    prepared(spark)
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: documents come once or twice, whole or with the words the mix takes."""
    prepared(spark)
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of 2048 tokens."""
    prepared(spark)
    return packing.packed_pieces(docs)


STAGES = [
    ("language ID", language_id),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", source_mix),
    ("best-fit packing", best_fit_packing),
]

#: Language models, permutations and packing are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
