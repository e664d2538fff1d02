"""A training corpus from raw documents: good ones, one of each group of near-duplicates, clean, pseudonymous, packed.

Each stage takes what the one before it kept. Null and empty texts, repeated rows, null ids and columns named as results are
taken as the stages' operators say; an empty table gives an empty one. The first four return the columns of ``documents``, the last one the packed
pieces. Each stage's result is written to the shared folder and read again, so that a lost executor costs no more than
its stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cashplan.llm import decontamination, packing, pii, quality, simhash
from cashplan.llm.common import table
from cashplan.llm.queries import pii_key, tokenizer_path
from cashplan.session import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.accepted(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document of the smallest id stays."""
    return simhash.one_of_each(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark contaminates go."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pseudonymous(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data gets pseudonyms; ``n_chars`` follows the text."""
    changed = pii.pseudonymized(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 1,024."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each),
    ("benchmark decontamination", uncontaminated),
    ("pii pseudonyms", pseudonymous),
    ("best-fit packing", packed),
]

#: SQL has neither the classifier's model nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
