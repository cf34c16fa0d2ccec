"""From raw documents to packed sequences: toxicity, language, near duplicates, packing.

Each stage works on all that the one before kept and returns the columns of documents, also further
ones of any name; the last returns the packed pieces. What a stage returns is written to the shared
folder and read again before the next, so a lost executor costs one stage's tasks at most.

Null ids are kept, as far as their texts are; null texts and texts without a letter go in the
language stage. Texts are read whole, however long. Of repeated rows, as of near copies, one stays;
ties are broken by id, text and the other columns. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessel.llm import langid, packing, simhash, toxicity
from tessel.llm.common import shipped, stored, table
from tessel.llm.registry import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score below the classifier's cut; it learns from the labels of ``sf_dir``. All
    rows stay if the labels hold fewer than two classes."""
    shipped(spark)
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def drop_foreign(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text has letters and is near enough to a centroid of some language of the
    documents that came in; null texts and texts without a letter go."""
    shipped(spark)
    return langid.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts whose sets of five-word shingles are alike by 0.8 or more,
    that with the smallest doc_id; of rows without an id one, if none of the group has an id."""
    shipped(spark)
    return simhash.representatives(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, with their sequence and place."""
    shipped(spark)
    return packing.packed_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("language", drop_foreign), ("near_copies", drop_near_copies), ("packing", pack)]

#: Classifiers, fingerprints and tokens can't be expressed in SQL; tests use a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
