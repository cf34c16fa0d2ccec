"""The labelled rows that classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remainder, text_of


def hashed_share(key, salt: int = 0):
    """A number from 0 to 1 for each key."""
    return F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 31) - 1)) / F.lit(float(1 << 31))


def training_rows(documents: DataFrame, labels: DataFrame, label: str, bound: int, rest: int = 0, divisor: int = 5) -> DataFrame:
    """(doc_id, text, y, fold) of at most ``bound`` labelled documents whose crc32 remainder
    isn't ``rest``: all, or a share drawn by a hash of doc_id. ``fold``: 0 to 1 by another hash.

    Labels are drawn first, so that only their ids and marks are broadcast (``bound`` rows). An id
    may stand for many rows of ``documents``: of more rows than ``bound`` those whose id and text
    have the smallest hashes are taken, which each task sees to before the shuffle. Null ids and
    labels are left out; of repeated labels the largest counts; of equal rows either may be taken.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (remainder(F.col("doc_id"), divisor) != rest)).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = known.count()
    if n > bound:  # drawn a little low, so that the limit below hardly ever cuts
        known = known.filter(hashed_share("doc_id", 1) < 0.95 * bound / n)
    sample = F.broadcast(known.limit(bound))
    found = documents.select("doc_id", text_of(documents).alias("text")).join(sample, "doc_id").withColumn("fold", hashed_share("doc_id", 2))
    if found.count() > bound:  # ids and no texts are read for this
        found = found.orderBy(F.xxhash64("doc_id", "text")).limit(bound).repartition(-(-bound // 1000))
    return found
