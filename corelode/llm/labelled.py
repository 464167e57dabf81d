"""Bounded labelled samples for classifiers, and the held-out fifth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, bound: int, longest: int) -> DataFrame:
    """At most ``bound`` labelled documents outside the held-out fifth: (doc_id, text, label).

    Ids are taken in the order of a hash, so any size of table gives the same
    kind of sample. The ids, not the texts, are sampled and sent to the tasks.
    Texts over ``longest`` bytes are left out of the sample (not out of scoring).
    Conflicting labels of one id count as their maximum; null labels and ids do not count.
    """
    ids = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound))
    texts = docs.select("doc_id", "text").filter(F.octet_length("text") <= longest)
    return texts.join(F.broadcast(ids), "doc_id")
