"""Exact deduplication by content hash, with byte comparison inside a hash."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import id_and_text


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per row of ``docs``: its group of equal texts and whether it stays.

    Rows are grouped by a 128-bit hash and, inside a hash, by the bytes of the
    text itself, so a collision makes two groups. Copies merge before the
    shuffle; afterwards only ids and hashes travel, and a hash of many rows is an
    ordinary skewed join that Spark splits. ``keep`` names the row that stays:
    the ``smallest`` or ``largest`` id.

    Null and empty texts are equal. Ids that are null lose against any id; a
    group without any id has ``keep_id`` null and all its rows stay. Rows equal
    in id and text are one document given twice: they share the decision. Empty
    tables give no rows; other columns are not carried.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = id_and_text(docs, id_col, text_col).select(
        "doc_id", "text", content_hash(F.col("text")).alias("h"), F.sha2("text", 256).alias("text_sha256"))
    texts = rows.groupBy("h", "text_sha256", "text").agg(best("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    # Two texts under one h and one SHA-256 could not be told apart by the join below: stop rather than merge.
    unique = F.when(F.count("*") > 1, F.raise_error(F.lit("two texts share both hashes")).cast("long")).otherwise(F.min("keep_id"))
    groups = texts.groupBy("h", "text_sha256").agg(unique.alias("keep_id"), F.min("group_size").alias("group_size"))
    joined = rows.drop("text").join(groups, ["h", "text_sha256"])
    return joined.select(
        "doc_id", "keep_id", "group_size", F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull()).alias("kept"), "text_sha256")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """``docs`` without the rows that lose in :func:`exact_groups`; all columns stay."""
    lost = (
        exact_groups(docs, id_col, text_col, keep).filter(~F.col("kept")).select(F.col("doc_id").alias("lost_id"), F.col("text_sha256").alias("lost_text")).distinct())
    text = F.sha2(F.coalesce(docs[text_col], F.lit("")), 256)
    return docs.join(lost, docs[id_col].eqNullSafe(lost["lost_id"]) & (text == lost["lost_text"]), "left_anti")
