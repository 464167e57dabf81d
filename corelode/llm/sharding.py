"""Shards by a permutation-filled lookup table."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHARDS = 64
# A prime of about 64 slots a shard: shares differ by one slot at most.
SLOTS = 4099
# Tables of more slots are refused: the table goes to every task.
MOST_SLOTS = 1 << 20


def _digest(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int = SHARDS, slots: int = SLOTS) -> list[int]:
    """The shard of each slot.

    Shards take turns; each claims the next free slot of its own permutation of
    the slots (a start and a stride from hashes of its number). Adding or
    removing a shard moves few slots beyond its own share.
    """
    if not 0 < shards <= slots <= MOST_SLOTS:
        raise ValueError(f"0 < shards <= slots <= {MOST_SLOTS} must hold")
    if any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"{slots} slots are not a prime number: a stride might miss some")
    at = [_digest(f"start {s}") % slots for s in range(shards)]
    stride = [_digest(f"stride {s}") % (slots - 1) + 1 if slots > 1 else 0 for s in range(shards)]
    owner, free = [-1] * slots, slots
    while True:
        for shard in range(shards):
            while owner[at[shard]] >= 0:
                at[shard] = (at[shard] + stride[shard]) % slots
            owner[at[shard]] = shard
            free -= 1
            if not free:
                return owner


def slot_of(key: Column, slots: int) -> Column:
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long") % slots


def with_shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, all columns, with ``slot`` and ``shard`` (columns of these names are replaced).

    The key is the id as text, and for a null id the text itself (null: empty),
    so that rows without an id spread too. Equal rows share a shard. One map
    over the rows: the table of at most MOST_SLOTS rows is broadcast. Empty
    tables give no rows.
    """
    owners = F.split(F.lit(",".join(map(str, lookup_table(shards, slots)))), ",")
    table = docs.sparkSession.range(1).select(F.posexplode(owners).alias("slot", "shard")).select(F.col("slot").cast("long"), F.col("shard").cast("int"))
    key = F.coalesce(F.col(id_col).cast("string"), F.col(text_col), F.lit("")).cast("binary")
    named = docs.select(F.struct(*docs.columns).alias("row"), slot_of(key, slots).alias("slot"))
    others = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("slot", "shard")]
    return named.join(F.broadcast(table), "slot").select(*others, "slot", "shard")


def write_shards(docs: DataFrame, path: str, files: int = 8, **options) -> None:
    """Write ``docs`` as Parquet, a folder for each shard, each shard through ``files`` tasks."""
    placed = with_shard(docs, **options)
    placed.withColumn("part", F.col("slot") % files).repartition("shard", "part").drop("part").write.partitionBy("shard").parquet(path)
