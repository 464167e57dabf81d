"""Benchmark items inside documents: size-partitioned MinHash containment, exact verification."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import LOWER, SHINGLE_WORDS, id_and_text, shingle_sets, texts_of

# Percent of an item's shingles that a document must hold.
CONTAINMENT = 75
# Bytes of item text that one scan of the documents takes with it to every task.
BLOCK_BYTES = 16 << 20


def needed(size: int) -> int:
    """Shared shingles that make a containment of an item of ``size`` shingles."""
    return -(-size * CONTAINMENT // 100)


@dataclass(frozen=True)
class Index:
    """Items of one block: their texts and the MinHash values that lead to them.

    Items are partitioned by size into powers of two. All items of a partition
    keep the same number of least fingerprints, enough for its largest: a
    document with 75 percent of an item's shingles lacks at most a quarter of
    them, so it holds at least one of the least quarter and one more.
    """

    ids: list
    texts: list[bytes]
    sizes: np.ndarray
    values: np.ndarray  # sorted MinHash values
    items: np.ndarray  # the item of each value

    @staticmethod
    def of(rows: list[tuple[object, str]]) -> Index:
        texts = [text.encode() for _, text in rows]
        sets = list(shingle_sets(texts))
        sizes = np.array([len(s) for s in sets], dtype=np.int64)
        kept = []
        for s in sets:
            largest = (1 << len(s).bit_length()) - 1
            kept.append(s[: largest - needed(largest) + 1])
        values = np.concatenate([*kept, np.empty(0, np.int64)])
        items = np.repeat(np.arange(len(rows)), [len(k) for k in kept])
        order = np.argsort(values, kind="stable")
        return Index([i for i, _ in rows], texts, sizes, values[order], items[order])

    def candidates(self, shingles: np.ndarray) -> np.ndarray:
        """Items of which a document with these fingerprints holds a MinHash value and that are small enough."""
        low = np.searchsorted(self.values, shingles, side="left")
        hit = np.flatnonzero(low < len(self.values))
        hit = hit[self.values[low[hit]] == shingles[hit]]
        if not len(hit):
            return hit
        high = np.searchsorted(self.values, shingles[hit], side="right")
        found = np.unique(np.concatenate([self.items[a:b] for a, b in zip(low[hit], high)]))
        return found[self.sizes[found] * CONTAINMENT <= 100 * len(shingles)]


def word_shingles(text: bytes) -> set[tuple[bytes, ...]]:
    words = text.translate(LOWER).split()
    if len(words) < SHINGLE_WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(SHINGLE_WORDS))))


def _held(index: Index, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
    """(row, item, shared shingles) of the items that texts contain, verified on the words themselves."""
    for row, (text, shingles) in enumerate(zip(texts, shingle_sets(texts))):
        found = index.candidates(shingles)
        own = word_shingles(text) if len(found) else set()
        for item in found:
            shared = len(own & word_shingles(index.texts[item]))
            if shared * 100 >= int(index.sizes[item]) * CONTAINMENT:
                yield row, int(item), shared


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[Index]:
    """The distinct items, a bounded part at a time."""
    rows = id_and_text(items, id_col, text_col).distinct()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = total // BLOCK_BYTES * 2 + 1  # halves, so that an uneven share still fits
    for i in range(n if total else 0):
        part = rows.filter(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)) == i)
        yield Index.of([(r["doc_id"], r["text"]) for r in part.collect()])


def _pairs_in(index: Index) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch.column("text")):
                rows = list(_held(index, texts))
                ids = batch.column("doc_id").take(pa.array([start + r for r, _, _ in rows], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([
                    ids, pa.array([index.ids[i] for _, i, _ in rows], type=pa.int64()),
                    pa.array([int(index.sizes[i]) for _, i, _ in rows], type=pa.int64()), pa.array([s for *_, s in rows], type=pa.int64()),
                ], names=["doc_id", "item_id", "item_shingles", "shared_shingles"])

    return run


def contained_items(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs of a document and a benchmark item of which it holds 75 percent of the five-word shingles.

    The items, a stated query set, go to the tasks in blocks of bounded size;
    each block is one pass over the documents without a shuffle. A document is
    probed with all its shingles, however long it is, and candidates are
    verified on their words in the same task.

    Words are runs without white space, A-Z as a-z; fewer than five words are one
    shingle. Null and empty texts hold nothing and items without words are never
    held. Repeated documents give repeated rows, repeated items one; ids may be
    null. Empty tables give no rows; other columns are not carried.

    Returns doc_id, item_id, item_shingles, shared_shingles.
    """
    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    schema = "doc_id long, item_id long, item_shingles long, shared_shingles long"
    parts = [rows.mapInArrow(_pairs_in(index), schema) for index in _blocks(items, item_id, item_text)]
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], schema)
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _without_held(index: Index, text_col: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stays = np.ones(batch.num_rows, dtype=bool)
            for start, texts in texts_of(batch.column(batch.schema.get_field_index(text_col))):
                stays[[start + row for row, _, _ in _held(index, texts)]] = False
            yield batch.filter(pa.array(stays))

    return run


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows that hold an item as in :func:`contained_items`."""
    for index in _blocks(items, item_id, item_text):
        docs = docs.mapInArrow(_without_held(index, text_col), docs.schema)
    return docs
