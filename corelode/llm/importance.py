"""Importance resampling towards a target distribution: array-scored weights, bisected cutoff."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corelode.llm.common import LOWER, id_and_text, stretches, texts_of
from corelode.operators.ordered import running_totals
from corelode.session import keep

BUCKETS = 10_000
SEED = 2024
LEAST_WORDS = 20
PERCENT = 10
# Words longer than this are hashed one by one, not a byte of all words at a time.
LONG_WORD = 32
# A search job counts the rows at or above so many cutoffs at once.
CUTOFFS = 63
# Words are runs of digits, a-z (after lower-casing A-Z) and bytes beyond ASCII.
_WORD = np.zeros(256, dtype=bool)
_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def _crc_table() -> np.ndarray:
    """The change of a CRC-32 (reflected polynomial EDB88320) by each byte value."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, np.uint32(0xEDB88320) ^ (table >> np.uint32(1)), table >> np.uint32(1))
    return table


_CRC = _crc_table()


def word_crcs(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(CRC-32, begin) of the words of lower-cased ``joined``, a byte of all words at a time."""
    data = np.frombuffer(joined, dtype=np.uint8)
    edge = np.diff(_WORD[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    lengths = end - begin
    by_length = np.argsort(-np.minimum(lengths, LONG_WORD + 1), kind="stable")
    start, sizes = begin[by_length], lengths[by_length]
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    for j in range(min(LONG_WORD, int(sizes[0])) if len(sizes) else 0):
        n = int(np.searchsorted(-np.minimum(sizes, LONG_WORD + 1), -j, side="left"))  # words of more than j bytes
        crc[:n] = _CRC[(crc[:n] ^ data[start[:n] + j]) & np.uint32(255)] ^ (crc[:n] >> np.uint32(8))
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(-np.minimum(sizes, LONG_WORD + 1), -LONG_WORD, side="left"))):
        crc[i] = zlib.crc32(joined[start[i] : start[i] + sizes[i]])
    out = np.empty_like(crc)
    out[by_length] = crc
    return out, begin


def buckets_of(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of every word; a long text comes in several stretches."""
    if len(texts) == 1:
        for part in stretches(texts[0], _GAP):
            crc, _ = word_crcs(part.translate(LOWER))
            yield np.zeros(len(crc), dtype=np.int64), (crc % np.uint32(BUCKETS)).astype(np.int64)
        return
    crc, begin = word_crcs(b" ".join(texts).translate(LOWER))
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    yield np.searchsorted(bounds, begin, side="right") - 1, (crc % np.uint32(BUCKETS)).astype(np.int64)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """How many words of ``texts`` (column text) each bucket has: a sum per task and bucket, BUCKETS rows to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(BUCKETS, dtype=np.int64)
        for batch in batches:
            for _, run_of in texts_of(batch.column("text")):
                for _, bucket in buckets_of(run_of):
                    seen += np.bincount(bucket, minlength=BUCKETS)
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], names=["bucket", "n"])

    summed = texts.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BUCKETS, dtype=np.int64)
    counts[summed["bucket"].to_numpy(np.int64)] = summed["n"].to_numpy(np.int64)
    return counts


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket floor(1000 ln) of the smoothed target rate over the smoothed corpus rate."""
    t, s = target.astype(float) + 1, corpus.astype(float) + 1
    return np.floor(1000 * np.log(t * (corpus.sum() + BUCKETS) / (s * (target.sum() + BUCKETS)))).astype(np.int64)


def weighed(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_features, weight) of every row of ``docs`` (doc_id, text): array look-ups, no shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch.column("text")):
                n, weight = np.zeros(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.int64)
                for owner, bucket in buckets_of(texts):
                    n += np.bincount(owner, minlength=len(texts))
                    weight += np.bincount(owner, weights=gain[bucket], minlength=len(texts)).astype(np.int64)  # whole numbers below 2^53
                ids = batch.column("doc_id").slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(weight)], names=["doc_id", "n_features", "weight"])

    return docs.mapInArrow(run, "doc_id long, n_features long, weight long")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 g) of a Gumbel variate from the id's hash; a null id counts as an empty one."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8)
    uniform = (F.conv(digits, 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000.0 * F.log(-F.log(uniform))).cast("long")


def _counts_from(rows: DataFrame, value: Column, cuts: list[int]) -> list[int]:
    """Exact numbers of rows with ``value`` >= each cut, in one job."""
    return list(rows.agg(*[F.count_if(value >= c).alias(f"n{i}") for i, c in enumerate(cuts)]).first())


def greatest_cut(rows: DataFrame, value: Column, wanted: int) -> int | None:
    """The greatest number with at least ``wanted`` rows whose ``value`` reaches it (None if there are fewer rows).

    Each job counts the rows at CUTOFFS places between two bounds and keeps the
    step in which the count passes ``wanted``: six bits a job, over all rows.
    """
    low, high, n = rows.agg(F.min(value), F.max(value), F.count(value)).first()
    if wanted <= 0 or n < wanted:
        return None
    while low < high:  # at least `wanted` rows reach low, and the cut is at most high
        step = -(-(high - low) // (CUTOFFS + 1))
        cuts = list(range(low + step, high + 1, step))
        reached = [c for c, k in zip(cuts, _counts_from(rows, value, cuts)) if k >= wanted]
        best = reached[-1] if reached else low
        low, high = best, min(high, best + step - 1)
    return low


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text",
    percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED,
) -> DataFrame:
    """``percent`` of the documents with ``least_words`` words, drawn in proportion to their likeness to ``target``.

    1. Words of all documents and of all target texts are counted by bucket;
       the log ratio of the two rates is a bucket's gain.
    2. A document's weight is the sum of its words' gains, looked up in an array
       of BUCKETS numbers; with Gumbel noise from its id it is the score, whose
       highest values are a draw without replacement. Scores are written once.
    3. The cutoff is found by counting (:func:`greatest_cut`): a score, then,
       among rows of that score, an id. Nothing is sorted for it.
    4. Rows at or above the cutoff are range-partitioned by rank order and
       numbered from the sizes of the parts.

    Null and empty texts have no features and are not drawn. A null id counts as
    an empty one, after all others of its score. Rows of one id are drawn each
    for itself; equal rows take ranks in any order among them. Empty tables give
    no rows, an empty target gives gains all the same; other columns are not carried.

    Returns doc_id, n_features, weight, score, rank.
    """
    texts = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    wanted = target.select(F.coalesce(F.col(target_text_col), F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts), bucket_counts(wanted))
    scored = weighed(texts, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = keep(scored.withColumn("row", F.monotonically_increasing_id()))  # written once: the number stays with its row
    able = scored.filter(F.col("n_features") >= least_words)
    draw = able.count() * percent // 100
    cut = greatest_cut(able, F.col("score"), draw)
    if cut is None:
        return scored.select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    tied = able.filter(F.col("score") == cut)
    from_ties = draw - able.filter(F.col("score") > cut).count()
    # The smallest ids: the greatest of the bitwise complements, which order all ids backwards. Null ids come last.
    last = greatest_cut(tied.filter("doc_id IS NOT NULL"), F.bitwise_not("doc_id"), from_ties) if from_ties else None
    among = F.lit(True) if last is None else F.coalesce(F.bitwise_not("doc_id") >= last, F.lit(False))
    chosen = F.coalesce((F.col("n_features") >= least_words) & ((F.col("score") > cut) | ((F.col("score") == cut) & among)), F.lit(False))
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    parts = keep(scored.filter(chosen).repartitionByRange(*order).withColumn("part", F.spark_partition_id()))
    return _numbered(parts, order, draw).unionByName(
        scored.filter(~chosen).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank")))


def _numbered(parts: DataFrame, order: list[Column], draw: int) -> DataFrame:
    """Ranks 1, 2, 3 ... across range parts; equal (score, id) beyond the draw get none."""
    sizes = running_totals(parts.groupBy("part").agg(F.count("*").alias("size")), [], ["part"], {"upto": F.col("size")})
    before = sizes.select(F.col("part").alias("p"), (F.col("upto") - F.col("size")).alias("before"))
    placed = parts.withColumn("place", F.row_number().over(Window.partitionBy("part").orderBy(*order))).join(before, F.col("part") == F.col("p"))
    rank = (F.col("before") + F.col("place")).cast("long")
    return placed.select("doc_id", "n_features", "weight", "score", F.when(rank <= draw, rank).alias("rank"))
