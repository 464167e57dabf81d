"""Helpers shared by the text operators."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ASCII capitals only; other letters keep their case.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE_WORDS = 5
# Bytes of text that one numpy pass handles; a longer text is a pass of its own.
PASS_BYTES = 1 << 19
ROWS_PER_PASS = 4096


def id_and_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id`` and ``text`` of ``df``; a null text is an empty one.

    Other columns go, so none of theirs can clash with an operator's own names.
    """
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    return F.translate(text, CAPITALS, CAPITALS.lower())


def texts_of(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The UTF-8 texts of an Arrow column in runs of about PASS_BYTES: (first row, texts).

    Only one run at a time exists as Python objects; null counts as empty.
    """
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    start = 0
    while start < len(sizes):
        rows = max(1, int(np.searchsorted(np.cumsum(sizes[start : start + ROWS_PER_PASS]), PASS_BYTES, side="right")))
        rows = min(rows, ROWS_PER_PASS, len(sizes) - start)
        yield start, [text or b"" for text in column.slice(start, rows).cast(pa.binary()).to_pylist()]
        start += rows


def stretches(text: bytes, gap: re.Pattern[bytes]) -> Iterator[bytes]:
    """A text in stretches of about PASS_BYTES, cut before a byte that ``gap`` finds (no word has one)."""
    start = 0
    while len(text) - start > 2 * PASS_BYTES:
        found = gap.search(text, start + PASS_BYTES)
        stop = found.start() if found else len(text)
        yield text[start:stop]
        start = stop
    yield text[start:] if start else text


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (shifts and odd multipliers)."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_BYTE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0xD1342543DE82EF95)
_LOWER = np.frombuffer(LOWER, dtype=np.uint8)


def _powers(n: int) -> np.ndarray:
    out = np.full(max(1, n), _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def word_codes(texts: list[bytes], words: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of several texts at once: (64-bit code, text index, begin, end, joined bytes).

    Words are runs without space, tab, line feed, vertical tab, form feed and
    carriage return; A-Z count as a-z.
    """
    joined = np.frombuffer(b" ".join([*texts, b""]), dtype=np.uint8)
    lower = _LOWER[joined]
    inside = ~_SPACE[lower]
    edge = np.diff(inside.view(np.int8), prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(bounds, begin, side="right") - 1
    if not words or not len(begin):
        return np.empty(0, np.uint64), owner, begin, end, lower
    at = np.flatnonzero(inside)
    lengths = end - begin
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(at)) - np.repeat(first, lengths)
    code = np.add.reduceat(_BYTE[lower[at]] * _powers(int(lengths.max()))[place], first)
    return mixed(code + lengths.astype(np.uint64)), owner, begin, end, lower


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Per text the sorted distinct fingerprints (int64) of its five-word shingles.

    A text of one to four words has one shingle, its whole sequence; a text
    without words has none.
    """
    code, owner, *_ = word_codes(texts)
    counts = np.bincount(owner, minlength=len(texts))
    stops = np.cumsum(counts)
    weights = _powers(SHINGLE_WORDS + 1)
    full = np.zeros(max(0, len(code) - SHINGLE_WORDS + 1), dtype=np.uint64)
    for j in range(SHINGLE_WORDS if len(full) else 0):
        full += code[j : j + len(full)] * weights[j]
    full = mixed(full + weights[SHINGLE_WORDS])
    for n, stop in zip(counts, stops):
        if n >= SHINGLE_WORDS:
            yield np.unique(full[stop - n : stop - SHINGLE_WORDS + 1].view(np.int64))
        elif n:
            short = (code[stop - n : stop] * weights[:n]).sum(dtype=np.uint64) + np.uint64(n)
            yield mixed(np.array([short], dtype=np.uint64)).view(np.int64)
        else:
            yield np.empty(0, dtype=np.int64)
