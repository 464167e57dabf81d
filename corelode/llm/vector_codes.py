"""Vector codes: 16 codebooks of 64 entries, exact nearest entries from bitmasks over sorted coordinates."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.operators.ordered import join_on
from corelode.session import keep

PARTS = 16
# Entries of a codebook: one bit each of a 64-bit mask.
ENTRIES = 64
ROUNDS = 2
# A component x counts as floor(SCALE * x), and no more than LARGEST either way: squares fit 64 bits.
SCALE = 256
LARGEST = 1 << 26
# Numbers that one numpy pass handles.
PASS_NUMBERS = 1 << 17
FINITE = "{v} IS NOT NULL AND NOT exists({v}, x -> x IS NULL OR isnan(x) OR abs(x) = double('infinity'))"


def whole_numbers(column: pa.ListArray, width: int) -> np.ndarray:
    """(rows, PARTS, width) whole numbers of an Arrow column of vectors; what a vector lacks counts as 0."""
    lengths = np.asarray(pc.list_value_length(column), dtype=np.int64)
    flat = np.asarray(column.flatten().cast(pa.float64()))
    numbers = np.clip(np.floor(flat * SCALE), -LARGEST, LARGEST).astype(np.int64)
    full = PARTS * width
    if (lengths == full).all():
        return numbers.reshape(len(lengths), PARTS, width)
    out = np.zeros((len(lengths), full), dtype=np.int64)
    at = np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[np.repeat(np.arange(len(lengths)), lengths), np.arange(len(numbers)) - at] = numbers
    return out.reshape(len(lengths), PARTS, width)


class NearestEntry:
    """Exact nearest entries of one codebook, ties to the lower index.

    Per dimension the entries' coordinates are sorted, and ``prefix[i]`` has the
    bits of the first i. A query takes the closest coordinate of every dimension
    as a guess; the best guess gives the initial radius. No nearer entry differs
    by more than the radius in any dimension, so each dimension selects a range
    of sorted coordinates, whose mask is the difference of two prefixes, and the
    AND of the masks holds every entry that can win. Those are measured.
    """

    def __init__(self, entries: np.ndarray) -> None:
        self.entries = entries
        order = np.argsort(entries, axis=0, kind="stable")
        self.order = order.T
        self.sorted = np.take_along_axis(entries, order, axis=0).T
        bits = np.left_shift(np.uint64(1), order.T.astype(np.uint64))
        self.prefix = np.hstack([np.zeros((len(bits), 1), np.uint64), np.bitwise_or.accumulate(bits, axis=1)])

    def _distance(self, points: np.ndarray, entry: np.ndarray) -> np.ndarray:
        return ((points - self.entries[entry]) ** 2).sum(axis=1)

    def candidates(self, points: np.ndarray) -> np.ndarray:
        """A mask per point with the bits of all entries that may be nearest."""
        bound = np.full(len(points), np.iinfo(np.int64).max)
        for d, (coordinates, order) in enumerate(zip(self.sorted, self.order)):
            at = np.minimum(np.searchsorted(coordinates, points[:, d]), len(coordinates) - 1)
            bound = np.minimum(bound, self._distance(points, order[at]))
        radius = np.sqrt(bound.astype(float)).astype(np.int64) + 1  # the root of a large number may be rounded down
        mask = np.full(len(points), np.uint64(0xFFFFFFFFFFFFFFFF))
        for d, (coordinates, prefix) in enumerate(zip(self.sorted, self.prefix)):
            low = np.searchsorted(coordinates, points[:, d] - radius, side="left")
            high = np.searchsorted(coordinates, points[:, d] + radius, side="right")
            mask &= prefix[high] & ~prefix[low]
        return mask

    def find(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(entry, squared distance) per point."""
        if not len(points):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        bits = np.unpackbits(self.candidates(points).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        row, entry = np.nonzero(bits)  # by point, lower entries first; every point has one at least
        distance = self._distance(points[row], entry)
        first = np.searchsorted(row, np.arange(len(points)))
        least = np.minimum.reduceat(distance, first)
        hits = np.flatnonzero(distance == least[row])
        return entry[hits[np.searchsorted(row[hits], np.arange(len(points)))]], least


@dataclass(frozen=True)
class Codebooks:
    """``entries``: (PARTS, at most ENTRIES, width) whole numbers."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def assign(self, column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of an Arrow column: (first row, numbers, entries (rows, PARTS), squared distances)."""
        width = self.entries.shape[2]
        searches = [NearestEntry(book) for book in self.entries]
        step = max(1, PASS_NUMBERS // (PARTS * width))
        for start in range(0, len(column), step):
            numbers = whole_numbers(column.slice(start, step), width)
            found = [search.find(numbers[:, p]) for p, search in enumerate(searches)]
            yield start, numbers, np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _seeds(kept: DataFrame) -> pa.Array:
    """The vectors of the ENTRIES smallest ids (of equal ids the least vector), at most so many rows at a time."""
    found: dict[int, list[float]] = {}
    rest = kept.filter("id IS NOT NULL")
    while len(found) < ENTRIES:
        rows = rest.filter(F.col("id") > max(found)).orderBy("id", "v").limit(ENTRIES).collect() if found else rest.orderBy("id", "v").limit(ENTRIES).collect()
        if not rows:
            break
        for r in rows:
            found.setdefault(r["id"], r["v"])
    return pa.array([found[i] for i in sorted(found)[:ENTRIES]], type=pa.list_(pa.float64()))


def _sums_in(books: Codebooks):
    """Per task: (part, entry, position, total, n) of the parts that an entry is nearest to."""
    parts, entries, width = books.entries.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts * entries, width), dtype=np.int64)
        n = np.zeros(parts * entries, dtype=np.int64)
        for batch in batches:
            for _, numbers, entry, _ in books.assign(batch.column("v")):
                slot = (entry + np.arange(parts) * entries).ravel()
                n += np.bincount(slot, minlength=len(n))
                for j in range(width):  # a run's sums are far below 2^53: doubles hold them exactly
                    total[:, j] += np.bincount(slot, weights=numbers[:, :, j].ravel(), minlength=len(n)).astype(np.int64)
        slot, position = (x.ravel() for x in np.meshgrid(np.flatnonzero(n), np.arange(width), indexing="ij"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (slot // entries, slot % entries, position, total[slot, position], n[slot])],
            names=["part", "entry", "position", "total", "n"])

    return run


def _kept(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    named = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    return named.filter(FINITE.format(v="v"))


def train(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS) -> Codebooks:
    """The codebooks of ``vectors``: ROUNDS rounds over all kept rows.

    They start at the parts of the smallest ids. Every round assigns all parts
    and replaces an entry by its parts' floored mean; an entry without parts
    stays. A task sends one sum per entry and position, at most PARTS * ENTRIES *
    width rows, and as many reach the driver. Rows without id don't seed.
    Vectors of different lengths: the longest gives the width, what others lack
    counts as 0. No kept row gives no entries.
    """
    kept = _kept(vectors, id_col, vector_col, label_col)
    longest = kept.agg(F.max(F.size("v"))).first()[0] or 0
    width = max(1, -(-longest // PARTS))
    entries = np.ascontiguousarray(whole_numbers(_seeds(kept), width).transpose(1, 0, 2))
    for _ in range(rounds if entries.size else 0):
        sums = kept.select("v").mapInArrow(_sums_in(Codebooks(entries)), "part long, entry long, position long, total long, n long")
        means = sums.groupBy("part", "entry", "position").agg(F.sum("total").alias("total"), F.sum("n").alias("n")).toPandas()
        entries = entries.copy()
        entries[means["part"], means["entry"], means["position"]] = means["total"].to_numpy() // means["n"].to_numpy()
    return Codebooks(entries)


def encode(vectors: DataFrame, books: Codebooks, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, label, code, error) of every kept row: two hex digits a part, and the squared distance left.

    A map over the rows; the codebooks, of bounded size, go to every task. A row
    is dropped if its vector is null or has a null or non-finite component.
    Without entries the code and the error are null.
    """
    kept = _kept(vectors, id_col, vector_col, label_col)
    schema = f"vec_id long, label {kept.schema['label'].dataType.simpleString()}, code string, error long"
    if not books.entries.size:
        return kept.select(F.col("id").alias("vec_id"), "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, _, entry, distance in books.assign(batch.column("v")):
                codes = [row.tobytes().hex() for row in entry.astype(np.uint8)]
                part = batch.slice(start, len(codes))
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("label"), pa.array(codes), pa.array(distance.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    return kept.mapInArrow(run, schema)


def decode(coded: DataFrame, books: Codebooks) -> DataFrame:
    """``coded``, all columns, with ``restored``: the vector its code stands for (middles of the steps of 1/SCALE)."""
    table = [[((e + 0.5) / SCALE).tolist() for e in part] for part in books.entries]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("code").to_pylist()
            whole = [None if c is None else [x for p, e in enumerate(bytes.fromhex(c)) for x in table[p][e]] for c in codes]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(whole, type=pa.list_(pa.float64()))], names=[*batch.schema.names, "restored"])

    return coded.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in coded.schema.fields), "restored array<double>"]))


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Train codebooks on all rows and encode all rows: one row per kept row.

    ``label_error`` is the error summed over the rows of an equal label, nulls
    together (null beyond 64 bits). Repeated rows get equal answers; a null id stays null; the vector's own
    column types may be float or double; empty tables give no rows; other
    columns are not carried.

    Returns vec_id, code, error, label_error, codebooks_sha256.
    """
    books = train(vectors, id_col, vector_col, label_col)
    coded = keep(encode(vectors, books, id_col, vector_col, label_col))
    by_label = keep(coded.groupBy("label").agg(F.try_sum("error").alias("label_error")))
    return join_on(coded, by_label, ["label"]).select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
