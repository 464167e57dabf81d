"""Toxicity grades by cumulative-link ordinal regression on sparse text features."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import LOWER, _BYTE, _powers, id_and_text, mixed, shingle_sets, stretches, texts_of
from corelode.llm.labelled import held_out, training_rows
from corelode.session import keep

# Labelled rows and bytes per text in the training sample; features in the model.
SAMPLE_ROWS = 12_000
SAMPLE_BYTES = 200_000
FEATURES = 1_024
# Features are counted in this many slots before the most telling ones are chosen.
SLOT_BITS = 20
# A word counts as itself and by its first bytes, since inflected forms share their stem.
PREFIXES = (4, 5, 6, 7, 8)
# Documents at this probability of any toxicity or more are rejected.
REJECT = 0.4
# Least log ratio of the toxic to the clean rate, times the root of the toxic count:
# a word in three toxic texts of a small sample is not evidence yet.
TELLING = 5.5
RIDGE = 2e-5
STEPS = 600
NO_LETTER = re.compile(rb"[\x00-\x40\x5B-\x60\x7B-\x7F]")


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, slot) of the distinct features of each text, ordered by text.

    A text on its own may be long: it is read in stretches, so that memory does not follow its length.
    """
    if len(texts) == 1:
        keys = [_feature_keys([part]) for part in stretches(texts[0], NO_LETTER)]
        key = keys[0] if len(keys) == 1 else np.unique(np.concatenate(keys))
    else:
        key = _feature_keys(texts)
    return key >> SLOT_BITS, key & ((1 << SLOT_BITS) - 1)


def _feature_keys(texts: list[bytes]) -> np.ndarray:
    lower = np.frombuffer(b" ".join([*texts, b""]).translate(LOWER), dtype=np.uint8)
    # Words are runs of letters here: "scum," is "scum".
    letter = (lower >= 128) | ((lower >= 97) & (lower <= 122))
    edge = np.diff(letter.view(np.int8), prepend=np.int8(0), append=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(begin):
        return np.empty(0, np.int64)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    owner = np.searchsorted(bounds, begin, side="right") - 1
    lengths = end - begin
    letters = lower[letter]
    first = np.cumsum(lengths) - lengths
    place = np.arange(len(letters), dtype=np.int32)
    place -= np.repeat(first.astype(np.int32), lengths)
    value = _BYTE[letters] * _powers(int(lengths.max()))[place]
    keys = []
    for size in (None, *PREFIXES):
        fits = np.ones(len(lengths), bool) if size is None else lengths >= size
        part = value if size is None else np.where(place < size, value, np.uint64(0))
        codes = mixed(np.add.reduceat(part, first)[fits] + np.uint64(0 if size is None else size))
        keys.append((owner[fits] << SLOT_BITS) | (codes >> np.uint64(64 - SLOT_BITS)).astype(np.int64))
    return np.unique(np.concatenate(keys))


@dataclass(frozen=True)
class GradeModel:
    """Weights of the slots and the ordered thresholds: P(grade <= j) = logistic(thresholds[j] - weights x)."""

    slots: np.ndarray  # sorted
    weights: np.ndarray
    thresholds: np.ndarray

    def grade_probabilities(self, texts: list[bytes]) -> np.ndarray:
        """(texts, grades)."""
        row, column = _chosen(self.slots, texts)
        score = np.bincount(row, weights=self.weights[column], minlength=len(texts)) if len(row) else np.zeros(len(texts))
        below = _logistic(self.thresholds[None, :] - score[:, None])
        edge = np.zeros((len(texts), 1))
        return np.diff(np.hstack([edge, below, edge + 1]), axis=1)


def _chosen(slots: np.ndarray, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, column) of the chosen features."""
    row, slot = features(texts)
    if not len(slots) or not len(row):
        empty = np.empty(0, np.int64)
        return empty, empty
    column = np.minimum(np.searchsorted(slots, slot), len(slots) - 1)
    hit = slots[column] == slot
    return row[hit], column[hit]


def _logistic(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def fit_grades(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ordered thresholds that maximise the cumulative-link likelihood, less a ridge.

    All thresholds share the weights; gaps between thresholds are positive by
    construction (exponentials). Features are present or absent. Full-batch Adam,
    a fixed number of steps.
    """
    n, top = len(grades), int(grades.max(initial=1))
    share = np.clip([(grades <= j).mean() for j in range(top)], 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    free = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    at = np.arange(n)
    for step in range(1, steps + 1):
        w, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        thresholds = free[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(rows, weights=w[columns], minlength=n)
        below = np.hstack([np.zeros((n, 1)), _logistic(thresholds[None, :] - score[:, None]), np.ones((n, 1))])
        slope = below * (1 - below)
        p = np.maximum(below[at, grades + 1] - below[at, grades], 1e-12)
        upper, lower = slope[at, grades + 1] / p, slope[at, grades] / p
        g_score = (upper - lower) / n  # of the negative log-likelihood
        g_threshold = np.array([-(upper[grades == j].sum() - lower[grades == j + 1].sum()) / n for j in range(top)])
        tail = np.cumsum(g_threshold[::-1])[::-1]
        gradient = np.concatenate([np.bincount(columns, weights=g_score[rows], minlength=n_features) + RIDGE * w, tail[:1], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        free = free - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return free[:n_features], free[n_features] + np.concatenate([[0.0], np.cumsum(np.exp(free[n_features + 1 :]))])


def _keys_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in texts_of(batch.column("text")):
            keys = pa.array([int(s[0]) if len(s) else 0 for s in shingle_sets(texts)], type=pa.int64())
            part = batch.slice(start, len(texts))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text"), part.column("label"), keys], names=["doc_id", "text", "label", "key"])


def _slots_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a task per slot, for either label."""
    seen = {label: np.zeros(1 << SLOT_BITS, dtype=np.int64) for label in (0, 1)}
    for batch in batches:
        for start, texts in texts_of(batch.column("text")):
            row, slot = features(texts)
            label = np.array(batch.column("label").slice(start, len(texts)).to_pylist(), dtype=np.int64)
            for value, counts in seen.items():
                counts += np.bincount(slot[label[row] == value], minlength=len(counts)) if len(row) else 0
    slot = np.flatnonzero(seen[0] + seen[1])
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (slot, seen[0][slot], seen[1][slot])], names=["slot", "clean", "toxic"])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> GradeModel:
    """Fit the grades on a bounded sample of the labelled rows outside the held-out fifth.

    The labels are one bit. Toxic rows are graded 1 or 2 by how many different
    telling features they have, up to the median of the sample or more; other
    rows are 0. Near copies (same least shingle fingerprint) count once, so
    that a large family does not pass for evidence; the row of the least id and
    text hash stands for them, so any partitioning gives the same model. The
    grades 1 and 2 are set by the features that then predict them: the second
    threshold learns this definition, not a judgement of its own. With labels of one kind
    only, or none, every document gets the share of toxic labels (0 if none).
    """
    rows = training_rows(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES).mapInArrow(_keys_in, "doc_id long, text string, label int, key long")
    least = F.min(F.struct("doc_id", F.xxhash64("text").alias("hash"), "text")).alias("least")  # whatever the partitioning, the same row
    sample = keep(rows.groupBy("label", "key").agg(least).select("label", "key", "least.doc_id", "least.text"))
    kinds = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    clean, toxic = kinds.get(0, 0), kinds.get(1, 0)
    if not clean or not toxic:
        sure = 20.0 if clean or not toxic else -20.0
        return GradeModel(np.empty(0, np.int64), np.empty(0), np.array([sure, sure + 1]))
    counts = sample.mapInArrow(_slots_in, "slot long, clean long, toxic long").groupBy("slot").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    rate = {k: (F.col(k) + 0.5) / (n + 1.0) for k, n in (("clean", clean), ("toxic", toxic))}
    surprise = F.log(rate["toxic"] / rate["clean"]) * F.sqrt("toxic")
    chosen = counts.filter(surprise >= TELLING).orderBy(surprise.desc(), "slot").limit(FEATURES).select("slot").orderBy("slot").toPandas()
    slots = chosen["slot"].to_numpy(np.int64)

    def columns_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch.column("text")):
                row, column = _chosen(slots, texts)
                offsets = np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(column))
                part = batch.slice(start, len(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), part.column("key"), lists], names=["doc_id", "label", "key", "columns"])

    # One row per label and key: the order is total.
    design = sample.mapInArrow(columns_in, "doc_id long, label int, key long, columns array<long>").orderBy("doc_id", "label", "key").toPandas()
    label_of = design["label"].to_numpy(np.int64)
    sizes = telling = design["columns"].map(len).to_numpy()
    grades = label_of * (1 + (telling > np.median(telling[label_of == 1])))
    weights, thresholds = fit_grades(
        np.repeat(np.arange(len(design)), sizes), np.concatenate(design["columns"].to_list()).astype(np.int64), grades, len(slots))
    return GradeModel(slots, weights, thresholds)


def _probabilities(model: GradeModel, column: pa.Array) -> np.ndarray:
    parts = [model.grade_probabilities(texts) for _, texts in texts_of(column)]
    return np.vstack(parts) if parts else np.empty((0, len(model.thresholds) + 1))


def grade_documents(docs: DataFrame, model: GradeModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Expected severity of every whole text: (doc_id, held_out, severity, score, grade, predicted, kept).

    ``severity`` is the expected grade, ``score`` the probability of any grade
    above 0, ``grade`` the likeliest one; ``predicted`` is 1 and ``kept`` false
    at REJECT or more. A null or empty text has no features and gets the score
    of the thresholds alone. One row per row, null and repeated ids too; empty
    tables give no rows; other columns are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = _probabilities(model, batch.column("text"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array(p @ np.arange(p.shape[1], dtype=float)), pa.array(1 - p[:, 0]),
                pa.array(p.argmax(axis=1), type=pa.int32())], names=["doc_id", "severity", "score", "grade"])

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    graded = rows.mapInArrow(run, "doc_id long, severity double, score double, grade int")
    return graded.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "severity", "score", "grade",
        (F.col("score") >= REJECT).cast("int").alias("predicted"), (F.col("score") < REJECT).alias("kept"))


def reject_toxic(docs: DataFrame, model: GradeModel, text_col: str = "text") -> DataFrame:
    """``docs``, all columns, without the rows whose score reaches REJECT."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in texts_of(batch.column(batch.schema.get_field_index(text_col))):
                stays = 1 - model.grade_probabilities(texts)[:, 0] < REJECT
                yield batch.slice(start, len(texts)).filter(pa.array(stays))

    return docs.mapInArrow(run, docs.schema)
