"""Quality by a byte-level convolutional network in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corelode.llm.common import id_and_text, shingle_sets, texts_of
from corelode.llm.labelled import held_out, training_rows

# Labelled rows and bytes per text in the training sample.
SAMPLE_ROWS = 3_000
SAMPLE_BYTES = 60_000
WIDTH = 6  # bytes under one filter
FILTERS = 16
# Chunks overlap by half: a chunk is two neighbouring steps.
STEP = 256
EPOCHS = 8
BATCH = 32
RATE = 0.01
# Scores of at least this much predict label 1.
ACCEPT = 0.3
# Bytes convolved at a time, so that a pass stays in the processor's cache.
PASS = 1 << 14


@dataclass
class ByteNetwork:
    """One weight per (place under the filter, byte, filter), a bias per filter, and the combining layer."""

    table: np.ndarray  # (WIDTH, 257, FILTERS); byte 256 pads
    bias: np.ndarray  # (FILTERS,)
    out: np.ndarray  # (2 * FILTERS,)
    out_bias: float

    @staticmethod
    def fresh(seed: int = 7) -> ByteNetwork:
        draw = np.random.default_rng(seed)
        table = draw.normal(0, 0.3, (WIDTH, 257, FILTERS)).astype(np.float32)
        table[:, 256] = 0
        return ByteNetwork(table, np.zeros(FILTERS, np.float32), draw.normal(0, 0.3, 2 * FILTERS).astype(np.float32), 0.0)

    def step_maxima(self, text: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """(steps, FILTERS): the greatest response of each filter in each step of the text, and where it is.

        The convolution runs over the whole text once, a pass at a time; the
        text is padded so that every byte starts one filter position.
        """
        n = max(1, -(-len(text) // STEP))
        padded = np.full(n * STEP + WIDTH - 1, 256, dtype=np.int64)
        padded[: len(text)] = text
        best = np.empty((n, FILTERS), np.float32)
        where = np.empty((n, FILTERS), np.int64) if places else None
        for a in range(0, n, PASS // STEP):
            b = min(n, a + PASS // STEP)
            at = padded[a * STEP : b * STEP + WIDTH - 1]
            size = (b - a) * STEP
            response = self.table[0].take(at[:size], axis=0)
            for w in range(1, WIDTH):
                response += self.table[w].take(at[w : w + size], axis=0)
            blocks = response.reshape(b - a, STEP, FILTERS)
            best[a:b] = blocks.max(axis=1)
            if places:
                where[a:b] = blocks.argmax(axis=1) + (np.arange(a, b) * STEP)[:, None]
        return best, where

    def pooled(self, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(chunks, FILTERS) after overlap, bias and rectifier; and the step that each chunk took its value from."""
        if len(best) == 1:
            taken = np.zeros((1, FILTERS), np.int64)
        else:
            later = best[1:] > best[:-1]
            taken = np.arange(len(best) - 1)[:, None] + later
        return np.maximum(np.take_along_axis(best, taken, axis=0) + self.bias, 0), taken

    def combine(self, chunks: np.ndarray) -> np.ndarray:
        """Whole-document features: the greatest and the mean value of each filter over the chunks."""
        return np.concatenate([chunks.max(axis=0), chunks.mean(axis=0)])

    def score(self, text: bytes) -> float:
        best, _ = self.step_maxima(np.frombuffer(text, dtype=np.uint8))
        logit = float(self.combine(self.pooled(best)[0]) @ self.out) + self.out_bias
        return float(0.5 * (1 + np.tanh(0.5 * logit)))


def fit_network(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS) -> ByteNetwork:
    """Adam on the logistic loss; the gradient of a maximum goes to the place that gave it."""
    net = ByteNetwork.fresh()
    parameters = [net.table, net.bias, net.out, np.zeros(1, np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in parameters]
    # Both labels weigh the same, whatever their share.
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum())) * len(labels)
    draw, step = np.random.default_rng(11), 0
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    for _ in range(epochs):
        for chosen in np.array_split(draw.permutation(len(data)), max(1, len(data) // BATCH)):
            step += 1
            gradients = [np.zeros_like(p) for p in parameters]
            for i in chosen:
                best, where = net.step_maxima(data[i], places=True)
                chunks, taken = net.pooled(best)
                features = net.combine(chunks)
                p = 0.5 * (1 + np.tanh(0.5 * (float(features @ net.out) + float(parameters[3][0]))))
                error = float(weight[i] * (p - labels[i]) / len(chosen))
                gradients[2] += error * features
                gradients[3] += error
                back = error * net.out
                g = np.tile(back[FILTERS:] / len(chunks), (len(chunks), 1)).astype(np.float32)
                g[chunks.argmax(axis=0), np.arange(FILTERS)] += back[:FILTERS]
                g *= chunks > 0
                gradients[1] += g.sum(axis=0)
                position = np.take_along_axis(where, taken, axis=0)
                column = np.broadcast_to(np.arange(FILTERS), position.shape)
                padded = np.full(len(data[i]) + STEP + WIDTH, 256, dtype=np.int64)
                padded[: len(data[i])] = data[i]
                for w in range(WIDTH):
                    np.add.at(gradients[0][w], (padded[position + w], column), g)
            gradients[0][:, 256] = 0
            for p, g, (m, v) in zip(parameters, gradients, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    net.out_bias = float(parameters[3][0])
    return net


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> ByteNetwork:
    """Fit on a bounded sample of labelled rows outside the held-out fifth; near copies count once.

    Without labels of both kinds the network has no evidence: it then gives the
    label it has seen (1 if none) to every text.
    """
    rows = training_rows(docs, labels, label, SAMPLE_ROWS, SAMPLE_BYTES).select("doc_id", "text", "label").collect()
    sample: dict[tuple[int, int], tuple[bytes, int]] = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"])):
        text = r["text"].encode()
        shingles = next(shingle_sets([text]))
        sample.setdefault((r["label"], int(shingles[0]) if len(shingles) else 0), (text, r["label"]))
    kinds = {y for _, y in sample.values()}
    if kinds != {0, 1}:
        net = ByteNetwork.fresh()
        net.out[:] = 0
        net.out_bias = -20.0 if kinds == {0} else 20.0
        return net
    return fit_network([t for t, _ in sample.values()], np.array([y for _, y in sample.values()]))


def quality_scores(docs: DataFrame, net: ByteNetwork, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text.

    The score is the probability of label 1; nothing but the bytes of the text
    enters it. Null and empty texts are scored as one chunk of padding. One row
    per row, null and repeated ids too; empty tables give no rows; other columns
    are not carried.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [net.score(text) for _, texts in texts_of(batch.column("text")) for text in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, type=pa.float64())], names=["doc_id", "score"])

    rows = id_and_text(docs, id_col, text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
