"""Document quality from random-indexing word vectors and a small neural network.

Every word has a random sparse index vector (from its hash); a word's context vector is the sum of
the index vectors of its neighbours over all documents.  Words share a table of fixed size by hash,
so the vectors of any corpus fit a broadcast.  Documents pool the vectors of their words, and a
two-layer network with a calibrated temperature gives the probability of good quality.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bytes_of, labelled_sample, map_arrow, slices, summed_over_tasks, word_hashes

ROWS = 1 << 15  # words share so many vectors
DIM = 32
SPARSE = 4  # non-zero entries of an index vector
REACH = 2  # neighbours on either side

SAMPLE = {0: 4000, 1: 6000}  # the bounded training sample: labelled rows of each class
HIDDEN, EPOCHS, RATE, DECAY = 24, 400, 0.02, 1e-3
FEATURES = 2 * (DIM + 1) + 3


def _rows(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def index_entries(h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(dimension, sign) of each non-zero entry of the words' index vectors."""
    for j in range(SPARSE):
        bits = (h >> np.uint64(8 * j)).astype(np.int64)
        yield bits & (DIM - 1), 1 - 2 * ((bits >> 6) & 1)


def context_sums(docs: DataFrame) -> np.ndarray:
    """(ROWS, DIM + 1): sums of neighbours' index vectors over all texts, and counts of occurrences."""
    width = DIM + 1

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(ROWS * width, np.int64)
        for big in batches:
            for b in slices(big, "text"):
                doc, h = word_hashes(bytes_of(b), lower=False)
                row = _rows(h)
                total += np.bincount(row * width + DIM, minlength=len(total))
                entries = list(index_entries(h))
                for step in range(1, REACH + 1):
                    near = np.flatnonzero(doc[step:] == doc[:-step]) if len(doc) > step else np.empty(0, int)
                    for dim, sign in entries:
                        for word, other in ((near, near + step), (near + step, near)):
                            total += np.bincount(row[word] * width + dim[other], sign[other], minlength=len(total)).astype(np.int64)
        return total

    return summed_over_tasks(docs.select("text"), count, ROWS * width).reshape(ROWS, width)


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """(ROWS, DIM + 1): context vectors of unit length, less their common mean, and the log share of
    the word in the corpus."""
    vec, count = sums[:, :DIM].astype(float), sums[:, DIM]
    vec /= np.maximum(np.linalg.norm(vec, axis=1, keepdims=True), 1e-9)
    vec -= np.average(vec, axis=0, weights=count) if count.any() else 0
    rare = np.log((count + 1) / (count.sum() + ROWS))
    return np.c_[vec, (rare - rare.mean()) / max(rare.std(), 1e-9)].astype(np.float32)


def pool(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """Per text: mean and deviation of its words' vectors, mean cosine of neighbouring words, share
    of vectors met for the first time, log of the number of words.  A text without words has zeros."""
    out = np.zeros((len(texts), FEATURES))
    doc, h = word_hashes(texts, lower=False)
    if not len(doc):
        return out
    row = _rows(h)
    v = vectors[row]
    some, first = np.unique(doc, return_index=True)
    n = np.diff(np.r_[first, len(doc)])[:, None]
    mean = np.add.reduceat(v, first, dtype=np.float64) / n
    square = np.add.reduceat(v.astype(np.float64) ** 2, first) / n
    width = DIM + 1
    out[some, :width] = mean
    out[some, width : 2 * width] = np.sqrt(np.maximum(square - mean**2, 0))
    unit = v[:, :DIM] / np.maximum(np.linalg.norm(v[:, :DIM], axis=1, keepdims=True), 1e-6)
    near = np.r_[0.0, (unit[1:] * unit[:-1]).sum(1)]
    near[first] = 0
    out[some, 2 * width] = np.add.reduceat(near, first) / np.maximum(n[:, 0] - 1, 1)
    distinct = np.unique(doc * ROWS + row) // ROWS
    out[some, 2 * width + 1] = np.bincount(distinct, minlength=len(texts))[some] / n[:, 0]
    out[some, 2 * width + 2] = np.log1p(n[:, 0])
    return out


@dataclass
class Network:
    """Features -> HIDDEN tanh units -> one logit, divided by the temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def constant(share: float) -> Network:
    one = np.ones(FEATURES)
    return Network(0 * one, one, np.zeros((FEATURES, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def fit_network(x: np.ndarray, y: np.ndarray, seed: int = 0) -> Network:
    """Full-batch Adam on the log loss with weight decay; same rows, same weights."""
    rng = np.random.default_rng(seed)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = (x - mean) / scale
    p = [rng.normal(0, 1 / np.sqrt(FEATURES), (FEATURES, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, EPOCHS + 1):
        hid = np.tanh(z @ p[0] + p[1])
        err = (1 / (1 + np.exp(-np.clip(hid @ p[2] + p[3], -30, 30))) - y) / len(y)
        back = np.outer(err, p[2]) * (1 - hid**2)
        grads = [z.T @ back + DECAY * p[0], back.sum(0), hid.T @ err + DECAY * p[2], err.sum(keepdims=True)]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            s[i] = 0.999 * s[i] + 0.001 * g * g
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
    return Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray) -> Network:
    """The temperature with the smallest log loss on rows that the weights have not seen."""
    logit = net.logits(x)

    def loss(t: float) -> float:
        a = np.clip(logit / t, -30, 30)
        return float(np.mean(np.logaddexp(0, a) - y * a))

    net.temperature = float(min(np.geomspace(0.25, 8, 101), key=loss))
    return net


@dataclass
class QualityModel:
    vectors: np.ndarray
    net: Network

    def probability(self, texts: list[bytes]) -> np.ndarray:
        return self.net.probability(pool(texts, self.vectors))


def train(docs: DataFrame, labels: DataFrame, held: Column, sample: dict[int, int] = SAMPLE) -> QualityModel:
    """Word vectors from all of ``docs``; the network from three quarters of a bounded sample of
    labelled rows and the temperature from the rest (all rows for both if either lacks a class).
    Without rows of both classes every score is the share of good labels (0.5 without labels)."""
    vectors = word_vectors(context_sums(docs))
    shared = docs.sparkSession.sparkContext.broadcast(vectors)  # of fixed size
    chosen = F.broadcast(labelled_sample(labels, "quality", held, sample))  # at most the sample's size
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "label", (F.col("bits") % 4).alias("part"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                x = pool(bytes_of(b), shared.value)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "label", "part")), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "label", "part", "x"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    got = sorted(map_arrow(rows, run, f"doc_id {kind}, label int, part long, x array<double>").collect(), key=lambda r: (r["doc_id"], r["x"]))
    y, part = np.array([r["label"] for r in got], float), np.array([r["part"] for r in got], int)
    if len(set(y.tolist())) < 2:
        return QualityModel(vectors, constant(y.mean() if len(y) else 0.5))
    x = np.array([r["x"] for r in got])
    fit = part > 0
    if len(set(y[fit].tolist())) < 2 or len(set(y[~fit].tolist())) < 2:
        fit = np.ones(len(y), bool)
    rest = fit if fit.all() else ~fit
    return QualityModel(vectors, calibrate(fit_network(x[fit], y[fit]), x[rest], y[rest]))


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a double ``score_col`` (replaced if there): the probability that the whole text is
    good.  Null and empty texts have the score of a text without words, very long ones are pooled whole; repeated rows and null ids
    are scored as they come; no rows give no rows."""
    rows = docs.drop(score_col)
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, text_col):
                p = shared.value.probability(bytes_of(b, text_col))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score_col])

    return map_arrow(rows, run, schema)
