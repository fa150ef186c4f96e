"""Toxicity by compression distance.

Two zstandard dictionaries are trained: a toxic one from the windows of toxic documents that begin
with what ordinary documents hardly have, an ordinary one from windows of ordinary documents.  Both are followed
by the same longer dictionary, trained on ordinary text.  Windows slide over a whole text and are
compressed with both; a window that the toxic dictionary makes shorter speaks for toxicity.  The
best windows are compressed again at shifted places, whose mean is free of chance, and a logistic
calibration turns gains into a probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .common import bytes_of, labelled_sample, map_arrow, slices

# The bounded training sample: labelled rows of each class, with their whole texts.
SAMPLE = {1: 2000, 0: 5000}
PARTS = 4  # of the sample; the calibration leaves one out at a time
TOXIC_WEIGHT = 3.0  # of a toxic row in the calibration: missing one costs as much as so many false alarms

START = 3  # first bytes of a word that are marked
LENGTHS = range(5, 9)  # bytes of the word beginnings whose document counts are compared
STANDS_OUT = 5.0  # standard deviations above the count that ordinary text lets expect
FACTOR = 3  # times as frequent in toxic documents at least

SEED_BYTES = 14  # of a window that a class dictionary is trained on; it begins with a word
SEEDS = 4  # such windows of an ordinary document, spread over the whole text
CLASS_BYTES, CLASS_COVER = 3072, {"k": 14, "d": 8}  # size of a class dictionary, and zstandard's segment and match lengths
BASE_BYTES, BASE_COVER = 32768, {"k": 32, "d": 6}
BASE_WINDOW, BASE_WINDOWS = 192, 40_000  # of the sample's ordinary texts, drawn from all places

WINDOW, STRIDE = 64, 32
BEST = 8  # windows of a text that are looked at again
SHIFTS = np.arange(-16, 17, 5)
LEVEL, MIN_MATCH = 6, 5


def normal(text: bytes) -> bytes:
    """ASCII letters in lower case, lines joined by spaces, and one bit turned in the first bytes of
    every word, so that what a word begins with is matched by beginnings of words alone."""
    if not text:
        return b""
    a = np.frombuffer(b" " + text.lower().replace(b"\n", b" "), np.uint8).copy()
    space = a == 32
    since = np.arange(len(a)) - np.maximum.accumulate(np.where(space, np.arange(len(a)), 0))
    a[(since > 0) & (since <= START)] ^= 32
    return a.tobytes()


def _starts(text: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, value) of the word beginnings of 5 to 8 bytes, the space in front included, as integers."""
    a = np.frombuffer(text + b" " * max(LENGTHS), np.uint8)
    at = np.flatnonzero(a[: len(text)] == 32)
    value, whole = np.zeros(len(at), np.uint64), np.ones(len(at), bool)
    for i in range(max(LENGTHS)):
        letter = a[at + i]
        if i:
            whole &= letter != 32
        value = value << np.uint64(8) | letter
        if i + 1 in LENGTHS:
            yield at[whole], value[whole]


def word_starts(text: bytes) -> np.ndarray:
    """The distinct word beginnings of a text."""
    return np.unique(np.concatenate([v for _, v in _starts(text)]))


def standing_out(toxic: list[bytes], ordinary: list[bytes]) -> np.ndarray:
    """Word beginnings that far more toxic documents hold than ordinary ones let expect."""
    value, count = np.unique(np.concatenate([word_starts(t) for t in toxic]), return_counts=True)
    other, other_count = np.unique(np.concatenate([word_starts(t) for t in ordinary]), return_counts=True)
    if not len(other):
        return value
    i = np.minimum(np.searchsorted(other, value), len(other) - 1)
    expect = len(toxic) * (np.where(other[i] == value, other_count[i], 0) + 0.5) / len(ordinary)
    return value[((count - expect) / np.sqrt(expect + 1) >= STANDS_OUT) & (count > FACTOR * expect)]


def toxic_windows(text: bytes, marks: np.ndarray) -> list[bytes]:
    """The windows of a text that begin with one of the marks."""
    places = [at[np.isin(v, marks)] for at, v in _starts(text)]
    return [text[a : a + SEED_BYTES] for a in np.unique(np.concatenate(places)).tolist()]


def ordinary_windows(text: bytes, rng: np.random.Generator) -> list[bytes]:
    at = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
    return [text[a : a + SEED_BYTES] for a in rng.permutation(at)[:SEEDS].tolist()]


def trained(samples: list[bytes], size: int, cover: dict[str, int]) -> bytes:
    """A zstandard dictionary; what is too little to be trained on is one itself."""
    try:
        return zs.train_dictionary(size, samples, level=3, **cover).as_bytes()
    except zs.ZstdError:
        return b"".join(dict.fromkeys(samples))[:size]


@dataclass(frozen=True)
class ToxicityModel:
    """Both dictionaries and the calibration; small, so it travels with the task."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[float, ...] = (0.0,) * 5
    mean: tuple[float, ...] = (0.0,) * 4
    scale: tuple[float, ...] = (1.0,) * 4

    def probability(self, features: np.ndarray) -> np.ndarray:
        z = ((features - self.mean) / self.scale) @ np.array(self.weights[1:]) + self.weights[0]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class Gains:
    """Compressed lengths of windows under the ordinary dictionary less those under the toxic one."""

    def __init__(self, model: ToxicityModel):
        self.both = [self._compressor(d) for d in (model.ordinary, model.toxic)] if model.toxic else []

    @staticmethod
    def _compressor(content: bytes) -> zs.ZstdCompressor:
        d = zs.ZstdCompressionDict(content, dict_type=zs.DICT_TYPE_RAWCONTENT)
        params = zs.ZstdCompressionParameters.from_level(
            LEVEL, source_size=WINDOW, dict_size=len(content), min_match=MIN_MATCH, write_content_size=0, write_checksum=0, write_dict_id=0, format=zs.FORMAT_ZSTD1_MAGICLESS
        )
        d.precompute_compress(compression_params=params)
        return zs.ZstdCompressor(dict_data=d, compression_params=params)

    def of(self, data: bytes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Gains of the windows data[start : start + size]; they may overlap."""
        if not self.both or not len(start):
            return np.zeros(len(start), np.int32)
        cuts = np.stack([start, size], 1).astype(np.uint64).tobytes()
        ordinary, toxic = (c.multi_compress_to_buffer(zs.BufferWithSegments(data, cuts)) for c in self.both)
        n = len(start)
        return np.fromiter((len(ordinary[i]) - len(toxic[i]) for i in range(n)), np.int32, n)

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Per text: largest gain, largest and summed mean gain of the best windows at shifted
        places, log of the number of windows.  An empty text has zeros."""
        out = np.zeros((len(texts), 4))
        texts = [normal(t) for t in texts]
        size = np.array([len(t) for t in texts])
        base = np.cumsum(size) - size
        count = np.where(size > 0, np.maximum(1, -(-(size - WINDOW + STRIDE) // STRIDE)), 0)
        if not count.sum():
            return out
        data = b"".join(texts)
        doc = np.repeat(np.arange(len(texts)), count)
        first = np.cumsum(count) - count
        at = (np.arange(len(doc)) - first[doc]) * STRIDE
        gain = self.of(data, base[doc] + at, np.minimum(WINDOW, size[doc] - at))
        np.maximum.at(out[:, 0], doc, gain)
        order = np.lexsort((at, -gain, doc))
        place = np.arange(len(order)) - first[doc[order]]
        best = order[(place < BEST) & (gain[order] >= 1)]
        if len(best):
            d = np.repeat(doc[best], len(SHIFTS))
            moved = (at[best][:, None] + SHIFTS[None]).ravel()
            moved = np.clip(moved, 0, np.maximum(0, size[d] - WINDOW))
            again = self.of(data, base[d] + moved, np.minimum(WINDOW, size[d]))
            mean = np.maximum(again.reshape(-1, len(SHIFTS)).mean(1), 0)
            np.maximum.at(out[:, 1], doc[best], mean)
            np.add.at(out[:, 2], doc[best], mean)
        out[:, 3] = np.log1p(count)
        return out


def calibrate(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic weights (intercept first), means and scales of the features, by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-9)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    penalty = np.diag([1e-6, *[ridge] * x.shape[1]])
    w, cost = np.zeros(z.shape[1]), np.where(y == 1, TOXIC_WEIGHT, 1.0)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (cost * p * (1 - p))[:, None]).T @ z + penalty, z.T @ (cost * (y - p)) - penalty @ w)
        w = w + np.clip(step, -2, 2)
    return w, mean, scale


def _base(ordinary: list[bytes]) -> bytes:
    """The dictionary of ordinary text, from windows drawn at all places of the whole texts."""
    size = np.array([-(-len(t) // BASE_WINDOW) for t in ordinary])
    first = np.cumsum(size) - size
    drawn = np.sort(np.random.default_rng(0).permutation(int(size.sum()))[:BASE_WINDOWS])
    doc = np.searchsorted(first, drawn, side="right") - 1
    cuts = zip(doc.tolist(), ((drawn - first[doc]) * BASE_WINDOW).tolist(), strict=True)
    return trained([ordinary[d][a : a + BASE_WINDOW] for d, a in cuts], BASE_BYTES, BASE_COVER)


def _dictionaries(texts: list[bytes], y: np.ndarray, base: bytes) -> ToxicityModel:
    """Of normal texts; copies of a text count once."""
    toxic = list(dict.fromkeys(t for t, k in zip(texts, y, strict=True) if k and t))
    ordinary = list(dict.fromkeys(t for t, k in zip(texts, y, strict=True) if not k and t))
    if not toxic or not ordinary:
        return ToxicityModel(b"", b"")
    marks, rng = standing_out(toxic, ordinary), np.random.default_rng(0)
    bad = [w for t in toxic for w in toxic_windows(t, marks)]
    good = [w for t in ordinary for w in ordinary_windows(t, rng)]
    if not bad:
        return ToxicityModel(b"", b"")
    return ToxicityModel(trained(bad, CLASS_BYTES, CLASS_COVER) + base, trained(good, CLASS_BYTES, CLASS_COVER) + base)


def fit(texts: list[bytes], y: np.ndarray, part: np.ndarray) -> ToxicityModel:
    """Dictionaries from all rows; the calibration sees each row's gains under class dictionaries that were
    made without the row's part.  Rows of one class alone give a constant score, their share of
    toxic labels (0.5 without rows)."""
    if len(set(y.tolist())) < 2:
        share = y.mean() if len(y) else 0.5
        return ToxicityModel(b"", b"", (float(np.log((share + 1e-9) / (1 - share + 1e-9))), 0, 0, 0, 0))
    plain = [normal(t) for t in texts]
    base = _base([t for t, k in zip(plain, y, strict=True) if not k])
    x = np.zeros((len(texts), 4))
    for k in set(part.tolist()):
        rest = np.flatnonzero(part != k)
        gains = Gains(_dictionaries([plain[i] for i in rest], y[rest], base))
        for i in np.flatnonzero(part == k).tolist():
            x[i] = gains.features(texts[i : i + 1])[0]
    model = _dictionaries(plain, y, base)
    w, mean, scale = calibrate(x, y)
    return ToxicityModel(model.toxic, model.ordinary, tuple(w.tolist()), tuple(mean.tolist()), tuple(scale.tolist()))


def train(docs: DataFrame, labels: DataFrame, held: Column, sample: dict[int, int] = SAMPLE) -> ToxicityModel:
    """The model of a bounded sample of labelled rows (whole texts), none of them held out.  One task
    fits it; the dictionaries and a few numbers reach the driver."""
    chosen = F.broadcast(labelled_sample(labels, "toxic", held, sample))  # at most the sample's size
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where("text <> ''").select("doc_id", "text", "label", (F.col("bits") % PARTS).cast("int").alias("part")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "label", "part")), strict=True)))
        m = fit([r[1].encode() for r in got], np.array([r[2] for r in got], int), np.array([r[3] for r in got], int))
        numbers = [pa.array([list(map(float, v))], pa.list_(pa.float64())) for v in (m.weights, m.mean, m.scale)]
        yield pa.RecordBatch.from_arrays([pa.array([m.toxic]), pa.array([m.ordinary]), *numbers], names=["toxic", "ordinary", "weights", "mean", "scale"])

    made = map_arrow(rows.repartition(1), run, "toxic binary, ordinary binary, weights array<double>, mean array<double>, scale array<double>").collect()
    if not made:
        return fit([], np.zeros(0, int), np.zeros(0, int))
    return ToxicityModel(bytes(made[0]["toxic"]), bytes(made[0]["ordinary"]), *(tuple(made[0][k]) for k in ("weights", "mean", "scale")))


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with a double ``score_col`` (replaced if there): the probability that the whole text is
    toxic.  Null and empty texts have the score of a text without windows, very long ones are read window by
    window to their end; repeated rows and null ids are scored as they come; no rows give no rows."""
    rows = docs.drop(score_col)
    schema = StructType([*rows.schema.fields, StructField(score_col, DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gains = Gains(model)
        for big in batches:
            for b in slices(big, text_col):
                p = model.probability(gains.features(bytes_of(b, text_col)))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p, pa.float64())], names=[*b.schema.names, score_col])

    return map_arrow(rows, run, schema)
