"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared as 64-bit numbers: exclusive-or and bit counts of one tile against another.
The bit counts of the four 16-bit quarters of two fingerprints differ by no more, in sum, than their
bits, so tiles hold fingerprints of equal quarter counts and meet only those tiles whose counts are
within the radius.  Of the links inside a pair of tiles a spanning forest leaves the task.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import component_labels
from ..session import cut_lineage
from .common import bytes_of, map_arrow, slices

SEED = 42
QUARTERS, QUARTER_BITS = 4, 16
SIDE = QUARTER_BITS + 1  # values that a quarter's bit count can have
TILE = 2048  # fingerprints of one side
ROWS_AT_ONCE = 256  # of a tile that are held against another whole one
WORDS_AT_ONCE = 1 << 16  # of a text


def fingerprint(text: bytes, words: int) -> int:
    """64 bits: each is 1 if it is set in over half of the hashes of the word shingles."""
    found = text.lower().split()  # bytes: A-Z alone, and white space of ASCII
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, WORDS_AT_ONCE):
        part = found[at : at + WORDS_AT_ONCE + words - 1]
        line = b" ".join(part)
        ends = list(itertools.accumulate(len(w) + 1 for w in part))
        starts = [0, *ends]
        last = ends[min(words, len(part)) - 1 :]
        h = np.fromiter((xxhash.xxh64_intdigest(line[a : b - 1], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last))
        ones += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, bits): the fingerprint as a signed long; null and empty texts have zero."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                made = np.array([fingerprint(t, words) for t in bytes_of(b)], np.uint64)
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "bits"])

    return map_arrow(docs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, bits long")


def _moves(radius: int) -> list[tuple[int, ...]]:
    """Differences of quarter counts that add up to the radius at most; of each and its opposite, one."""
    reach = range(-radius, radius + 1)
    return [m for m in itertools.product(reach, repeat=QUARTERS) if sum(map(abs, m)) <= radius and m >= (0,) * QUARTERS]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, label) of the nodes of the links a - b: the smallest node that each is linked to."""
    node, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    i, j = place[: len(a)], place[len(a) :]
    label = np.arange(len(node))
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        for k in (label[i], label[j], i, j):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == label).all():
            return node, node[label]
        label = new


def linked(x: np.ndarray, y: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of ``x`` and ``y`` that differ in at most ``radius`` bits, as (fingerprint, label)."""
    left, right = [], []
    for at in range(0, len(x), ROWS_AT_ONCE):
        part = x[at : at + ROWS_AT_ONCE]
        i, j = np.nonzero(np.bitwise_count(part[:, None] ^ y[None]) <= radius)
        if same:
            i, j = i[i + at < j], j[i + at < j]
        if len(i):  # links of a dense group shrink to a forest before the next rows are looked at
            node, label = forest(part[i], y[j])
            left.append(node)
            right.append(label)
    if not left:
        return np.empty(0, x.dtype), np.empty(0, x.dtype)
    return forest(np.concatenate(left), np.concatenate(right))


def near_fingerprints(bits: DataFrame, radius: int) -> DataFrame:
    """(a, b): links that connect what differs in at most ``radius`` bits, of distinct ``bits``."""
    quarter = lambda i: F.bit_count(F.shiftrightunsigned("bits", QUARTER_BITS * i).bitwiseAND((1 << QUARTER_BITS) - 1))
    cells = bits.select("bits", *(quarter(i).alias(f"q{i}") for i in range(QUARTERS)))
    names = [f"q{i}" for i in range(QUARTERS)]
    sizes = cells.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("tiles"))  # SIDE ** QUARTERS rows at most
    sizes = cut_lineage(sizes)
    part = F.pmod(F.xxhash64("bits"), F.col("tiles")).cast("int").alias("part")
    tiles = cut_lineage(cells.join(sizes, names).groupBy(*names, part).agg(F.collect_list("bits").alias("tile")))

    moves = F.array(*(F.struct(*(F.lit(x).alias(f"d{i}") for i, x in enumerate(m))) for m in _moves(radius)))
    at = tiles.withColumn("m", F.explode(moves))
    at = at.withColumns({f"h{i}": F.col(f"q{i}") - F.col(f"m.d{i}") for i in range(QUARTERS)})
    at = at.where(F.least(*(F.col(f"h{i}") for i in range(QUARTERS))) >= 0)
    homes = sizes.toDF(*(f"h{i}" for i in range(QUARTERS)), "seats")
    at = at.join(homes, [f"h{i}" for i in range(QUARTERS)])
    own = F.col("m") == F.struct(*(F.lit(0).alias(f"d{i}") for i in range(QUARTERS)))
    last = F.when(own, F.col("part")).otherwise(F.col("seats") - 1)  # a cell's own parts meet once
    at = at.select(*(F.col(f"h{i}") for i in range(QUARTERS)), F.explode(F.sequence(F.lit(0), last)).alias("seat"), F.col("tile").alias("y"), (own & (F.col("seat") == F.col("part"))).alias("same"))
    seats = tiles.select(*(F.col(f"q{i}").alias(f"h{i}") for i in range(QUARTERS)), F.col("part").alias("seat"), F.col("tile").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for x, y, same in zip(big.column("x"), big.column("y"), big.column("same").to_pylist(), strict=True):
                a, b = linked(*(t.values.to_numpy(zero_copy_only=False).view(np.uint64) for t in (x, y)), radius, same)
                if (a != b).any():
                    yield pa.RecordBatch.from_arrays([pa.array(c[a != b].view(np.int64)) for c in (a, b)], names=["a", "b"])

    pairs = seats.join(at, [*(f"h{i}" for i in range(QUARTERS)), "seat"]).select("x", "y", "same")
    return map_arrow(pairs, run, "a long, b long")


def simhash_groups(docs: DataFrame, words: int = 4, radius: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) per row of ``docs``: 16 hex digits, and the smallest id reachable
    over links of fingerprints that differ in at most ``radius`` bits (0 to 64).

    Shingles of ``words`` words count as often as they stand; a text of fewer words is one shingle.
    Null, empty and blank texts have fingerprint zero, which is linked like any other.  Very long texts
    are hashed whole, in parts.  Rows without an id take part but name no component (null where all
    are such); repeated rows stay; further columns do not matter; no rows give no rows.
    """
    made = cut_lineage(with_fingerprint(docs, words, id_col, text_col))
    names = cut_lineage(made.groupBy("bits").agg(F.min("doc_id").alias("_name")))  # copies are one from here
    labels = component_labels(cut_lineage(near_fingerprints(names.select("bits"), radius).distinct()))
    named = names.join(labels.withColumnRenamed("node", "bits"), "bits", "left").withColumn("component", F.coalesce("component", "bits"))
    of = cut_lineage(named.join(named.groupBy("component").agg(F.min("_name").alias("component_id")), "component").select("bits", "component_id"))
    return made.join(of, "bits", "left").select("doc_id", F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")
