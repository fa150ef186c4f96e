"""Reading the corpus tables and moving them through Arrow tasks in slices of bounded size."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 1 << 20
SLICE_ROWS = 2048
BATCH_BYTES = 4 << 20
CHUNKS = 64  # parts of a table of counters that are summed apart

# Odd multipliers of the hashes (any odd constants would do).
WORD_STEP = 0x9E3779B97F4A7C15
WORD_STEP_INVERSE = pow(WORD_STEP, -1, 1 << 64)
MIX_1, MIX_2 = 0xBF58476D1CE4E5B9, 0x94D049BB133111EB

# Words: runs of anything but space and the bytes 9 to 13; LOWER puts A-Z in lower case.
WHITE = np.zeros(256, bool)
WHITE[[32, *range(9, 14)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive parts of a batch of at most ``rows`` rows whose ``column`` holds about ``limit``
    bytes (one row at least), so that working arrays stay small however long or many the texts are."""
    if batch.num_rows == 0:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start = size = 0
    for i, n in enumerate(lengths):
        if i > start and (size + n > limit or i - start == rows):
            yield batch.slice(start, i - start)
            start, size = i, 0
        size += n
    yield batch.slice(start)


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``df.mapInArrow`` with batches of a few megabytes: the session's limit is lowered to
    ``BATCH_BYTES`` if it is higher, as rows of long texts would else fill executors with batches.
    A worker gives freed memory back at the end of a task, for it stays for the next one."""
    key, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    if not 0 < int(re.sub(r"\D", "", conf.get(key))) <= BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if sys.platform == "linux":
            ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(tidy, schema)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null reads as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def crc_fold(column: str, folds: int) -> Column:
    """crc32 of an id written as text, modulo ``folds``; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def bytes_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    """The texts of a batch as UTF-8; null reads as empty."""
    return [x or b"" for x in batch.column(column).cast(pa.binary()).to_pylist()]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX_1)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX_2)
    return h ^ (h >> np.uint64(31))


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the word multiplier and of its inverse modulo 2**64."""
    out = []
    for m in (WORD_STEP, WORD_STEP_INVERSE):
        p = np.full(n, m, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def word_hashes(texts: list[bytes], lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all words of the texts, in order.  A word's hash is a polynomial of its bytes,
    cut out of one running sum over all texts."""
    ends = np.cumsum([len(t) + 1 for t in texts])
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    if lower:
        raw = LOWER[raw]
    white = WHITE[raw]
    first = np.flatnonzero(~white & np.r_[True, white[:-1]])
    last = np.flatnonzero(~white & np.r_[white[1:], True]) + 1
    up, down = _powers(1 << max(16, int(len(raw)).bit_length()))
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    word = mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))
    return np.searchsorted(ends, first, side="right"), word


def _packed(numbers: np.ndarray) -> bytes:
    """Integers in the fewest bytes that hold the largest of them (its width in front), deflated."""
    width = next(w for w in (1, 2, 4, 8) if w == 8 or np.abs(numbers).max(initial=0) < 1 << (8 * w - 1))
    return bytes([width]) + zlib.compress(numbers.astype(f"<i{width}").tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(data[1:]), f"<i{data[0]}").astype(np.int64)


def summed_over_tasks(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], size: int) -> np.ndarray:
    """Sum over all tasks of the ``size`` integers that ``count`` makes of a task's batches.  Tasks
    send their numbers in chunks, further tasks add those up, and one table of fixed size reaches
    the driver."""
    width = -(-size // CHUNKS)
    schema = "chunk int, numbers binary"

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.asarray(count(batches), np.int64)
        for c in range(CHUNKS):
            part = total[c * width : (c + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([_packed(part)], pa.binary())], names=["chunk", "numbers"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("numbers").to_pylist(), strict=True):
                part = _unpacked(x)
                sums[c] = sums[c] + part if c in sums else part
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([_packed(x) for x in sums.values()], pa.binary())], names=["chunk", "numbers"])

    out = np.zeros(size, np.int64)
    for r in map_arrow(map_arrow(rows, send, schema).repartition(CHUNKS, "chunk"), add, schema).collect():
        part = _unpacked(r["numbers"])
        out[r["chunk"] * width : r["chunk"] * width + len(part)] += part
    return out


def labelled_sample(labels: DataFrame, label: str, held: Column, per_class: dict[int, int], id_col: str = "doc_id") -> DataFrame:
    """(doc_id, label, bits): at most so many labelled ids of each class, none held out.  The ids with
    the smallest hashes are taken, so the sample does not hang on the order of rows; its size is the
    bound, whatever the tables."""
    fit = labels.select(F.col(id_col).alias("doc_id"), F.col(label).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    fit = fit.where(~held).distinct()
    parts = [fit.where(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for k, n in per_class.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("bits", F.shiftrightunsigned(F.xxhash64(F.lit(7), "doc_id"), 20))
