"""Lossless PNG columns: writing, checked reading and low-frequency cosine-transform hashes.

A payload of bytes becomes an 8-bit colour image of fixed width.  Reading walks the chunks, tests
every checksum, inflates the data and undoes the row filters in numpy.  The hash is computed in
integers, so equal images have equal hashes on every machine.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from .common import map_arrow, slices, texts_of

# Fixed values of the PNG format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS_OF_COLOUR_TYPE = {0: 1, 2: 3, 4: 2, 6: 4}

WIDTH, CHANNELS = 64, 3
UNIT = WIDTH * CHANNELS
LEVEL = 4
GRID, KEPT = 32, 8
COSINE_SCALE = 1 << 10


class BadPng(ValueError):
    """The bytes are no PNG of the kinds read here, or a checksum fails."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def filter_rows(rows: np.ndarray, step: int) -> np.ndarray:
    """Rows with their filter byte in front: none, left or above, whichever has the smallest sum of
    signed magnitudes in that row (the first on ties)."""
    left = rows.copy()
    left[:, step:] -= rows[:, :-step]
    above = rows.copy()
    above[1:] -= rows[:-1]
    options = (rows, left, above)
    cost = np.stack([np.minimum(x, 0 - x).sum(1, dtype=np.int64) for x in options])
    kind = cost.argmin(0).astype(np.uint8)
    out = np.empty((len(rows), rows.shape[1] + 1), np.uint8)
    out[:, 0] = kind
    out[:, 1:] = np.choose(kind[:, None], options)
    return out


def unfilter_rows(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undoes the five row filters; runs of rows with the same simple filter at once."""
    out = np.empty_like(rows)
    edges = np.flatnonzero(np.r_[True, kinds[1:] != kinds[:-1], True]) if len(kinds) else np.zeros(1, int)
    zero = np.zeros(rows.shape[1], np.uint8)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        prior = out[a - 1] if a else zero
        kind = kinds[a]
        if kind == 0:
            out[a:b] = rows[a:b]
        elif kind == 1:
            out[a:b] = rows[a:b].reshape(b - a, -1, step).cumsum(1, dtype=np.uint8).reshape(b - a, -1)
        elif kind == 2:
            out[a:b] = np.vstack([prior[None], rows[a:b]]).cumsum(0, dtype=np.uint8)[1:]
        elif kind in (3, 4):
            for y in range(a, b):
                out[y] = _unpredict(rows[y], out[y - 1] if y else zero, step, paeth=kind == 4)
        else:
            raise BadPng(f"row filter {kind}")
    return out


def _unpredict(row: np.ndarray, above: np.ndarray, step: int, paeth: bool) -> np.ndarray:
    """One row of the average or Paeth filter: each pixel needs the one before it."""
    raw, up = row.reshape(-1, step).astype(np.int32), above.reshape(-1, step).astype(np.int32)
    out = np.empty_like(raw)
    a = c = np.zeros(step, np.int32)
    for x in range(len(raw)):
        b = up[x]
        if paeth:
            p = a + b - c
            pa_, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
        else:
            guess = (a + b) >> 1
        a = out[x] = (raw[x] + guess) & 255
        c = b
    return out.astype(np.uint8).ravel()


def write_png(payload: bytes, level: int = LEVEL) -> bytes:
    """An RGB image of width 64 whose samples are the payload (a positive multiple of 192 bytes)."""
    if not payload or len(payload) % UNIT:
        raise ValueError("the payload must be a positive multiple of 192 bytes")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, UNIT)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(rows, CHANNELS).tobytes(), level)) + _chunk(b"IEND", b"")


def read_png(data: bytes) -> np.ndarray:
    """Samples (height, width, channels) of an 8-bit, non-interlaced PNG; BadPng if anything is wrong."""
    if data[:8] != SIGNATURE:
        raise BadPng("no signature")
    at, head, packed, ended = 8, None, [], False
    while not ended:
        if at + 12 > len(data):
            raise BadPng("a chunk is cut off")
        n, kind = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(data):
            raise BadPng("a chunk is cut off")
        if zlib.crc32(body, zlib.crc32(kind)) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise BadPng(f"checksum of {kind.decode('latin-1')}")
        at += 12 + n
        if kind == b"IHDR":
            if n != 13:
                raise BadPng("header length")
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        elif kind == b"IEND":
            ended = True
        elif kind[:1].isupper():
            raise BadPng(f"unread critical chunk {kind.decode('latin-1')}")
    if head is None or not packed:
        raise BadPng("header or data are missing")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or colour not in CHANNELS_OF_COLOUR_TYPE or interlaced or not width or not height:
        raise BadPng("only 8-bit samples without interlacing or palette are read")
    step = CHANNELS_OF_COLOUR_TYPE[colour]
    size = height * (width * step + 1)
    box = zlib.decompressobj()
    try:
        raw = box.decompress(b"".join(packed), size)
    except zlib.error as e:
        raise BadPng(str(e)) from e
    if len(raw) != size or (box.unconsumed_tail and box.decompress(box.unconsumed_tail, 1)):
        raise BadPng("data of another size than the header says")
    rows = np.frombuffer(raw, np.uint8).reshape(height, -1)
    return unfilter_rows(rows[:, 0], rows[:, 1:], step).reshape(height, width, step)


@functools.cache
def _cosines() -> np.ndarray:
    k, x = np.arange(KEPT)[:, None], np.arange(GRID)[None, :]
    return np.rint(COSINE_SCALE * np.cos(np.pi * (2 * x + 1) * k / (2 * GRID))).astype(np.int64)


@functools.lru_cache(1024)
def _reduce(n: int) -> np.ndarray:
    """(KEPT, n): shares of n samples in GRID equal cells, times the cosines of the cells."""
    cell, at = np.arange(GRID)[:, None], np.arange(n)[None, :]
    share = np.minimum((cell + 1) * n, (at + 1) * GRID) - np.maximum(cell * n, at * GRID)
    return _cosines() @ np.maximum(share, 0)


def cosine_hash(image: np.ndarray) -> bytes:
    """Eight bytes: the signs of the 8 x 8 lowest cosine frequencies of the grey image on a 32 x 32
    grid, each against the median of all but the constant one."""
    grey = image.sum(2, dtype=np.int64)
    low = (_reduce(grey.shape[0]) @ grey @ _reduce(grey.shape[1]).T).ravel()
    return np.packbits(low > np.sort(low[1:])[31]).tobytes()


def payload_of(text: str) -> tuple[int, bytes]:
    """UTF-8 length of a text, and its bytes filled with spaces to a positive multiple of 192."""
    raw = text.encode()
    return len(raw), raw + b" " * (UNIT - len(raw) if not raw else -len(raw) % UNIT)


def texts_to_png(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = LEVEL) -> DataFrame:
    """(doc_id, n_bytes, media): every text as a PNG column.  Null and empty texts become one row of
    spaces, very long ones a tall picture; ids may be null or repeat; further columns are dropped; no rows
    give no rows."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, "text"):
                made = [payload_of(x) for x in texts_of(b)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([write_png(p, level) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    return map_arrow(rows, run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


FEATURES = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, feature string, error string"


def png_features(stored: DataFrame, media_col: str = "media") -> DataFrame:
    """Reads stored PNGs back: adds size and digests of samples and file, the cosine hash (binary,
    and as hexadecimal ``feature``) and ``error`` (null if the file is sound; else the other new
    columns but those of the file are null).  A null file counts as unsound.  The media column goes;
    all others stay, and one that has a new column's name is replaced."""
    fresh = [x.split()[0] for x in FEATURES.split(", ")]
    kept = [c for c in stored.columns if c != media_col and c not in fresh]
    rows = stored.select(*kept, stored[media_col].alias(media_col))
    schema = StructType([*(rows.schema[c] for c in kept), *StructType.fromDDL(FEATURES).fields])

    def one(data: bytes | None) -> tuple:
        if data is None:
            return (*[None] * 7, "no file")
        file = len(data), hashlib.sha256(data).hexdigest()
        try:
            image = read_png(data)
        except BadPng as e:
            return (*[None] * 3, *file, None, None, str(e))
        samples = image.tobytes()
        code = cosine_hash(image)
        return (len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), *file, code, code.hex(), None)

    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in slices(big, media_col):
                made = list(zip(*map(one, b.column(media_col).to_pylist()), strict=True))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), *(pa.array(x, t) for x, t in zip(made, kinds, strict=True))], names=[*kept, *fresh])

    return map_arrow(rows, run, schema)
