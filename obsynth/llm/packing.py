"""Vector bin packing of token pieces into training sequences.

Every sequence has three limits: tokens, segments and loss-bearing tokens.  A task keeps a bounded
window of waiting pieces and fills one sequence at a time: of the pieces that fit, the one with the
largest dot product of its demand (scaled by capacity and by how scarce each resource is in the
window) with what is left of the sequence goes in.  Where nothing fits and cutting is allowed, a
piece is cut to the room that is left, so sequences end full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import codec, default_vocabulary
from .common import map_arrow, slices, texts_of

END_ID = 0
SEQUENCE_BITS = 40  # sequence_id = partition << 40 | running number of the task


@dataclass(frozen=True)
class Limits:
    tokens: int = 1024
    segments: int = 64
    loss_tokens: int = 1024

    def vector(self) -> np.ndarray:
        return np.array([self.tokens, self.segments, self.loss_tokens], float)


@dataclass
class Piece:
    """A run of one example's tokens; ``loss`` of them bear loss (any run of it: ``loss_from`` on)."""

    key: object
    start: int
    length: int
    loss_from: int  # positions of the example from here on bear loss

    def loss(self, length: int | None = None) -> int:
        end = self.start + (self.length if length is None else length)
        return max(0, end - max(self.start, self.loss_from))


class SequencePacker:
    """Packs a stream of pieces; ``window`` bounds what waits in memory."""

    def __init__(self, limits: Limits = Limits(), window: int = 256):
        self.limits, self.cap, self.window = limits, limits.vector(), window
        self.pieces: list[Piece | None] = [None] * window
        self.demand = np.zeros((window, 3))
        self.free = list(range(window))
        self.sequences = 0

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        """Takes one piece; yields the sequences that became ready."""
        while piece.length >= self.limits.tokens and self._whole(piece):
            yield [self._cut(piece, self.limits.tokens)]
        if not piece.length:
            return
        slot = self.free.pop()
        self.pieces[slot] = piece
        self.demand[slot] = self._vector(piece)
        if not self.free:
            while len(self.free) < self.window // 2:
                yield from self._tail(self._fill())

    def finish(self) -> Iterator[list[Piece]]:
        while len(self.free) < self.window:
            yield from self._tail(self._fill())

    def _whole(self, p: Piece) -> bool:
        return p.loss(self.limits.tokens) <= self.limits.loss_tokens and self.limits.segments >= 1

    def _vector(self, p: Piece) -> np.ndarray:
        return np.array([p.length, 1, p.loss()], float) / self.cap

    @staticmethod
    def _cut(p: Piece, n: int) -> Piece:
        head = Piece(p.key, p.start, n, p.loss_from)
        p.start, p.length = p.start + n, p.length - n
        return head

    def _take(self, slot: int) -> Piece:
        p = self.pieces[slot]
        self.pieces[slot] = None
        self.demand[slot] = 0
        self.free.append(slot)
        return p

    def _fill(self) -> list[Piece]:
        left, out = np.ones(3), []
        scarce = self.demand.sum(0)  # total demand: a resource much asked for weighs more
        used = np.array([p is not None for p in self.pieces])
        while used.any() and left[0] > 0 and left[1] * self.cap[1] > 0.5:
            fits = used & (self.demand <= left + 1e-12).all(1)
            if fits.any():
                slot = int(np.argmax(np.where(fits, self.demand @ (scarce * left), -1)))
                used[slot] = False
                left = left - self.demand[slot]
                out.append(self._take(slot))
            else:
                slot = int(np.argmax(np.where(used, self.demand[:, 0], -1)))
                p = self.pieces[slot]
                room, loss = round(left[0] * self.cap[0]), round(left[2] * self.cap[2])
                n = min(room, p.length, max(0, p.loss_from - p.start) + loss)
                if n <= 0:
                    break
                out.append(self._cut(p, n))
                left = left - np.array([n, 1, out[-1].loss()]) / self.cap
                self.demand[slot] = self._vector(p)
                break
            left = np.round(left * self.cap) / self.cap
        return out

    def _tail(self, seq: list[Piece]) -> Iterator[list[Piece]]:
        """A sequence that stayed short is cut at powers of two, which need no padding."""
        total = sum(p.length for p in seq)
        while total and total != self.limits.tokens:
            part, room = [], 1 << (total.bit_length() - 1)
            total -= room
            while room:
                p = seq[0]
                n = min(room, p.length)
                part.append(self._cut(p, n))
                room -= n
                if not p.length:
                    seq.pop(0)
            yield part
        if seq:
            yield seq


def pack_stream(examples: Iterable[tuple[object, int, int]], limits: Limits = Limits(), window: int = 256) -> Iterator[list[Piece]]:
    """Sequences (lists of pieces in order) of examples given as (key, tokens, first loss position)."""
    packer = SequencePacker(limits, window)
    for key, n, loss_from in examples:
        yield from packer.add(Piece(key, 0, n, loss_from))
    yield from packer.finish()


def turn_loss_start(role: Column, text: Column) -> Column:
    """Loss start of a conversation's turn as an example: what the assistant says bears loss, no token of
    other turns does."""
    return F.when(role == "assistant", 0).otherwise(F.char_length(F.coalesce(text, F.lit(""))) + 1)


PACKED = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame,
    vocabulary: str | None = None,
    limits: Limits = Limits(),
    window: int = 256,
    id_col: str = "doc_id",
    text_col: str = "text",
    with_ids: bool = False,
    loss_col: str | None = None,
) -> DataFrame:
    """One row per piece of a document (its token ids and a closing id 0) with its place in a sequence.

    Encoding and packing happen in the task that reads the text: no token is shuffled, and each task
    leaves at most a few short sequences of power-of-two length.  Ids of sequences hold the partition
    number, so they are unique and the same when a lost task runs again.  ``loss_col`` tells how many
    characters of the text (a prompt) bear no loss: both parts are encoded apart, the closing id bears
    loss unless the number exceeds the text's length, and a column ``loss_tokens`` counts those of the
    piece.  Without it (or where it is null) every token bears loss.  A null text is empty (one piece, the closing id), a very long one is cut
    into as many pieces as it needs; repeated rows and null ids
    are packed as they come; further columns are dropped; an empty table gives no rows.
    """
    path = vocabulary or default_vocabulary()
    start = F.coalesce(docs[loss_col], F.lit(0)).cast("long") if loss_col else F.lit(0).cast("long")
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), start.alias("loss_start"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {PACKED}" + (", ids binary" if with_ids else "") + (", loss_tokens long" if loss_col else "")
    kind = pa.int64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, packer = codec(path), SequencePacker(limits, window)
        base = TaskContext.get().partitionId() << SEQUENCE_BITS
        made = 0
        rows_out: list[tuple] = []
        id_type = pa.int64()

        def emit(sequences: Iterator[list[Piece]]) -> None:
            nonlocal made
            for seq in sequences:
                offset = 0
                for p in seq:
                    doc_id, ids = p.key
                    own = ids[4 * p.start : 4 * (p.start + p.length)]
                    rows_out.append((doc_id, p.start, p.length, zlib.crc32(own), len(ids) // 4, base | made, offset) + ((own,) if with_ids else ()) + ((p.loss(),) if loss_col else ()))
                    offset += p.length
                made += 1

        def flush() -> pa.RecordBatch:
            types = [id_type, *[kind] * 6] + ([pa.binary()] if with_ids else []) + ([kind] if loss_col else [])
            cols = list(zip(*rows_out, strict=True)) or [()] * len(types)
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + (["ids"] if with_ids else []) + (["loss_tokens"] if loss_col else [])
            rows_out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, types, strict=True)], names=names)

        for big in batches:
            id_type = big.schema.field("doc_id").type
            for b in slices(big, "text"):
                texts, starts = texts_of(b), b.column("loss_start").to_pylist()
                prompts = c.encode_batch([t[: max(0, k)] for t, k in zip(texts, starts, strict=True)]) if loss_col else [b""] * len(texts)
                answers = c.encode_batch([t[max(0, k) :] for t, k in zip(texts, starts, strict=True)] if loss_col else texts)
                for doc_id, text, k, prompt, answer in zip(b.column("doc_id").to_pylist(), texts, starts, prompts, answers, strict=True):
                    ids = prompt + answer + END_ID.to_bytes(4, "little")
                    emit(packer.add(Piece((doc_id, ids), 0, len(ids) // 4, (len(prompt) + 4 * (k > len(text))) // 4)))
                yield flush()
        emit(packer.finish())
        yield flush()

    return map_arrow(rows, run, schema)
