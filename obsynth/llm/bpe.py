"""Byte-level byte-pair encoding and decoding in batched numpy merge rounds.

The words of a batch lie in one flat array of symbols.  A round looks up the rank of every adjacent
pair by binary search in the sorted pair keys (pairs of single bytes in a table made so), finds the lowest rank of each word and merges its
occurrences from left to right; only pairs beside a merge are looked up again, and words without a
mergeable pair leave the arrays.  Words already met are kept in a bounded cache of the task.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import map_arrow, slices, texts_of

# Fixed value: the public pre-tokenization pattern of the byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same cut for texts of ASCII and Latin-1 letters alone, where plain classes say the same.
PLAIN = r"[\t-\r -~À-ÖØ-öø-ÿ]*"
PLAIN_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ÿ0-9]+|\s+(?!\S)|\s+"
CACHE_WORDS = 300_000
NO_RANK = np.iinfo(np.int32).max

ENCODED = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in vocabulary files: itself if it is a visible
    Latin-1 character, else the next free code point from 256 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in visible else next(spare)) for b in range(256)]


class BytePairCodec:
    """Encoder and decoder of one vocabulary file (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.byte_ids = np.array([vocab[c] for c in letters], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        keys = np.array([vocab[a] << 20 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces = {i: bytes(byte_of[c] for c in t) for t, i in vocab.items()}
        pieces.update({i: t.encode() for t, i in self.special.items()})
        n = max(pieces) + 1
        self.pieces = np.array([pieces.get(i, b"") for i in range(n)], object)
        self.piece_len = np.array([len(x) for x in self.pieces], np.int64)
        self.piece_at = np.cumsum(self.piece_len) - self.piece_len
        self.piece_bytes = np.frombuffer(b"".join(self.pieces), np.uint8)
        self.split_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.is_plain, self.plain_words = re.compile(PLAIN).fullmatch, re.compile(PLAIN_PATTERN).findall
        self.any_words = regex.compile(PATTERN).findall
        first = np.arange(256)
        self.first_ranks = self.rank_of(*(x.ravel() for x in np.meshgrid(self.byte_ids[first], self.byte_ids[first], indexing="ij")))
        self.cache: dict[str, bytes] = {}

    def words(self, text: str) -> list[str]:
        return self.plain_words(text) if self.is_plain(text) else self.any_words(text)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left.astype(np.int64) << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_RANK)

    def merge_words(self, words: list[bytes]) -> list[bytes]:
        """Token ids (little-endian unsigned 32-bit) of each word, all words merged together."""
        if not words:
            return []
        lens = np.fromiter(map(len, words), np.int64, len(words))
        raw = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.byte_ids[raw], np.repeat(np.arange(len(words)), lens)
        rank = np.full(len(sym), NO_RANK, np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.first_ranks[raw[inner].astype(np.int32) << 8 | raw[inner + 1]]
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            low = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(sym)])
            live = np.repeat(low != NO_RANK, sizes)
            if not live.all():
                done_sym.append(sym[~live])
                done_word.append(word[~live])
                low = np.repeat(low, sizes)[live]
                sym, word, rank = sym[live], word[live], rank[live]
            else:
                low = np.repeat(low, sizes)
            at = np.flatnonzero(rank == low)
            # in a run of overlapping occurrences (aaa) every second one merges, from the left
            head = np.r_[True, (at[1:] != at[:-1] + 1) | (word[at[1:]] != word[at[:-1]])] if len(at) else np.empty(0, bool)
            first = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.zeros(len(sym), bool)
            moved[at] = True
            sym, word, rank, moved = sym[keep], word[keep], rank[keep], moved[keep]
            again = np.flatnonzero(moved | np.r_[moved[1:], False])
            rank[again] = NO_RANK
            inner = again[again + 1 < len(sym)]
            inner = inner[word[inner] == word[inner + 1]]
            rank[inner] = self.rank_of(sym[inner], sym[inner + 1])
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        sym = sym[np.argsort(word, kind="stable")].astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(word, minlength=len(words)))
        return [sym[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.  The vocabulary's special
        strings become their ids; everything else is cut into words by the public pattern."""
        cut, fresh = [], set()
        for text in texts:
            parts = self.split_special.split(text) if self.split_special else [text]
            cut.append([p if p in self.special else self.words(p) for p in parts])
            for p in cut[-1]:
                if isinstance(p, list):
                    fresh.update(p)
        if len(self.cache) + len(fresh) > CACHE_WORDS:
            self.cache.clear()
        new = [w for w in fresh if w not in self.cache]
        self.cache.update(zip(new, self.merge_words([w.encode() for w in new]), strict=True))
        get = self.cache.__getitem__
        return [b"".join(b"".join(map(get, p)) if isinstance(p, list) else self.special[p].to_bytes(4, "little") for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """Text of ids; bytes that are no UTF-8 become the replacement character."""
        i = np.frombuffer(ids, "<u4")
        return b"".join(self.pieces[i].tolist()).decode("utf-8", "replace")


@functools.cache
def codec(path: str) -> BytePairCodec:
    """One codec a Python worker; the file is read where the task runs."""
    return BytePairCodec(path)


def encode_decode(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``docs``: id, number of tokens, digest of the ids, digest of the decoded text.

    A null text reads as empty (no tokens, digests of the empty string), very long ones are encoded whole; repeated rows, null ids and
    further columns are allowed, the latter are dropped.  An empty table gives an empty result.
    """
    path = vocabulary or default_vocabulary()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {ENCODED}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for big in batches:
            for b in slices(big, "text"):
                ids = c.encode_batch(texts_of(b))
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"),
                        pa.array([len(x) // 4 for x in ids], pa.int64()),
                        pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                        pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                    ],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return map_arrow(rows, run, schema)
