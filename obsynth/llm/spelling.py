"""Words one edit apart, by blocked Gram matrices of letter counts.

Words are blocked by the counts of their letters in ``GROUPS`` classes (which add up to the length).
An edit moves one unit between classes or adds one, so a block meets only itself and its adjacent
blocks.  A task multiplies the letter-count matrices of two blocks: squared distances follow from the
Gram matrix, one edit never makes more than two, and the few pairs that pass are compared letter by
letter.  Tasks report counts and the best neighbour of each word, never the pairs.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow

GROUPS = 5  # classes of letters: code point modulo this
TILE_WORDS = 1024  # of one side of a product
TILE_CHARS = 1 << 18
LETTERS = "A-Za-zÀ-ÿ"
COMPARED = 1 << 20  # letters of pairs compared at once


def lower_ascii(c: Column) -> Column:
    """A-Z alone in lower case (the JVM's fast path where the text holds nothing but ASCII)."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, string.ascii_uppercase, string.ascii_lowercase))


def letter_runs(docs: DataFrame, least: int, text_col: str = "text") -> DataFrame:
    """``docs`` without the text, a row for each maximal run of letters of at least ``least`` code
    points, lower-cased, as ``run``.  Null and empty texts have none."""
    other = [F.col(f"`{c}`") for c in docs.columns if c not in (text_col, "run")]
    found = docs.select(*other, F.explode(F.split(F.col(text_col), f"[^{LETTERS}]+")).alias("run"))
    return found.where(F.char_length("run") >= least).withColumn("run", lower_ascii(F.col("run")))


def misspelt(runs: DataFrame, one_in: int, id_col: str = "doc_id") -> DataFrame:
    """``runs`` where one in ``one_in`` pairs of document and run lost a letter, chosen by crc32."""
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.col("run"))
    h, size = F.crc32(named.cast("binary")), F.char_length("run")
    at = (h % size).cast("int")
    cut = F.concat(F.substr("run", F.lit(1), at), F.substr("run", at + 2, size))
    return runs.withColumn("run", F.when(h % one_in == 0, cut).otherwise(F.col("run")))


def word_counts(runs: DataFrame, least_chars: int, least: int) -> DataFrame:
    """(word, n) of the runs that are long and frequent enough."""
    found = runs.where(F.char_length("run") >= least_chars).groupBy(F.col("run").alias("word")).agg(F.count(F.lit(1)).alias("n"))
    return found.where(F.col("n") >= least)


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size)


def with_cells(words: DataFrame) -> DataFrame:
    """(word, n, cell): counts of the letters in each class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("word").to_pylist()
            size = np.array([len(t) for t in texts], np.int64)
            group = _codes(["".join(texts)], int(size.sum()))[0].astype(np.int64) % GROUPS
            count = np.bincount(np.repeat(np.arange(len(texts)), size) * GROUPS + group, minlength=len(texts) * GROUPS)
            cell = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * GROUPS, pa.int32()), pa.array(count, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("word"), b.column("n"), cell], names=["word", "n", "cell"])

    return map_arrow(words.select("word", "n"), run, "word string, n long, cell array<int>")


def _homes() -> list[tuple[int, ...]]:
    """What to add to a block's cell for the cells that it is compared at: its own, half of those of
    equal length (the other half compares the other way round), and those one letter shorter."""
    out, unit = [(0,) * GROUPS], np.eye(GROUPS, dtype=int)
    for i in range(GROUPS):
        out.append(tuple((-unit[i]).tolist()))
        out += [tuple((unit[i] - unit[j]).tolist()) for j in range(i + 1, GROUPS)]
    return out


def close_pairs(x: list[str], y: list[str], same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Places (i, j) of the words of ``x`` and ``y`` one edit apart.  All of ``x`` have one length, all of
    ``y`` that length or one more; with ``same`` both are one block, and i < j."""
    size, longer = len(x[0]), len(y[0]) - len(x[0])
    a, b = _codes(x, size), _codes(y, size + longer)
    alphabet = np.unique(np.concatenate([np.unique(a), np.unique(b)]))
    kind = np.float32 if (size + 1) ** 2 < 1 << 22 else np.float64  # of exact sums

    def counts(codes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(alphabet, codes) + np.arange(len(codes))[:, None] * len(alphabet)
        return np.bincount(at.ravel(), minlength=len(codes) * len(alphabet)).reshape(len(codes), -1).astype(kind)

    u, v = counts(a), counts(b)
    norm_u, norm_v = (u * u).sum(1), (v * v).sum(1)
    i, j = np.nonzero(u @ v.T * -2 + norm_u[:, None] + norm_v[None] <= 2)
    if same:
        i, j = i[i < j], j[i < j]
    near = np.zeros(len(i), bool)
    step = max(1, COMPARED // (size + 1))
    for k in range(0, len(i), step):
        p, q = a[i[k : k + step]], b[j[k : k + step]]
        if not longer:
            near[k : k + step] = (p != q).sum(1) == 1
            continue
        front = np.logical_and.accumulate(p == q[:, :-1], axis=1).sum(1)
        back = np.logical_and.accumulate((p == q[:, 1:])[:, ::-1], axis=1).sum(1)
        near[k : k + step] = front + back >= size
    return i[near], j[near]


def _best(words: list[str], n: np.ndarray, own: np.ndarray, other: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """For each word (place ``own``) with partners: its place, their number and the place of the best,
    which has the largest n and of those the smallest word."""
    order = sorted(range(len(words)), key=lambda k: (-n[k], words[k]))
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    top = np.full(size, len(words))
    np.minimum.at(top, own, rank[other])
    count = np.bincount(own, minlength=size)
    for k in np.flatnonzero(count).tolist():
        yield k, int(count[k]), order[top[k]]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, form, form_n) of every word with a word one edit away: how many there are, and
    the most frequent (of equal ones the smallest) with its count."""
    cells = cut_lineage(with_cells(words))
    sizes = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.char_length("word")).alias("_chars"))
    tiles = F.greatest(F.ceil(F.col("_n") / TILE_WORDS), F.ceil(F.col("_chars") / TILE_CHARS)).cast("int")
    sizes = cut_lineage(sizes.select("cell", tiles.alias("tiles")))
    part = F.pmod(F.xxhash64("word"), F.col("tiles")).cast("int").alias("part")
    blocks = cut_lineage(cells.join(sizes, "cell").groupBy("cell", part).agg(F.collect_list(F.struct("word", "n")).alias("words")))

    moves = F.array(*(F.array(*(F.lit(x) for x in m)) for m in _homes()))
    at = blocks.select("cell", "part", F.col("words").alias("y"), F.explode(moves).alias("move"))
    at = at.withColumn("home", F.zip_with("cell", "move", lambda c, m: c + m)).where(F.array_min("home") >= 0)
    at = at.join(sizes.select(F.col("cell").alias("home"), "tiles"), "home")
    own = F.col("home") == F.col("cell")
    last = F.when(own, F.col("part")).otherwise(F.col("tiles") - 1)  # a block meets each pair of its own parts once
    at = at.select("home", F.explode(F.sequence(F.lit(0), last)).alias("seat"), "y", (own & (F.col("seat") == F.col("part"))).alias("same"))
    seats = blocks.select(F.col("cell").alias("home"), F.col("part").alias("seat"), F.col("words").alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for r in range(big.num_rows):
                x, y = big.column("x")[r].values, big.column("y")[r].values
                side = [(s.field("word").to_pylist(), s.field("n").to_numpy(zero_copy_only=False)) for s in (x, y)]
                (wx, nx), (wy, ny) = side
                i, j = close_pairs(wx, wy, big.column("same")[r].as_py())
                if not len(i):
                    continue
                found = [(wx[k], c, int(ny[m]), wy[m]) for k, c, m in _best(wy, ny, i, j, len(wx))]
                found += [(wy[k], c, int(nx[m]), wx[m]) for k, c, m in _best(wx, nx, j, i, len(wy))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["word", "k", "form_n", "form"])

    pairs = seats.join(at.withColumn("same", F.coalesce("same", F.lit(False))), ["home", "seat"]).select("x", "y", "same")
    found = map_arrow(pairs, run, "word string, k long, form_n long, form string")
    best = F.min(F.struct((-F.col("form_n")).alias("m"), F.col("form")))
    return found.groupBy("word").agg(F.sum("k").alias("n_near"), best.alias("b")).select("word", "n_near", F.col("b.form").alias("form"), (-F.col("b.m")).alias("form_n"))


def _roots(links: DataFrame) -> DataFrame:
    """(word, root): the last form that (word, form) leads to.  Each round doubles the reach; counts
    grow along a path by the factor of a form, so paths are short."""
    hop = cut_lineage(links.select("word", F.col("form").alias("root")))
    while True:
        on = hop.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        hop = cut_lineage(hop.join(on, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")))
        if hop.where("_moved").isEmpty():
            return hop.select("word", "root")
        hop = hop.drop("_moved")


def spelling_variants(words: DataFrame, factor: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) per row of the word counts (word, n).

    ``n_near`` counts the words that one inserted, deleted or replaced code point apart; ``form`` is the one
    of largest ``n`` (ties: the smallest in code-point order) if its ``form_n`` is at least ``factor`` times
    the word's, else both are null; ``root`` is what forms lead to at last, the word itself without one.
    Words have to be distinct; null and empty words are left out, further columns do not matter,
    words of any length are compared whole, and no rows give no rows.
    """
    words = cut_lineage(words.select("word", F.col("n").cast("long").alias("n")).where("word <> '' and n is not null"))
    near = words.join(near_words(words), "word", "left")
    fits = F.col("form_n") >= factor * F.col("n")
    out = cut_lineage(near.select("word", F.when(fits, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("form_n")).alias("form_n")))
    roots = _roots(out.where("form is not null"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
