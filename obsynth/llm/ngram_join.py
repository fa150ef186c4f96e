"""Jaccard self-join of documents on word n-grams by vertical partitioning of a global n-gram order.

1. All n-grams are counted into a fixed number of buckets; buckets by rising count (then hashes) are
   the global order, and equal shares of the counted mass cut it into fragments.
2. Each document's set is sorted in that order.  Two sets as similar as asked share an n-gram of
   their prefixes (the rarest n-grams), so prefixes alone are joined to find candidates.
3. Sizes, the first shared position and a parity bitmap (whose differing bits never exceed the
   differing n-grams) rule candidates out without loss.
4. For the rest every fragment counts its overlap separately; the sum per pair decides.

Copies with equal sets are one node throughout.  Candidates come in two steps so that a group of
thousands of near copies never becomes all its pairs: first every node meets the smallest and the
largest node of its n-grams, and links make components; then pairs of different components meet,
each node outside an n-gram's main component with that n-gram's nodes, unless both have met at an
n-gram just before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.graph import component_labels
from ..session import cut_lineage, discard
from .common import bytes_of, map_arrow, mix, slices, summed_over_tasks, word_hashes

BUCKETS = 1 << 21  # counters of the n-gram order; of fixed size, whatever the corpus
FRAGMENTS = 8
BITS = 1024  # of the parity bitmap
LANES = BITS // 64
SLOTS = 1 << 23  # bits that mark wanted documents, 1 MB
BITMAP_BYTES = 4096  # of one row that bitmap_construct_agg makes
TRIED_FIRST = 16  # one in so many of the pairs between components is tried before all others
SALT_ROWS = 4096  # nodes of one n-gram that stay together
BEFORE = 3  # earlier n-grams of a node that tell whether a pair has met already

GRAM_STEP = 0xC2B2AE3D27D4EB4F  # any odd constant would do


@dataclass(frozen=True)
class Similarity:
    """n-grams of ``words`` words; linked where ``percent`` of the union is shared."""

    words: int = 5
    percent: int = 80

    def prefix(self, n: np.ndarray) -> np.ndarray:
        """Sets linked with one of n elements share one of its first so many."""
        return n - -(-self.percent * n // 100) + 1

    def front(self, n: Column) -> Column:
        """The first n-gram that a set shares with a linked one of its size or larger is among so many."""
        return n - F.ceil(2 * self.percent * n / (100 + self.percent)) + 1

    def linked(self, n_a: Column, n_b: Column, both: Column) -> Column:
        return 100 * both >= self.percent * (n_a + n_b - both)

    def sizes_fit(self, n_a: Column, n_b: Column) -> Column:
        return 100 * F.least(n_a, n_b) >= self.percent * F.greatest(n_a, n_b)

    def least_overlap(self, n_a: Column, n_b: Column) -> Column:
        return F.ceil(self.percent * (n_a + n_b) / (100 + self.percent))


def gram_hashes(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of all n-grams of the texts; a text of fewer words is one n-gram."""
    row, word = word_hashes(texts, lower=True)
    count = np.bincount(row, minlength=len(texts))
    start = np.cumsum(count) - count

    def chain(at: np.ndarray, n: int) -> np.ndarray:
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(GRAM_STEP) + word[at + i]
        return mix(h)

    full = np.flatnonzero(row[: len(row) - words + 1] == row[words - 1 :]) if len(row) >= words else np.empty(0, int)
    rows, hashes = [row[full]], [chain(full, words)]
    for n in range(1, words):
        short = np.flatnonzero(count == n)
        rows.append(short)
        hashes.append(chain(start[short], n))
    return np.concatenate(rows), np.concatenate(hashes)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)


def count_grams(docs: DataFrame, words: int) -> np.ndarray:
    """How many n-grams of all texts fall into each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(BUCKETS, np.int64)
        for big in batches:
            for b in slices(big, "text"):
                total += np.bincount(_bucket(gram_hashes(bytes_of(b), words)[1]), minlength=BUCKETS)
        return total

    return summed_over_tasks(docs.select("text"), count, BUCKETS)


@dataclass(frozen=True)
class GramOrder:
    """Place of each bucket in the global order, its fragment, and over how many salts its n-grams
    are dealt (more than one where the count stands out of the mean)."""

    place: np.ndarray
    fragment: np.ndarray
    salts: np.ndarray

    @staticmethod
    def of(counts: np.ndarray) -> GramOrder:
        by = np.argsort(counts, kind="stable")
        place = np.empty(BUCKETS, np.int32)
        place[by] = np.arange(BUCKETS, dtype=np.int32)
        mass = np.cumsum(counts[by])
        fragment = np.zeros(BUCKETS, np.uint8)
        fragment[by] = np.minimum(FRAGMENTS - 1, mass * FRAGMENTS // max(1, int(mass[-1]) + 1))
        salts = 1 + np.maximum(0, counts - 4 * int(counts.mean() + 1)) // SALT_ROWS
        return GramOrder(place, fragment, salts.astype(np.int32))


def _sorted_sets(texts: list[bytes], words: int, order: GramOrder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, bucket) of the distinct n-grams of each text, in the global order."""
    row, h = gram_hashes(texts, words)
    bucket = _bucket(h)
    by = np.lexsort((h, order.place[bucket].astype(np.int64) | row.astype(np.int64) << 32))
    row, h, bucket = row[by], h[by], bucket[by]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])] if len(h) else np.empty(0, bool)
    return row[fresh], h[fresh], bucket[fresh]


SET_FIELDS = "node long, n int, tokens array<long>, salts array<int>, dealt array<boolean>, " + ", ".join(f"s{i} long" for i in range(LANES))


def _node_ids(h: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic hash of each sorted set."""
    raw = memoryview(h.tobytes())
    made = [hashlib.blake2b(raw[8 * a : 8 * (a + k)], digest_size=8).digest() if k else b"\0" * 8 for a, k in zip(start.tolist(), n.tolist(), strict=True)]
    return np.frombuffer(b"".join(made), np.int64)


def document_sets(docs: DataFrame, order, sim: Similarity) -> DataFrame:
    """One row per document (doc_id, text): node, size, prefix n-grams and parity bitmap.  Of equal
    sets within a task only the first has a prefix."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        o = order.value
        for big in batches:
            for b in slices(big, "text"):
                row, h, bucket = _sorted_sets(bytes_of(b), sim.words, o)
                n = np.bincount(row, minlength=b.num_rows)
                start = np.cumsum(n) - n
                node = _node_ids(h, start, n)
                fresh = np.array([k > 0 and not (x in seen or seen.add(x)) for x, k in zip(node.tolist(), n.tolist(), strict=True)], bool)
                keep = np.where(fresh, sim.prefix(n), 0)
                pos = np.arange(len(row)) - start[row]
                take = pos < keep[row]
                of = o.salts[bucket[take]]
                salt = (node[row[take]] & 0x7FFFFFFF) % of
                offsets = pa.array(np.r_[0, np.cumsum(keep)], pa.int32())
                cell = (h & np.uint64(BITS - 1)).astype(np.int64)
                parity = (np.bincount(row * BITS + cell, minlength=b.num_rows * BITS) & 1).astype(np.uint8)
                lanes = np.packbits(parity.reshape(b.num_rows, BITS), axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id"), pa.array(node), pa.array(n, pa.int32()),
                        pa.ListArray.from_arrays(offsets, pa.array(h[take].view(np.int64))), pa.ListArray.from_arrays(offsets, pa.array(salt.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(of > 1)),
                        *(pa.array(np.ascontiguousarray(lanes[:, i])) for i in range(LANES)),
                    ],
                    names=["doc_id", "node", "n", "tokens", "salts", "dealt", *(f"s{i}" for i in range(LANES))],
                )

    return map_arrow(docs, run, f"doc_id {id_type}, {SET_FIELDS}")


def _slot() -> Column:
    return F.pmod(F.xxhash64("doc_id"), F.lit(SLOTS))


def wanted_slots(ids: DataFrame) -> np.ndarray:
    """Bits of the slots that ids hash to; of fixed size, so it travels to every task."""
    slots = ids.where("doc_id is not null").select((_slot() + 1).alias("s"))  # these functions count from 1
    found = slots.groupBy(F.bitmap_bucket_number("s").alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("bits")).collect()
    out = np.zeros(SLOTS // 8, np.uint8)
    for r in found:
        at = (r["b"] - 1) * BITMAP_BYTES
        out[at : at + BITMAP_BYTES] = np.frombuffer(r["bits"], np.uint8)
    return out


def fragments_of(docs: DataFrame, wanted, order, sim: Similarity) -> DataFrame:
    """(node, grams): the sets of documents whose slot is wanted (or that have no id) as one array for
    each fragment of the order.  Texts are not shuffled; the caller drops the nodes it did not want."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        o, bits = order.value, wanted.value
        for big in batches:
            slot = big.column("slot").to_numpy(zero_copy_only=False)
            take = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool) | (slot < 0)
            for b in slices(big.filter(pa.array(take)), "text"):
                row, h, bucket = _sorted_sets(bytes_of(b), sim.words, o)
                n = np.bincount(row, minlength=b.num_rows)
                node = _node_ids(h, np.cumsum(n) - n, n)
                key = row * FRAGMENTS + o.fragment[bucket]  # rises with the order
                cuts = np.searchsorted(key, np.arange(b.num_rows * FRAGMENTS + 1))
                inner = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(h.view(np.int64)))
                outer = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * FRAGMENTS, pa.int32()), inner)
                yield pa.RecordBatch.from_arrays([pa.array(node), outer], names=["node", "grams"])

    slot = F.when(F.col("doc_id").isNull(), F.lit(-1)).otherwise(_slot())
    return map_arrow(docs.select(slot.alias("slot"), "text"), run, "node long, grams array<array<long>>")


def _ordered(a: Column, b: Column, n_a: Column, n_b: Column) -> list[Column]:
    swap = a > b
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b"), F.when(swap, n_b).otherwise(n_a).alias("n_a"), F.when(swap, n_a).otherwise(n_b).alias("n_b")]


def _by_bitmap(pairs: DataFrame, sigs: DataFrame, sim: Similarity) -> DataFrame:
    """Pairs whose parity bitmaps do not differ in more bits than linked sets may differ."""
    left = sigs.select(F.col("node").alias("a"), *(F.col(f"s{i}").alias(f"x{i}") for i in range(LANES)))
    right = sigs.select(F.col("node").alias("b"), *(F.col(f"s{i}").alias(f"y{i}") for i in range(LANES)))
    differ = sum((F.bit_count(F.col(f"x{i}").bitwiseXOR(F.col(f"y{i}"))) for i in range(LANES)), F.lit(0))
    most = F.col("n_a") + F.col("n_b") - 2 * sim.least_overlap(F.col("n_a"), F.col("n_b"))
    return pairs.join(left, "a").join(right, "b").where(differ <= most).select("a", "b", "n_a", "n_b")


def _verified(pairs: DataFrame, docs: DataFrame, people: DataFrame, order, sim: Similarity) -> DataFrame:
    """The pairs that are linked, as a table: overlaps are counted in every fragment and summed per pair.
    The table ``pairs`` and the sets read for it are deleted."""
    need = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    shown = people.where("shown").join(need, "node", "left_semi").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = docs.sparkSession.sparkContext.broadcast(wanted_slots(shown))  # of fixed size
    found = fragments_of(docs, wanted, order, sim)
    grams = cut_lineage(found.join(need, "node", "left_semi").dropDuplicates(["node"]))
    left, right = grams.select(F.col("node").alias("a"), F.col("grams").alias("x")), grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    shared = [F.size(F.array_intersect(F.get("x", F.lit(f)), F.get("y", F.lit(f)))).alias(f"o{f}") for f in range(FRAGMENTS)]
    parts = pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", *shared)
    both = sum((F.col(f"o{f}") for f in range(FRAGMENTS)), F.lit(0))
    out = cut_lineage(parts.where(sim.linked(F.col("n_a"), F.col("n_b"), both)).select("a", "b"))
    discard(pairs, grams)
    wanted.destroy()
    return out


def near_duplicates(docs: DataFrame, sim: Similarity = Similarity(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id) per row of ``docs``: size of the n-gram set and smallest id
    among the documents reachable over links.

    Null and empty texts and texts of white space have no n-gram and are linked with nothing; a text
    of fewer words than an n-gram is one n-gram, and very long texts are taken whole.  Further columns
    do not matter, whatever their names.  Rows without an id take part (their texts can link
    others) but name no component: a component of such rows alone is null.  Rows that repeat an id
    are judged by their own texts.  No rows, no result.
    """
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    spark = docs.sparkSession
    order = spark.sparkContext.broadcast(GramOrder.of(count_grams(docs, sim.words)))  # of fixed size
    sets = cut_lineage(document_sets(docs, order, sim))

    # prefix n-grams that more than one node holds, and all that are dealt over several salts: a node
    # alone in its salt may share the n-gram with the nodes of another one
    rows = sets.select("node", "n", F.posexplode(F.arrays_zip("tokens", "salts", "dealt")).alias("pos", "t"))
    rows = rows.select(F.col("t.tokens").alias("token"), F.col("t.salts").alias("salt"), F.col("t.dealt").alias("dealt"), "node", "n", "pos")
    over = W.partitionBy("token", "salt")
    # and that stand early enough in one of them to be the first that a pair shares
    early = F.max(F.col("pos") < sim.front(F.col("n"))).over(over)
    rows = rows.withColumns({"lo": F.min(F.struct("node", "n")).over(over), "hi": F.max(F.struct("node", "n")).over(over), "early": early})
    live = cut_lineage(rows.where("lo.node < hi.node and early or dealt").drop("dealt", "early").dropDuplicates(["token", "salt", "node"]))  # a node has one salt: no further shuffle

    def candidates(found: DataFrame) -> DataFrame:
        return found.where(F.col("a") < F.col("b")).where(sim.sizes_fit(F.col("n_a"), F.col("n_b")))

    # every node with the smallest and the largest of the nodes that most of its n-grams lead to, and
    # the ends of dealt-out n-grams with each other: a few pairs for each node
    def led_to(end: str) -> DataFrame:
        fits = (F.col(f"{end}.node") != F.col("node")) & sim.sizes_fit(F.col("n"), F.col(f"{end}.n"))
        often = live.where(fits).groupBy("node", "n", F.col(end).alias("e")).agg(F.count(F.lit(1)).alias("k"))
        return often.groupBy("node", "n").agg(F.max(F.struct("k", "e")).alias("m")).select("node", "n", F.col("m.e").alias("e"))

    heads = live.groupBy("token", "salt").agg(F.min(F.struct("node", "n")).alias("h"))
    tops = heads.groupBy("token").agg(F.min("h").alias("top"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "top")
    star = led_to("lo").union(led_to("hi")).select(*_ordered(F.col("node"), F.col("e.node"), F.col("n"), F.col("e.n")))
    star = star.union(heads.join(tops, "token").select(*_ordered(F.col("h.node"), F.col("top.node"), F.col("h.n"), F.col("top.n"))))
    star = cut_lineage(candidates(star).distinct())
    sigs = cut_lineage(sets.where(F.size("tokens") > 0).select("node", *(f"s{i}" for i in range(LANES))).join(live.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"]))
    # whose set is which node, without the n-grams, which go
    people = cut_lineage(sets.select("doc_id", "node", F.col("n").cast("long").alias("n_shingles"), (F.size("tokens") > 0).alias("shown")))
    discard(sets)
    links = _verified(cut_lineage(_by_bitmap(star, sigs, sim)), docs, people, order, sim)

    # pairs of different components: who is not of an n-gram's main component meets its other nodes.  A
    # part of the pairs comes first, as most components of a group join by it; then all the others.
    labels = cut_lineage(component_labels(links))
    own = live.select("token", "node", "n", "pos").join(labels.withColumnRenamed("component", "c"), "node", "left").withColumn("c", F.coalesce("c", "node"))
    parts = own.groupBy("token", "c").agg(F.count(F.lit(1)).alias("k"))
    main = parts.groupBy("token").agg(F.max(F.struct("k", "c")).alias("m"), F.count(F.lit(1)).alias("parts")).where("parts > 1").select("token", F.col("m.c").alias("main"))
    # every n-gram that two components share is here, so a pair that shares an earlier one meets there
    line = W.partitionBy("node").orderBy("pos")
    before = [f"p{i}" for i in range(BEFORE)]
    own = cut_lineage(own.join(main, "token").withColumns({p: F.lag("token", i + 1).over(line) for i, p in enumerate(before)}))
    discard(live)

    def between(own: DataFrame, first: bool) -> DataFrame:
        own = own.withColumn("inner", F.col("c") == F.col("main")).drop("main")
        fields = ("node", "n", "pos", "c", "inner", *before)
        x, y = (d.select("token", *(F.col(k).alias(f"{k}_{e}") for k in fields)) for d, e in ((own.where("not inner"), "x"), (own, "y")))
        n_x, n_y = F.col("n_x"), F.col("n_y")
        met_before = F.lit(False)
        for p in before:
            for q in before:
                met_before = met_before | F.coalesce(F.col(f"{p}_x") == F.col(f"{q}_y"), F.lit(False))
        met = x.join(y, "token").where((F.col("c_x") != F.col("c_y")) & (F.col("inner_y") | (F.col("node_x") < F.col("node_y"))) & sim.sizes_fit(n_x, n_y) & ~met_before)
        turn = F.pmod(F.xxhash64(F.least("node_x", "node_y"), F.greatest("node_x", "node_y")), F.lit(TRIED_FIRST)) == 0
        # at the first n-gram that a linked pair shares, what is left of both sets must be enough
        enough = F.least(n_x - F.col("pos_x"), n_y - F.col("pos_y")) >= sim.least_overlap(n_x, n_y)
        ends = [F.when(F.col("node_x") > F.col("node_y"), F.col(f"c_{e}")) for e in "yx"]
        met = met.where(enough & (turn if first else ~turn)).select(*_ordered(F.col("node_x"), F.col("node_y"), n_x, n_y), F.coalesce(ends[0], "c_x").alias("c_a"), F.coalesce(ends[1], "c_y").alias("c_b")).distinct()
        return cut_lineage(met.join(star.select("a", "b"), ["a", "b"], "left_anti"))

    def renamed(d: DataFrame, names: DataFrame, *cols: str) -> DataFrame:
        """Components under the names that they have got since."""
        for c in cols:
            d = d.join(names.select(F.col("node").alias(c), F.col("component").alias("_new")), c, "left").withColumn(c, F.coalesce("_new", c)).drop("_new")
        return d

    for first in (True, False):
        met = between(own, first)
        more = _verified(cut_lineage(_by_bitmap(met, sigs, sim)), docs, people, order, sim)
        joined = more.join(met, ["a", "b"]).select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct()
        names = cut_lineage(component_labels(cut_lineage(joined)))  # of whole components: few
        if first:
            own = renamed(own, names, "c", "main")
        # nodes that no link has reached name themselves
        alone = names.join(labels.select("node"), "node", "left_anti")
        labels = cut_lineage(renamed(labels, names, "component").unionByName(alone))
        discard(met, more)
    discard(star, sigs, links)

    # a component is named by its smallest document; the result is a table
    named = people.drop("shown").join(labels, "node", "left")
    named = cut_lineage(named.withColumn("component", F.coalesce("component", "node")))
    names = cut_lineage(named.where("n_shingles > 0").groupBy("component").agg(F.min("doc_id").alias("_name")))
    out = named.join(names, "component", "left")
    discard(people, labels)
    order.destroy()
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("_name")).otherwise(F.col("doc_id")).alias("component_id"))
