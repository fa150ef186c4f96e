"""Exact top-k inner products by norm-sorted blocks, rotated partial sums and residual bounds.

Vectors are turned into integers, rotated by the singular vectors of the whole set (so that the
first coordinates carry most of the length), sorted by descending length and cut into blocks.  For
a pair, the product of the first coordinates plus the product of the lengths of the rests bounds the
inner product from above (Cauchy-Schwarz).  The longest block gives each query a first k-th score;
blocks and candidates that cannot reach it are left out, the others are scored in exact integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import map_arrow

BLOCK = 2048
SCALE = 64
HEAD_SHARE = 0.7  # the head holds this share of the squared length
SLACK = 1e-6  # relative guard for the bounds' rounding


def quantize(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component; null if the vector is null or holds a null, NaN or
    infinite component."""
    x = F.transform(vec, lambda v: v.cast("double"))
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.when(fine, F.transform(x, lambda v: F.floor(v * scale).cast("long")))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _gram(vectors: DataFrame, dim: int) -> np.ndarray:
    """Sum of outer products, added up in every task; dim x dim numbers reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for b in batches:
            v = _matrix(b.column("v"), dim).astype(float)
            total += v.T @ v
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(list(total))], names=["i", "row"])

    parts = map_arrow(vectors.select("v"), run, "i long, row array<double>")
    sums = parts.select("i", F.posexplode("row")).groupBy("i", "pos").agg(F.sum("col").alias("x")).collect()
    out = np.zeros((dim, dim))
    for r in sums:
        out[r["i"], r["pos"]] = r["x"]
    return out


def _blocks(rows: DataFrame, block: int, rotation: np.ndarray, head: int) -> DataFrame:
    """Rows (id, v, len2) by descending length in blocks of ``block`` rows, one row a block: number,
    ids, vectors, rotated heads and lengths of the rests as arrays, and the largest length.

    A range sort and the counts of its partitions (one row each) number the rows, so blocks are full
    however the rows are partitioned and however many of them tie.
    """
    order = [F.col("len2").desc(), F.col("id")]
    dim = len(rotation)
    ranged = cut_lineage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    numbered = ranged.withColumn("_part", part).join(sizes.select("_part", before.alias("_before")), "_part")
    place = F.col("_before") + F.col("_m").bitwiseAND((1 << 33) - 1)
    grouped = numbered.groupBy(F.floor(place / block).alias("b")).agg(F.sort_array(F.collect_list(F.struct((-F.col("len2")).alias("neg"), "id", "v"))).alias("rows"))
    flat = grouped.select("b", F.col("rows.id").alias("ids"), F.flatten("rows.v").alias("vecs"), F.sqrt(-F.col("rows")[0]["neg"]).alias("top"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads, rests = [], []
            for cell in b.column("vecs"):
                rot = cell.values.to_numpy(zero_copy_only=False).reshape(-1, dim) @ rotation
                heads.append(rot[:, :head].tobytes())
                rests.append(np.sqrt((rot[:, head:] ** 2).sum(1)).tobytes())
            ids, vecs = ([x.values.to_numpy(zero_copy_only=False).astype(np.int64).tobytes() for x in b.column(c)] for c in ("ids", "vecs"))
            cells = [pa.array(x, pa.binary()) for x in (ids, vecs, heads, rests)]
            yield pa.RecordBatch.from_arrays([b.column("b"), *cells, b.column("top")], names=["b", "ids", "vecs", "heads", "rests", "top"])

    return cut_lineage(map_arrow(flat, run, "b long, ids binary, vecs binary, heads binary, rests binary, top double"))


PAIRS = 64  # candidate rows bounded at a time for a block of queries


def _merge(best: tuple[np.ndarray, np.ndarray, np.ndarray] | None, q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best (score, then smaller id) of each query among two lists of (query, id, score)."""
    if best is not None:
        q, ids, score = (np.concatenate(x) for x in zip(best, (q, ids, score), strict=True))
    order = np.lexsort((ids, -score, q))
    q, ids, score = q[order], ids[order], score[order]
    first = np.r_[0, np.flatnonzero(q[1:] != q[:-1]) + 1]
    place = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)])) if len(q) else np.empty(0, int)
    return q[place < k], ids[place < k], score[place < k]


def _score(dim: int, head: int, k: int):
    """Task function over (query block, candidate block) rows: the exact best k of each query there,
    its k-th score so far, and the least length a candidate needs to reach any of these scores."""

    def one(row: dict) -> tuple:
        qi, qv = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_vecs"], np.int64).reshape(-1, dim)
        qh, qr = np.frombuffer(row["q_heads"]).reshape(-1, head), np.frombuffer(row["q_rests"])
        ci, cv = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["vecs"], np.int64).reshape(-1, dim)
        ch, cr = np.frombuffer(row["heads"]).reshape(-1, head), np.frombuffer(row["rests"])
        floor = np.full(len(qi), -np.inf) if row["floors"] is None else np.frombuffer(row["floors"]).copy()
        q_len, c_len = np.sqrt((qh**2).sum(1) + qr**2), np.sqrt((ch**2).sum(1) + cr**2)
        best = None
        for a in range(0, len(ci), PAIRS):
            part = slice(a, a + PAIRS)
            if (q_len * c_len[a] * (1 + SLACK) + SLACK < floor).all():
                break  # lengths descend: no later row can reach any query's k-th score
            bound = qh @ ch[part].T + np.outer(qr, cr[part])
            guard = SLACK * (1 + np.outer(q_len, c_len[part]))
            x, y = np.nonzero((bound + guard >= floor[:, None]) & (qi[:, None] != ci[part][None]))
            if len(x):
                best = _merge(best, x, ci[part][y], np.einsum("ij,ij->i", qv[x], cv[part][y]), k)
                count = np.bincount(best[0], minlength=len(qi))
                full = count >= k
                floor[full] = np.maximum(floor[full], best[2][(np.cumsum(count) - 1)[full]])
        need = np.full(len(qi), -np.inf)
        np.divide(floor, q_len, out=need, where=(q_len > 0) & np.isfinite(floor))
        need[(q_len == 0) & (floor > 0)] = np.inf
        q, ids, scores = best or (np.empty(0, int),) * 3
        return floor.tobytes(), float(need.min()), [{"query_id": a, "vec_id": b, "score": c} for a, b, c in zip(qi[q].tolist(), ids.tolist(), scores.tolist(), strict=True)]

    found = pa.list_(pa.struct([(x, pa.int64()) for x in ("query_id", "vec_id", "score")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pylist()[0]
                made = one(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["q"]], pa.int64()), pa.array([made[0]], pa.binary()), pa.array([made[1]]), pa.array([made[2]], found)], names=["q", "floors", "reach", "found"]
                )

    return run


SCORED = "q long, floors binary, reach double, found array<struct<query_id: long, vec_id: long, score: long>>"


def exact_top_k(vectors: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row whose id is divisible by ``every``, the k rows
    with the largest integer inner products, other than rows with the query's own id; ties go to the
    smaller id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without an
    id, and all others must have one length, else it raises.  Rows that repeat an id count once (the
    first in the order of their components).  No rows, no result.
    """
    base = vectors.select(F.col(id_col).cast("long").alias("id"), quantize(F.col(vec_col), scale).alias("v")).where("id is not null and v is not null")
    base = base.groupBy("id").agg(F.min("v").alias("v")).withColumn("len2", F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x))
    base = cut_lineage(base)
    shape = base.agg(F.min(F.size("v")).alias("a"), F.max(F.size("v")).alias("b")).first()
    if not shape["b"]:
        return base.where("false").select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.col("len2").alias("score"))
    if shape["a"] != shape["b"]:
        raise ValueError(f"vectors of {shape['a']} and {shape['b']} components")
    dim = shape["b"]
    values, rotation = np.linalg.eigh(_gram(base, dim))
    values, rotation = np.maximum(values[::-1], 0), np.ascontiguousarray(rotation[:, ::-1])
    head = int(min(dim, np.searchsorted(np.cumsum(values), HEAD_SHARE * values.sum()) + 1))
    score = _score(dim, head, k)

    cands = _blocks(base, block, rotation, head)
    queries = _blocks(base.where(F.col("id") % every == 0), block // 4, rotation, head)
    queries = queries.select(F.col("b").alias("q"), *(F.col(x).alias(f"q_{x}") for x in ("ids", "vecs", "heads", "rests")))
    fields = ["q", "q_ids", "q_vecs", "q_heads", "q_rests", "ids", "vecs", "heads", "rests", "floors"]

    # every query block first meets block 0, the longest candidates
    first = queries.withColumn("b", F.lit(0).cast("long")).join(cands, "b").withColumn("floors", F.lit(None).cast("binary"))
    opening = cut_lineage(map_arrow(first.select(*fields).repartition("q"), score, SCORED))
    # then the blocks that its weakest k-th score does not rule out; only numbers meet here
    pairs = opening.select("q", "floors", "reach").join(cands.where("b > 0").select("b", "top"), F.col("top") * (1 + SLACK) + SLACK >= F.col("reach"))
    later = map_arrow(pairs.repartition("q", "b").join(queries, "q").join(cands.drop("top"), "b").select(*fields), score, SCORED)
    both = opening.select("found").union(later.select("found")).select(F.inline("found"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return both.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
