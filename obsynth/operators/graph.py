"""River networks and tile groups: pointer doubling and label propagation.

A network is a forest (comid -> next_comid, 0 = sink).  Pointer doubling needs log2(depth) rounds of
one equi-join each; every round's state is written to the checkpoint folder, so the plan stays short
and a lost executor re-reads one round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, discard

MAX_ROUNDS = 64


def _jumps(reaches: DataFrame, id_col: str, next_col: str) -> DataFrame:
    """(v, up): one step downstream; a next id that is not in the table counts as a sink."""
    v = reaches.select(F.col(id_col).alias("v"), F.col(next_col).alias("n"))
    known = reaches.select(F.col(id_col).alias("n"), F.lit(True).alias("_known"))
    j = v.join(known, "n", "left")
    return j.select("v", F.when(F.col("_known"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("up"))


def trace_downstream(starts: DataFrame, reaches: DataFrame, start: str = "start", id_col: str = "comid", next_col: str = "next_comid") -> DataFrame:
    """(start, step, comid) for every node on the path from each start to its sink, start included
    (GR1).  Each round doubles the length of the known paths: a path of length L joins the jump table
    once per doubling, so depth D takes log2(D) joins."""
    jump = cut_lineage(_jumps(reaches, id_col, next_col))
    ids = reaches.select(F.col(id_col).alias("v"))
    path = starts.select(F.col(start).alias("start")).distinct().join(ids, F.col("start") == F.col("v"), "left_semi")
    path = path.select("start", F.lit(0).cast("long").alias("step"), F.col("start").alias("v"))
    span = 1
    for _ in range(MAX_ROUNDS):
        # the jump table holds span-step jumps; shift the whole known path by span
        more = path.join(jump, "v").where(F.col("up") != 0).select("start", (F.col("step") + span).alias("step"), F.col("up").alias("v"))
        path = cut_lineage(path.unionByName(more))
        nxt = jump.alias("a").join(jump.alias("b"), F.col("a.up") == F.col("b.v"), "left")
        jump = cut_lineage(nxt.select(F.col("a.v").alias("v"), F.coalesce(F.col("b.up"), F.lit(0)).cast("long").alias("up")))
        span *= 2
        if jump.where(F.col("up") != 0).isEmpty():
            # no node is ``span`` steps above another: every path is complete
            return path.select("start", "step", F.col("v").alias(id_col))
    raise ValueError("the network has a cycle")


def trace_upstream(trace: DataFrame, start: str = "start", node: str = "comid") -> DataFrame:
    """Starts that drain through each node: the trace read the other way (JN20)."""
    return trace.select(F.col(node).alias("node"), F.col(start).alias("source"))


def downstream_sink(reaches: DataFrame, id_col: str = "comid", next_col: str = "next_comid") -> DataFrame:
    """(comid, sink): last node of every path, by pointer doubling with self-looping sinks (GR5)."""
    j = _jumps(reaches, id_col, next_col)
    j = cut_lineage(j.select("v", F.when(F.col("up") == 0, F.col("v")).otherwise(F.col("up")).alias("up")))
    for _ in range(MAX_ROUNDS):
        nxt = j.alias("a").join(j.alias("b"), F.col("a.up") == F.col("b.v"))
        nxt = cut_lineage(nxt.select(F.col("a.v").alias("v"), F.col("b.up").alias("up"), (F.col("a.up") != F.col("b.up")).alias("_moved")))
        done = nxt.where("_moved").isEmpty()
        j = nxt.drop("_moved")
        if done:
            return j.select(F.col("v").alias(id_col), F.col("up").alias("sink"))
    raise ValueError("the network has a cycle")


def accumulate_sum(flux: DataFrame, reaches: DataFrame, value: str = "flux", time: list[str] = ["month"], id_col: str = "comid", next_col: str = "next_comid") -> DataFrame:
    """Flux of every reach plus everything upstream of it, per time step (GR2).

    Doubling on subtree sums: after k rounds a node holds its inputs within 2^k steps upstream; adding
    the sums of the nodes exactly 2^k steps above it reaches 2^(k+1).  Rows stay (node, time) in every
    round and contributions are combined before the shuffle, so a hub with very many tributaries is
    one partial sum per task.  No upstream-downstream closure is built.
    """
    jump = cut_lineage(_jumps(reaches, id_col, next_col).where(F.col("up") != 0))
    acc = flux.groupBy(F.col(id_col).alias("v"), *time).agg(F.sum(value).alias("s"))
    acc = acc.join(reaches.select(F.col(id_col).alias("v")), "v", "left_semi")
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            return acc.select(F.col("v").alias(id_col), *time, F.col("s").alias(value))
        up = acc.join(jump, "v").select(F.col("up").alias("v"), *time, "s")
        acc = cut_lineage(acc.unionByName(up).groupBy("v", *time).agg(F.sum("s").alias("s")))
        jump = _double(jump)
    raise ValueError("the network has a cycle")


def accumulate_longest(reaches: DataFrame, length: str = "length_km", id_col: str = "comid", next_col: str = "next_comid", out: str = "longest_km") -> DataFrame:
    """Own length plus the longest upstream path (GR2, GR3), by doubling on path maxima."""
    lens = reaches.select(F.col(id_col).alias("v"), F.col(length).alias("len"))
    jump = _jumps(reaches, id_col, next_col).where(F.col("up") != 0).join(lens, "v")
    # d: length from v (included) to its jump target (excluded)
    jump = cut_lineage(jump.select("v", "up", F.col("len").alias("d")))
    acc = lens.withColumn("m", F.col("len"))
    for _ in range(MAX_ROUNDS):
        if jump.isEmpty():
            return acc.select(F.col("v").alias(id_col), F.col("m").alias(out))
        # path ending at v, then the nodes between v and its target, then the target
        up = acc.join(jump, "v").select(F.col("up").alias("v"), (F.col("m") - F.col("len") + F.col("d")).alias("above"))
        best = up.groupBy("v").agg(F.max("above").alias("above"))
        acc = acc.join(best, "v", "left")
        acc = cut_lineage(acc.select("v", "len", F.greatest(F.col("m"), F.col("len") + F.col("above")).alias("m")))
        jump = _double(jump, with_length=True)
    raise ValueError("the network has a cycle")


def _double(jump: DataFrame, with_length: bool = False) -> DataFrame:
    """Jump table of twice the span; nodes that run past a sink drop out."""
    a, b = jump.alias("a"), jump.alias("b")
    cols = [F.col("a.v").alias("v"), F.col("b.up").alias("up")]
    if with_length:
        cols.append((F.col("a.d") + F.col("b.d")).alias("d"))
    return cut_lineage(a.join(b, F.col("a.up") == F.col("b.v")).select(*cols))


def add_network_flags(reaches: DataFrame, id_col: str = "comid", next_col: str = "next_comid", up_col: str | None = None) -> DataFrame:
    """Basin code (millions of the id) and head flag: no upstream id, or never referenced (GR3)."""
    refs = reaches.select(F.col(next_col).alias(id_col), F.lit(True).alias("_ref")).distinct()
    d = reaches.join(refs, id_col, "left")
    head = F.col("_ref").isNull()
    if up_col:
        head = head | (F.col(up_col) == 0)
    return d.withColumn("basin02", F.floor(F.col(id_col) / 1_000_000).cast("int")).withColumn("is_head", head).drop("_ref")


def component_labels(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): smallest id of each connected component, by alternating large-star and
    small-star steps until the edge set is stable.  Each step is a min aggregate and a join; no
    neighbourhood is gathered, so a hub node is safe."""
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    nodes = cut_lineage(e.select("u").union(e.select("v")).distinct())
    e = cut_lineage(e.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        # large star: neighbours above a node move to the smallest node around it
        both = e.union(e.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("_m")).select("u", F.least("u", "_m").alias("m"))
        big = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        big = cut_lineage(big.where("u <> v").distinct())
        # small star: a node and its smaller neighbours move to the smallest of them
        low = big.groupBy("u").agg(F.min("v").alias("m"))
        small = big.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.toDF("u", "v"))
        small = cut_lineage(small.where("u <> v").distinct())
        discard(e, big)
        # order-free signature of the edge set: one small aggregate a round decides convergence
        now = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        stable, seen, e = now == seen, now, small
        if stable:
            lab = nodes.withColumnRenamed("u", "node").join(e.toDF("node", "component"), "node", "left")
            return lab.select("node", F.coalesce("component", "node").alias("component"))


def star_edges(membership: DataFrame, group: str, member: str) -> DataFrame:
    """Edges that connect the members of each group through its smallest member: as many edges as
    memberships, never all pairs."""
    low = membership.groupBy(group).agg(F.min(member).alias("_m"))
    return membership.join(low, group).select(F.col(member).alias("a"), F.col("_m").alias("b")).distinct()


def tile_groups(tiles: DataFrame, touches: DataFrame, tile: str = "tile_id", feature: str = "feature_id", forced: DataFrame | None = None) -> DataFrame:
    """Tiles sharing a large feature form one group, named by its smallest tile; forced rows
    (tile, group) override (CAL5)."""
    lab = component_labels(star_edges(touches, feature, tile)).toDF(tile, "group")
    out = tiles.select(tile).join(lab, tile, "left").select(tile, F.coalesce("group", tile).alias("group"))
    if forced is not None:
        out = out.join(forced.select(tile, F.col("group").alias("_f")), tile, "left").select(tile, F.coalesce("_f", "group").alias("group"))
    return out


def check_conservation(acc: DataFrame, flux: DataFrame, reaches: DataFrame, value: str = "flux", id_col: str = "comid", next_col: str = "next_comid") -> DataFrame:
    """Total at the sinks against the total input (GR2): one row with both and the relative gap."""
    sinks = acc.join(reaches.where(F.col(next_col) == 0).select(id_col), id_col, "left_semi").agg(F.sum(value).alias("at_sinks"))
    given = flux.join(reaches.select(id_col), id_col, "left_semi").agg(F.sum(value).alias("given"))
    a, b = sinks.withColumn("_k", F.lit(1)), given.withColumn("_k", F.lit(1))
    gap: Column = F.abs(F.col("at_sinks") - F.col("given")) / F.greatest(F.abs("given"), F.lit(1e-300))
    return a.join(b, "_k").select("at_sinks", "given", gap.alias("gap"))
