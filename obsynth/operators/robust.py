"""Exact order statistics and robust means per group, by one method for groups of every size.

A mergeable sketch of bounded size brackets each wanted rank.  One scan then counts, per group, what
lies below the brackets and keeps the distinct values inside them (about a hundredth of a large group) with
their counts; ranking those gives the exact answer.  No group meets in one task: sketches and counts
are combined before the shuffle, and a group's values outside the brackets are one row.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.numeric import col
from ..session import cut_lineage

ACCURACY = 2000  # of the sketch; its ranks are off by a two-thousandth at most
MARGIN = 0.002  # of a bracket on either side of a rank, as a share of the group
MAD_TO_SIGMA = 1.4826  # fixed value
MOST_TOGETHER = 1 << 18  # rows dealt out as one that meet in one task


def same_keys(df: DataFrame, other: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on equal keys, nulls included; the keys of ``other`` go."""
    renamed = other.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(c for c in other.columns if c not in keys))
    on = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    return df.join(renamed, on, how).drop(*(f"_key{i}" for i in range(len(keys))))


def _values(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """Keys and the present values as ``_v``."""
    return df.select(*keys, col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))


def _sketch(d: DataFrame, keys: list[str], probs: list[float], accuracy: int = ACCURACY) -> DataFrame:
    """keys, the count ``_n`` and approximate quantiles ``_q``."""
    return d.groupBy(*keys).agg(F.count("_v").alias("_n"), F.percentile_approx("_v", [min(max(float(p), 0.0), 1.0) for p in probs], accuracy).alias("_q"))


def _quantiles(d: DataFrame, keys: list[str], probs: dict[str, float], rough: int = 1, table: bool = False) -> DataFrame:
    """Quantiles of ``_v``: one read for the sketch and one for the counts.  ``rough`` makes the sketch so many times
    smaller and the brackets wider.  With ``table`` the brackets are written first: the planner knows their size
    and sends few of them to the rows, where it would else deal out all rows."""
    k = len(probs)
    brackets = _sketch(d, keys, [p + m for p in probs.values() for m in (-MARGIN * rough, MARGIN * rough)], ACCURACY // rough)
    lows, highs = [f"_a{i}" for i in range(k)], [f"_z{i}" for i in range(k)]
    brackets = brackets.select(*keys, "_n", *(F.col("_q")[2 * i].alias(lows[i]) for i in range(k)), *(F.col("_q")[2 * i + 1].alias(highs[i]) for i in range(k)))
    x, v = same_keys(d, cut_lineage(brackets) if table else brackets, keys), F.col("_v")
    inside = [v.between(F.col(a), F.col(z)) for a, z in zip(lows, highs, strict=True)]
    some = inside[0]
    for i in inside[1:]:
        some = some | i

    # a row for each distinct value inside a bracket, and one for all values outside; next to a bracket
    # only the nearest values can be wanted (a rank is at most one place off)
    fixed = ["_n", *lows, *highs]
    counts = [F.count_if(v < F.col(a)).alias(f"_below{i}") for i, a in enumerate(lows)]
    nearest = [f.alias(f"_{n}{i}") for i, (a, z) in enumerate(zip(lows, highs, strict=True)) for n, f in (("top", F.max(F.when(v < F.col(a), v))), ("low", F.min(F.when(v > F.col(z), v))))]
    x = x.groupBy(*keys, *fixed, F.when(some, v).alias("_w")).agg(F.count(F.lit(1)).alias("_c"), *counts, *nearest)

    group, rising, w = W.partitionBy(*keys), W.partitionBy(*keys).orderBy("_w"), F.col("_w")
    ranked, made = {}, []
    for i, p in enumerate(probs.values()):
        held = F.when(w.between(F.col(f"_a{i}"), F.col(f"_z{i}")), F.col("_c")).otherwise(0)
        ranked[f"_upto{i}"] = F.sum(F.col(f"_below{i}")).over(group) + F.sum(held).over(rising)
        ranked[f"_held{i}"] = held
        pos = F.lit(float(p)) * (F.col("_n") - 1)
        made.append((F.floor(pos), F.ceil(pos), pos - F.floor(pos)))
    x = x.withColumns(ranked)
    out = []
    for i, (name, (lo, hi, part)) in enumerate(zip(probs, made, strict=True)):
        upto, held = F.col(f"_upto{i}"), F.col(f"_held{i}")

        def at(rank: Column, i: int = i, upto: Column = upto, held: Column = held) -> Column:
            found = F.max(F.when((held > 0) & (upto - held <= rank) & (upto > rank), w))
            place, total = F.max(rank), F.max(f"_total{i}")
            under, over = F.when(place == total - 1, F.max(f"_top{i}")), F.when(place == total + F.sum(held), F.min(f"_low{i}"))
            return F.coalesce(found, under, over, F.raise_error(F.lit("a rank lies outside its bracket")).cast("double"))

        x = x.withColumn(f"_total{i}", F.sum(F.col(f"_below{i}")).over(group))
        out.append((at(lo) + F.max(part) * (at(hi) - at(lo))).alias(name))
    return x.groupBy(*keys).agg(*out)


def group_quantiles(df: DataFrame, keys: list[str], value: str | Column, probs: dict[str, float]) -> DataFrame:
    """Exact linearly interpolated quantiles (type 7) of non-missing values per group (S4)."""
    return _quantiles(_values(df, keys, value), keys, probs)


def medians_of_many(df: DataFrame, keys: list[str], value: str | Column, name: str = "median") -> DataFrame:
    """keys, ``number`` of the group, exact median and ``nobs`` of groups that are few beside their rows.  The groups are
    a table, one row each, and so are their brackets: no row is shuffled, and rows are sorted by a number."""
    d = _values(df, keys, value)
    groups = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("nobs"))
    groups = cut_lineage(groups.withColumn("number", F.row_number().over(W.orderBy(*keys)).cast("long")))
    numbered = same_keys(d, groups.select(*keys, "number"), keys).select("number", "_v")
    return groups.join(_quantiles(numbered, ["number"], {name: 0.5}, rough=8, table=True), "number")


def group_median(df: DataFrame, keys: list[str], value: str | Column, name: str = "median") -> DataFrame:
    return group_quantiles(df, keys, value, {name: 0.5})


def _with_mad(d: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``_values`` with the median and the MAD of their group.  Keys and values are written
    once, as are the medians, so what made the rows runs once however often they are read."""
    d = cut_lineage(d)
    dev = same_keys(d, cut_lineage(_quantiles(d, keys, {"median": 0.5})), keys)
    mad = _quantiles(dev.select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_v")), keys, {"mad": 0.5})
    return same_keys(dev, mad, keys)


def group_mad(df: DataFrame, keys: list[str], value: str | Column) -> DataFrame:
    """keys, median and median absolute deviation (AGG3)."""
    d = cut_lineage(_values(df, keys, value))
    med = cut_lineage(_quantiles(d, keys, {"median": 0.5}))
    dev = same_keys(d, med, keys).select(*keys, F.abs(F.col("_v") - F.col("median")).alias("_v"))
    return same_keys(med, _quantiles(dev, keys, {"mad": 0.5}), keys).select(*keys, "median", "mad")


def with_nmad(df: DataFrame, keys: list[str], value: str, name: str = "nmad") -> DataFrame:
    """Append the normalised deviation of each value within its group.  Where the MAD is zero the
    values equal to the median get 0 and the others NULL (S3)."""
    m = group_mad(df, keys, value)
    dev = F.abs(F.col(value) - F.col("_med"))
    j = same_keys(df, m.select(*keys, F.col("median").alias("_med"), F.col("mad").alias("_mad")), keys, "left")
    score = F.when(F.col("_mad") > 0, dev / (F.col("_mad") * MAD_TO_SIGMA)).when(dev == 0, F.lit(0.0))
    return j.withColumn(name, score).drop("_med", "_mad")


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once.  A plain column would be inlined into the body by the
    optimizer and, inside an array lambda, computed again for every element."""
    return F.transform(F.array(value), body)[0]


def bin_reducer(method: str) -> float | str:
    """'median', 'mean' or the sigma count of an ``nmadK`` method (AGG2)."""
    m = re.fullmatch(r"nmad(\d+(?:\.\d+)?)", method)
    if m:
        return float(m.group(1))
    if method in ("median", "mean"):
        return method
    raise ValueError(f"unknown binning method {method}")


def _reducers(methods: list[str]) -> list[Column]:
    """The statistic of each method over rows that carry the median and MAD of their group.  A method
    ``nmadK`` is the mean of the values within K deviations (those at the median where the MAD is
    zero), the median itself where none is."""
    out, gap = [], F.abs(F.col("_v") - F.col("median"))
    for m in methods:
        how = bin_reducer(m)
        if how == "mean":
            out.append(F.avg("_v"))
        elif how == "median":
            out.append(F.max("median"))
        else:
            keep = (gap < how * MAD_TO_SIGMA * F.col("mad")) | (gap == 0)
            out.append(F.coalesce(F.avg(F.when(keep, F.col("_v"))), F.max("median")))
    return out


def _reduced(d: DataFrame, keys: list[str], methods: list[str], names: list[str]) -> DataFrame:
    """keys, one column a method, nobs."""
    kinds = {bin_reducer(m) for m in methods}
    if kinds == {"mean"}:
        rows = d
    elif kinds <= {"mean", "median"}:
        rows = same_keys(d, _quantiles(d, keys, {"median": 0.5}), keys)
    else:
        rows = _with_mad(d, keys)
    return rows.groupBy(*keys).agg(*(c.alias(n) for c, n in zip(_reducers(methods), names, strict=True)), F.count(F.lit(1)).alias("nobs"))


def reduce_bins(df: DataFrame, keys: list[str], value: str, method: str = "nmad5", out: str | None = None) -> DataFrame:
    """keys, the binned statistic and ``nobs`` (AGG1, AGG2).  ``nmadK`` is the mean of the values
    whose normalised deviation is below K; a zero MAD keeps the values equal to the median (S3)."""
    return _reduced(_values(df, keys, value), keys, [method], [out or value])


def reduce_bins_methods(df: DataFrame, keys: list[str], value: str, methods: list[str]) -> DataFrame:
    """keys, method, statistic, nobs for several binning methods.  Median and MAD are found once for
    all methods, and one aggregate evaluates every method."""
    names = [f"_m{i}" for i in range(len(methods))]
    got = _reduced(_values(df, keys, value), keys, methods, names)
    made = F.array(*(F.struct(F.lit(m).alias("method"), F.col(n).alias(value)) for m, n in zip(methods, names, strict=True)))
    return got.select(*keys, "nobs", F.explode(made).alias("_m")).select(*keys, "_m.method", f"_m.{value}", "nobs")


def _middle(a: Column) -> Column:
    """The median of a sorted array without nulls."""
    n = F.size(a)
    low, high = F.get(a, ((n - 1) / 2).cast("int")), F.get(a, (n / 2).cast("int"))
    return low + 0.5 * (high - low)


def _array_reducer(method: str, a: Column, median: Column, mad: Column) -> Column:
    """One of ``_reducers`` over the values of a group as an array."""
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.size(x)
    how = bin_reducer(method)
    if how == "median":
        return median
    if how == "mean":
        return mean(a)
    keep = F.filter(a, lambda v: (F.abs(v - median) < how * MAD_TO_SIGMA * mad) | (v == median))
    return let(keep, lambda k: F.when(F.size(k) > 0, mean(k)).otherwise(median))


def reduce_cells(df: DataFrame, deal: list[str], spread: Callable[[DataFrame], DataFrame], cell: str, value: str, methods: list[str]) -> DataFrame:
    """``reduce_bins_methods(spread(df), [cell, *deal], ...)`` for many small cells, where ``spread`` makes several rows
    of one and numbers the cells by a long; a number has one ``deal``.  The rows of ``df`` are shuffled once, by ``deal``,
    and spread out and sorted where their cells lie; a cell's values then are one array.  Rows of a ``deal`` of more
    than MOST_TOGETHER do not meet in one task, their cells are found by sketches and counts."""
    keys, a = [cell, *deal], F.col("_a")
    full = cut_lineage(df.groupBy(*deal).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > MOST_TOGETHER).select(*deal))
    some = not full.isEmpty()
    d = _values(spread((same_keys(df, full, deal, "left_anti") if some else df).repartition(*deal)), keys, value)
    # sorted by one number, which is cheap; the aggregate sorts by all keys and finds them in order
    cells = d.sortWithinPartitions(cell).groupBy(*keys).agg(F.sort_array(F.collect_list("_v")).alias("_a"))

    def made(median: Column, mad: Column) -> Column:
        return F.array(*(F.struct(F.lit(m).alias("method"), _array_reducer(m, a, median, mad).alias(value)) for m in methods))

    out = let(_middle(a), lambda m: let(_middle(F.sort_array(F.transform(a, lambda v: F.abs(v - m)))), lambda mad: made(m, mad)))
    cells = cells.select(*keys, F.size(a).cast("long").alias("nobs"), F.explode(out).alias("_m")).select(*keys, "_m.method", f"_m.{value}", "nobs")
    if some:
        cells = cells.unionByName(reduce_bins_methods(spread(same_keys(df, full, deal, "left_semi")), keys, value, methods))
    return cells
