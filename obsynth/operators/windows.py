"""Ordered operators.  Windows run over one series or one elevation profile, both of which live on
fixed axes (438 dates, 100 heights), never over an unbounded group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.numeric import col, total


def rate_from_cumulative(df: DataFrame, keys: list[str], date: str, value: str, out: str = "rate", per_second: bool = True, repeat_first: bool = False) -> DataFrame:
    """Difference of a cumulative series over its time step (WIN1)."""
    w = W.partitionBy(*keys).orderBy(date)
    step = F.datediff(F.col(date), F.lag(date).over(w))
    diff = F.col(value) - F.lag(value).over(w)
    df = df.withColumn(out, F.try_divide(diff, step * F.lit(86400.0)) if per_second else diff)
    if repeat_first:
        df = df.withColumn(out, F.coalesce(out, F.lead(out).over(w)))
    return df


def monotone_repair(df: DataFrame, keys: list[str], order: str, value: str, out: str = "repaired") -> DataFrame:
    """First value plus the running sum of the non-negative increments (WIN2)."""
    w = W.partitionBy(*keys).orderBy(order)
    step = F.col(value) - F.lag(value).over(w)
    df = df.withColumn("_step", F.when(step.isNull(), F.col(value)).when(step < 0, F.lit(0.0)).otherwise(step))
    return df.withColumn(out, F.sum("_step").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_step")


def valid_range(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """First and last index with a value (WIN3)."""
    ok = F.col(value).isNotNull()
    return df.groupBy(*keys).agg(F.min(F.when(ok, F.col(index))).alias("first_valid"), F.max(F.when(ok, F.col(index))).alias("last_valid"))


def with_valid_range(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    ok, w = F.when(F.col(value).isNotNull(), F.col(index)), W.partitionBy(*keys)
    return df.withColumn("first_valid", F.min(ok).over(w)).withColumn("last_valid", F.max(ok).over(w))


def valid_gaps(df: DataFrame, keys: list[str], index: str, value: str, out: str = "gap") -> DataFrame:
    """Missing cells strictly inside the valid range (WIN4)."""
    d = with_valid_range(df, keys, index, value)
    inside = (F.col(index) > F.col("first_valid")) & (F.col(index) < F.col("last_valid"))
    return d.withColumn(out, F.coalesce(inside, F.lit(False)) & F.col(value).isNull()).drop("first_valid", "last_valid")


def dilate(flag: str | Column, keys: list[str], index: str, radius: int) -> Column:
    """Grow (radius > 0) or shrink (radius < 0) the TRUE runs of a dense axis (WIN5)."""
    w = W.partitionBy(*keys).orderBy(index).rowsBetween(-abs(radius), abs(radius))
    return (F.max if radius >= 0 else F.min)(col(flag)).over(w)


def true_run_length(df: DataFrame, keys: list[str], index: str, flag: str, out: str = "run_length") -> DataFrame:
    """Length of the TRUE run of each row, 0 for FALSE rows (WIN6)."""
    w = W.partitionBy(*keys).orderBy(index)
    d = df.withColumn("_block", F.sum(F.when(F.col(flag), 0).otherwise(1)).over(w.rowsBetween(W.unboundedPreceding, 0)))
    n = F.sum(F.col(flag).cast("int")).over(W.partitionBy(*keys, "_block"))
    return d.withColumn(out, F.when(F.col(flag), n).otherwise(F.lit(0)).cast("int")).drop("_block")


def extend_ends(df: DataFrame, keys: list[str], index: str, value: str, inside: str | Column | None = None, out: str | None = None) -> DataFrame:
    """Carry the first and last value outward to the ends of the axis; inner gaps stay (WIN7).
    ``inside`` restricts the fill to the rows of the has-area range."""
    d = with_valid_range(df, keys, index, value)
    w = W.partitionBy(*keys).orderBy(index)
    full = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    first, last = F.first(value, ignorenulls=True).over(full), F.last(value, ignorenulls=True).over(full)
    filled = (
        F.when(F.col(index) < F.col("first_valid"), first)
        .when(F.col(index) > F.col("last_valid"), last)
        .otherwise(F.col(value))
    )
    if inside is not None:
        filled = F.when(col(inside), filled).otherwise(F.col(value))
    return d.withColumn(out or value, filled).drop("first_valid", "last_valid")


def interpolate(df: DataFrame, keys: list[str], x: str, value: str, out: str | None = None, outside: str = "linear") -> DataFrame:
    """Piecewise-linear fill of missing values along ``x`` (WIN8, WIN9).  Beyond the known points:
    ``linear`` continues the end slope, ``flat`` holds the end value, ``none`` leaves NULL."""
    out = out or value
    w = W.partitionBy(*keys).orderBy(x)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(x).alias("x"), F.col(value).alias("y")))
    d = df.withColumn("_k", known)
    d = d.withColumn("_lo", F.last("_k", ignorenulls=True).over(back)).withColumn("_hi", F.first("_k", ignorenulls=True).over(ahead))
    if outside == "linear":
        # second known point inward from each end of the axis
        d = d.withColumn("_prev", F.when(F.col("_k").isNotNull(), F.lag("_lo").over(w)))
        d = d.withColumn("_next", F.when(F.col("_k").isNotNull(), F.lead("_hi").over(w)))
        d = d.withColumn("_lo2", F.last("_prev", ignorenulls=True).over(back)).withColumn("_hi2", F.first("_next", ignorenulls=True).over(ahead))
    lo, hi = F.col("_lo"), F.col("_hi")

    def line(a: Column, b: Column) -> Column:
        return a["y"] + (b["y"] - a["y"]) * (F.col(x) - a["x"]) / (b["x"] - a["x"])

    if outside == "linear":
        below = F.when(F.col("_hi2").isNotNull(), line(hi, F.col("_hi2"))).otherwise(hi["y"])
        above = F.when(F.col("_lo2").isNotNull(), line(F.col("_lo2"), lo)).otherwise(lo["y"])
    elif outside == "flat":
        below, above = hi["y"], lo["y"]
    elif outside == "none":
        below, above = F.lit(None).cast("double"), F.lit(None).cast("double")
    else:
        raise ValueError("outside must be 'linear', 'flat' or 'none'")
    y = (
        F.when(F.col(value).isNotNull(), F.col(value))
        .when(lo.isNotNull() & hi.isNotNull(), line(lo, hi))
        .when(hi.isNotNull(), below)
        .when(lo.isNotNull(), above)
    )
    return d.withColumn(out, y).drop("_k", "_lo", "_hi", "_prev", "_next", "_lo2", "_hi2")


def resample(series: DataFrame, axis: DataFrame, keys: list[str], x: str, value: str, outside: str = "flat") -> DataFrame:
    """Series on another axis: union the axes, interpolate, keep the asked positions (WIN9).
    ``axis`` has the columns keys + x."""
    wanted = axis.select(*keys, x, F.lit(True).alias("_want"))
    u = series.select(*keys, x, value).join(wanted, [*keys, x], "full_outer")
    return interpolate(u, keys, x, value, outside=outside).where("_want").drop("_want")


def center_on(df: DataFrame, keys: list[str], value: str, period: Column, out: str | None = None) -> DataFrame:
    """Subtract the mean over a reference period (WIN11, CMP10).  The mean is a combined aggregate
    joined back, so the operator also serves keys with very many rows."""
    ref = df.where(period).groupBy(*keys).agg(F.avg(value).alias("_ref"))
    return df.join(ref, keys, "left").withColumn(out or value, F.col(value) - F.col("_ref")).drop("_ref")


def center_on_first_year(df: DataFrame, keys: list[str], date: str, value: str, out: str | None = None) -> DataFrame:
    """Subtract the mean of the first twelve months (CMP10)."""
    first = df.groupBy(*keys).agg(F.min(date).alias("_d0"))
    d = df.join(first, keys)
    return center_on(d, keys, value, F.col(date) < F.add_months("_d0", 12), out).drop("_d0")


def remove_trend(df: DataFrame, trends: DataFrame, date: str, value: str = "dh", by: str = "mission", trend: str = "land_trend", step_days: int = 30) -> DataFrame:
    """Subtract (t - mid) * trend; mid is the mean decimal year of the axis dates between the first
    and the last valid date of a mission (WIN12)."""
    span = df.where(F.col(value).isNotNull()).groupBy(by).agg(F.min(date).alias("_a"), F.max(date).alias("_b"))
    axis = span.select(by, F.explode(F.sequence("_a", "_b", F.make_dt_interval(F.lit(step_days)))).alias("_d"))
    mid = axis.groupBy(by).agg(F.avg(decimal_year("_d")).alias("_mid"))
    d = df.join(mid, by, "left").join(trends.select(by, trend), by, "left")
    moved = (decimal_year(date) - F.col("_mid")) * F.col(trend)
    return d.withColumn(value, F.col(value) - F.coalesce(moved, F.lit(0.0))).drop("_mid", trend)


def arg_best(df: DataFrame, keys: list[str], value: str, tie: str, largest: bool = True) -> DataFrame:
    """Whole row with the largest (smallest) value, first ``tie`` on equal values (WIN13, S6)."""
    rest = [c for c in df.columns if c not in keys]
    if largest:
        pick = F.min_by(F.struct(*rest), F.struct(-F.col(value), F.col(tie)))
    else:
        pick = F.min_by(F.struct(*rest), F.struct(F.col(value), F.col(tie)))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def reservoir_weights(residence_days: float = 45.0) -> list[float]:
    """Monthly response of a linear reservoir that starts with one unit and gets one more on each of
    29 days: 30-day shares of all that leaves it, two digits, up to the first zero (WIN15).

    A share q = 1 - 1/residence of the store stays each day, so after d days of inflow it holds
    residence - (residence - 1) q^d, and a geometric sum gives the outflow of every period."""
    q = 1 - 1 / residence_days
    month = 1 - q**30
    held = residence_days - (residence_days - 1) * q**29  # on day 30, when the inflow has ended
    flows = [30 - (residence_days - 1) * month, *(held * q ** (30 * k - 29) * month for k in range(1, 10))]
    shares = [round(f / 30, 2) for f in flows]
    return shares[: shares.index(0)] if 0 in shares else shares


def convolve(df: DataFrame, keys: list[str], order: str, value: str, weights: list[float], out: str = "response") -> DataFrame:
    """Causal convolution of each series with fixed weights on an even axis (WIN15)."""
    w = W.partitionBy(*keys).orderBy(order)
    terms = [F.coalesce(F.lag(value, k).over(w), F.lit(0.0)) * F.lit(float(c)) for k, c in enumerate(weights)]
    return df.withColumn(out, total(terms))


def shift_profile(df: DataFrame, keys: list[str], index: str, value: str, shift: int, n_fit: int | None = None, skip_zero: bool = False, out: str = "shifted") -> DataFrame:
    """Move an elevation profile by ``shift`` bins (positive: down) and continue it into the vacated
    bins with the line through the nearest ``n_fit`` remaining points (all when None) (WIN16)."""
    w = W.partitionBy(*keys).orderBy(index)
    moved = F.lead(value, shift).over(w) if shift >= 0 else F.lag(value, -shift).over(w)
    d = df.withColumn("_m", moved).withColumn("_pos", F.row_number().over(w))
    d = d.withColumn("_size", F.count(F.lit(1)).over(W.partitionBy(*keys)))
    kept = (F.col("_pos") <= F.col("_size") - shift) if shift >= 0 else (F.col("_pos") > -shift)
    use = kept & (F.col("_m") != 0) if skip_zero else kept
    d = d.withColumn("_kept", kept).withColumn("_use", use)
    if n_fit is not None:
        side = F.col("_pos").desc() if shift >= 0 else F.col("_pos")
        rank = F.sum(F.col("_use").cast("int")).over(W.partitionBy(*keys).orderBy(side).rowsBetween(W.unboundedPreceding, 0))
        d = d.withColumn("_use", F.col("_use") & (rank <= n_fit))
    full = W.partitionBy(*keys)
    x, y = F.when(F.col("_use"), F.col("_pos").cast("double")), F.when(F.col("_use"), F.col("_m"))
    slope, mx, my = F.regr_slope(y, x).over(full), F.avg(x).over(full), F.avg(y).over(full)
    line = F.coalesce(my + F.coalesce(slope, F.lit(0.0)) * (F.col("_pos") - mx), F.lit(0.0))
    d = d.withColumn(out, F.when(F.col("_kept"), F.col("_m")).otherwise(line))
    return d.drop("_m", "_pos", "_size", "_kept", "_use")


def slope_per_year(df: DataFrame, keys: list[str], t: Column, value: str, out: str = "slope") -> DataFrame:
    """Least-squares slope against decimal year; NULL below two points or a single time (WIN17)."""
    d = df.where(F.col(value).isNotNull())
    return d.groupBy(*keys).agg(F.regr_slope(F.col(value), t).alias(out), F.count(F.lit(1)).alias("n"))


def net_change(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Last minus first valid value and the rank of the change over all keys (CMP6)."""
    d = df.where(F.col(value).isNotNull())
    g = d.groupBy(*keys).agg((F.max_by(value, order) - F.min_by(value, order)).alias("change"))
    return g
