"""Sampling a model stack in scale space and calibrating it against observations.

The stack is linear in its four corner series inside one bracket of the class grid, and both the
residual variance and the seasonal fit are quadratic or linear in the residual.  One aggregate per
(group, bracket) - sums of products of the observed series and the four corners - therefore prices
every candidate of the search grid in closed form; no series is ever expanded over the grid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.models import annual_terms
from ..functions.numeric import col
from ..functions.scales import scale_distance
from ..schema import MELT_TO_PRECIP_WEIGHT, ORIGIN_PENALTY, SEASONALITY_WEIGHT
from .fit import TIME_ORIGIN, ols, seasonal_terms

CORNERS = [(0, 0), (0, 1), (1, 0), (1, 1)]


def bracket(c: str | Column, axis: list[float]) -> tuple[Column, Column]:
    """(index of the lower class, fraction towards the next) on a sorted axis; NULL outside."""
    c = col(c)
    i = F.lit(None).cast("int")
    for k in reversed(range(len(axis) - 1)):
        i = F.when((c >= axis[k]) & (c <= axis[k + 1]), F.lit(k)).otherwise(i)
    lo = F.lit(None).cast("double")
    for k in range(len(axis) - 1):
        lo = F.when(i == k, (c - axis[k]) / (axis[k + 1] - axis[k])).otherwise(lo)
    return i, lo


def class_index(c: str | Column, axis: list[float], tol: float = 1e-9) -> Column:
    c = col(c)
    i = F.lit(None).cast("int")
    for k, v in enumerate(axis):
        i = F.when(F.abs(c - v) <= tol, F.lit(k)).otherwise(i)
    return i


def sample_stack(stack: DataFrame, params: DataFrame, on: list[str], p_axis: list[float], m_axis: list[float], values: list[str], series: list[str] = ["date"]) -> DataFrame:
    """Bilinear values of the stack at each (pscale, mscale) of ``params`` (CAL1).  Weights are attached to
    the four corner classes of the parameter row, so the stack is read once and summed."""
    ip, fp = bracket("pscale", p_axis)
    im, fm = bracket("mscale", m_axis)
    q = params.withColumns({"_ip": ip, "_im": im, "_fp": fp, "_fm": fm})
    wp = {0: 1 - F.col("_fp"), 1: F.col("_fp")}
    wm = {0: 1 - F.col("_fm"), 1: F.col("_fm")}
    corners = F.array(*[F.struct((F.col("_ip") + a).alias("ip"), (F.col("_im") + b).alias("im"), (wp[a] * wm[b]).alias("w")) for a, b in CORNERS])
    own = [c for c in params.columns]
    q = q.select(*own, F.explode(corners).alias("_c")).where("_c.w > 0")
    s = stack.select(*on, *series, class_index("pscale", p_axis).alias("_ip"), class_index("mscale", m_axis).alias("_im"), *values)
    q = q.withColumns({"_ip": F.col("_c.ip"), "_im": F.col("_c.im"), "_w": F.col("_c.w")}).drop("_c")
    j = s.join(q, [*on, "_ip", "_im"])
    return j.groupBy(*own, *series).agg(*[F.sum(F.col("_w") * F.col(v)).alias(v) for v in values])


def origin_factor(p: Column, m: Column, penalty: float, melt_weight: float, scaling=(True, True)) -> Column:
    dp = scale_distance(p) if scaling[0] else p
    dm = scale_distance(m) if scaling[1] else m
    a, b = dm * F.lit(melt_weight), dp * F.lit(1 - melt_weight)
    return F.lit(1.0) + F.sqrt(a * a + b * b) * F.lit(penalty)


def group_series(df: DataFrame, groups: DataFrame, values: list[str], extra: list[str] = [], tile: str = "tile_id", date: str = "date") -> DataFrame:
    """Sum of tile series per calibration group."""
    return df.join(groups.select(tile, "group"), tile).groupBy("group", *extra, date).agg(*[F.sum(v).alias(v) for v in values])


def grid_search(
    obs: DataFrame, stack: DataFrame, keys: list[str], p_axis: list[float], m_axis: list[float],
    p_grid: list[float], m_grid: list[float], date: str = "date", value: str = "value", stack_keys: list[str] | None = None,
    seasonality_weight: float = SEASONALITY_WEIGHT, penalty: float = ORIGIN_PENALTY, melt_weight: float = MELT_TO_PRECIP_WEIGHT,
    calibrate_to: str = "all", all_costs: bool = False,
) -> DataFrame:
    """Cheapest (pscale, mscale) per key on a search grid (CAL2, CAL3, CAL4).

    ``obs`` has keys + date + value; ``stack`` has stack_keys (default keys) + date + pscale + mscale + value.
    Dates present in both are used.  Ties go to the smaller pscale, then mscale."""
    stack_keys = keys if stack_keys is None else stack_keys
    s = stack.select(*stack_keys, date, class_index("pscale", p_axis).alias("_p"), class_index("mscale", m_axis).alias("_m"), F.col(value).alias("_g"))
    # each class value takes part in up to four brackets, as one of their corners
    slots = F.array(*[F.struct((F.col("_p") - a).alias("bp"), (F.col("_m") - b).alias("bm"), F.lit(2 * a + b).alias("k")) for a, b in CORNERS])
    s = s.select(*stack_keys, date, "_g", F.explode(slots).alias("_s"))
    s = s.where((F.col("_s.bp") >= 0) & (F.col("_s.bm") >= 0) & (F.col("_s.bp") < len(p_axis) - 1) & (F.col("_s.bm") < len(m_axis) - 1))
    s = s.groupBy(*stack_keys, date, F.col("_s.bp").alias("bp"), F.col("_s.bm").alias("bm")).agg(
        *[F.max(F.when(F.col("_s.k") == k, F.col("_g"))).alias(f"_g{k}") for k in range(4)])
    o = obs.where(F.col(value).isNotNull()).select(*keys, date, F.col(value).alias("_y"))
    j = s.join(o, [*stack_keys, date])
    bk = [*keys, "bp", "bm"]

    # sums of products of [1, t, cos, sin] and of the five series [y, g0..g3]
    t = decimal_year(date) - F.lit(TIME_ORIGIN)
    cs, sn = annual_terms(t)
    j = j.withColumns({"_t": t, "_c": cs, "_n": sn, "_1": F.lit(1.0)})
    design, series = ["_1", "_t", "_c", "_n"], ["_y", "_g0", "_g1", "_g2", "_g3"]
    aggs = [F.sum(F.col(a) * F.col(b)).alias(f"_dd_{i}_{k}") for i, a in enumerate(design) for k, b in enumerate(design) if k >= i]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"_ds_{i}_{k}") for i, a in enumerate(design) for k, b in enumerate(series)]
    aggs += [F.sum(F.col(a) * F.col(b)).alias(f"_ss_{i}_{k}") for i, a in enumerate(series) for k, b in enumerate(series) if k >= i]
    g = j.groupBy(*bk).agg(*aggs)

    # candidates of each bracket, one row each; the residual is a fixed linear mix of the five series
    def inside(grid, axis):
        out = {}
        for v in grid:
            for k in range(len(axis) - 1):
                if axis[k] - 1e-12 <= v <= axis[k + 1] + 1e-12:
                    out.setdefault(k, []).append((float(v), min(max((v - axis[k]) / (axis[k + 1] - axis[k]), 0.0), 1.0)))
                    break
        return out

    def options(bucket: str, table, name: str) -> Column:
        arr = F.array().cast("array<struct<v:double,f:double>>")
        for k, vals in table.items():
            lits = F.array(*[F.struct(F.lit(v).alias("v"), F.lit(f).alias("f")) for v, f in vals])
            arr = F.when(F.col(bucket) == k, lits).otherwise(arr)
        return F.explode(arr).alias(name)

    g = g.select("*", options("bp", inside(p_grid, p_axis), "_cp"))
    g = g.select("*", options("bm", inside(m_grid, m_axis), "_cm"))
    fp, fm = F.col("_cp.f"), F.col("_cm.f")
    g = g.withColumns({"_w0": (1 - fp) * (1 - fm), "_w1": (1 - fp) * fm, "_w2": fp * (1 - fm), "_w3": fp * fm})
    mix = [F.lit(1.0)] + [-F.col(f"_w{k}") for k in range(4)]

    def mixed(i: int) -> Column:
        e = F.lit(0.0)
        for k in range(5):
            e = e + F.when(mix[k] == 0, F.lit(0.0)).otherwise(mix[k] * F.col(f"_ds_{i}_{k}"))
        return e

    cols = {f"_b_{i}": mixed(i) for i in range(4)}
    ss = F.lit(0.0)
    for i in range(5):
        for k in range(i, 5):
            f = mix[i] * mix[k] * (1.0 if i == k else 2.0)
            ss = ss + F.when(f == 0, F.lit(0.0)).otherwise(f * F.col(f"_ss_{i}_{k}"))
    cols["_rr"] = ss
    g = g.withColumns(cols)
    n, r1 = F.col("_dd_0_0"), F.col("_b_0")
    g = g.withColumn("_rmse", F.sqrt(F.greatest(F.lit(0.0), F.col("_rr") / n - (r1 / n) * (r1 / n))))
    g = g.withColumns({f"_a_{i}_{k}": F.col(f"_dd_{i}_{k}") for i in range(4) for k in range(i, 4)})
    from .fit import solve_normal

    keep = ["_rmse", "_cp", "_cm"]
    sub = g.select(*bk, *keep, *[c for c in g.columns if c.startswith(("_a_", "_b_"))])
    sub = solve_normal(sub, ["k0", "k1", "k2", "k3"])
    p, m = F.col("_cp.v"), F.col("_cm.v")
    amp = F.sqrt(F.col("k2") * F.col("k2") + F.col("k3") * F.col("k3"))
    if calibrate_to == "all":
        misfit = F.lit(1 - seasonality_weight) * F.col("_rmse") + F.lit(seasonality_weight) * amp
    elif calibrate_to == "trend":
        misfit = F.lit(1 - seasonality_weight) * F.abs("k1")
    else:
        raise ValueError("use cost_from_residuals for the other targets")
    cost = misfit * origin_factor(p, m, penalty, melt_weight)
    out = sub.select(*keys, p.alias("pscale"), m.alias("mscale"), F.col("_rmse").alias("rmse"), amp.alias("amplitude"), cost.alias("cost"))
    return out if all_costs else best_cost(out, keys)


def best_cost(costs: DataFrame, keys: list[str]) -> DataFrame:
    pick = F.min_by(F.struct("pscale", "mscale", "rmse", "amplitude", "cost"), F.struct("cost", "pscale", "mscale"))
    return costs.groupBy(*keys).agg(pick.alias("_b")).select(*keys, "_b.*")


def cost_from_residuals(
    residuals: DataFrame, keys: list[str], date: str = "date", value: str = "residual", calibrate_to: str = "all",
    seasonality_weight: float = SEASONALITY_WEIGHT, penalty: float = ORIGIN_PENALTY, melt_weight: float = MELT_TO_PRECIP_WEIGHT,
) -> DataFrame:
    """Cost of explicit residual series; keys include pscale and mscale (CAL2).  Targets: all, trend,
    annual (residuals nearest the seasonal minimum of each year) and five_year (trends of 5-year bins)."""
    ref = residuals.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    r = residuals.join(ref, keys).withColumn("_r", F.col(value) - F.col("_mean")).drop("_mean")
    fac = origin_factor(F.col("pscale"), F.col("mscale"), penalty, melt_weight)
    ws = F.lit(1 - seasonality_weight)
    if calibrate_to == "five_year":
        b = F.floor(F.year(date) / 5)
        tr = ols(r.withColumn("_five", b), [*keys, "_five"], "_r", seasonal_terms(date))
        g = tr.where(F.col("c1").isNotNull()).groupBy(*keys).agg(F.sqrt(F.avg(F.col("c1") * F.col("c1"))).alias("_m"))
        return g.select(*keys, (ws * F.col("_m") * fac).alias("cost"))
    fit = ols(r, keys, "_r", seasonal_terms(date), extra={"_ss": F.avg(F.col("_y") * F.col("_y"))})
    if calibrate_to == "all":
        amp = F.sqrt(F.col("p_cos") * F.col("p_cos") + F.col("p_sin") * F.col("p_sin"))
        return fit.select(*keys, ((ws * F.sqrt("_ss") + F.lit(seasonality_weight) * amp) * fac).alias("cost"))
    if calibrate_to == "trend":
        return fit.select(*keys, (ws * F.abs("c1") * fac).alias("cost"))
    if calibrate_to != "annual":
        raise ValueError(f"unknown target {calibrate_to}")
    from ..functions.models import phase_month

    low = fit.select(*keys, (F.pmod(phase_month("p_cos", "p_sin") + 5, F.lit(12)) + 1).alias("_month"))
    span = r.groupBy(*keys).agg(F.min(F.year(date)).alias("_y0"), F.max(F.year(date)).alias("_y1"))
    j = r.join(low, keys).join(span, keys)
    y = F.year(date)
    j = j.withColumn("_year", F.explode(F.array(y - 1, y, y + 1))).where(F.col("_year").between(F.col("_y0"), F.col("_y1")))
    gap = F.abs(F.datediff(F.col(date), F.make_date("_year", "_month", F.lit(15))))
    near = j.groupBy(*keys, "_year").agg(F.min_by("_r", F.struct(gap, F.col(date))).alias("_v"))
    g = near.groupBy(*keys).agg(F.sqrt(F.avg(F.col("_v") * F.col("_v"))).alias("_m"))
    return g.select(*keys, (ws * F.col("_m") * fac).alias("cost"))
