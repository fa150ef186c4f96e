"""Least-squares fits per group from sums of products.

Every linear fit is one map-side combined aggregate (a handful of doubles per group cross the
shuffle, whatever the group size) followed by an LDL' solve written as Column arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import decimal_year
from ..functions.models import amplitude, annual_terms, phase_day, phase_month
from ..functions.numeric import bin_center, bin_index, col
from .robust import let, medians_of_many

TIME_ORIGIN = 2000.0  # integer, so the annual terms keep their phase


def normal_sums(x: dict[str, Column], y: Column, weight: Column | None = None) -> list[Column]:
    """Aggregates of the normal equations, named _a_i_j and _b_i."""
    w = F.lit(1.0) if weight is None else weight
    xs = list(x.values())
    out = []
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            out.append(F.sum(w * xs[i] * xs[j]).alias(f"_a_{i}_{j}"))
        out.append(F.sum(w * xs[i] * y).alias(f"_b_{i}"))
    return out


def solve_normal(df: DataFrame, names: list[str], rel_tol: float = 1e-10) -> DataFrame:
    """Append the solution columns ``names`` from _a_i_j, _b_i (LDL'); NULL for a singular system.

    The factorisation is one nested expression whose steps are bound once each, so that a filter pushed
    below it by the optimizer cannot multiply it out."""
    p = len(names)

    def factor(k: int, done: list[Column]) -> Column:
        """Column k of L as struct (d, z, l_{k+1}, ...), then the rest; ``done`` holds the earlier ones."""
        if k == p:
            return back(p - 1, done, {})
        d = F.col(f"_a_{k}_{k}")
        for c in done:
            d = d - c[f"l{k}"] * c[f"l{k}"] * c["d"]
        d = F.when(d > F.abs(F.col(f"_a_{k}_{k}")) * rel_tol, d)
        z = F.col(f"_b_{k}")
        for c in done:
            z = z - c[f"l{k}"] * c["z"]
        low = []
        for i in range(k + 1, p):
            e = F.col(f"_a_{k}_{i}")
            for c in done:
                e = e - c[f"l{i}"] * c[f"l{k}"] * c["d"]
            low.append((e / d).alias(f"l{i}"))
        return let(F.struct(d.alias("d"), z.alias("z"), *low), lambda c: factor(k + 1, [*done, c]))

    def back(k: int, cols: list[Column], x: dict[int, Column]) -> Column:
        if k < 0:
            return F.struct(*[x[i].alias(names[i]) for i in range(p)])
        e = cols[k]["z"] / cols[k]["d"]
        for i in range(k + 1, p):
            e = e - cols[k][f"l{i}"] * x[i]
        return let(e, lambda v: back(k - 1, cols, {**x, k: v}))

    keep = [c for c in df.columns if not c.startswith(("_a_", "_b_"))]
    solved = df.select(*keep, factor(0, []).alias("_sol"))
    return solved.select(*[c for c in keep if c not in names], *[F.col("_sol")[n].alias(n) for n in names])


def ols(df: DataFrame, keys: list[str], y: str | Column, x: dict[str, Column], weight: str | Column | None = None, extra: dict[str, Column] | None = None) -> DataFrame:
    """Weighted least squares of y on the named regressors per group; one row per group with the
    coefficients and ``n`` (user-model hook for models linear in their coefficients)."""
    d = df.select(*keys, col(y).cast("double").alias("_y"), *[e.alias(f"_x_{n}") for n, e in x.items()],
                  *([col(weight).cast("double").alias("_w")] if weight is not None else []))
    d = d.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    cols = {n: F.col(f"_x_{n}") for n in x}
    sums = normal_sums(cols, F.col("_y"), F.col("_w") if weight is not None else None)
    more = [e.alias(n) for n, e in (extra or {}).items()]
    g = d.groupBy(*keys).agg(*sums, F.count(F.lit(1)).alias("n"), *more)
    return solve_normal(g, list(x))


def seasonal_terms(date: str | Column, acceleration: bool = False) -> dict[str, Column]:
    t = decimal_year(date) - F.lit(TIME_ORIGIN)
    c, s = annual_terms(t)
    x = {"c0": F.lit(1.0), "c1": t}
    if acceleration:
        x["c2"] = t * t
    x["p_cos"], x["p_sin"] = c, s
    return x


def seasonal_fit(
    df: DataFrame, keys: list[str], date: str, value: str, acceleration: bool = False,
    phase: str = "table", interval: tuple[str | None, str | None] | None = None,
) -> DataFrame:
    """Offset, trend, [acceleration], amplitude, phase day and month per group (FIT1-FIT4).

    The time axis is centred on ceil(mean t); an integer shift, so only the offset and (with
    acceleration) the trend depend on it.  ``acceleration`` is the t^2 coefficient (S8).
    ``interval`` is an open date window.
    """
    if interval is not None:
        lo, hi = interval
        if lo is not None:
            df = df.where(F.col(date) > F.lit(lo).cast("date"))
        if hi is not None:
            df = df.where(F.col(date) < F.lit(hi).cast("date"))
    x = seasonal_terms(date, acceleration)
    g = ols(df, keys, value, x, extra={"_tmean": F.avg("_x_c1")})
    shift = F.ceil(F.round(F.col("_tmean"), 9)).cast("double")
    c2 = F.col("c2") if acceleration else F.lit(0.0)
    out = [
        *keys, F.col("n"),
        (F.col("c0") + F.col("c1") * shift + c2 * shift * shift).alias("offset"),
        (F.col("c1") + 2.0 * c2 * shift).alias("trend"),
    ]
    if acceleration:
        out.append(F.col("c2").alias("acceleration"))
    out += [
        amplitude("p_cos", "p_sin").alias("amplitude"),
        phase_day("p_cos", "p_sin", phase).alias("phase_day"),
        phase_month("p_cos", "p_sin", "series").alias("phase_month"),
        F.col("p_cos"), F.col("p_sin"),
    ]
    return g.select(*out)


def region_trends(df: DataFrame, keys: list[str], date: str, value: str, interval: tuple[str, str] | None = None) -> DataFrame:
    """Trend from the 4-coefficient fit; acceleration, amplitude and phase from the 5-coefficient
    fit (FIT3, FIT4).  Both systems share one pass of sums.  ``interval`` is closed."""
    if interval is not None:
        df = df.where(F.col(date).between(F.lit(interval[0]).cast("date"), F.lit(interval[1]).cast("date")))
    # order the regressors so that the 4-coefficient system is a leading block of the 5-coefficient one
    t = decimal_year(date) - F.lit(TIME_ORIGIN)
    c, s = annual_terms(t)
    x = {"c0": F.lit(1.0), "c1": t, "p_cos": c, "p_sin": s, "c2": t * t}
    d = df.select(*keys, F.col(value).cast("double").alias("_y"), *[e.alias(f"_x_{n}") for n, e in x.items()])
    d = d.where(F.col("_y").isNotNull() & ~F.isnan("_y"))
    g = d.groupBy(*keys).agg(*normal_sums({n: F.col(f"_x_{n}") for n in x}, F.col("_y")), F.count(F.lit(1)).alias("n"))
    keep = {c: F.col(c) for c in g.columns}
    four = solve_normal(g.withColumns({f"_keep{c}": v for c, v in keep.items() if c.startswith("_")}), ["k0", "trend", "kc", "ks"])
    back = four.withColumns({c[len("_keep"):]: F.col(c) for c in four.columns if c.startswith("_keep")})
    back = back.drop(*[c for c in back.columns if c.startswith("_keep")])
    five = solve_normal(back, ["c0", "c1", "p_cos", "p_sin", "acceleration"])
    return five.select(
        *keys, "n", "trend", "acceleration", amplitude("p_cos", "p_sin").alias("amplitude"),
        phase_day("p_cos", "p_sin", "table").alias("phase"),
    )


def curvature_coefficients(df: DataFrame, keys: list[str], curvature: str, value: str, lo: float = -1.0, hi: float = 1.0, width: float = 0.1, degree: int = 4) -> DataFrame:
    """Quartic through the binned medians weighted by their counts; groups with too few bins have no
    row (FIT5)."""
    n_bins = int(round((hi - lo) / width))
    d = df.where(F.col(value).isNotNull() & F.col(curvature).isNotNull())
    d = d.withColumn("_bin", bin_index(curvature, lo, width)).where(F.col("_bin").between(0, n_bins - 1))
    b = medians_of_many(d, [*keys, "_bin"], value, "_m").withColumnRenamed("nobs", "_n").withColumn("_c", bin_center("_bin", lo, width))
    powers = {"q0": F.lit(1.0)}
    for k in range(1, degree + 1):
        powers[f"q{k}"] = F.pow(F.col("_c"), F.lit(float(k)))
    fit = ols(b, keys, "_m", powers, weight="_n")
    return fit.where(F.col("n") > degree + 1)


def curvature_correct(df: DataFrame, off_mask: DataFrame, keys: list[str], curvature: str, value: str, **axis) -> DataFrame:
    """Subtract the polynomial bias estimated on ``off_mask`` rows; unfitted groups are unchanged (FIT5)."""
    return curvature_subtract(df, curvature_coefficients(off_mask, keys, curvature, value, **axis), keys, curvature, value)


def curvature_subtract(df: DataFrame, fit: DataFrame, keys: list[str], curvature: str, value: str, out: str | None = None) -> DataFrame:
    """``out`` (else ``value`` itself) without the polynomial of ``curvature_coefficients``."""
    names = [c for c in fit.columns if c.startswith("q")]
    j = df.join(fit.select(*keys, *names), keys, "left")
    bias = F.col(names[-1])
    for c in reversed(names[:-1]):
        bias = bias * F.col(curvature) + F.col(c)
    return j.withColumn(out or value, F.col(value) - F.coalesce(bias, F.lit(0.0))).drop(*names)


EQUILIBRIUM = ("1979-01-01", "2000-01-01")  # fixed value: the period in which ice bodies count as steady, both ends included


def steady_discharge(df: DataFrame, keys: list[str], date: str, smb: str, area: str, lat: str, max_latitude: float = -60.0, period: tuple[str, str] = EQUILIBRIUM) -> DataFrame:
    """Discharge that balances the mean SMB rate of each ice body below a latitude over the period in
    which it was steady (FIT13)."""
    d = df.where((F.col(lat) < max_latitude) & F.col(date).between(*(F.lit(p).cast("date") for p in period)))
    g = d.groupBy(*keys).agg(F.regr_slope(F.col(smb), decimal_year(date)).alias("_rate"), F.first(area).alias("_area"))
    return g.select(*keys, (F.col("_rate") * F.col("_area") / 1000.0).alias("discharge_gtyr"))


def fill_discharge(observed: DataFrame, modelled: DataFrame) -> DataFrame:
    """Observed and modelled discharge, one below the other; negatives become zero (FIT14).  A body that is
    observed and modelled has two rows: the modelled bodies are a region without observations."""
    u = observed.unionByName(modelled, allowMissingColumns=True)
    return u.withColumn("discharge_gtyr", F.when(F.col("discharge_gtyr") < 0, F.lit(0.0)).otherwise(F.col("discharge_gtyr")))


def allocate_by_area(tiles: DataFrame, bodies: DataFrame, tile: str, value: str, area: str) -> DataFrame:
    """Share a tile total among its bodies by area (FIT14); the tile area is a combined aggregate."""
    whole = bodies.groupBy(tile).agg(F.sum(area).alias("_whole"))
    j = bodies.join(whole, tile).join(tiles.select(tile, value), tile)
    return j.withColumn(value, F.when(F.col("_whole") > 0, F.col(value) * F.col(area) / F.col("_whole"))).drop("_whole")


def total_between(df: DataFrame, value: str, lo: float, hi: float) -> DataFrame:
    """One row: the total of a column and whether it lies in a sane range (FIT14)."""
    return df.agg(F.sum(value).alias("total")).withColumn("sane", F.coalesce(F.col("total").between(lo, hi), F.lit(False)))


def scale_classes(df: DataFrame, keys: list[str], pscale: str, value: str, new: list[float]) -> DataFrame:
    """Values at new scale classes: linear between known classes, a line through the outermost three
    beyond them (all when three or fewer), never negative; fewer than two usable classes give zero
    (FIT15).  A group holds the few classes of one cell, so arrays are bounded."""
    pts = F.sort_array(F.collect_list(F.struct(F.col(pscale).cast("double").alias("x"), F.col(value).alias("y"))))
    g = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(pts.alias("_p"))
    g = g.withColumn("_ok", F.filter("_p", lambda p: p["y"] >= 0)).withColumn("_n", F.size("_ok"))
    g = g.withColumn(pscale, F.explode(F.array(*[F.lit(float(v)) for v in new])))
    x = F.col(pscale)
    # interpolation uses every class
    g = g.withColumn("_lo", F.try_element_at(F.filter("_p", lambda p: p["x"] <= x), F.lit(-1)))
    g = g.withColumn("_hi", F.try_element_at(F.filter("_p", lambda p: p["x"] >= x), F.lit(1)))
    lo, hi = F.col("_lo"), F.col("_hi")
    inner = F.when(lo["x"] == hi["x"], lo["y"]).otherwise(lo["y"] + (hi["y"] - lo["y"]) * (x - lo["x"]) / (hi["x"] - lo["x"]))
    three = F.when(F.col("_n") <= 3, F.col("_ok")).when(lo.isNull(), F.slice("_ok", 1, 3)).otherwise(F.slice("_ok", -3, 3))
    g = g.withColumn("_e", three)
    m = F.size("_e").cast("double")

    def acc(f):
        return F.aggregate("_e", F.lit(0.0), lambda a, p: a + f(p))

    g = g.withColumns({"_sx": F.try_divide(acc(lambda p: p["x"]), m), "_sy": F.try_divide(acc(lambda p: p["y"]), m)})
    sxx = acc(lambda p: (p["x"] - F.col("_sx")) * (p["x"] - F.col("_sx")))
    sxy = acc(lambda p: (p["x"] - F.col("_sx")) * (p["y"] - F.col("_sy")))
    outer = F.col("_sy") + F.try_divide(sxy, sxx) * (x - F.col("_sx"))
    y = F.when(F.col("_n") < 2, F.lit(0.0)).when(lo.isNotNull() & hi.isNotNull(), inner).otherwise(outer)
    return g.select(*keys, pscale, F.greatest(F.lit(0.0), y).alias(value))
