"""Gap filling, amplitude normalisation and cross-sensor alignment of binned cubes."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.dates import DATE_AXIS_START, DATE_AXIS_STEP, decimal_year
from ..functions.models import surface_season
from .binning import area_average
from .robust import MAD_TO_SIGMA
from .spatial import nearest
from .windows import dilate, interpolate, true_run_length, with_valid_range

# fixed values: bounds of the nine surface coefficients (const, t, t^2, h, h^2, phase, s, s h, s h^2)
LOWER = [-10.0, -3.0, -2.0, -0.05, -0.0001, -1.0, -7.0, -0.05, -0.001]
UPPER = [10.0, 3.0, 2.0, 0.05, 0.0001, 1.0, 7.0, 0.05, 0.001]
N_SURFACE = 9


def axis_decimal_year(index: np.ndarray, start: str = DATE_AXIS_START, step: int = DATE_AXIS_STEP) -> np.ndarray:
    """Decimal year of the bin centres."""
    d0 = dt.date.fromisoformat(start)
    days = [d0 + dt.timedelta(days=int(i) * step + step // 2) for i in index]
    return np.array([d.year + d.timetuple().tm_yday / (366 if d.year % 4 == 0 and (d.year % 100 != 0 or d.year % 400 == 0) else 365) for d in days])


def _basis(t, h):
    """Columns const, t, t^2, h, h^2 and the sine and cosine blocks times 1, h, h^2."""
    s, c = np.sin(2 * np.pi * t), np.cos(2 * np.pi * t)
    one = np.ones_like(t)
    return np.column_stack([one, t, t * t, h, h * h, s, s * h, s * h * h, c, c * h, c * h * h])


def _boxed_quadratic(G, b, lo, hi):
    """Minimise x'Gx/2 - b'x in a box by an active set: solve for the free coefficients, pin the one that
    leaves the box furthest, release a pinned one whose gradient points inward."""
    d = np.sqrt(np.maximum(np.diag(G), 1e-300))
    G, b, lo, hi = G / np.outer(d, d), b / d, lo * d, hi * d  # unit diagonal
    G = G + 1e-12 * np.eye(len(b))
    pin = np.zeros(len(b), dtype=int)
    x = np.zeros(len(b))
    for _ in range(6 * len(b)):
        free = pin == 0
        x = np.where(pin < 0, lo, np.where(pin > 0, hi, x))
        if free.any():
            x[free] = np.linalg.solve(G[np.ix_(free, free)], b[free] - G[np.ix_(free, ~free)] @ x[~free])
        out = np.where(free, np.maximum(lo - x, x - hi) / np.maximum(hi - lo, 1e-300), -1.0)
        worst = int(np.argmax(out))
        if out[worst] > 1e-12:
            pin[worst] = -1 if x[worst] < lo[worst] else 1
            continue
        grad = G @ x - b
        back = np.where(pin < 0, -grad, np.where(pin > 0, grad, -1.0))
        worst = int(np.argmax(back))
        if back[worst] <= 1e-9 * (1 + np.abs(b).max()):
            break
        pin[worst] = 0
    return np.clip(x, lo, hi) / d


def fit_surface(t, h, y, w):
    """Weighted bounded fit of the nine-coefficient surface.  For a fixed phase the model is linear in the
    other eight, and their normal equations follow from one 11 x 11 Gram matrix, so the phase is scanned
    and refined without touching the data again."""
    B = _basis(t, h)
    A = B.T @ (B * w[:, None])
    r = B.T @ (w * y)
    yy = float(np.sum(w * y * y))
    lo = np.array(LOWER[:5] + LOWER[6:])
    hi = np.array(UPPER[:5] + UPPER[6:])

    def at(phase):
        s, c = math.cos(2 * math.pi * phase), math.sin(2 * math.pi * phase)
        T = np.zeros((11, 8))
        T[:5, :5] = np.eye(5)
        for k in range(3):
            T[5 + k, 5 + k], T[8 + k, 5 + k] = s, c
        G, b = T.T @ A @ T, T.T @ r
        x = _boxed_quadratic(G, b, lo, hi)
        return yy - 2 * b @ x + x @ G @ x, x

    phases = np.linspace(-0.25, 0.25, 33)
    cost = [at(p)[0] for p in phases]
    k = int(np.argmin(cost))
    a, b = phases[k] - 1 / 64, phases[k] + 1 / 64
    g = (math.sqrt(5) - 1) / 2
    p1, p2 = b - g * (b - a), a + g * (b - a)
    f1, f2 = at(p1)[0], at(p2)[0]
    for _ in range(40):
        if f1 <= f2:
            b, p2, f2 = p2, p1, f1
            p1 = b - g * (b - a)
            f1 = at(p1)[0]
        else:
            a, p1, f1 = p1, p2, f2
            p2 = a + g * (b - a)
            f2 = at(p2)[0]
    phase = (a + b) / 2
    x = at(phase)[1]
    return np.concatenate([x[:5], [phase], x[5:]])


def eval_surface(t, h, p):
    s = np.sin(2 * np.pi * (t + p[5]))
    return p[0] + p[1] * t + p[2] * t * t + p[3] * h + p[4] * h * h + s * (p[6] + p[7] * h + p[8] * h * h)


def spread(df: DataFrame, keys: list[str]) -> DataFrame:
    """Partition by key with the session's full partition count.  The fits are heavy and their input small:
    left alone, partition coalescing by bytes would put all of them in one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def _no_rows(columns):
    return pd.DataFrame({c: pd.Series(dtype=object) for c in columns})


def _nmad(x):
    a = np.abs(x - np.median(x))
    m = np.median(a) * MAD_TO_SIGMA
    return np.where(a == 0, 0.0, np.inf) if m == 0 else a / m


def _smooth_residuals(t, h, res, tq, hq, n, chunk=512):
    """Median over the n nearest cells, spread to the query cells with inverse squared distance."""
    med = np.empty(len(t))
    for i in range(0, len(t), chunk):
        d = (t[i : i + chunk, None] - t[None]) ** 2 + (h[i : i + chunk, None] - h[None]) ** 2
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        med[i : i + chunk] = np.median(res[near], axis=1)
    out = np.empty(len(tq))
    for i in range(0, len(tq), chunk):
        d = (tq[i : i + chunk, None] - t[None]) ** 2 + (hq[i : i + chunk, None] - h[None]) ** 2
        exact = d <= 1e-24
        w = 1.0 / np.maximum(d, 1e-24)
        v = (w * med[None]).sum(1) / w.sum(1)
        hit = exact.any(1)
        out[i : i + chunk] = np.where(hit, (exact * med[None]).sum(1) / np.maximum(exact.sum(1), 1), v)
    return out


FILL_SCHEMA = "date_index int, height_index int, dh double, nobs long, t0 double, h0 double, dh0 double, param array<double>"


def surface_model_fill(
    binned: DataFrame, keys: list[str], settings: DataFrame, height_width: float = 100.0, span_keys: list[str] = ["mission"],
    axis_start: str = DATE_AXIS_START, axis_step: int = DATE_AXIS_STEP,
) -> DataFrame:
    """Fill the valid rectangle of every (run, sensor, tile) from a bounded surface fit plus smoothed
    residuals (FIT7).  ``binned`` has keys + date_index, height_index, dh, nobs; ``settings`` has
    mission, bincount_min, smooth_n, nmad_max, length_scale.

    Count and size filters, and the date range that all tiles of a sensor share, are SQL.  The fit itself
    runs on one cube per task: a cube has at most 438 x 100 cells, whatever the number of points behind it."""
    d = binned.join(settings, "mission")
    raw_span = binned.where(F.col("dh").isNotNull()).groupBy(*span_keys).agg(F.min("date_index").alias("_d0"), F.max("date_index").alias("_d1"))
    d = d.where((F.col("nobs") > F.col("bincount_min")) & (F.abs("dh") < 200.0)).join(raw_span, span_keys)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in binned.select(*keys).schema) + ", " + FILL_SCHEMA

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        empty = _no_rows([*keys, *[p.split()[0] for p in FILL_SCHEMA.split(", ")]])
        if len(pdf) <= N_SURFACE + 2:
            return empty
        one = pdf.iloc[0]
        dates = np.arange(int(one["_d0"]), int(one["_d1"]) + 1)
        heights = np.arange(int(pdf["height_index"].min()), int(pdf["height_index"].max()) + 1)
        t_axis = axis_decimal_year(dates, axis_start, axis_step)
        h_axis = (heights + 0.5) * height_width
        t_mean, h_mean = float(np.round(t_axis.mean())), float(h_axis.mean())
        t_axis, h_axis = t_axis - t_mean, h_axis - h_mean
        ti = pdf["date_index"].to_numpy() - dates[0]
        hi = pdf["height_index"].to_numpy() - heights[0]
        t, h = t_axis[ti], h_axis[hi]
        y, w = pdf["dh"].to_numpy(float), pdf["nobs"].to_numpy(float)
        level = float(np.median(y)) + 1e-7
        y = y - level
        p = fit_surface(t, h, y, w)
        keep = _nmad(y - eval_surface(t, h, p)) <= float(one["nmad_max"])
        if keep.sum() <= N_SURFACE + 2:
            return empty
        if not keep.all():
            t, h, y, w, ti, hi = t[keep], h[keep], y[keep], w[keep], ti[keep], hi[keep]
            p = fit_surface(t, h, y, w)
        res = y - eval_surface(t, h, p)
        T, H = (a.ravel() for a in np.meshgrid(t_axis, h_axis, indexing="ij"))
        n, scale = int(one["smooth_n"]), float(one["length_scale"])
        extra = np.zeros(len(T)) if len(y) < n else _smooth_residuals(t, h / scale, res, T, H / scale, n)
        nobs = np.zeros((len(dates), len(heights)), dtype=np.int64)
        nobs[ti, hi] = w.astype(np.int64)
        D, E = (a.ravel() for a in np.meshgrid(dates, heights, indexing="ij"))
        out = {k: [one[k]] * len(T) for k in keys}
        out |= {"date_index": D.astype(np.int32), "height_index": E.astype(np.int32), "dh": eval_surface(T, H, p) + level + extra,
                "nobs": nobs.ravel(), "t0": t_mean, "h0": h_mean, "dh0": level, "param": [p.tolist()] * len(T)}
        return pd.DataFrame(out)

    return spread(d, keys).groupBy(*keys).applyInPandas(work, schema)


def split_params(filled: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(cube, one coefficient row per key) of :func:`surface_model_fill`."""
    par = filled.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("t0", "h0", "dh0", "param")], F.sum("nobs").alias("nobs_final"))
    return filled.drop("t0", "h0", "dh0", "param"), par


def replace_with_model(
    cube: DataFrame, tile_list: DataFrame, target: str, preferred: list[str], run: list[str] = [], height_width: float = 100.0,
    axis_start: str = DATE_AXIS_START, axis_step: int = DATE_AXIS_STEP, tile: str = "tile_id",
) -> DataFrame:
    """In the listed tiles overwrite the target sensor with a surface fitted to the preferred sensors, the
    first valid one winning per cell; nobs = 9999 (FIT6).  Tiles where a preferred sensor has no data stay as
    they are.  A cube of one (run, tile) has at most dates x heights x sensors cells."""
    keys = [*run, tile]
    d = cube.join(tile_list.select(tile), tile, "left_semi").where(F.col("mission").isin(target, *preferred) & F.col("dh").isNotNull())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cube.select(*keys).schema) + ", date_index int, height_index int, dh double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        none = _no_rows([*keys, "date_index", "height_index", "dh"])
        parts = [pdf[pdf["mission"] == m] for m in preferred]
        if any(len(p) == 0 for p in parts):
            return none
        ref = pd.concat(parts).drop_duplicates(["date_index", "height_index"], keep="first")
        h0, h1 = int(ref["height_index"].min()), int(ref["height_index"].max())
        own = pdf[(pdf["mission"] == target) & pdf["height_index"].between(h0, h1)]
        if len(own) == 0:
            return none
        dates = np.arange(int(own["date_index"].min()), int(own["date_index"].max()) + 1)
        heights = np.arange(h0, h1 + 1)
        tm = axis_decimal_year(dates, axis_start, axis_step).mean()
        hm = ((heights + 0.5) * height_width).mean()
        t = axis_decimal_year(ref["date_index"].to_numpy(), axis_start, axis_step) - tm
        h = (ref["height_index"].to_numpy() + 0.5) * height_width - hm
        y, w = ref["dh"].to_numpy(float), ref["nobs"].to_numpy(float) + 1.0
        D, E = (a.ravel() for a in np.meshgrid(dates, heights, indexing="ij"))
        T, H = axis_decimal_year(D, axis_start, axis_step) - tm, (E + 0.5) * height_width - hm
        if len(heights) == 1:
            x = lambda q: np.column_stack([np.ones_like(q), q, q * q, np.sin(2 * np.pi * q), np.cos(2 * np.pi * q)])
            sw = np.sqrt(w)
            b = np.linalg.lstsq(x(t) * sw[:, None], y * sw, rcond=None)[0]
            v = x(T) @ b
        else:
            v = eval_surface(T, H, fit_surface(t, h, y, w))
        one = pdf.iloc[0]
        return pd.DataFrame({**{k: [one[k]] * len(v) for k in keys}, "date_index": D.astype(np.int32), "height_index": E.astype(np.int32), "dh": v})

    made = spread(d, keys).groupBy(*keys).applyInPandas(work, schema)
    made = made.withColumn("mission", F.lit(target)).withColumn("nobs", F.lit(9999).cast("long")).select(*cube.columns)
    rest = cube.join(made.select(*keys, "mission", "date_index", "height_index"), [*keys, "mission", "date_index", "height_index"], "left_anti")
    return rest.unionByName(made)


def amplitude_normalize(cube: DataFrame, params: DataFrame, ref_params: DataFrame, on: list[str], t: str = "t", h: str = "height_bin", value: str = "dh") -> DataFrame:
    """Add (reference season - own season) (FIT8).  Cells of tiles without both fits are unchanged."""
    a = params.select(*on, F.col("t0").alias("_t0"), F.col("h0").alias("_h0"), F.col("param").alias("_p"))
    b = ref_params.select(*on, F.col("t0").alias("_rt0"), F.col("h0").alias("_rh0"), F.col("param").alias("_rp"))
    j = cube.join(a, on, "left").join(b, on, "left")
    own = surface_season(F.col(t) - F.col("_t0"), F.col(h) - F.col("_h0"), F.col("_p"))
    ref = surface_season(F.col(t) - F.col("_rt0"), F.col(h) - F.col("_rh0"), F.col("_rp"))
    return j.withColumn(value, F.col(value) + F.coalesce(ref - own, F.lit(0.0))).drop("_t0", "_h0", "_p", "_rt0", "_rh0", "_rp")


def mission_offsets(cube: DataFrame, hyps: DataFrame, keys: list[str], time: str, reference: list[str], mission: str = "mission", value: str = "dh", **cols) -> DataFrame:
    """Offset of each sensor and tile from the reference sensors: median over common dates of the
    difference of area means per reference, averaged with weight sqrt(nobs of the aligned sensor) (FIT9, S13)."""
    series = area_average(cube, hyps, [*keys, mission, time], value, **cols)
    n = cube.where(F.col(value).isNotNull()).groupBy(*keys, mission).agg(F.sum("nobs").alias("_n"))
    own = series.where(~F.col(mission).isin(reference))
    ref = series.where(F.col(mission).isin(reference)).select(*keys, time, F.col(mission).alias("_ref"), F.col(value).alias("_rv"))
    d = own.join(ref, [*keys, time]).withColumn("_d", F.col(value) - F.col("_rv"))
    # one value per date of the axis
    med = d.groupBy(*keys, mission, "_ref").agg(F.median("_d").alias("_m"))
    w = F.sqrt(F.col("_n").cast("double"))
    g = med.join(n, [*keys, mission]).groupBy(*keys, mission).agg(F.try_divide(F.sum(F.col("_m") * w), F.sum(w)).alias("offset"), F.count(F.lit(1)).alias("n_refs"))
    return g.where(F.col("offset").isNotNull())


def align(cube: DataFrame, offsets: DataFrame, keys: list[str], mission: str = "mission", value: str = "dh") -> DataFrame:
    """Subtract the offsets (FIT9)."""
    j = cube.join(offsets.select(*keys, mission, "offset"), [*keys, mission], "left")
    return j.withColumn(value, F.col(value) - F.coalesce("offset", F.lit(0.0))).drop("offset")


def fill_empty_tiles(
    cube: DataFrame, levels: DataFrame, targets: DataFrame, tiles: DataFrame, hyps: DataFrame, dims: list[str] = ["mission"],
    tile: str = "tile_id", time: str = "date_index", height: str = "height_index", value: str = "dh", k: int = 5,
) -> DataFrame:
    """Rows for empty target tiles from the k nearest tiles with data at overlapping elevations (FIT10).

    Each neighbour is reduced by its level, cells take the median, profiles are interpolated and
    extended linearly over the has-area range, and the median level is added back; a tile without area
    gives 0 rows of value 0 on the sensor's dates.  ``levels``: dims + tile + level; ``targets``: dims + tile;
    ``tiles``: tile, lon, lat; ``hyps``: tile, height, area_km2.

    Neighbours are searched per elevation bin: the k nearest over a range of bins are among the k nearest
    of its bins, so the search needs no tile-by-tile product."""
    band = hyps.where(F.col("area_km2") > 0).groupBy(tile).agg(F.min(height).alias("_h0"), F.max(height).alias("_h1"))
    t = targets.join(band, tile).join(tiles.select(tile, "lon", "lat"), tile)
    q = t.withColumn(height, F.explode(F.sequence("_h0", "_h1")))
    have = cube.where(F.col(value).isNotNull()).select(*dims, tile, height).distinct().join(tiles.select(tile, "lon", "lat"), tile)
    near = nearest(q, have, k, tile, tile, by=[*dims, height])
    near = near.groupBy(*dims, tile, f"{tile}_2").agg(F.min("meters").alias("meters"))
    r = F.row_number().over(W.partitionBy(*dims, tile).orderBy("meters", f"{tile}_2"))  # k x heights rows
    near = near.withColumn("_r", r).where(F.col("_r") <= k).select(*dims, F.col(tile).alias("_target"), F.col(f"{tile}_2").alias(tile))
    near = near.join(levels.select(*dims, tile, "level"), [*dims, tile])
    src = near.join(cube.where(F.col(value).isNotNull()), [*dims, tile])
    src = src.join(t.select(*dims, F.col(tile).alias("_target"), "_h0", "_h1"), [*dims, "_target"]).where(F.col(height).between(F.col("_h0"), F.col("_h1")))
    med = src.groupBy(*dims, "_target", time, height).agg(F.median(F.col(value) - F.col("level")).alias(value))  # at most k values
    lev = near.groupBy(*dims, "_target").agg(F.median("level").alias("_level"))
    grid = med.select(*dims, "_target", time).distinct().join(t.select(*dims, F.col(tile).alias("_target"), "_h0", "_h1"), [*dims, "_target"])
    grid = grid.withColumn(height, F.explode(F.sequence("_h0", "_h1"))).drop("_h0", "_h1")
    full = interpolate(grid.join(med, [*dims, "_target", time, height], "left"), [*dims, "_target", time], height, value)
    out = full.join(lev, [*dims, "_target"]).select(*dims, F.col("_target").alias(tile), time, height, (F.col(value) + F.col("_level")).alias(value))
    return out


def profile_fill(profile: DataFrame, keys: list[str], cell: list[str], index: str, value: str, area: str, reach: int = 1, max_fraction: float = 0.1) -> DataFrame:
    """Fill a model elevation profile (FIT16): inner gaps up to 2 reach + 1 bins linearly; ends by ``reach`` bins,
    and further to the edge of the has-area range when less than ``max_fraction`` of the tile's area lies
    beyond; end values are held.  ``profile`` is dense in ``index`` with keys (tile), cell (date, scale)."""
    pk = [*keys, *cell]
    d = profile.withColumn("_ok", F.col(value).isNotNull())
    d = d.withColumn("_near", dilate("_ok", pk, index, reach))
    w = W.partitionBy(*pk)
    lo, hi = F.min(F.when(F.col("_near"), F.col(index))).over(w), F.max(F.when(F.col("_near"), F.col(index))).over(w)
    a0, a1 = F.min(F.when(F.col(area) > 0, F.col(index))).over(w), F.max(F.when(F.col(area) > 0, F.col(index))).over(w)
    d = d.withColumns({"_lo": lo, "_hi": hi, "_a0": a0, "_a1": a1, "_whole": F.sum(area).over(w)})
    below = F.try_divide(F.sum(F.when(F.col(index) < F.col("_lo"), F.col(area)).otherwise(0.0)).over(w), F.col("_whole"))
    above = F.try_divide(F.sum(F.when(F.col(index) > F.col("_hi"), F.col(area)).otherwise(0.0)).over(w), F.col("_whole"))
    d = d.withColumns({"_below": below, "_above": above})
    start = F.when((F.col("_below") > 0) & (F.col("_below") < max_fraction), F.col("_a0")).otherwise(F.col("_lo"))
    stop = F.when((F.col("_above") > 0) & (F.col("_above") < max_fraction), F.col("_a1")).otherwise(F.col("_hi"))
    d = d.withColumn("_fill", F.col(index).between(start, stop) & ~F.col("_ok"))
    d = with_valid_range(d, pk, index, value)
    inner = (F.col(index) > F.col("first_valid")) & (F.col(index) < F.col("last_valid"))
    d = true_run_length(d, pk, index, "_fill", "_run")
    # gaps wider than the limit keep only the bins near known ones
    wide = inner & (F.col("_run") > 2 * reach + 1)
    d = d.withColumn("_fill", F.col("_fill") & (~F.coalesce(wide, F.lit(False)) | F.col("_near")))
    full = interpolate(d, pk, index, value, out="_v", outside="flat")
    return full.withColumn(value, F.when(F.col("_ok") | F.col("_fill"), F.col("_v"))).select(*profile.columns)


def profile_volume(profile: DataFrame, keys: list[str], value: str, area: str) -> DataFrame:
    """Volume as the area-weighted sum over elevation / 1000, missing bins as zero (FIT16)."""
    return profile.groupBy(*keys).agg((F.sum(F.coalesce(F.col(value) * F.col(area), F.lit(0.0))) / 1000.0).alias(value))


def monthly_spline(series: DataFrame, keys: list[str], date: str, value: str, clamp: bool = True) -> DataFrame:
    """Evenly spaced series to the first of every month with a quadratic B-spline, negatives clamped
    (WIN10).  One series (a few hundred dates) per call."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in series.select(*keys).schema) + f", month date, {value} double"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(date)
        d = pd.to_datetime(pdf[date])
        day = d.map(pd.Timestamp.toordinal).to_numpy(float)
        y = pdf[value].to_numpy(float)
        ok = ~np.isnan(y)
        months = pd.date_range(d.iloc[0].replace(day=1), d.iloc[-1], freq="MS")
        months = months[(months >= d.iloc[0]) & (months <= d.iloc[-1])]
        if ok.sum() < 3 or len(months) == 0:
            return _no_rows([*keys, "month", value])
        first = int(np.argmax(ok))
        y = y[ok]
        n = len(y)
        step = day[1] - day[0]
        x = (months.map(pd.Timestamp.toordinal).to_numpy(float) - day[first]) / step
        # coefficients c with y_i = c_{i-1}/8 + 6 c_i/8 + c_{i+1}/8, linear beyond the ends
        M = np.zeros((n + 2, n + 2))
        for i in range(n):
            M[i + 1, i : i + 3] = [1 / 8, 6 / 8, 1 / 8]
        M[0, :3] = [1, -2, 1]
        M[-1, -3:] = [1, -2, 1]
        c = np.linalg.solve(M, np.concatenate([[0.0], y, [0.0]]))
        k = np.clip(np.rint(x), 0, n - 1).astype(int)
        u = x - k
        v = c[k] * (0.5 - u) ** 2 / 2 + c[k + 1] * (0.75 - u * u) + c[k + 2] * (0.5 + u) ** 2 / 2
        v = np.where((x < 0) | (x > n - 1), np.nan, v)
        if clamp:
            v = np.where(v < 0, 0.0, v)
        one = pdf.iloc[0]
        return pd.DataFrame({**{q: [one[q]] * len(v) for q in keys}, "month": months.date, value: v})

    return spread(series, keys).groupBy(*keys).applyInPandas(work, schema)


def with_axis_time(df: DataFrame, index: str = "date_index", start: str = DATE_AXIS_START, step: int = DATE_AXIS_STEP) -> DataFrame:
    """Decimal year of the bin centre as column ``t``."""
    day = F.date_add(F.lit(start).cast("date"), (F.col(index) * step + step // 2).cast("int"))
    return df.withColumn("t", decimal_year(day))
