"""Query registry: name -> (Spark callable, SQL text or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import ROUND_CUT

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def r(expr: str, digits: int = 6) -> str:
    """SQL twin of ``functions.numeric.fixed``."""
    return f"floor(({expr}) * 1e{digits} + {ROUND_CUT}) / 1e{digits}"


def with_(*ctes: str) -> str:
    return "with recursive " + ",\n".join(ctes) + "\n"


def sql_median_ctes(name: str, src: str, keys: str, value: str) -> str:
    return f"{name} as (select {keys}, median({value}) as med from {src} group by {keys})"


def sql_nmad_ctes(prefix: str, src: str, keys: list[str], value: str, k: float) -> list[str]:
    """CTEs ending in <prefix>_bins(keys, v, nobs): mean of values with normalised deviation below k."""
    ks = ", ".join(keys)
    on = " and ".join(f"a.{c} = b.{c}" for c in keys)
    aks = ", ".join(f"a.{c}" for c in keys)
    return [
        f"{prefix}_m as (select {ks}, median({value}) as med, count(*) as nobs from {src} group by {ks})",
        f"{prefix}_d as (select {aks}, a.{value} as x, b.med, b.nobs, abs(a.{value} - b.med) as d from {src} a join {prefix}_m b on {on})",
        f"{prefix}_s as (select {ks}, median(d) as mad from {prefix}_d group by {ks})",
        f"{prefix}_bins as (select {aks}, coalesce(avg(case when a.d < b.mad * {k} * 1.4826 or a.d = 0 then a.x end), any_value(a.med)) as v, "
        f"any_value(a.nobs) as nobs from {prefix}_d a join {prefix}_s b on {on} group by {aks})",
    ]


def sql_ols_ctes(prefix: str, src: str, keys: list[str], xs: list[str], y: str) -> list[str]:
    """CTEs ending in <prefix>_fit(keys, b0.., n): least squares by successive residualisation
    (orthogonal regressors, then back substitution), independent of normal equations."""
    ks = ", ".join(keys)
    p = len(xs)
    out = [f"{prefix}_q0 as (select {ks}, {', '.join(f'cast({x} as double) as x{i}' for i, x in enumerate(xs))}, cast({y} as double) as y from {src} where {y} is not null)"]
    gs: list[str] = []
    for k in range(p):
        over = f"over (partition by {ks})"
        cols = [f"x{i}" for i in range(k + 1)]
        made = []
        for j in range(k + 1, p):
            made.append(f"sum(x{k} * x{j}) {over} / sum(x{k} * x{k}) {over} as g{k}_{j}")
        made.append(f"sum(x{k} * y) {over} / sum(x{k} * x{k}) {over} as g{k}_y")
        new = [f"g{k}_{j}" for j in range(k + 1, p)] + [f"g{k}_y"]
        out.append(f"{prefix}_p{k} as (select *, {', '.join(made)} from {prefix}_q{k})")
        rest = [f"x{j} - g{k}_{j} * x{k} as x{j}" for j in range(k + 1, p)] + [f"y - g{k}_y * x{k} as y"]
        gs += new
        out.append(f"{prefix}_q{k + 1} as (select {ks}, {', '.join(cols + rest + gs)} from {prefix}_p{k})")
    out.append(f"{prefix}_g as (select {ks}, count(*) as n, {', '.join(f'max({g}) as {g}' for g in gs)} from {prefix}_q{p} group by {ks})")
    prev = f"{prefix}_g"
    for k in reversed(range(p)):
        expr = f"g{k}_y" + "".join(f" - g{k}_{j} * b{j}" for j in range(k + 1, p))
        out.append(f"{prefix}_b{k} as (select *, {expr} as b{k} from {prev})")
        prev = f"{prefix}_b{k}"
    out.append(f"{prefix}_fit as (select * from {prev})")
    return out


DECYEAR = "(year({d}) + dayofyear({d}) / dayofyear(make_date(year({d}), 12, 31)))"


def sql_decyear(d: str) -> str:
    return DECYEAR.format(d=d)


def sql_season(d: str) -> tuple[str, str, str]:
    t = f"({sql_decyear(d)} - 2000.0)"
    return t, f"cos({t} * (2 * pi()))", f"sin({t} * (2 * pi()))"


def sql_phase_fraction(c: str, s: str, phase: str = "table") -> str:
    a = {"table": f"atan2({c}, {s}) + pi() / 2", "series": f"atan2({s}, {c}) + pi() / 2", "peak": f"atan2({s}, {c})"}[phase]
    return f"(({a}) / (2 * pi()) - floor(({a}) / (2 * pi())))"


def sql_haversine(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    h = (
        f"pow(sin((radians({lat2} - {lat1})) / 2), 2.0) + cos(radians({lat1})) * cos(radians({lat2})) * "
        f"pow(sin((radians({lon2} - {lon1})) / 2), 2.0)"
    )
    return f"(2.0 * 6371000.0 * asin(least(1.0, sqrt({h}))))"
