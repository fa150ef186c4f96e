"""Counts and sums of differences within distances of the points of a block, without looking at most pairs (numpy, inside tasks)."""

from __future__ import annotations

import numpy as np

from ..functions.geo import EARTH_RADIUS_M

RUN = 32  # neighbouring places that are decided together
LEAF = 2048  # points whose values are not halved again
PIECE = 4096  # points tested at once
GUARD = 1e-13  # cosines this near an edge are decided by the haversine
SLACK = 1e-7  # radians that bounds of runs are widened by


def unit(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Rows x, y, z, lon, lat."""
    a, b = np.radians(lon), np.radians(lat)
    return np.column_stack([np.cos(b) * np.cos(a), np.cos(b) * np.sin(a), np.sin(b), lon, lat])


def along_curve(p: np.ndarray) -> np.ndarray:
    """Order of places along Hilbert curves on the faces of a cube; equal places are neighbours."""
    r, f = np.arange(len(p)), np.abs(p[:, :3]).argmax(1)
    n, up = 1 << 16, p[r, f]
    x, y = (np.clip((p[r, (f + k) % 3] / np.abs(up) + 1) * (n // 2), 0, n - 1).astype(np.int64) for k in (1, 2))
    d, s = (f * 2 + (up > 0)) * n * n, n // 2
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        d += s * s * ((3 * rx) ^ ry)
        flip = rx & ~ry
        x, y = np.where(flip, n - 1 - x, x), np.where(flip, n - 1 - y, y)
        x, y = np.where(ry, x, y), np.where(ry, y, x)
        s //= 2
    return np.lexsort((p[:, 4], p[:, 3], d))


def places(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First index of each place and the place of each point; equal places are neighbours."""
    new = np.ones(len(p), dtype=bool)
    new[1:] = (p[1:, 3:] != p[:-1, 3:]).any(1)
    return np.nonzero(new)[0], np.cumsum(new) - 1


def runs(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First index, centre and angular radius of runs of places."""
    at = np.arange(0, len(p), RUN)
    c = np.add.reduceat(p[:, :3], at)
    size = np.linalg.norm(c, axis=1, keepdims=True)
    c = np.where(size > 1e-6, c / np.maximum(size, 1e-6), p[at, :3])
    dot = np.einsum("ij,ij->i", p[:, :3], np.repeat(c, RUN, axis=0)[: len(p)])
    return at, c, np.arccos(np.clip(np.minimum.reduceat(dot, at), -1, 1))


def ball(p: np.ndarray) -> tuple[float, float, float, float]:
    """Centre and angular radius of all points."""
    c = p[:, :3].sum(0)
    c = c / np.linalg.norm(c) if np.linalg.norm(c) > 1e-6 else p[0, :3]
    return *c, np.arccos(np.clip((p[:, :3] @ c).min(), -1, 1))


def inside(q: np.ndarray, d: np.ndarray, dot: np.ndarray, edge: float) -> np.ndarray:
    """Whether d <= edge, for all pairs; what rounding could decide is left to the haversine."""
    cut = np.cos(min(edge / EARTH_RADIUS_M, np.pi)) if edge >= 0 else 2.0
    sure, may = dot > cut + GUARD, dot >= cut - GUARD
    if np.count_nonzero(sure) != np.count_nonzero(may):
        i, j = np.nonzero(may & ~sure)
        a, b = q[i, 3:], d[j, 3:]
        h = np.sin(np.radians(b[:, 1] - a[:, 1]) / 2) ** 2 + np.cos(np.radians(a[:, 1])) * np.cos(np.radians(b[:, 1])) * np.sin(np.radians(b[:, 0] - a[:, 0]) / 2) ** 2
        sure[i, j] = 2 * EARTH_RADIUS_M * np.arcsin(np.minimum(1.0, np.sqrt(h))) <= edge
    return sure


def tested(q: np.ndarray, d: np.ndarray):
    """Pairs that are looked at one by one, in pieces: slice of d, cosines."""
    for k in range(0, len(d), PIECE):
        yield slice(k, k + PIECE), q[:, :3] @ d[k : k + PIECE, :3].T


def sums_within(q: np.ndarray, d: np.ndarray, w: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """[edge, point of q, (count, sum of w)] over the points of d within each edge.

    Runs of places are decided together where their bounds allow; only runs that the edge may cut are tested."""
    qa, qp = places(q)
    da, _ = places(d)
    q, weight = q[qa], np.column_stack([np.diff(np.append(da, len(d))).astype(float), np.add.reduceat(w, da)])
    d = d[da]
    at, c, r = runs(d)
    whole = np.add.reduceat(weight, at)
    pad = -len(d) % RUN
    d3 = np.concatenate([d, np.repeat(d[-1:], pad, axis=0)]).reshape(-1, RUN, 5)
    w3 = np.concatenate([weight, np.zeros((pad, 2))]).reshape(-1, RUN, 2)
    out = np.zeros((len(edges), len(q), 2))
    for a, qc, qr in zip(*runs(q), strict=True):
        part = q[a : a + RUN]
        mid, slack = np.arccos(np.clip(c @ qc, -1, 1)), r + (qr + SLACK)
        far, near = mid + slack, mid - slack
        for e, edge in enumerate(edges):
            angle = edge / EARTH_RADIUS_M
            sure = far <= angle
            got = out[e, a : a + RUN]
            got += whole[sure].sum(0)
            cut = np.nonzero((near <= angle) & ~sure)[0]
            x, y = d3[cut].reshape(-1, 5), w3[cut].reshape(-1, 2)
            for k, dot in tested(part, x):
                got += inside(part, x[k], dot, edge).astype(float) @ y[k]
    return out[:, qp]


class BandSums:
    """For the points of a block: numbers and sums of every annulus over the points that are added."""

    def __init__(self, lon: np.ndarray, lat: np.ndarray, value: np.ndarray, edges: np.ndarray):
        self.q, self.v, self.edges = unit(lon, lat), value, edges
        self.n, self.equal, self.s = (np.zeros((len(edges), len(value))) for _ in range(3))
        self.inf, self.nan = (np.zeros((len(edges) - 1, len(value))) for _ in range(2))  # differences that are not finite

    def add(self, lon: np.ndarray, lat: np.ndarray, value: np.ndarray) -> None:
        d, fq, fd = unit(lon, lat), np.isfinite(self.v), np.isfinite(value)
        iq = np.nonzero(fq)[0]
        self._halve(iq, d[fd], value[fd])
        for x in np.unique(value[~fd]):
            self._not_finite(np.arange(len(self.v)), d[np.isnan(value) if np.isnan(x) else value == x], x)
        if len(iq) < len(fq) and fd.any():
            self._not_finite(np.nonzero(~fq)[0], d[fd], 0.0)

    def _halve(self, iq: np.ndarray, d: np.ndarray, v: np.ndarray) -> None:
        """Of two halves of the values, every difference between them is that from the cut between them, added."""
        if not len(iq) or not len(v):
            return
        low = v.min()
        if low == v.max():
            n = sums_within(self.q[iq], d, np.zeros(len(v)), self.edges)[..., 0]
            diff = np.abs(self.v[iq] - low)
            self.n[:, iq] += n
            self.s[:, iq] += n * diff
            self.equal[:, iq] += n * (diff == 0)
            return
        if len(v) <= LEAF or len(iq) <= RUN:
            for k, dot in tested(self.q[iq], d):
                diff = np.abs(self.v[iq][:, None] - v[k][None])
                same = diff == 0
                any_same = same.any()
                for e, edge in enumerate(self.edges):
                    m = inside(self.q[iq], d[k], dot, edge)
                    self.n[e, iq] += np.count_nonzero(m, axis=1)
                    self.s[e, iq] += np.einsum("ij,ij->i", m, diff)
                    if any_same:
                        self.equal[e, iq] += np.count_nonzero(m & same, axis=1)
            return
        cut = np.partition(v, len(v) // 2)[len(v) // 2]
        below, of_q = (v < cut, self.v[iq] < cut) if cut > low else (v <= cut, self.v[iq] <= cut)
        for side in (below, ~below):
            i = iq[~of_q] if side is below else iq[of_q]
            if len(i):
                got = sums_within(self.q[i], d[side], np.abs(v[side] - cut), self.edges)
                self.n[:, i] += got[..., 0]
                self.s[:, i] += got[..., 0] * np.abs(self.v[i] - cut) + got[..., 1]
        self._halve(iq[of_q], d[below], v[below])
        self._halve(iq[~of_q], d[~below], v[~below])

    def _not_finite(self, iq: np.ndarray, d: np.ndarray, value: float) -> None:
        n = sums_within(self.q[iq], d, np.zeros(len(d)), self.edges)[..., 0]
        self.n[:, iq] += n
        with np.errstate(invalid="ignore"):
            unknown = np.isnan(self.v[iq] - value)
        self.nan[:, iq] += np.diff(n, axis=0) * unknown
        self.inf[:, iq] += np.diff(n, axis=0) * ~unknown

    def result(self) -> tuple[np.ndarray, ...]:
        """Point, band, pairs, sum of their finite differences, differences not 0, infinite ones, unknown ones; where there are pairs."""
        n = np.diff(self.n, axis=0)
        c = n - np.diff(self.equal, axis=0)
        b, i = np.nonzero(n)
        n, c, inf, nan = (x[b, i].astype(np.int64) for x in (n, c, self.inf, self.nan))
        return i, b, n, np.where(c > inf + nan, np.diff(self.s, axis=0)[b, i], 0.0), c, inf, nan
