"""Concave outlines of groups of points: a Delaunay triangulation with long border edges cut in."""

from __future__ import annotations

import heapq
from math import cos, hypot, pi, sin

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostrata.functions.geo import DEG2RAD, EARTH_R

SEGMENTS = 16
#: The largest buffer, in metres.
MAX_BUFFER_M = 1000


def triangulate(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int]]:
    """Delaunay triangles (counter-clockwise) of distinct points; none if all lie on one line.

    Points are inserted along a Hilbert-like sweep; each insertion walks from the last triangle to
    the one that holds the point and replaces the triangles whose circle does.
    """
    n = len(x)
    scale = max(float(np.ptp(x)), float(np.ptp(y)), 1e-12)
    px, py = ((x - x.mean()) / scale).tolist(), ((y - y.mean()) / scale).tolist()
    big = 1e4
    px += [-big, big, 0.0]
    py += [-big, -big, big]
    cells = max(1, int(n**0.5 / 2))
    row = np.minimum(((y - y.min()) / scale * cells).astype(int), cells)
    order = np.lexsort((np.where(row % 2 == 0, x, -x), row)).tolist()

    def turn(a: int, b: int, c: int) -> float:
        return (px[b] - px[a]) * (py[c] - py[a]) - (py[b] - py[a]) * (px[c] - px[a])

    def in_circle(t: tuple[int, int, int], d: int) -> bool:
        ax, ay, bx, by, cx, cy = (v for p in t for v in (px[p] - px[d], py[p] - py[d]))
        return (ax * ax + ay * ay) * (bx * cy - cx * by) - (bx * bx + by * by) * (ax * cy - cx * ay) + (cx * cx + cy * cy) * (ax * by - bx * ay) > 1e-15

    owner: dict[tuple[int, int], tuple[int, int, int]] = {}

    def add(a: int, b: int, c: int) -> tuple[int, int, int]:
        t = (a, b, c)
        owner[a, b] = owner[b, c] = owner[c, a] = t
        return t

    last = add(n, n + 1, n + 2)
    for p in order:
        t, steps = last, 0
        while True:
            steps += 1
            out = next(((b, a) for a, b in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0])) if turn(a, b, p) < -1e-18), None)
            if out is None or out not in owner or steps > 4 * len(owner):
                break
            t = owner[out]
        bad, todo = {t}, [t]
        while todo:
            a, b, c = todo.pop()
            for e in ((b, a), (c, b), (a, c)):
                other = owner.get(e)
                if other is not None and other not in bad and in_circle(other, p):
                    bad.add(other)
                    todo.append(other)
        border = [(a, b) for u, v, w in bad for a, b in ((u, v), (v, w), (w, u)) if owner.get((b, a)) not in bad]
        for u, v, w in bad:
            for e in ((u, v), (v, w), (w, u)):
                owner.pop(e, None)
        for a, b in border:
            if p not in (a, b):
                last = add(a, b, p)
    return [t for t in set(owner.values()) if max(t) < n and turn(*t) > 1e-14]


def concave_ring(x: np.ndarray, y: np.ndarray, longest: float) -> list[int] | None:
    """Indices of the outline, counter-clockwise from the lowest x; null below three points off one line.

    Border edges above ``longest`` are cut in to their triangle's third corner, longest first, as
    long as that corner isn't on the border yet. Equal points count once.
    """
    first: dict[tuple[float, float], int] = {}
    for i, at in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        first.setdefault(at, i)
    keep = np.array(sorted(first.values(), key=lambda i: (x[i], y[i])), dtype=int)
    if len(keep) < 3:
        return None
    sx, sy = x[keep], y[keep]
    across = {}
    for a, b, c in triangulate(sx, sy):
        across[a, b], across[b, c], across[c, a] = c, a, b
    if not across:
        return None
    border = {e for e in across if e[::-1] not in across}
    on = {v for e in border for v in e}
    size = lambda e: hypot(sx[e[0]] - sx[e[1]], sy[e[0]] - sy[e[1]])
    heap = [(-size(e), e) for e in border]
    heapq.heapify(heap)
    while heap and -heap[0][0] > longest:
        _, (a, b) = heapq.heappop(heap)
        c = across[a, b]
        if c in on:
            continue
        on.add(c)
        border.discard((a, b))
        for e in ((a, c), (c, b)):
            border.add(e)
            heapq.heappush(heap, (-size(e), e))
    after = dict(border)
    start = min(after)
    ring, v = [start], after[start]
    while v != start and len(ring) <= len(after):
        ring.append(v)
        v = after[v]
    return [int(keep[i]) for i in ring]


def outline(lon: np.ndarray, lat: np.ndarray, lon0: float, lat0: float, longest: float, buffer_m: float = 0) -> list[tuple[float, float]] | None:
    """A closed ring in degrees; with a buffer, around a circle of points at each corner of the plain outline."""
    k = EARTH_R * cos(lat0 * DEG2RAD)
    xy = lambda lo, la: ((lo - lon0) * DEG2RAD * k, (la - lat0) * DEG2RAD * EARTH_R)
    x, y = xy(lon, lat)
    base = concave_ring(x, y, longest)
    if buffer_m == 0:
        return None if base is None else [(float(lon[i]), float(lat[i])) for i in [*base, base[0]]]
    corners = base if base is not None else range(len(lon))
    if base is not None:
        longest = max(longest, *(hypot(x[a] - x[b], y[a] - y[b]) for a, b in zip(base, [*base[1:], base[0]], strict=True)))
    d_lat = buffer_m / EARTH_R / DEG2RAD
    more = [(lon[i] + d_lat / cos(lat[i] * DEG2RAD) * cos(2 * pi * s / SEGMENTS), lat[i] + d_lat * sin(2 * pi * s / SEGMENTS)) for i in corners for s in range(SEGMENTS)]
    glon, glat = np.concatenate([lon, [p[0] for p in more]]), np.concatenate([lat, [p[1] for p in more]])
    ring = concave_ring(*xy(glon, glat), longest)
    return None if ring is None else [(float(glon[i]), float(glat[i])) for i in [*ring, ring[0]]]


def outlines(members: DataFrame, group: str, frame: DataFrame, tightness: str = "tightness_km", buffer_m: float = 0) -> DataFrame:
    """(group, tightness_km, ring) of members (group, lon, lat, tightness_km); ring is null where there is no polygon.

    One group is one task's work: a triangulation needs all its points.
    """
    if not 0 <= buffer_m <= MAX_BUFFER_M:
        raise ValueError(f"buffer_m must be from 0 to {MAX_BUFFER_M}")
    rows = members.select(group, "idx", "lon", "lat", F.col(tightness).alias("tightness_km")).crossJoin(F.broadcast(frame.select("lon0", "lat0")))

    def kernel(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("idx")
        one = g.iloc[0]
        ring = outline(g["lon"].to_numpy(), g["lat"].to_numpy(), one["lon0"], one["lat0"], one["tightness_km"] * 1000, buffer_m)
        return pd.DataFrame({group: [one[group]], "tightness_km": [one["tightness_km"]], "ring": [None if ring is None else [list(p) for p in ring]]})

    return rows.groupBy(group).applyInPandas(kernel, f"{group} string, tightness_km double, ring array<array<double>>")
