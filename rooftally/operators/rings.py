"""Polygons as rings: array<struct<x: double, y: double>>, open (the first point isn't repeated).

Areas, lengths, centres and bounds are expressions, projections of points too. Convex hulls, smallest rectangles, simplified
lines and projections of whole rings run in Arrow batches, on many rings at once. A null ring gives nulls; a ring
of under three points has no area.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

RING = "array<struct<x:double,y:double>>"


def of_points(points: list[tuple[Column, Column]]) -> Column:
    return F.array(*[F.struct(x.cast("double").alias("x"), y.cast("double").alias("y")) for x, y in points])


def box_ring(x0="x0", y0="y0", x1="x1", y1="y1") -> Column:
    a, b, c, d = (F.col(v) for v in (x0, y0, x1, y1))
    return of_points([(a, b), (c, b), (c, d), (a, d)])


def _steps(ring: Column, of) -> Column:
    """``of(point, next point)`` summed around the ring."""
    turned = F.concat(F.slice(ring, F.lit(2), F.size(ring)), F.slice(ring, 1, 1))
    return F.aggregate(F.zip_with(ring, turned, of), F.lit(0.0), lambda a, v: a + v)


def area(ring: Column) -> Column:
    return F.abs(_steps(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])) / 2


def perimeter(ring: Column) -> Column:
    return _steps(ring, lambda p, q: F.hypot(q["x"] - p["x"], q["y"] - p["y"]))


def centroid(ring: Column) -> tuple[Column, Column]:
    """Centre of the area; null where there is none."""
    twice = _steps(ring, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    of = lambda c: _steps(ring, lambda p, q: (p[c] + q[c]) * (p["x"] * q["y"] - q["x"] * p["y"])) / F.nullif(3 * twice, F.lit(0.0))
    return of("x"), of("y")


def bounds(ring: Column) -> Column:
    along = lambda c: F.transform(ring, lambda p: p[c])  # noqa: E731  a second argument of the inner one would be the place
    xs, ys = along("x"), along("y")
    return F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))


def mapped(ring: Column, of) -> Column:
    """Each point by ``of(x, y)``, which gives the new x and y."""

    def point(p: Column) -> Column:
        x, y = of(p["x"], p["y"])
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(ring, point)


def from_coordinates(text: Column, between_points: str, between_numbers: str) -> Column:
    """The ring of a text of numbers; a last point that repeats the first is left out, and numbers after the second."""
    points = F.transform(F.split(F.trim(text), between_points), lambda t: F.split(t, between_numbers))
    ring = F.transform(points, lambda p: F.struct(F.try_element_at(p, F.lit(1)).try_cast("double").alias("x"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("y")))
    closed = (F.size(ring) > 1) & (F.element_at(ring, 1) == F.element_at(ring, -1))
    return F.when(F.trim(text) != "", F.when(closed, F.slice(ring, F.lit(1), F.size(ring) - 1)).otherwise(ring))


def from_wkt(text: Column) -> Column:
    """The outer ring of ``POLYGON ((x y, …))``; null for anything else and for empty ones."""
    inner = F.regexp_extract(text, r"(?i)^\s*POLYGON\s*Z?\s*\(\(([^)]*)\)", 1)
    return from_coordinates(F.nullif(inner, F.lit("")), r"\s*,\s*", r"\s+")


def to_wkt(ring: Column) -> Column:
    text = lambda p: F.concat_ws(" ", p["x"].cast("string"), p["y"].cast("string"))
    return F.concat(F.lit("POLYGON (("), F.array_join(F.transform(F.concat(ring, F.slice(ring, 1, 1)), text), ", "), F.lit("))"))


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise: lower and upper chains over the points by x, then y."""
    points = np.unique(points, axis=0)
    if len(points) < 3:
        return points

    def chain(some):
        out: list[np.ndarray] = []
        for p in some:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    return np.array(chain(points) + chain(points[::-1]))


def hull_measures(points: np.ndarray) -> tuple[float, float, float]:
    """Area of the hull, long and short side of the smallest rectangle around it (one side of it lies on the hull)."""
    corners = hull(points)
    if len(corners) < 3:
        return 0.0, 0.0, 0.0
    following = np.roll(corners, -1, axis=0)
    whole = abs(np.sum(corners[:, 0] * following[:, 1] - following[:, 0] * corners[:, 1])) / 2
    along = (following - corners) / np.linalg.norm(following - corners, axis=1)[:, None]
    across = np.stack([-along[:, 1], along[:, 0]], axis=1)
    sides = np.stack([np.ptp(corners @ along.T, axis=0), np.ptp(corners @ across.T, axis=0)])
    best = int(np.argmin(np.round(sides.prod(axis=0), 9)))
    return float(whole), float(sides[:, best].max()), float(sides[:, best].min())


#: Points of a ring up to which all its pairs are looked at; triples of points that a task looks at at a time.
FEW, TRIPLES = 24, 1 << 20


def few_measures(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """(3, rings): `hull_measures` of rings of as many points, (rings, n), all at once.

    A pair of points is a side of the hull if no point is right of it and none on its line lies beyond its ends.
    """
    rings_, n = x.shape
    out, step = np.zeros((3, rings_)), max(1, TRIPLES // n**3)
    again = np.tril(np.ones((n, n), bool), -1)
    for at in range(0, rings_, step):
        px, py = x[at : at + step], y[at : at + step]
        dx, dy = px[:, None, :] - px[:, :, None], py[:, None, :] - py[:, :, None]  # from i to j
        first = ~((dx == 0) & (dy == 0) & again).any(axis=2)  # of equal points, the first stands for all
        turn = dx[:, :, :, None] * dy[:, :, None, :] - dy[:, :, :, None] * dx[:, :, None, :]
        along = dx[:, :, :, None] * dx[:, :, None, :] + dy[:, :, :, None] * dy[:, :, None, :]
        length2 = dx * dx + dy * dy
        inner = (turn > 0) | ((turn == 0) & (along >= 0) & (along <= length2[..., None]))
        side = inner.all(axis=3) & (length2 > 0) & first[:, :, None] & first[:, None, :]
        cross = px[:, :, None] * py[:, None, :] - py[:, :, None] * px[:, None, :]
        whole = np.abs(np.where(side, cross, 0.0).sum(axis=(1, 2))) / 2
        length = np.sqrt(np.where(side, length2, 1.0))
        ux, uy = dx / length, dy / length
        ahead = ux[..., None] * px[:, None, None, :] + uy[..., None] * py[:, None, None, :]
        beside = ux[..., None] * py[:, None, None, :] - uy[..., None] * px[:, None, None, :]
        sides = [np.ptp(c, axis=3).reshape(len(px), -1) for c in (ahead, beside)]
        angle = np.arctan2(dy, dx)
        angle = np.where(angle <= -np.pi / 2, angle + 2 * np.pi, angle).reshape(len(px), -1)
        flat = side.reshape(len(px), -1)
        size = np.where(flat, np.round(sides[0] * sides[1], 9), np.inf)
        # among equals the first side from the leftmost point on, counter-clockwise
        best = np.where(size == size.min(axis=1, keepdims=True), np.where(flat, angle, np.inf), np.inf).argmin(axis=1)
        some, row = flat.sum(axis=1) > 2, np.arange(len(px))
        p, q = (c[row, best] for c in sides)
        out[:, at : at + step] = np.where(some, np.stack([whole, np.maximum(p, q), np.minimum(p, q)]), 0.0)
        # where last digits make sides that don't close, the chains decide
        leaves, comes = side.sum(axis=2), side.sum(axis=1)
        for k in np.flatnonzero((leaves != comes).any(axis=1) | (leaves > 1).any(axis=1) | ~some):
            out[:, at + k] = hull_measures(np.stack([px[k], py[k]], axis=1))
    return out


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row (0 for null ones), and all of them."""
    return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), column.flatten().to_numpy(zero_copy_only=False)


def shape(ring: Column) -> Column:
    """struct(hull_area, major, minor). Rings of few points are measured together, by their number of points."""

    def of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        (many, x), (_, y) = _flat(xs), _flat(ys)
        start, out = np.cumsum(many) - many, np.zeros((3, len(many)))
        for n in np.unique(many[many > 2]):
            rows = np.flatnonzero(many == n)
            at = start[rows][:, None] + np.arange(n)
            out[:, rows] = few_measures(x[at], y[at]) if n <= FEW else np.array([hull_measures(np.stack([x[k], y[k]], axis=1)) for k in at]).T
        none = xs.is_null().to_numpy(zero_copy_only=False)
        return pa.StructArray.from_arrays([pa.array(c, mask=none) for c in out], ["hull_area", "major", "minor"])

    return F.arrow_udf(of, "hull_area double, major double, minor double")(ring["x"], ring["y"])


def elongation(measures: Column) -> Column:
    """Long over short side, 1 for what has no area."""
    return F.when(measures["minor"] > 0, measures["major"] / measures["minor"]).otherwise(1.0)


def solidity(ring: Column, measures: Column) -> Column:
    """Area over that of the hull, 1 for what has none."""
    return F.when(measures["hull_area"] > 0, area(ring) / measures["hull_area"]).otherwise(1.0)


def simplified(points: np.ndarray, tolerance: float) -> np.ndarray:
    """The closed ring without points nearer than ``tolerance`` to the line that stays: from its first point to the one
    furthest from it and back; on each line, the point furthest off is kept if it is further than that, and splits the line."""
    if len(points) < 4:
        return points
    closed = np.concatenate([points, points[:1]])
    far = int(np.argmax(((points - points[0]) ** 2).sum(axis=1)))
    keep, open_ = {0, far, len(points)}, [(0, far), (far, len(points))]
    while open_:
        i, j = open_.pop()
        if j - i < 2:
            continue
        d, inner = closed[j] - closed[i], closed[i + 1 : j] - closed[i]
        length = math.hypot(*d)
        off = np.abs(d[0] * inner[:, 1] - d[1] * inner[:, 0]) / length if length else np.hypot(inner[:, 0], inner[:, 1])
        k = int(off.argmax())
        if off[k] > tolerance:
            keep.add(i + 1 + k)
            open_ += [(i, i + 1 + k), (i + 1 + k, j)]
    return closed[sorted(keep - {len(points)})]


def kept_points(many: np.ndarray, x: np.ndarray, y: np.ndarray, tolerance: float) -> np.ndarray:
    """Which points of rings, one after the other, `simplified` keeps. many: points of each ring, none of them 0. All lines of all rings are split at once."""
    closed = many + 1
    start = np.cumsum(closed) - closed
    ring = np.repeat(np.arange(len(many)), closed)
    own = np.arange(len(ring)) - start[ring]
    place = np.where(own == many[ring], 0, own) + (np.cumsum(many) - many)[ring]
    x, y = x[place], y[place]
    keep = (own == 0) | (own == many[ring]) | (many[ring] < 4)

    def first_most(value: np.ndarray, starts: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        most = np.maximum.reduceat(value, starts)
        hit = np.flatnonzero(value == most[group])[::-1]
        place = np.zeros(len(starts), np.int64)
        place[group[hit]] = hit
        return place, most

    keep[first_most((x - x[start[ring]]) ** 2 + (y - y[start[ring]]) ** 2, start, ring)[0]] = True
    while True:
        ends = np.flatnonzero(keep)
        line = np.cumsum(keep) - 1
        i, j = ends[line], ends[np.minimum(line + 1, len(ends) - 1)]
        dx, dy, ex, ey = x[j] - x[i], y[j] - y[i], x - x[i], y - y[i]
        length = np.hypot(dx, dy)
        off = np.where(length > 0, np.abs(dx * ey - dy * ex) / np.where(length > 0, length, 1.0), np.hypot(ex, ey))
        at, most = first_most(np.where(keep, -1.0, off), ends, line)
        more = at[most > tolerance]
        if not len(more):
            return keep[own < many[ring]]
        keep[more] = True


def wobble(ring: Column, tolerance: float) -> Column:
    """Length of the ring over that of its simplified form; null where that has none."""

    def lengths(many: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        start = np.cumsum(many) - many
        following = np.arange(1, len(x) + 1)
        following[start + many - 1] = start
        return np.add.reduceat(np.hypot(x[following] - x, y[following] - y), start)

    def of(xs: pa.Array, ys: pa.Array) -> pa.Array:
        (many, x), (_, y) = _flat(xs), _flat(ys)
        out, some = np.zeros(len(many)), many > 0
        if some.any():
            n = many[some]
            keep = kept_points(n, x, y, tolerance)
            left = np.add.reduceat(keep.astype(np.int64), np.cumsum(n) - n)
            rest = lengths(left, x[keep], y[keep])
            out[some] = np.where(rest > 0, lengths(n, x, y) / np.where(rest > 0, rest, 1.0), 0.0)
        return pa.array(out, mask=out == 0)

    return F.arrow_udf(of, "double")(ring["x"], ring["y"])


# Transverse Mercator on the WGS 84 ellipsoid, as series in the third flattening; good to a millimetre inside a zone.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_R = 0.9996 * _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)


def _middle(epsg: Column) -> Column:
    return F.radians((epsg % 100) * 6 - 183)


def _north(epsg: Column) -> Column:
    return F.when(F.floor(epsg / 100) == 327, 10_000_000.0).otherwise(0.0)


def _to_zone(m, lon, lat, middle, north):
    """Of columns with ``m`` as F, of arrays with numpy."""
    s, dl = m.sin(m.radians(lat)), m.radians(lon) - middle
    t = m.sinh(m.atanh(s) - _E * m.atanh(_E * s))
    xi, eta = m.atan2(t, m.cos(dl)), m.atanh(m.sin(dl) / m.sqrt(1 + t * t))
    east = eta + sum((a * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), 0.0)
    up = xi + sum((a * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, a in enumerate(ALPHA, 1)), 0.0)
    return 500_000 + _R * east, north + _R * up


def _from_zone(m, x, y, middle, north):
    xi, eta = (y - north) / _R, (x - 500_000) / _R
    u = xi - sum((b * m.sin(2 * j * xi) * m.cosh(2 * j * eta) for j, b in enumerate(BETA, 1)), 0.0)
    v = eta - sum((b * m.cos(2 * j * xi) * m.sinh(2 * j * eta) for j, b in enumerate(BETA, 1)), 0.0)
    chi = m.asin(m.sin(u) / m.cosh(v))
    lat = chi + sum((d * m.sin(2 * j * chi) for j, d in enumerate(DELTA, 1)), 0.0)
    return m.degrees(middle + m.atan2(m.sinh(v), m.cos(u))), m.degrees(lat)


def to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of ``epsg`` (326zz north, 327zz south)."""
    return _to_zone(F, lon, lat, _middle(epsg), _north(epsg))


def from_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    return _from_zone(F, x, y, _middle(epsg), _north(epsg))


def _mapped_at_once(ring: Column, of, *numbers: Column) -> Column:
    """`mapped` of all points of an Arrow batch at once: ``of`` takes arrays of x, y and each point's ``numbers``. Points without x or y, or a null number, give nulls."""

    def run(ring: pa.Array, *numbers: pa.Array) -> pa.Array:
        many, points = pc.fill_null(pc.list_value_length(ring), 0).to_numpy(zero_copy_only=False).astype(np.int64), ring.flatten()
        per_point = [np.repeat(c.cast(pa.float64()).to_numpy(zero_copy_only=False), many) for c in numbers]
        none = np.logical_or.reduce([c.is_null().to_numpy(zero_copy_only=False) for c in points.flatten()] + [np.repeat(c.is_null().to_numpy(zero_copy_only=False), many) for c in numbers])
        with np.errstate(all="ignore"):
            moved = of(*(c.to_numpy(zero_copy_only=False).astype(float) for c in points.flatten()), *per_point)
        told = pa.StructArray.from_arrays([pa.array(c, pa.float64(), mask=none) for c in moved], ["x", "y"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(many))).astype(np.int32)), told, mask=ring.is_null())

    return F.arrow_udf(run, RING)(ring, *numbers)


def ring_to_utm(ring: Column, epsg: Column) -> Column:
    """`to_utm` of each point of a ring in degrees."""
    return _mapped_at_once(ring, lambda x, y, e: _to_zone(np, x, y, *_zone_numbers(e)), epsg)


def ring_from_utm(ring: Column, epsg: Column) -> Column:
    """`from_utm` of each point of a ring in metres."""
    return _mapped_at_once(ring, lambda x, y, e: _from_zone(np, x, y, *_zone_numbers(e)), epsg)


def _zone_numbers(epsg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.radians(epsg % 100 * 6 - 183), np.where(np.floor(epsg / 100) == 327, 10_000_000.0, 0.0)
