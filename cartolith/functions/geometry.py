"""Geometry kernels on plain Python values: predicates, ring assembly, overlay, simplification.

A ring is a closed list of ``(x, y)``; a polygon is ``(outer, inners)``; a multipolygon a list of
polygons. Predicates are planar. Edges on the sphere are great circles: project both geometries
with ``Gnomonic`` first, which maps great circles to straight lines, and the planar predicates are
exact for the sphere.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Iterable, Iterator, Sequence
from itertools import takewhile

import numpy as np

Pt = tuple[float, float]
Ring = list[Pt]
Polygon = tuple[Ring, list[Ring]]
MultiPolygon = list[Polygon]

EPS = 1e-12


# ---------------------------------------------------------------- basics


def cross(o: Pt, a: Pt, b: Pt) -> float:
    return (a[0] - o[0]) * (b[1] - o[1]) - (a[1] - o[1]) * (b[0] - o[0])


def signed_area(ring: Ring) -> float:
    """Planar area; positive when counter-clockwise."""
    return 0.5 * sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))


def spherical_area(ring: Ring, radius: float = 1.0) -> float:
    """Area on a sphere with great-circle edges, from degrees; positive when counter-clockwise."""
    total = 0.0
    for (x1, y1), (x2, y2) in zip(ring, ring[1:]):
        d, y1, y2 = math.radians(x2 - x1), math.radians(y1), math.radians(y2)
        total -= 2 * math.atan(math.tan(d / 2) * math.sin((y1 + y2) / 2) / math.cos((y1 - y2) / 2))
    return total * radius * radius


def area(mp: MultiPolygon, radius: float | None = None) -> float:
    """Area of a multipolygon: planar, or spherical on ``radius``."""
    one = signed_area if radius is None else (lambda r: spherical_area(r, radius))
    return sum(abs(one(o)) - sum(abs(one(i)) for i in inners) for o, inners in mp)


def num_points(mp: MultiPolygon) -> int:
    return sum(len(o) + sum(map(len, inners)) for o, inners in mp)


def envelope(points: Iterable[Pt]) -> tuple[float, float, float, float]:
    xs, ys = zip(*points)
    return min(xs), min(ys), max(xs), max(ys)


def spherical_envelope(mp: MultiPolygon) -> tuple[float, float, float, float]:
    """The box of a multipolygon whose edges are great circles, which rise above their ends towards a pole."""
    x0, y0, x1, y1 = envelope([p for o, _ in mp for p in o])
    for outer, _ in mp:
        a = np.radians(np.asarray(outer, dtype=float))
        v = np.column_stack([np.cos(a[:, 1]) * np.cos(a[:, 0]), np.cos(a[:, 1]) * np.sin(a[:, 0]), np.sin(a[:, 1])])
        p, q = v[:-1], v[1:]
        n = np.cross(p, q)
        size = np.linalg.norm(n, axis=1)
        kept = size > 1e-12
        n = n[kept] / size[kept, None]
        # The circle's highest point lies on the edge when it comes after p and before q; the lowest is its opposite.
        top = np.array([0.0, 0.0, 1.0]) - n[:, 2:] * n
        after, before = np.einsum("ij,ij->i", np.cross(p[kept], top), n), np.einsum("ij,ij->i", np.cross(top, q[kept]), n)
        height = np.degrees(np.arctan2(np.linalg.norm(top, axis=1), np.abs(n[:, 2])))
        y1 = max([y1, *height[(after > 0) & (before > 0)].tolist()])
        y0 = min([y0, *(-height[(after < 0) & (before < 0)]).tolist()])
    return x0, y0, x1, y1


def box_polygon(box: tuple[float, float, float, float]) -> Polygon:
    x0, y0, x1, y1 = box
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)], []


def reclose(ring: Ring) -> Ring:
    return ring + [ring[0]] if ring and ring[0] != ring[-1] else ring


def drop_repeats(ring: Ring) -> Ring:
    return [p for i, p in enumerate(ring) if i == 0 or p != ring[i - 1]]


def correct(poly: Polygon) -> Polygon:
    """Closed rings, outer counter-clockwise, inner clockwise."""
    outer = reclose(poly[0])
    if signed_area(outer) < 0:
        outer = outer[::-1]
    inners = [r[::-1] if signed_area(r) > 0 else r for r in map(reclose, poly[1])]
    return outer, inners


def rings(mp: MultiPolygon) -> list[Ring]:
    return [r for o, inners in mp for r in (o, *inners) if r]


class Gnomonic:
    """The gnomonic projection about a centre; for what lies within 90 degrees of it."""

    def __init__(self, lon: float, lat: float):
        self._lon, self._sin, self._cos = math.radians(lon), math.sin(math.radians(lat)), math.cos(math.radians(lat))

    @classmethod
    def around(cls, points: Sequence[Pt]) -> "Gnomonic":
        x0, y0, x1, y1 = envelope(points)
        return cls((x0 + x1) / 2, (y0 + y1) / 2)

    def flat(self, pts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(projected points, which of them lie before the horizon; the others' places mean nothing)."""
        a = np.radians(np.asarray(pts, dtype=float).reshape(-1, 2))
        d, s, c = a[:, 0] - self._lon, np.sin(a[:, 1]), np.cos(a[:, 1])
        depth = self._sin * s + self._cos * c * np.cos(d)
        seen = depth > 1e-6
        depth = np.where(seen, depth, 1.0)
        return np.column_stack([c * np.sin(d) / depth, (self._cos * s - self._sin * c * np.cos(d)) / depth]), seen

    def points(self, pts: Sequence[Pt]) -> list[Pt] | None:
        """The projected points; None where one lies beyond the horizon."""
        xy, seen = self.flat(np.asarray(pts, dtype=float))
        return list(map(tuple, xy.tolist())) if seen.all() else None

    def multi(self, mp: MultiPolygon) -> MultiPolygon | None:
        out = []
        for o, inners in mp:
            p = self.points(o)
            i = [self.points(r) for r in inners]
            if p is None or any(r is None for r in i):
                return None
            out.append((p, i))
        return out  # type: ignore[return-value]


# ---------------------------------------------------------------- points


def on_segment(p: Pt, a: Pt, b: Pt, eps: float = EPS) -> bool:
    """Whether p lies on the segment ab, within ``eps``."""
    length = max(abs(b[0] - a[0]), abs(b[1] - a[1]))
    if length == 0:
        return abs(p[0] - a[0]) <= eps and abs(p[1] - a[1]) <= eps
    if abs(cross(a, b, p)) > eps * max(1.0, length):
        return False
    return min(a[0], b[0]) - eps <= p[0] <= max(a[0], b[0]) + eps and min(a[1], b[1]) - eps <= p[1] <= max(a[1], b[1]) + eps


def place_in_ring(p: Pt, ring: Ring) -> int:
    """1 inside, 0 on the ring, -1 outside; by crossings of a ray to the right."""
    inside = False
    x, y = p
    for a, b in zip(ring, ring[1:]):
        if on_segment(p, a, b):
            return 0
        if (a[1] > y) != (b[1] > y) and x < (b[0] - a[0]) * (y - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return 1 if inside else -1


def place_in(p: Pt, mp: MultiPolygon) -> int:
    """1 in the interior, 0 on a boundary, -1 outside a multipolygon."""
    best = -1
    for outer, inners in mp:
        at = place_in_ring(p, outer)
        if at == 1:
            for r in inners:
                inner = place_in_ring(p, r)
                if inner >= 0:
                    at = 0 if inner == 0 else -1
                    break
        if at == 1:
            return 1
        best = max(best, at)
    return best


#: Below so many point-edge pairs plain loops are faster than arrays.
_FEW = 400
_BLOCK = 1_000_000


def _places_in_ring(pts: np.ndarray, ring: Ring) -> np.ndarray:
    """``place_in_ring`` of many points."""
    e = np.hstack([np.asarray(ring[:-1], dtype=float), np.asarray(ring[1:], dtype=float)])
    ax, ay, bx, by = e.T
    dx, dy = bx - ax, by - ay
    reach = EPS * np.maximum(1.0, np.maximum(np.abs(dx), np.abs(dy)))
    out = np.empty(len(pts), dtype=np.int8)
    step = max(1, _BLOCK // max(1, len(e)))
    for k in range(0, len(pts), step):
        x, y = pts[k : k + step, :1], pts[k : k + step, 1:]
        i, j = np.nonzero((ay > y) != (by > y))
        right = x[i, 0] < dx[j] * (y[i, 0] - ay[j]) / dy[j] + ax[j]
        inside = np.bincount(i[right], minlength=len(x)) % 2 == 1
        i, j = np.nonzero(np.abs(dx * (y - ay) - dy * (x - ax)) <= reach)
        p, q, a, b, c, d = x[i, 0], y[i, 0], ax[j], ay[j], bx[j], by[j]
        on = np.zeros(len(x), dtype=bool)
        on[i[(p >= np.minimum(a, c) - EPS) & (p <= np.maximum(a, c) + EPS) & (q >= np.minimum(b, d) - EPS) & (q <= np.maximum(b, d) + EPS)]] = True
        out[k : k + step] = np.where(on, 0, np.where(inside, 1, -1))
    return out


def places_in(points: Sequence[Pt], mp: MultiPolygon) -> np.ndarray:
    """``place_in`` of many points."""
    if len(points) * num_points(mp) < _FEW:
        return np.array([place_in(p, mp) for p in points], dtype=np.int8)
    pts = np.asarray(points, dtype=float).reshape(-1, 2)
    best = np.full(len(pts), -1, dtype=np.int8)
    for outer, inners in mp:
        at = _places_in_ring(pts, outer)
        for r in inners:
            inside = np.flatnonzero(at == 1)
            if not len(inside):
                break
            inner = _places_in_ring(pts[inside], r)
            at[inside] = np.where(inner < 0, 1, np.where(inner == 0, 0, -1))
        best = np.maximum(best, at)
    return best


def point_covered_by(p: Pt, mp: MultiPolygon) -> bool:
    return place_in(p, mp) >= 0


# ---------------------------------------------------------------- segments


def _edge_arrays(mp: MultiPolygon) -> np.ndarray:
    parts = [np.hstack([np.asarray(r[:-1]), np.asarray(r[1:])]) for r in rings(mp) if len(r) > 1]
    return np.vstack(parts) if parts else np.empty((0, 4))


def _near(edges: np.ndarray, a: Pt, b: Pt) -> np.ndarray:
    """Edges whose boxes meet the box of ab."""
    if not len(edges):
        return edges
    x0, x1 = min(a[0], b[0]) - EPS, max(a[0], b[0]) + EPS
    y0, y1 = min(a[1], b[1]) - EPS, max(a[1], b[1]) + EPS
    hit = (np.minimum(edges[:, 0], edges[:, 2]) <= x1) & (np.maximum(edges[:, 0], edges[:, 2]) >= x0)
    hit &= (np.minimum(edges[:, 1], edges[:, 3]) <= y1) & (np.maximum(edges[:, 1], edges[:, 3]) >= y0)
    return edges[hit]


def meeting(a: Pt, b: Pt, c: Pt, d: Pt) -> list[float]:
    """Places along ab (0 to 1) where it meets cd: a crossing, touches, or the ends of an overlap."""
    rx, ry, sx, sy = b[0] - a[0], b[1] - a[1], d[0] - c[0], d[1] - c[1]
    den = rx * sy - ry * sx
    scale = max(abs(rx), abs(ry)) * max(abs(sx), abs(sy))
    out = []
    if scale and abs(den) > EPS * scale:
        t = ((c[0] - a[0]) * sy - (c[1] - a[1]) * sx) / den
        u = ((c[0] - a[0]) * ry - (c[1] - a[1]) * rx) / den
        if -EPS <= t <= 1 + EPS and -EPS <= u <= 1 + EPS:
            out.append(min(1.0, max(0.0, t)))
    else:
        length = rx * rx + ry * ry
        for p in (c, d):
            if on_segment(p, a, b):
                out.append(min(1.0, max(0.0, ((p[0] - a[0]) * rx + (p[1] - a[1]) * ry) / length)) if length else 0.0)
        for t, p in ((0.0, a), (1.0, b)):
            if on_segment(p, c, d):
                out.append(t)
    return out


def _pieces(a: Pt, b: Pt, edges: np.ndarray) -> list[tuple[Pt, Pt]]:
    """ab cut at all places where it meets the edges."""
    cuts = {0.0, 1.0}
    ends: dict[float, Pt] = {0.0: a, 1.0: b}
    for x1, y1, x2, y2 in _near(edges, a, b).tolist():
        for t in meeting(a, b, (x1, y1), (x2, y2)):
            cuts.add(t)
            # A cut at an edge's end takes that very point, so that neighbours stay joined.
            for q in ((x1, y1), (x2, y2)):
                p = (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))
                if t not in (0.0, 1.0) and abs(p[0] - q[0]) <= 1e-11 and abs(p[1] - q[1]) <= 1e-11:
                    ends[t] = q
    order = sorted(cuts)
    pts = [ends.get(t, (a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1]))) for t in order]
    return [(p, q) for p, q in zip(pts, pts[1:]) if abs(p[0] - q[0]) > EPS or abs(p[1] - q[1]) > EPS]


#: Below so many segments plain loops are faster than arrays.
_FEW_SEGMENTS = 6


def _on_segments(p: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``on_segment`` of each row."""
    d, to = b - a, p - a
    length = np.abs(d).max(1)
    on = np.abs(d[:, 0] * to[:, 1] - d[:, 1] * to[:, 0]) <= EPS * np.maximum(1.0, length)
    on &= ((np.minimum(a, b) - EPS <= p) & (p <= np.maximum(a, b) + EPS)).all(1)
    return np.where(length == 0, (np.abs(to) <= EPS).all(1), on)


def _meetings(e: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``meeting`` of each row of edges with the other's: (places, which of them count), four columns in its order."""
    rx, ry, sx, sy = e[:, 2] - e[:, 0], e[:, 3] - e[:, 1], f[:, 2] - f[:, 0], f[:, 3] - f[:, 1]
    den = rx * sy - ry * sx
    scale = np.maximum(np.abs(rx), np.abs(ry)) * np.maximum(np.abs(sx), np.abs(sy))
    cross_ = (scale != 0) & (np.abs(den) > EPS * scale)
    wx, wy = f[:, 0] - e[:, 0], f[:, 1] - e[:, 1]
    with np.errstate(divide="ignore", invalid="ignore"):
        t, u = (wx * sy - wy * sx) / den, (wx * ry - wy * rx) / den
    at, ok = np.zeros((len(e), 4)), np.zeros((len(e), 4), dtype=bool)
    ok[:, 0] = cross_ & (-EPS <= t) & (t <= 1 + EPS) & (-EPS <= u) & (u <= 1 + EPS)
    at[:, 0] = np.where(ok[:, 0], np.minimum(1.0, np.maximum(0.0, t)) + 0.0, 0.0)
    k = np.flatnonzero(~cross_)
    if len(k):
        a, b, ends = e[k, :2], e[k, 2:], (f[k, :2], f[k, 2:])
        rx, ry = rx[k], ry[k]
        length = rx * rx + ry * ry
        for n, p in enumerate(ends):
            ok[k, n] = _on_segments(p, a, b)
            with np.errstate(divide="ignore", invalid="ignore"):
                t = ((p[:, 0] - a[:, 0]) * rx + (p[:, 1] - a[:, 1]) * ry) / length
            at[k, n] = np.where(length != 0, np.minimum(1.0, np.maximum(0.0, t)) + 0.0, 0.0)
        ok[k, 2], ok[k, 3], at[k, 3] = _on_segments(a, *ends), _on_segments(b, *ends), 1.0
    return at, ok


def _cut(segments: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """``_pieces`` of all segments in their order, as rows."""
    if len(segments) < _FEW_SEGMENTS:
        made = [(*p, *q) for x0, y0, x1, y1 in segments.tolist() for p, q in _pieces((x0, y0), (x1, y1), edges)]
        return np.array(made, dtype=float).reshape(-1, 4)
    low, high = np.minimum(edges[:, :2], edges[:, 2:]), np.maximum(edges[:, :2], edges[:, 2:])
    step, out = max(1, _BLOCK // max(1, len(edges))), []
    for k in range(0, len(segments), step):
        e = segments[k : k + step]
        x0, x1 = np.minimum(e[:, :2], e[:, 2:]) - EPS, np.maximum(e[:, :2], e[:, 2:]) + EPS
        near = (low[:, 0] <= x1[:, :1]) & (high[:, 0] >= x0[:, :1]) & (low[:, 1] <= x1[:, 1:]) & (high[:, 1] >= x0[:, 1:])
        i, j = np.nonzero(near)
        at, ok = _meetings(e[i], edges[j])
        ok &= (at != 0.0) & (at != 1.0)
        row, place = np.nonzero(ok)
        t, i, f = at[row, place], i[row], edges[j[row]]
        p = e[i, :2] + t[:, None] * (e[i, 2:] - e[i, :2])
        # A cut at an edge's end takes that very point, so that neighbours stay joined.
        first, last = ((np.abs(p - q) <= 1e-11).all(1) for q in (f[:, :2], f[:, 2:]))
        p = np.where(last[:, None], f[:, 2:], np.where(first[:, None], f[:, :2], p))
        n = np.arange(len(e))
        i, t, p = np.concatenate([i, n, n]), np.concatenate([t, np.zeros(len(e)), np.ones(len(e))]), np.vstack([p, e[:, :2], e[:, 2:]])
        order = np.lexsort((np.concatenate([first | last, np.zeros(2 * len(e), dtype=bool)]), t, i))
        i, t, p = i[order], t[order], p[order]
        kept = np.append((i[1:] != i[:-1]) | (t[1:] != t[:-1]), True)
        i, p = i[kept], p[kept]
        whole = (i[1:] == i[:-1]) & (np.abs(p[1:] - p[:-1]) > EPS).any(1)
        out.append(np.hstack([p[:-1], p[1:]])[whole])
    return np.vstack(out)


def _middles(segments: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The middles of all pieces."""
    pieces = _cut(segments, edges)
    return (pieces[:, :2] + pieces[:, 2:]) / 2


def _mid(p: Pt, q: Pt) -> Pt:
    return (p[0] + q[0]) / 2, (p[1] + q[1]) / 2


def line_covered_by(line: Sequence[Pt], mp: MultiPolygon) -> bool:
    """Whether all of a line lies in a multipolygon, its boundary allowed."""
    if not mp or not line:
        return False
    if (places_in(line, mp) < 0).any():
        return False
    edges = _edge_arrays(mp)
    middles = _middles(_edge_arrays([(list(line), [])]), edges)
    return not len(middles) or bool((places_in(middles, mp) >= 0).all())


def polygon_covered_by(poly: Polygon, mp: MultiPolygon) -> bool:
    """Whether all of a polygon lies in a multipolygon, boundaries allowed.

    Its rings must be covered, and no edge of the multipolygon may run through its interior.
    """
    if not poly[0] or not mp or not line_covered_by(poly[0], mp):
        return False
    if not all(line_covered_by(r, mp) for r in poly[1]):
        return False
    x0, y0, x1, y1 = envelope(poly[0])
    own = _edge_arrays([poly])
    e = _edge_arrays(mp)
    e = e[(np.maximum(e[:, 0], e[:, 2]) >= x0) & (np.minimum(e[:, 0], e[:, 2]) <= x1) & (np.maximum(e[:, 1], e[:, 3]) >= y0) & (np.minimum(e[:, 1], e[:, 3]) <= y1)]
    middles = _middles(e, own)
    return not len(middles) or not (places_in(middles, [poly]) > 0).any()


def multi_covered_by(a: MultiPolygon, b: MultiPolygon) -> bool:
    return bool(a) and all(polygon_covered_by(p, b) for p in a)


def line_intersects(line: Sequence[Pt], mp: MultiPolygon) -> bool:
    """Whether a line and a multipolygon share a point."""
    if not mp or not line:
        return False
    if (places_in(line, mp) >= 0).any():
        return True
    edges = _edge_arrays(mp)
    return any(meeting(a, b, (e[0], e[1]), (e[2], e[3])) for a, b in zip(line, line[1:]) for e in _near(edges, a, b).tolist())


def disjoint(a: MultiPolygon, b: MultiPolygon) -> bool:
    return not multi_intersects(a, b)


def multi_intersects(a: MultiPolygon, b: MultiPolygon) -> bool:
    """Whether two multipolygons share a point."""
    if not a or not b:
        return False
    if any(line_intersects(r, b) for r in rings(a)):
        return True
    return any(place_in(r[0], a) >= 0 for r in rings(b))


def ring_within(inner: Ring, outer: Ring) -> bool:
    """Planar and strict: the inner box strictly inside the outer one, and the ring covered."""
    a, b = envelope(inner), envelope(outer)
    if not (b[0] < a[0] and b[1] < a[1] and a[2] < b[2] and a[3] < b[3]):
        return False
    return polygon_covered_by((inner, []), [(outer, [])])


def is_simple(ring: Ring) -> bool:
    """Whether a closed ring neither crosses nor touches itself."""
    if len(ring) < 4 or ring[0] != ring[-1] or len(set(ring[:-1])) != len(ring) - 1:
        return False
    return not any(True for _ in _self_meetings(ring))


def _self_meetings(ring: Ring) -> Iterator[tuple[int, int]]:
    """Pairs of a closed ring's edges that share more than the point between neighbours."""
    pts = np.asarray(ring, dtype=float)
    e = np.hstack([pts[:-1], pts[1:]])
    low, high = np.minimum(pts[:-1], pts[1:]), np.maximum(pts[:-1], pts[1:])
    n = len(e)
    step = max(1, _BLOCK // max(1, n))
    for k in range(0, n, step):
        x0, x1 = low[k : k + step], high[k : k + step]
        near = (low[k:, 0] <= x1[:, :1]) & (high[k:, 0] >= x0[:, :1]) & (low[k:, 1] <= x1[:, 1:]) & (high[k:, 1] >= x0[:, 1:])
        i, j = np.nonzero(np.triu(near, 1))
        i, j = i + k, j + k
        met = _meet(e[i], e[j], i, j, n)
        yield from zip(i[met].tolist(), j[met].tolist())


def _meet(e: np.ndarray, f: np.ndarray, i: np.ndarray, j: np.ndarray, n: int | np.ndarray) -> np.ndarray:
    """Which edges ``i`` and later ones ``j`` of rings of ``n`` edges share more than the point between neighbours."""
    at, ok = _meetings(e, f)
    after, around = j == i + 1, (i == 0) & (j == n - 1) & (j != i + 1)
    ok &= ~after[:, None] | (at < 1 - 1e-9)
    ok &= ~around[:, None] | (at > 1e-9)
    return ok.any(1)


# ---------------------------------------------------------------- many rings at once

#: Points of many rings one after the other, and the place at which each begins, with that behind the last.
Packed = tuple[np.ndarray, np.ndarray]
#: Pairs of edges that are looked at together, what fits a core's cache; a ring of more is looked at alone.
_TOGETHER = 1 << 18


def packed(many: Sequence[Ring]) -> Packed:
    pts = np.array([p for r in many for p in r], dtype=float).reshape(-1, 2)
    return pts, np.cumsum([0, *map(len, many)])


def unpacked(many: Packed) -> list[Ring]:
    pts, starts = list(map(tuple, many[0].tolist())), many[1].tolist()
    return [pts[a:b] for a, b in zip(starts, starts[1:])]


def are_simple(many: Packed) -> np.ndarray:
    """``is_simple`` of each ring; points that are there twice are edges that meet."""
    pts, starts = many
    size = np.diff(starts)
    out = size >= 4
    whole = np.flatnonzero(out)
    out[whole] = (pts[starts[whole]] == pts[starts[whole + 1] - 1]).all(1)
    out[_meetings_of(many, np.flatnonzero(out))[0]] = False
    return out


def _meetings_of(many: Packed, some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_self_meetings`` of some of the rings: ring, edge and later edge of each, in no order.

    Rings of like size are looked at together, as arrays with a place for each pair of edges.
    """
    pts, starts = many
    n = np.diff(starts)[some] - 1
    some, n = some[order := np.argsort(n, kind="stable")], n[order]
    out, k = [], int(np.searchsorted(n, 1))  # a ring without edges has no meetings
    while k < len(some):
        # So many rings that fit with the room the largest of them takes.
        here = n[k : k + max(1, _TOGETHER // int(n[k]) ** 2)]
        here = here[: max(1, int(np.searchsorted(np.arange(1, len(here) + 1) * here.astype(np.int64) ** 2, _TOGETHER, "right")))]
        which, most = some[k : k + len(here)], int(here[-1])
        k += len(here)
        if most**2 > _TOGETHER:
            pairs = np.array(list(_self_meetings(pts[starts[which[0]] : starts[which[0] + 1]])), dtype=np.int64).reshape(-1, 2)
            out.append((np.repeat(which, len(pairs)), *pairs.T))
            continue
        place = np.arange(most)
        at = np.minimum(starts[which][:, None] + place, len(pts) - 2)
        e = np.concatenate([pts[at], pts[at + 1]], axis=2)
        e[place >= here[:, None]] = np.nan  # near nothing
        low, high = np.minimum(e[:, :, :2], e[:, :, 2:]), np.maximum(e[:, :, :2], e[:, :, 2:])
        near = np.less.outer(place, place) & (low[:, None, :, 0] <= high[:, :, None, 0])
        near &= high[:, None, :, 0] >= low[:, :, None, 0]
        near &= low[:, None, :, 1] <= high[:, :, None, 1]
        near &= high[:, None, :, 1] >= low[:, :, None, 1]
        r, pair = np.divmod(np.flatnonzero(near), most * most)
        i, j = np.divmod(pair, most)
        met = _meet(e[r, i], e[r, j], i, j, here[r])
        out.append((which[r[met]], i[met], j[met]))
    return tuple(np.concatenate(x) for x in zip(*out)) if out else (np.empty(0, np.int64),) * 3


def _tidied(many: Packed) -> Packed:
    """``drop_repeats(reclose(ring))`` of each ring."""
    pts, starts = many
    full = np.flatnonzero(np.diff(starts))
    open_ = full[(pts[starts[full]] != pts[starts[full + 1] - 1]).any(1)]
    pts = np.insert(pts, starts[open_ + 1], pts[starts[open_]], axis=0)
    starts = starts + np.searchsorted(open_ + 1, np.arange(len(starts)), "right")
    kept = np.ones(len(pts), dtype=bool)
    kept[1:] = (pts[1:] != pts[:-1]).any(1)
    kept[starts[:-1][np.diff(starts) > 0]] = True
    return _only(pts, starts, kept)


def _only(pts: np.ndarray, starts: np.ndarray, kept: np.ndarray) -> Packed:
    return pts[kept], np.concatenate([[0], np.cumsum(kept)])[starts]


def all_without_crossings(many: Packed) -> Packed:
    """Each ring without the loops that its crossing edges close.

    All crossings are found at once. Two edges that cross close a loop, the shorter way around
    between them; loops that overlap, or lie in one another, are one group, and the points of a
    group go together. What is left may cross anew, so this is repeated for the rings that had
    crossings; each time points go.
    """
    pts, starts = _tidied(many)
    left = np.flatnonzero(np.diff(starts) > 3)
    while len(left):
        r, i, j = _meetings_of((pts, starts), left)
        n = starts[r + 1] - starts[r] - 1
        crossing = (j > i + 1) & ~((i == 0) & (j == n - 1))
        r, i, j, n = r[crossing], i[crossing], j[crossing], n[crossing]
        if not len(r):
            break
        low, between, last = starts[r], 2 * (j - i) <= n, starts[r] + n
        # +1 where a loop begins, -1 behind its end; what isn't between the two edges is before and behind them.
        begin = np.concatenate([(low + i + 1)[between], low[~between], (low + j + 1)[~between]])
        end = np.concatenate([(low + j + 1)[between], (low + i + 1)[~between], last[~between]])
        depth = np.cumsum(np.bincount(begin, minlength=len(pts)) - np.bincount(end, minlength=len(pts)))
        kept = depth == 0
        left = np.unique(r)
        kept[starts[left + 1] - 1] = False  # the closing point; it is set anew
        pts, starts = _tidied(_only(pts, starts, kept))
        left = left[np.diff(starts)[left] > 3]
    return pts, starts


def is_valid(mp: MultiPolygon) -> bool:
    """Simple rings, and holes inside their outer ring."""
    return bool(mp) and all(is_simple(o) and all(is_simple(r) and polygon_covered_by((r, []), [(o, [])]) for r in inners) for o, inners in mp)


# ---------------------------------------------------------------- overlay


def overlay(a: MultiPolygon, b: MultiPolygon, how: str) -> MultiPolygon:
    """``union``, ``intersection`` or ``difference`` of two multipolygons.

    Edges of each are cut where they meet the other's; a piece stays by the side of the other on
    which its middle lies, and pieces are joined to rings, turning left-most where rings touch.
    """
    a, b = [correct(p) for p in a if p[0]], [correct(p) for p in b if p[0]]
    if not a or not b:
        return a if how == "difference" or (how == "union" and not b) else (b if how == "union" else [])
    keep: list[tuple[Pt, Pt]] = []
    ea, eb = _edge_arrays(a), _edge_arrays(b)
    directed_b = {(_key(p), _key(q)) for p, q in _pairs(_cut(eb, ea))}
    for mine, other, edges, first in ((a, b, eb, True), (b, a, ea, False)):
        pieces = _cut(_edge_arrays(mine), edges)
        places = places_in((pieces[:, :2] + pieces[:, 2:]) / 2, other)
        for (p, q), at in zip(_pairs(pieces), places.tolist()):
            if at == 0:
                if not first:
                    continue
                same = (_key(p), _key(q)) in directed_b
                if same != (how == "difference"):
                    keep.append((p, q))
            elif how == "union":
                if at < 0:
                    keep.append((p, q))
            elif how == "intersection":
                if at > 0:
                    keep.append((p, q))
            elif first and at < 0:
                keep.append((p, q))
            elif not first and at > 0:
                keep.append((q, p))
    return _assemble(_join(keep))


def _pairs(pieces: np.ndarray) -> list[tuple[Pt, Pt]]:
    return [((x0, y0), (x1, y1)) for x0, y0, x1, y1 in pieces.tolist()]


def _key(p: Pt) -> tuple[int, int]:
    return round(p[0] * 1e10), round(p[1] * 1e10)


def _join(pieces: list[tuple[Pt, Pt]]) -> list[Ring]:
    """Closed rings of directed pieces."""
    start: dict[tuple[int, int], list[int]] = {}
    for i, (p, _) in enumerate(pieces):
        start.setdefault(_key(p), []).append(i)
    used, out = [False] * len(pieces), []
    for i in range(len(pieces)):
        if used[i]:
            continue
        ring, at = [pieces[i][0]], i
        while True:
            used[at] = True
            p, q = pieces[at]
            ring.append(q)
            if _key(q) == _key(ring[0]):
                ring[-1] = ring[0]
                if len(ring) > 3:
                    out.append(ring)
                break
            turn = [j for j in start.get(_key(q), []) if not used[j]]
            if not turn:
                break
            back = math.atan2(p[1] - q[1], p[0] - q[0])
            angle = lambda j: (back - math.atan2(pieces[j][1][1] - q[1], pieces[j][1][0] - q[0])) % (2 * math.pi) or 2 * math.pi  # noqa: B023, E731
            at = min(turn, key=angle)
    return out


def _assemble(loops: list[Ring]) -> MultiPolygon:
    """Counter-clockwise rings with the clockwise ones inside them as holes."""
    loops = [r for r in loops if abs(signed_area(r)) > 1e-20]
    outers: MultiPolygon = [(r, []) for r in loops if signed_area(r) > 0]
    for hole in (r for r in loops if signed_area(r) < 0):
        inside = [p for p in outers if any(place_in_ring(q, p[0]) > 0 for q in [*hole, _mid(hole[0], hole[1])])]
        if inside:
            min(inside, key=lambda p: signed_area(p[0]))[1].append(hole)
    return outers


# ---------------------------------------------------------------- ring assembly


def _is_ring(points: Sequence[Pt]) -> bool:
    return len(points) > 3 and points[0] == points[-1]


def stitch(parts: Sequence[Sequence[Pt]]) -> list[Ring]:
    """Chains of parts that share end points; each part is in one chain.

    A part that is a ring is a chain of its own. The first unused part begins a chain; at its end,
    then at its start, the earliest unused part that has an end point there is joined on, turned
    where need be, until none is left or the chain is a ring. End points are indexed, so the time
    grows with the number of points, not with the square of the number of parts.
    """
    whole = [list(p) for p in parts if p]
    ends: dict[Pt, deque[int]] = {}
    for i, p in enumerate(whole):
        if not _is_ring(p):
            for point in {p[0], p[-1]}:
                ends.setdefault(point, deque()).append(i)
    used = [False] * len(whole)

    def further(point: Pt) -> list[Pt] | None:
        """The next part from this point on, the point itself left out."""
        waiting = ends.get(point, ())
        while waiting:
            i = waiting.popleft()
            if not used[i]:
                used[i] = True
                return whole[i][1:] if whole[i][0] == point else whole[i][-2::-1]
        return None

    chains = []
    for i, first in enumerate(whole):
        if used[i]:
            continue
        used[i] = True
        chain = deque(first)
        for at, grow in ((-1, chain.extend), (0, chain.extendleft)):
            while not _is_ring(chain) and (more := further(chain[at])) is not None:
                grow(more)
        chains.append(list(chain))
    return chains


def closed_and_open(chains: Sequence[Ring]) -> tuple[list[Ring], list[Ring]]:
    """(closed chains of more than three points, the others)."""
    return [c for c in chains if _is_ring(c)], [c for c in chains if not _is_ring(c)]


def assign_holes(outers: Sequence[Ring], inners: Sequence[Ring], strict: bool) -> list[Polygon]:
    """Each inner ring goes to the first outer one that holds it; others are dropped.

    ``strict``: planar within (relations); otherwise covered by (boundaries).
    """
    left = list(inners)
    out: list[Polygon] = []
    for o in outers:
        mine = [r for r in left if (ring_within(r, o) if strict else polygon_covered_by((r, []), [(o, [])]))]
        left = [r for r in left if r not in mine]
        out.append((list(o), [list(r) for r in mine]))
    return out


# ---------------------------------------------------------------- simplification


def distances(a: Pt, b: Pt, pts: np.ndarray) -> np.ndarray:
    """Signed distances in degrees of points from the line ab."""
    length = math.hypot(a[0] - b[0], a[1] - b[1])
    if length == 0:
        raise ValueError("a line needs two points")
    return ((b[1] - a[1]) * (a[0] - pts[:, 0]) - (b[0] - a[0]) * (a[1] - pts[:, 1])) / length


def one_sided(ring: Ring, eps: float, inside: bool) -> Ring:
    """A ring with fewer points that gives way to one side only.

    The rule: a chord between two points of the ring may stand for all points between them when
    each lies on the side that may go (``inside``: at a positive distance, else at a negative one)
    or on the chord, and none is further than ``eps``. Where it may not, the point that speaks most
    against it stays and cuts the range in two: the furthest one on the other side, else the
    furthest one. The edge from the last point to the first is kept.
    """
    return one_sided_at(ring, [eps], inside)[0]


def one_sided_at(ring: Ring, tolerances: Iterable[float], inside: bool) -> list[Ring]:
    """``one_sided`` at each tolerance. Where a range is cut doesn't depend on it, so ranges are looked at once."""
    pts = np.asarray(ring[:-1] if ring and ring[0] == ring[-1] else ring, dtype=float).reshape(-1, 2)
    plain = pts.tolist()
    seen: dict[tuple[int, int], tuple[float, float, int]] = {}  # (least and greatest distance, cut) of a range
    out = []
    for eps in tolerances:
        kept = np.zeros(len(pts), dtype=bool)
        kept[:1] = kept[-1:] = True
        ranges = [(0, len(pts) - 1)]
        while ranges:
            first, last = ranges.pop()
            if last - first < 2:
                continue
            if (first, last) not in seen:
                seen[first, last] = _range(pts, plain, first, last, inside)
            least, most, cut = seen[first, last]
            if least >= 0 and most <= eps:
                continue
            kept[cut] = True
            ranges += [(first, cut), (cut, last)]
        out.append(drop_repeats(reclose([tuple(p) for p in pts[kept].tolist()])))
    return out


#: Below so many points plain loops are faster than arrays.
_SHORT = 40


def _range(pts: np.ndarray, plain: list[list[float]], first: int, last: int, inside: bool) -> tuple[float, float, int]:
    """(least and greatest distance of the points between from their chord, the point to cut at)."""
    a, b = plain[first], plain[last]
    if last - first > _SHORT or a == b:
        between = pts[first + 1 : last]
        if a == b:  # no chord: all that differs from the point must stay
            free = -np.hypot(*(between - pts[first]).T)
        else:
            free = distances(tuple(a), tuple(b), between) * (1 if inside else -1)
        least, most = float(free.min()), float(free.max())
        return least, most, first + 1 + int(free.argmin() if least < 0 else free.argmax())
    (ax, ay), dx, dy, length = a, b[0] - a[0], b[1] - a[1], math.hypot(a[0] - b[0], a[1] - b[1])
    sign = 1 if inside else -1
    values = [(dy * (ax - x) - dx * (ay - y)) / length * sign for x, y in plain[first + 1 : last]]
    least, most = min(values), max(values)
    return least, most, first + 1 + values.index(least if least < 0 else most)


def score(points: int, most_points: int, kept_area: float, full_area: float) -> float:
    return 0.40 * (1 - points / most_points) + 0.60 * (kept_area / full_area if full_area else 0.0)


#: Rings below this many points are not simplified, nor below so many in the result; the
#: least and widest tolerance in degrees, and the number of tolerances.
LEAST_POINTS, LEAST_KEPT, LEAST_EPS, MOST_EPS, EPS_STEPS = 30, 7, 1e-8, 0.013, 6


def tolerances() -> np.ndarray:
    return LEAST_EPS + (MOST_EPS - LEAST_EPS) / EPS_STEPS * np.arange(EPS_STEPS)


def simplified_inside(ring: Ring) -> Ring | None:
    """The simplification of a ring, points going outwards only, at which the score stops rising.

    The ring is simplified at every tolerance first. Those that drop points make a series, which
    ends before the first one with too few points; of it the last one before the score first falls
    is taken.
    """
    full = abs(signed_area(ring))
    tried = one_sided_at(ring, tolerances().tolist(), inside=False)
    series = list(takewhile(lambda r: len(r) >= LEAST_KEPT, (r for r in tried if len(r) < len(ring))))
    if not series:
        return None
    scores = np.array([score(len(r), len(ring), abs(signed_area(r)), full) for r in series])
    falls = np.flatnonzero(np.diff(scores) < 0)
    return series[falls[0] if len(falls) else -1]


def under_estimate(ring: Ring) -> MultiPolygon:
    """A smaller polygon inside the ring; empty for rings of few points, or where none is found.

    The simplified ring is taken when it is valid and covered by the ring; if it crosses itself, with
    its crossing loops cut out; and what sticks out of the ring is clipped.
    """
    if len(ring) < LEAST_POINTS:
        return []
    ring, _ = correct((ring, []))
    exact: MultiPolygon = [(ring, [])]
    small = simplified_inside(ring)
    if small is None:
        return []
    if not is_simple(small):
        small = without_crossings(small)
        if not is_simple(small):
            return []
    shape: MultiPolygon = [correct((small, []))]
    if multi_covered_by(shape, exact):
        return shape
    shape = [p for p in overlay(shape, exact, "intersection") if is_valid([p])]
    return shape if multi_covered_by(shape, exact) else []


def over_estimate(ring: Ring) -> MultiPolygon:
    """A larger polygon around the ring; the box for rings of few points, or where nothing else works."""
    box = box_polygon(envelope(ring))
    if len(ring) < LEAST_POINTS:
        return [box]
    ring, _ = correct((ring, []))
    got, wide = one_sided_at(ring, [MOST_EPS, 6 * MOST_EPS], inside=True)
    for find in (lambda: got, lambda: without_crossings(wide)):
        c = find()
        if len(c) > 3 and is_simple(c):
            mp = [correct((c, []))]
            if polygon_covered_by((ring, []), mp):
                return mp
            joined = overlay([(ring, [])], mp, "union")
            if len(joined) == 1 and is_valid(joined) and polygon_covered_by((ring, []), joined):
                return joined
    return [box]


def without_crossings(ring: Ring) -> Ring:
    """``all_without_crossings`` of one ring."""
    return unpacked(all_without_crossings(packed([ring])))[0]


def _crossings(ring: Ring) -> list[tuple[int, int]]:
    """All pairs of edges, not neighbours, that share a point."""
    n = len(ring) - 1
    return [(i, j) for i, j in _self_meetings(ring) if j > i + 1 and not (i == 0 and j == n - 1)]


def kept_valid(points: Sequence[Pt], lines: Sequence[Ring], polygons: Sequence[Polygon]) -> tuple[list[Pt], list[Ring], list[Polygon]]:
    """The valid elements of a collection; a polygon that isn't valid as it is, is tried corrected.

    Points are finite, lines have two different points, polygons simple rings with holes inside.
    """
    finite = lambda p: math.isfinite(p[0]) and math.isfinite(p[1])
    good_lines = [x for x in lines if all(map(finite, x)) and len(set(x)) > 1]
    good_polygons = []
    for p in polygons:
        if is_valid([p]):
            good_polygons.append(p)
        elif p[0] and is_valid([fixed := correct((drop_repeats(p[0]), [drop_repeats(r) for r in p[1]]))]):
            good_polygons.append(fixed)
    return [p for p in points if finite(p)], good_lines, good_polygons
