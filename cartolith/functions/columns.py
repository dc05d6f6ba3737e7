"""Geometry of point arrays as column expressions: boxes, areas, WKT, distances."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cartolith.functions.text import fixed6_pairs


def bbox(points: Column) -> Column:
    """``xmin, ymin, xmax, ymax`` of an array of points."""
    lon, lat = F.transform(points, lambda p: p["lon"]), F.transform(points, lambda p: p["lat"])
    return F.struct(F.array_min(lon).alias("xmin"), F.array_min(lat).alias("ymin"), F.array_max(lon).alias("xmax"), F.array_max(lat).alias("ymax"))


def box_ring(xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """A box as a closed ring, counter-clockwise."""
    p = lambda x, y: F.struct(x.alias("lon"), y.alias("lat"))
    return F.array(p(xmin, ymin), p(xmax, ymin), p(xmax, ymax), p(xmin, ymax), p(xmin, ymin))


def boxes_overlap(a: str, b: str) -> Column:
    """Whether two boxes, given by column prefixes, share a point."""
    c = F.col
    return (c(f"{a}xmin") <= c(f"{b}xmax")) & (c(f"{b}xmin") <= c(f"{a}xmax")) & (c(f"{a}ymin") <= c(f"{b}ymax")) & (c(f"{b}ymin") <= c(f"{a}ymax"))


def _edges(points: Column) -> Column:
    n = F.size(points)
    return F.transform(F.slice(points, 2, F.greatest(n - 1, F.lit(0))), lambda q, i: F.struct(F.get(points, i).alias("a"), q.alias("b")))


def planar_area(points: Column) -> Column:
    """Signed area of a closed ring in squared degrees; positive when counter-clockwise."""
    twice = F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s + e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"])
    return twice / 2


def spherical_area(points: Column, radius: float = 1.0) -> Column:
    """Signed area of a closed ring with great-circle edges; positive when counter-clockwise.

    The excess of the strip between an edge and the equator is
    ``2 atan(tan(dlon / 2) * sin((lat1 + lat2) / 2) / cos((lat1 - lat2) / 2))``; a ring's area is
    minus the sum.
    """

    def strip(e: Column) -> Column:
        dlon = F.radians(e["b"]["lon"] - e["a"]["lon"])
        y1, y2 = F.radians(e["a"]["lat"]), F.radians(e["b"]["lat"])
        return 2 * F.atan(F.tan(dlon / 2) * F.sin((y1 + y2) / 2) / F.cos((y1 - y2) / 2))

    return F.aggregate(_edges(points), F.lit(0.0), lambda s, e: s - strip(e)) * (radius * radius)


def corrected(points: Column) -> Column:
    """The ring closed, and counter-clockwise."""
    closed = reclosed(points)
    return F.when(planar_area(closed) < 0, F.reverse(closed)).otherwise(closed)


def reclosed(points: Column) -> Column:
    """The ring with its first point at the end as well."""
    first = F.get(points, F.lit(0))
    return F.when((F.size(points) > 0) & (first != F.element_at(points, -1)), F.concat(points, F.array(first))).otherwise(points)


def unique_points(points: Column) -> Column:
    """Without points that equal the one before."""
    return F.filter(points, lambda p, i: (i == 0) | (p != F.get(points, i - 1)))


def is_closed(points: Column, more_than: int) -> Column:
    """More than so many points, the last equal to the first."""
    return (F.size(points) > more_than) & (F.get(points, F.lit(0)) == F.element_at(points, -1))


def way_wkt(points: Column) -> Column:
    """A way's WKT: closed ways of more than two points are polygons."""
    told = F.array_join(fixed6_pairs(points), ", ")
    return F.when(is_closed(points, 2), F.concat(F.lit("POLYGON(("), told, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING("), told, F.lit(")")))


def line_distance(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Signed distance in degrees of C from the line AB; null where A equals B."""
    length = F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))
    return F.when(length > 0, ((by - ay) * (ax - cx) - (bx - ax) * (ay - cy)) / length)


def simplification_score(points: Column, most_points: Column, area: Column, full_area: Column) -> Column:
    """How good a simplification is: 40 % for points saved, 60 % for area kept."""
    return 0.40 * (1 - points / most_points) + 0.60 * (area / full_area)


def within_tolerance(difference: Column, original: Column) -> Column:
    """Whether an area difference is positive and below 1e-5 of the original."""
    share = F.when(original != 0, difference / original)
    return F.coalesce((share > 0) & (share < 1e-5), F.lit(False))


def ring_distance(i: Column, j: Column, n: Column) -> Column:
    """Steps between two places of a ring of ``n``, the shorter way."""
    return F.least(F.pmod(i - j, n), F.pmod(j - i, n))


def read_wkt(wkt: Column) -> Column:
    """The rings of a ``POINT``, ``LINESTRING`` or ``POLYGON`` text as arrays of points; null for other texts.

    A point is a ring of one point, a line a ring of its points.
    """
    body = F.regexp_extract(wkt, r"^\s*(?:POINT|LINESTRING|POLYGON)\s*\(+(.*?)\)+\s*$", 1)
    number = lambda p, i: F.element_at(F.split(F.trim(p), r"\s+"), i).cast("double")
    point = lambda p: F.struct(number(p, 1).alias("lon"), number(p, 2).alias("lat"))
    rings = F.transform(F.split(body, r"\)\s*,\s*\("), lambda r: F.transform(F.split(r, ","), point))
    return F.when(body != "", rings)
