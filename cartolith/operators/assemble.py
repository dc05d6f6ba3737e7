"""Geometry of relations and boundaries: one row in, one row out, in Arrow batches.

All parts of a relation are in its row, in member order, since joining rings depends on that order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions import geometry as g
from cartolith.scratch import prepare

#: Fixed value: boundaries of more outer ways are skipped in the golden profile.
MOST_OUTERS = 3000

_PT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
_RING = pa.list_(_PT)
_POLYGON = pa.struct([("outer", _RING), ("inners", pa.list_(_RING))])

GEOMETRIES = f"id BIGINT, has_tag BOOLEAN, wkt STRING, points ARRAY<{model.POINT}>, lines ARRAY<{model.RING}>, polygons ARRAY<{model.POLYGON}>"


def ring_in(points: list[dict]) -> g.Ring:
    return [(p["lon"], p["lat"]) for p in points]


def ring_out(ring: g.Ring) -> list[dict]:
    return [{"lon": float(x), "lat": float(y)} for x, y in ring]


def polygon_in(p: dict) -> g.Polygon:
    return ring_in(p["outer"]), [ring_in(r) for r in p["inners"]]


def polygon_out(p: g.Polygon) -> dict:
    return {"outer": ring_out(p[0]), "inners": [ring_out(r) for r in p[1]]}


def coordinates_to_polygon(points: list[dict]) -> g.Polygon:
    """A corrected polygon of a ring of coordinates."""
    return g.correct((ring_in(points), []))


def _pairs(ring: g.Ring) -> str:
    return ",".join("%f %f" % p for p in ring)


def relation_geometry(points: list[g.Pt], outers: list[g.Ring], inners: list[g.Ring]) -> tuple[str, list[g.Ring], list[g.Polygon]]:
    """(WKT, lines, polygons) of a relation.

    Outer parts are joined to chains; closed ones are polygons and take the closed inner chains
    that lie within them. The collection has points, polygons with holes, open chains, then the
    other polygons. Inner chains that are open or within no polygon are not written.
    """
    closed, lines = g.closed_and_open(g.stitch(outers))
    holes, _ = g.closed_and_open(g.stitch(inners))
    polygons = g.assign_holes(closed, holes, strict=True)
    with_holes = [p for p in polygons if p[1]]
    plain = [p for p in polygons if not p[1]]
    polygon = lambda p: "POLYGON((" + _pairs(p[0]) + ")" + "".join(f",({_pairs(r)})" for r in p[1]) + ")"
    parts = ["POINT(%f %f)" % p for p in points] + [polygon(p) for p in with_holes] + [f"LINESTRING({_pairs(line)})" for line in lines] + [polygon(p) for p in plain]
    return f"GEOMETRYCOLLECTION({','.join(parts)})", lines, with_holes + plain


def relation_geometries(parts: DataFrame) -> DataFrame:
    """``id, has_tag, wkt, points, lines, polygons`` of ``rel_id, has_tag, points, outers, inners``."""
    prepare(parts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, tags, pts, outs, ins = (batch.column(i).to_pylist() for i in range(5))
            wkts, points, lines, polys = [], [], [], []
            for p, o, i in zip(pts, outs, ins):
                w, ls, ps = relation_geometry(ring_in(p), [ring_in(x) for x in o], [ring_in(x) for x in i])
                wkts.append(w)
                # The text has every element; what takes part in spatial relations has to be valid.
                good, ls, ps = g.kept_valid(ring_in(p), ls, ps)
                points.append(ring_out(good))
                lines.append([ring_out(x) for x in ls])
                polys.append([polygon_out(x) for x in ps])
            cols = [batch.column(0), batch.column(1), pa.array(wkts, pa.string()), pa.array(points, _RING), pa.array(lines, pa.list_(_RING)), pa.array(polys, pa.list_(_POLYGON))]
            yield pa.RecordBatch.from_arrays(cols, names=["id", "has_tag", "wkt", "points", "lines", "polygons"])

    return parts.select("rel_id", "has_tag", "points", "outers", "inners").mapInArrow(run, GEOMETRIES)


def boundary_geometry(outers: list[g.Ring], inners: list[g.Ring]) -> tuple[g.MultiPolygon, g.MultiPolygon, g.MultiPolygon] | None:
    """(exact, over-estimate, under-estimate); None without a closed outer ring."""
    closed, _ = g.closed_and_open(g.stitch(outers))
    if not closed:
        return None
    holes, _ = g.closed_and_open(g.stitch(inners))
    exact = [g.correct(p) for p in g.assign_holes([g.drop_repeats(r) for r in closed], holes, strict=False)]
    over: g.MultiPolygon = []
    under: g.MultiPolygon = []
    for outer, mine in exact:
        over += g.over_estimate(outer)
        small = g.under_estimate(outer)
        for hole in mine:
            if small and not g.disjoint(small, [(hole, [])]):
                small = g.overlay(small, [(hole, [])], "difference")
        under += small
    return exact, over, under


def boundaries(parts: DataFrame, most_outers: int | None = None) -> DataFrame:
    """The boundary table (``model.BOUNDARIES``) of ``rel_id, outers, inners``; area in square metres.

    The box is that of great-circle edges. With ``most_outers`` boundaries of more outer ways are left out.
    """
    prepare(parts.sparkSession)
    if most_outers is not None:
        parts = parts.where(F.size("outers") <= most_outers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, outs, ins in zip(*(batch.column(k).to_pylist() for k in range(3))):
                made = boundary_geometry([ring_in(x) for x in outs], [ring_in(x) for x in ins])
                if made is None:
                    continue
                exact, over, under = made
                box = g.spherical_envelope(exact)
                rows.append((i, g.area(exact, model.EARTH_RADIUS), *box, *([polygon_out(p) for p in mp] for mp in made)))
            kinds = [pa.int64(), *[pa.float64()] * 5, *[pa.list_(_POLYGON)] * 3]
            names = ["id", "area", "xmin", "ymin", "xmax", "ymax", "exact", "over", "under"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(kinds)], names=names)

    return parts.select("rel_id", "outers", "inners").mapInArrow(run, model.BOUNDARIES)
