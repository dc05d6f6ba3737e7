"""Spatial joins of features with boundaries: filter on a grid, refine on geometry.

Filter: boxes are put on a grid with levels. A boundary lies on the finest level on which it covers
few cells; a feature probes every level that holds boundaries. So the join is an equi-join on
(level, cell), however large a boundary is, and no cell list grows without bound. Overlapping boxes
give each pair once.

Refine: exact predicates on the sphere (great-circle edges, by gnomonic projection about the
boundary; planar on request). The under- and over-estimates only decide earlier what the exact
shape would decide as well.

Candidates are pairs of ids until then. A boundary's pairs are dealt to as many parts as they need
(``PART_PAIRS`` each), so a country that holds most features is no hot key; its shape goes to each
part once, not to each pair, and a part is a stream: the shape first, then the features one batch
after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions import geometry as g
from cartolith.functions.columns import boxes_overlap
from cartolith.operators.assemble import polygon_in, ring_in
from cartolith.scratch import materialise, prepare

FINEST = 0.25
LEVELS = 12
#: A box covers at most so many cells in each direction on its level, and one more.
CELLS = 4
#: Candidate pairs of a boundary that one part takes, about.
PART_PAIRS = 20_000
#: Fixed value: a polygon of a relation that is a boundary itself may stick out by this share of its area.
TOLERANCE = 1e-5

FEATURES = f"fid STRING, self BIGINT, kind STRING, points ARRAY<{model.POINT}>, lines ARRAY<{model.RING}>, polygons ARRAY<{model.POLYGON}>"


def level_of(width: Column, height: Column) -> Column:
    """The finest level on which a box of this size covers at most ``CELLS`` cells a side."""
    steps = F.log2(F.greatest(width, height, F.lit(FINEST * CELLS)) / (FINEST * CELLS))
    return F.least(F.ceil(steps), F.lit(LEVELS)).cast("int")


def cells(level: Column, prefix: str = "") -> Column:
    """The cells ``cx, cy`` of a box on a level, as an array."""
    size = F.pow(F.lit(2.0), level) * FINEST
    place = lambda c: F.floor(F.col(prefix + c) / size).cast("int")
    xs, ys = F.sequence(place("xmin"), place("xmax")), F.sequence(place("ymin"), place("ymax"))
    return F.flatten(F.transform(xs, lambda x: F.transform(ys, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def candidates(features: DataFrame, boundaries: DataFrame, sphere: bool = False) -> DataFrame:
    """``fid, bid, inside_box``: pairs whose boxes share a point, each once.

    ``features``: ``fid`` and a box; ``boundaries``: ``id`` and a box. ``inside_box``: whether the
    boundary's box holds the feature's (always true for the sphere, where it tells nothing).
    """
    box = ["xmin", "ymin", "xmax", "ymax"]
    b = boundaries.select(F.col("id").alias("bid"), *[F.col(c).alias(f"b_{c}") for c in box])
    b = b.withColumn("level", level_of(F.col("b_xmax") - F.col("b_xmin"), F.col("b_ymax") - F.col("b_ymin")))
    b = b.withColumn("cell", F.explode(cells(F.col("level"), "b_")))
    f = features.select("fid", *[F.col(c).alias(f"f_{c}") for c in box])
    levels = [r.level for r in b.select("level").distinct().collect()]  # at most LEVELS + 1 values
    if not levels:
        return f.select("fid", F.lit(0).cast("long").alias("bid"), F.lit(True).alias("inside_box")).limit(0)
    f = f.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels])))
    f = f.withColumn("cell", F.explode(cells(F.col("level"), "f_")))
    # Of the cells that a pair shares, the first one speaks for it: no distinct is needed.
    size = F.pow(F.lit(2.0), F.col("level")) * FINEST
    first = lambda c: F.floor(F.greatest(F.col(f"f_{c}"), F.col(f"b_{c}")) / size).cast("int")
    own = (F.col("cell.cx") == first("xmin")) & (F.col("cell.cy") == first("ymin"))
    inside = F.lit(True) if sphere else F.expr("b_xmin <= f_xmin AND f_xmax <= b_xmax AND b_ymin <= f_ymin AND f_ymax <= b_ymax")
    return f.join(b, ["level", "cell"]).where(boxes_overlap("f_", "b_") & own).select("fid", "bid", inside.alias("inside_box"))


def feature_boxes(features: DataFrame) -> DataFrame:
    """``features`` with the box of all their points."""
    rings = F.concat("lines", F.transform("polygons", lambda p: p["outer"]))
    every = F.concat("points", F.flatten(rings))
    lon, lat = F.transform(every, lambda p: p["lon"]), F.transform(every, lambda p: p["lat"])
    boxed = features.withColumn("xmin", F.array_min(lon)).withColumn("xmax", F.array_max(lon)).withColumn("ymin", F.array_min(lat)).withColumn("ymax", F.array_max(lat))
    return boxed.where("xmin is not null")


class Boundary:
    """A boundary ready for tests; on the sphere, projected about its middle."""

    def __init__(self, exact: g.MultiPolygon, over: g.MultiPolygon, under: g.MultiPolygon, sphere: bool):
        self.project = None
        self.exact, self.over, self.under = exact, over, under
        if sphere and exact:
            centre = g.Gnomonic.around([p for o, _ in exact for p in o])
            told = centre.multi(exact)
            if told is not None:
                self.project = centre
                self.exact, self.over, self.under = told, centre.multi(over) or [], centre.multi(under) or []

    def shape(self, points: list[g.Pt], lines: list[g.Ring], polygons: list[g.Polygon]) -> "Feature | None":
        if self.project is None:
            return Feature(points, lines, polygons)
        p = self.project.points(points)
        ls = [self.project.points(x) for x in lines]
        ps = self.project.multi(polygons)
        if p is None or ps is None or any(x is None for x in ls):
            return None  # beyond the horizon
        return Feature(p, ls, ps)  # type: ignore[arg-type]


class Feature:
    def __init__(self, points: list[g.Pt], lines: list[g.Ring], polygons: list[g.Polygon]):
        self.points, self.lines, self.polygons = points, lines, polygons

    def covered_by(self, mp: g.MultiPolygon) -> bool:
        return (
            all(g.point_covered_by(p, mp) for p in self.points)
            and all(g.line_covered_by(x, mp) for x in self.lines)
            and all(g.polygon_covered_by(p, mp) for p in self.polygons)
        )

    def intersects(self, mp: g.MultiPolygon) -> bool:
        return (
            any(g.point_covered_by(p, mp) for p in self.points)
            or any(g.line_intersects(x, mp) for x in self.lines)
            or any(g.multi_intersects([p], mp) for p in self.polygons)
        )

    def nearly_covered_by(self, mp: g.MultiPolygon) -> bool:
        """Covered, but for polygons that stick out by less than the tolerance."""
        if not all(g.point_covered_by(p, mp) for p in self.points) or not all(g.line_covered_by(x, mp) for x in self.lines):
            return False
        for p in self.polygons:
            if not g.polygon_covered_by(p, mp):
                share = g.area(g.overlay([p], mp, "difference")) / (g.area([p]) or math.inf)
                if not 0 < share < TOLERANCE:
                    return False
        return True


def decide(b: Boundary, f: "Feature | Spots | None", kind: str = "way", tolerant: bool = False, touching_counts: bool = False, inside_box: bool = True, within_only: bool = False) -> tuple[str, str]:
    """(``within``, ``intersects`` or ``none``; ``early accept``, ``early reject`` or ``regular``).

    ``touching_counts``: a way that meets the under-estimate is within (the golden profile).
    ``inside_box``: whether the boundary's box holds the feature's; if not, it can't be within.
    ``within_only``: whether it intersects isn't asked for.
    """
    if f is None:
        return "none", "early reject"
    if not inside_box and not tolerant and not touching_counts:
        return ("intersects" if f.intersects(b.exact) else "none"), "early reject"
    if b.under and (f.intersects(b.under) if touching_counts and kind == "way" else f.covered_by(b.under)):
        return "within", "early accept"
    reject = bool(b.over) and not f.covered_by(b.over)
    if reject and not tolerant:
        return ("intersects" if not within_only and f.intersects(b.over) and f.intersects(b.exact) else "none"), "early reject"
    if f.covered_by(b.exact) or (tolerant and f.nearly_covered_by(b.exact)):
        return "within", "regular"
    return ("intersects" if not within_only and f.intersects(b.exact) else "none"), "regular"


class Spots:
    """A feature of points only, whose places in the shapes of a boundary are known."""

    def __init__(self, places: dict[int, tuple[int, int]]):
        self._places = places  # of each shape, by its identity: the lowest and the highest place of a point

    def covered_by(self, mp: g.MultiPolygon) -> bool:
        return self._places[id(mp)][0] >= 0

    def intersects(self, mp: g.MultiPolygon) -> bool:
        return self._places[id(mp)][1] >= 0

    nearly_covered_by = covered_by


def spots(b: Boundary, points: pa.ListArray) -> list[Spots | None]:
    """The features of points only, tested against a boundary's shapes all at once."""
    flat = points.flatten()
    xy = np.column_stack([flat.field("lon").to_numpy(), flat.field("lat").to_numpy()])
    starts = points.offsets.to_numpy()[:-1] - points.offsets[0].as_py()
    seen = np.ones(len(xy), dtype=bool)
    if b.project is not None:
        xy, seen = b.project.flat(xy)
    seen = np.minimum.reduceat(seen, starts)
    ranges = {}
    for mp in (b.exact, b.over, b.under):
        at = g.places_in(xy.tolist(), mp) if mp else np.full(len(xy), -1, dtype=np.int8)
        ranges[id(mp)] = (np.minimum.reduceat(at, starts).tolist(), np.maximum.reduceat(at, starts).tolist())
    return [Spots({k: (low[i], high[i]) for k, (low, high) in ranges.items()}) if seen[i] else None for i in range(len(points))]


_REFINED = "fid string, bid long, decision string, path string"
_SHAPES = ("exact", "over", "under")
_GEOMETRY = ("points", "lines", "polygons")


def relate(features: DataFrame, boundaries: DataFrame, sphere: bool = True, touching_counts: bool = False, within_only: bool = False, part_pairs: int = PART_PAIRS) -> DataFrame:
    """``fid, bid, decision, path`` of each candidate pair that isn't the feature itself.

    ``features`` as ``FEATURES``: ``self`` is the boundary id that the feature is (else null). In the
    plane a feature whose box isn't inside the boundary's is never within, so with ``within_only``
    such pairs don't leave the JVM; on the sphere edges bulge out of boxes and each pair is tested.
    """
    prepare(features.sparkSession)
    boxed = feature_boxes(features).select("fid", "xmin", "ymin", "xmax", "ymax")
    if sphere:  # great-circle edges of this width rise by less than that above their ends
        rise = F.least(F.lit(90.0), F.lit(0.0025) * F.pow(F.col("xmax") - F.col("xmin"), F.lit(2.0)))
        boxed = boxed.withColumn("ymin", F.col("ymin") - rise).withColumn("ymax", F.col("ymax") + rise)
    pairs = candidates(boxed, boundaries, sphere)
    if within_only and not sphere:
        pairs = pairs.where("inside_box")
    pairs = materialise(pairs, "pairs", "snappy")  # ids only
    loads = pairs.groupBy("bid").agg(F.ceil(F.count(F.lit(1)) / part_pairs).cast("int").alias("parts"))
    known = boundaries.select(F.col("id").alias("self"), F.lit(True).alias("is_boundary"))
    told = features.join(known, "self", "left").select("fid", "self", "kind", *_GEOMETRY, F.coalesce("is_boundary", F.lit(False)).alias("is_boundary"))
    dealt = pairs.join(loads, "bid").withColumn("part", F.pmod(F.xxhash64("fid"), F.col("parts")).cast("int")).drop("parts")
    asked = dealt.join(told, "fid").where("self is null or self <> bid").drop("self")
    shapes = boundaries.select(F.col("id").alias("bid"), *_SHAPES).join(loads, "bid").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    stream = shapes.withColumn("turn", F.lit(0)).unionByName(asked.withColumn("turn", F.lit(1)), allowMissingColumns=True)

    def refine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ready = None, None
        for batch in batches:
            part = list(zip(batch.column("bid").to_pylist(), batch.column("part").to_pylist(), batch.column("turn").to_pylist()))
            borders = [0, *(i for i in range(1, len(part)) if part[i] != part[i - 1]), len(part)]
            for a, b in zip(borders, borders[1:]):
                rows = batch.slice(a, b - a)
                if not part[a][2]:
                    now, ready = part[a][:2], Boundary(*([polygon_in(p) for p in rows.column(c)[0].as_py()] for c in _SHAPES), sphere)
                    continue
                if part[a][:2] != now:
                    raise ValueError("a boundary's shape comes before its features")
                out = _decided(ready, rows, touching_counts, within_only)
                yield pa.RecordBatch.from_arrays([rows.column("fid"), rows.column("bid"), pa.array([d for d, _ in out], pa.string()), pa.array([p for _, p in out], pa.string())], names=["fid", "bid", "decision", "path"])

    columns = ["bid", "part", "turn", "fid", "kind", "is_boundary", "inside_box", *_GEOMETRY, *_SHAPES]
    ordered = stream.select(*columns).repartition("bid", "part").sortWithinPartitions("bid", "part", "turn")
    return ordered.mapInArrow(refine, _REFINED)


def _decided(b: Boundary, rows: pa.RecordBatch, touching_counts: bool, within_only: bool) -> list[tuple[str, str]]:
    """The decisions on a batch of features of one boundary."""
    points, lines, polygons = (rows.column(c) for c in _GEOMETRY)
    only_points = ((pc.list_value_length(lines).to_numpy() + pc.list_value_length(polygons).to_numpy()) == 0) & (pc.list_value_length(points).to_numpy() > 0)
    shapes: list[Feature | Spots | None] = [None] * rows.num_rows
    if only_points.any():
        for i, shape in zip(np.flatnonzero(only_points).tolist(), spots(b, points.filter(pa.array(only_points)))):
            shapes[i] = shape
    for i in np.flatnonzero(~only_points).tolist():
        shapes[i] = b.shape(ring_in(points[i].as_py()), [ring_in(x) for x in lines[i].as_py()], [polygon_in(p) for p in polygons[i].as_py()])
    told = zip(shapes, *(rows.column(c).to_pylist() for c in ("kind", "is_boundary", "inside_box")))
    return [decide(b, shape, kind, tolerant, touching_counts, inside, within_only) for shape, kind, tolerant, inside in told]


def containment(boundaries: DataFrame, sphere: bool = True) -> DataFrame:
    """``child, parent``: every boundary and each larger one that covers it.

    Equal areas don't contain each other. It is the whole closure, not its reduction.
    """
    as_features = boundaries.select(
        F.col("id").cast("string").alias("fid"), F.col("id").alias("self"), F.lit("relation").alias("kind"),
        F.expr(f"CAST(array() AS ARRAY<{model.POINT}>)").alias("points"), F.expr(f"CAST(array() AS ARRAY<{model.RING}>)").alias("lines"), F.col("exact").alias("polygons"),
    )
    told = relate(as_features.withColumn("self", F.col("self")), boundaries, sphere).where("decision = 'within'").select(F.col("fid").cast("long").alias("child"), F.col("bid").alias("parent"))
    areas = boundaries.select("id", "area")
    told = told.join(areas.select(F.col("id").alias("child"), F.col("area").alias("a")), "child").join(areas.select(F.col("id").alias("parent"), F.col("area").alias("b")), "parent")
    return told.where("a < b").select("child", "parent")


def with_containers(related: DataFrame, closure: DataFrame) -> DataFrame:
    """Adds to accepted pairs the containers of their boundary; each pair once, the strongest decision."""
    more = related.where("decision = 'within'").join(closure, F.col("bid") == F.col("child")).select("fid", F.col("parent").alias("bid"), "decision", F.lit("container").alias("path"))
    both = related.unionByName(more).withColumn("rank", F.when(F.col("decision") == "within", 0).when(F.col("decision") == "intersects", 1).otherwise(2))
    best = both.groupBy("fid", "bid").agg(F.min(F.struct("rank", "decision", "path")).alias("b"))
    return best.select("fid", "bid", "b.decision", "b.path")


def relation_triples(related: DataFrame) -> DataFrame:
    """``s, p, o``: four triples of a pair within, two of one that intersects only."""
    b = F.concat(F.lit("osmrel:"), F.col("bid").cast("string"))
    t = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    f = F.col("fid")
    both = [t(f, model.INTERSECTS, b), t(b, model.INTERSECTS, f)]
    rows = F.when(F.col("decision") == "within", F.array(t(f, model.WITHIN, b), t(b, model.CONTAINS, f), *both)).otherwise(F.array(*both))
    return related.where("decision <> 'none'").select(F.explode(rows).alias("t")).select("t.*")


def decision_counts(related: DataFrame) -> DataFrame:
    """How pairs were decided: ``path, decision, n``."""
    return related.groupBy("path", "decision").agg(F.count(F.lit(1)).alias("n"))


def cached(related: DataFrame) -> DataFrame:
    """Written once, for the several outputs that read it."""
    return materialise(related, "related")
