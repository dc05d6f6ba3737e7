"""Queries of shapes that have holes, crossings and many points, of lines that cross boundaries, of the
sphere, and of the whole conversion of a small extract.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions import columns as c
from cartolith.functions import geometry as g
from cartolith.operators import assemble, spatial, stats, tags
from cartolith.plans import bridge as b
from cartolith.plans import fixture
from cartolith.plans.registry import query
from cartolith.scratch import prepare, scratch_path

S = SparkSession
#: Tasks for each core where rows are long work.
TASKS_A_CORE = 4
_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def each(df: DataFrame, f: Callable[[dict], dict], schema: str) -> DataFrame:
    """The geometry kernels on each row, in Arrow batches."""
    names = [x.split()[0] for x in schema.split(", ")]

    def rows(batch: pa.RecordBatch) -> dict[str, list]:
        made = [f(r) for r in batch.to_pylist()]
        return {n: [r[n] for r in made] for n in names}

    return together(df, rows, schema)


def together(df: DataFrame, f: Callable[[pa.RecordBatch], dict], schema: str) -> DataFrame:
    """The geometry kernels on all rows of an Arrow batch at once; ``f`` gives its columns.

    A row takes far more time than its bytes tell, so rows are dealt to all cores: a small table is one
    file, and adaptive execution makes few partitions of short rows.
    """
    prepare(df.sparkSession)
    df = df.repartition(TASKS_A_CORE * df.sparkSession.sparkContext.defaultParallelism)
    fields = pa.schema([(n, _ARROW[t]) for n, t in (x.split() for x in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict(f(batch), schema=fields)

    return df.mapInArrow(run, schema)


def none_of(kind: str) -> Column:
    return F.expr(f"CAST(array() AS ARRAY<{kind}>)")


def on_circle(x: Column, y: Column, radius: Column, n: Column, i: Column) -> Column:
    """Point ``i`` of ``n`` about a centre; counted on, the first one comes again."""
    turn = (i % n).cast("double") / n * F.lit(2.0) * F.pi()
    return F.struct((x + radius * F.cos(turn)).alias("lon"), (y + radius * F.sin(turn)).alias("lat"))


def circle(x: Column, y: Column, radius: Column, n: Column) -> Column:
    """A closed ring of ``n`` points about a centre."""
    return F.transform(F.sequence(F.lit(0), n), lambda i: on_circle(x, y, radius, n, i))


def round_parts(spark: S, d: str) -> DataFrame:
    """Each nation a circle of 40 points and more, in two ways, with a hole of half its radius."""
    n = (F.lit(40) + F.lit(8) * F.col("n_nationkey")).cast("int")
    x = b.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("rel_id"), (F.lit(-100.0) + 8 * F.col("n_nationkey")).alias("x"), F.lit(10.0).alias("y"), n.alias("n"))
    ring = circle(F.col("x"), F.col("y"), F.lit(2.0), F.col("n"))
    half = (F.col("n") / 2).cast("int")
    outers = F.array(F.slice(ring, 1, half + 1), F.reverse(F.slice(ring, half + 1, F.col("n") - half + 1)))
    return x.select("rel_id", "n", outers.alias("outers"), F.array(circle(F.col("x"), F.col("y"), F.lit(1.0), F.lit(12))).alias("inners"))


# ---------------------------------------------------------------- assembly


@query("a24_size_guard", "SELECT (1000 + r_regionkey)::BIGINT AS id, (2999 + r_regionkey)::INTEGER AS points FROM region WHERE 2998 + r_regionkey <= 3000")
def a24_size_guard(spark: S, d: str) -> DataFrame:
    """Boundaries of some 3,000 ways of two points; those of more than 3,000 are left out."""
    n = (F.lit(2998) + F.col("r_regionkey")).cast("int")
    at = lambda i: on_circle(F.lit(20.0), F.lit(10.0), F.lit(2.0), n, i)
    outers = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.array(at(i), at(i + 1)))
    parts = b.table(spark, d, "region").select((F.lit(1000) + F.col("r_regionkey")).cast("long").alias("rel_id"), outers.alias("outers"), none_of(model.RING).alias("inners"))
    return assemble.boundaries(parts, assemble.MOST_OUTERS).select("id", F.size(F.col("exact")[0]["outer"]).alias("points"))


@query("a25_drop_empty", "SELECT (1000 + n_nationkey % 5)::BIGINT AS id, count(*) FILTER (WHERE n_nationkey % 2 = 0)::INTEGER AS kept FROM nation GROUP BY ALL")
def a25_drop_empty(spark: S, d: str) -> DataFrame:
    """Rings without points go; the others of a relation are its polygons."""
    ring = c.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    kept = F.when(F.col("id") % 2 == 0, ring).otherwise(none_of(model.POINT))
    rows = b.boxes(spark, d).where("id < 1000").groupBy((F.lit(1000) + F.col("id") % 5).alias("rel_id")).agg(F.collect_list(kept).alias("outers"))
    made = assemble.relation_geometries(rows.select("rel_id", F.lit(True).alias("has_tag"), none_of(model.POINT).alias("points"), "outers", none_of(model.RING).alias("inners")))
    return made.select("id", F.size("polygons").alias("kept"))


@query("a60_ordinals", b.sql("-- select\nSELECT way_id, ord::INTEGER AS ord, ref FROM way_refs"))
def a60_ordinals(spark: S, d: str) -> DataFrame:
    """Places of references in their ways, from the ways' arrays."""
    packed = b.way_refs(spark, d).groupBy(F.col("way_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    return tags.way_refs(packed.withColumn("tags", none_of(model.TAG))).select("way_id", "ord", "ref")


@query("a07_only_statistics", b.sql("""-- select
SELECT ((SELECT count(*) FROM nodes) * 4 + (SELECT count(*) FROM ways) * 3 + (SELECT sum(1 + admin::INTEGER + has_level::INTEGER + has_name::INTEGER) FROM rels))::BIGINT AS tag_lines,
  (SELECT count(DISTINCT way_id) FROM way_coords)::BIGINT AS way_shapes"""))
def a07_only_statistics(spark: S, d: str) -> DataFrame:
    """Counts what a conversion would write, and writes nothing to a target."""
    from cartolith.plans.convert import Conversion, Extract

    refs = b.way_refs(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    ways = b.ways(spark, d).join(refs, F.col("id") == F.col("way_id"), "left").select("id", F.coalesce("refs", F.expr("CAST(array() AS ARRAY<BIGINT>)")).alias("refs"), "tags")
    made = Conversion(Extract(b.nodes(spark, d), ways, b.relations(spark, d)))
    return made.tag_lines().agg(F.count(F.lit(1)).alias("tag_lines")).join(F.broadcast(made.way_points().agg(F.count(F.lit(1)).alias("way_shapes"))))  # one row


@query("g22_boundary_holes", "SELECT n_nationkey::BIGINT AS id, (41 + 8 * n_nationkey)::INTEGER AS outer_points, 1::INTEGER AS holes, 13::INTEGER AS hole_points, true AS under_inside, true AS over_outside FROM nation")
def g22_boundary_holes(spark: S, d: str) -> DataFrame:
    """Boundaries of two ways and a hole: the estimates lie inside and outside of what is left."""

    def test(r: dict) -> dict:
        exact, over, under = ([assemble.polygon_in(p) for p in r[k]] for k in ("exact", "over", "under"))
        ((outer, holes),) = exact
        inside = not under or g.multi_covered_by(under, exact)
        return {"id": r["id"], "outer_points": len(outer), "holes": len(holes), "hole_points": len(holes[0]), "under_inside": inside, "over_outside": g.polygon_covered_by((outer, []), over)}

    return each(assemble.boundaries(round_parts(spark, d)), test, "id long, outer_points int, holes int, hole_points int, under_inside boolean, over_outside boolean")


@query("g28_boundary_table", "SELECT n_nationkey::BIGINT AS id, (-102.0 + 8 * n_nationkey)::DOUBLE AS xmin, 8.0::DOUBLE AS ymin, (-98.0 + 8 * n_nationkey)::DOUBLE AS xmax, 12.0::DOUBLE AS ymax, 1::INTEGER AS polygons, true AS smaller FROM nation")
def g28_boundary_table(spark: S, d: str) -> DataFrame:
    """The boundary table of circles with holes: the box, and an area below that of the box less the hole."""
    t = assemble.boundaries(round_parts(spark, d))
    box = [F.round(x, 6).alias(x) for x in ("xmin", "ymin", "xmax", "ymax")]
    square = c.spherical_area(c.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")), model.EARTH_RADIUS)
    return t.select("id", *box, F.size("exact").alias("polygons"), ((F.col("area") < square) & (F.col("area") > square / 2)).alias("smaller"))


@query("a54_simplification_stats", "SELECT count(*)::BIGINT AS boundaries, count(*)::BIGINT AS over_n, sum(41 + 8 * n_nationkey + 13)::BIGINT AS points, true AS fewer FROM nation")
def a54_simplification_stats(spark: S, d: str) -> DataFrame:
    """Statistics of boundaries that have estimates; no estimate has more points than its shape."""
    s = stats.simplification_stats(assemble.boundaries(round_parts(spark, d)))
    fewer = (F.col("over_ratio_sum") <= F.col("over_n")) & (F.coalesce("under_ratio_sum", F.lit(0.0)) <= F.col("under_n"))
    return s.select("boundaries", "over_n", "points", fewer.alias("fewer"))


# ---------------------------------------------------------------- kernels

_L = [(0.0, 0.0), (10.0, 0.0), (10.0, 5.0), (5.0, 5.0), (5.0, 10.0), (0.0, 10.0), (0.0, 0.0)]
_BOXES = "SELECT p_partkey AS id, (p_partkey % 13 - 1)::DOUBLE AS x0, (p_partkey % 11 - 1)::DOUBLE AS y0, (p_partkey % 13 + p_partkey % 7)::DOUBLE AS x1, (p_partkey % 11 + p_partkey % 3)::DOUBLE AS y1 FROM part"


@query("g14_relations_of_shapes", f"""WITH s AS ({_BOXES}),
f AS (SELECT *, x1 > 10 OR y1 > 10 OR (x1 > 5 AND y1 > 5) AS out, x0 > 10 OR y0 > 10 OR x1 < 0 OR y1 < 0 OR (x0 > 5 AND y0 > 5) AS apart FROM s)
SELECT id, x0 > 0 AND y0 > 0 AND x1 < 10 AND y1 < 10 AND NOT out AS within, x0 >= 0 AND y0 >= 0 AND NOT out AS covered, NOT apart AS meets, apart AS disjoint,
  y0 >= 0 AND y0 <= 10 AND x1 >= 0 AND x0 <= CASE WHEN y0 <= 5 THEN 10 ELSE 5 END AS line_meets,
  y0 >= 0 AND y0 <= 10 AND x0 >= 0 AND x1 <= CASE WHEN y0 <= 5 THEN 10 ELSE 5 END AS line_covered FROM f""")
def g14_relations_of_shapes(spark: S, d: str) -> DataFrame:
    """Boxes, and their lower sides as lines, against a shape that isn't convex."""

    def test(r: dict) -> dict:
        x0, y0, x1, y1 = r["x0"], r["y0"], r["x1"], r["y1"]
        box, shape, line = g.box_polygon((x0, y0, x1, y1)), [(_L, [])], [(x0, y0), (x1, y0)]
        return {
            "id": r["id"], "within": g.ring_within(box[0], _L), "covered": g.polygon_covered_by(box, shape), "meets": g.multi_intersects([box], shape),
            "disjoint": g.disjoint([box], shape), "line_meets": g.line_intersects(line, shape), "line_covered": g.line_covered_by(line, shape),
        }

    k = F.col("p_partkey")
    rows = b.table(spark, d, "part").select(k.cast("long").alias("id"), *[x.cast("double").alias(n) for n, x in (("x0", k % 13 - 1), ("y0", k % 11 - 1), ("x1", k % 13 + k % 7), ("y1", k % 11 + k % 3))])
    return each(rows, test, "id long, within boolean, covered boolean, meets boolean, disjoint boolean, line_meets boolean, line_covered boolean")


@query("g17_validity", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 2) AS valid, (CASE p_partkey % 4 WHEN 1 THEN 0 ELSE 1 END)::INTEGER AS simple_outers FROM part")
def g17_validity(spark: S, d: str) -> DataFrame:
    """Boxes, bow ties, boxes with a hole inside, and with a hole outside."""

    def test(r: dict) -> dict:
        k = r["id"] % 4
        x, y = float(r["id"] % 100), float(r["id"] % 37)
        at = lambda pts: [(x + a, y + b_) for a, b_ in pts]
        outer = at([(0, 0), (4, 4), (4, 0), (0, 4), (0, 0)] if k == 1 else [(0, 0), (4, 0), (4, 4), (0, 4), (0, 0)])
        holes = [] if k < 2 else [at([(1 + 9 * (k == 3), 1), (2 + 9 * (k == 3), 1), (2 + 9 * (k == 3), 2), (1 + 9 * (k == 3), 1)])]
        _, _, kept = g.kept_valid([], [], [(outer, [])])
        return {"id": r["id"], "valid": g.is_valid([(outer, holes)]), "simple_outers": len(kept)}

    return each(b.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")), test, "id long, valid boolean, simple_outers int")


@query("g24_estimates", "SELECT o_custkey AS id, 11 + o_custkey % 100 >= 30 AS simplified, true AS under_inside, true AS over_outside, true AS no_more_points FROM (SELECT DISTINCT o_custkey FROM orders)")
def g24_estimates(spark: S, d: str) -> DataFrame:
    """Wavy rings of 11 points and more; below 30 the estimate is the box alone."""
    import math

    def test(r: dict) -> dict:
        k, n = r["id"], 10 + r["id"] % 100
        at = lambda t: 1 + 0.01 * math.sin(5 * t + k)
        ring = [(10 + at(t) * math.cos(t), 10 + at(t) * math.sin(t)) for t in (2 * math.pi * i / n for i in range(n))]
        ring.append(ring[0])
        exact, under, over = [g.correct((ring, []))], g.under_estimate(ring), g.over_estimate(ring)
        box = [g.box_polygon(g.envelope(ring))]
        return {
            "id": k, "simplified": over != box, "under_inside": not under or g.multi_covered_by(under, exact), "over_outside": g.multi_covered_by(exact, over),
            "no_more_points": g.num_points(over) <= max(5, len(ring)) and g.num_points(under) <= len(ring),
        }

    rows = b.table(spark, d, "orders").select(F.col("o_custkey").cast("long").alias("id")).distinct()
    return each(rows, test, "id long, simplified boolean, under_inside boolean, over_outside boolean, no_more_points boolean")


@query("g26_loops", "SELECT p_partkey AS id, false AS simple_before, true AS simple_after, true AS most_left FROM part")
def g26_loops(spark: S, d: str) -> DataFrame:
    """Rings with loops, one or two of them overlapping, that are cut out."""

    def test(batch: pa.RecordBatch) -> dict:
        k = batch.column("id").to_numpy()
        n = 24 + k % 40
        starts = np.concatenate([[0], np.cumsum(n + 1)])
        first = np.repeat(starts[:-1], n + 1)
        turn = 2 * np.pi * (np.arange(starts[-1]) - first) / np.repeat(n, n + 1)
        ring = np.column_stack([np.cos(turn), np.sin(turn)])
        for at in (starts[:-1] + 3 + k % 5, (starts[:-1] + 12 + k % 9)[k % 2 == 1]):
            ring[at], ring[at + 1] = ring[at + 1], ring[at]
        ring[starts[1:] - 1] = ring[starts[:-1]]
        fixed = g.all_without_crossings((ring, starts))
        return {"id": k, "simple_before": g.are_simple((ring, starts)), "simple_after": g.are_simple(fixed), "most_left": np.diff(fixed[1]) >= n // 2}

    return together(b.table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id")), test, "id long, simple_before boolean, simple_after boolean, most_left boolean")


@query("g04_read_wkt", b.sql("-- select\nSELECT way_id, count(*)::INTEGER AS points, round(sum(lon), 5) + 0.0 AS lon, round(sum(lat), 5) + 0.0 AS lat FROM way_coords GROUP BY way_id"))
def g04_read_wkt(spark: S, d: str) -> DataFrame:
    """The written geometry of ways, read back."""
    from cartolith.operators import resolve

    p = resolve.way_points(resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d)))
    ring = p.select("way_id", c.read_wkt(c.way_wkt(F.col("points")))[0].alias("r"))
    total = lambda k: (F.round(F.aggregate("r", F.lit(0.0), lambda s, q: s + q[k]), 5) + F.lit(0.0)).alias(k)
    return ring.select("way_id", F.size("r").alias("points"), total("lon"), total("lat"))


# ---------------------------------------------------------------- relations to boundaries


def _features(rows: DataFrame, kind: str, lines: Column | None = None, polygons: Column | None = None, points: Column | None = None) -> DataFrame:
    return rows.select(
        F.col("id").cast("string").alias("fid"), F.lit(None).cast("long").alias("self"), F.lit(kind).alias("kind"),
        (points if points is not None else none_of(model.POINT)).alias("points"), (lines if lines is not None else none_of(model.RING)).alias("lines"),
        (polygons if polygons is not None else none_of(model.POLYGON)).alias("polygons"),
    )


_DECIDED = "CASE WHEN {x0} >= xmin AND {x1} <= xmax AND {y0} >= ymin AND {y1} <= ymax THEN 'within' ELSE 'intersects' END AS decision"


@query("g15_lines_cross", b.sql(f"""-- select
SELECT nodes.id AS nid, boxes.id AS bid, {_DECIDED.format(x0='lon', x1='lon + 20', y0='lat', y1='lat')}
FROM nodes JOIN boxes ON lon <= xmax AND lon + 20 >= xmin AND lat <= ymax AND lat >= ymin"""))
def g15_lines_cross(spark: S, d: str) -> DataFrame:
    """Lines of 20 degrees to the east: within a boundary, or across its border."""
    line = F.array(F.array(F.struct("lon", "lat"), F.struct((F.col("lon") + 20).alias("lon"), "lat")))
    r = spatial.relate(_features(b.nodes(spark, d), "way", lines=line), b.boundaries(spark, d), sphere=False)
    return r.where("decision <> 'none'").select(F.col("fid").cast("long").alias("nid"), "bid", "decision")


@query("g31_closed_ways", b.sql(f"""-- select
SELECT nodes.id AS nid, boxes.id AS bid, {_DECIDED.format(x0='lon', x1='lon + 3', y0='lat', y1='lat + 2')}
FROM nodes JOIN boxes ON lon <= xmax AND lon + 3 >= xmin AND lat <= ymax AND lat + 2 >= ymin"""))
def g31_closed_ways(spark: S, d: str) -> DataFrame:
    """Closed ways are polygons: within a boundary, or across its border."""
    ring = c.box_ring(F.col("lon"), F.col("lat"), F.col("lon") + 3, F.col("lat") + 2)
    polygons = F.array(F.struct(ring.alias("outer"), none_of(model.RING).alias("inners")))
    r = spatial.relate(_features(b.nodes(spark, d), "way", polygons=polygons), b.boundaries(spark, d), sphere=False)
    return r.where("decision <> 'none'").select(F.col("fid").cast("long").alias("nid"), "bid", "decision")


def _sphere_boxes(spark: S, d: str) -> DataFrame:
    ring = c.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    return assemble.boundaries(b.boxes(spark, d).select(F.col("id").alias("rel_id"), F.array(ring).alias("outers"), none_of(model.RING).alias("inners")))


#: A great circle between two points of one latitude rises above it by the cosine of the longitude from its middle.
_ON_SPHERE = """tan(radians(lat)) * cos(radians(36)) <= tan(radians(ymax)) * cos(radians(lon - xmin - 36)) + 1e-9
  AND tan(radians(lat)) * cos(radians(36)) >= tan(radians(ymin)) * cos(radians(lon - xmin - 36)) - 1e-9"""


@query("g30_points_on_the_sphere", b.sql(f"-- select\nSELECT nodes.id AS nid, boxes.id AS bid FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND {_ON_SPHERE}"))
def g30_points_on_the_sphere(spark: S, d: str) -> DataFrame:
    """Nodes within boundaries whose edges are great circles."""
    r = spatial.relate(_features(b.nodes(spark, d), "node", points=F.array(F.struct("lon", "lat"))), _sphere_boxes(spark, d))
    return r.where("decision = 'within'").select(F.col("fid").cast("long").alias("nid"), "bid")


@query("g30_lines_on_the_sphere", b.sql(f"""ends AS (
  SELECT nodes.id AS nid, boxes.id AS bid, lon BETWEEN xmin AND xmax AND {_ON_SPHERE} AS a, lon BETWEEN xmin AND xmax AND {_ON_SPHERE.replace('lat', '(lat / 2)')} AS z FROM nodes, boxes WHERE lat <> 0)
-- select
SELECT nid, bid, CASE WHEN a AND z THEN 'within' ELSE 'intersects' END AS decision FROM ends WHERE a OR z"""))
def g30_lines_on_the_sphere(spark: S, d: str) -> DataFrame:
    """Lines along a meridian, from each node half way to the equator, that end in a boundary.

    The boundaries are convex on the sphere, so a line is within when both ends are.
    """
    line = F.array(F.array(F.struct("lon", "lat"), F.struct("lon", (F.col("lat") / 2).alias("lat"))))
    r = spatial.relate(_features(b.nodes(spark, d).where("lat <> 0"), "way", lines=line), _sphere_boxes(spark, d))
    return r.where("decision <> 'none'").select(F.col("fid").cast("long").alias("nid"), "bid", "decision")


# ---------------------------------------------------------------- the whole conversion


def _literal(line: str) -> str:
    return "('" + line.replace("'", "''") + "')"


@query("a03_golden_conversion", "SELECT * FROM (VALUES " + ", ".join(map(_literal, fixture.GOLDEN_LINES)) + ") t(line)")
def a03_golden_conversion(spark: S, d: str) -> DataFrame:
    """A small extract, read from XML and converted as a whole: clusters, ways, relations and their boundaries."""
    from cartolith.plans.convert import Conversion, read

    path = scratch_path(spark, "extract.osm")
    spark.createDataFrame([(fixture.to_xml(fixture.ENRICHED),)], "xml string").coalesce(1).write.text(path)
    return Conversion(read(spark, path), "golden").lines(with_tags=False)
