"""Queries of the map operators over the bridged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions import columns as g
from cartolith.functions import text as t
from cartolith.operators import assemble, cluster, graph, resolve, spatial, stats, tags
from cartolith.plans import bridge as b
from cartolith.plans.registry import query
from cartolith.scratch import global_index, materialise

S = SparkSession


# ---------------------------------------------------------------- sources, sinks, records


@query("a01_scan_all", "SELECT (SELECT count(*) FROM part)::BIGINT AS nodes, (SELECT count(*) FROM orders)::BIGINT AS ways, (SELECT count(*) FROM customer)::BIGINT AS relations, (SELECT max(o_orderkey) FROM orders)::BIGINT AS max_way_id")
def a01_scan_all(spark: S, d: str) -> DataFrame:
    return stats.entity_counts(b.nodes(spark, d), b.ways(spark, d), b.relations(spark, d))


@query("a02_scan_relations", b.sql("-- select\nSELECT id, kind FROM rels"))
def a02_scan_relations(spark: S, d: str) -> DataFrame:
    return b.relations(spark, d).select("id", tags.tag_value("type").alias("kind"))


@query("a04_turtle_sink", "SELECT count(*)::BIGINT AS lines, sum(length('osmway:' || o_orderkey || ' osmt:status \"' || o_orderstatus || '\" .'))::BIGINT AS chars FROM orders")
def a04_turtle_sink(spark: S, d: str) -> DataFrame:
    """Writes bzip2 Turtle and reads it back."""
    from cartolith.scratch import scratch_path
    from cartolith.sources import turtle

    rows = b.ways(spark, d).select("id", F.filter("tags", lambda x: x["k"] == "status").alias("tags"))
    path = scratch_path(spark, "turtle")
    turtle.write(turtle.lines(tags.tag_triples(rows, "osmway:")), path)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("value")).alias("chars"))


@query("a05_turtle_append", "SELECT (2 * count(*))::BIGINT AS lines FROM region")
def a05_turtle_append(spark: S, d: str) -> DataFrame:
    from cartolith.scratch import scratch_path
    from cartolith.sources import turtle

    path = scratch_path(spark, "turtle")
    rows = b.table(spark, d, "region").select(F.col("r_name").alias("line"))
    turtle.write(rows, path)
    turtle.write(rows, path, append=True)
    return spark.read.text(path).agg(F.count(F.lit(1)).alias("lines"))


_PREFIXES = " UNION ALL ".join(f"SELECT {i}::INTEGER AS ord, '@prefix {n} <{iri}> .' AS line" for i, (n, iri) in enumerate(model.PREFIXES))


@query("a06_prefixes", _PREFIXES)
def a06_prefixes(spark: S, d: str) -> DataFrame:
    from cartolith.sources import turtle

    return turtle.prefixes(spark)



@query("a08_node_points", b.sql("""-- select
SELECT 'osmnode:' || id AS s, 'geo:hasGeometry' AS p, '"POINT(' || printf('%.6f', lon) || ' ' || printf('%.6f', lat) || ')"^^geo:wktLiteral' AS o FROM nodes"""))
def a08_node_points(spark: S, d: str) -> DataFrame:
    return tags.node_point_triples(b.nodes(spark, d))


@query("a09_load_records", b.sql("-- select\nSELECT way_id, ord, ref FROM way_refs"))
def a09_load_records(spark: S, d: str) -> DataFrame:
    """Ways with reference arrays, exploded to records again."""
    packed = b.way_refs(spark, d).groupBy("way_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "ref"))), lambda x: x["ref"]).alias("refs"))
    return packed.select("way_id", F.posexplode("refs").alias("ord", "ref")).withColumn("ord", F.col("ord").cast("long"))


# ---------------------------------------------------------------- predicates and projections


@query("a11_has_tag", b.sql("-- select\nSELECT id FROM rels WHERE kind = 'boundary'"))
def a11_has_tag(spark: S, d: str) -> DataFrame:
    return b.relations(spark, d).where(tags.has_tag("type", "boundary")).select("id")


@query("a12_has_key", b.sql("-- select\nSELECT id FROM rels WHERE has_level"))
def a12_has_key(spark: S, d: str) -> DataFrame:
    return b.relations(spark, d).where(tags.has_key("admin_level")).select("id")


@query("a13_administrative_boundaries", b.sql("-- select\nSELECT id FROM rels WHERE kind = 'boundary' AND admin AND has_level AND has_name AND NOT part"))
def a13_administrative_boundaries(spark: S, d: str) -> DataFrame:
    return tags.administrative_boundaries(b.relations(spark, d)).select("id")


@query("a14_boundary_members", b.sql("-- select\nSELECT id AS rel_id, 0::INTEGER AS ord, id AS ref, '2' AS role FROM rels"))
def a14_boundary_members(spark: S, d: str) -> DataFrame:
    return tags.way_members(b.relations(spark, d))


@query("a15_role_codes", "SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '0' ELSE '3' END AS code FROM orders")
def a15_role_codes(spark: S, d: str) -> DataFrame:
    role = F.when(F.col("o_orderstatus") == "F", "outer").when(F.col("o_orderstatus") == "O", "inner").otherwise("")
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), tags.role_code(role).alias("code"))


@query("a16_member_codes", b.sql("""-- select
SELECT id AS rel_id, mtype, role FROM rels, LATERAL (
  SELECT 'w' AS mtype, '2' AS role UNION ALL SELECT 'n', '4' UNION ALL SELECT 'r', '1' WHERE subarea UNION ALL SELECT 'r', '4' WHERE part)"""))
def a16_member_codes(spark: S, d: str) -> DataFrame:
    return tags.relation_members(b.relations(spark, d)).select("rel_id", "mtype", "role")


@query("a17_route_relations", b.sql("-- select\nSELECT id, CASE WHEN kind = 'multipolygon' THEN 'multi' ELSE 'other' END AS route FROM rels WHERE kind = 'multipolygon' OR NOT (subarea OR part)"))
def a17_route_relations(spark: S, d: str) -> DataFrame:
    multi, other = tags.route_relations(b.relations(spark, d))
    return multi.select("id", F.lit("multi").alias("route")).unionByName(other.select("id", F.lit("other").alias("route")))


@query("a18_has_relation_member", b.sql("-- select\nSELECT id, subarea OR part AS nested FROM rels"))
def a18_has_relation_member(spark: S, d: str) -> DataFrame:
    return b.relations(spark, d).select("id", tags.has_relation_member().alias("nested"))


@query("a19_has_any_tag", b.sql("-- select\nSELECT id, has_name AS has_tag FROM rels"))
def a19_has_any_tag(spark: S, d: str) -> DataFrame:
    """Relations of which only the name is kept: not all have one."""
    named = b.relations(spark, d).withColumn("tags", F.filter("tags", lambda x: x["k"] == "name"))
    return named.select("id", tags.has_any_tag().alias("has_tag"))


@query("a20_named_ways", b.sql("-- select\nSELECT id, length(name)::INTEGER AS n FROM ways WHERE name <> ''"))
def a20_named_ways(spark: S, d: str) -> DataFrame:
    return b.ways(spark, d).where(tags.tag_value("name") != "").select("id", F.length("name").alias("n"))


@query("a21_tagged_relations", b.sql("-- select\nSELECT id AS rel_id, (2 + subarea::INTEGER + part::INTEGER)::BIGINT AS n FROM rels WHERE has_name"))
def a21_tagged_relations(spark: S, d: str) -> DataFrame:
    """Members of relations that have a tag, of which only the name is kept."""
    named = b.relations(spark, d).withColumn("tags", F.filter("tags", lambda x: x["k"] == "name"))
    return tags.relation_members(named).where("has_tag").groupBy("rel_id").agg(F.count(F.lit(1)).alias("n"))


def _points(spark: S, d: str) -> DataFrame:
    return resolve.way_points(resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d)))


@query("a22_closed_rings", b.sql("""p AS (SELECT way_id, list([lon, lat] ORDER BY ord) AS pts FROM way_coords GROUP BY way_id)
-- select
SELECT way_id, len(pts) > 3 AND pts[1] = pts[-1] AS ring, len(pts) > 2 AND pts[1] = pts[-1] AS closed_way FROM p"""))
def a22_closed_rings(spark: S, d: str) -> DataFrame:
    """Relations need more than three points, ways more than two."""
    p = F.col("points")
    return _points(spark, d).select("way_id", g.is_closed(p, 3).alias("ring"), g.is_closed(p, 2).alias("closed_way"))




# ---------------------------------------------------------------- joins


@query("a27_resolve_way_nodes", b.sql("-- select\nSELECT way_id, ord, lon, lat FROM way_coords"))
def a27_resolve_way_nodes(spark: S, d: str) -> DataFrame:
    return resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d))


@query("a28_boundary_way_nodes", b.sql("-- select\nSELECT way_id, ord, lon, lat FROM way_coords WHERE way_id IN (SELECT ref FROM members WHERE role > '1')"))
def a28_boundary_way_nodes(spark: S, d: str) -> DataFrame:
    outer = b.members(spark, d).where("role > '1'").select(F.col("ref").alias("way_id"))
    return resolve.way_coordinates(b.way_refs(spark, d).join(outer, "way_id", "left_semi"), b.nodes(spark, d))


@query("a29_resolve_members", b.sql("-- select\nSELECT rel_id, members.ord, way_coords.ord AS suborder, role, lon, lat FROM members JOIN way_coords ON ref = way_id"))
def a29_resolve_members(spark: S, d: str) -> DataFrame:
    """Way members with the points of their ways."""
    c = resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d))
    return resolve.member_ways(b.members(spark, d), c).drop("has_tag")


@query("a30_member_nodes", b.sql("-- select\nSELECT rels.id AS rel_id, lon, lat FROM rels JOIN nodes ON c_nationkey = nodes.id"))
def a30_member_nodes(spark: S, d: str) -> DataFrame:
    """Node members with their points."""
    return resolve.member_nodes(tags.relation_members(b.relations(spark, d)), b.nodes(spark, d)).select("rel_id", "lon", "lat")


@query("a34_semi_ways", b.sql("-- select\nSELECT id FROM ways WHERE id IN (SELECT ref FROM members WHERE role = '2')"))
def a34_semi_ways(spark: S, d: str) -> DataFrame:
    return resolve.used_ways(b.ways(spark, d), b.members(spark, d).where("role = '2'")).select("id")


@query("a35_semi_nodes", b.sql("-- select\nSELECT id FROM nodes WHERE id IN (SELECT ref FROM way_refs)"))
def a35_semi_nodes(spark: S, d: str) -> DataFrame:
    return resolve.used_nodes(b.nodes(spark, d), b.way_refs(spark, d)).select("id")


_CLUSTERS = """pairs AS (SELECT DISTINCT name, ref, way_id FROM named_refs),
edges AS (SELECT p.name, p.ref, p.way_id AS a, q.way_id AS b FROM pairs p JOIN pairs q ON p.name = q.name AND p.ref = q.ref AND p.way_id <> q.way_id),
reach(a, b) AS (SELECT a, a FROM edges UNION SELECT reach.a, edges.b FROM reach JOIN edges ON reach.b = edges.a),
roots AS (SELECT a AS way_id, min(b) AS root FROM reach GROUP BY a),
heads AS (
  SELECT root, edges.name, min(edges.ref) AS least_ref, min(first_way) AS first_way FROM roots
  JOIN edges ON roots.way_id = edges.a JOIN (SELECT name, min(way_id) AS first_way FROM pairs GROUP BY name) f ON edges.name = f.name GROUP BY root, edges.name),
ids AS (SELECT root, name, (SELECT max(id) FROM ways) + row_number() OVER (ORDER BY first_way, least_ref, root) AS cluster_id FROM heads),
clusters AS (SELECT cluster_id, ids.name, way_id FROM roots JOIN ids ON roots.root = ids.root)
"""


def _clusters(spark: S, d: str) -> DataFrame:
    most = b.ways(spark, d).agg(F.max("id").alias("m")).first().m
    return cluster.clusters(b.named_refs(spark, d), most or 0)


@query("a36_cluster_index", b.sql(_CLUSTERS + "-- select\nSELECT ways.id, cluster_id FROM ways JOIN clusters ON ways.id = way_id", True))
def a36_cluster_index(spark: S, d: str) -> DataFrame:
    return b.ways(spark, d).join(_clusters(spark, d).select(F.col("way_id").alias("id"), "cluster_id"), "id").select("id", "cluster_id")


@query("a37_cluster_geometry", b.sql(_CLUSTERS + """, parts AS (
  SELECT way_id, CASE WHEN count(*) > 3 AND list([lon, lat] ORDER BY ord)[1] = list([lon, lat] ORDER BY ord)[-1] THEN 'POLYGON((' ELSE 'LINESTRING(' END AS head,
    string_agg(printf('%.6f %.6f', lon, lat), ',' ORDER BY ord) AS body FROM way_coords GROUP BY way_id)
-- select
SELECT cluster_id, 'GEOMETRYCOLLECTION(' || string_agg(head || body || CASE WHEN head = 'POLYGON((' THEN '))' ELSE ')' END, ',' ORDER BY clusters.way_id) || ')' AS wkt
FROM clusters JOIN parts ON clusters.way_id = parts.way_id GROUP BY cluster_id""", True))
def a37_cluster_geometry(spark: S, d: str) -> DataFrame:
    """A37 and G02."""
    return cluster.cluster_wkt(_clusters(spark, d), _points(spark, d))


_NODE_BOXES = "-- select\nSELECT nodes.id AS nid, boxes.id AS bid FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"


def _node_features(spark: S, d: str) -> DataFrame:
    none = F.expr(f"CAST(array() AS ARRAY<{model.RING}>)")
    return b.nodes(spark, d).select(
        F.col("id").cast("string").alias("fid"), F.lit(None).cast("long").alias("self"), F.lit("node").alias("kind"), F.array(F.struct("lon", "lat")).alias("points"),
        none.alias("lines"), F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)").alias("polygons"),
    )


@query("a38_spatial_join", b.sql("""w AS (SELECT way_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM way_coords GROUP BY way_id)
-- select
SELECT way_id, boxes.id AS bid FROM w JOIN boxes ON x0 <= xmax AND xmin <= x1 AND y0 <= ymax AND ymin <= y1"""))
def a38_spatial_join(spark: S, d: str) -> DataFrame:
    """Box candidates of ways and boundaries, by the leveled grid."""
    boxed = _points(spark, d).select(F.col("way_id").cast("string").alias("fid"), g.bbox(F.col("points")).alias("x")).select("fid", "x.*")
    return spatial.candidates(boxed, b.boxes(spark, d)).select(F.col("fid").cast("long").alias("way_id"), "bid")


@query("a39_boundary_self_join", b.sql("-- select\nSELECT a.id AS child, c.id AS parent FROM boxes a JOIN boxes c ON a.id <> c.id AND c.xmin <= a.xmin AND c.ymin <= a.ymin AND a.xmax <= c.xmax AND a.ymax <= c.ymax"))
def a39_boundary_self_join(spark: S, d: str) -> DataFrame:
    x = materialise(b.boxes(spark, d), "boxes")
    pairs = spatial.candidates(x.withColumn("fid", F.col("id").cast("string")), x).select(F.col("fid").cast("long").alias("child"), F.col("bid").alias("parent"))
    box = ["xmin", "ymin", "xmax", "ymax"]
    child = x.select(F.col("id").alias("child"), *[F.col(c).alias(f"a_{c}") for c in box])
    parent = x.select(F.col("id").alias("parent"), *[F.col(c).alias(f"c_{c}") for c in box])
    both = pairs.join(child, "child").join(parent, "parent").where("child <> parent")
    return both.where("c_xmin <= a_xmin AND c_ymin <= a_ymin AND a_xmax <= c_xmax AND a_ymax <= c_ymax").select("child", "parent")


@query("a40_points_in_boundaries", b.sql(_NODE_BOXES))
def a40_points_in_boundaries(spark: S, d: str) -> DataFrame:
    """Nodes covered by boundaries (planar, as the boxes' edges are parallels)."""
    r = spatial.relate(_node_features(spark, d), b.boundaries(spark, d), sphere=False)
    return r.where("decision = 'within'").select(F.col("fid").cast("long").alias("nid"), "bid")


@query("a41_not_itself", b.sql("-- select\nSELECT a.id AS a, c.id AS b FROM boxes a JOIN boxes c ON a.xmin = c.xmin AND a.id <> c.id"))
def a41_not_itself(spark: S, d: str) -> DataFrame:
    x = b.boxes(spark, d)
    return x.select(F.col("id").alias("a"), "xmin").join(x.select(F.col("id").alias("b"), "xmin"), "xmin").where("a <> b").select("a", "b")


@query("a42_holes", b.sql("-- select\nSELECT count(*)::BIGINT AS assigned FROM boxes WHERE id < 1000"))
def a42_holes(spark: S, d: str) -> DataFrame:
    """Nations shrunk by a degree are holes of their region."""
    x = b.boxes(spark, d)
    ring = lambda m: g.box_ring(F.col("xmin") + m, F.col("ymin") + m, F.col("xmax") - m, F.col("ymax") - m)
    inner = x.where("id < 1000").groupBy((1000 + F.col("id") % 5).alias("rel_id")).agg(F.collect_list(ring(1)).alias("inners"))
    outer = x.where("id >= 1000").select(F.col("id").alias("rel_id"), F.array(ring(0)).alias("outers"))
    parts = outer.join(inner, "rel_id").select("rel_id", F.lit(True).alias("has_tag"), F.expr(f"CAST(array() AS ARRAY<{model.POINT}>)").alias("points"), "outers", "inners")
    return assemble.relation_geometries(parts).agg(F.sum(F.aggregate("polygons", F.lit(0), lambda s, p: s + F.size(p["inners"]))).cast("long").alias("assigned"))


@query("a43_shared_node_edges", b.sql("""pairs AS (SELECT DISTINCT name, ref, way_id FROM named_refs)
-- select
SELECT name, ref, min(way_id) OVER w AS a, way_id AS b FROM pairs WINDOW w AS (PARTITION BY name, ref) QUALIFY way_id > min(way_id) OVER w"""))
def a43_shared_node_edges(spark: S, d: str) -> DataFrame:
    return cluster.star_edges(b.named_refs(spark, d))


# ---------------------------------------------------------------- aggregations


@query("a44_entity_counts", "SELECT (SELECT count(*) FROM part)::BIGINT AS nodes, (SELECT count(*) FROM orders)::BIGINT AS ways, (SELECT count(*) FROM customer)::BIGINT AS relations")
def a44_entity_counts(spark: S, d: str) -> DataFrame:
    return stats.entity_counts(b.nodes(spark, d), b.ways(spark, d), b.relations(spark, d)).drop("max_way_id")


@query("a45_max_way_id", "SELECT greatest(coalesce(max(o_orderkey), 0), 0)::BIGINT AS max_way_id FROM orders")
def a45_max_way_id(spark: S, d: str) -> DataFrame:
    return stats.entity_counts(b.nodes(spark, d), b.ways(spark, d), b.relations(spark, d)).select("max_way_id")


@query("a46_relation_counts", b.sql("""-- select
SELECT count_if(kind = 'boundary')::BIGINT AS boundaries, count_if(kind = 'boundary' AND admin)::BIGINT AS administrative,
  count_if(kind = 'boundary' AND admin AND has_level)::BIGINT AS with_level, count_if(kind = 'boundary' AND admin AND has_level AND has_name)::BIGINT AS with_name,
  count_if(kind = 'multipolygon')::BIGINT AS multipolygons, count_if(subarea OR part)::BIGINT AS nested, count_if(NOT (subarea OR part))::BIGINT AS flat,
  count_if(kind = 'multipolygon' AND (subarea OR part))::BIGINT AS nested_multipolygons, 0::BIGINT AS nested_multipolygon_boundaries FROM rels"""))
def a46_relation_counts(spark: S, d: str) -> DataFrame:
    """A46 and A47 in one pass."""
    return stats.relation_counts(b.relations(spark, d))


@query("a48_way_lines", b.sql("""-- select
SELECT way_id, CASE WHEN count(*) > 2 AND list([lon, lat] ORDER BY ord)[1] = list([lon, lat] ORDER BY ord)[-1]
  THEN 'POLYGON((' || string_agg(printf('%.6f %.6f', lon, lat), ', ' ORDER BY ord) || '))'
  ELSE 'LINESTRING(' || string_agg(printf('%.6f %.6f', lon, lat), ', ' ORDER BY ord) || ')' END AS wkt
FROM way_coords GROUP BY way_id"""))
def a48_way_lines(spark: S, d: str) -> DataFrame:
    """The geometry of every way."""
    return _points(spark, d).select("way_id", g.way_wkt(F.col("points")).alias("wkt"))


@query("a49_relation_parts", b.sql("""per AS (SELECT rel_id, members.ord, role, count(*) AS n FROM members JOIN way_coords ON ref = way_id GROUP BY ALL)
-- select
SELECT rel_id, count(*) FILTER (WHERE role > '1')::INTEGER AS outers, count(*) FILTER (WHERE role = '0')::INTEGER AS inners,
  coalesce(sum(n) FILTER (WHERE role > '1'), 0)::BIGINT AS outer_points FROM per GROUP BY rel_id"""))
def a49_relation_parts(spark: S, d: str) -> DataFrame:
    c = resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d))
    parts = resolve.relation_parts(resolve.member_ways(b.members(spark, d), c).withColumn("mtype", F.lit("w")))
    points = F.aggregate("outers", F.lit(0), lambda s, r: s + F.size(r)).cast("long")
    return parts.select("rel_id", F.size("outers").alias("outers"), F.size("inners").alias("inners"), points.alias("outer_points"))


_SHARED = _CLUSTERS + """, t AS (
  SELECT id AS way_id, k, v FROM (SELECT id, unnest(['name', 'status', 'priority']) AS k, unnest([name, o_orderstatus, o_orderpriority]) AS v FROM ways))
-- select
SELECT cluster_id, k, v FROM clusters JOIN t ON clusters.way_id = t.way_id GROUP BY cluster_id, k, v
HAVING count(DISTINCT t.way_id) = (SELECT count(*) FROM clusters c WHERE c.cluster_id = clusters.cluster_id)"""


@query("a50_shared_tags", b.sql(_SHARED, True))
def a50_shared_tags(spark: S, d: str) -> DataFrame:
    return cluster.shared_tags(_clusters(spark, d), b.ways(spark, d))


@query("a51_cluster_sizes", b.sql(_CLUSTERS + "-- select\nSELECT cluster_id, count(*)::BIGINT AS n_ways FROM clusters GROUP BY cluster_id", True))
def a51_cluster_sizes(spark: S, d: str) -> DataFrame:
    return cluster.cluster_sizes(_clusters(spark, d))


@query("a52_concat", b.sql("-- select\nSELECT way_id, string_agg(ref::VARCHAR, ' ' ORDER BY ord) AS refs FROM way_refs GROUP BY way_id"))
def a52_concat(spark: S, d: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ord", "ref")))
    return b.way_refs(spark, d).groupBy("way_id").agg(F.array_join(F.transform(ordered, lambda x: x["ref"].cast("string")), " ").alias("refs"))


@query("a53_decision_counts", b.sql("-- select\nSELECT 'regular' AS path, 'within' AS decision, count(*)::BIGINT AS n FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"))
def a53_decision_counts(spark: S, d: str) -> DataFrame:
    return spatial.decision_counts(spatial.relate(_node_features(spark, d), b.boundaries(spark, d), sphere=False))



@query("a55_extents", b.sql("-- select\nSELECT way_id, min(lon) AS xmin, min(lat) AS ymin, max(lon) AS xmax, max(lat) AS ymax FROM way_coords GROUP BY way_id"))
def a55_extents(spark: S, d: str) -> DataFrame:
    """The box of each way."""
    return _points(spark, d).select("way_id", g.bbox(F.col("points")).alias("x")).select("way_id", "x.*")


@query("a56_sorted_unique", b.sql("-- select\nSELECT way_id, list_sort(list_distinct(list(ref)))::VARCHAR AS refs FROM way_refs GROUP BY way_id"))
def a56_sorted_unique(spark: S, d: str) -> DataFrame:
    refs = F.array_sort(F.collect_set("ref"))
    return b.way_refs(spark, d).groupBy("way_id").agg(F.concat(F.lit("["), F.array_join(refs.cast("array<string>"), ", "), F.lit("]")).alias("refs"))


@query("a57_written_counts", b.sql("-- select\nSELECT count(DISTINCT rel_id)::BIGINT AS relations FROM members JOIN way_refs ON members.ref = way_id JOIN nodes ON way_refs.ref = nodes.id"))
def a57_written_counts(spark: S, d: str) -> DataFrame:
    c = resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d))
    return resolve.member_ways(b.members(spark, d), c).agg(F.count_distinct("rel_id").alias("relations"))


# ---------------------------------------------------------------- order


@query("a58_adjacent_edges", b.sql("""pairs AS (SELECT DISTINCT name, ref, way_id FROM named_refs),
l AS (SELECT name, ref, lag(way_id) OVER (PARTITION BY name, ref ORDER BY way_id) AS a, way_id AS b FROM pairs)
-- select
SELECT * FROM l WHERE a IS NOT NULL"""))
def a58_adjacent_edges(spark: S, d: str) -> DataFrame:
    return cluster.adjacent_edges(b.named_refs(spark, d))


@query("a59_chunks", b.sql("-- select\nSELECT name, count(*)::BIGINT AS rows, count(DISTINCT way_id)::BIGINT AS ways FROM named_refs GROUP BY name"))
def a59_chunks(spark: S, d: str) -> DataFrame:
    return b.named_refs(spark, d).groupBy("name").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("way_id").alias("ways"))



@query("a61_name_dictionary", b.sql("-- select\nSELECT name, row_number() OVER (ORDER BY min(id)) AS name_id FROM ways GROUP BY name"))
def a61_name_dictionary(spark: S, d: str) -> DataFrame:
    return cluster.name_dictionary(b.ways(spark, d).select("name", F.lit(0).alias("entity"), "id"))


@query("a62_cluster_ids", b.sql(_CLUSTERS + "-- select\nSELECT cluster_id, name, min(way_id) AS first_way FROM clusters GROUP BY cluster_id, name", True))
def a62_cluster_ids(spark: S, d: str) -> DataFrame:
    return _clusters(spark, d).groupBy("cluster_id", "name").agg(F.min("way_id").alias("first_way"))


def _rank_query(name: str, sql: str, rows: object, order: list, keep: list[str]) -> None:
    query(name, b.sql(f"-- select\n{sql}"))(lambda spark, d: global_index(rows(spark, d), order, "rank").select(*keep, "rank"))


_coords = lambda spark, d: resolve.way_coordinates(b.way_refs(spark, d), b.nodes(spark, d))
_rank_query("a63_sort_nodes", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM nodes", b.nodes, ["id"], ["id"])
_rank_query("a64_sort_refs", "SELECT ref, way_id, ord, row_number() OVER (ORDER BY ref, way_id, ord) - 1 AS rank FROM way_refs", b.way_refs, ["ref", "way_id", "ord"], ["ref", "way_id", "ord"])
_rank_query("a65_sort_way_coords", "SELECT way_id, ord, row_number() OVER (ORDER BY way_id, ord) - 1 AS rank FROM way_coords", _coords, ["way_id", "ord"], ["way_id", "ord"])
_rank_query("a66_sort_by_name", "SELECT name, ref, way_id, ord, row_number() OVER (ORDER BY name, ref, way_id, ord) - 1 AS rank FROM named_refs", b.named_refs, ["name", "ref", "way_id", "ord"], ["name", "ref", "way_id", "ord"])
_rank_query("a67_sort_members_by_ref", "SELECT rel_id, ref, row_number() OVER (ORDER BY ref, rel_id) - 1 AS rank FROM members", b.members, ["ref", "rel_id"], ["rel_id", "ref"])
_rank_query("a69_sort_by_area", "SELECT id, row_number() OVER (ORDER BY (xmax - xmin) * (ymax - ymin), id) - 1 AS rank FROM boxes", lambda s, d: b.boxes(s, d).withColumn("planar", (F.col("xmax") - F.col("xmin")) * (F.col("ymax") - F.col("ymin"))), ["planar", "id"], ["id"])
_rank_query("a70_sort_ids", "SELECT id, row_number() OVER (ORDER BY id) - 1 AS rank FROM (SELECT DISTINCT ref AS id FROM way_refs)", lambda s, d: b.way_refs(s, d).select(F.col("ref").alias("id")).distinct(), ["id"], ["id"])
_rank_query("a71_sort_by_lat_lon", "SELECT id, row_number() OVER (ORDER BY lat, lon, id) - 1 AS rank FROM nodes", b.nodes, ["lat", "lon", "id"], ["id"])


@query("a68_sort_relation_coords", b.sql("-- select\nSELECT rel_id, members.ord AS ord, way_coords.ord AS suborder, row_number() OVER (ORDER BY rel_id, members.ord, way_coords.ord) - 1 AS rank FROM members JOIN way_coords ON ref = way_id"))
def a68_sort_relation_coords(spark: S, d: str) -> DataFrame:
    rows = resolve.member_ways(b.members(spark, d), _coords(spark, d)).select("rel_id", "ord", "suborder")
    return global_index(rows, ["rel_id", "ord", "suborder"], "rank")


# ---------------------------------------------------------------- sets


@query("a72_append", b.sql("-- select\nSELECT id, 'n' AS kind FROM nodes UNION ALL SELECT id, 'w' FROM ways"))
def a72_append(spark: S, d: str) -> DataFrame:
    return b.nodes(spark, d).select("id", F.lit("n").alias("kind")).unionByName(b.ways(spark, d).select("id", F.lit("w").alias("kind")))


@query("a73_set_algebra", b.sql("""p AS (SELECT way_id, list(DISTINCT ref) AS refs FROM way_refs GROUP BY way_id)
-- select
SELECT a.way_id, len(list_intersect(a.refs, c.refs))::INTEGER AS shared, len(list_distinct(list_concat(a.refs, c.refs)))::INTEGER AS joined FROM p a JOIN p c ON c.way_id = a.way_id + 1"""))
def a73_set_algebra(spark: S, d: str) -> DataFrame:
    p = b.way_refs(spark, d).groupBy("way_id").agg(F.collect_set("ref").alias("refs"))
    nxt = p.select((F.col("way_id") - 1).alias("way_id"), F.col("refs").alias("more"))
    return p.join(nxt, "way_id").select("way_id", F.size(F.array_intersect("refs", "more")).alias("shared"), F.size(F.array_union("refs", "more")).alias("joined"))


@query("a74_skip_set", b.sql("""-- select
SELECT id FROM nodes WHERE id NOT IN (
  SELECT ref FROM way_refs WHERE way_id IN (SELECT id FROM rels WHERE kind = 'boundary' AND admin AND has_level AND has_name AND NOT part))"""))
def a74_skip_set(spark: S, d: str) -> DataFrame:
    """Nodes that no administrative boundary uses."""
    outlines = tags.way_members(tags.administrative_boundaries(b.relations(spark, d))).select(F.col("ref").alias("way_id"))
    used = b.way_refs(spark, d).join(outlines, "way_id", "left_semi").select(F.col("ref").alias("id"))
    return b.nodes(spark, d).join(used, "id", "left_anti").select("id")


# ---------------------------------------------------------------- strings and tags


@query("f01_split", "SELECT doc_id, len(string_split(text, 'e'))::INTEGER AS n, string_split(text, 'e')[1] AS first FROM documents")
def f01_split(spark: S, d: str) -> DataFrame:
    parts = t.split_literal(F.col("text"), "e")
    return b.table(spark, d, "documents").select("doc_id", F.size(parts).alias("n"), F.get(parts, F.lit(0)).alias("first"))


@query("f02_replace", "SELECT doc_id, replace(text, 'th', '<>') AS text FROM documents")
def f02_replace(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.replace_all(F.col("text"), "th", "<>").alias("text"))


_ESCAPED = "replace(replace(replace(replace(replace({0}, chr(92), chr(92) || chr(92)), chr(9), chr(92) || 't'), chr(34), chr(92) || chr(34)), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r')"
_ENCODED = "replace(replace(url_encode({0}), '.', '%2E'), '~', '%7E')"


@query("f03_encode_literal", f"SELECT doc_id, {_ESCAPED.format('text')} AS literal FROM documents")
def f03_encode_literal(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "documents").select("doc_id", t.encode_literal(F.col("text")).alias("literal"))


@query("f04_url_encode", f"SELECT page_id, {_ENCODED.format('url')} AS encoded FROM pages")
def f04_url_encode(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "pages").select("page_id", t.url_encode(F.col("url")).alias("encoded"))


@query("f05_fixed_decimals", "SELECT event_id, printf('%.6f', value / 7) AS told FROM events")
def f05_fixed_decimals(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "events").select("event_id", t.fixed6(F.col("value") / 7).alias("told"))


@query("f06_integers", "SELECT o_orderkey AS id, (o_orderkey::VARCHAR || '0')::BIGINT AS ten FROM orders")
def f06_integers(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.col("o_orderkey").cast("string"), F.lit("0")).cast("long").alias("ten"))


@query("f07_substrings", "SELECT page_id, contains(url, 'example.net') AS has_net, starts_with(url, 'https') AS secure, octet_length(url::BLOB)::INTEGER AS size FROM pages")
def f07_substrings(spark: S, d: str) -> DataFrame:
    u = F.col("url")
    return b.table(spark, d, "pages").select("page_id", u.contains("example.net").alias("has_net"), u.startswith("https").alias("secure"), F.octet_length("url").alias("size"))


@query("f08_concat", "SELECT p_partkey AS id, p_name || ' / ' || p_brand || ' / ' || p_type AS label FROM part")
def f08_concat(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" / ", "p_name", "p_brand", "p_type").alias("label"))


#: Ten kinds of tags for every page: each rule meets many values.
_RULE_TAGS = [
    ("wikidata", "'Q' || page_id || '; Q' || (page_id + 1)"), ("brand:wikidata", "'P' || page_id"), ("wikipedia", "url"), ("wikipedia", "'de:' || substr(url, 9)"),
    ("wikipedia:note", "url"), ("wikimedia_commons", "url"), ("is_in", "'a ' || page_id || ';b;' || page_id"), ("website", "url"), ("note:website", "url"), ("contact.site", "replace(url, 'https://', 'www.')"), ("name", "html"),
]


def _rule_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT page_id, {i} AS ord, '{k}' AS k, {v} AS v FROM pages" for i, (k, v) in enumerate(_RULE_TAGS))
    under = "replace(v, ' ', '_')"
    return f"""
WITH raw AS ({rows}), keyed AS (SELECT page_id, ord, {_ENCODED.format('k')} AS k, v FROM raw),
objects AS (
  SELECT page_id, ord, k, CASE
    WHEN contains(k, 'wiki') AND contains(k, 'wikidata') AND starts_with(v, 'Q') AND NOT contains(k, 'note') THEN list_transform(string_split(replace(v, ' ', ''), ';'), lambda x: 'wd:' || x)
    WHEN contains(k, 'wikipedia') AND NOT contains(k, 'note') AND length(v) > 4 AND starts_with(v, 'http') THEN ['<' || {under} || '>']
    WHEN contains(k, 'wikipedia') AND NOT contains(k, 'note') THEN ['wpd:' || {_ENCODED.format(under)}]
    WHEN contains(k, 'wiki') THEN []::VARCHAR[]
    WHEN k = 'is_in' THEN list_transform(string_split(replace(v, ' ', ''), ';'), lambda x: '"' || x || '"')
    WHEN length(v) > 3 AND (starts_with(v, 'http') OR starts_with(v, 'www.')) AND NOT contains(k, 'note') THEN ['<' || {_ENCODED.format(under)} || '>']
    ELSE ['"' || {_ESCAPED.format('v')} || '"'] END AS os
  FROM keyed)
SELECT 'osmnode:' || page_id AS s, 'osmt:' || k AS p, unnest(os) AS o FROM objects
"""


@query("t01_tag_triples", _rule_sql())
def t01_tag_triples(spark: S, d: str) -> DataFrame:
    """All tag rules, on whole texts."""
    values = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(v.replace("page_id ||", "CAST(page_id AS STRING) ||").replace("|| page_id", "|| CAST(page_id AS STRING)")).alias("v")) for k, v in _RULE_TAGS])
    return tags.tag_triples(b.table(spark, d, "pages").select(F.col("page_id").alias("id"), values.alias("tags")), "osmnode:")


# ---------------------------------------------------------------- numbers and geometry


@query("m01_line_distance", b.sql("""-- select
SELECT id, round(((20.0 - -10.0) * (-30.0 - lon) - (40.0 - -30.0) * (-10.0 - lat)) / sqrt((-30.0 - 40.0) * (-30.0 - 40.0) + (-10.0 - 20.0) * (-10.0 - 20.0)), 6) AS dist FROM nodes"""))
def m01_line_distance(spark: S, d: str) -> DataFrame:
    x = [F.lit(v) for v in (-30.0, -10.0, 40.0, 20.0)]
    return b.nodes(spark, d).select("id", F.round(g.line_distance(*x, F.col("lon"), F.col("lat")), 6).alias("dist"))


@query("m02_simplification_score", "SELECT o_orderkey AS id, round(0.40::DOUBLE * (1 - (o_custkey % 50)::DOUBLE / 50) + 0.60::DOUBLE * (o_totalprice / 500000), 9) AS score FROM orders")
def m02_simplification_score(spark: S, d: str) -> DataFrame:
    s = g.simplification_score((F.col("o_custkey") % 50).cast("double"), F.lit(50), F.col("o_totalprice"), F.lit(500000))
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.round(s, 9).alias("score"))


@query("m03_tolerance", "SELECT event_id, coalesce(value / 1000000 / event_id > 0 AND value / 1000000 / event_id < 0.00001, false) AS inside FROM events WHERE event_id > 0")
def m03_tolerance(spark: S, d: str) -> DataFrame:
    e = b.table(spark, d, "events").where("event_id > 0")
    return e.select("event_id", g.within_tolerance(F.col("value") / 1000000, F.col("event_id").cast("double")).alias("inside"))


@query("m04_ring_distance", "SELECT o_orderkey AS id, least((((o_orderkey - o_custkey) % 97) + 97) % 97, (((o_custkey - o_orderkey) % 97) + 97) % 97)::BIGINT AS steps FROM orders")
def m04_ring_distance(spark: S, d: str) -> DataFrame:
    return b.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), g.ring_distance(F.col("o_orderkey"), F.col("o_custkey"), F.lit(97)).cast("long").alias("steps"))


@query("g03_relation_wkt", b.sql("-- select\nSELECT rels.id, 'GEOMETRYCOLLECTION(POINT(' || printf('%.6f %.6f', lon, lat) || '))' AS wkt FROM rels JOIN nodes ON c_nationkey = nodes.id"))
def g03_relation_wkt(spark: S, d: str) -> DataFrame:
    m = tags.relation_members(b.relations(spark, d))
    parts = resolve.relation_parts(resolve.member_nodes(m, b.nodes(spark, d)).withColumn("mtype", F.lit("n")))
    return assemble.relation_geometries(parts).select("id", "wkt")


@query("g06_box_polygon", b.sql("-- select\nSELECT id, printf('%.6f %.6f', xmin, ymin) || ',' || printf('%.6f %.6f', xmax, ymin) || ',' || printf('%.6f %.6f', xmax, ymax) || ',' || printf('%.6f %.6f', xmin, ymax) || ',' || printf('%.6f %.6f', xmin, ymin) AS ring FROM boxes"))
def g06_box_polygon(spark: S, d: str) -> DataFrame:
    return b.boxes(spark, d).select("id", F.array_join(t.fixed6_pairs(g.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))), ",").alias("ring"))


@query("g07_area", b.sql("""e AS (
  SELECT way_id, ord, lon, lat, lead(lon) OVER w AS lon2, lead(lat) OVER w AS lat2 FROM way_coords WINDOW w AS (PARTITION BY way_id ORDER BY ord))
-- select
SELECT way_id, round(coalesce(sum(-2 * atan(tan(radians(lon2 - lon) / 2) * sin((radians(lat) + radians(lat2)) / 2) / cos((radians(lat) - radians(lat2)) / 2))), 0), 6) + 0.0 AS area,
  round(coalesce(sum(lon * lat2 - lon2 * lat), 0) / 2, 4) + 0.0 AS planar FROM e GROUP BY way_id"""))
def g07_area(spark: S, d: str) -> DataFrame:
    p = F.col("points")
    return _points(spark, d).select("way_id", (F.round(g.spherical_area(p), 6) + F.lit(0.0)).alias("area"), (F.round(g.planar_area(p), 4) + F.lit(0.0)).alias("planar"))


@query("g08_correct", b.sql("-- select\nSELECT id, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS planar FROM boxes"))
def g08_correct(spark: S, d: str) -> DataFrame:
    """Boxes given open and clockwise come back closed and counter-clockwise."""
    ring = F.slice(F.reverse(g.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))), 1, 4)
    return b.boxes(spark, d).select("id", g.planar_area(g.corrected(ring)).alias("planar"))


@query("g09_unique_points", b.sql("""l AS (SELECT way_id, ord, lon, lat, lag(lon) OVER w AS x, lag(lat) OVER w AS y, row_number() OVER w AS n FROM way_coords WINDOW w AS (PARTITION BY way_id ORDER BY ord))
-- select
SELECT way_id, count(*) FILTER (WHERE n = 1 OR lon <> x OR lat <> y)::INTEGER AS points FROM l GROUP BY way_id"""))
def g09_unique_points(spark: S, d: str) -> DataFrame:
    return _points(spark, d).select("way_id", F.size(g.unique_points(F.col("points"))).alias("points"))


def _clip(name: str, how: str, area_sql: str) -> None:
    """Each nation's box, shifted by half a cell, with the boxes it was."""

    def run(spark: S, d: str) -> DataFrame:
        import pyarrow as pa

        from cartolith.functions import geometry as k
        from cartolith.scratch import prepare

        prepare(spark)

        def clip(batches):  # noqa: ANN001, ANN202
            for batch in batches:
                rows = batch.to_pylist()
                one = [[k.box_polygon((r["xmin"], r["ymin"], r["xmax"], r["ymax"]))] for r in rows]
                two = [[k.box_polygon((r["xmin"] + 36, r["ymin"] + 17, r["xmax"] + 36, r["ymax"] + 17))] for r in rows]
                out = [round(k.area(k.overlay(x, y, how)), 6) for x, y in zip(one, two)]
                yield pa.RecordBatch.from_arrays([pa.array([r["id"] for r in rows], pa.int64()), pa.array(out, pa.float64())], names=["id", "area"])

        return b.boxes(spark, d).where("id < 1000").select("id", "xmin", "ymin", "xmax", "ymax").mapInArrow(clip, "id long, area double")

    query(name, b.sql(f"-- select\nSELECT id, {area_sql}::DOUBLE AS area FROM boxes WHERE id < 1000"))(run)


_clip("g10_union", "union", "2 * 72 * 34 - 36 * 17")
_clip("g11_difference", "difference", "72 * 34 - 36 * 17")
_clip("g12_intersection", "intersection", "36 * 17")


def _way_features(spark: S, d: str) -> DataFrame:
    none = F.expr(f"CAST(array() AS ARRAY<{model.POINT}>)")
    return _points(spark, d).where(F.size("points") > 1).select(
        F.col("way_id").cast("string").alias("fid"), F.lit(None).cast("long").alias("self"), F.lit("way").alias("kind"), none.alias("points"),
        F.array("points").alias("lines"), F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)").alias("polygons"),
    )


@query("g13_lines_covered", b.sql("""w AS (SELECT way_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM way_coords GROUP BY way_id HAVING count(*) > 1)
-- select
SELECT way_id, boxes.id AS bid FROM w JOIN boxes ON xmin <= x0 AND x1 <= xmax AND ymin <= y0 AND y1 <= ymax"""))
def g13_lines_covered(spark: S, d: str) -> DataFrame:
    """Ways within boundaries; a box covers a way when it covers all its points."""
    r = spatial.relate(_way_features(spark, d), b.boundaries(spark, d), sphere=False, within_only=True)
    return r.where("decision = 'within'").select(F.col("fid").cast("long").alias("way_id"), "bid")


@query("g18_num_points", b.sql("-- select\nSELECT way_id, count(*)::INTEGER AS points FROM way_coords GROUP BY way_id"))
def g18_num_points(spark: S, d: str) -> DataFrame:
    return _points(spark, d).select("way_id", F.size("points").alias("points"))


@query("g19_ring_assembly", b.sql("-- select\nSELECT id, ((xmax - xmin) * (ymax - ymin))::DOUBLE AS area, 1::INTEGER AS polygons FROM boxes"))
def g19_ring_assembly(spark: S, d: str) -> DataFrame:
    """Boxes whose four sides come as ways in all directions are stitched to rings."""
    ring = g.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    side = lambda i: F.slice(ring, i, 2)
    outers = F.array(side(1), F.reverse(side(3)), F.reverse(side(2)), side(4))
    parts = b.boxes(spark, d).select(F.col("id").alias("rel_id"), F.lit(True).alias("has_tag"), F.expr(f"CAST(array() AS ARRAY<{model.POINT}>)").alias("points"), outers.alias("outers"), F.expr(f"CAST(array() AS ARRAY<{model.RING}>)").alias("inners"))
    made = assemble.relation_geometries(parts)
    return made.select("id", F.abs(g.planar_area(F.col("polygons")[0]["outer"])).alias("area"), F.size("polygons").alias("polygons"))


@query("g27_reclose", b.sql("-- select\nSELECT id, 5::INTEGER AS points FROM boxes"))
def g27_reclose(spark: S, d: str) -> DataFrame:
    ring = F.slice(g.box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax")), 1, 4)
    return b.boxes(spark, d).select("id", F.size(g.reclosed(ring)).alias("points"))



@query("g29_grid_cells", b.sql("-- select\nSELECT nodes.id AS nid, count(*)::BIGINT AS boxes FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax GROUP BY nodes.id"))
def g29_grid_cells(spark: S, d: str) -> DataFrame:
    """Index queries: how many boxes hold each node."""
    f = b.nodes(spark, d).select(F.col("id").cast("string").alias("fid"), F.col("lon").alias("xmin"), F.col("lat").alias("ymin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymax"))
    return spatial.candidates(f, b.boxes(spark, d)).groupBy(F.col("fid").cast("long").alias("nid")).agg(F.count(F.lit(1)).alias("boxes"))


@query("g32_collections_within", b.sql("""w AS (
  SELECT rel_id, min(lon) AS x0, max(lon) AS x1, min(lat) AS y0, max(lat) AS y1 FROM members JOIN way_coords ON ref = way_id GROUP BY rel_id)
-- select
SELECT rel_id, boxes.id AS bid FROM w JOIN boxes ON xmin <= x0 AND x1 <= xmax AND ymin <= y0 AND y1 <= ymax"""))
def g32_collections_within(spark: S, d: str) -> DataFrame:
    """Relations of points: within a boundary when every point is."""
    rows = resolve.member_ways(b.members(spark, d), _coords(spark, d))
    f = rows.groupBy("rel_id").agg(F.collect_list(F.struct("lon", "lat")).alias("points")).select(
        F.col("rel_id").cast("string").alias("fid"), F.lit(None).cast("long").alias("self"), F.lit("relation").alias("kind"), "points",
        F.expr(f"CAST(array() AS ARRAY<{model.RING}>)").alias("lines"), F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)").alias("polygons"))
    return spatial.relate(f, b.boundaries(spark, d), sphere=False, within_only=True).where("decision = 'within'").select(F.col("fid").cast("long").alias("rel_id"), "bid")


@query("g33_relation_triples", b.sql("""pairs AS (SELECT 'osmnode:' || nodes.id AS f, 'osmrel:' || boxes.id AS r FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax)
-- select
SELECT f AS s, 'geof:sfWithin' AS p, r AS o FROM pairs UNION ALL SELECT r, 'geof:sfContains', f FROM pairs UNION ALL SELECT f, 'geof:sfIntersects', r FROM pairs UNION ALL SELECT r, 'geof:sfIntersects', f FROM pairs"""))
def g33_relation_triples(spark: S, d: str) -> DataFrame:
    f = _node_features(spark, d).withColumn("fid", F.concat(F.lit("osmnode:"), F.col("fid")))
    return spatial.relation_triples(spatial.relate(f, b.boundaries(spark, d), sphere=False))


# ---------------------------------------------------------------- graphs


@query("r01_name_clusters", b.sql(_CLUSTERS + "-- select\nSELECT cluster_id, name, way_id FROM clusters", True))
def r01_name_clusters(spark: S, d: str) -> DataFrame:
    return _clusters(spark, d)


@query("r02_cluster_members", b.sql(_CLUSTERS + "-- select\nSELECT 'osmway:' || cluster_id AS s, 'geof:sfContains' AS p, 'osmway:' || way_id AS o FROM clusters", True))
def r02_cluster_members(spark: S, d: str) -> DataFrame:
    return cluster.member_triples(_clusters(spark, d))


@query("r03_containment", b.sql("-- select\nSELECT a.id AS child, c.id AS parent FROM boxes a JOIN boxes c ON a.id < 1000 AND c.id >= 1000 AND c.xmin <= a.xmin AND c.ymin <= a.ymin AND a.xmax <= c.xmax AND a.ymax <= c.ymax"))
def r03_containment(spark: S, d: str) -> DataFrame:
    return spatial.containment(materialise(b.boundaries(spark, d), "boundaries"), sphere=False)


@query("r04_successors", """
WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS child, o_custkey // 2 AS parent FROM orders WHERE o_custkey > 0),
reach(child, ancestor) AS (SELECT child, parent FROM e UNION SELECT reach.child, e.parent FROM reach JOIN e ON reach.ancestor = e.child)
SELECT child, ancestor FROM reach""")
def r04_successors(spark: S, d: str) -> DataFrame:
    e = b.table(spark, d, "orders").where("o_custkey > 0").select(F.col("o_custkey").alias("child"), F.expr("o_custkey div 2").alias("parent")).distinct()
    return graph.successors(e)


@query("r05_implied", b.sql("-- select\nSELECT nodes.id::VARCHAR AS fid, boxes.id AS bid FROM nodes JOIN boxes ON lon BETWEEN xmin AND xmax AND lat BETWEEN ymin AND ymax"))
def r05_implied(spark: S, d: str) -> DataFrame:
    """Pairs found by a boundary's containers: each once, whichever way it was found."""
    x = materialise(b.boundaries(spark, d), "boundaries")
    small = spatial.relate(_node_features(spark, d), x.where("id < 1000"), sphere=False)
    return spatial.with_containers(small, spatial.containment(x, sphere=False)).where("decision = 'within'").select("fid", "bid")


@query("r06_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_partkey AS a, l_suppkey + 10000000 AS b FROM lineitem), sym AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
cc(node, root) USING KEY (node) AS (
  SELECT a, a FROM sym GROUP BY a
  UNION
  SELECT sym.a, min(cc.root) FROM cc JOIN sym ON sym.b = cc.node JOIN recurring.cc AS known ON known.node = sym.a GROUP BY sym.a, known.root HAVING min(cc.root) < known.root)
SELECT node, root FROM cc""")
def r06_components(spark: S, d: str) -> DataFrame:
    """Parts and suppliers linked by any order line."""
    e = b.table(spark, d, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 10000000).alias("b"))
    return graph.components(e)

