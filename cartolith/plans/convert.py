"""The whole conversion: map entities to an enriched graph, as tables of lines.

Profiles: ``default`` writes subjects and spaces consistently and tests geometry exactly;
``golden`` follows the established output in its peculiarities: open ways that lie within a
boundary are ``osmnode:`` subjects there, way geometries end in two blanks, and a way that meets a
boundary's under-estimate counts as within.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions.columns import is_closed, way_wkt
from cartolith.functions.text import triple_line
from cartolith.operators import assemble, cluster, resolve, spatial, tags
from cartolith.progress import step
from cartolith.scratch import materialise
from cartolith.sources import osm_pbf, osm_xml, turtle


@dataclass
class Extract:
    """The three entity tables."""

    nodes: DataFrame
    ways: DataFrame
    relations: DataFrame


def read(spark: SparkSession, path: str) -> Extract:
    """An extract from a ``.pbf`` or XML file (plain, gzip or bzip2).

    A PBF file is decoded once, to a written table that the three entity tables are filters of.
    """
    if path.endswith(".pbf"):
        entities = materialise(osm_pbf.read_entities(spark, path), "entities")
        return Extract(osm_pbf.nodes_of(entities), osm_pbf.ways_of(entities), osm_pbf.relations_of(entities))
    return Extract(osm_xml.read_nodes(spark, path), osm_xml.read_ways(spark, path), osm_xml.read_relations(spark, path))


class Conversion:
    """The tables of a conversion; what several outputs read is written once."""

    def __init__(self, extract: Extract, profile: str = "default", sphere: bool = True, include_nodes: bool = False):
        if profile not in ("default", "golden"):
            raise ValueError(f"unknown profile {profile}")
        self.x, self.golden, self.sphere, self.include_nodes = extract, profile == "golden", sphere, include_nodes
        self._made: dict[str, DataFrame] = {}

    def _once(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        if name not in self._made:
            with step(name):
                self._made[name] = materialise(make(), name)
        return self._made[name]

    # ------------------------------------------------------------ tables

    def refs(self) -> DataFrame:
        return tags.way_refs(self.x.ways)

    def way_coordinates(self) -> DataFrame:
        return self._once("way-coordinates", lambda: resolve.way_coordinates(self.refs(), self.x.nodes))

    def way_points(self) -> DataFrame:
        return self._once("way-points", lambda: resolve.way_points(self.way_coordinates()))

    def boundaries(self) -> DataFrame:
        """Administrative boundaries, by a semi-join chain relation, way, node."""

        def make() -> DataFrame:
            members = tags.way_members(tags.administrative_boundaries(self.x.relations))
            ways = resolve.used_ways(self.x.ways, members)
            refs = tags.way_refs(ways)
            at = resolve.way_coordinates(refs, resolve.used_nodes(self.x.nodes, refs))
            rows = resolve.member_ways(members.withColumn("mtype", F.lit("w")).withColumn("has_tag", F.lit(True)), at)
            return assemble.boundaries(resolve.relation_parts(rows.withColumn("mtype", F.lit("w"))), assemble.MOST_OUTERS if self.golden else None)

        return self._once("boundaries", make)

    def closure(self) -> DataFrame:
        return self._once("closure", lambda: spatial.containment(self.boundaries(), self.sphere))

    def relation_geometries(self) -> DataFrame:
        def make() -> DataFrame:
            multi, other = tags.route_relations(self.x.relations)
            members = tags.relation_members(multi.unionByName(other))
            coordinates = resolve.member_coordinates(members, self.x.nodes, self.way_coordinates())
            return assemble.relation_geometries(resolve.relation_parts(coordinates))

        return self._once("relations", make)

    def clusters(self) -> DataFrame:
        def make() -> DataFrame:
            most = self.x.ways.agg(F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).alias("m")).first().m
            return cluster.clusters(self.refs(), most)

        return self._once("clusters", make)

    def _way_features(self) -> DataFrame:
        """Ways with a name and at least two points; the golden profile lets any tag do for the first way."""
        named = F.coalesce(tags.tag_value("name") != "", F.lit(False))
        ways = self.x.ways.select("id", named.alias("named"), tags.has_any_tag().alias("tagged"))
        gate = F.col("named")
        if self.golden:
            first = self.x.ways.agg(F.min("id").alias("first"))
            ways = ways.join(F.broadcast(first))  # one row
            gate = gate | ((F.col("id") == F.col("first")) & F.col("tagged"))
        ways = ways.where(gate).join(self.way_points(), F.col("id") == F.col("way_id")).where(F.size("points") > 1)
        closed = is_closed(F.col("points"), 2)
        none = F.expr(f"CAST(array() AS ARRAY<{model.RING}>)")
        polygon = F.expr(f"CAST(array(named_struct('outer', points, 'inners', array())) AS ARRAY<{model.POLYGON}>)")
        return ways.select(
            F.concat(F.lit("osmway:"), F.col("id").cast("string")).alias("fid"), F.lit(None).cast("long").alias("self"), F.lit("way").alias("kind"),
            F.expr(f"CAST(array() AS ARRAY<{model.POINT}>)").alias("points"),
            F.when(closed, none).otherwise(F.array("points")).alias("lines"),
            F.when(closed, polygon).otherwise(F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)")).alias("polygons"),
            closed.alias("closed"),
        )

    def _node_features(self) -> DataFrame:
        point = F.array(F.struct("lon", "lat"))
        return self.x.nodes.where(tags.has_any_tag()).select(
            F.concat(F.lit("osmnode:"), F.col("id").cast("string")).alias("fid"), F.lit(None).cast("long").alias("self"), F.lit("node").alias("kind"),
            point.alias("points"), F.expr(f"CAST(array() AS ARRAY<{model.RING}>)").alias("lines"), F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)").alias("polygons"),
        )

    def _relation_features(self) -> DataFrame:
        r = self.relation_geometries().where("has_tag")
        return r.select(F.concat(F.lit("osmrel:"), F.col("id").cast("string")).alias("fid"), F.col("id").alias("self"), F.lit("relation").alias("kind"), "points", "lines", "polygons")

    def related(self) -> DataFrame:
        """``fid, bid, decision, path`` of ways and relations (nodes on request), containers added."""

        def make() -> DataFrame:
            features = self._way_features().drop("closed").unionByName(self._relation_features())
            if self.include_nodes:
                features = features.unionByName(self._node_features())
            direct = spatial.relate(features, self.boundaries(), self.sphere, touching_counts=self.golden)
            # A relation is never within itself, also not by way of a container.
            own = F.concat(F.lit("osmrel:"), F.col("bid").cast("string")) != F.col("fid")
            return spatial.with_containers(direct, self.closure()).where(own)

        return self._once("related", make)

    # ------------------------------------------------------------ lines

    def tag_lines(self) -> DataFrame:
        parts = [tags.tag_triples(self.x.nodes, "osmnode:"), tags.tag_triples(self.x.ways, "osmway:"), tags.tag_triples(self.x.relations, "osmrel:"), tags.node_point_triples(self.x.nodes)]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return turtle.lines(out)

    def cluster_lines(self) -> DataFrame:
        c = self.clusters()
        shared = cluster.shared_tags(c, self.x.ways).groupBy(F.col("cluster_id").alias("id")).agg(F.collect_list(F.struct("k", "v")).alias("tags"))
        wkt = cluster.cluster_wkt(c, self.way_points())
        shape = wkt.select(F.concat(F.lit("osmway:"), F.col("cluster_id").cast("string")).alias("s"), F.lit(model.HAS_GEOMETRY).alias("p"), _literal("wkt").alias("o"))
        return turtle.lines(tags.tag_triples(shared, "osmway:").unionByName(cluster.member_triples(c)).unionByName(shape))

    def way_lines(self) -> DataFrame:
        subject = F.concat(F.lit("osmway:"), F.col("way_id").cast("string"))
        line = triple_line(subject, F.lit(model.HAS_GEOMETRY), _literal(way_wkt(F.col("points"))))
        if self.golden:
            line = F.concat(F.substring_index(line, " .", 1), F.lit("  ."))
        shapes = self.way_points().select(line.alias("line"))
        rows = self.related().where("fid LIKE 'osmway:%'")
        if self.golden:
            open_ = self._way_features().where("not closed").select("fid", F.lit(True).alias("open"))
            rows = rows.join(open_, "fid", "left")
            as_node = F.col("open").isNotNull() & (F.col("decision") == "within")
            rows = rows.withColumn("fid", F.when(as_node, F.replace("fid", F.lit("osmway:"), F.lit("osmnode:"))).otherwise(F.col("fid")))
        return shapes.unionByName(turtle.lines(spatial.relation_triples(rows)))

    def relation_lines(self) -> DataFrame:
        shapes = self.relation_geometries().select(F.concat(F.lit("osmrel:"), F.col("id").cast("string")).alias("s"), F.lit(model.HAS_GEOMETRY).alias("p"), _literal("wkt").alias("o"))
        rows = spatial.relation_triples(self.related().where("fid LIKE 'osmrel:%'"))
        return turtle.lines(shapes.unionByName(rows))

    def node_lines(self) -> DataFrame:
        return turtle.lines(spatial.relation_triples(self.related().where("fid LIKE 'osmnode:%'")))

    def lines(self, with_tags: bool = True) -> DataFrame:
        out = self.cluster_lines().unionByName(self.way_lines()).unionByName(self.relation_lines())
        if self.include_nodes:
            out = out.unionByName(self.node_lines())
        return self.tag_lines().unionByName(out) if with_tags else out


def _literal(wkt: object) -> object:
    text = F.col(wkt) if isinstance(wkt, str) else wkt
    return F.concat(F.lit('"'), text, F.lit(f'"{model.WKT_LITERAL}'))


def statistics(c: Conversion) -> dict[str, int]:
    """What a conversion would write, counted by kind; nothing is written to its target."""
    return {
        "tag_lines": c.tag_lines().count(), "cluster_lines": c.cluster_lines().count(), "way_lines": c.way_lines().count(), "relation_lines": c.relation_lines().count(),
        "clusters": c.clusters().select("cluster_id").distinct().count(), "boundaries": c.boundaries().count(),
    }


def convert(spark: SparkSession, source: str, target: str, profile: str = "default", only_stats: bool = False, compression: str | None = "bzip2") -> dict[str, int]:
    """Converts a file and writes Turtle; returns counts. ``only_stats`` writes nothing."""
    from cartolith.operators.stats import entity_counts

    extract = read(spark, source)
    counts = entity_counts(extract.nodes, extract.ways, extract.relations).first().asDict()
    c = Conversion(extract, profile)
    if only_stats:
        told = statistics(c)
        return counts | told | {"lines": sum(n for k, n in told.items() if k.endswith("_lines"))}
    with step("write"):
        turtle.write_turtle(spark, c.lines(), target, compression)
    return counts
