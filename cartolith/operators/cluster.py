"""Name clusters: ways of one name that share nodes, joined to new synthetic ways."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions.columns import is_closed
from cartolith.functions.text import fixed6_pairs
from cartolith.operators.graph import components
from cartolith.scratch import global_index


def named_refs(refs: DataFrame) -> DataFrame:
    """References of ways with a non-empty name: ``name, ref, way_id``, each once."""
    return refs.where("name is not null and name <> ''").select("name", "ref", "way_id").distinct()


def name_dictionary(names: DataFrame) -> DataFrame:
    """``name, name_id``: ids from 1 by first appearance; ``names`` has ``name, entity, id``. 0 stands for no name."""
    first = names.where("name is not null and name <> ''").groupBy("name").agg(F.min(F.struct("entity", "id")).alias("first"))
    return global_index(first, ["first.entity", "first.id", "name"], "name_id", start=1).select("name", "name_id")


def adjacent_edges(refs: DataFrame) -> DataFrame:
    """``name, ref, a, b``: neighbours in way order among the ways of a name that share a node."""
    w = Window.partitionBy("name", "ref").orderBy("way_id")
    return named_refs(refs).withColumn("a", F.lag("way_id").over(w)).where("a is not null").select("name", "ref", "a", F.col("way_id").alias("b"))


def star_edges(refs: DataFrame) -> DataFrame:
    """``name, ref, a, b``: the least way of a name and node with each other one.

    As connected as all pairs, and one row a reference: a node that very many ways share is summed
    before the shuffle.
    """
    r = named_refs(refs)
    least = r.groupBy("name", "ref").agg(F.min("way_id").alias("a"), F.max("way_id").alias("most")).where("a < most").drop("most")
    return r.join(least, ["name", "ref"]).where("way_id > a").select("name", "ref", "a", F.col("way_id").alias("b"))


def clusters(refs: DataFrame, max_way_id: int) -> DataFrame:
    """``cluster_id, name, way_id``: clusters of at least two ways.

    Ids follow the greatest way id, in order of the name's first way and the least shared node.
    """
    edges = star_edges(refs)
    members = components(edges)
    first_way = named_refs(refs).groupBy("name").agg(F.min("way_id").alias("first_way"))
    keyed = edges.select("name", "ref", F.col("a").alias("node")).join(members, "node")
    heads = keyed.groupBy("root").agg(F.min("ref").alias("least_ref"), F.first("name").alias("name")).join(first_way, "name")
    ids = global_index(heads, ["first_way", "least_ref", "root"], "cluster_id", start=max_way_id + 1)
    return members.join(ids.select("root", "name", "cluster_id"), "root").select("cluster_id", "name", F.col("node").alias("way_id"))


def shared_tags(cluster_ways: DataFrame, ways: DataFrame) -> DataFrame:
    """``cluster_id, k, v``: the tags that every way of a cluster has."""
    size = cluster_ways.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    tags = cluster_ways.join(ways.select(F.col("id").alias("way_id"), F.explode("tags").alias("t")), "way_id")
    per = tags.groupBy("cluster_id", F.col("t.k").alias("k"), F.col("t.v").alias("v")).agg(F.count_distinct("way_id").alias("n"))
    return per.join(size, "cluster_id").where("n = size").select("cluster_id", "k", "v")


def cluster_sizes(cluster_ways: DataFrame) -> DataFrame:
    return cluster_ways.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_ways"))


def cluster_wkt(cluster_ways: DataFrame, points: DataFrame) -> DataFrame:
    """``cluster_id, wkt`` of clusters whose ways all have a geometry; parts by way id."""
    size = cluster_sizes(cluster_ways)
    text = F.array_join(fixed6_pairs(F.col("points")), ",")
    part = F.when(is_closed(F.col("points"), 3), F.concat(F.lit("POLYGON(("), text, F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING("), text, F.lit(")")))
    rows = cluster_ways.join(points, "way_id").select("cluster_id", "way_id", part.alias("part"))
    joined = rows.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("way_id", "part"))).alias("p"))
    whole = joined.join(size, "cluster_id").where(F.size("p") == F.col("n_ways"))
    return whole.select("cluster_id", F.concat(F.lit("GEOMETRYCOLLECTION("), F.array_join(F.transform("p", lambda x: x["part"]), ","), F.lit(")")).alias("wkt"))


def member_triples(cluster_ways: DataFrame) -> DataFrame:
    """``s, p, o``: clusters contain their ways."""
    name = lambda c: F.concat(F.lit("osmway:"), F.col(c).cast("string"))
    return cluster_ways.select(name("cluster_id").alias("s"), F.lit(model.CONTAINS).alias("p"), name("way_id").alias("o"))
