"""Joins that resolve references, and the ordered groups made of them.

Dangling references drop out (inner joins); kinds of members are part of the join key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def way_coordinates(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """``way_id, ord, lon, lat`` of way references (``way_id, ord, ref``)."""
    at = nodes.select(F.col("id").alias("ref"), "lon", "lat")
    return refs.join(at, "ref").select("way_id", "ord", "lon", "lat")


def way_points(coordinates: DataFrame) -> DataFrame:
    """``way_id, points``: each way's points in order. One way's points are one row, as in the source."""
    ordered = F.array_sort(F.collect_list(F.struct("ord", "lon", "lat")))
    return coordinates.groupBy("way_id").agg(F.transform(ordered, lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))).alias("points"))


def used_ways(ways: DataFrame, members: DataFrame) -> DataFrame:
    """Ways that some member refers to (a semi-join before any heavier one)."""
    return ways.join(members.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")


def used_nodes(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes that some way refers to."""
    return nodes.join(refs.select(F.col("ref").alias("id")).distinct(), "id", "left_semi")


def member_nodes(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """``rel_id, ord, suborder, role, has_tag, lon, lat`` of node members."""
    at = nodes.select(F.col("id").alias("ref"), "lon", "lat")
    return members.where("mtype = 'n'").join(at, "ref").select("rel_id", "ord", F.lit(0).alias("suborder"), "role", "has_tag", "lon", "lat")


def member_ways(members: DataFrame, coordinates: DataFrame) -> DataFrame:
    """The same of way members, a row for each point of the way."""
    at = coordinates.select(F.col("way_id").alias("ref"), F.col("ord").alias("suborder"), "lon", "lat")
    return members.where("mtype = 'w'").join(at, "ref").select("rel_id", "ord", "suborder", "role", "has_tag", "lon", "lat")


def member_coordinates(members: DataFrame, nodes: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Points of node members and of way members, in one table with ``mtype``."""
    n = member_nodes(members, nodes).withColumn("mtype", F.lit("n"))
    return n.unionByName(member_ways(members, coordinates).withColumn("mtype", F.lit("w")))


def relation_parts(coordinates: DataFrame) -> DataFrame:
    """``rel_id, has_tag, points, outers, inners``: the parts of each relation in member order.

    Points are node members; outers are way members of the roles outer, none and others; inners
    those of the role inner; subareas drop out.
    """
    point = lambda p: F.struct(p["lon"].alias("lon"), p["lat"].alias("lat"))
    ordered = F.array_sort(F.collect_list(F.struct("suborder", "lon", "lat")))
    by_member = coordinates.groupBy("rel_id", "ord", "mtype", "role").agg(F.transform(ordered, point).alias("pts"), F.max("has_tag").alias("has_tag"))
    row = F.struct("ord", "pts")
    collect = lambda cond: F.transform(F.array_sort(F.collect_list(F.when(cond, row))), lambda m: m["pts"])
    way = F.col("mtype") == "w"
    return by_member.groupBy("rel_id").agg(
        F.max("has_tag").alias("has_tag"),
        F.flatten(collect(F.col("mtype") == "n")).alias("points"),
        collect(way & (F.col("role") > "1")).alias("outers"),
        collect(way & (F.col("role") == "0")).alias("inners"),
    )
