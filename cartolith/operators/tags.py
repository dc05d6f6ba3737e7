"""Predicates on tags and members, and tag triples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith import model
from cartolith.functions.text import tag_objects, url_encode


def has_tag(k: str, v: str, tags: str = "tags") -> Column:
    return F.exists(tags, lambda t: (t["k"] == k) & (t["v"] == v))


def has_key(k: str, tags: str = "tags") -> Column:
    return F.exists(tags, lambda t: t["k"] == k)


def tag_value(k: str, tags: str = "tags") -> Column:
    """The first value of a key; null without the key."""
    return F.get(F.filter(tags, lambda t: t["k"] == k), F.lit(0))["v"]


def has_any_tag(tags: str = "tags") -> Column:
    return F.size(tags) > 0


def has_relation_member(members: str = "members", but_role: str | None = None) -> Column:
    """Whether a member is a relation; with ``but_role``, one of another role than that."""
    return F.exists(members, lambda m: (m["type"] == "relation") & (F.lit(True) if but_role is None else m["role"] != but_role))


def role_code(role: Column) -> Column:
    out = F.lit("4")
    for name, code in model.ROLE_CODES.items():
        out = F.when(role == name, code).otherwise(out)
    return out


def member_code(kind: Column) -> Column:
    """``n``, ``w`` or ``r``; null for other kinds."""
    out = F.lit(None).cast("string")
    for name, code in model.MEMBER_CODES.items():
        out = F.when(kind == name, code).otherwise(out)
    return out


def administrative_boundaries(relations: DataFrame) -> DataFrame:
    """Relations that are administrative boundaries with level and name, and no sub-relation but subareas."""
    return relations.where(
        has_tag("type", "boundary") & has_tag("boundary", "administrative") & has_key("admin_level") & has_key("name")
        & ~has_relation_member(but_role="subarea")
    )


def way_members(relations: DataFrame) -> DataFrame:
    """``rel_id, ord, ref, role``: way members only, numbered among themselves from 0."""
    ways = F.filter("members", lambda m: m["type"] == "way")
    return relations.select(F.col("id").alias("rel_id"), F.posexplode(ways).alias("ord", "m")).select("rel_id", "ord", F.col("m.ref").alias("ref"), role_code(F.col("m.role")).alias("role"))


def relation_members(relations: DataFrame) -> DataFrame:
    """``rel_id, ord, mtype, ref, role, has_tag``: members of known kinds, numbered in order from 0."""
    known = F.filter("members", lambda m: m["type"].isin(*model.MEMBER_CODES))
    rows = relations.select(F.col("id").alias("rel_id"), has_any_tag().alias("has_tag"), F.posexplode(known).alias("ord", "m"))
    return rows.select("rel_id", "ord", member_code(F.col("m.type")).alias("mtype"), F.col("m.ref").alias("ref"), role_code(F.col("m.role")).alias("role"), "has_tag")


def route_relations(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(multipolygons, other relations without sub-relations)."""
    multi = has_tag("type", "multipolygon")
    return relations.where(multi), relations.where(~multi & ~has_relation_member())


def way_refs(ways: DataFrame) -> DataFrame:
    """``way_id, ord, ref, name, has_tag`` of each node reference."""
    return ways.select(F.col("id").alias("way_id"), tag_value("name").alias("name"), has_any_tag().alias("has_tag"), F.posexplode("refs").alias("ord", "ref"))


def tag_triples(entities: DataFrame, prefix: str) -> DataFrame:
    """``s, p, o`` of the tags of ``id, tags``."""
    tags = entities.select(F.concat(F.lit(prefix), F.col("id").cast("string")).alias("s"), F.explode("tags").alias("t"))
    keyed = tags.select("s", url_encode(F.col("t.k")).alias("k"), F.coalesce(F.col("t.v"), F.lit("")).alias("v"))
    return keyed.select("s", F.concat(F.lit("osmt:"), F.col("k")).alias("p"), F.explode(tag_objects(F.col("k"), F.col("v"))).alias("o"))


def node_point_triples(nodes: DataFrame) -> DataFrame:
    """``s, p, o``: the point of every node, tagged or not."""
    from cartolith.functions.text import fixed6

    wkt = F.concat(F.lit('"POINT('), fixed6(F.col("lon")), F.lit(" "), fixed6(F.col("lat")), F.lit(f')"{model.WKT_LITERAL}'))
    return nodes.select(F.concat(F.lit("osmnode:"), F.col("id").cast("string")).alias("s"), F.lit(model.HAS_GEOMETRY).alias("p"), wkt.alias("o"))
