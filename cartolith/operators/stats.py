"""Statistics of a map extract, each table read once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.operators.tags import has_key, has_relation_member, has_tag


def entity_counts(nodes: DataFrame, ways: DataFrame, relations: DataFrame) -> DataFrame:
    """``nodes, ways, relations, max_way_id`` (0 without ways)."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    w = ways.agg(F.count(F.lit(1)).alias("ways"), F.greatest(F.coalesce(F.max("id"), F.lit(0)), F.lit(0)).alias("max_way_id"))
    r = relations.agg(F.count(F.lit(1)).alias("relations"))
    one = lambda d: d.withColumn("__k", F.lit(0))
    return one(n).join(one(w), "__k").join(one(r), "__k").select("nodes", "ways", "relations", "max_way_id")


def relation_counts(relations: DataFrame) -> DataFrame:
    """Nested counts of boundaries, multipolygons and relations of relations, in one pass."""
    boundary = has_tag("type", "boundary")
    admin = boundary & has_tag("boundary", "administrative")
    level = admin & has_key("admin_level")
    multi, nested = has_tag("type", "multipolygon"), has_relation_member()
    return relations.agg(
        F.count_if(boundary).alias("boundaries"), F.count_if(admin).alias("administrative"),
        F.count_if(level).alias("with_level"), F.count_if(level & has_key("name")).alias("with_name"),
        F.count_if(multi).alias("multipolygons"), F.count_if(nested).alias("nested"), F.count_if(~nested).alias("flat"),
        F.count_if(multi & nested).alias("nested_multipolygons"), F.count_if(multi & nested & boundary).alias("nested_multipolygon_boundaries"),
    )


def simplification_stats(boundaries: DataFrame) -> DataFrame:
    """How far simplification reduced points: sums and counts of ratios, and all points."""
    n = lambda c: F.aggregate(c, F.lit(0), lambda s, p: s + F.size(p["outer"]) + F.aggregate(p["inners"], F.lit(0), lambda t, r: t + F.size(r)))
    e, o, u = n("exact"), n("over"), n("under")
    return boundaries.agg(
        F.sum(F.when(u > 0, u / e)).alias("under_ratio_sum"), F.count_if(u > 0).alias("under_n"),
        F.sum(F.when(o > 0, o / e)).alias("over_ratio_sum"), F.count_if(o > 0).alias("over_n"),
        F.sum(e).alias("points"), F.count(F.lit(1)).alias("boundaries"),
    )
