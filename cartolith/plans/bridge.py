"""The driver's star-schema tables as a map: the same definitions for Spark and for SQL.

Parts are nodes, orders are ways named by customer, order lines are node references, customers are
relations with orders as members, nations and regions are nested boxes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tag(k: str, v: object) -> object:
    return F.struct(F.lit(k).alias("k"), v.cast("string").alias("v"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    lon = ((F.col("p_partkey") * 37) % 3600).cast("double") / F.lit(10.0) - F.lit(180.0)
    lat = ((F.col("p_partkey") * 53) % 1700).cast("double") / F.lit(10.0) - F.lit(85.0)
    return p.select(F.col("p_partkey").alias("id"), lon.alias("lon"), lat.alias("lat"), F.array(tag("name", F.col("p_name")), tag("brand", F.col("p_brand")), tag("type", F.col("p_type"))).alias("tags"))


def ways(spark: SparkSession, d: str) -> DataFrame:
    """``id, name, tags``; references are a table of their own."""
    o = table(spark, d, "orders")
    name = F.concat(F.lit("C"), F.col("o_custkey").cast("string"))
    return o.select(F.col("o_orderkey").alias("id"), name.alias("name"), F.array(tag("name", name), tag("status", F.col("o_orderstatus")), tag("priority", F.col("o_orderpriority"))).alias("tags"))


def way_refs(spark: SparkSession, d: str) -> DataFrame:
    """``way_id, ord, ref``. The order breaks ties by all columns; an order has few lines."""
    w = Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)
    li = table(spark, d, "lineitem")
    return li.select(F.col("l_orderkey").alias("way_id"), (F.row_number().over(w) - 1).cast("long").alias("ord"), F.col("l_partkey").alias("ref"))


def named_refs(spark: SparkSession, d: str) -> DataFrame:
    """``way_id, ord, ref, name, has_tag``."""
    return way_refs(spark, d).join(ways(spark, d).select(F.col("id").alias("way_id"), "name"), "way_id").withColumn("has_tag", F.lit(True))


def members(spark: SparkSession, d: str) -> DataFrame:
    """``rel_id, ord, mtype, ref, role, has_tag``: a customer's orders, in order."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    role = F.when(F.col("o_orderstatus") == "F", "2").when(F.col("o_orderstatus") == "O", "0").otherwise("3")
    o = table(spark, d, "orders")
    return o.select(F.col("o_custkey").alias("rel_id"), (F.row_number().over(w) - 1).cast("long").alias("ord"), F.lit("w").alias("mtype"), F.col("o_orderkey").alias("ref"), role.alias("role"), F.lit(True).alias("has_tag"))


def relations(spark: SparkSession, d: str) -> DataFrame:
    """``id, members, tags``: customers; type by market segment, boundaries by balance."""
    c = table(spark, d, "customer")
    kind = F.when(F.col("c_custkey") % 5 == 0, "boundary").when(F.col("c_custkey") % 5 == 1, "multipolygon").otherwise("route")
    extra = F.filter(
        F.array(
            tag("type", kind),
            F.when(F.col("c_custkey") % 10 == 0, tag("boundary", F.lit("administrative"))),
            F.when(F.col("c_nationkey") % 2 == 0, tag("admin_level", F.col("c_nationkey") % 9)),
            F.when(F.col("c_acctbal") > 0, tag("name", F.col("c_name"))),
        ),
        lambda t: t.isNotNull(),
    )
    member = lambda t, r, role: F.struct(F.lit(t).alias("type"), r.cast("long").alias("ref"), F.lit(role).alias("role"))
    ms = F.filter(
        F.array(
            member("way", F.col("c_custkey"), "outer"), member("node", F.col("c_nationkey"), "label"),
            F.when(F.col("c_custkey") % 3 == 0, member("relation", F.col("c_custkey") + 1, "subarea")),
            F.when(F.col("c_custkey") % 7 == 0, member("relation", F.col("c_custkey") + 2, "part")),
        ),
        lambda m: m.isNotNull(),
    )
    return c.select(F.col("c_custkey").cast("long").alias("id"), ms.alias("members"), extra.alias("tags"))


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """``id, area, xmin, ymin, xmax, ymax``: nations in a 5 by 5 grid, regions (1000 + key) as its columns."""
    from cartolith.functions.columns import box_ring, spherical_area

    n = table(spark, d, "nation")
    x0 = F.lit(-180.0) + F.lit(72.0) * (F.col("n_nationkey") % 5)
    y0 = F.lit(-85.0) + F.lit(34.0) * F.floor(F.col("n_nationkey") / 5)
    nation = n.select(F.col("n_nationkey").cast("long").alias("id"), x0.alias("xmin"), y0.alias("ymin"), (x0 + 72).alias("xmax"), (y0 + 34).alias("ymax"))
    r = table(spark, d, "region")
    rx = F.lit(-180.0) + F.lit(72.0) * F.col("r_regionkey")
    region = r.select((F.col("r_regionkey") + 1000).cast("long").alias("id"), rx.alias("xmin"), F.lit(-85.0).alias("ymin"), (rx + 72).alias("xmax"), F.lit(85.0).alias("ymax"))
    both = nation.unionByName(region)
    return both.withColumn("area", spherical_area(box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))))


def boundaries(spark: SparkSession, d: str) -> DataFrame:
    """The boxes with their shapes, as the boundary table."""
    from cartolith import model
    from cartolith.functions.columns import box_ring

    ring = box_ring(F.col("xmin"), F.col("ymin"), F.col("xmax"), F.col("ymax"))
    shape = F.array(F.struct(ring.alias("outer"), F.expr(f"CAST(array() AS ARRAY<{model.RING}>)").alias("inners")))
    return boxes(spark, d).select("id", "area", "xmin", "ymin", "xmax", "ymax", shape.alias("exact"), shape.alias("over"), F.expr(f"CAST(array() AS ARRAY<{model.POLYGON}>)").alias("under"))


#: The same tables in SQL; put ``WITH`` before and the query after.
SQL = """
nodes AS (
  SELECT p_partkey AS id, ((p_partkey * 37) % 3600)::DOUBLE / 10 - 180 AS lon, ((p_partkey * 53) % 1700)::DOUBLE / 10 - 85 AS lat, p_name, p_brand, p_type FROM part),
ways AS (SELECT o_orderkey AS id, 'C' || o_custkey AS name, o_orderstatus, o_orderpriority FROM orders),
way_refs AS (
  SELECT l_orderkey AS way_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS ord, l_partkey AS ref
  FROM lineitem),
way_coords AS (SELECT way_id, ord, lon, lat FROM way_refs JOIN nodes ON ref = nodes.id),
named_refs AS (SELECT way_id, ord, ref, name FROM way_refs JOIN ways ON way_id = ways.id),
members AS (
  SELECT o_custkey AS rel_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS ord, o_orderkey AS ref,
    CASE o_orderstatus WHEN 'F' THEN '2' WHEN 'O' THEN '0' ELSE '3' END AS role FROM orders),
rels AS (
  SELECT c_custkey AS id, CASE c_custkey % 5 WHEN 0 THEN 'boundary' WHEN 1 THEN 'multipolygon' ELSE 'route' END AS kind,
    c_custkey % 10 = 0 AS admin, c_nationkey % 2 = 0 AS has_level, c_acctbal > 0 AS has_name, c_custkey % 3 = 0 AS subarea, c_custkey % 7 = 0 AS part, c_nationkey
  FROM customer),
boxes AS (
  SELECT n_nationkey::BIGINT AS id, -180.0::DOUBLE + 72 * (n_nationkey % 5) AS xmin, -85.0::DOUBLE + 34 * (n_nationkey // 5) AS ymin,
    -180.0::DOUBLE + 72 * (n_nationkey % 5) + 72 AS xmax, -85.0::DOUBLE + 34 * (n_nationkey // 5) + 34 AS ymax FROM nation
  UNION ALL
  SELECT r_regionkey::BIGINT + 1000, -180.0::DOUBLE + 72 * r_regionkey, -85.0::DOUBLE, -180.0::DOUBLE + 72 * r_regionkey + 72, 85.0::DOUBLE FROM region)
"""


def sql(query: str, recursive: bool = False) -> str:
    """A query over the map tables."""
    more, _, last = query.rpartition("-- select")
    ctes = SQL.strip() + ("," + more.strip().rstrip(",") if more.strip() else "")
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes}\n{last.strip()}"
