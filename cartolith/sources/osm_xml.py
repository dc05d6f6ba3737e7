"""OpenStreetMap XML as three tables.

Each entity is its own scan, so a plan that needs ways only reads ways only. ``.gz`` and ``.bz2``
files are read by Spark's codecs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_TAGS = "tag ARRAY<STRUCT<_k: STRING, _v: STRING>>"
_SCHEMAS = {
    "node": f"_id LONG, _lat DOUBLE, _lon DOUBLE, {_TAGS}",
    "way": f"_id LONG, nd ARRAY<STRUCT<_ref: LONG>>, {_TAGS}",
    "relation": f"_id LONG, member ARRAY<STRUCT<_type: STRING, _ref: LONG, _role: STRING>>, {_TAGS}",
}


def _scan(spark: SparkSession, path: str, entity: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", entity).schema(_SCHEMAS[entity]).load(path)


def _tags() -> object:
    empty = F.array().cast("array<struct<k:string,v:string>>")
    return F.coalesce(F.transform("tag", lambda t: F.struct(t["_k"].alias("k"), F.coalesce(t["_v"], F.lit("")).alias("v"))), empty).alias("tags")


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return _scan(spark, path, "node").select(F.col("_id").alias("id"), F.col("_lon").alias("lon"), F.col("_lat").alias("lat"), _tags())


def read_ways(spark: SparkSession, path: str) -> DataFrame:
    refs = F.coalesce(F.transform("nd", lambda n: n["_ref"]), F.array().cast("array<bigint>"))
    return _scan(spark, path, "way").select(F.col("_id").alias("id"), refs.alias("refs"), _tags())


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    member = lambda m: F.struct(m["_type"].alias("type"), m["_ref"].alias("ref"), F.coalesce(m["_role"], F.lit("")).alias("role"))
    members = F.coalesce(F.transform("member", member), F.array().cast("array<struct<type:string,ref:bigint,role:string>>"))
    return _scan(spark, path, "relation").select(F.col("_id").alias("id"), members.alias("members"), _tags())
