"""Map entities as streams: tag triples of what arrives, clusters as soon as they are whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cartolith import model
from cartolith.operators.tags import tag_triples
from cartolith.sources.turtle import lines


def arriving(spark: SparkSession, path: str, schema: str = model.NODES) -> DataFrame:
    """Entities of the Parquet files that arrive in a folder."""
    return spark.readStream.schema(schema.replace(": ", " ")).parquet(path)


def tag_lines(entities: DataFrame, prefix: str) -> DataFrame:
    """Turtle lines of the tags; the same expressions as in batch."""
    return lines(tag_triples(entities, prefix))


def complete_clusters(points: DataFrame, cluster_ways: DataFrame) -> DataFrame:
    """``cluster_id, n_ways`` of clusters whose ways have all arrived (update mode).

    ``points`` is a stream with ``way_id``; ``cluster_ways`` a table of ``cluster_id, way_id``. A
    way that arrives twice counts once.
    """
    size = cluster_ways.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))
    wanted = cluster_ways.join(size, "cluster_id")
    seen = points.select("way_id").join(wanted, "way_id").groupBy("cluster_id", "size").agg(F.size(F.collect_set("way_id")).alias("n_ways"))
    return seen.where("n_ways = size").select("cluster_id", "n_ways")


def write(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Writes lines of all that is there now, then ends; a restart goes on where it stopped."""
    text = stream.select(F.col("line").alias("value"))
    return text.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
