"""Streams give what the batch gives."""

from collections import Counter

import maps
from cartolith.operators.tags import tag_triples
from cartolith.sources.turtle import lines
from cartolith.streaming import tags


def test_tag_lines(spark, tmp_path):
    nodes = maps.tables(spark, maps.ENRICHED).nodes
    source, target, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    nodes.where("id < 16").write.parquet(source)
    tags.write(tags.tag_lines(tags.arriving(spark, source), "osmnode:"), target, state).awaitTermination(120)
    nodes.where("id >= 16").write.mode("append").parquet(source)
    tags.write(tags.tag_lines(tags.arriving(spark, source), "osmnode:"), target, state).awaitTermination(120)
    want = Counter(r.line for r in lines(tag_triples(nodes, "osmnode:")).collect())
    assert Counter(r.value for r in spark.read.text(target).collect()) == want and want


def test_clusters_come_out_when_they_are_whole(spark, tmp_path):
    source = str(tmp_path / "points")
    members = spark.createDataFrame([(13, 8), (13, 9), (14, 6), (14, 7)], "cluster_id long, way_id long")
    spark.createDataFrame([(8,), (9,), (6,), (6,)], "way_id long").write.parquet(source)
    stream = spark.readStream.schema("way_id long").parquet(source)
    q = tags.complete_clusters(stream, members).writeStream.format("memory").queryName("whole").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.cluster_id, r.n_ways) for r in spark.table("whole").collect()] == [(13, 2)]
