"""Strings, tags, graphs, collections and the command line."""

import random

import pytest
from pyspark.sql import functions as F

from cartolith import cli
from cartolith.functions import text
from cartolith.operators import collections as c
from cartolith.operators import graph, spatial, stats, tags
from cartolith.scratch import global_index, materialise

RULES = [
    ("wikidata", "Q1; Q2", ["wd:Q1", "wd:Q2"]), ("wikidata", "", []), ("wikidata", "P1", []), ("brand:wikidata", "Q5", ["wd:Q5"]),
    ("wikipedia", "http://x.org/a b", ["<http://x.org/a_b>"]), ("wikipedia", "de:Ä b", ["wpd:de%3A%C3%84_b"]), ("wikipedia", "http", ["wpd:http"]),
    ("wikipedia:note", "de:x", []), ("wikimedia_commons", "File:x", []), ("is_in", "a b;c;", ['"ab"', '"c"', '""']),
    ("website", "www.x.org/a b", ["<www%2Ex%2Eorg%2Fa_b>"]), ("website", "http", ["<http>"]), ("url", "www", ['"www"']), ("note", "http://x", ['"http://x"']),
    ("name", 'a"b\\c\td\ne\rf', ['"a\\"b\\\\c\\td\\ne\\rf"']), ("name", "~.*ß", ['"~.*ß"']),
]


def test_tag_rules(spark):
    df = spark.createDataFrame([(i, k, v) for i, (k, v, _) in enumerate(RULES)], "i int, k string, v string")
    got = {r.i: r.o for r in df.select("i", text.tag_objects(text.url_encode(F.col("k")), F.col("v")).alias("o")).collect()}
    assert [got[i] for i in range(len(RULES))] == [o for _, _, o in RULES]


def test_strings(spark):
    r = spark.range(1).select(
        text.split_literal(F.lit(";a;;b;"), ";").alias("s"), text.split_literal(F.lit("a.|b"), ".|").alias("d"),
        text.url_encode(F.lit("a b~.*-_ß+%")).alias("u"), text.fixed6(F.lit(53.0749425)).alias("f"), text.fixed6(F.lit(0.0000005)).alias("z"),
    ).first()
    assert r.s == ["", "a", "", "b", ""] and r.d == ["a", "b"] and r.u == "a%20b%7E%2E%2A-_%C3%9F%2B%25" and (r.f, r.z) == ("53.074942", "0.000000")


def test_relation_filters(spark):
    schema = "id long, members array<struct<type:string,ref:long,role:string>>, tags array<struct<k:string,v:string>>"
    admin = [("type", "boundary"), ("boundary", "administrative"), ("admin_level", "2"), ("name", "x")]
    rows = [(1, [("way", 1, "outer"), ("relation", 2, "subarea")], admin), (2, [("relation", 2, "part")], admin), (3, [], admin[:3]), (4, [("relation", 1, "")], [("type", "multipolygon")]), (5, [("changeset", 1, ""), ("node", 1, "")], [])]
    df = spark.createDataFrame(rows, schema)
    assert [r.id for r in tags.administrative_boundaries(df).collect()] == [1]
    multi, other = tags.route_relations(df)
    assert [r.id for r in multi.collect()] == [4] and sorted(r.id for r in other.collect()) == [3, 5]
    assert [(r.ord, r.mtype) for r in tags.relation_members(df).where("rel_id = 5").collect()] == [(0, "n")]
    counts = stats.relation_counts(df).first()
    assert (counts.boundaries, counts.administrative, counts.with_level, counts.with_name, counts.multipolygons, counts.nested, counts.flat, counts.nested_multipolygons) == (3, 3, 3, 2, 1, 3, 2, 1)


def test_components_and_successors(spark):
    rnd = random.Random(4)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(130)] + [(i, i + 1) for i in range(300, 360)]
    parent = list(range(400))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = sorted((root(a), root(b)))
        parent[rb] = ra
    want = {x: root(x) for e in edges for x in e if e[0] != e[1]}
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == want
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(20, 18)], "child int, parent int")
    reach = {(r.child, r.ancestor) for r in graph.successors(chain).collect()}
    assert (0, 20) in reach and (18, 18) in reach and (19, 0) not in reach
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_numbering_is_gapless(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = global_index(df, ["k"], "n").collect()
    assert all(r.k == r.n for r in got) and len(got) == 1000
    assert global_index(df.where("k < 0"), ["k"], "n").count() == 0


def test_unique_with_a_predicate(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 1.05, 3.0, 3.01, None, None, 3.0])], "pos long, v double")
    near = c.unique_consecutive(df, ["v"], lambda a, b: F.abs(a["v"] - b["v"]) < 0.1)
    assert sorted(r.pos for r in near.collect()) == [0, 2, 4, 5, 6]
    assert sorted(r.pos for r in c.unique_consecutive(df, ["v"]).collect()) == [0, 1, 2, 3, 4, 6]


def test_unsorted_runs_are_seen(spark):
    df = spark.createDataFrame([(0, 0, 5), (0, 1, 3), (1, 0, 1)], "run long, run_pos long, v int")
    assert c.unsorted_places(df, "v").first().n == 1


def test_grid_join_equals_all_pairs(spark):
    rnd = random.Random(2)
    boxes = lambda n, most: [(i, *(lambda x, y, w, h: (x, y, x + w, y + h))(rnd.uniform(-180, 170), rnd.uniform(-85, 80), rnd.choice([0, rnd.uniform(0, most)]), rnd.uniform(0, most))) for i in range(n)]
    a, b = boxes(150, 5), boxes(60, 60) + [(99, -180.0, -85.0, 180.0, 85.0)]
    fa = spark.createDataFrame([(str(i), *r) for i, *r in a], "fid string, xmin double, ymin double, xmax double, ymax double")
    fb = spark.createDataFrame(b, "id long, xmin double, ymin double, xmax double, ymax double")
    got = [(r.fid, r.bid) for r in spatial.candidates(fa, fb).collect()]
    want = {(str(x[0]), y[0]) for x in a for y in b if x[1] <= y[3] and y[1] <= x[3] and x[2] <= y[4] and y[2] <= x[4]}
    assert len(got) == len(set(got)) and set(got) == want
    assert spatial.candidates(fa, fb.where("id < 0")).count() == 0


def test_written_tables(spark):
    df = materialise(spark.range(10), "t")
    assert df.count() == 10 and df.dtypes == spark.range(10).dtypes


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from cartolith.scratch import scratch_root

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077", getConf=dict), conf=SimpleNamespace(get=lambda k, d=None: d))
    with pytest.raises(ValueError, match="checkpoint"):
        scratch_root(cluster)


def test_earlier_rounds_are_deleted(spark):
    import os

    from cartolith.operators import graph
    from cartolith.scratch import scratch_path

    home = os.path.dirname(scratch_path(spark, "x"))
    before = {n for n in os.listdir(home) if n.startswith(("stars", "edges"))} if os.path.isdir(home) else set()
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "a long, b long")
    assert {r.root for r in graph.components(chain).collect()} == {0}
    assert len({n for n in os.listdir(home) if n.startswith(("stars", "edges"))} - before) == 1


def test_command_line(tmp_path, capsys):
    source = tmp_path / "m.osm"
    source.write_text("<osm/>")
    good = cli.parse(["-osmpath", str(source), "--ttlpath", f"{tmp_path}/out"])
    assert good.osmpath == str(source) and good.profile == "default"
    assert cli.parse(["-osmpath", "hdfs://store/m.osm.pbf", "-ttlpath", "s3a://bucket/out/graph"]).osmpath == "hdfs://store/m.osm.pbf"
    for bad in ([], ["-osmpath", str(source)], ["-osmpath", "/none", "-ttlpath", f"{tmp_path}/o"], ["-osmpath", str(source), "-ttlpath", "plain"], ["-osmpath", str(source), "-ttlpath", "/no/such/o"], ["-what"]):
        with pytest.raises(SystemExit):
            cli.parse(bad)
    capsys.readouterr()


def test_steps_are_logged(caplog):
    from cartolith.progress import step

    with caplog.at_level("INFO", logger="cartolith"), step("sorting"):
        pass
    assert [m.split(":")[0] for m in caplog.messages] == ["sorting ...", "sorting"]
