"""The whole conversion against a graph worked out by hand."""

import bz2
import glob
import math
from collections import Counter

import pytest

import maps
from cartolith import model
from cartolith.functions import geometry as g
from cartolith.operators import spatial
from cartolith.plans.convert import Conversion, convert, read
from cartolith.sources import osm_pbf

POINTS = {i: "%f %f" % (lon, lat) for i, (lat, lon, _) in maps.ENRICHED[0].items()}


def pairs(refs, mark):
    return mark.join(POINTS[r] for r in refs)


def expected():
    """The enriched extract's lines in the established output: 64."""
    out = []
    for c, (ways, keys) in {13: ([8, 9], 2), 14: ([6, 7], 2), 15: ([10, 11, 12], 3)}.items():
        name = "NameclusterLongerChain" if keys == 3 else "Namecluster"
        shared = {"name": name, "commonkey": "commontag"} | ({"commonkey2": "commontag2"} if keys == 3 else {})
        out += [f'osmway:{c} osmt:{k} "{v}" .' for k, v in shared.items()]
        out += [f"osmway:{c} geof:sfContains osmway:{w} ." for w in ways]
        shape = ",".join(f"LINESTRING({pairs(maps.ENRICHED[1][w][0], ',')})" for w in ways)
        out.append(f'osmway:{c} geo:hasGeometry "GEOMETRYCOLLECTION({shape})"^^geo:wktLiteral .')
    for w, (refs, _) in maps.ENRICHED[1].items():
        closed = len(refs) > 2 and refs[0] == refs[-1]
        told = f"POLYGON(({pairs(refs, ', ')}))" if closed else f"LINESTRING({pairs(refs, ', ')})"
        out.append(f'osmway:{w} geo:hasGeometry "{told}"^^geo:wktLiteral  .')
    for w in (2, 4, 8, 9, 10, 11, 12):
        s = f"osmway:{w}" if w == 4 else f"osmnode:{w}"
        out += [f"{s} geof:sfWithin osmrel:1 .", f"osmrel:1 geof:sfContains {s} .", f"{s} geof:sfIntersects osmrel:1 .", f"osmrel:1 geof:sfIntersects {s} ."]
    for w in (3, 5, 6):
        out += [f"osmway:{w} geof:sfIntersects osmrel:1 .", f"osmrel:1 geof:sfIntersects osmway:{w} ."]
    ring = f"POLYGON(({pairs([1, 2, 3, 4, 1], ',')}))"
    out.append(f'osmrel:1 geo:hasGeometry "GEOMETRYCOLLECTION({ring})"^^geo:wktLiteral .')
    return Counter(out)


def lines(df):
    return Counter(r.line for r in df.collect())


def test_golden(spark, tmp_path):
    path = maps.write_xml(maps.ENRICHED, str(tmp_path / "m.osm"))
    assert sum(expected().values()) == 64
    assert lines(Conversion(read(spark, path), "golden").lines(with_tags=False)) == expected()


@pytest.mark.parametrize("dense", [True, False])
def test_pbf_gives_the_same_tables(spark, tmp_path, dense):
    a = read(spark, maps.write_xml(maps.ENRICHED, str(tmp_path / "m.osm")))
    b = read(spark, maps.write_pbf(maps.ENRICHED, str(tmp_path / "m.pbf"), dense))
    for x, y in ((a.nodes, b.nodes), (a.ways, b.ways), (a.relations, b.relations)):
        assert sorted(map(repr, x.collect())) == sorted(map(repr, y.collect()))


def test_large_files_are_read_in_ranges(spark, tmp_path):
    """A file of many blobs gives many tasks with the same rows."""
    nodes = {i: (50 + i / 1e4, 8 + i / 1e4, {"note": "OSMData" if i % 7 == 0 else "x" * (i % 90)}) for i in range(1, 3001)}
    path = tmp_path / "many.pbf"
    with open(path, "wb") as f:
        for at in range(1, 3001, 50):
            part = {i: nodes[i] for i in range(at, at + 50)}
            f.write(open(maps.write_pbf((part, {at: ([at, at + 1], {"name": "OSMDataOSMData"})}, {}), str(tmp_path / "one"), at % 100 == 1), "rb").read())
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = osm_pbf.read_entities(spark, str(path))
        assert rows.rdd.getNumPartitions() > 5
        got = {r.id: (r.lat, r.lon, r.tags[0].v) for r in osm_pbf.nodes_of(rows).collect()}
        assert got == {i: (pytest.approx(a), pytest.approx(o), t["note"]) for i, (a, o, t) in nodes.items()}
        assert sorted(r.id for r in osm_pbf.ways_of(rows).collect()) == list(range(1, 3001, 50)) and osm_pbf.relations_of(rows).count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_blobs_of_lines():
    content = b"".join(maps.blob(kind, data, False) for kind, data in ((b"OSMHeader", b"h"), (b"OSMData", b"a" * 10), (b"Other", b"zz"), (b"OSMData", b"x" + osm_pbf.DATA + b"y"), (b"OSMData", b"OSMData"), (b"OSMData", b"")))
    got = [osm_pbf.blob_data(x) for x in osm_pbf.blobs_of(iter(content.split(osm_pbf.DATA)))]
    assert got == [b"a" * 10, b"x" + osm_pbf.DATA + b"y", b"OSMData", b""]
    with pytest.raises(ValueError):
        list(osm_pbf.blobs_of(iter(content[:-3].split(osm_pbf.DATA))))


def test_a_boundary_that_holds_most_features(spark):
    """95 % of the features lie in one boundary: its pairs are dealt to many parts, each with the shape once."""
    ring = lambda x0, y0, x1, y1: [{"lon": float(x), "lat": float(y)} for x, y in g.box_polygon((x0, y0, x1, y1))[0]]
    shape = lambda *box: [{"outer": ring(*box), "inners": []}]
    boxes = [(1, (0, 0, 50, 50)), (2, (60, 0, 70, 10)), (3, (10, 10, 12, 12))]
    table = spark.createDataFrame([(i, 1.0, *map(float, box), shape(*box), shape(*box), []) for i, box in boxes], model.BOUNDARIES.replace(": ", " "))
    rows = [(f"p{i}", None, "node", [{"lon": (i * 7 % 500) / 10.0, "lat": (i * 3 % 490) / 10.0}], [], []) for i in range(950)]
    rows += [(f"l{i}", None, "way", [], [[{"lon": 55.0 + i % 10, "lat": 5.0}, {"lon": 62.0, "lat": 5.0}]], []) for i in range(50)]
    features = spark.createDataFrame(rows, spatial.FEATURES.replace(": ", " "))
    got = spatial.relate(features, table, sphere=False, part_pairs=40)
    told = Counter((r.fid, r.bid, r.decision) for r in got.collect())
    want = Counter()
    for fid, _, _, points, lines_, _ in rows:
        for i, (x0, y0, x1, y1) in boxes:
            ends = points or lines_[0]
            inside = [x0 <= p["lon"] <= x1 and y0 <= p["lat"] <= y1 for p in ends]
            if any(inside):
                want[fid, i, "within" if all(inside) else "intersects"] += 1
    assert {k: n for k, n in told.items() if k[2] != "none"} == want
    assert told == Counter((r.fid, r.bid, r.decision) for r in spatial.relate(features, table, sphere=False).collect())
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "repartition" in text.lower()


def test_boxes_of_great_circles():
    x0, y0, x1, y1 = g.spherical_envelope([g.box_polygon((0, 17, 72, 51))])
    assert (x0, y0, x1) == (0, 17, 72) and y1 == pytest.approx(math.degrees(math.atan(math.tan(math.radians(51)) / math.cos(math.radians(36)))))
    assert g.spherical_envelope([g.box_polygon((0, -51, 72, -17))])[1] == pytest.approx(-56.770, abs=0.001)
    assert g.spherical_envelope([([(0, 0), (1, 0), (1, 1), (0, 0)], [])])[3] == pytest.approx(1, abs=1e-9)


def test_default_profile(spark):
    got = lines(Conversion(maps.tables(spark, maps.ENRICHED)).lines(with_tags=False))
    assert got["osmway:2 geof:sfWithin osmrel:1 ."] == 1
    assert not any(line.startswith("osmnode:") for line in got)
    assert not any("  ." in line for line in got)


def test_planar_and_spherical_agree_here(spark):
    x = maps.tables(spark, maps.ENRICHED)
    assert lines(Conversion(x, sphere=False).way_lines()) == lines(Conversion(x).way_lines())


def test_nodes_on_request(spark):
    got = lines(Conversion(maps.tables(spark, maps.ENRICHED), include_nodes=True).node_lines())
    assert got["osmnode:15 geof:sfWithin osmrel:1 ."] == 1
    assert not any("osmnode:16" in line for line in got)


def test_tag_output(spark, tmp_path):
    """24 lines: nine prefixes, three points, twelve tags."""
    source = maps.write_xml(maps.TAGGED, str(tmp_path / "t.osm"))
    counts = convert(spark, source, str(tmp_path / "out"))
    assert (counts["nodes"], counts["ways"], counts["relations"]) == (3, 1, 1)
    parts = sorted(glob.glob(str(tmp_path / "out/part=*/part-*.bz2")))
    got = [line for p in parts for line in bz2.open(p, "rt", encoding="utf-8").read().splitlines()]
    assert len([x for x in got if x.startswith("@prefix")]) == 9
    assert got[0] == "@prefix osmnode: <https://www.openstreetmap.org/node/> ."
    assert 'osmnode:3 osmt:name "Bremen-Neustadt" .' in got
    assert 'osmrel:1000 osmt:type "restriction" .' in got
    assert 'osmway:100 osmt:cycleway%3Aright "track" .' in got
    assert "osmway:100 osmt:wikipedia wpd:de%3ALilienthaler_Heerstra%C3%9Fe ." in got
    assert 'osmnode:1 geo:hasGeometry "POINT(8.786805 53.074942)"^^geo:wktLiteral .' in got
    # All references of the way and the relation dangle: the relation keeps no geometry.
    assert len(got) == 24


def test_only_statistics(spark, tmp_path):
    source = maps.write_xml(maps.ENRICHED, str(tmp_path / "m.osm"))
    counts = convert(spark, source, str(tmp_path / "none"), only_stats=True)
    assert counts["max_way_id"] == 12 and counts["clusters"] == 3 and counts["boundaries"] == 1
    assert not (tmp_path / "none").exists()


def square(i, x0, y0, x1, y1, at):
    """Nodes i.. of a box and their closed reference list."""
    pts = [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
    at.update({i + k: (y, x, {}) for k, (x, y) in enumerate(pts)})
    return [i, i + 1, i + 2, i + 3, i]


ADMIN = {"type": "boundary", "boundary": "administrative", "admin_level": "4"}


def test_relations_with_holes_and_split_rings(spark):
    """Every outer ring gets its own hole; rings split into ways in all directions are joined; kinds are part of a reference."""
    n = {}
    a, b = square(1, 0, 0, 4, 4, n), square(11, 10, 0, 14, 4, n)
    ha, hb = square(21, 1, 1, 2, 2, n), square(31, 11, 1, 12, 2, n)
    ways = {1: (a[:2], {}), 2: (a[3:0:-1][:2], {}), 3: (a[1:3], {}), 4: (a[4:2:-1], {}), 5: (b, {}), 6: (ha, {}), 7: (hb, {}), 8: ([5, 6], {})}
    members = [("way", 1, "outer"), ("way", 2, "outer"), ("way", 3, "outer"), ("way", 4, "outer"), ("way", 5, ""), ("way", 6, "inner"), ("way", 7, "inner"), ("node", 5, "label"), ("way", 8, "x")]
    n[5], n[6] = (20.0, 20.0, {}), (30.0, 30.0, {})
    x = maps.tables(spark, (n, ways, {7: (members, {"type": "multipolygon"})}))
    row = Conversion(x).relation_geometries().first()
    assert row.wkt.startswith("GEOMETRYCOLLECTION(POINT(20.000000 20.000000),POLYGON((")
    assert row.wkt.count("POLYGON") == 2 and row.wkt.count("),(") == 2 and row.wkt.count("LINESTRING(20.000000 20.000000,30.000000 30.000000)") == 1
    assert sorted(len(p.inners) for p in row.polygons) == [1, 1]


def test_dangling_and_single_node_ways(spark):
    n = {1: (0.0, 0.0, {}), 2: (0.0, 1.0, {}), 3: (1.0, 1.0, {})}
    ways = {1: ([1, 99, 2], {}), 2: ([2, 3], {}), 3: ([3], {})}
    got = {r.way_id: len(r.points) for r in Conversion(maps.tables(spark, (n, ways, {}))).way_points().collect()}
    assert got == {1: 2, 2: 2, 3: 1}


def test_nested_and_equal_boundaries(spark):
    """Three nested boundaries, two alike: the closure holds all containers, and no pair of equal areas."""
    n, ways, rels = {}, {}, {}
    for i, (x0, y0, x1, y1) in enumerate([(0, 0, 9, 9), (1, 1, 6, 6), (2, 2, 4, 4), (2, 2, 4, 4)]):
        ways[i + 1] = (square(100 * (i + 1), x0, y0, x1, y1, n), {})
        rels[i + 1] = ([("way", i + 1, "outer")], {**ADMIN, "name": f"B{i}"})
    n[1], n[2] = (3.0, 2.5, {}), (3.0, 3.5, {})
    ways[9] = ([1, 2], {"name": "inside"})
    c = Conversion(maps.tables(spark, (n, ways, rels)))
    assert sorted((r.child, r.parent) for r in c.closure().collect()) == [(2, 1), (3, 1), (3, 2), (4, 1), (4, 2)]
    related = {(r.fid, r.bid): r.decision for r in c.related().collect()}
    assert [related["osmway:9", k] for k in (1, 2, 3, 4)] == ["within"] * 4
    assert ("osmrel:1", 1) not in related and related["osmrel:3", 4] == "within"


def test_subarea_boundaries_contain_but_have_no_geometry(spark):
    n = {}
    ways = {1: (square(1, 0, 0, 4, 4, n), {}), 2: ([50, 51], {"name": "w"})}
    n[50], n[51] = (1.0, 1.0, {}), (2.0, 2.0, {})
    sub = {5: ([("way", 1, "outer"), ("relation", 6, "subarea")], {**ADMIN, "name": "S"}), 6: ([("way", 1, "outer"), ("relation", 5, "part")], {**ADMIN, "name": "P"})}
    c = Conversion(maps.tables(spark, (n, ways, sub)))
    assert [r.id for r in c.boundaries().collect()] == [5]
    assert c.relation_geometries().count() == 0
    assert {(r.fid, r.bid, r.decision) for r in c.related().collect()} == {("osmway:2", 5, "within")}


def test_cluster_without_all_geometries(spark):
    """A cluster with an unresolved way still contains it, but has no geometry."""
    n = {1: (0.0, 0.0, {}), 2: (0.0, 1.0, {})}
    ways = {1: ([1, 2], {"name": "A"}), 2: ([77, 78], {"name": "A"}), 3: ([77, 1], {"name": "A"})}
    c = Conversion(maps.tables(spark, (n, ways, {})))
    got = lines(c.cluster_lines())
    assert got["osmway:4 geof:sfContains osmway:2 ."] == 1 and not any("hasGeometry" in x for x in got)


def test_way_that_crosses_a_round_boundary(spark):
    """A boundary of many points has estimates; a way that leaves it only intersects."""
    import math

    k = 720
    n = {i + 1: (10 + math.sin(2 * math.pi * i / k), 10 + math.cos(2 * math.pi * i / k), {}) for i in range(k)}
    n |= {5001: (10.0, 10.0, {}), 5002: (10.0, 15.0, {}), 5003: (10.2, 10.2, {})}
    ways = {1: ([*range(1, k + 1), 1], {}), 2: ([5001, 5002], {"name": "out"}), 3: ([5001, 5003], {"name": "in"})}
    x = maps.tables(spark, (n, ways, {1: ([("way", 1, "outer")], {**ADMIN, "name": "round"})}))
    b = Conversion(x).boundaries().first()
    assert b.under and len(b.under[0].outer) < k / 2
    exact = {r.fid: r.decision for r in Conversion(x).related().collect()}
    assert exact == {"osmway:2": "intersects", "osmway:3": "within"}
    golden = {r.fid: r.decision for r in Conversion(x, "golden").related().collect()}
    assert golden == {"osmway:2": "within", "osmway:3": "within"}
