"""A small map extract and the graph that it converts to in the golden profile."""

from __future__ import annotations

from xml.sax.saxutils import quoteattr

# Nodes: id -> (lat, lon, tags). Ways: id -> (refs, tags). Relations: id -> (members, tags).
_common = {"commonkey": "commontag"}
_long = {"name": "NameclusterLongerChain", **_common, "commonkey2": "commontag2"}
ENRICHED = (
    {
        1: (50.0, 8.0, {}), 2: (50.0, 9.0, {}), 3: (51.0, 9.0, {}), 4: (51.0, 8.0, {}), 5: (50.02, 8.02, {}), 6: (50.03, 8.03, {}),
        7: (50.88, 8.8, {}), 8: (51.01, 8.8, {}), 9: (50.05, 8.05, {}), 10: (50.05, 8.06, {}), 11: (50.06, 8.06, {}), 12: (50.8, 8.8, {}),
        13: (51.01, 8.8, {}), 14: (51.01, 9.1, {}), 15: (50.070685, 8.7819939, {"name": "NodeInside"}), 16: (53.070685, 8.7819939, {"name": "NodeOutside"}),
    },
    {
        1: ([1, 2, 3, 4, 1], {}), 2: ([5, 6], {"name": "WayInside"}), 3: ([7, 8], {"name": "WayNotEnclosed"}),
        4: ([9, 10, 11, 9], {"name": "PolygonEnclosed"}), 5: ([12, 13, 14, 12], {"name": "PolygonNotEnclosed"}),
        6: ([12, 13], {"name": "Namecluster", **_common, "ownkey": "a"}), 7: ([13, 14], {"name": "Namecluster", **_common, "ownkey": "b"}),
        8: ([1, 2], {"name": "Namecluster", **_common, "ownkey": "a"}), 9: ([2, 3], {"name": "Namecluster", **_common, "ownkey": "b"}),
        10: ([1, 2, 3], {**_long, "ownkey": "a"}), 11: ([3, 4], {**_long, "ownkey": "b"}), 12: ([4, 5, 6], {**_long, "ownkey": "b"}),
    },
    {1: ([("way", 1, "outer")], {"type": "boundary", "boundary": "administrative", "admin_level": "5", "name": "Perimeter"})},
)


def to_xml(extract: tuple) -> str:
    """An extract as an OSM document."""
    tags = lambda t: "".join(f"<tag k={quoteattr(k)} v={quoteattr(v)}/>" for k, v in t.items())
    nodes, ways, relations = extract
    out = ['<?xml version="1.0" encoding="UTF-8"?>', '<osm version="0.6">']
    out += [f'<node id="{i}" lat="{lat!r}" lon="{lon!r}">{tags(t)}</node>' for i, (lat, lon, t) in nodes.items()]
    out += [f'<way id="{i}">' + "".join(f'<nd ref="{r}"/>' for r in refs) + tags(t) + "</way>" for i, (refs, t) in ways.items()]
    out += [f'<relation id="{i}">' + "".join(f'<member type="{k}" ref="{r}" role="{o}"/>' for k, r, o in ms) + tags(t) + "</relation>" for i, (ms, t) in relations.items()]
    return "\n".join([*out, "</osm>"])


#: The established output for the extract.
GOLDEN_LINES = [
    'osmnode:10 geof:sfIntersects osmrel:1 .',
    'osmnode:10 geof:sfWithin osmrel:1 .',
    'osmnode:11 geof:sfIntersects osmrel:1 .',
    'osmnode:11 geof:sfWithin osmrel:1 .',
    'osmnode:12 geof:sfIntersects osmrel:1 .',
    'osmnode:12 geof:sfWithin osmrel:1 .',
    'osmnode:2 geof:sfIntersects osmrel:1 .',
    'osmnode:2 geof:sfWithin osmrel:1 .',
    'osmnode:8 geof:sfIntersects osmrel:1 .',
    'osmnode:8 geof:sfWithin osmrel:1 .',
    'osmnode:9 geof:sfIntersects osmrel:1 .',
    'osmnode:9 geof:sfWithin osmrel:1 .',
    'osmrel:1 geo:hasGeometry "GEOMETRYCOLLECTION(POLYGON((8.000000 50.000000,9.000000 50.000000,9.000000 51.000000,8.000000 51.000000,8.000000 50.000000)))"^^geo:wktLiteral .',
    'osmrel:1 geof:sfContains osmnode:10 .',
    'osmrel:1 geof:sfContains osmnode:11 .',
    'osmrel:1 geof:sfContains osmnode:12 .',
    'osmrel:1 geof:sfContains osmnode:2 .',
    'osmrel:1 geof:sfContains osmnode:8 .',
    'osmrel:1 geof:sfContains osmnode:9 .',
    'osmrel:1 geof:sfContains osmway:4 .',
    'osmrel:1 geof:sfIntersects osmnode:10 .',
    'osmrel:1 geof:sfIntersects osmnode:11 .',
    'osmrel:1 geof:sfIntersects osmnode:12 .',
    'osmrel:1 geof:sfIntersects osmnode:2 .',
    'osmrel:1 geof:sfIntersects osmnode:8 .',
    'osmrel:1 geof:sfIntersects osmnode:9 .',
    'osmrel:1 geof:sfIntersects osmway:3 .',
    'osmrel:1 geof:sfIntersects osmway:4 .',
    'osmrel:1 geof:sfIntersects osmway:5 .',
    'osmrel:1 geof:sfIntersects osmway:6 .',
    'osmway:1 geo:hasGeometry "POLYGON((8.000000 50.000000, 9.000000 50.000000, 9.000000 51.000000, 8.000000 51.000000, 8.000000 50.000000))"^^geo:wktLiteral  .',
    'osmway:10 geo:hasGeometry "LINESTRING(8.000000 50.000000, 9.000000 50.000000, 9.000000 51.000000)"^^geo:wktLiteral  .',
    'osmway:11 geo:hasGeometry "LINESTRING(9.000000 51.000000, 8.000000 51.000000)"^^geo:wktLiteral  .',
    'osmway:12 geo:hasGeometry "LINESTRING(8.000000 51.000000, 8.020000 50.020000, 8.030000 50.030000)"^^geo:wktLiteral  .',
    'osmway:13 geo:hasGeometry "GEOMETRYCOLLECTION(LINESTRING(8.000000 50.000000,9.000000 50.000000),LINESTRING(9.000000 50.000000,9.000000 51.000000))"^^geo:wktLiteral .',
    'osmway:13 geof:sfContains osmway:8 .',
    'osmway:13 geof:sfContains osmway:9 .',
    'osmway:13 osmt:commonkey "commontag" .',
    'osmway:13 osmt:name "Namecluster" .',
    'osmway:14 geo:hasGeometry "GEOMETRYCOLLECTION(LINESTRING(8.800000 50.800000,8.800000 51.010000),LINESTRING(8.800000 51.010000,9.100000 51.010000))"^^geo:wktLiteral .',
    'osmway:14 geof:sfContains osmway:6 .',
    'osmway:14 geof:sfContains osmway:7 .',
    'osmway:14 osmt:commonkey "commontag" .',
    'osmway:14 osmt:name "Namecluster" .',
    'osmway:15 geo:hasGeometry "GEOMETRYCOLLECTION(LINESTRING(8.000000 50.000000,9.000000 50.000000,9.000000 51.000000),LINESTRING(9.000000 51.000000,8.000000 51.000000),LINESTRING(8.000000 51.000000,8.020000 50.020000,8.030000 50.030000))"^^geo:wktLiteral .',
    'osmway:15 geof:sfContains osmway:10 .',
    'osmway:15 geof:sfContains osmway:11 .',
    'osmway:15 geof:sfContains osmway:12 .',
    'osmway:15 osmt:commonkey "commontag" .',
    'osmway:15 osmt:commonkey2 "commontag2" .',
    'osmway:15 osmt:name "NameclusterLongerChain" .',
    'osmway:2 geo:hasGeometry "LINESTRING(8.020000 50.020000, 8.030000 50.030000)"^^geo:wktLiteral  .',
    'osmway:3 geo:hasGeometry "LINESTRING(8.800000 50.880000, 8.800000 51.010000)"^^geo:wktLiteral  .',
    'osmway:3 geof:sfIntersects osmrel:1 .',
    'osmway:4 geo:hasGeometry "POLYGON((8.050000 50.050000, 8.060000 50.050000, 8.060000 50.060000, 8.050000 50.050000))"^^geo:wktLiteral  .',
    'osmway:4 geof:sfIntersects osmrel:1 .',
    'osmway:4 geof:sfWithin osmrel:1 .',
    'osmway:5 geo:hasGeometry "POLYGON((8.800000 50.800000, 8.800000 51.010000, 9.100000 51.010000, 8.800000 50.800000))"^^geo:wktLiteral  .',
    'osmway:5 geof:sfIntersects osmrel:1 .',
    'osmway:6 geo:hasGeometry "LINESTRING(8.800000 50.800000, 8.800000 51.010000)"^^geo:wktLiteral  .',
    'osmway:6 geof:sfIntersects osmrel:1 .',
    'osmway:7 geo:hasGeometry "LINESTRING(8.800000 51.010000, 9.100000 51.010000)"^^geo:wktLiteral  .',
    'osmway:8 geo:hasGeometry "LINESTRING(8.000000 50.000000, 9.000000 50.000000)"^^geo:wktLiteral  .',
    'osmway:9 geo:hasGeometry "LINESTRING(9.000000 50.000000, 9.000000 51.000000)"^^geo:wktLiteral  .',
]
