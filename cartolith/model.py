"""Schemas of the map data model and its vocabulary."""

from __future__ import annotations

TAG = "STRUCT<k: STRING, v: STRING>"
POINT = "STRUCT<lon: DOUBLE, lat: DOUBLE>"
RING = f"ARRAY<{POINT}>"
POLYGON = f"STRUCT<outer: {RING}, inners: ARRAY<{RING}>>"

NODES = f"id BIGINT, lon DOUBLE, lat DOUBLE, tags ARRAY<{TAG}>"
WAYS = f"id BIGINT, refs ARRAY<BIGINT>, tags ARRAY<{TAG}>"
RELATIONS = f"id BIGINT, members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>, tags ARRAY<{TAG}>"
TRIPLES = "s STRING, p STRING, o STRING"
BOUNDARIES = f"id BIGINT, area DOUBLE, xmin DOUBLE, ymin DOUBLE, xmax DOUBLE, ymax DOUBLE, exact ARRAY<{POLYGON}>, over ARRAY<{POLYGON}>, under ARRAY<{POLYGON}>"

# The output vocabulary, in its order.
PREFIXES = [
    ("osmnode:", "https://www.openstreetmap.org/node/"),
    ("osmway:", "https://www.openstreetmap.org/way/"),
    ("osmrel:", "https://www.openstreetmap.org/relation/"),
    ("osmt:", "https://www.wiki.openstreetmap.org/wiki/key:"),
    ("osmwiki:", "https://wiki.openstreetmap.org/wiki/"),
    ("geof:", "http://www.opengis.net/def/function/geosparql/"),
    ("geo:", "http://www.opengis.net/ont/geosparql#"),
    ("wpd:", "https://de.wikipedia.org/wiki/"),
    ("wd:", "http://www.wikidata.org/entity/"),
]
HAS_GEOMETRY = "geo:hasGeometry"
WITHIN, CONTAINS, INTERSECTS = "geof:sfWithin", "geof:sfContains", "geof:sfIntersects"
WKT_LITERAL = "^^geo:wktLiteral"
# Role codes of relation members; any other role is '4'.
ROLE_CODES = {"inner": "0", "subarea": "1", "outer": "2", "": "3"}
MEMBER_CODES = {"node": "n", "way": "w", "relation": "r"}
EARTH_RADIUS = 6371008.8
