"""Map extracts for tests, from short definitions: written as XML, as PBF, or as tables."""

from __future__ import annotations

import struct
import zlib

from cartolith.plans.fixture import ENRICHED, to_xml

# Two extracts. Nodes: id -> (lat, lon, tags). Ways: id -> (refs, tags). Relations: id -> (members, tags).
TAGGED = (
    {1: (53.0749415, 8.7868047, {}), 2: (53.071932, 8.7840591, {}), 3: (53.070685, 8.7819939, {"highway": "motorway_junction", "name": "Bremen-Neustadt"})},
    {100: ([20958823, 20973902], {"cycleway:right": "track", "highway": "secondary", "lit": "yes", "loc_name": "Langer Jammer", "maxspeed": "50", "name": "Lilienthaler Heerstraße", "oneway": "yes", "surface": "asphalt", "wikipedia": "de:Lilienthaler Heerstraße"})},
    {1000: ([("way", 23619512, ""), ("node", 255856327, "")], {"type": "restriction"})},
)


def write_xml(extract: tuple, path: str) -> str:
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_xml(extract))
    return path


def varint(n: int) -> bytes:
    out = b""
    n &= (1 << 64) - 1
    while n > 0x7F:
        out, n = out + bytes([n & 0x7F | 0x80]), n >> 7
    return out + bytes([n])


def zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def field(no: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return varint(no << 3) + varint(value)
    return varint(no << 3 | 2) + varint(len(value)) + value


def blob(kind: bytes, data: bytes, squeeze: bool) -> bytes:
    body = field(2, len(data)) + field(3, zlib.compress(data)) if squeeze else field(1, data)
    head = field(1, kind) + field(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def write_pbf(extract: tuple, path: str, dense: bool = True) -> str:
    """A file of one header blob and one data blob for each kind of entity."""
    nodes, ways, relations = extract
    strings: dict[str, int] = {"": 0}
    s = lambda x: strings.setdefault(x, len(strings))
    deltas = lambda xs: b"".join(varint(zig(b - a)) for a, b in zip([0, *xs], xs))
    plain = lambda xs: b"".join(map(varint, xs))
    units = lambda v: round(v * 1e7)
    if dense:
        kv = b"".join(plain([x for k, v in t.items() for x in (s(k), s(v))] + [0]) for _, _, t in nodes.values())
        body = field(1, deltas([*nodes])) + field(8, deltas([units(a) for a, _, _ in nodes.values()])) + field(9, deltas([units(o) for _, o, _ in nodes.values()])) + field(10, kv)
        groups = [field(2, body)]
    else:
        groups = [b"".join(field(1, field(1, zig(i)) + field(2, plain([s(k) for k in t])) + field(3, plain([s(v) for v in t.values()])) + field(8, zig(units(a))) + field(9, zig(units(o)))) for i, (a, o, t) in nodes.items())]
    groups.append(b"".join(field(3, field(1, i) + field(2, plain([s(k) for k in t])) + field(3, plain([s(v) for v in t.values()])) + field(8, deltas(r))) for i, (r, t) in ways.items()))
    kinds = {"node": 0, "way": 1, "relation": 2}
    groups.append(b"".join(field(4, field(1, i) + field(2, plain([s(k) for k in t])) + field(3, plain([s(v) for v in t.values()])) + field(8, plain([s(o) for _, _, o in m])) + field(9, deltas([r for _, r, _ in m])) + field(10, plain([kinds[k] for k, _, _ in m]))) for i, (m, t) in relations.items()))
    table = field(1, b"".join(field(1, x.encode()) for x in strings))

    with open(path, "wb") as f:
        f.write(blob(b"OSMHeader", field(4, b"OsmSchema-V0.6"), False))
        for i, g in enumerate(groups):
            f.write(blob(b"OSMData", table + field(2, g), i % 2 == 0))
    return path


def tables(spark, extract: tuple):
    """The extract as the three entity tables."""
    from cartolith import model
    from cartolith.plans.convert import Extract

    nodes, ways, relations = extract
    n = [(i, float(lon), float(lat), [*t.items()]) for i, (lat, lon, t) in nodes.items()]
    w = [(i, refs, [*t.items()]) for i, (refs, t) in ways.items()]
    r = [(i, ms, [*t.items()]) for i, (ms, t) in relations.items()]
    plain = lambda s: s.replace("STRUCT<k: STRING, v: STRING>", "STRUCT<k STRING, v STRING>")
    return Extract(spark.createDataFrame(n, plain(model.NODES)), spark.createDataFrame(w, plain(model.WAYS)), spark.createDataFrame(r, plain(model.RELATIONS)))
