"""OpenStreetMap PBF as three tables.

A PBF file is a row of independent blobs, each behind a small header that names its kind. Spark's
text source reads the file in byte ranges, from any store, with the header's field that names data
blobs as the line separator: a line is then the rest of a header, its blob, and the size of the next
header. So a file of any size is read by as many tasks as it has ranges, and a task holds one blob
at a time. The separator has control characters that map data doesn't; should a blob have it in its
own bytes nevertheless, it comes as several lines, its length tells, and they are put together again.

Each blob is decoded by itself: zlib, the string table, dense nodes with delta coding, ways and
relations. The decoder reads the wire format directly, as far as the map data needs it. One read
gives all three kinds, as one table with a column ``kind``.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.scratch import prepare

_MEMBER = ("node", "way", "relation")
_TAGS = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
_MEMBERS = pa.list_(pa.struct([("type", pa.string()), ("ref", pa.int64()), ("role", pa.string())]))
_COLUMNS = [("kind", pa.string()), ("id", pa.int64()), ("lon", pa.float64()), ("lat", pa.float64()), ("refs", pa.list_(pa.int64())), ("members", _MEMBERS), ("tags", _TAGS)]
ENTITIES = "kind STRING, id BIGINT, lon DOUBLE, lat DOUBLE, refs ARRAY<BIGINT>, members ARRAY<STRUCT<type: STRING, ref: BIGINT, role: STRING>>, tags ARRAY<STRUCT<k: STRING, v: STRING>>"
#: Fixed value: the first field of the header of a blob with map data, which is the blob's kind.
DATA = b"\x0a\x07OSMData"


def varint(buf: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = buf[at]
        at += 1
        out |= (b & 0x7F) << shift
        if b < 0x80:
            return out, at
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def signed64(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def fields(buf: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message; packed values and sub-messages as bytes."""
    at = 0
    while at < len(buf):
        key, at = varint(buf, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(buf, at)
        elif kind == 2:
            size, at = varint(buf, at)
            value, at = buf[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = buf[at : at + size], at + size
        else:
            raise ValueError("an unknown wire type")
        yield key >> 3, value


def packed(buf: bytes, sign: bool = False) -> list[int]:
    out, at = [], 0
    while at < len(buf):
        v, at = varint(buf, at)
        out.append(zigzag(v) if sign else v)
    return out


def _running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blob_data(blob: bytes) -> bytes:
    """The content of a blob, raw or zlib."""
    got = dict(fields(blob))
    if 1 in got:
        return got[1]  # type: ignore[return-value]
    if 3 in got:
        return zlib.decompress(got[3])  # type: ignore[arg-type]
    raise ValueError("a blob that is neither raw nor zlib")


def decode_block(data: bytes) -> Iterator[tuple]:
    """The entities of a primitive block, as rows of ``ENTITIES``."""
    strings: list[str] = []
    groups: list[bytes] = []
    scale = {17: 100, 19: 0, 20: 0}
    for no, value in fields(data):
        if no == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(value)]  # type: ignore[union-attr,arg-type]
        elif no == 2:
            groups.append(value)  # type: ignore[arg-type]
        elif no in scale:
            scale[no] = signed64(value)  # type: ignore[arg-type]
    degree = lambda offset, v: (offset + scale[17] * v) / 1e9
    pairs = lambda keys, values: [{"k": strings[k], "v": strings[v]} for k, v in zip(keys, values)]
    for group in groups:
        for no, value in fields(group):
            if no == 1:
                f = dict(fields(value))  # type: ignore[arg-type]
                yield "node", zigzag(f[1]), degree(scale[20], zigzag(f[9])), degree(scale[19], zigzag(f[8])), None, None, pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))  # type: ignore[arg-type]
            elif no == 2:
                f = dict(fields(value))  # type: ignore[arg-type]
                ids, lats, lons = (_running(packed(f.get(n, b""), True)) for n in (1, 8, 9))  # type: ignore[arg-type]
                kv, at = packed(f.get(10, b"")), 0  # type: ignore[arg-type]
                for i, lat, lon in zip(ids, lats, lons):
                    tags = []
                    while at < len(kv) and kv[at]:
                        tags.append({"k": strings[kv[at]], "v": strings[kv[at + 1]]})
                        at += 2
                    at += 1
                    yield "node", i, degree(scale[20], lon), degree(scale[19], lat), None, None, tags
            elif no == 3:
                f = dict(fields(value))  # type: ignore[arg-type]
                yield "way", signed64(f[1]), None, None, _running(packed(f.get(8, b""), True)), None, pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))  # type: ignore[arg-type]
            elif no == 4:
                f = dict(fields(value))  # type: ignore[arg-type]
                roles, refs, kinds = packed(f.get(8, b"")), _running(packed(f.get(9, b""), True)), packed(f.get(10, b""))  # type: ignore[arg-type]
                members = [{"type": _MEMBER[k], "ref": r, "role": strings[s]} for s, r, k in zip(roles, refs, kinds)]
                yield "relation", signed64(f[1]), None, None, None, members, pairs(packed(f.get(2, b"")), packed(f.get(3, b"")))  # type: ignore[arg-type]


class _Short(Exception):
    """A line that ends before its blob does."""


def blob_of(line: bytes) -> bytes | None:
    """The data blob that a line begins with; None for what stands before the first one."""
    if line[:1] in (b"", b"\0"):  # the size of a file's first header
        return None
    at, size = 0, None
    while size is None:  # the rest of the header: what follows the kind, up to the blob's size
        key, at = varint(line, at)
        if key >> 3 == 3 and key & 7 == 0:
            size, at = varint(line, at)
        elif key & 7 == 2:
            skip, at = varint(line, at)
            at += skip
        else:
            raise ValueError("not a blob of map data")
    blob, rest = line[at : at + size], line[at + size :]
    if len(blob) < size:
        raise _Short
    while len(rest) not in (0, 4):  # blobs of other kinds in between
        if len(rest) < 4:
            raise _Short
        (head,) = struct.unpack_from(">I", rest)
        told = dict(fields(rest[4 : 4 + head]))
        if 3 not in told or len(rest) < 4 + head + told[3]:
            raise _Short
        rest = rest[4 + head + told[3] :]
    return blob


def blobs_of(lines: Iterator[bytes]) -> Iterator[bytes]:
    """The data blobs of consecutive lines; lines that a blob's own bytes cut are put together."""
    held: bytes | None = None
    for line in lines:
        held = line if held is None else held + DATA + line
        try:
            blob = blob_of(held)
        except (_Short, IndexError):
            continue
        held = None
        if blob is not None:
            yield blob
    if held is not None:
        raise ValueError("a blob is cut: the file is damaged, or a byte range ends inside a blob that holds its own separator (raise spark.sql.files.maxPartitionBytes)")


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """All entities of a file or folder, as ``ENTITIES``, in one read."""
    prepare(spark)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lines = (line for batch in batches for line in batch.column(0).to_pylist())
        for blob in blobs_of(lines):
            rows = list(decode_block(blob_data(blob)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, (_, t) in enumerate(_COLUMNS)], names=[n for n, _ in _COLUMNS])

    lines = spark.read.option("lineSep", DATA.decode()).text(path)
    return lines.select(F.col("value").cast("binary").alias("line")).mapInArrow(decode, ENTITIES)


def nodes_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'node'").select("id", "lon", "lat", "tags")


def ways_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'way'").select("id", "refs", "tags")


def relations_of(entities: DataFrame) -> DataFrame:
    return entities.where("kind = 'relation'").select("id", "members", "tags")
