"""Media payloads in content-defined chunks.

A payload is cut where a rolling gear hash of its last 32 bytes has ``CUT_BITS`` leading zeros,
between a least and a most chunk length; so equal passages give equal chunks wherever they lie.
Chunks are stored once each, by the first 16 bytes of their SHA-256; a payload is the ordered list
of its chunks' digests.

Three tables are written to the shared folder:

* ``alone``: payloads of which no chunk is shared, with their chunks beside the list. They go
  from the reader to the table without a shuffle, and are read back the same way.
* ``lists``: the ordered chunk lists of the other payloads, one row per distinct payload.
* ``chunks``: the distinct chunks of those, deduplicated by digest.

Which chunks may be shared is told by a bitmap of the digests that occur more than once, with 64
bits for each chunk that the input's bytes let expect, up to ``MOST_BITS`` (8 MB, so its broadcast
is bounded). A false hit only sends a payload the longer way, which is the plain join of lists and
chunks. An input with fewer than four bits of that for a chunk (some 80 GB) has no bitmap:
all its payloads go the longer way, and the pass that would fill it isn't made. What is stored and
read back is the same either way. Reading joins lists with chunks on the digest, orders them and
verifies each digest again.

The stored form of a payload is its manifest (magic ``CDC1``, number of chunks, then digest and
length of each) and its chunks as zstandard frames, in order: a function of the payload alone.

Edge cases: a null text is empty; the payload of an empty text is one unit of blanks; equal texts
give equal values; repeated rows give a row each; a null ``doc_id`` is kept; extra columns don't
matter; an empty table gives no rows. A long text is any number of chunks; none is skipped.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import materialise, prepare

UNIT = 192
LEAST, MOST = 1024, 16384
CUT_BITS = 12  # one cut in 4,096 bytes on average, beyond the least length
WINDOW = 32
LEVEL = 3
DIGEST = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26
MAGIC = b"CDC1"

#: The gear table: 32-bit words of SHA-256 of the byte's value.
GEAR = np.array([int.from_bytes(hashlib.sha256(bytes([b])).digest()[:4], "little") for b in range(256)], dtype=np.uint32)


def payload_of(text: str | None) -> bytes:
    """UTF-8 bytes, with blanks up to a positive multiple of the unit."""
    raw = (text or "").encode()
    return raw + b" " * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def gear_hashes(data: bytes) -> np.ndarray:
    """The rolling hash at each byte: the sum of the last 32 gear words, byte ``k`` back shifted by ``k``."""
    h = GEAR[np.frombuffer(data, dtype=np.uint8)]
    step = 1
    while step < WINDOW:
        older = h[:-step] << np.uint32(step)
        h[step:] += older
        step *= 2
    return h


def cut(data: bytes) -> list[int]:
    """The ends of a payload's chunks."""
    n = len(data)
    if n <= LEAST:
        return [n]
    marks = np.flatnonzero(gear_hashes(data) >> np.uint32(32 - CUT_BITS) == 0) + 1
    ends, at = [], 0
    while n - at > LEAST:
        i = int(np.searchsorted(marks, at + LEAST))
        end = int(marks[i]) if i < len(marks) else n
        at = min(end, at + MOST, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(data: bytes) -> list[bytes]:
    out, at = [], 0
    for end in cut(data):
        out.append(data[at:end])
        at = end
    return out


def digest_of(chunk: bytes) -> bytes:
    return hashlib.sha256(chunk).digest()[:DIGEST]


def _bit(digest: bytes, bits: int) -> int:
    return int.from_bytes(digest[:8], "little", signed=True) % bits


def manifest(digests: list[bytes], lengths: list[int]) -> bytes:
    return b"".join([MAGIC, struct.pack("<I", len(digests)), *(d + struct.pack("<I", n) for d, n in zip(digests, lengths))])


def rebuild(digests: list[bytes], frames: list[bytes]) -> tuple[bytes, list[int]]:
    """The payload of stored chunks, each verified, and the chunks' lengths."""
    expand = zstandard.ZstdDecompressor()
    parts = [expand.decompress(f, max_output_size=MOST) for f in frames]
    for d, p in zip(digests, parts, strict=True):
        if digest_of(p) != d:
            raise ValueError("a chunk is not what its digest says")
    return b"".join(parts), [len(p) for p in parts]


def features(payload: bytes, n_chunks: int) -> str:
    """Features of a payload read back: chunks, mean sample, entropy in bits, samples above 127."""
    counts = np.bincount(np.frombuffer(payload, dtype=np.uint8), minlength=256)
    share = counts[counts > 0] / len(payload)
    mean = float((counts * np.arange(256)).sum()) / len(payload)
    entropy = float(-(share * np.log2(share)).sum())
    return f"chunks={n_chunks};mean={mean:.4f};entropy={entropy:.4f};high={int(counts[128:].sum())}"


def describe(digests: list[bytes], frames: list[bytes]) -> tuple:
    """What is told of a stored payload, from its stored chunks alone."""
    payload, lengths = rebuild(digests, frames)
    head = manifest(digests, lengths)
    stored = hashlib.sha256(head)
    for f in frames:
        stored.update(f)
    return (
        len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
        len(head) + sum(map(len, frames)), stored.hexdigest(), features(payload, len(digests)),
    )


_TOLD = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
_TOLD_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
_TOLD_SCHEMA = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _columns(rows: list[tuple], kinds: list[pa.DataType]) -> list[pa.Array]:
    return [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]


def bits_for(docs: DataFrame) -> int:
    """The bitmap's size for the texts of ``docs``: a power of two, 0 where it would be too full to tell anything."""
    told = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("size")).first()
    chunks = told.n + told.size // (LEAST + (1 << CUT_BITS))
    return 0 if 4 * chunks > MOST_BITS else min(MOST_BITS, max(LEAST_BITS, 1 << (64 * chunks).bit_length()))


def shared_bitmap(docs: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of digests that occur more than once in ``docs``: ``bits / 8`` bytes, whatever the input.

    Bits that two different digests share are set as well.
    """

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_bit(digest_of(c), bits) for t in batch.column(0).to_pylist() for c in chunks_of(payload_of(t))]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], names=["bit"])

    seen = docs.select("text").mapInArrow(digests, "bit long").groupBy("bit").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    # Words of 4,096 bits, so at most bits / 4096 rows come to the driver.
    words = seen.groupBy(F.shiftright("bit", 12).alias("word")).agg(F.collect_set((F.col("bit") % 4096).cast("int")).alias("set"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for places in batch.column(1).to_pylist():
                word = np.zeros(4096, dtype=np.uint8)
                word[places] = 1
                out.append(np.packbits(word, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["word", "packed"])

    bitmap = np.zeros(max(1, bits // 4096) * 512, dtype=np.uint8)
    got = words.mapInArrow(pack, "word long, packed binary").toArrow()
    for word, packed in zip(got.column("word").to_pylist(), got.column("packed").to_pylist()):
        bitmap[512 * word : 512 * word + 512] = np.frombuffer(packed, dtype=np.uint8)
    return bitmap


def store(docs: DataFrame, bits: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stores the payloads of ``docs`` (``doc_id``, ``text``): the tables (alone, lists, chunks), written.

    ``bits``: the bitmap's size, 0 for none; by the input's size unless given.

    ``alone``: ``doc_id, n_bytes, digests, frames``. ``lists``: ``doc_id, n_bytes, payload, digests``
    for each row, where ``payload`` is the digest of the list. ``chunks``: ``digest, frame``.
    """
    spark = docs.sparkSession
    prepare(spark)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bits = bits_for(slim) if bits is None else bits
    told = spark.sparkContext.broadcast(shared_bitmap(slim, bits) if bits else None)  # at most MOST_BITS / 8 bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = told.value
        squeeze = zstandard.ZstdCompressor(level=LEVEL)
        sent: set[bytes] = set()  # of this task; a hint only, so it is emptied when large
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = payload_of(text)
                parts = chunks_of(data)
                digests = [digest_of(p) for p in parts]
                n_bytes = len((text or "").encode())
                if bits and not any(bitmap[b >> 3] >> (b & 7) & 1 for b in (_bit(d, bits) for d in digests)):
                    rows.append((doc, n_bytes, None, digests, [squeeze.compress(p) for p in parts], True))
                    continue
                if len(sent) > 100_000:
                    sent.clear()
                new = [(d, p) for d, p in dict(zip(digests, parts)).items() if d not in sent]
                sent.update(d for d, _ in new)
                key = hashlib.sha256(b"".join(digests)).digest()[:DIGEST]
                rows.append((doc, n_bytes, key, digests, None, False))
                rows += [(None, None, None, [d], [squeeze.compress(p)], False) for d, p in new]
            yield pa.RecordBatch.from_arrays(_columns(rows, kinds), names=["doc_id", "n_bytes", "payload", "digests", "frames", "alone"])

    kinds = [pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.bool_()]
    rows = slim.mapInArrow(write, "doc_id long, n_bytes long, payload binary, digests array<binary>, frames array<binary>, alone boolean")
    # One written table with all three kinds of rows, so that texts are cut once.
    written = materialise(rows, "media", "uncompressed")
    alone = written.where("alone").select("doc_id", "n_bytes", "digests", "frames")
    lists = written.where("payload is not null").select("doc_id", "n_bytes", "payload", "digests")
    parts = written.where("not alone and payload is null").select(F.col("digests")[0].alias("digest"), F.col("frames")[0].alias("frame"))
    chunks = materialise(parts.groupBy("digest").agg(F.first("frame").alias("frame")), "media-chunks", "uncompressed")
    return alone, lists, chunks


def read_back(alone: DataFrame, lists: DataFrame, chunks: DataFrame) -> DataFrame:
    """What the stored payloads hold, one row for each stored document."""
    prepare(alone.sparkSession)

    def direct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [describe(d, f) for d, f in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *_columns(got, _TOLD_TYPES)], names=["doc_id", "n_bytes", *_TOLD])

    def ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for key, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                parts.sort(key=lambda p: p["seq"])
                if [p["seq"] for p in parts] != list(range(parts[0]["n"])):
                    raise ValueError("a chunk list is not whole")
                keys.append(key)
                rows.append(describe([p["digest"] for p in parts], [p["frame"] for p in parts]))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), *_columns(rows, _TOLD_TYPES)], names=["payload", *_TOLD])

    straight = alone.select("doc_id", "n_bytes", "digests", "frames").mapInArrow(direct, f"doc_id long, n_bytes long, {_TOLD_SCHEMA}")
    distinct = lists.groupBy("payload").agg(F.first("digests").alias("digests"))
    wanted = distinct.select("payload", F.size("digests").alias("n"), F.posexplode("digests").alias("seq", "digest"))
    bodies = chunks.select(F.col("digest").alias("__digest"), "frame")
    found = wanted.join(bodies, F.col("digest") == F.col("__digest"), "left")
    whole = found.groupBy("payload").agg(F.collect_list(F.struct("seq", "n", "digest", "frame")).alias("parts"))
    told = whole.mapInArrow(ordered, f"payload binary, {_TOLD_SCHEMA}").withColumnRenamed("payload", "__payload")
    joined = lists.select("doc_id", "n_bytes", "payload").join(told, F.col("payload") == F.col("__payload")).drop("payload", "__payload")
    return straight.unionByName(joined)


def stored_media(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """Stores all payloads and returns what is read back."""
    return read_back(*store(docs, bits))
