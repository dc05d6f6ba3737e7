"""Token ids in shuffled planes.

A shard is a range of ``doc_id``; its rows are frames. A frame holds the ids of whole documents,
in order, cut into blocks of a fixed number of ids. Each block is transposed into planes (byte
``i`` of every id together, or bit ``i``), which zstandard compresses one by one: the high bytes
of ids repeat far more than the ids do. The frame's head holds the chunk index: ids and documents
in it, and the length and crc32 of each plane.

Frames are rows of a table in Parquet (uncompressed pages, as planes are compressed already), so
they go to any store that Spark writes to, with its commit protocol: lost executors and repeated
tasks leave no half-written file. A frame decodes by itself, so reading needs no shuffle.

Frame layout, little-endian: magic ``CPL1``, id width in bytes (u8), plane kind (u8: 0 bytes,
1 bits), ids in a block (u32), ids (u64), blocks (u32), planes in a block (u32), documents (u32);
then per block and plane compressed length (u32) and crc32 of the plane (u32); per document its
number of ids (u32); then the planes.

Edge cases: a null or empty text is the end id alone; documents with a null ``doc_id`` come first;
rows alike in ``doc_id`` are ordered by a digest of their text, and repeated rows are kept; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.llm.common import buckets_for, prepare, scratch_path
from cartolith.llm.encoding import encoder, grouped

MAGIC = b"CPL1"
HEAD = struct.Struct("<4sBBIQIII")
BLOCK_IDS = 65_536
FRAME_IDS = 1 << 20
#: Documents a shard holds about.
SHARD_ROWS = 8_000


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """The planes of a block of ids, lowest first."""
    as_bytes = ids.view(np.uint8).reshape(len(ids), ids.dtype.itemsize)
    if kind == "byte":
        return [np.ascontiguousarray(as_bytes[:, i]).tobytes() for i in range(as_bytes.shape[1])]
    bits = np.unpackbits(as_bytes, axis=1, bitorder="little")
    return [np.packbits(bits[:, i], bitorder="little").tobytes() for i in range(bits.shape[1])]


def from_planes(planes: list[bytes], n: int, dtype: np.dtype, kind: str) -> np.ndarray:
    """The ids that ``to_planes`` took apart."""
    if kind == "byte":
        stacked = np.stack([np.frombuffer(p, dtype=np.uint8) for p in planes], axis=1)
    else:
        bits = np.stack([np.unpackbits(np.frombuffer(p, dtype=np.uint8), count=n, bitorder="little") for p in planes], axis=1)
        stacked = np.packbits(bits, axis=1, bitorder="little")
    return np.ascontiguousarray(stacked).reshape(-1).view(dtype)


def encode_frame(ids: np.ndarray, doc_lengths: list[int], kind: str = "byte", block: int = BLOCK_IDS, level: int = 3) -> bytes:
    """A frame of the ids of whole documents."""
    squeeze = zstandard.ZstdCompressor(level=level)
    index, body, blocks = [], [], 0
    for at in range(0, len(ids), block):
        blocks += 1
        for plane in to_planes(ids[at : at + block], kind):
            small = squeeze.compress(plane)
            index += [len(small), zlib.crc32(plane)]
            body.append(small)
    planes = ids.dtype.itemsize * (1 if kind == "byte" else 8)
    head = HEAD.pack(MAGIC, ids.dtype.itemsize, kind == "bit", block, len(ids), blocks, planes, len(doc_lengths))
    return b"".join([head, np.array(index, dtype="<u4").tobytes(), np.array(doc_lengths, dtype="<u4").tobytes(), *body])


def decode_frame(frame: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ids and the documents' lengths of a frame; raises where a plane isn't what was written."""
    magic, width, bits, block, n, blocks, planes, docs = HEAD.unpack_from(frame)
    if magic != MAGIC:
        raise ValueError("not a frame of token planes")
    at = HEAD.size
    index = np.frombuffer(frame, dtype="<u4", count=2 * blocks * planes, offset=at).reshape(-1, 2)
    at += index.nbytes
    lengths = np.frombuffer(frame, dtype="<u4", count=docs, offset=at)
    at += lengths.nbytes
    dtype, kind = np.dtype(f"<u{width}"), "bit" if bits else "byte"
    expand = zstandard.ZstdDecompressor()
    out, k = [], 0
    for b in range(blocks):
        count = min(block, n - b * block)
        got = []
        for _ in range(planes):
            size, crc = index[k]
            plane = expand.decompress(frame[at : at + int(size)], max_output_size=max(1, count))
            if zlib.crc32(plane) != crc:
                raise ValueError("a plane is damaged")
            got.append(plane)
            at += int(size)
            k += 1
        out.append(from_planes(got, count, dtype, kind))
    return (np.concatenate(out) if out else np.empty(0, dtype)), lengths


def write_frames(docs: DataFrame, path: str, vocabulary: str, end_id: int, kind: str = "byte", block: int = BLOCK_IDS, frame_ids: int = FRAME_IDS, shard_rows: int = SHARD_ROWS) -> None:
    """Writes the ids of ``docs`` (``doc_id``, ``text``) in ascending ``doc_id`` order to ``path``."""
    prepare(docs.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        end = np.array([end_id], dtype=enc.dtype).tobytes()
        held: list[bytes] = []
        ids_of: list[int | None] = []
        sizes: list[int] = []
        shard, number = None, 0

        def out() -> pa.RecordBatch:
            frame = encode_frame(np.frombuffer(b"".join(held), dtype=enc.dtype), sizes, kind, block)
            cols = [pa.array([shard], pa.int32()), pa.array([number], pa.int64()), pa.array([sum(sizes)], pa.int64()), pa.array([ids_of], pa.list_(pa.int64())), pa.array([frame], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "frame_no", "n_ids", "doc_ids", "frame"])

        total = 0
        for batch in grouped(batches, 1):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            for doc, part, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), enc.encode(texts)):
                shard = part
                held.append(ids + end)
                ids_of.append(doc)
                sizes.append(len(held[-1]) // enc.width)
                total += sizes[-1]
                if total >= frame_ids:
                    yield out()
                    held, ids_of, sizes, total, number = [], [], [], 0, number + 1
        if held:
            yield out()
        enc.settle()

    order = ["doc_id", "__text_key"]
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("__text_key"))
    n = buckets_for(docs.select("doc_id").count(), shard_rows)
    dealt = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.select("doc_id", "text", F.spark_partition_id().alias("shard")).mapInArrow(frames, "shard int, frame_no long, n_ids long, doc_ids array<long>, frame binary")
    rows.write.option("compression", "uncompressed").parquet(path)


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """The documents of a written path: ``doc_id, start, n_tokens, ids_crc32``, on request ``ids`` (u32).

    ``start`` counts the ids of all documents before: frames are summed within their shard, shards
    (few rows) over all.
    """
    prepare(spark)
    frames = spark.read.schema("shard int, frame_no long, n_ids long, doc_ids array<long>, frame binary").parquet(path)
    index = frames.select("shard", "frame_no", "n_ids")
    shards = index.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    above = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("__s"), F.coalesce(F.sum("n").over(above), F.lit(0)).alias("__shard_base"))
    inside = Window.partitionBy("shard").orderBy("frame_no").rowsBetween(Window.unboundedPreceding, -1)
    bases = index.withColumn("__frame_base", F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).drop("n_ids")
    bases = bases.join(shards, F.col("shard") == F.col("__s")).select(F.col("shard").alias("__s"), F.col("frame_no").alias("__f"), (F.col("__shard_base") + F.col("__frame_base")).alias("__base"))

    def open_frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, docs, frame in zip(*(batch.column(i).to_pylist() for i in range(4))):
                ids, lengths = decode_frame(frame)
                wide = ids.astype("<u4").tobytes()
                starts = np.concatenate([[0], np.cumsum(lengths[:-1], dtype=np.int64)]) if len(lengths) else np.empty(0, np.int64)
                spans = [wide[4 * int(s) : 4 * (int(s) + int(n))] for s, n in zip(starts, lengths)]
                cols = [pa.array([shard] * len(docs), pa.int32()), pa.array([number] * len(docs), pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths.astype(np.int64)), pa.array([zlib.crc32(s) for s in spans], pa.int64())]
                names = ["shard", "frame_no", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.array(spans, pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "shard int, frame_no long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
    docs = frames.select("shard", "frame_no", "doc_ids", "frame").mapInArrow(open_frames, schema)
    placed = docs.join(bases, (F.col("shard") == F.col("__s")) & (F.col("frame_no") == F.col("__f")))
    return placed.select("doc_id", (F.col("start") + F.col("__base")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def stored_documents(docs: DataFrame, vocabulary: str, end_id: int, kind: str = "byte") -> DataFrame:
    """Writes ``docs`` to the shared folder and returns what is read back."""
    path = scratch_path(docs.sparkSession, "token-planes")
    write_frames(docs, path, vocabulary, end_id, kind)
    return read_documents(docs.sparkSession, path)
