"""Harmonic packing of token sequences.

A document becomes its token ids and an end id, and is cut into pieces whose lengths fill, or
nearly fill, a reciprocal share ``capacity / k`` of a sequence. Pieces of class ``k`` (length in
``(capacity / (k + 1), capacity / k]``) go ``k`` to a sequence, so a class needs no search: a
piece's number within its class gives its sequence. Classes are numbered by workers that each
hold a hash bucket of them; only the open sequence at the end of each class, a bounded rest, is
packed in one task by first fit, longest first.

Cutting: as long as the remainder would leave more than ``slack`` of its share empty, the next
smaller share ``capacity // (k + 1)`` is cut off whole. A remainder of up to ``sqrt(capacity)``
has a class of its own length and is never cut.

Edge cases: a null or empty text is the end id alone; repeated rows are packed as often as they
occur; a null ``doc_id`` is kept; other columns are ignored, whatever their names; an empty table
gives no rows. Texts of any length are tokenized whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import materialise, number_within, prepare
from cartolith.llm.encoding import encoder, grouped

CAPACITY = 4096
SLACK = 0.02

PIECES = "doc_id long, doc_key long, start long, length long, doc_tokens long, class int"


def cut_lengths(total: int, capacity: int = CAPACITY, slack: float = SLACK) -> list[int]:
    """The lengths of a document's pieces, in order."""
    out = [capacity] * (total // capacity)
    rest = total % capacity
    while rest:
        k = capacity // rest
        share = capacity // k
        if rest * rest <= capacity or share - rest <= slack * share:
            out.append(rest)
            break
        out.append(capacity // (k + 1))
        rest -= capacity // (k + 1)
    return out


def pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = CAPACITY, slack: float = SLACK, with_ids: bool = True) -> DataFrame:
    """The pieces of each document with their ids (little-endian unsigned 32 bits), class included.

    Without ids there is ``ids_crc32`` instead, and ids don't leave the Python worker. ``doc_key``
    tells documents apart that share a ``doc_id``: a digest of the text.
    """
    prepare(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in grouped(batches, 1):
            texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
            rows: list[tuple] = []
            for doc, key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), enc.encode(texts)):
                ids = np.frombuffer(ids, dtype=enc.dtype).astype("<u4").tobytes() + end
                total, start = len(ids) // 4, 0
                for n in cut_lengths(total, capacity, slack):
                    part = ids[4 * start : 4 * (start + n)]
                    rows.append((doc, key, start, n, total, capacity // n, part if with_ids else zlib.crc32(part)))
                    start += n
            cols = list(zip(*rows)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary() if with_ids else pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(cols, kinds)], names=["doc_id", "doc_key", "start", "length", "doc_tokens", "class", told])
        enc.settle()

    told = "ids" if with_ids else "ids_crc32"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("doc_key"))
    return slim.mapInArrow(cut, PIECES + (", ids binary" if with_ids else ", ids_crc32 long"))


def first_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of each length, longest first; bins whose room is equal are used in order.

    Bins are kept by the room they have left, so a fit is found among at most ``capacity`` sizes.
    """
    room: dict[int, list[int]] = {}
    used: list[int] = []
    out: list[tuple[int, int]] = [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        fits = [r for r in room if r >= n]
        if fits:
            r = min(fits)
            b = room[r].pop()
            if not room[r]:
                del room[r]
        else:
            b, r = len(used), capacity
            used.append(0)
        out[i] = (b, used[b])
        used[b] += n
        if r > n:
            room.setdefault(r - n, []).append(b)
    return out


def place(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces; all other columns stay.

    ``parts`` is written once, so that numbering sees the same rows each time; pass it without the
    ids where they aren't needed.
    """
    written = materialise(parts, "pieces")
    counts = written.groupBy("class").agg(F.count(F.lit(1)).alias("__class_rows"))
    rows = written.count()
    numbered = number_within(written, ["class"], ["doc_id", "doc_key", "start"], "__index", rows)
    numbered = numbered.join(F.broadcast(counts.withColumnRenamed("class", "__class")), F.col("class") == F.col("__class")).drop("__class")  # at most `capacity` classes
    bin_no = F.floor(F.col("__index") / F.col("class"))
    numbered = numbered.withColumn("__bin", bin_no).withColumn("__open", bin_no == F.floor(F.col("__class_rows") / F.col("class")))
    numbered = materialise(numbered, "numbered")
    before = Window.partitionBy("class", "__bin").orderBy("__index").rowsBetween(Window.unboundedPreceding, -1)
    full = (
        numbered.where(~F.col("__open"))
        .withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
        .withColumn("sequence_id", F.col("__bin") * F.lit(capacity + 1) + F.col("class"))
    )
    rest = numbered.where(F.col("__open"))
    own = [c for c in numbered.columns if not c.startswith("__")]
    schema = rest.select(*own).schema.add("sequence_id", "long").add("offset", "long")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [pa.Table.from_batches([b]) for b in batches]
        if not tables:
            return
        t = pa.concat_tables(tables).sort_by([("class", "ascending"), ("__index", "ascending")])
        spots = first_fit(t.column("length").to_pylist(), capacity)
        t = t.select(own)
        t = t.append_column("sequence_id", pa.array([b * (capacity + 1) for b, _ in spots], pa.int64()))
        t = t.append_column("offset", pa.array([o for _, o in spots], pa.int64()))
        yield from t.to_batches()

    # Of each class fewer than k pieces are left: about capacity * ln(capacity) pieces in all, whatever the input.
    tail = rest.select(*own, "__index").coalesce(1).mapInArrow(fill, schema)
    return full.select(*own, "sequence_id", "offset").unionByName(tail)


def sequences(placed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """The packed sequences: ``sequence_id``, ``ids`` (binary, padded to ``capacity``) and ``n_ids``.

    Needs the column ``ids`` of the pieces.
    """
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(F.transform("__parts", lambda p: p["ids"]), F.lit(b""), lambda a, b: F.concat(a, b))
    pad = np.array([pad_id], dtype="<u4").tobytes()
    filled = F.concat(joined, F.expr(f"substring(repeat_pad, 1, 4 * ({capacity} - n_ids))"))
    out = placed.groupBy("sequence_id").agg(ordered.alias("__parts"), F.sum("length").alias("n_ids"))
    return out.withColumn("repeat_pad", F.lit(pad * capacity)).select("sequence_id", filled.alias("ids"), "n_ids")


def packed_digests(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Where each piece lies, with the crc32 of its ids in place of the ids."""
    parts = pieces(docs, vocabulary, end_id, with_ids=False)
    return place(parts).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def crc32_ids(ids: list[int]) -> int:
    """The crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())
