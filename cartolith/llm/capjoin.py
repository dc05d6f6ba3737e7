"""Near-duplicate vectors by spherical-cap filters.

A filter is a direction of a random product code: after a seeded rotation the space is cut into two
or three parts, and a direction is one unit code vector of each part, so ``codes`` vectors a part
give ``codes ** parts`` directions. A vector belongs to its ``EACH`` best directions in each of
``REPEATS`` independent codes; they are listed without looking at all of them, since the best sums
come from the best of each part. ``codes`` grows with the largest label, so that vectors that
aren't close share few filters at any size. Vectors below ``SHORT`` components have few directions:
they belong to all that they exceed by ``alpha``, the quantile at which a random vector is in
``filters_each`` filters on average, and at least to their best ones (``least_filters``).

Close vectors share filters; those that share one, within a label, are compared by cosine in
double precision, each pair at its first common filter only. Pairs at exactly 0.98 are missed with a
probability of about 0.0001 (measured for 64 components); tests compare with brute force.

A filter's number and a vector's id travel first; filters of one vector end there, and only vectors
of crowded filters are fetched. A crowded filter is compared in tiles of at most about ``TILE``
times ``TILE`` vectors by a product of matrices, each tile a unit of work of its own, so nothing
caps a filter's members and none meets in one task. A tile gives one row a vector: the number of its
links there, and a vector of its component.

Equal vectors of a label are one class, so copies are compared once; their links are counted, not
listed.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label, link with nothing: they have 0 links and are their own component. Vectors of
different lengths don't link; finite components of any size count (``[1e200, 2e200]``, ``[5e-324]``). Repeated rows are vectors like any other. A null ``vec_id`` is kept
and is never a component's id unless it is alone. Extra columns don't matter; an empty table gives
no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import join_spread, materialise, prepare
from cartolith.operators.graph import components

THRESHOLD = 0.98
CODES = 512
FILTERS_EACH = 32
LEAST_FILTERS = 12
SEED = 20_240_601
#: Best directions of a vector in each code, and the number of codes; vectors below ``SHORT`` components use ``filters_of``.
EACH, REPEATS, SHORT = 8, 3, 16
#: Directions for each vector of a label at least, and the most code vectors of a part.
SPARSE, MOST_CODES = 64, 2048
#: Vectors on a side of a tile, and rows of small filters that are compared at once.
TILE, FEW = 1024, 256


@lru_cache(8)
def code(dim: int, codes: int, filters_each: float, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """(rotation, codes of the first half, of the second half, alpha) for vectors of ``dim``.

    Few dimensions hold few directions, so short vectors have at most ``2 ** dim`` codes a half.
    """
    codes = min(codes, 1 << min(dim, 20))
    rng = np.random.default_rng([seed, dim, codes])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    first = (dim + 1) // 2
    halves = []
    for d in (first, dim - first):
        c = rng.standard_normal((codes, max(1, d)))
        halves.append(c / np.linalg.norm(c, axis=1, keepdims=True) / np.sqrt(2))
    if dim == 1:
        halves[1] *= 0
    probe = rng.standard_normal((256, dim))
    probe /= np.linalg.norm(probe, axis=1, keepdims=True)
    most = min(codes * codes, int(16 * filters_each))
    # The best products of each probe are enough to place the quantile; all of them wouldn't fit.
    best = [np.partition((a[:, None] + b[None, :]).reshape(-1), codes * codes - most)[codes * codes - most :] for a, b in zip(*_halves(probe, rotation, halves[0], halves[1]))]
    every = np.sort(np.concatenate(best))
    alpha = float(every[max(0, len(every) - max(1, int(filters_each * len(probe))))])
    return rotation, halves[0], halves[1], alpha


def _halves(x: np.ndarray, rotation: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    y = x @ rotation
    rest = y[:, one.shape[1] :] if y.shape[1] > one.shape[1] else np.zeros((len(y), two.shape[1]))
    return y[:, : one.shape[1]] @ one.T, rest @ two.T


def filters_of(x: np.ndarray, codes: int = CODES, filters_each: float = FILTERS_EACH, least: int = LEAST_FILTERS, seed: int = SEED) -> list[np.ndarray]:
    """The filters of each row of ``x`` (unit vectors), ascending."""
    rotation, one, two, alpha = code(x.shape[1], codes, filters_each, seed)
    out = []
    for s, t in zip(*_halves(x, rotation, one, two)):
        so, to = np.argsort(-s, kind="stable"), np.argsort(-t, kind="stable")
        ss, ts = s[so], t[to]
        rows = int(np.searchsorted(-ss, -(alpha - ts[0]), side="right"))
        reach = np.searchsorted(-ts, -(alpha - ss[:rows]), side="right")
        if reach.sum() >= least:
            i = np.repeat(np.arange(rows), reach)
            j = np.arange(len(i)) - np.repeat(np.cumsum(reach) - reach, reach)
        else:  # the best pairs lie among the best `least` of each half
            m = min(least, len(ss))
            best = np.argsort(-(ss[:m, None] + ts[None, :m]).reshape(-1), kind="stable")[:least]
            i, j = np.divmod(best, m)
        out.append(np.sort(so[i].astype(np.int64) * len(t) + to[j]))
    return out


def _doubles(raw: list[bytes], kind: str) -> np.ndarray:
    """The rows as doubles, each times the power of two that brings its largest component below 1.

    That is exact, leaves the cosine as it is, and keeps squares of any finite components in range.
    """
    x = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(raw), -1).astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(1, initial=0.0, keepdims=True))[1])


def _unit(raw: list[bytes], kind: str) -> np.ndarray:
    x = _doubles(raw, kind)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


@lru_cache(64)
def product_code(dim: int, most: int, repeat: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """(rotation, code vectors of each part) for vectors of ``dim``, of which a label has up to ``most``."""
    parts = 3 if dim >= 48 else 2
    codes = 32
    while codes**parts < SPARSE * most and codes < MOST_CODES:
        codes *= 2
    rng = np.random.default_rng([SEED, dim, codes, repeat])
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0]
    sizes = [dim // parts + (i < dim % parts) for i in range(parts)]
    vectors = [rng.standard_normal((codes, d)) for d in sizes]
    return rotation, [c / np.linalg.norm(c, axis=1, keepdims=True) for c in vectors]


def _best(s: np.ndarray, each: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest values of each row and their places."""
    at = np.argpartition(-s, each - 1, axis=1)[:, :each] if s.shape[1] > each else np.broadcast_to(np.arange(s.shape[1]), s.shape)
    return np.take_along_axis(s, at, 1), at


def best_filters(x: np.ndarray, most: int, repeat: int, each: int = EACH) -> np.ndarray:
    """The ``each`` best directions of each row of ``x`` (unit vectors) in one code."""
    rotation, vectors = product_code(x.shape[1], most, repeat)
    y = x @ rotation
    total, filters, begin = np.zeros((len(x), 1)), np.zeros((len(x), 1), dtype=np.int64), 0
    for c in vectors:
        s, at = _best(y[:, begin : begin + c.shape[1]] @ c.T, each)
        begin += c.shape[1]
        sums = (total[:, :, None] + s[:, None, :]).reshape(len(x), -1)
        made = (filters[:, :, None] * len(c) + at[:, None, :]).reshape(len(x), -1)
        total, place = _best(sums, each)
        filters = np.take_along_axis(made, place, 1)
    return filters


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit numbers, mixed one to one."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def buckets_of(x: np.ndarray, labels: np.ndarray, most: int) -> list[np.ndarray]:
    """For each row of ``x`` (unit vectors) numbers of its filters, ascending.

    Labels, lengths and codes have numbers of their own, but for chance; vectors are compared after that.
    """
    own = np.asarray(labels, dtype=np.int64).astype(np.uint64) << np.uint64(32) | np.uint64(x.shape[1] << 2)
    if x.shape[1] < SHORT:
        salt = _mixed(own)
        return [np.unique(_mixed(f ^ k).view(np.int64)) for f, k in zip((f.astype(np.uint64) for f in filters_of(x)), salt)]
    made = [_mixed(best_filters(x, most, r).astype(np.uint64) ^ _mixed(own | np.uint64(r))[:, None]) for r in range(REPEATS)]
    return list(np.sort(np.hstack(made).view(np.int64), axis=1))


def _shared(begin: np.ndarray, end: np.ndarray, filters: np.ndarray, below: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether row ``one[i]`` and row ``two[j]`` share a filter whose number is less than their bucket's."""
    rows = np.union1d(one, two)
    size = end[rows] - begin[rows]
    row = np.repeat(np.arange(len(rows)), size)
    value = filters[np.repeat(begin[rows], size) + np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)]
    earlier = value < below[rows][row]
    row, value = row[earlier], value[earlier]
    _, at, n = np.unique(value, return_inverse=True, return_counts=True)
    common = np.cumsum(n > 1) - 1
    row, at = row[n[at] > 1], common[at[n[at] > 1]]
    a, b = np.searchsorted(rows, one), np.searchsorted(rows, two)
    out = np.zeros((len(one), len(two)), dtype=bool)
    for k in range(0, int((n > 1).sum()), 2048):
        here = (at >= k) & (at < k + 2048)
        has = np.zeros((len(rows), 2048), dtype=np.float32)
        has[row[here], at[here] - k] = 1
        out |= has[a] @ has[b].T > 0
    return out


def _roots(hit: np.ndarray) -> np.ndarray:
    """For each node of a symmetric adjacency the first node of its component."""
    root = np.full(len(hit), -1)
    for i in range(len(hit)):
        found = np.array([i]) if root[i] < 0 else np.empty(0, dtype=int)
        while len(found):
            root[found] = i
            found = np.flatnonzero(hit[found].any(0) & (root < 0))
    return root


def _compared(t: pa.Table, spans: list[tuple[int, int]], threshold: float, kind: str) -> list[np.ndarray]:
    """``a, b, links`` of some whole tiles, ``spans`` of the rows of ``t``: one tile of any size, or small ones."""
    column = lambda name: t[name].to_numpy()
    rows = np.concatenate([np.arange(i, j) for i, j in spans])
    tile = np.repeat(np.arange(len(spans)), [j - i for i, j in spans])
    bucket, lo, hi, part, label, dim, ids, copies = (column(n)[rows] for n in ("bucket", "lo", "hi", "part", "label", "dim", "id", "copies"))
    lists = t["filters"].combine_chunks()
    ends = np.cumsum(lists.value_lengths().to_numpy())
    begin, filters = (ends - lists.value_lengths().to_numpy())[rows], lists.flatten().to_numpy()
    end = ends[rows]
    raw = t["raw"].take(pa.array(rows)).to_pylist()
    hit = np.zeros((len(rows), len(rows)), dtype=bool)
    for d in np.unique(dim):
        at = np.flatnonzero(dim == d)
        x = _doubles([raw[i] for i in at], kind)
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        cross = len(spans) == 1 and lo[0] != hi[0]
        one, two = (np.flatnonzero(part[at] == p) for p in (lo[0], hi[0])) if cross else (np.arange(len(at)),) * 2
        cos = unit[one] @ unit[two].T
        p, q = at[one], at[two]
        own = (tile[p][:, None] == tile[q][None, :]) & (label[p][:, None] == label[q][None, :]) & (ids[p][:, None] != ids[q][None, :])
        own &= (lo[p] == hi[p])[:, None] | (part[p][:, None] != part[q][None, :])
        met = own & (cos >= threshold)
        i, j = np.nonzero(own & (np.abs(cos - threshold) < 1e-12))
        met[i, j] = cosine(x[one[i]], x[two[j]]) >= threshold
        i, j = met.any(1), met.any(0)
        if i.any():
            met[np.ix_(i, j)] &= ~_shared(begin, end, filters, bucket, p[i], q[j])
            hit[np.ix_(p, q)] |= met
            hit[np.ix_(q, p)] |= met.T
    linked = np.flatnonzero(hit.any(1))
    hit = hit[np.ix_(linked, linked)]
    return [ids[linked], ids[linked][_roots(hit)], (hit @ copies[linked].astype(np.float64)).astype(np.int64)]


def _tiles(batches: Iterator[pa.RecordBatch], threshold: float, kind: str, tile: int, few: int) -> Iterator[pa.RecordBatch]:
    """Compares tiles, whose rows follow each other."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
    waiting: list[pa.RecordBatch] = []

    def settled(last: bool) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(waiting)
        names = [t[n].to_numpy() for n in ("bucket", "lo", "hi")]
        new = np.zeros(t.num_rows, dtype=bool)
        for x in names:
            new[1:] |= x[1:] != x[:-1]
        starts = [0, *np.flatnonzero(new).tolist(), *([t.num_rows] if last else [])]
        group: list[tuple[int, int]] = []
        groups = [group]
        for span in zip(starts, starts[1:]):
            if group and span[1] - group[0][0] > few:
                groups.append(group := [])
            group.append(span)
        for g in filter(None, groups):
            if (made := _compared(t, g, threshold, kind)) and len(made[0]):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in made], schema=schema)
        waiting[:] = [] if last else t.slice(starts[-1]).to_batches()

    for batch in batches:
        waiting.append(batch)
        if sum(b.num_rows for b in waiting) >= 2 * tile:
            yield from settled(False)
    if waiting:
        yield from settled(True)


def links(classes: DataFrame, threshold: float, kind: str = "<f8", tile: int = TILE, few: int = FEW) -> DataFrame:
    """``a, b, links``: a class, one of its component, and links of ``a`` (copies of the others counted), not all in one row.

    ``classes``: ``id, label, dim, raw`` (components as ``kind``), ``copies, filters``, one row a class, written.
    """
    each = classes.select("id", F.explode(F.array_distinct("filters")).alias("bucket"))
    crowded = each.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    crowded = materialise(crowded.select("bucket", F.ceil(F.col("n") / tile).cast("int").alias("sides")), "cap-crowded", "snappy")
    dealt = each.join(crowded, "bucket").withColumn("part", F.pmod(F.xxhash64("id", "bucket"), F.col("sides")).cast("int"))
    dealt = dealt.withColumn("side", F.explode(F.sequence(F.lit(0), F.col("sides") - 1)))
    dealt = dealt.select("id", "bucket", F.least("part", "side").alias("lo"), F.greatest("part", "side").alias("hi"), "part")
    rows = dealt.join(classes.select("id", "label", "dim", "copies", "raw", "filters"), "id")
    rows = rows.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")
    return rows.mapInArrow(lambda batches: _tiles(batches, threshold, kind, tile, few), "a long, b long, links long")


def cosine(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The cosine of each row pair, in double precision."""
    return np.einsum("ij,ij->i", x, y) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("ij,ij->i", y, y)))


def _packed(column: pa.Array, labels: pa.Array, kind: str) -> list[bytes | None]:
    """The components of each usable vector as bytes."""
    raw: list[bytes | None] = [None] * len(column)
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    size = np.where(labels.is_valid().to_numpy(zero_copy_only=False), size, 0)
    for d in np.unique(size[size > 0]):
        at = np.flatnonzero(size == d)
        values = column.take(pa.array(at)).flatten()
        x = values.cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False).reshape(len(at), d)  # null: nan
        usable = np.isfinite(x).all(1) & x.any(1)
        data, width = x[usable].astype(kind).tobytes(), d * int(kind[-1])
        for n, i in enumerate(at[usable].tolist()):
            raw[i] = data[n * width : (n + 1) * width]
    return raw


def near_vectors(embeddings: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for each row of ``embeddings`` (``vec_id, embedding, label``)."""
    prepare(embeddings.sparkSession)
    kind = "<f4" if embeddings.schema["embedding"].dataType == T.ArrayType(T.FloatType(), embeddings.schema["embedding"].dataType.containsNull) else "<f8"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pa.array(_packed(batch.column(2), batch.column(1), kind), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), raw], names=["vec_id", "label", "raw"])

    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), "embedding").mapInArrow(pack, "vec_id long, label int, raw binary")
    rows = rows.withColumn("key", F.when(F.col("raw").isNotNull(), F.unhex(F.md5(F.concat(F.col("raw"), F.encode(F.col("label").cast("string"), "UTF-8"))))))
    rows = materialise(rows, "cap-rows")
    usable = rows.where("key is not null").withColumn("dim", (F.octet_length("raw") / int(kind[-1])).cast("int"))
    most = usable.groupBy("label", "dim").agg(F.approx_count_distinct("key").alias("n")).agg(F.max("n")).first()[0] or 1

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            labels, dims, raw = np.asarray(batch.column(1)), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            lists: list[np.ndarray] = [np.empty(0, dtype=np.int64)] * len(dims)
            for d in np.unique(dims):
                at = np.flatnonzero(dims == d)
                for i, f in zip(at, buckets_of(_unit([raw[i] for i in at], kind), labels[at], most)):
                    lists[i] = f
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            filters = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists) if lists else np.empty(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, filters], names=["key", "label", "dim", "raw", "copies", "least", "filters"])

    classes = usable.groupBy("key").agg(F.first("label").alias("label"), F.first("dim").alias("dim"), F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least"))
    classes = classes.mapInArrow(decode, "key binary, label int, dim int, raw binary, copies long, least long, filters array<long>")
    classes = materialise(classes.withColumn("id", F.monotonically_increasing_id()), "cap-filters")
    found = materialise(links(classes, threshold, kind), "cap-links", "snappy")
    others = found.groupBy("a").agg(F.sum("links").alias("others"))
    roots = components(found.where("a != b").select("a", "b"))
    member = classes.select("id", "key", "copies", "least").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("root", "id")).drop("node")
    member = materialise(member, "cap-members")
    least = materialise(member.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("component_id")), "cap-roots")
    told = join_spread(member, least, "root", "__root", member.count()).join(others, F.col("id") == F.col("a"), "left")
    told = materialise(told.select(F.col("key").alias("__key"), (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), "component_id"), "cap-told")
    named = rows.select("vec_id", "key")
    out = join_spread(named, told, "key", "__key", rows.count())
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
