"""MinHash near-dedup with improved consistent weighted sampling.

A document is the weighted set of its five-word shingles (lower case, punctuation dropped; of
shorter texts the one shingle of all words). A shingle's weight is ``(1 + ln tf) * idf``; idf is 1
up to a document share of 1 % and falls to ``IDF_FLOOR`` for a shingle in every document, so
boilerplate counts less. Document counts come from all documents: each task counts shingles in a
table of fixed size, tables are added up, and what chance collisions explain is taken off.

A weight is kept as elements: the first occurrence of a shingle weighs its idf, the ``k``-th adds
``(ln k - ln (k - 1)) * idf``, each a whole number of 250ths in the element's low eight bits. So
an element weighs the same in every document, and the weighted Jaccard similarity of two documents
is the weight of their common elements over that of all.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples: element and level ``(e, t)``
with least ``a = c / (y e^r)``, ``ln y = r (t - beta)``, ``t = floor(ln w / r + beta)``. The draws
``r, c, beta`` come from a seeded table that a hash of element and sample addresses, so ``a`` is a
table look-up. Two documents agree in a sample with the probability of their similarity.

Documents that agree in all samples of a band are candidates. Texts that are equal are one node.
Within a bucket every node is verified against the centre first (a star, never all pairs); the
centre is the node whose own buckets are the fullest, which in a family of copies is one close to
the original. Links are pairs with weighted Jaccard similarity >= the threshold on the whole
texts. A node ``c`` that is not linked to its centre ``a`` is compared further, with the nodes
``b`` of the bucket that it can still be linked to: those of other components, with
``|d(a, c) - d(a, b)| <= 1 - threshold`` (similarity distance is a metric). That comparison is part
of the join's condition, at the first bucket that both are in, so only links come out of it.
Components are found by distributed star contraction; a class is named by its least ``doc_id``.

At similarity 0.8 a pair shares no band with probability 0.0004, at 0.9 with less than 1e-8.

Edge cases: a null text is its own class; empty texts, and texts without words, are alike only
where they are equal; repeated rows are copies; rows with a null ``doc_id`` take part, and name a
class (null) only when all of it is null; extra columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import join_spread, materialise, prepare, whole_row
from cartolith.operators.graph import components

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 5
IDF_FLOOR = 0.7
IDF_FULL_SHARE = 0.01
IDF_STEPS = 16
TABLE_BITS = 18
#: An element's weight is a whole number of this part.
UNIT = 250
POOL_BITS = 14
SEED = 7
#: Bytes of a text that are hashed at once.
BLOCK_BYTES = 1 << 17
#: Open nodes of a bucket that one task compares with the bucket, about.
OPEN_NODES = 500
#: Characters beyond ASCII that belong to no word.
_NO_WORD = re.compile(r"[^\x00-\x7f\w]")


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (the multipliers of splitmix64, fixed values)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@lru_cache(1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(whether a byte belongs to a word, a random 64-bit number for it)."""
    word = np.array([b >= 0x80 or chr(b).isalnum() or b == ord("_") for b in range(256)])
    return word, np.random.default_rng(SEED + 2).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


@lru_cache(1)
def _block_powers() -> tuple[np.ndarray, np.ndarray]:
    return _powers(BLOCK_BYTES)


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number and of its inverse, modulo 2 ** 64."""
    base = 0x9E3779B97F4A7C15
    out = []
    for x in (base, pow(base, -1, 1 << 64)):
        steps = np.full(size, x, dtype=np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash for each word of a text, in order.

    Long texts are hashed in blocks that end between words, so memory grows with the number of words
    only.
    """
    if not text:
        return np.empty(0, np.uint64)
    text = text.lower()
    if not text.isascii():
        text = _NO_WORD.sub(" ", text)
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    if len(data) <= BLOCK_BYTES:
        return _hashes(data)
    out, at, is_word = [], 0, _byte_tables()[0]
    while at < len(data):
        size = BLOCK_BYTES
        while True:
            gaps = np.flatnonzero(~is_word[data[at : at + size]])
            if len(gaps) or at + size >= len(data):
                break
            size *= 2  # one word fills the block
        end = len(data) if at + size >= len(data) else at + int(gaps[-1]) + 1
        out.append(_hashes(data[at:end]))
        at = end
    return np.concatenate(out)


def _hashes(data: np.ndarray) -> np.ndarray:
    """The hashes of all words of some bytes at once.

    Sums of the bytes' random numbers times powers of their places are taken up to each word's ends,
    and the difference is moved to the word's start.
    """
    is_word, numbers = _byte_tables()
    edge = np.diff(is_word[data].view(np.int8), prepend=np.int8(0), append=np.int8(0))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _block_powers() if len(data) <= BLOCK_BYTES else _powers(len(data))
    total = np.empty(len(data) + 1, dtype=np.uint64)
    total[0] = 0
    np.cumsum(numbers[data] * up[: len(data)], out=total[1:])
    return _mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes ascending, how often each occurs)."""
    h = word_hashes(text)
    if not len(h):
        return h, np.empty(0, np.int64)
    n = min(WORDS, len(h))
    out = np.zeros(len(h) - n + 1, dtype=np.uint64)
    for i in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i]
    return np.unique(_mix(out), return_counts=True)


def slot_of(shingle: np.ndarray) -> np.ndarray:
    """A shingle's place in the table of document counts."""
    return (shingle >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


def document_counts(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents by slot of the table, documents) over all of ``docs``; the table has a fixed size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = np.zeros(1 << TABLE_BITS, dtype=np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                # A document counts once in a slot.
                table[np.unique(slot_of(shingles(t)[0]))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([table.tobytes()], pa.binary())], names=["n", "table"])

    parts = docs.select("text").mapInArrow(count, "n long, table binary").rdd.map(lambda r: (r.n, np.frombuffer(bytes(r.table), dtype=np.int64)))
    zero = (0, np.zeros(1 << TABLE_BITS, dtype=np.int64))
    n, table = parts.treeReduce(lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3) if parts.getNumPartitions() else zero
    return table, n


def idf_levels(table: np.ndarray, n: int) -> np.ndarray:
    """The idf step of each slot, 0 (1.0) to ``IDF_STEPS`` (``IDF_FLOOR``).

    A slot's usual load, and four deviations of it, are taken off its count first.
    """
    usual = float(np.median(table))
    df = np.maximum(1.0, table - usual - 4 * np.sqrt(usual))
    share = np.clip(df / max(1, n), 1e-12, 1.0)
    fallen = 1 - np.minimum(1.0, np.log(share) / np.log(IDF_FULL_SHARE))
    # Shingles in few documents are never boilerplate, however small the corpus.
    return np.where(df < 20, 0, np.round(fallen * IDF_STEPS)).astype(np.uint8)


@lru_cache(32)
def _increments(level: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """For an idf step, the occurrences up to ``most`` that add to the rounded weight, and what each adds."""
    k = np.arange(1, most + 1)
    running = np.round((1 - (1 - IDF_FLOOR) * level / IDF_STEPS) * UNIT * (1 + np.log(k))).astype(np.int64)
    more = np.diff(running, prepend=0)
    return k[more > 0], more[more > 0].astype(np.uint64)


def elements_of(text: str | None, levels: np.ndarray) -> np.ndarray:
    """The elements of a text, ascending; the low eight bits are the weight."""
    h, tf = shingles(text)
    if not len(h):
        return np.empty(0, np.int64)
    steps, parts = levels[slot_of(h)], []
    for level in np.unique(steps):
        at = steps == level
        x, most = h[at], tf[at]
        ks, adds = _increments(int(level), 1 << int(most.max() - 1).bit_length())
        n = np.searchsorted(ks, most, "right")
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        x, k = np.repeat(x, n), ks[place].astype(np.uint64)
        x = np.where(k > 1, _mix(x + k), x)
        parts.append((x & np.uint64(0xFFFFFFFFFFFFFF00)) | adds[place])
    return np.unique(np.concatenate(parts)).view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The weighted Jaccard similarity of two documents' elements; 0 where one has none."""
    if not len(a) or not len(b):
        return 0.0
    shared = int((np.intersect1d(a, b, assume_unique=True) & 255).sum())
    return shared / (int((a & 255).sum()) + int((b & 255).sum()) - shared)


@lru_cache(1)
def _draws() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    r, c = rng.gamma(2.0, 1.0, 1 << POOL_BITS), rng.gamma(2.0, 1.0, 1 << POOL_BITS)
    return r, c, rng.uniform(size=1 << POOL_BITS)


@lru_cache(256)
def _row_of_weight(weight: int) -> np.ndarray:
    """For a weight, ``a`` of each draw as bits that sort like it."""
    r, c, beta = _draws()
    t = np.floor(np.log(weight / UNIT) / r + beta)
    a = c / np.exp(r * (t - beta + 1))
    return a.astype(np.float32).view(np.uint32)


@lru_cache(1)
def _sample_hashes() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED + 1)
    n = BANDS * ROWS
    return rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, n, dtype=np.uint64)


def band_keys(docs: list[np.ndarray]) -> list[np.ndarray]:
    """The band keys of each document's elements; none for documents without."""
    out: list[np.ndarray] = [np.empty(0, np.int64)] * len(docs)
    full = [i for i, d in enumerate(docs) if len(d)]
    if not full:
        return out
    starts = np.cumsum([0] + [len(docs[i]) for i in full[:-1]])
    h = np.concatenate([docs[i] for i in full]).view(np.uint64)
    weights, row = np.unique((h & np.uint64(255)).astype(np.uint8), return_inverse=True)
    # A draw's a in the high bits; equal ones are told apart by the element's own bits.
    table = np.concatenate([_row_of_weight(int(v)) for v in weights]).astype(np.uint64) << np.uint64(32)
    base = row.astype(np.int64) << POOL_BITS
    multipliers, addends = _sample_hashes()
    keys = np.empty((len(full), BANDS), dtype=np.uint64)
    x, place, drawn = (np.empty(len(h), dtype=np.uint64) for _ in range(3))
    at = place.view(np.int64)
    for band in range(BANDS):
        key = np.full(len(full), band, dtype=np.uint64)
        for s in range(band * ROWS, (band + 1) * ROWS):
            np.multiply(h, multipliers[s], out=x)
            np.add(x, addends[s], out=x)
            np.right_shift(x, np.uint64(64 - POOL_BITS), out=place)
            np.add(at, base, out=at)
            np.take(table, at, out=drawn, mode="clip")
            np.right_shift(x, np.uint64(16), out=x)
            np.bitwise_and(x, np.uint64(0xFFFFFFFF), out=x)
            np.bitwise_or(drawn, x, out=drawn)
            key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(drawn, starts))
        keys[:, band] = key
    for i, k in zip(full, keys.view(np.int64)):
        out[i] = k
    return out


def signatures(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``doc_id, node, bands`` of each row; ``node`` is the text's md5 (null text: null)."""
    told = docs.sparkSession.sparkContext.broadcast(levels)  # 2 ** TABLE_BITS bytes

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[np.ndarray] = []
            group: list[np.ndarray] = []
            held = 0
            for t in batch.column(1).to_pylist():
                group.append(elements_of(t, told.value))
                held += len(group[-1])
                if held > 60_000:  # what fits a core's cache
                    keys += band_keys(group)
                    group, held = [], 0
            keys += band_keys(group)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "node", "bands"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.unhex(F.md5("text")).alias("node"))
    return slim.mapInArrow(sign, "doc_id long, node binary, bands array<long>")


def nodes_with_elements(docs: DataFrame, nodes: DataFrame, levels: np.ndarray) -> DataFrame:
    """``node, elements, mass`` of the texts whose node is in ``nodes``, each once."""
    told = docs.sparkSession.sparkContext.broadcast(levels)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [elements_of(t, told.value) for t in batch.column(1).to_pylist()]
            mass = [int((e & 255).sum()) for e in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64())), pa.array(mass, pa.int64())], names=["node", "elements", "mass"])

    texts = docs.select(F.unhex(F.md5("text")).alias("node"), "text").join(nodes, "node", "left_semi")
    return texts.groupBy("node").agg(F.first("text").alias("text")).select("node", "text").mapInArrow(weigh, "node binary, elements array<long>, mass long")


def _lists(column: pa.ListArray) -> list[np.ndarray]:
    values, ends = column.values.to_numpy(), column.offsets.to_numpy()
    return [values[a:b] for a, b in zip(ends[:-1], ends[1:])]


def measured(pairs: DataFrame, weighted: DataFrame) -> DataFrame:
    """``pairs`` (``a, b``) with ``sim``, the similarity of the whole texts."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sims = [similarity(x, y) for x, y in zip(_lists(batch.column(2)), _lists(batch.column(3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "sim"])

    x = weighted.select(F.col("node").alias("a"), F.col("elements").alias("wa"))
    y = weighted.select(F.col("node").alias("b"), F.col("elements").alias("wb"))
    joined = pairs.join(y, "b").join(x, "a").select("a", "b", "wa", "wb")
    return joined.mapInArrow(compare, "a binary, b binary, sim double")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(``doc_id, node`` of each row, ``node, root`` of each node that has a link), written tables."""
    prepare(docs.sparkSession)
    levels = idf_levels(*document_counts(docs))
    rows = materialise(signatures(docs, levels), "dup-rows", few=True)
    banded = rows.where("size(bands) > 0").select("node", F.explode("bands").alias("key"))
    # Buckets with at least two different texts; they are summed up before the shuffle.
    buckets = banded.groupBy("key").agg(F.min("node").alias("one"), F.max("node").alias("other"), F.count(F.lit(1)).alias("n")).where("one != other")
    members = materialise(banded.join(buckets.select("key", "n"), "key").distinct(), "dup-members", few=True)
    fullness = members.groupBy("node").agg(F.sum("n").alias("fullness"))
    centres = members.join(fullness, "node").groupBy("key").agg(F.max(F.struct("fullness", "node")).alias("c")).select("key", F.col("c.node").alias("centre"))
    members = materialise(members.select("key", "node").join(centres, "key").where("node != centre"), "dup-centred")
    star = members.select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    nodes = members.select("node").unionByName(members.select(F.col("centre").alias("node"))).distinct()
    weighted = materialise(nodes_with_elements(docs, nodes, levels), "dup-weighted", few=True)
    known = materialise(measured(star, weighted), "dup-star", few=True)
    roots = materialise(components(known.where(F.col("sim") >= threshold)), "dup-roots")
    more = materialise(_further_links(rows, members, known, roots, weighted, threshold), "dup-further")
    joined = components(more).select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    # Roots that the further links join; one without a star of its own is not among the roots yet.
    every = roots.unionByName(joined.join(roots, F.col("__node") == F.col("node"), "left_anti").select(F.col("__node").alias("node"), F.col("__node").alias("root")))
    final = every.join(joined, F.col("root") == F.col("__node"), "left").select("node", F.coalesce("__root", "root").alias("root"))
    return rows.select("doc_id", "node"), materialise(final, "dup-classes")


def _further_links(rows: DataFrame, members: DataFrame, known: DataFrame, roots: DataFrame, weighted: DataFrame, threshold: float) -> DataFrame:
    """``a, b``: links within buckets beyond their centres, as roots of different components."""
    reach = 1 - threshold
    told = members.join(known.select(F.col("a").alias("centre"), F.col("b").alias("node"), "sim"), ["centre", "node"])
    told = materialise(told.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "dup-told")
    # A bucket with many open nodes is compared in as many parts.
    open_ = told.where(F.col("sim") < threshold).groupBy("key").agg(F.ceil(F.count(F.lit(1)) / OPEN_NODES).cast("int").alias("parts"))
    here = told.join(open_, "key")
    wanted = here.select("node").distinct()
    bands = rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("bands").alias("bands"))
    full = bands.join(weighted, "node").withColumnRenamed("node", "__node")
    here = here.select("key", "node", "root", "sim", "parts").join(full, F.col("node") == F.col("__node")).drop("__node")
    earlier = F.expr("slice(bands, 1, array_position(bands, key) - 1)")
    here = materialise(here.withColumn("earlier", earlier.cast("array<long>")).drop("bands"), "dup-here")
    side = lambda df, s: df.select("key", "part", F.col("node").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("root", "sim", "earlier", "elements", "mass")])
    mine = here.where(F.col("sim") < threshold).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    left, other = side(mine, "a"), side(here.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "b")
    near = (F.abs(F.col("sim_a") - F.col("sim_b")) <= reach + 1e-9) & ((F.col("sim_b") >= threshold) | (F.col("a") < F.col("b")))
    first_bucket = ~F.arrays_overlap("earlier_a", "earlier_b")
    shared = F.aggregate(F.array_intersect("elements_a", "elements_b"), F.lit(0).cast("long"), lambda s, e: s + e.bitwiseAND(F.lit(255)))
    linked = shared.cast("double") * (1 + threshold) >= threshold * (F.col("mass_a") + F.col("mass_b")) - 1e-6
    found = left.join(other, (left["key"] == other["key"]) & (left["part"] == other["part"]) & (F.col("root_a") != F.col("root_b")) & near & first_bucket & linked)
    return found.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()


def near_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, class_id, class_rows, kept`` of each row; ``kept`` for one ``doc_id`` of each class.

    ``class_id`` is the least ``doc_id`` of the class.
    """
    rows, roots = classes(docs, threshold)
    told = _class_of_nodes(rows, roots)
    out = join_spread(rows, told, "node", "__node", rows.count())
    class_id = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id"))
    return out.select("doc_id", class_id.alias("class_id"), F.coalesce("class_rows", F.lit(1)).cast("long").alias("class_rows"), F.coalesce(F.col("doc_id") == class_id, F.lit(True)).alias("kept"))


def _class_of_nodes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``__node, class_id, class_rows, first_node`` of each text: rows are counted by text, then texts by class, before they meet."""
    least = lambda d, n: F.min(F.struct(F.col(d).isNull().alias("none"), F.col(d).alias("doc_id"), F.col(n).alias("node")))
    texts = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
    texts = texts.join(roots, "node", "left").withColumn("class", F.coalesce("root", "node")).drop("root")
    texts = materialise(texts, "dup-texts")
    named = texts.groupBy(F.col("class").alias("__class")).agg(least("least", "node").alias("first"), F.sum("n").alias("class_rows"))
    named = materialise(named.select("__class", F.col("first.doc_id").alias("class_id"), F.col("first.node").alias("first_node"), "class_rows"), "dup-named")
    met = join_spread(texts, named, "class", "__class", texts.count())
    return materialise(met.select(F.col("node").alias("__node"), "class_id", "class_rows", "first_node"), "dup-nodes")


def without_copies(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class, the one with the least ``doc_id``; rows with a null text stay. Columns as they were."""
    rows, roots = classes(docs, threshold)
    told = _class_of_nodes(rows, roots)
    # One text of each class, by its least doc_id; the other texts' rows go before anything is shuffled.
    first = told.where("__node = first_node").select(F.col("first_node").alias("__first_node"), F.col("class_id").alias("__first_id"))
    marked = docs.select(whole_row(docs).alias("__row"), F.col("doc_id").cast("long").alias("__id"), F.unhex(F.md5("text")).alias("__node"))
    with_text = marked.where("__node is not null").join(first, F.col("__id").eqNullSafe(F.col("__first_id")) & (F.col("__node") == F.col("__first_node")), "left_semi")
    order = Window.partitionBy("__id", "__node").orderBy(F.lit(0))  # rows alike in both: one stays
    one = with_text.withColumn("__nth", F.row_number().over(order)).where("__nth = 1")
    return one.select("__row.*").unionByName(marked.where("__node is null").select("__row.*"))
