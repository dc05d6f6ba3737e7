"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives, all documents of the training fold the unlabelled
text. A linear model on the presence of words and word beginnings is trained with numpy to
minimise the non-negative risk estimate

    prior * R(positives as positive) + max(0, R(unlabelled as negative) - prior * R(positives as negative))

under the logistic loss, where ``prior`` is the share of toxic text among the unlabelled. When the
negative part falls below zero, the step goes against it, as the method has it. Weights are shrunk
towards zero (proximal steps), so a long text is not toxic for its length.

Fit: on at most ``most_positive`` and ``most_unlabelled`` documents, those with the smallest hash
of ``doc_id``, rows that repeat an id and a text once; scoring covers every document whole. Labels, language, source and ``doc_id`` are no
inputs of a score. The prior is the share of toxic documents among labelled ones of the fold,
unless given.

Edge cases: a null or empty text scores what the model gives a text without features; equal texts
score equal; labels that are null or contradict each other count as toxic if any row says 1; with
no positives every score is the prior; very long texts are scored whole; repeated rows are scored as often as they occur; a null
``doc_id`` is scored and is not held out; an empty table gives no rows; extra columns don't matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.llm.common import free_name, give_back, map_rows, prepare

FEATURES = 1 << 20
PREFIXES = (4, 5, 6)
_WORD = re.compile(r"[^\W\d_]+")
MOST_POSITIVE = 4_000
MOST_UNLABELLED = 8_000
THRESHOLD = 0.7
#: Words a worker remembers.
REMEMBERED = 200_000


def features_of_word(word: str) -> tuple[int, ...]:
    """The features of a lower-case word: itself and its beginnings."""
    told = [word] + [f"^{word[:n]}" for n in PREFIXES if len(word) >= n]
    return tuple(zlib.crc32(t.encode()) & (FEATURES - 1) for t in told)


def words_of(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def features_of(text: str | None) -> np.ndarray:
    """The features present in a text, ascending."""
    return np.array(sorted({f for w in words_of(text) for f in features_of_word(w)}), dtype=np.int32)


@dataclass
class Model:
    """Weights of the features that matter, and the bias."""

    ids: np.ndarray
    weights: np.ndarray
    bias: float

    def scorer(self) -> "Scorer":
        return Scorer(self)


class Scorer:
    """Scores whole texts; remembers which features of a word matter."""

    def __init__(self, model: Model):
        self._weight = dict(zip(model.ids.tolist(), model.weights.tolist()))
        self._bias = model.bias
        self._memo: dict[str, tuple[int, ...]] = {}

    def score(self, text: str | None) -> float:
        memo, weight = self._memo, self._weight
        if len(memo) > REMEMBERED:
            memo.clear()
        present: set[int] = set()
        for w in words_of(text):
            got = memo.get(w)
            if got is None:
                got = memo[w] = tuple(f for f in features_of_word(w) if f in weight)
            if got:
                present.update(got)
        z = self._bias + sum(weight[f] for f in sorted(present))
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


class _Rows:
    """Documents' kept features, ordered both ways: by document and by feature.

    Sums run over neighbours in memory then, which is several times faster than scattering them.
    They are worked through in blocks of about ``block`` entries, so no wide copy of all is made.
    """

    def __init__(self, docs: list[np.ndarray], place: np.ndarray, k: int, block: int = 250_000):
        self.n, self.k = len(docs), k
        cols = [c[c >= 0] for c in (place[d] for d in docs)]
        sizes = np.array([len(c) for c in cols])
        flat = np.concatenate(cols).astype(np.int32, copy=False)
        del cols
        self._by_doc = _blocks(flat, sizes, block)
        rows = np.repeat(np.arange(self.n, dtype=np.int32), sizes)
        counts, at = np.bincount(flat, minlength=k), 0
        ordered = np.empty_like(rows)
        edges = np.searchsorted(np.cumsum(counts), np.arange(0, len(flat) + 1, max(1, 4 * block)))
        for low, high in zip([0, *edges.tolist()], [*edges.tolist(), k]):  # a range of features at a time
            here = np.flatnonzero((flat >= low) & (flat < high))
            ordered[at : at + len(here)] = rows[here[np.argsort(flat[here], kind="stable")]]
            at += len(here)
        del rows
        self._by_feature = _blocks(ordered, counts, block)

    def times(self, w: np.ndarray) -> np.ndarray:
        """The sum of each document's weights."""
        return _sums(self._by_doc, w, self.n)

    def gathered(self, x: np.ndarray) -> np.ndarray:
        """The sum of a document value over the documents of each feature."""
        return _sums(self._by_feature, x, self.k)


def _blocks(flat: np.ndarray, sizes: np.ndarray, block: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(groups with entries, where each begins, entries) of blocks of whole groups; ``sizes`` of the groups in order."""
    full = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[full])
    out, first, done = [], 0, 0
    while first < len(full):
        last = max(first + 1, int(np.searchsorted(ends, done + block, side="right")))
        starts = np.concatenate([[done], ends[first : last - 1]]) - done
        out.append((full[first:last], starts, flat[done : ends[last - 1]]))
        first, done = last, int(ends[last - 1])
    return out


def _sums(blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], x: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros(n)
    for groups, starts, entries in blocks:
        out[groups] = np.add.reduceat(x[entries], starts)
    return out


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[float, float]:
    """(the risk of positives as positive, that of negatives as negative, which may fall below zero), of margins."""
    return prior * float(np.logaddexp(0, -zp).mean()), float(np.logaddexp(0, zu).mean()) - prior * float(np.logaddexp(0, zp).mean())


def slopes(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The step's direction for each margin: the risk's gradient, or, where the negative part is below zero, against that part."""
    as_negative_u, as_negative_p = sigmoid(zu) / len(zu), -prior * sigmoid(zp) / len(zp)
    if risk(zp, zu, prior)[1] >= 0:
        return -prior * sigmoid(-zp) / len(zp) + as_negative_p, as_negative_u
    return -as_negative_p, -as_negative_u


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, steps: int = 400, rate: float = 0.15, shrink: float = 3e-4, full_shrink: int = 1_500, least_documents: int = 3) -> Model:
    """Fits the model by proximal gradient steps on the non-negative risk (Adam scaling).

    ``shrink`` holds from ``full_shrink`` positives on; fewer are noisier and shrink more, with
    the square root.
    """
    if not positive or not unlabelled:
        return Model(np.empty(0, np.int64), np.empty(0), float(np.log(prior / (1 - prior))))
    seen = np.zeros(FEATURES, dtype=np.int32)
    for d in positive:
        seen[d] += 1
    kept = np.flatnonzero(seen >= least_documents)
    place = np.full(FEATURES, -1, dtype=np.int32)
    place[kept] = np.arange(len(kept), dtype=np.int32)
    del seen
    k = len(kept)
    shrink *= max(1.0, full_shrink / len(positive)) ** 0.5
    pos, unl = _Rows(positive, place, k), _Rows(unlabelled, place, k)
    w, bias = np.zeros(k), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for step in range(1, steps + 1):
        gp, gu = slopes(bias + pos.times(w), bias + unl.times(w), prior)
        g = pos.gathered(gp) + unl.gathered(gu)
        gb = float(gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        size = rate / (1 + 4 * step / steps)
        scale = size / (np.sqrt(v / c2) + 1e-5)
        w = w - scale * m / c1
        w = np.sign(w) * np.maximum(0, np.abs(w) - scale * shrink)
        bias -= size * 0.3 * (mb / c1) / (np.sqrt(vb / c2) + 1e-5)
    alive = np.flatnonzero(w)
    return Model(kept[alive].astype(np.int64), w[alive], bias)


def fold(doc_id: Column) -> Column:
    """``crc32(doc_id as text) mod 3``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3


def fit(docs: DataFrame, labels: DataFrame, held_out: int = 1, prior: float | None = None, most_positive: int = MOST_POSITIVE, most_unlabelled: int = MOST_UNLABELLED) -> Model:
    """Fits a model on the rows whose fold is not ``held_out``."""
    prepare(docs.sparkSession)
    known = labels.where(F.coalesce(fold(F.col("doc_id")) != held_out, F.lit(False))).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where("toxic is not null")
    if prior is None:
        told = known.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("y")).first()
        prior = (told.y + 0.5) / (told.n + 1.0)
    prior = min(0.5, max(1e-3, float(prior)))
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("__t")).where(F.coalesce(fold(F.col("doc_id")) != held_out, F.lit(False)))

    def sample(rows: DataFrame, most: int, y: int) -> DataFrame:
        """The rows with the smallest hashes, each (doc_id, text) once: never more than ``most``."""
        chosen = rows.select("doc_id", "__t").distinct().orderBy(F.xxhash64("doc_id"), "__t").limit(most)
        found = own.join(F.broadcast(chosen), ["doc_id", "__t"], "left_semi").dropDuplicates(["doc_id", "__t"])
        return found.select("text", F.lit(y).alias("y"))

    toxic = known.where("toxic = 1").select("doc_id")
    sampled = sample(own.join(toxic, "doc_id", "left_semi"), most_positive, 1).unionByName(sample(own, most_unlabelled, 0))

    def featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features_of(t).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], names=["y", "features"])

    told = sampled.mapInArrow(featurise, "y int, features binary").toArrow().combine_chunks()
    y = told.column("y").to_numpy()
    # Views of the received buffer, in an order that doesn't depend on how tasks ended.
    sets = [np.frombuffer(f.as_buffer(), dtype=np.int32) if f.as_buffer().size else np.empty(0, np.int32) for f in told.column("features")]
    order = sorted(range(len(sets)), key=lambda i: (len(sets[i]), zlib.crc32(sets[i])))
    give_back()
    model = train([sets[i] for i in order if y[i] == 1], [sets[i] for i in order if y[i] == 0], prior)
    del told, sets, y
    give_back()
    return model


def scored(docs: DataFrame, model: Model, score: str = "score") -> DataFrame:
    """``docs`` with a score for each row; columns as they were."""
    spark = docs.sparkSession
    prepare(spark)
    told = spark.sparkContext.broadcast(model)  # at most FEATURES weights
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        if not ready:
            ready.append(told.value.scorer())
        return [*batch.columns, pa.array([ready[0].score(t) for t in batch.column(at).to_pylist()], pa.float64())]

    ready: list[Scorer] = []  # one for each task
    return map_rows(docs, run, T.StructType().add(score, T.DoubleType()))


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = scored(slim, fit(docs, labels)).select("doc_id", F.coalesce(fold(F.col("doc_id")) == 1, F.lit(False)).alias("held_out"), "score")
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def without_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; columns as they were."""
    score = free_name(docs, "toxicity")
    return scored(docs, model, score).where(F.col(score) < threshold).drop(score)
