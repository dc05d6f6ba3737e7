"""K-d tree partitioning of documents into shards of equal bytes.

Documents are points in four metadata dimensions (size, place of ``doc_id``, language, source),
each scaled to 16 bits. A node with ``k`` shards is split along its widest dimension where
``k // 2`` of its ``k`` shares of bytes lie on the left: the weighted median, or the weighted
quantile where ``k`` is odd. All nodes of a level are split at once. The cut is found exactly, by
three histograms of at most 65,536 bins a node (the dimension, then two halves of a hash that
orders equal coordinates), each summed over all documents; no task holds a node.

Documents with equal texts share one point and stay together, as units, unless a unit would weigh
more than ``tolerance`` of a shard: then it is dealt into pieces of about that weight, so one hot
text can't upset the sizes.

Edge cases: a null text weighs 8 bytes and forms one group with the others; very long texts are
measured whole, and one that outweighs a shard has a shard beyond the mean; a null ``doc_id``, language or source is the least
coordinate of its dimension or a value of its own; rows that repeat are sharded as often as they
occur; extra columns don't matter; an empty table gives no rows; shards stay empty when there are
fewer documents than shards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import join_spread, materialise, number_within

DIMENSIONS = ("size", "place", "lang", "source")
TOP = 65_535
OVERHEAD = 8


def size_of(text: str = "text") -> Column:
    """UTF-8 bytes of a text (null: none) and the overhead of a row."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + OVERHEAD


def shards_for(total_bytes: int, target_bytes: int) -> int:
    """The number of leaves at which each has about the target bytes."""
    return max(1, round(total_bytes / target_bytes))


def _scaled(x: Column, least: Column, most: Column) -> Column:
    return F.when(most > least, F.floor((x - least) / (most - least) * TOP)).otherwise(F.lit(0)).cast("long")


def points(docs: DataFrame, shards: int, tolerance: float) -> tuple[DataFrame, DataFrame, int]:
    """(rows with their unit, units with bytes and coordinates, number of rows), both written."""
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), size_of().alias("size"),
        F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b""))).alias("text_crc32"),
        F.coalesce(F.xxhash64("text"), F.lit(0)).alias("text_key"), "lang", "source",
    )
    slim = materialise(slim, "kd-slim")
    log = F.log2(F.col("size").cast("double"))
    all_ = slim.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"), F.min(log).alias("s0"), F.max(log).alias("s1"), F.min("doc_id").alias("d0"), F.max("doc_id").alias("d1")).first()
    weight = max(1.0, tolerance * (all_.b or 0) / shards)
    hashed = lambda c: F.when(F.col(c).isNull(), 0).otherwise(F.pmod(F.xxhash64(c), F.lit(TOP + 1)))
    groups = slim.groupBy("text_key").agg(
        F.greatest(F.lit(1), F.ceil(F.sum("size") / F.lit(weight))).alias("pieces"),
        _scaled(F.min(log), F.lit(all_.s0), F.lit(all_.s1)).alias("c_size"),
        _scaled(F.coalesce(F.min("doc_id"), F.lit(all_.d0)).cast("double"), F.lit(all_.d0).cast("double"), F.lit(all_.d1).cast("double")).alias("c_place"),
        F.min("lang").alias("lang"), F.min("source").alias("source"),
    )
    groups = groups.select(F.col("text_key").alias("__k"), "pieces", "c_size", F.coalesce("c_place", F.lit(0)).alias("c_place"), hashed("lang").alias("c_lang"), hashed("source").alias("c_source"))
    rows = join_spread(slim.drop("lang", "source"), materialise(groups, "kd-groups"), "text_key", "__k", all_.n)
    rows = rows.withColumn("piece", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.col("pieces"))).drop("pieces")
    rows = materialise(rows, "kd-rows")
    coordinates = [f"c_{d}" for d in DIMENSIONS]
    units = rows.groupBy("text_key", "piece").agg(F.sum("size").alias("bytes"), *[F.first(c).alias(c) for c in coordinates])
    units = units.withColumn("tie", F.shiftrightunsigned(F.xxhash64("text_key", "piece"), 32)).withColumn("lo", F.lit(0)).withColumn("k", F.lit(shards))
    return rows, units, all_.n


def _cut_in(rows: DataFrame, bin_: Column, last: bool) -> DataFrame:
    """Of each node the bin in which its share of bytes is reached, with the bytes before it.

    ``rows``: ``lo, goal, before, bytes`` with what ``bin_`` needs. In the ``last`` pass, the bin
    is the one whose end is nearest to the goal (-1: none of them).
    """
    sums = rows.groupBy("lo", bin_.alias("bin")).agg(F.sum("bytes").alias("b"), F.first("goal").alias("goal"), F.first("before").alias("before"))
    up_to = Window.partitionBy("lo").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("end", F.col("before") + F.sum("b").over(up_to)).withColumn("start", F.col("end") - F.col("b"))
    if last:
        near = sums.groupBy("lo").agg(F.min(F.struct(F.abs(F.col("end") - F.col("goal")).alias("off"), "bin")).alias("best"), F.first("before").alias("before"), F.first("goal").alias("goal"))
        none = F.abs(F.col("before") - F.col("goal")) <= F.col("best.off")  # of two cuts equally near, the earlier one
        return near.select(F.col("lo").alias("n_lo"), F.when(none, F.lit(-1)).otherwise(F.col("best.bin")).alias("cut"))
    return sums.where((F.col("start") < F.col("goal")) & (F.col("end") >= F.col("goal"))).select(F.col("lo").alias("n_lo"), F.col("bin").alias("cut"), F.col("start").alias("n_before"))


def split_level(units: DataFrame) -> DataFrame:
    """Splits every node that has more than one shard."""
    open_ = units.where("k > 1")
    spans = [F.struct((F.max(f"c_{d}") - F.min(f"c_{d}")).alias("span"), F.lit(-i).alias("dim")) for i, d in enumerate(DIMENSIONS)]
    nodes = open_.groupBy("lo").agg(F.sum("bytes").alias("__all"), F.first("k").alias("__k"), F.greatest(*spans).alias("__widest"))
    nodes = nodes.select(F.col("lo").alias("n_lo"), (F.col("__all") * F.floor(F.col("__k") / 2) / F.col("__k")).alias("goal"), (-F.col("__widest.dim")).alias("dim"))
    nodes = materialise(nodes, "kd-nodes", "snappy")
    at = F.element_at(F.array(*[f"c_{d}" for d in DIMENSIONS]), (F.col("dim") + 1).cast("int"))
    start = open_.join(nodes, F.col("lo") == F.col("n_lo")).drop("n_lo").withColumn("at", at).withColumn("before", F.lit(0.0))
    high, low = F.shiftright("tie", 16), F.col("tie").bitwiseAND(F.lit(65_535))
    first = materialise(_cut_in(start, F.col("at"), False).withColumnRenamed("cut", "cut_at"), "kd-cut", "snappy")
    inside = start.drop("before").join(first, (F.col("lo") == F.col("n_lo")) & (F.col("at") == F.col("cut_at"))).withColumnRenamed("n_before", "before").drop("n_lo", "cut_at")
    second = materialise(_cut_in(inside, high, False).withColumnRenamed("cut", "cut_high"), "kd-cut", "snappy")
    inner = inside.drop("before").join(second, (F.col("lo") == F.col("n_lo")) & (high == F.col("cut_high"))).withColumnRenamed("n_before", "before").drop("n_lo", "cut_high")
    third = _cut_in(inner, low, True).withColumnRenamed("cut", "cut_low")
    cuts = nodes.join(first.drop("n_before"), "n_lo").join(second.drop("n_before"), "n_lo").join(third, "n_lo").withColumn("cut_tie", F.col("cut_high") * 65_536 + F.col("cut_low"))
    cuts = materialise(cuts.select("n_lo", "dim", "cut_at", "cut_tie"), "kd-cuts", "snappy")
    joined = units.join(cuts, (F.col("lo") == F.col("n_lo")) & (F.col("k") > 1), "left").withColumn("at", at)
    left = (F.col("at") < F.col("cut_at")) | ((F.col("at") == F.col("cut_at")) & (F.col("tie") <= F.col("cut_tie")))
    half = F.floor(F.col("k") / 2).cast("int")
    lo = F.when(F.col("n_lo").isNull() | left, F.col("lo")).otherwise(F.col("lo") + half)
    k = F.when(F.col("n_lo").isNull(), F.col("k")).when(left, half).otherwise(F.col("k") - half)
    kept = [c for c in units.columns if c not in ("lo", "k")]
    return joined.select(*kept, lo.cast("int").alias("lo"), k.cast("int").alias("k"))


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, tolerance: float = 0.01) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row of ``docs``.

    Either the number of shards or their target bytes is given. ``slot`` numbers a shard's rows
    from 0 without gaps.
    """
    if shards is None:
        total = docs.agg(F.coalesce(F.sum(size_of()), F.lit(0)).alias("b")).first().b
        shards = shards_for(total, target_bytes or (128 << 20))
    rows, units, n = points(docs, shards, tolerance)
    units = materialise(units, "kd-units")
    for _ in range((shards - 1).bit_length()):
        units = materialise(split_level(units), "kd-units")
    at = units.select(F.col("text_key").alias("__k"), F.col("piece").alias("__p"), F.col("lo").alias("shard"))
    placed = rows.select("doc_id", "size", "text_crc32", "text_key", "piece").join(at, (F.col("text_key") == F.col("__k")) & (F.col("piece") == F.col("__p")))
    placed = materialise(placed.select("doc_id", "size", "text_crc32", "text_key", "shard"), "kd-placed")
    return number_within(placed, ["shard"], ["doc_id", "text_key"], "slot", n).select("doc_id", "size", "text_crc32", "shard", "slot")
