"""What the corpus operators share beside written tables: batches, distributed numbering."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cartolith.scratch import materialise, prepare, scratch_path, scratch_root

__all__ = ["materialise", "prepare", "scratch_path", "scratch_root", "table", "buckets_for", "number_within", "join_spread", "whole_row", "free_name", "map_rows", "give_back"]


def give_back() -> None:
    """Returns memory that this process has freed but still holds to the system."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # glibc only
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def buckets_for(rows: int, width: int) -> int:
    """How many buckets keep ``width`` rows each."""
    return max(1, -(-rows // width))


def number_within(df: DataFrame, group: Sequence[str], order: Sequence[str], into: str, rows: int, width: int = 50_000) -> DataFrame:
    """Numbers the rows of each group from 0 without gaps, in no task more than about ``width`` rows of a group.

    Rows alike in all columns are counted first (with map-side combine) and numbered as one, so a
    row that is repeated without end is one row to the tasks that order; it is multiplied again at
    the end. Distinct rows are dealt to hash buckets of ``order``; a small table of bucket counts
    gives each bucket its base, and the running count is taken inside buckets only. ``rows`` is the
    row count of ``df``, which is read once for each of the two tables, so pass a written one.
    """
    b, base, times = "__num_bucket", "__num_base", "__num_times"
    n = buckets_for(rows, width)
    dealt = df.withColumn(b, F.pmod(F.xxhash64(*order), F.lit(n)))
    keys = [*group, b]
    running = Window.partitionBy(*group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy(*keys).agg(F.count(F.lit(1)).alias(base)).withColumn(base, F.coalesce(F.sum(base).over(running), F.lit(0)))
    own = df.columns
    counted = dealt.groupBy(*own, b).agg(F.count(F.lit(1)).alias(times))
    inner = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    ranked = counted.withColumn(into, F.coalesce(F.sum(times).over(inner), F.lit(0)))
    renamed = bases.select(*[F.col(k).alias(f"__num_{i}") for i, k in enumerate(keys)], base)
    same = [ranked[k].eqNullSafe(renamed[f"__num_{i}"]) for i, k in enumerate(keys)]
    joined = ranked.join(renamed, on=_all(same), how="inner").withColumn(into, F.col(into) + F.col(base))
    one = joined.where(F.col(times) == 1).select(*own, into)
    each = F.explode(F.sequence(F.col(into), F.col(into) + F.col(times) - 1))
    return one.unionByName(joined.where(F.col(times) > 1).select(*own, each.alias(into)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


#: Rows of a key from which on it is joined without a shuffle, and the most keys that are.
HOT_ROWS, MOST_HOT = 50_000, 10_000


def join_spread(many: DataFrame, one: DataFrame, key: str, other: str, rows: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``many`` left-joined with ``one`` (a row a key at most) on ``key`` = ``other``, no key in one task.

    Rows of keys with more than ``max(hot_rows, rows / MOST_HOT)`` rows, so fewer than ``MOST_HOT``
    keys whatever the input, meet their row of ``one`` by a broadcast of those few; the others by a
    shuffle. ``rows`` is the row count of ``many``, which is read more than once, as ``one`` is:
    pass written tables. ``other`` is dropped.
    """
    width = max(hot_rows, -(-rows // MOST_HOT))
    if rows <= width:
        return many.join(one, F.col(key) == F.col(other), "left").drop(other)
    hot = many.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("__hot")).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > width).select("__hot")
    hot = materialise(hot, "hot", "snappy")
    if hot.isEmpty():
        return many.join(one, F.col(key) == F.col(other), "left").drop(other)
    few = F.broadcast(hot.join(one, F.col("__hot") == F.col(other), "left").drop(other))  # fewer than MOST_HOT rows
    straight = many.join(few, F.col(key) == F.col("__hot")).drop("__hot")
    rest = many.join(F.broadcast(hot), F.col(key) == F.col("__hot"), "left_anti").join(one, F.col(key) == F.col(other), "left").drop(other)
    return straight.unionByName(rest)


def whole_row(df: DataFrame) -> Column:
    """All columns of a table as one struct, whatever their names."""
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in df.columns])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or a longer one where a column has it already."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def map_rows(df: DataFrame, change: Callable[[pa.RecordBatch], list[pa.Array]], more: T.StructType | None = None) -> DataFrame:
    """Changes batches of whole rows; ``more`` are fields that follow the table's own.

    ``change`` gives the columns of a batch. Columns travel under plain names, so any name will do.
    """
    fields = [*df.schema.fields, *(more.fields if more else [])]
    plain = T.StructType([T.StructField(f"c{i}", f.dataType) for i, f in enumerate(fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(change(batch), names=[f"c{i}" for i in range(len(fields))])

    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, plain).toDF(*[f.name for f in fields])
