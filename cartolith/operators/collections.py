"""Bulk collections and streams as tables: sorts, runs, zips, queues, maps, matrices.

A sequence is a table with a position column (``pos``, from 0). Positions come from a range
partitioning (``scratch.global_index``), never from a single-task sort; streams that are zipped are
joined on their positions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartolith.scratch import global_index, materialise

# ---------------------------------------------------------------- streams


def streamify(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A stream of driver-side rows."""
    return spark.createDataFrame(list(rows), schema)


def generate(spark: SparkSession, n: int, value: Callable[[Column], Column], name: str = "v") -> DataFrame:
    """``pos`` and a generated value of it."""
    return spark.range(n).select(F.col("id").alias("pos"), value(F.col("id")).alias(name))


def materialised(df: DataFrame, most: int | None = None) -> DataFrame:
    """A stream written to a table; bounded to the first ``most`` positions on request."""
    return materialise(df if most is None else df.where(F.col("pos") < most), "stream")


def discard(df: DataFrame) -> None:
    """Runs a stream to its end and keeps nothing."""
    df.write.format("noop").mode("overwrite").save()


def positioned(df: DataFrame, order: Sequence[str | Column], into: str = "pos") -> DataFrame:
    """Numbers a stream in a total order."""
    return global_index(df, list(order), into)


def zip_streams(*streams: DataFrame) -> DataFrame:
    """``pos`` and one struct a stream (``c1``, ``c2``, ...): rows of equal positions, up to the shortest."""
    out = None
    for i, s in enumerate(streams, 1):
        one = s.select("pos", F.struct(*[c for c in s.columns if c != "pos"]).alias(f"c{i}"))
        out = one if out is None else out.join(one, "pos")
    if out is None:
        raise ValueError("nothing to zip")
    return out


def transform(zipped: DataFrame, into: str, f: Callable[..., Column]) -> DataFrame:
    """Applies a function to the components of a zip."""
    parts = [F.col(c) for c in zipped.columns if c != "pos"]
    return zipped.select("pos", f(*parts).alias(into))


def choose(zipped: DataFrame, k: int) -> DataFrame:
    """Component ``k`` (from 1) of a zip."""
    return zipped.select("pos", f"c{k}.*")


def _neighbours(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row with the values of the position before; a join, so that no task holds the stream."""
    before = df.select((F.col("pos") + 1).alias("pos"), F.struct(*columns).alias("__before"))
    return df.join(before, "pos", "left")


def unique_consecutive(df: DataFrame, columns: Sequence[str], same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Without rows that equal the one before (or that ``same`` says are like it)."""
    near = _neighbours(df, columns)
    now = F.struct(*columns)
    alike = F.col("__before").eqNullSafe(now) if same is None else F.coalesce(same(F.col("__before"), now), F.lit(False))
    return near.where((F.col("pos") == 0) | ~alike).drop("__before")


def runs(df: DataFrame, size: int, order: Sequence[str]) -> DataFrame:
    """Sorted runs of ``size`` rows of a stream: ``run``, and ``run_pos`` within it."""
    w = Window.partitionBy("run").orderBy(*order, "pos")
    return df.withColumn("run", F.floor(F.col("pos") / size).cast("long")).withColumn("run_pos", F.row_number().over(w).cast("long") - 1)


def unsorted_places(runs_: DataFrame, key: str) -> DataFrame:
    """``n``: places in runs at which the key falls; 0 when all runs are sorted."""
    w = Window.partitionBy("run").orderBy("run_pos")
    return runs_.withColumn("__last", F.lag(key).over(w)).agg(F.count_if(F.col("__last") > F.col(key)).alias("n"))


def merge_runs(runs_: DataFrame, order: Sequence[str]) -> DataFrame:
    """All runs merged to one sorted stream, with ``rank``."""
    return global_index(runs_, [*order, "run", "run_pos"], "rank")


# ---------------------------------------------------------------- algorithms


def sort(df: DataFrame, order: Sequence[str | Column], into: str = "rank") -> DataFrame:
    """Sorted, with the rank of each row; the order has to be total for the ranks to be certain."""
    return global_index(df, list(order), into)


def key_sort(df: DataFrame, key: Column, ties: Sequence[str], into: str = "rank") -> DataFrame:
    """Sorted by an integer key."""
    return global_index(df.withColumn("__key", key.cast("long")), ["__key", *ties], into).drop("__key")


def stable_key_sort(df: DataFrame, key: Column, into: str = "rank") -> DataFrame:
    """Sorted by an integer key, rows of equal keys in the order of their positions."""
    return key_sort(df, key, ["pos"], into)


def find(df: DataFrame, condition: Column) -> DataFrame:
    """``pos`` of the first row that meets a condition; null without one."""
    return df.where(condition).agg(F.min("pos").alias("pos"))


def shuffled(df: DataFrame, seed: str, key: str, into: str = "rank") -> DataFrame:
    """A random order that depends on the seed only: by md5 of seed and key."""
    return global_index(df.withColumn("__h", F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))), ["__h", key], into).drop("__h")


def random32(key: Column, seed: str) -> Column:
    """A pseudo-random number below 2**32 for each key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A pseudo-random number in [0, 1) for each key."""
    return random32(key, seed).cast("double") / float(1 << 32)


# ---------------------------------------------------------------- containers


def last_in_first_out(df: DataFrame, k: int) -> DataFrame:
    """What ``k`` pops of a stack give: the rows of the highest positions, newest first (``popped`` from 0)."""
    return df.orderBy(F.desc("pos")).limit(k).withColumn("popped", F.row_number().over(Window.orderBy(F.desc("pos"))).cast("long") - 1)  # k rows


def first_in_first_out(df: DataFrame, k: int) -> DataFrame:
    """What ``k`` pops of a queue give, oldest first."""
    return df.orderBy("pos").limit(k).withColumn("popped", F.row_number().over(Window.orderBy("pos")).cast("long") - 1)  # k rows


def both_ends(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: the front (``front_*``) and the back (``back_*``) of a double-ended queue."""
    return df.agg(*[F.min_by(c, "pos").alias(f"front_{c}") for c in columns], *[F.max_by(c, "pos").alias(f"back_{c}") for c in columns])


def at(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """The rows at some positions."""
    return df.where(F.col("pos").isin(*positions))


def pushed_back(df: DataFrame, rows: DataFrame) -> DataFrame:
    """A vector (``pos`` from 0) with the rows of another one behind its end."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.unionByName(rows.join(F.broadcast(n)).withColumn("pos", F.col("pos") + F.col("__n")).drop("__n"))  # one row


def popped_back(df: DataFrame, k: int) -> DataFrame:
    """A vector without its last ``k`` rows."""
    n = df.agg(F.count(F.lit(1)).alias("__n"))
    return df.join(F.broadcast(n)).where(F.col("pos") < F.col("__n") - k).drop("__n")  # one row


def resized(df: DataFrame, n: int, **fill: object) -> DataFrame:
    """A vector of ``n`` rows: cut, or filled up with one value for each column."""
    old = df.agg(F.count(F.lit(1)).alias("__n"))
    more = df.sparkSession.range(n).select(F.col("id").alias("__pos")).join(F.broadcast(old)).where(F.col("__pos") >= F.col("__n"))  # one row
    more = more.select(F.col("__pos").alias("pos"), *[F.lit(v).cast(df.schema[c].dataType).alias(c) for c, v in fill.items()])
    return df.where(F.col("pos") < n).unionByName(more, allowMissingColumns=True)


def assigned(df: DataFrame, values: DataFrame) -> DataFrame:
    """A vector with other rows at the positions of ``values`` (the same columns, a position once)."""
    return df.join(values.select("pos"), "pos", "left_anti").unionByName(values)


def exported(df: DataFrame, path: str) -> None:
    """Writes a vector's rows in order, a range of positions to a file."""
    df.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(path)


def backwards(df: DataFrame, n: int) -> DataFrame:
    """A stream of ``n`` rows read from its end: ``pos`` counts from the last row."""
    return df.withColumn("pos", F.lit(n) - 1 - F.col("pos"))


def top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of an order, with ``rank`` from 0: each task keeps ``k`` rows."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long") - 1)  # k rows


def pop_ahead(df: DataFrame, value: str, limit: float) -> DataFrame:
    """All that a bulk pop with a limit gives from a queue whose largest is first: values strictly above it."""
    return df.where(F.col(value) > limit)


def lower_bound(table: DataFrame, key: str, x: object) -> DataFrame:
    """The row of the least key that is not below ``x``."""
    return table.where(F.col(key) >= x).orderBy(key).limit(1)


def upper_bound(table: DataFrame, key: str, x: object) -> DataFrame:
    """The row of the least key above ``x``."""
    return table.where(F.col(key) > x).orderBy(key).limit(1)


def equal_range(table: DataFrame, key: str, x: object) -> DataFrame:
    return table.where(F.col(key) == x)


def insert_kept(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Inserts in order; a key that is there keeps its value."""
    return rows.groupBy(key).agg(F.min_by(value, order).alias(value))


def insert_overwriting(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Inserts in order; a later value replaces an earlier one."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def erased(table: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


# ---------------------------------------------------------------- matrices (i, j, v)


def mat_add(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("i", "j").agg(F.sum("v").alias("v"))


def mat_scale(a: DataFrame, x: float) -> DataFrame:
    return a.withColumn("v", F.col("v") * x)


def mat_mul(a: DataFrame, b: DataFrame) -> DataFrame:
    """The product: rows are joined on the inner index and summed before the last shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def mat_transpose(a: DataFrame) -> DataFrame:
    return a.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def mat_times_column(a: DataFrame, x: DataFrame) -> DataFrame:
    """A matrix times a column vector (``i, v``)."""
    return a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def row_times_mat(x: DataFrame, a: DataFrame) -> DataFrame:
    """A row vector (``j, v``) times a matrix."""
    return a.join(x.select(F.col("j").alias("i"), F.col("v").alias("x")), "i").groupBy("j").agg(F.sum(F.col("v") * F.col("x")).alias("v"))
