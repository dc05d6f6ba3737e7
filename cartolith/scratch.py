"""Written intermediate tables in the shared folder, and a global numbering built on them."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Sequence

from py4j.java_gateway import JavaGateway
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_PACKAGE = os.path.dirname(os.path.abspath(__file__))
#: Rows and bytes of an Arrow batch that goes to a Python worker, unless the session says otherwise.
BATCH_ROWS = 512
BATCH_BYTES = 4 << 20

_homes: set[str] = set()


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    A folder of our own is set only where a session has none and all of it runs in one process, as in
    tests: on a cluster a folder of the driver's machine isn't shared.
    """
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: written tables need a folder that driver and executors share")
        root = getattr(spark, "_cartolith_scratch", None) or tempfile.mkdtemp(prefix="cartolith-")
        spark._cartolith_scratch = root
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for a table of this application; its tables go when the driver ends."""
    home = f"{scratch_root(spark)}/cartolith-{spark.sparkContext.applicationId}"
    if home not in _homes:
        _homes.add(home)
        atexit.register(_remove, spark.sparkContext._gateway, home)
    return f"{home}/{name}-{uuid.uuid4().hex}"


def _remove(gateway: JavaGateway, path: str) -> None:
    """Deletes a folder in whatever store it is; a driver whose JVM is gone leaves it."""
    with contextlib.suppress(Py4JError, OSError):
        hadoop = gateway.jvm.org.apache.hadoop
        where = hadoop.fs.Path(path)
        where.getFileSystem(hadoop.conf.Configuration()).delete(where, True)


#: A table that is written to a local folder goes there without checksum files. Hadoop starts a process
#: (``chmod``) for each file and folder it makes in a local folder, with checksums four for each file,
#: and until that process has begun, all memory of the executor counts as its own as well.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def materialise(df: DataFrame, name: str, codec: str = "zstd", few: bool = False) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: lineage is cut, columns stay prunable.

    With ``few``, rows of small tables that many tasks make are gathered first, by their bytes, into
    few files.
    """
    return materialise_at(df.hint("rebalance") if few else df, name, codec)[0]


def materialise_at(df: DataFrame, name: str, codec: str = "zstd") -> tuple[DataFrame, str]:
    """``materialise`` with the table's path, for steps that ``discard`` it."""
    spark, path = df.sparkSession, scratch_path(df.sparkSession, name)
    df.write.options(compression=codec, **_PLAIN_FILES).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a written table that no later step reads."""
    _remove(spark.sparkContext._gateway, path)


def prepare(spark: SparkSession) -> None:
    """Makes the session ready for Python stages: bounded Arrow batches, this package on executors."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b") in ("67108864b", "64MB", "64m"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_cartolith_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="cartolith-code-")  # Spark's file server takes the archive from here, as long as the driver runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "cartolith_code.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _, names in os.walk(_PACKAGE):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(base, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(_PACKAGE)))
    sc.addPyFile(target)
    sc._cartolith_shipped = True


def global_index(df: DataFrame, order: Sequence[Column | str], into: str, start: int = 0) -> DataFrame:
    """Numbers all rows in the given total order, without a single-task sort.

    Rows are range-partitioned and sorted, written with their partition's number, and numbered as
    (rows of all partitions before) + (place in the partition).
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    part, place = "__gi_part", "__gi_place"
    ranged = materialise(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id() - F.shiftleft(F.col(part).cast("long"), 33)), "ranged")
    before = Window.orderBy("__gi_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(F.col(part).alias("__gi_p")).agg(F.count(F.lit(1)).alias("__gi_n"))
    bases = bases.select("__gi_p", F.coalesce(F.sum("__gi_n").over(before), F.lit(0)).alias("__gi_base"))
    out = ranged.join(F.broadcast(bases), F.col(part) == F.col("__gi_p"))  # one row a partition
    return out.withColumn(into, (F.col("__gi_base") + F.col(place) + start).cast("long")).drop(part, place, "__gi_p", "__gi_base")
