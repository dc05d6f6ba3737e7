"""The Turtle sink: triples as lines of text, bzip2 by default."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.functions.text import prefix_lines, triple_line


def prefixes(spark: SparkSession) -> DataFrame:
    """The prefix lines, numbered in order."""
    return spark.createDataFrame(list(enumerate(prefix_lines())), "ord int, line string")


def lines(triples: DataFrame) -> DataFrame:
    """``line`` of each triple (``s, p, o``)."""
    return triples.select(triple_line(F.col("s"), F.col("p"), F.col("o")).alias("line"))


def write(text: DataFrame, path: str, compression: str | None = "bzip2", append: bool = False) -> None:
    """Writes lines to a folder of part files; appending adds files. Part files may be concatenated."""
    text.select(F.col("line").alias("value")).write.mode("append" if append else "overwrite").option("compression", compression or "none").text(path)


def write_turtle(spark: SparkSession, text: DataFrame, path: str, compression: str | None = "bzip2") -> None:
    """A whole output: prefixes first (the file that sorts first), then the lines."""
    write(prefixes(spark).orderBy("ord").select("line").coalesce(1), f"{path}/part=0", compression)
    write(text, f"{path}/part=1", compression)
