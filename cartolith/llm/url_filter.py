"""URL filters by a sorted digest array.

Rules (host, path prefix, verdict) become a digest file: 64-bit xxhash keys in ascending order, the
place of each rule's full string, and the strings. It is mapped into memory, so what a probe touches
is what it pages in. A URL's candidates are its host's suffixes with prefixes of its path, of only
those depths and lengths that some rule has; they are cut and digested in the JVM. A batch of
candidates is probed at once by vectorised binary search, and a hit counts after the full string is
compared, so colliding digests do no harm.

One method serves every number of rules. Up to ``most_bytes`` (a checked size) there is one file,
sent to each executor once through Spark's file server; all Python workers of a machine share its
pages, and no row is shuffled. Beyond it, the digests' range is cut into parts of about that size:
rules and candidates (each distinct host and path once) are dealt by the part of their digest, and
a task writes its part's file from the rules that reach it, in order, maps it, probes its
candidates, and deletes it. The file lives as long as its task, so a lost executor loses nothing
that a retry doesn't make again. Candidates of a part are dealt over several tasks of it, so that a
frequent digest (the candidates of a frequent host) is no hot task.

Rules fit a host and all its subdomains when the path starts with the rule's path; the longest
rule string wins, and of rules with the same string ``block``. A URL that no rule fits is allowed.

Edge cases: a null URL, or one without ``://``, has an empty host and path and is allowed; A-Z of a
rule's host count as small letters, as in URLs, and other letters are taken as they are; a rule
with a null host or path never fits; very long URLs are cut and compared whole; repeated rows stay;
other columns are ignored; an empty table or an empty rule list is fine.
"""

from __future__ import annotations

import atexit
import mmap
import os
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cartolith.llm.common import prepare

HEAD = struct.Struct("<4sQ")
MAGIC = b"CUF2"
#: The largest file, and so the most that comes to the driver and goes to an executor.
MOST_BYTES = 64 << 20
#: Bytes of a rule beside its string: digest, end of the string, verdict.
RULE_BYTES = 17
#: Tasks that share the candidates of one part of the digests.
SPREAD = 8

Rule = tuple[str, str, str]
_RULES = "host string, path string, verdict string"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    return small_letters(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0))


def small_letters(host: Column) -> Column:
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def named_rules(rules: DataFrame) -> DataFrame:
    """``rule, verdict, depth, length, key`` of ``host, path, verdict``, each rule string once."""
    host, verdict = small_letters(F.col("host")), F.col("verdict")
    wrong = F.raise_error(F.concat(F.lit("a verdict is allow or block, not "), F.coalesce(verdict, F.lit("null"))))
    told = rules.select(
        F.concat(host, "path").alias("rule"), F.when(verdict.isin("allow", "block"), verdict).otherwise(wrong.cast("string")).alias("verdict"),
        F.size(F.split(host, r"\.", -1)).alias("depth"), F.length("path").alias("length"),
        (~F.rlike("host", F.lit("[/?#]")) & F.rlike("path", F.lit("^(/|$)"))).alias("fits"),
    )
    # What no URL can fit goes: a URL's path is empty or begins with a slash, and its host has none.
    told = told.where("rule is not null AND fits").drop("fits")
    # A string may be cut in host and path in more than one way; each way is a shape of its own.
    once = told.groupBy("rule").agg(F.max("verdict").alias("verdict"), F.collect_set(F.struct("depth", "length")).alias("shapes"))  # block sorts after allow
    return once.withColumn("key", F.xxhash64("rule"))


def write_digests(target: str, rules: Iterable[tuple[int, str, str]]) -> None:
    """Writes a digest file of (key, rule, verdict), which come in ascending order of keys."""
    keys, ends, blobs, at = [], [], [], 0
    for key, rule, verdict in rules:
        blob = verdict[:1].encode() + rule.encode()
        at += len(blob)
        keys.append(key)
        ends.append(at)
        blobs.append(blob)
    with open(target, "wb") as f:
        f.write(HEAD.pack(MAGIC, len(keys)))
        f.write(np.array(keys, dtype="<i8").tobytes())
        f.write(np.array(ends, dtype="<i8").tobytes())
        f.writelines(blobs)


class DigestFile:
    """A digest file, mapped into memory."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n = HEAD.unpack_from(self._map)
        if magic != MAGIC:
            raise ValueError("not a digest file")
        self.keys = np.frombuffer(self._map, "<i8", n, HEAD.size)
        self.ends = np.frombuffer(self._map, "<i8", n, HEAD.size + 8 * n)
        self._blobs = HEAD.size + 16 * n

    def find(self, keys: np.ndarray, names: pa.Array) -> tuple[np.ndarray, list[str]]:
        """(places of the candidates that are rules, the verdict of each); ``keys`` are their digests."""
        if not len(self.keys) or not len(keys):
            return np.empty(0, np.int64), []
        at = np.searchsorted(self.keys, keys)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == keys)
        found, verdicts = [], []
        for i in hit.tolist():
            k, want = int(at[i]), names[i].as_py().encode()
            while k < len(self.keys) and self.keys[k] == keys[i]:
                blob = self._map[self._blobs + (int(self.ends[k - 1]) if k else 0) : self._blobs + int(self.ends[k])]
                if blob[1:] == want:
                    found.append(i)
                    verdicts.append("block" if blob[:1] == b"b" else "allow")
                    break
                k += 1
        return np.array(found, dtype=np.int64), verdicts


def candidates(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """The strings of a URL that a rule may have, as ``array<string>``."""
    told = F.array(*[F.struct(F.lit(d).alias("depth"), F.lit(n).alias("length")) for d, n in shapes])
    parts = F.split(host, r"\.", -1)
    fitting = F.filter(told, lambda s: (F.length(path) >= s["length"]) & (F.size(parts) >= s["depth"]) & (host != ""))
    return F.transform(fitting, lambda s: F.concat(F.array_join(F.slice(parts, -s["depth"], s["depth"]), "."), F.substring(path, F.lit(1), s["length"])))


_opened: dict[str, DigestFile] = {}


def judge(pages: DataFrame, rules: DataFrame | Iterable[Rule], most_bytes: int = MOST_BYTES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``pages`` (``page_id``, ``url``).

    ``rules``: a table with ``host, path, verdict``, or a list for short ones.
    """
    spark = pages.sparkSession
    prepare(spark)
    if not isinstance(rules, DataFrame):
        rules = list(rules)
        if wrong := {v for _, _, v in rules} - {"allow", "block"}:
            raise ValueError(f"a verdict is allow or block, not {sorted(map(str, wrong))}")
        rules = spark.createDataFrame(rules, _RULES)
    named = named_rules(rules)
    told = named.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("rule") + RULE_BYTES), F.lit(0)).alias("size")).first()
    # Depths up to a host's labels, lengths up to a URL's: bounded by URLs, not by the number of rules.
    shapes = sorted((r.depth, r.length) for r in named.select(F.explode("shapes").alias("s")).select("s.*").distinct().collect())
    split = _split(pages)
    if not shapes:
        return split.withColumn("rule", F.lit(None).cast("string")).withColumn("verdict", F.lit("allow"))
    if told.size <= most_bytes:
        return _judge_by_file(split, named, shapes)
    return _judge_by_ranges(split, named, shapes, -(-told.size // max(1, most_bytes // 4)))  # rules of a part are held once more while they are written


def _split(pages: DataFrame) -> DataFrame:
    url = F.coalesce(F.col("url"), F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))


def _judge_by_file(split: DataFrame, named: DataFrame, shapes: list[tuple[int, int]]) -> DataFrame:
    """One file of at most ``most_bytes`` on each executor; no shuffle."""
    sc = split.sparkSession.sparkContext
    rows = [(r.key, r.rule, r.verdict) for r in named.select("key", "rule", "verdict").collect()]  # at most `most_bytes`
    rows.sort()
    sent = sc.__dict__.setdefault("_cartolith_rule_files", set())
    name = f"cartolith-rules-{xxhash.xxh64_hexdigest(repr(rows))}.cuf"
    if name not in sent:  # a name can be registered once in an application
        folder = tempfile.mkdtemp(prefix="cartolith-")  # Spark's file server takes the file from here, as long as the driver runs
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        write_digests(os.path.join(folder, name), rows)
        sc.addFile(os.path.join(folder, name))
        sent.add(name)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _opened:
            _opened[name] = DigestFile(SparkFiles.get(name))
        for batch in batches:
            names, keys = batch.column(3), batch.column(4)
            found, verdicts = _opened[name].find(keys.flatten().to_numpy(), names.flatten())
            rule, verdict = _longest(batch.num_rows, names.offsets.to_numpy(), names.flatten(), found, verdicts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(rule, pa.string()), pa.array(verdict, pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    asked = split.withColumn("names", candidates(F.col("host"), F.col("path"), shapes))
    asked = asked.withColumn("keys", F.transform("names", lambda n: F.xxhash64(n)))
    return asked.mapInArrow(probe, "page_id long, host string, path string, rule string, verdict string")


def _longest(rows: int, offsets: np.ndarray, names: pa.Array, found: np.ndarray, verdicts: list[str]) -> tuple[list[str | None], list[str]]:
    """The rule and verdict of each row, from its candidates that are rules."""
    rule: list[str | None] = [None] * rows
    verdict = ["allow"] * rows
    row_of = np.searchsorted(offsets - offsets[0], found, side="right") - 1
    for i, row, told in zip(found.tolist(), row_of.tolist(), verdicts):
        name = names[i].as_py()
        if rule[row] is None or len(name) > len(rule[row]):
            rule[row], verdict[row] = name, told
    return rule, verdict


def part_of(key: Column, parts: int) -> Column:
    """The part of the digests' range, cut evenly, that a digest lies in."""
    share = (key.cast("double") + float(1 << 63)) / float(1 << 64)
    return F.least(F.floor(share * parts), F.lit(parts - 1)).cast("int")


def _judge_by_ranges(split: DataFrame, named: DataFrame, shapes: list[tuple[int, int]], parts: int) -> DataFrame:
    """Rules and distinct candidates meet by the range of their digest; each task maps its part's file."""
    places = split.select("host", "path").where("host != ''").distinct()
    wide = places.select("host", "path", F.explode(candidates(F.col("host"), F.col("path"), shapes)).alias("rule")).withColumn("key", F.xxhash64("rule"))
    spread = F.pmod(F.xxhash64("host", "path"), F.lit(SPREAD)).cast("int")
    asked = wide.select(F.lit(1).alias("kind"), "host", "path", "rule", "key", F.lit(None).cast("string").alias("verdict"), part_of(F.col("key"), parts).alias("part"), spread.alias("salt"))
    every = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    none = F.lit(None).cast("string")
    told = named.select(F.lit(0).alias("kind"), none.alias("host"), none.alias("path"), "rule", "key", "verdict", part_of(F.col("key"), parts).alias("part"), every.alias("salt"))
    both = told.unionByName(asked)
    dealt = both.repartition(parts * SPREAD, "part", "salt").sortWithinPartitions("part", "salt", "kind", "key")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory(prefix="cartolith-") as folder:
            now, rules, mapped, made = None, [], None, 0
            for batch in batches:
                group = np.asarray(batch.column(6)).astype(np.int64) * SPREAD + np.asarray(batch.column(7))
                kind = np.asarray(batch.column(0))
                borders = np.flatnonzero(np.diff(group * 2 + kind)) + 1
                for a, b in zip([0, *borders.tolist()], [*borders.tolist(), batch.num_rows]):
                    piece = batch.slice(a, b - a)
                    if group[a] != now:
                        now, rules, mapped = group[a], [], None
                    if kind[a] == 0:
                        rules += zip(piece.column(4).to_pylist(), piece.column(3).to_pylist(), piece.column(5).to_pylist())
                        continue
                    if mapped is None:
                        made += 1
                        path = os.path.join(folder, f"{made}.cuf")
                        write_digests(path, rules)
                        mapped, rules = DigestFile(path), []
                        os.unlink(path)  # the mapping stays
                    found, verdicts = mapped.find(piece.column(4).to_numpy(), piece.column(3))
                    at = pa.array(found)
                    yield pa.RecordBatch.from_arrays([*(piece.column(i).take(at) for i in (1, 2, 3)), pa.array(verdicts, pa.string())], names=["host", "path", "rule", "verdict"])

    cols = ["kind", "host", "path", "rule", "key", "verdict", "part", "salt"]
    hits = dealt.select(*cols).mapInArrow(probe, "host string, path string, rule string, verdict string")
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct("rule", "verdict"), F.length("rule")).alias("__hit"))
    # Hosts and paths that repeat without end are matched to their one verdict; AQE splits the side that repeats.
    out = split.join(best, ["host", "path"], "left")
    return out.select("page_id", "host", "path", F.col("__hit.rule").alias("rule"), F.coalesce(F.col("__hit.verdict"), F.lit("allow")).alias("verdict"))
