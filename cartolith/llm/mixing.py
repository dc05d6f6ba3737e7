"""Mixing sources to target weights by hierarchical budgeting.

Documents belong to leaves of a domain-language-source tree. A token budget is propagated from the
root by the weights of each node's children. A child whose supply (tokens of its leaves times
``max_epochs``) is below its share is short; what it can't take is shared among its siblings by
weight, and only what all siblings together can't take is left to the parent's siblings. Level by
level that is water-filling: with children in ascending order of supply / weight, a child is
saturated when the budget covers all before it in full and the rest at its own ratio.

Each leaf then reads its documents in seeded epochs: epoch ``e`` is the order of
``md5(seed:e:doc_id:md5(text))``. The leaf's budget is some whole epochs and a token-prefix of the
next one: documents whose preceding tokens in that order are below what is left, so at most one
document reaches beyond the budget. The prefix ends at a hash value per leaf, found without sorting
a leaf in one task: hash buckets are summed, the bucket that holds the end is found on the sums, and
only its rows are summed by hash. Rows alike in id and text share a hash; where the end falls among
them, as many of them are taken as the rest asks for.

All of it is DataFrame expressions. Tokens are runs of characters other than blank, tab, line feed
and carriage return, unless a column of token counts is named.

Edge cases: null domains, languages or sources are the key ``(none)``; a null or empty text has 0
tokens and follows its hash like the others (it is part of whole epochs, and of a prefix when its
place comes before the end); rows that repeat an id and a text are taken one by one, rows that only
repeat an id, null ones included, have places of their own; very long texts are counted whole; a
node without weight gets ``default_weight``; extra columns stay as they are, whatever their names;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cartolith.llm.common import materialise, whole_row

NONE = "(none)"
#: Rows of a leaf's hash bucket, about.
BUCKET_ROWS = 2_000
HASH_DIGITS = 13  # hexadecimal digits of md5: 52 bits, exact in a long and a double


def tokens_of(text: str = "text") -> Column:
    """The number of tokens in a text."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def text_hash(text: str = "text") -> Column:
    return F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))


def hash_of(seed: int, epoch: Column, doc_id: str = "doc_id", text: str = "text_hash") -> Column:
    """A document's place in an epoch: the first 52 bits of ``md5(seed:epoch:doc_id:md5(text))``."""
    told = F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(NONE)), F.lit(":"), F.col(text))
    return F.conv(F.substring(F.md5(told.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("long")


def _weights(weights: Mapping[str, int], key: Column, default: int) -> Column:
    if not weights:
        return F.lit(default).cast("long")
    pairs = [F.lit(x) for kv in weights.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default)).cast("long")


def water_fill(nodes: DataFrame, parent: list[str], child: str, supply: str, weight: str, budget: str, into: str) -> DataFrame:
    """Shares ``budget`` (the same in all rows of a parent) among the children; adds ``into``."""
    up_to = Window.partitionBy(*parent).orderBy("__ratio", child).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*parent)
    out = nodes.withColumn("__ratio", F.col(supply).cast("double") / F.col(weight))
    out = out.withColumn("__later", F.sum(weight).over(whole) - F.sum(weight).over(up_to))
    out = out.withColumn("__full", F.sum(supply).over(up_to).cast("double") + F.col("__ratio") * F.col("__later") <= F.col(budget))
    spent = F.coalesce(F.sum(F.when(F.col("__full"), F.col(supply))).over(whole), F.lit(0)).cast("double")
    open_weight = F.coalesce(F.sum(F.when(~F.col("__full"), F.col(weight))).over(whole), F.lit(0)).cast("double")
    out = out.withColumn("__spent", spent).withColumn("__open", open_weight)
    share = F.when(F.col("__full"), F.col(supply).cast("double")).otherwise((F.col(budget) - F.col("__spent")) / F.col("__open") * F.col(weight))
    return out.withColumn(into, share).drop("__ratio", "__later", "__full", "__spent", "__open")


def leaf_budgets(leaves: DataFrame, weights: Mapping[str, Mapping[str, int]], budget: float, max_epochs: int, default_weight: int = 1) -> DataFrame:
    """The token budget of each leaf.

    ``leaves``: ``domain, lang, source, tokens``. ``weights``: for ``domain``, ``lang`` and
    ``source`` the whole-number weight of a key. ``budget``: tokens asked for as a share of all
    supply in one epoch. Adds ``budget`` (whole tokens), ``epochs`` (whole ones) and ``rest``.
    """
    if any(w < 1 for by_key in weights.values() for w in by_key.values()):
        raise ValueError("weights are whole numbers from 1")
    t = leaves.withColumn("__cap", (F.col("tokens") * max_epochs).cast("long"))
    for c in ("domain", "lang", "source"):
        t = t.withColumn(f"__w_{c}", _weights(weights.get(c, {}), F.col(c), default_weight))
    total = t.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("__all"), F.coalesce(F.sum("__cap"), F.lit(0)).alias("__most"))
    asked = F.least(F.floor(F.col("__all") * F.lit(budget)).cast("double"), F.col("__most").cast("double"))
    domains = t.groupBy("domain").agg(F.sum("__cap").alias("__cap"), F.first("__w_domain").alias("__w")).withColumn("__root", F.lit(0))
    top = total.select(F.lit(0).alias("__root_id"), asked.alias("__asked"))
    domains = water_fill(domains.join(F.broadcast(top), F.col("__root") == F.col("__root_id")), ["__root"], "domain", "__cap", "__w", "__asked", "__given")  # one row
    domains = domains.select(F.col("domain").alias("__d"), F.col("__given").alias("__from_domain"))
    langs = t.groupBy("domain", "lang").agg(F.sum("__cap").alias("__cap"), F.first("__w_lang").alias("__w"))
    langs = langs.join(domains, F.col("domain") == F.col("__d"))
    langs = water_fill(langs, ["domain"], "lang", "__cap", "__w", "__from_domain", "__given")
    langs = langs.select(F.col("domain").alias("__d"), F.col("lang").alias("__l"), F.col("__given").alias("__from_lang"))
    t = t.join(langs, (F.col("domain") == F.col("__d")) & (F.col("lang") == F.col("__l")))
    t = water_fill(t, ["domain", "lang"], "source", "__cap", "__w_source", "__from_lang", "__given")
    whole = F.floor(F.col("__given") + 1e-6).cast("long")
    t = t.withColumn("budget", whole)
    t = t.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("rest", (F.col("budget") - F.col("epochs") * F.col("tokens")).cast("long"))
    return t.drop(*[c for c in t.columns if c.startswith("__")])


def plan_mix(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: float, max_epochs: int, seed: int, tokens: str | None = None, bucket_rows: int = BUCKET_ROWS) -> tuple[DataFrame, DataFrame]:
    """Plans a mix: (slim documents with ``copies`` still to decide, the table of leaves).

    The slim table has ``doc_id``, the leaf's keys and ``tokens`` and is written once; texts are
    read once for it. The table of leaves has ``epochs`` and ``end_hash``: documents with a hash
    below it are in the last, partial epoch. Of those whose hash is ``end_hash``, ``end_rows`` are.
    """
    count = F.col(tokens).cast("long") if tokens else tokens_of()
    keys = [F.coalesce(c.cast("string"), F.lit(NONE)) for c in (domain, F.col("lang"), F.col("source"))]
    slim = docs.select("doc_id", *[k.alias(n) for k, n in zip(keys, ("domain", "lang", "source"))], count.alias("tokens"), text_hash().alias("text_hash"))
    slim = materialise(slim, "mix-slim")
    leaf = ["domain", "lang", "source"]
    leaves = slim.groupBy(*leaf).agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    leaves = materialise(leaf_budgets(leaves, weights, budget, max_epochs), "mix-leaves", "snappy")
    hashed = with_leaves(slim, leaves, ("epochs", "rest", "docs")).withColumn("__h", hash_of(seed, F.col("epochs")))
    buckets = F.floor((F.col("docs") + bucket_rows - 1) / bucket_rows)
    hashed = hashed.where(F.col("rest") > 0).withColumn("__b", F.floor(F.col("__h").cast("double") / float(16**HASH_DIGITS) * buckets))
    sums = hashed.groupBy(*leaf, "__b").agg(F.sum("tokens").alias("__t"), F.max("rest").alias("__r"))
    before = Window.partitionBy(*leaf).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__t").over(before), F.lit(0)))
    # The bucket in which the tokens before a document first reach the rest.
    edge = sums.where((F.col("__before") < F.col("__r")) & (F.col("__before") + F.col("__t") >= F.col("__r")))
    edge = edge.select(*[F.col(c).alias(f"__e_{c}") for c in leaf], F.col("__b").alias("__e_b"), "__before")
    inside = hashed.join(edge, F.col("__b").eqNullSafe(F.col("__e_b")) & (F.col("domain") == F.col("__e_domain")) & (F.col("lang") == F.col("__e_lang")) & (F.col("source") == F.col("__e_source")))
    places = inside.groupBy(*leaf, "__h").agg(F.sum("tokens").alias("__t"), F.count(F.lit(1)).alias("__n"), F.max("__before").alias("__before"), F.max("rest").alias("__r"))
    here = Window.partitionBy(*leaf).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    places = places.withColumn("__up", F.col("__before") + F.coalesce(F.sum("__t").over(here), F.lit(0)))
    # Rows of one place have equal texts, so equal tokens: the rest asks for the first few of them.
    asked = F.when(F.col("__t") > 0, F.ceil((F.col("__r") - F.col("__up")) * F.col("__n") / F.col("__t"))).otherwise(F.col("__n"))
    ends = places.where(F.col("__up") < F.col("__r")).groupBy(*leaf).agg(F.max_by(F.struct("__h", "__n", asked.cast("long").alias("asked")), F.col("__h")).alias("__end"))
    all_of_it = F.col("__end.asked") >= F.col("__end.__n")
    end_hash = F.col("__end.__h") + F.when(all_of_it, 1).otherwise(0)
    ends = ends.select(*[F.col(c).alias(f"__e_{c}") for c in leaf], end_hash.alias("end_hash"), F.when(all_of_it, 0).otherwise(F.col("__end.asked")).alias("end_rows"))
    on = (F.col("domain") == F.col("__e_domain")) & (F.col("lang") == F.col("__e_lang")) & (F.col("source") == F.col("__e_source"))
    leaves = leaves.join(ends, on, "left").drop("__e_domain", "__e_lang", "__e_source").withColumn("end_hash", F.coalesce("end_hash", F.lit(0))).withColumn("end_rows", F.coalesce("end_rows", F.lit(0)))
    return slim, materialise(leaves, "mix-ends", "snappy")


def with_leaves(docs: DataFrame, leaves: DataFrame, columns: tuple[str, ...], keys: tuple[str, str, str] = ("domain", "lang", "source")) -> DataFrame:
    """Joins columns of the leaves to documents; Spark broadcasts the leaves where they are small."""
    small = leaves.select(*[F.col(c).alias(f"__leaf_{c}") for c in ("domain", "lang", "source")], *columns)
    on = [docs[k] == small[f"__leaf_{c}"] for k, c in zip(keys, ("domain", "lang", "source"))]
    return docs.join(small, on[0] & on[1] & on[2]).drop("__leaf_domain", "__leaf_lang", "__leaf_source")


def copies_of(seed: int, doc_id: str = "doc_id", epochs: str = "epochs", end_hash: str = "end_hash", text: str = "text_hash") -> Column:
    """How often a document is taken: the whole epochs, and one more inside the prefix.

    Right for all documents but those at a place with ``end_rows``; see ``with_copies``.
    """
    return F.col(epochs) + F.when(hash_of(seed, F.col(epochs), doc_id, text) < F.col(end_hash), 1).otherwise(0)


def with_copies(docs: DataFrame, leaves: DataFrame, seed: int, keys: tuple[str, str, str] = ("domain", "lang", "source"), doc_id: str = "doc_id", text: str = "text_hash") -> DataFrame:
    """``docs`` with ``copies``: how often the mix takes each row.

    Rows at a place that is taken in part (only repeated rows are) are written, counted by leaf and
    partition, and numbered inside partitions; no leaf is ordered in one task.
    """
    own = docs.columns
    told = with_leaves(docs, leaves, ("epochs", "end_hash", "end_rows"), keys).withColumn("copies", copies_of(seed, doc_id, text=text).cast("long"))
    if leaves.where("end_rows > 0").isEmpty():
        return told.select(*own, "copies")
    split = (F.col("end_rows") > 0) & (hash_of(seed, F.col("epochs"), doc_id, text) == F.col("end_hash"))
    tied = told.where(split).withColumn("__part", F.spark_partition_id()).withColumn("__place", F.monotonically_increasing_id())
    tied = materialise(tied, "mix-tied")
    inside = Window.partitionBy(*keys, "__part").orderBy("__place")
    sums = tied.groupBy(*keys, "__part").agg(F.count(F.lit(1)).alias("__n"))
    above = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"__s{i}") for i, k in enumerate(keys)], F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(above), F.lit(0)).alias("__above"))
    same = F.col("__part") == F.col("__p")
    for i, k in enumerate(keys):
        same = same & (F.col(k) == F.col(f"__s{i}"))
    numbered = tied.withColumn("__nth", F.row_number().over(inside)).join(sums, same)
    taken = F.when(F.col("__above") + F.col("__nth") <= F.col("end_rows"), 1).otherwise(0)
    numbered = numbered.withColumn("copies", (F.col("epochs") + taken).cast("long"))
    return told.where(~split).select(*own, "copies").unionByName(numbered.select(*own, "copies"))


def mixed(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: float, max_epochs: int, seed: int, tokens: str | None = None) -> DataFrame:
    """Each document's leaf, tokens and number of copies: ``doc_id, domain, lang, source, tokens, copies``."""
    slim, leaves = plan_mix(docs, domain, weights, budget, max_epochs, seed, tokens)
    return with_copies(slim, leaves, seed).select("doc_id", "domain", "lang", "source", "tokens", "copies")


def select_rows(docs: DataFrame, domain: Column, weights: Mapping[str, Mapping[str, int]], budget: float, max_epochs: int, seed: int, tokens: str | None = None) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they were."""
    _, leaves = plan_mix(docs, domain, weights, budget, max_epochs, seed, tokens)
    keys = [F.coalesce(c.cast("string"), F.lit(NONE)) for c in (domain, F.col("lang"), F.col("source"))]
    wide = docs.select(whole_row(docs).alias("__row"), F.col("doc_id").alias("__id"), text_hash().alias("__text"), *[k.alias(f"__{n}") for k, n in zip(keys, ("domain", "lang", "source"))])
    counted = with_copies(wide, leaves, seed, ("__domain", "__lang", "__source"), "__id", "__text").where("copies > 0")
    return counted.select("__row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("__time")).select("__row.*")
