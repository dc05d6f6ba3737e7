"""The queries of the corpus operators, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cartolith.llm import capjoin, kdshard, media, mixing, neardup, packing, pii, tokenbin, toxicity, url_filter
from cartolith.llm.common import table

#: (host, path prefix, verdict)
RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

#: Sources by domain, and whole-number weights of the tree's nodes; others weigh 1.
DOMAINS = {f"src{i}": ("web", "books", "code", "wiki")[i // 5] for i in range(20)}
WEIGHTS = {
    "domain": {"web": 4, "books": 2, "code": 2, "wiki": 2},
    "lang": {"en": 60, "fr": 15, "de": 15, "es": 10},
    "source": {"src0": 8},
}
MIX_BUDGET, MIX_EPOCHS, MIX_SEED = 1.0, 3, 13


SHARDS = 24


def vocabulary(name: str) -> str:
    """The path of an installed vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def domain_of(source: str = "source") -> Column:
    pairs = [F.lit(x) for kv in DOMAINS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.col(source)), F.lit("other"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), RULES)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"), domain_of(), WEIGHTS, MIX_BUDGET, MIX_EPOCHS, MIX_SEED)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_media(table(spark, sf_dir, "documents"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "documents"))


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_digests(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), end_id=2)


def op7_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.stored_documents(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), end_id=0)


def op8_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.pseudonymise(docs, pii.secret_key(), counts=True)


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kdshard.kd_shards(table(spark, sf_dir, "documents"), shards=SHARDS)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_cap_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return capjoin.near_vectors(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_url_filter, op2_mix_sources, op3_toxicity, op4_media_chunks, op5_near_dedup, op6_harmonic_packing, op7_token_planes, op8_pii_pseudonyms, op9_kd_shards, op10_cap_filters)
}


def _rules_sql() -> str:
    return ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)


def _weight_sql(column: str, level: str) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS[level].items())
    return f"CASE {column} {cases} ELSE 1 END"


def _domain_sql() -> str:
    return "CASE source " + " ".join(f"WHEN '{k}' THEN '{d}'" for k, d in DOMAINS.items()) + " ELSE 'other' END"


def _fill_sql(name: str, source: str, parent: str, child: str, budget: str) -> str:
    """Water-filling of ``budget`` among the children in ``source`` (cap, w)."""
    return f"""
{name}_a AS (
  SELECT *, cap::DOUBLE / w AS ratio,
    (sum(w) OVER (PARTITION BY {parent}) - sum(w) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {child} ROWS UNBOUNDED PRECEDING))::BIGINT AS later,
    (sum(cap) OVER (PARTITION BY {parent} ORDER BY cap::DOUBLE / w, {child} ROWS UNBOUNDED PRECEDING))::DOUBLE AS upto
  FROM {source}),
{name}_b AS (SELECT *, upto + ratio * later <= {budget} AS is_full FROM {name}_a),
{name}_c AS (
  SELECT *, coalesce(sum(cap) FILTER (WHERE is_full) OVER (PARTITION BY {parent}), 0)::DOUBLE AS spent,
    coalesce(sum(w) FILTER (WHERE NOT is_full) OVER (PARTITION BY {parent}), 0)::DOUBLE AS open_w
  FROM {name}_b),
{name} AS (SELECT *, CASE WHEN is_full THEN cap::DOUBLE ELSE ({budget} - spent) / open_w * w END AS given FROM {name}_c)"""


def _mix_sql() -> str:
    hashed = f"('0x' || substr(md5('{MIX_SEED}:' || epochs || ':' || coalesce(doc_id::VARCHAR, '(none)') || ':' || text_hash), 1, 13))::BIGINT"
    return f"""
WITH slim AS (
  SELECT doc_id, {_domain_sql()} AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source,
    coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')), 0)::BIGINT AS tokens, md5(coalesce(text, '')) AS text_hash
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * {MIX_EPOCHS})::BIGINT AS cap FROM slim GROUP BY ALL),
asked AS (SELECT least(floor(sum(tokens)::DOUBLE * {MIX_BUDGET!r}::DOUBLE), sum(cap)::DOUBLE) AS total FROM leaves),
d0 AS (SELECT 0 AS root, domain, sum(cap)::BIGINT AS cap, any_value({_weight_sql('domain', 'domain')}) AS w, any_value(total) AS total FROM leaves, asked GROUP BY domain),
{_fill_sql('d1', 'd0', 'root', 'domain', 'total')},
l0 AS (SELECT leaves.domain, lang, sum(leaves.cap)::BIGINT AS cap, any_value({_weight_sql('lang', 'lang')}) AS w, any_value(d1.given) AS from_domain FROM leaves JOIN d1 ON leaves.domain = d1.domain GROUP BY leaves.domain, lang),
{_fill_sql('l1', 'l0', 'domain', 'lang', 'from_domain')},
s0 AS (SELECT leaves.*, {_weight_sql('source', 'source')} AS w, l1.given AS from_lang FROM leaves JOIN l1 ON leaves.domain = l1.domain AND leaves.lang = l1.lang),
{_fill_sql('s1', 's0', 'domain, lang', 'source', 'from_lang')},
b AS (SELECT domain, lang, source, tokens AS supply, floor(given + 1e-6)::BIGINT AS budget FROM s1),
e AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM b),
hashed AS (SELECT slim.*, e.epochs, e.budget - e.epochs * e.supply AS rest, {hashed} AS h FROM slim JOIN e USING (domain, lang, source)),
ranked AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY h ROWS UNBOUNDED PRECEDING) - tokens AS before FROM hashed)
SELECT doc_id, domain, lang, source, tokens, (epochs + CASE WHEN rest > 0 AND before < rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked
"""


ORACLE_SQL: dict[str, str] = {
    "op1_url_filter": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_rules_sql()}),
rest AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
best AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(rule_verdict, length(rule_host || rule_path)) AS verdict
  FROM (SELECT DISTINCT host, path FROM split)
  JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY host, path)
SELECT page_id, split.host, split.path, rule, coalesce(verdict, 'allow') AS verdict
FROM split LEFT JOIN best ON split.host = best.host AND split.path = best.path
""",
    "op2_mix_sources": _mix_sql(),
    "op10_cap_filters": """
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS n, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
usable AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.n AS a, b.n AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.e) = len(b.e) AND a.n <> b.n
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach(a, b) AS (SELECT n, n FROM v UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a),
least AS (SELECT a, min(vec_id) AS component_id FROM reach JOIN v ON reach.b = v.n GROUP BY a),
degree AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, v.vec_id = component_id AS kept
FROM v JOIN least ON v.n = least.a LEFT JOIN degree ON v.n = degree.a
""",
}
