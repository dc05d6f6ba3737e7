import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import helpers
from cartolith.llm import mixing as m

WEIGHTS = {"domain": {"a": 3, "b": 1}, "lang": {"en": 2}, "source": {"src0": 5, "src1": 2}}
DOMAIN = None


@pytest.fixture(autouse=True, scope="module")
def domain(spark):
    """Columns need a session, so the expression is made here."""
    global DOMAIN
    DOMAIN = F.when(F.col("source").isin("src0", "src1"), "a").when(F.col("source") == "src2", "b")


def fill(budget, children):
    """Water-filling by rounds: who is short takes all it has, the others share the rest by weight."""
    out, left = {}, dict(children)
    while left:
        rate = budget / sum(w for _, w in left.values())
        short = [k for k, (cap, w) in left.items() if cap <= rate * w + 1e-9]
        if not short:
            return out | {k: rate * w for k, (_, w) in left.items()}
        for k in short:
            out[k] = float(left[k][0])
            budget -= left.pop(k)[0]
    return out


def brute(rows, budget, epochs, seed):
    """The number of copies of each (doc_id, leaf)."""
    leaf_of = lambda r: ({"src0": "a", "src1": "a", "src2": "b"}.get(r["source"], m.NONE), r["lang"] or m.NONE, r["source"] or m.NONE)
    count = lambda t: len((t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ")) - (t or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ").count("")
    supply = defaultdict(int)
    for r in rows:
        supply[leaf_of(r)] += count(r["text"])
    cap = {k: v * epochs for k, v in supply.items()}
    w = lambda level, key: WEIGHTS[level].get(key, 1)
    total = min(int(sum(supply.values()) * budget), sum(cap.values()))
    group = lambda keys, n: {p: sum(c for k, c in cap.items() if k[:n] == p) for p in {k[:n] for k in keys}}
    budgets = {}
    for d, given in fill(total, {p[0]: (c, w("domain", p[0])) for p, c in group(cap, 1).items()}).items():
        langs = {p[1]: (c, w("lang", p[1])) for p, c in group([k for k in cap if k[0] == d], 2).items()}
        for lang, more in fill(given, langs).items():
            budgets |= {(d, lang, s): b for s, b in fill(more, {k[2]: (c, w("source", k[2])) for k, c in cap.items() if k[:2] == (d, lang)}).items()}
    out = []
    for leaf, given in budgets.items():
        mine = [(r["doc_id"], count(r["text"]), hashlib.md5((r["text"] or "").encode()).hexdigest()) for r in rows if leaf_of(r) == leaf]
        whole, rest = divmod(int(given + 1e-6), supply[leaf]) if supply[leaf] else (0, 0)
        place = lambda d, t: hashlib.md5(f"{seed}:{whole}:{m.NONE if d is None else d}:{t}".encode()).hexdigest()[: m.HASH_DIGITS]  # noqa: B023, E731
        before = 0
        for d, n, _ in sorted(mine, key=lambda x: place(x[0], x[2])):
            out.append((d, *leaf, n, whole + (rest > 0 and before < rest)))
            before += n
    return sorted(out, key=repr), budgets


@pytest.mark.parametrize(("budget", "epochs"), [(0.3, 1), (1.0, 1), (1.0, 3), (2.2, 3), (9.0, 2)])
def test_against_brute_force(spark, budget, epochs):
    docs = helpers.documents(spark)
    want, _ = brute(helpers.rows_of(docs), budget, epochs, 17)
    got = m.mixed(docs, DOMAIN, WEIGHTS, budget, epochs, 17)
    assert sorted(((r.doc_id, r.domain, r.lang, r.source, r.tokens, r.copies) for r in got.collect()), key=repr) == want


def test_small_buckets_change_nothing(spark):
    docs = helpers.documents(spark)
    want, _ = brute(helpers.rows_of(docs), 0.5, 1, 3)
    slim, leaves = m.plan_mix(docs, DOMAIN, WEIGHTS, 0.5, 1, 3, bucket_rows=2)
    got = m.with_copies(slim, leaves, 3)
    assert sorted(r.copies for r in got.collect()) == sorted(w[-1] for w in want)


def test_rows_and_columns_are_kept(spark):
    docs = helpers.documents(spark)
    taken = m.select_rows(docs, DOMAIN, WEIGHTS, 1.0, 2, 17)
    assert taken.columns == docs.columns
    want, _ = brute(helpers.rows_of(docs), 1.0, 2, 17)
    assert sorted(repr(r.doc_id) for r in taken.select("doc_id").collect()) == sorted(repr(w[0]) for w in want for _ in range(w[-1]))


@pytest.mark.parametrize("budget", [0.001, 0.25, 0.5, 0.999])
def test_repeated_rows_are_taken_one_by_one(spark, budget):
    rows = [(None, "a b c", "en", "src0", 1)] * 200 + [(7, "d e", "en", "src0", 2)] * 100 + [(None, "f", "en", "src0", 3)] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, end_rows int").repartition(5)
    asked = int(803 * budget)
    got = [(r.tokens, r.copies) for r in m.mixed(docs, F.lit("d"), {}, budget, 1, 5).collect()]
    assert len(got) == 303 and asked <= sum(n * c for n, c in got) <= asked + 2
    taken = m.select_rows(docs, F.lit("d"), {}, budget, 1, 5)
    assert taken.columns == docs.columns and taken.count() == sum(c for _, c in got)


def test_shortage_goes_to_siblings_first(spark):
    rows = [("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s1", 1000), ("b", "x", "s1", 1000)]
    leaves = spark.createDataFrame(rows, "domain string, lang string, source string, tokens long")
    got = {(r.domain, r.lang, r.source): r.budget for r in m.leaf_budgets(leaves, {}, 400 / 3010, 1).collect()}
    # a: 200, so x: 100 and y: 100; s1 has 10 of its 50, and s2, not y or b, takes the other 40.
    assert got == {("a", "x", "s1"): 10, ("a", "x", "s2"): 90, ("a", "y", "s1"): 100, ("b", "x", "s1"): 200}


def test_empty_and_bad_weights(spark):
    assert m.mixed(helpers.empty(spark), DOMAIN, WEIGHTS, 1.0, 2, 1).count() == 0
    with pytest.raises(ValueError):
        m.mixed(helpers.documents(spark), DOMAIN, {"lang": {"en": 0}}, 1.0, 2, 1)


def test_native(spark):
    plan = m.mixed(helpers.documents(spark), DOMAIN, WEIGHTS, 1.0, 2, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_column_of_token_counts(spark):
    docs = spark.createDataFrame([(i, "x y z", "en", "src0", 10) for i in range(40)], "doc_id long, text string, lang string, source string, n long")
    got = m.mixed(docs, F.lit("d"), {}, 0.5, 1, 1, tokens="n").agg(F.sum(F.col("tokens") * F.col("copies")).alias("t")).first().t
    assert got == 200
