"""The pipeline's stages, each judged on its own input, and the registered queries with SQL."""

import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from cartolith.llm import mixing, queries, toxicity
from cartolith.llm.common import materialise, table
from cartolith.llm.pii import luhn_digit

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """(name, rows before, rows after) of each stage."""
    docs, out = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        after = materialise(stage(spark, docs, DATA), "stage")
        out.append((name, docs, after))
        docs = after
    return out


def test_stages(stages):
    assert [n for n, _, _ in stages] == ["toxicity", "near_dedup", "pii", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.dtypes == before.dtypes and 0 < after.count()


def test_toxic_documents_go(spark, stages):
    _, before, after = stages[0]
    model = toxicity.fit(before, table(spark, DATA, "labels"))
    by = model.scorer()
    want = {r.doc_id for r in before.collect() if by.score(r.text) < toxicity.THRESHOLD}
    assert {r.doc_id for r in after.collect()} == want


def test_one_of_each_family_stays(stages):
    _, before, after = stages[1]
    from test_neardup import classes_by_brute_force, levels_of

    rows = [r.asDict() for r in before.collect()]
    want = {c for _, c in classes_by_brute_force(rows, levels_of(rows))}
    assert sorted(repr(r.doc_id) for r in after.collect()) == sorted(want)


def test_personal_data_is_replaced(stages):
    _, before, after = stages[2]
    old, new = ({r.doc_id: r.text for r in d.collect()} for d in (before, after))
    assert old.keys() == new.keys() and all(len(old[k]) == len(new[k]) for k in old)
    values = [(k, v) for k, t in old.items() for v in re.findall(r"[a-z.0-9]+@[a-z0-9.]+|\+1 \(\d{3}\) \d{3}-\d{4}|\d{16}", t)]
    values = [(k, v) for k, v in values if not v.isdigit() or luhn_digit(v[:-1]) == int(v[-1])]
    assert values and not any(v in new[k] for k, v in values)
    assert sum(old[k] == new[k] for k in old) > len(old) / 2


def test_the_mix_has_its_tokens(stages):
    _, before, after = stages[3]
    count = lambda d: sum(len(re.findall(r"[^ \t\n\r]+", r.text)) for r in d.collect())
    longest = max(len(r.text.split()) for r in before.collect())
    leaves = before.select("lang", "source").distinct().count()
    assert abs(count(after) - count(before)) <= leaves * longest / 4  # at most one document a leaf reaches beyond its budget
    assert max(Counter(r.doc_id for r in after.collect()).values()) <= corpus_pipeline.EPOCHS
    assert mixing.NONE not in {r.lang for r in after.collect()}


def test_packing_holds_every_id(stages):
    from test_packing import ids_of

    _, before, after = stages[4]
    want = Counter()
    for r in before.collect():
        want[r.doc_id, zlib.crc32(np.array(ids_of(r.text), dtype="<u4").tobytes())] += 1
    spans, bins = defaultdict(int), defaultdict(list)
    for r in after.collect():
        spans[r.doc_id] += r.length
        bins[r.sequence_id].append((r.offset, r.length))
    tokens = Counter()
    for r in before.collect():
        tokens[r.doc_id] += len(ids_of(r.text))
    assert spans == tokens
    assert all(sum(n for _, n in v) <= 4096 for v in bins.values())


def test_awkward_documents_pass_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows, ties and columns with clashing names."""
    import helpers

    docs = helpers.documents(spark)
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(None, 1), (3, None)], "doc_id long, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, str(tmp_path)), "awkward")
        assert docs.columns == before.columns
        if name == "pii":
            assert docs.count() == before.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    tokens = Counter()
    for r in packed:
        tokens[r.doc_id] += r.length
    from test_packing import ids_of

    want = Counter()
    for r in docs.collect():
        want[r.doc_id] += len(ids_of(r.text))
    assert tokens == want and any(r.text is None for r in docs.collect())


def test_no_documents_pass_all_stages(spark, tmp_path):
    import helpers

    docs = helpers.empty(spark)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, str(tmp_path)), "none")
        assert docs.count() == 0


def test_run(spark, stages):
    told = lambda d: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in d.collect())
    assert told(corpus_pipeline.run(spark, DATA)) == told(stages[-1][2])


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(spark, name):
    from test_queries import compare

    compare(spark, name, queries.QUERIES, queries.ORACLE_SQL)


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
