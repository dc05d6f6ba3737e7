import random
import zlib
from collections import Counter, defaultdict

import pytest

import helpers
from cartolith.llm import kdshard as k


def check(docs, rows, shards):
    want = sorted((repr(d["doc_id"]), len((d["text"] or "").encode()) + 8, zlib.crc32((d["text"] or "").encode())) for d in helpers.rows_of(docs))
    assert sorted((repr(r.doc_id), r.size, r.text_crc32) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("shards", [1, 2, 5, 24])
def test_awkward_documents(spark, shards):
    docs = helpers.documents(spark)
    check(docs, k.kd_shards(docs, shards).collect(), shards)


def corpus(spark, n, copies):
    rnd = random.Random(8)
    hot = helpers.words(rnd, 100)
    rows = [(i, hot if i < copies else helpers.words(rnd, 20 + rnd.randrange(200)), rnd.choice(["en", "en", "de"]), rnd.choice(["a", "a", "a", "b", "c"])) for i in range(n)]
    rows += [(n + i, rows[copies + i][1], "fr", "z") for i in range(50)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


@pytest.mark.parametrize(("copies", "shards"), [(2, 24), (1500, 24), (1500, 7)])
def test_bytes_are_near_equal(spark, copies, shards):
    """Also where one text holds a third of all rows."""
    docs = corpus(spark, 4000, copies)
    rows = k.kd_shards(docs, shards).collect()
    check(docs, rows, shards)
    size = Counter()
    for r in rows:
        size[r.shard] += r.size
    mean = sum(size.values()) / shards
    assert len(size) == shards and all(abs(v - mean) <= 0.04 * mean for v in size.values())
    groups = defaultdict(set)
    total = Counter()
    for r in rows:
        groups[r.text_crc32].add(r.shard)
        total[r.text_crc32] += r.size
    assert all(len(groups[c]) == 1 for c, t in total.items() if t <= 0.01 * mean)


def tree(units, lo, shards):
    """The tree by its definition: whole nodes, sorted by coordinate and tie, cut nearest to the left shards' share."""
    if shards == 1 or not units:
        return {u["unit"]: lo for u in units}
    spans = [max(u["at"][i] for u in units) - min(u["at"][i] for u in units) for i in range(len(k.DIMENSIONS))]
    dim = spans.index(max(spans))
    units = sorted(units, key=lambda u: (u["at"][dim], u["tie"]))
    left = shards // 2
    goal, before, n = sum(u["bytes"] for u in units) * left / shards, 0, 0
    while n < len(units) and before + units[n]["bytes"] < goal:
        before += units[n]["bytes"]
        n += 1
    if n < len(units) and abs(before + units[n]["bytes"] - goal) < abs(before - goal):
        n += 1
    return tree(units[:n], lo, left) | tree(units[n:], lo + left, shards - left)


@pytest.mark.parametrize(("copies", "shards"), [(2, 2), (2, 5), (300, 24), (300, 13)])
def test_against_a_tree_built_whole(spark, copies, shards):
    docs = corpus(spark, 900, copies)
    _, units, _ = k.points(docs, shards, 0.01)
    rows = units.collect()
    want = tree([{"unit": (u.text_key, u.piece), "at": [u[f"c_{d}"] for d in k.DIMENSIONS], "tie": u.tie, "bytes": u.bytes} for u in rows], 0, shards)
    for _ in range((shards - 1).bit_length()):
        units = k.materialise(k.split_level(units), "kd-test")
    got = {(u.text_key, u.piece): u.lo for u in units.collect()}
    assert got == want and len(set(want.values())) == shards


def test_a_split_is_along_the_widest_dimension(spark):
    """Two shards of equally large documents in two far places are those places."""
    rows = [(i if i < 100 else 10**6 + i, f"{i:08d} " * 20, "en", "a") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    by = defaultdict(set)
    for r in k.kd_shards(docs, 2, tolerance=0.0001).collect():
        by[r.shard].add(r.doc_id < 1000)
    assert by == {0: {True}, 1: {False}}


def test_target_bytes_and_empty(spark):
    docs = corpus(spark, 500, 2)
    n = len({r.shard for r in k.kd_shards(docs, target_bytes=40_000).collect()})
    total = sum(len(d["text"].encode()) + 8 for d in helpers.rows_of(docs))
    assert n == k.shards_for(total, 40_000)
    assert k.kd_shards(helpers.empty(spark), 24).count() == 0
    assert k.kd_shards(helpers.empty(spark), target_bytes=100).count() == 0
