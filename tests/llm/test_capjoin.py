import math

import numpy as np
import pytest

from cartolith.llm import capjoin as c

SCHEMA = "vec_id long, embedding array<float>, label int, `key` string, root int"


def brute(rows, threshold=c.THRESHOLD):
    use = []
    for i, (_, e, label) in enumerate(rows):
        if label is not None and e and None not in e and all(map(math.isfinite, e)) and any(e):
            use.append((i, np.array(e, dtype=np.float32).astype(float)))
    parent, degree = list(range(len(rows))), [0] * len(rows)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, x) in enumerate(use):
        for j, y in use[:n]:
            if rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / (np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                parent[root(i)] = root(j)
                degree[i] += 1
                degree[j] += 1
    least = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            least[root(i)] = min(v, least.get(root(i), v))
    out = []
    for i, (v, _, _) in enumerate(rows):
        comp = least.get(root(i))
        out.append((v, degree[i], comp, v == comp if v is not None and comp is not None else True))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "k", 1) for r in rows], SCHEMA)


def got(spark, rows):
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in c.near_vectors(frame(spark, rows)).collect()), key=repr)


def vectors(seed, n, dim, labels=3, families=12):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((families, dim))
    rows = []
    for i in range(n):
        x = rng.standard_normal(dim) if i % 3 == 0 else centres[rng.integers(families)] + rng.standard_normal(dim) * rng.choice([0.02, 0.1, 0.15])
        rows.append((i, [float(v) for v in np.float32(x)], int(rng.integers(labels))))
    return rows


@pytest.mark.parametrize(("seed", "dim"), [(1, 64), (2, 16), (3, 33)])
def test_against_brute_force(spark, seed, dim):
    rows = vectors(seed, 240, dim)
    rows += [(1000 + i, rows[i][1], rows[i][2]) for i in range(20)]  # exact copies
    rows += [(2000 + i, [2 * v for v in rows[i][1]], rows[i][2]) for i in range(20)]  # the same direction
    rows += [rows[3], rows[3]]
    assert got(spark, rows) == brute(rows)


def test_awkward_vectors(spark):
    one = [1.0, 0.0, 2.0]
    rows = [(1, None, 1), (2, [], 1), (3, [0.0, 0.0, 0.0], 1), (4, [1.0, None, 2.0], 1), (5, [math.nan, 1.0, 1.0], 1), (6, [math.inf, 1.0, 1.0], 1), (7, one, None), (8, one, None), (9, one, 1), (10, one, 1), (11, one, 2), (12, [1.0, 0.0], 1), (None, one, 1), (13, [0.0, 0.0, 0.0], 1), (14, [5.0], 1), (15, [7.0], 1), (16, [-7.0], 1)]
    assert got(spark, rows) == brute(rows)


def test_components_of_any_size(spark):
    rows = [(1, [1e200, 2e200], 1), (2, [1.0, 2.0], 1), (3, [5e-324, 1e-323], 1), (4, [1e-200, 2e-200], 1), (5, [1.7e308, -1.7e308], 1), (6, [-1.7e308, 1.7e308], 1), (7, [1e300, -1e300], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in c.near_vectors(df).collect()}
    assert got == {1: (3, 1), 2: (3, 1), 3: (3, 1), 4: (3, 1), 5: (1, 5), 6: (0, 6), 7: (1, 5)}


def test_empty(spark):
    assert c.near_vectors(frame(spark, [])).count() == 0
    assert got(spark, [(1, None, 1)]) == [(1, 0, 1, True)]


def test_recall_of_filters():
    """Close pairs share a filter; measured against all pairs."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((1500, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((1500, 64))
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * noise
    shared = [bool(len(np.intersect1d(a, b))) for a, b in zip(c.filters_of(x), c.filters_of(y))]
    assert np.mean(shared) > 0.999


def test_listed_filters_are_the_exceeding_ones():
    rng = np.random.default_rng(6)
    x = rng.standard_normal((40, 24))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, one, two, alpha = c.code(24, 32, 10.0, c.SEED)
    a, b = c._halves(x, rotation, one, two)
    for f, s, t in zip(c.filters_of(x, 32, 10.0, 1), a, b):
        want = np.flatnonzero((s[:, None] + t[None, :]).reshape(-1) >= alpha)
        assert (len(want) == 0 and len(f) == 1) or f.tolist() == want.tolist()


def test_best_filters_are_the_best_of_all():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((30, 50))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rotation, vectors = c.product_code(50, 100, 1)
    y, sums, begin = x @ rotation, np.zeros((30, 1)), 0
    for v in vectors:
        sums = (sums[:, :, None] + (y[:, begin : begin + v.shape[1]] @ v.T)[:, None, :]).reshape(30, -1)
        begin += v.shape[1]
    assert begin == 50
    want = np.sort(np.argsort(-sums, axis=1)[:, : c.EACH], axis=1)
    assert (np.sort(c.best_filters(x, 100, 1), axis=1) == want).all()


@pytest.mark.parametrize("most", [500, 1_000_000])
def test_recall_of_buckets(most):
    """Pairs at the threshold share a bucket; others hardly ever do, however many there are."""
    rng = np.random.default_rng(5)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.standard_normal((4000, 64))
    noise -= (noise * x).sum(1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * noise
    labels = np.zeros(4000, dtype=int)
    a, b = c.buckets_of(x, labels, most), c.buckets_of(y, labels, most)
    assert np.mean([bool(len(np.intersect1d(p, q))) for p, q in zip(a, b)]) > 0.999
    n = np.unique(np.concatenate(a), return_counts=True)[1]
    assert (n * (n - 1) // 2).sum() * (most / 4000) < 4000 * 4  # old filters: 32 ** 2 / 2 ** 19 a pair, whatever the size
    assert not np.intersect1d(np.concatenate(a), np.concatenate(c.buckets_of(x, labels + 1, most))).size


@pytest.mark.parametrize(("tile", "few"), [(2, 3), (7, 20), (1024, 256)])
def test_tiles_count_each_pair_once(spark, tile, few):
    """A crowded filter in many tiles, and small ones together, give the links of all pairs."""
    from pyspark.sql import functions as F

    rows = vectors(11, 150, 64, labels=1, families=2) + vectors(12, 40, 3, labels=2, families=2)
    use = [(i, np.array(e, dtype="<f4"), label) for i, (_, e, label) in enumerate(rows)]
    made = []
    for i, e, label in use:
        unit = e.astype(float) / np.linalg.norm(e.astype(float))
        made.append((i, label, len(e), bytearray(e.tobytes()), 1 + i % 3, [int(f) for f in c.buckets_of(unit[None], np.array([label]), 500)[0]]))
    df = spark.createDataFrame(made, "id long, label int, dim int, raw binary, copies long, filters array<long>")
    found = c.links(df, 0.98, "<f4", tile, few)
    got = {r.a: r.n for r in found.groupBy("a").agg(F.sum("links").alias("n")).collect()}
    want = {}
    for i, x, p in use:
        for j, y, q in use:
            if i != j and p == q and len(x) == len(y) and c.cosine(x[None].astype(float), y[None].astype(float))[0] >= 0.98:
                want[i] = want.get(i, 0) + 1 + j % 3
    assert got == want and max(got.values()) > 30
