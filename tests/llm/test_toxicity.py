import math
import random
import zlib

import numpy as np
import pytest

import helpers
from cartolith.llm import toxicity as t

BAD = ["idiot", "loser", "grumph", "snork"]


def corpus(n=900, seed=1):
    """(doc_id, text, toxic); toxic texts hold some bad words, with endings."""
    rnd = random.Random(seed)
    vocabulary = helpers.words(rnd, 800).split()
    out = []
    for i in range(n):
        w = [rnd.choice(vocabulary) for _ in range(30 + rnd.randrange(200))]
        toxic = rnd.random() < 0.15
        if toxic:
            for _ in range(1 + rnd.randrange(3)):
                w[rnd.randrange(len(w))] = rnd.choice(BAD) + rnd.choice(["", "s", "er"])
        out.append((i, " ".join(w), int(toxic)))
    return out


def test_held_out_accuracy(spark):
    rows = corpus(2000)
    docs = spark.createDataFrame([(i, x, "t") for i, x, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r for r in t.scores(docs, labels).collect()}
    assert len(got) == len(rows)
    held = [(got[i], y) for i, _, y in rows if got[i].held_out]
    assert [got[i].held_out for i, _, _ in rows] == [zlib.crc32(str(i).encode()) % 3 == 1 for i, _, _ in rows]
    assert all(g.predicted == int(g.score >= 0.7) and 0 <= g.score <= 1 for g in got.values())
    hits = sum(g.predicted for g, y in held if y)
    false = sum(g.predicted for g, y in held if not y)
    assert hits >= 0.9 * sum(y for _, y in held) and false <= 0.03 * len(held)


def test_held_out_labels_are_not_used(spark):
    rows = corpus(300)
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    make = lambda turn: spark.createDataFrame([(i, 1 - y if turn and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = ({r.doc_id: r.score for r in t.scores(docs, make(turn)).collect()} for turn in (False, True))
    assert a == b


def test_awkward_documents(spark):
    docs = helpers.documents(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 1), (4, 0), (4, 0), (5, 1), (7, 1)], "doc_id long, toxic int")
    got = t.scores(docs, labels).collect()
    assert len(got) == docs.count()
    by_text = {}
    for r, d in zip(sorted(got, key=lambda r: repr(r.doc_id)), sorted(helpers.rows_of(docs), key=lambda d: repr(d["doc_id"]))):
        if d["doc_id"] is not None:
            assert by_text.setdefault(d["text"] or "", r.score) == r.score
    kept = t.without_toxic(docs, t.fit(docs, labels), threshold=2.0)
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_without_positives_or_documents(spark):
    none = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    got = {r.score for r in t.scores(helpers.documents(spark), none).collect()}
    assert len(got) == 1
    assert t.scores(helpers.empty(spark), none).count() == 0
    assert t.scores(helpers.empty(spark), none.limit(0)).count() == 0


def test_risk_never_trains_below_zero():
    """Positives that fill the unlabelled set don't drive all scores up without end."""
    rnd = np.random.default_rng(0)
    pos = [np.sort(rnd.choice(1000, 20, replace=False)).astype(np.int32) for _ in range(50)]
    model = t.train(pos, pos, prior=0.5)
    assert np.isfinite(model.weights).all() and abs(model.bias) < 20


def plain_risk(w, bias, pos, unl, prior):
    """The non-negative risk by its formula, document by document."""
    margin = lambda d: bias + sum(w[f] for f in d.tolist())
    loss = lambda z: math.log1p(math.exp(-abs(z))) + max(0.0, -z)
    p_pos = sum(loss(margin(d)) for d in pos) / len(pos)
    p_neg = sum(loss(-margin(d)) for d in pos) / len(pos)
    u_neg = sum(loss(-margin(d)) for d in unl) / len(unl)
    return prior * p_pos, u_neg - prior * p_neg


@pytest.mark.parametrize("seed", range(6))
def test_the_gradient_is_that_of_the_risk(seed):
    """Numeric differences of the plain risk; below zero, those of the negative part turned round."""
    rng = np.random.default_rng(seed)
    k = 12
    draw = lambda n: [np.sort(rng.choice(k, rng.integers(0, 6), replace=False)).astype(np.int32) for _ in range(n)]
    pos, unl, w, bias, prior = draw(7), draw(15), rng.normal(size=k) * (3 if seed % 2 else 0.5), rng.normal(), 0.45
    if seed >= 4:  # the positives look more like unlabelled text than the unlabelled do: below zero
        w, bias = np.full(k, -2.0), 1.0
        pos, unl = [np.array([], np.int32)] * 7, [np.arange(k, dtype=np.int32)] * 15
    place = np.arange(k, dtype=np.int32)
    rows_p, rows_u = t._Rows(pos, place, k), t._Rows(unl, place, k)
    zp, zu = bias + rows_p.times(w), bias + rows_u.times(w)
    a, b = plain_risk(w, bias, pos, unl, prior)
    assert t.risk(zp, zu, prior) == pytest.approx((a, b))
    assert (b < 0) == (seed >= 4) or seed < 4
    gp, gu = t.slopes(zp, zu, prior)
    got = rows_p.gathered(gp) + rows_u.gathered(gu)

    def objective(w2, bias2):
        x, y = plain_risk(w2, bias2, pos, unl, prior)
        return x + y if b >= 0 else -y

    for i in range(k):
        step = np.zeros(k)
        step[i] = 1e-5
        assert got[i] == pytest.approx((objective(w + step, bias) - objective(w - step, bias)) / 2e-5, abs=1e-6)
    assert gp.sum() + gu.sum() == pytest.approx((objective(w, bias + 1e-5) - objective(w, bias - 1e-5)) / 2e-5, abs=1e-6)


def test_the_trainer_reaches_a_plain_one_s_risk():
    """Full-batch descent with the method's rule, written out, ends at no lower penalised risk."""
    rng = np.random.default_rng(3)
    k = 30
    toxic = lambda: np.sort(np.concatenate([rng.choice(5, 2, replace=False), 5 + rng.choice(k - 5, 6, replace=False)])).astype(np.int32)
    clean = lambda: np.sort(5 + rng.choice(k - 5, 8, replace=False)).astype(np.int32)
    pos, unl, prior, shrink = [toxic() for _ in range(60)], [toxic() if i % 5 == 0 else clean() for i in range(300)], 0.2, 0.01
    model = t.train(pos, unl, prior, shrink=shrink, full_shrink=1)
    got = np.zeros(k)
    got[model.ids] = model.weights

    def cost(w, b):
        x, y = plain_risk(w, b, pos, unl, prior)
        return x + max(0.0, y) + shrink * np.abs(w).sum()

    dense = lambda docs: np.array([np.isin(np.arange(k), d) for d in docs], dtype=float)
    p, u, w, b = dense(pos), dense(unl), np.zeros(k), 0.0
    for _ in range(6000):
        zp, zu = p @ w + b, u @ w + b
        s = lambda z: 1 / (1 + np.exp(-z))
        below = np.log1p(np.exp(zu)).mean() < prior * np.log1p(np.exp(zp)).mean()
        gp, gu = (prior * s(zp) / len(p), -s(zu) / len(u)) if below else (-prior * (1 - s(zp)) / len(p) - prior * s(zp) / len(p), s(zu) / len(u))
        w = w - 0.5 * (p.T @ gp + u.T @ gu)
        w = np.sign(w) * np.maximum(0, np.abs(w) - 0.5 * shrink)
        b -= 0.5 * (gp.sum() + gu.sum())
    assert cost(got, model.bias) <= cost(w, b) * 1.1 + 0.01
    assert got[:5].sum() > 3 * np.abs(got[5:]).sum()


def test_the_sample_has_a_bound(spark):
    """Rows that share an id, or repeat, don't grow the sample."""
    rows = [(1, f"word{i} toxic", 1) for i in range(50)] + [(1, "same", 1)] * 50 + [(i, f"text {i}", 0) for i in range(2, 60)]
    docs = spark.createDataFrame([(i, x) for i, x, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    seen = {}
    honest = t.train
    t.train = lambda p, u, prior, **k: seen.update(p=len(p), u=len(u)) or honest(p, u, prior, **k)
    try:
        t.fit(docs, labels, most_positive=20, most_unlabelled=30)
    finally:
        t.train = honest
    assert seen == {"p": 20, "u": 30}
