"""Small documents with every awkward case, for all operators."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, `class` string, shard int, node string, tokens string, score string, `bucket.no` int"


def words(rnd, n, size=400):
    return " ".join("".join(rnd.choice("abdeghlnorstu") for _ in range(2 + rnd.randrange(size) % 6)) for _ in range(n))


def documents(spark, n=60, seed=5):
    """Random texts, copies, near copies, null and empty texts, a very long one, null ids, repeated rows, clashing names."""
    rnd = random.Random(seed)
    texts = [words(rnd, 20 + rnd.randrange(150)) for _ in range(n)]
    texts += [texts[0], texts[0], texts[1], None, None, "", "", " ", "...", "one", "Ä é\tß", words(rnd, 30_000), "a" * 70_000]
    for k in (2, 3, 4):
        w = texts[k].split()
        w[len(w) // 2] = "changed"
        texts.append(" ".join(w))
    rows = [(i, t, None if i % 9 == 0 else ("en", "de")[i % 2], None if i % 11 == 0 else f"src{i % 4}") for i, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, texts[6], None, None), (None, None, "en", "src1"), (None, None, "en", "src1")]
    full = [(d, t, lang, s, None if t is None else len(t), "c", 7, "n", "t", "s", 1) for d, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return [r.asDict(recursive=True) for r in df.collect()]
