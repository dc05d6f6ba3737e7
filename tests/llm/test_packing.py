import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import helpers
from cartolith.llm import packing as p
from cartolith.llm.queries import vocabulary

VOCABULARY = vocabulary("word_bpe_49k.json")


def ids_of(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return t.encode(text or "", add_special_tokens=False).ids + [2]


@given(st.integers(1, 60_000), st.sampled_from([64, 1000, 4096]))
@settings(max_examples=300, deadline=None)
def test_cuts_fill_their_shares(total, capacity):
    parts = p.cut_lengths(total, capacity)
    assert sum(parts) == total and all(1 <= x <= capacity for x in parts)
    for x in parts:
        share = capacity // (capacity // x)
        assert x * x <= capacity or share - x <= p.SLACK * share + 1


def test_packing(spark):
    docs = helpers.documents(spark)
    rows = p.packed_digests(docs, VOCABULARY, 2).collect()
    want = defaultdict(list)
    for d in helpers.rows_of(docs):
        want[d["doc_id"]].append(ids_of(d["text"]))
    pieces = defaultdict(list)
    for r in rows:
        assert any(len(i) == r.doc_tokens and zlib.crc32(np.array(i[r.start : r.start + r.length], dtype="<u4").tobytes()) == r.ids_crc32 for i in want[r.doc_id])
        pieces[r.sequence_id].append((r.offset, r.length))
    assert sum(r.length for r in rows) == sum(len(i) for v in want.values() for i in v)
    for v in pieces.values():
        at = 0
        for offset, length in sorted(v):
            assert offset == at
            at += length
        assert at <= p.CAPACITY
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id, r.doc_tokens].append((r.start, r.length))
    for (doc, n), v in spans.items():
        copies = sum(len(i) == n for i in want[doc])
        assert sum(x for _, x in v) == n * copies and len([s for s, _ in v if s == 0]) == copies


def test_little_padding(spark):
    rnd = random.Random(4)
    docs = spark.createDataFrame([(i, helpers.words(rnd, 5 + rnd.randrange(900))) for i in range(400)], "doc_id long, text string")
    rows = p.packed_digests(docs, VOCABULARY, 2).collect()
    filled = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) * p.CAPACITY <= 1.03 * filled + p.CAPACITY


def test_added_tokens_and_ids_or_digests(spark):
    docs = spark.createDataFrame([(1, "a <|endoftext|> b"), (2, "<|STARTOFTEXT|>x"), (3, None)], "doc_id long, text string")
    ids = {r.doc_id: r.ids for r in p.pieces(docs, VOCABULARY, 2).collect() if r.start == 0}
    crcs = {r.doc_id: r.ids_crc32 for r in p.pieces(docs, VOCABULARY, 2, with_ids=False).collect() if r.start == 0}
    assert {k: zlib.crc32(v) for k, v in ids.items()} == crcs
    assert 49407 in ids_of("a <|endoftext|> b") and all(bytes(ids[i]) == np.array(ids_of(t), dtype="<u4").tobytes() for i, t in ((1, "a <|endoftext|> b"), (2, "<|STARTOFTEXT|>x"), (3, None)))


def test_sequences_hold_the_ids(spark):
    docs = helpers.documents(spark)
    placed = p.place(p.pieces(docs, VOCABULARY, 2))
    made = {r.sequence_id: r for r in p.sequences(placed).collect()}
    for r in placed.collect():
        s = made[r.sequence_id]
        assert len(s.ids) == 4 * p.CAPACITY and s.ids[4 * r.offset : 4 * (r.offset + r.length)] == r.ids
        assert not any(s.ids[4 * s.n_ids :])


def test_classes_take_as_many_pieces_as_fit(spark):
    parts = spark.createDataFrame([(i, i, 0, 37, 37, 4096 // 37) for i in range(5000)], "doc_id long, doc_key long, start long, length long, doc_tokens long, class int")
    got = p.place(parts).groupBy("sequence_id").count().collect()
    assert sorted(r["count"] for r in got) == [5000 % 110] + [110] * (5000 // 110)


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=100, deadline=None)
def test_first_fit(lengths):
    spots = p.first_fit(lengths, 64)
    bins = defaultdict(list)
    for n, (b, o) in zip(lengths, spots):
        bins[b].append((o, n))
    for v in bins.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
    assert sum(1 for v in bins.values() if sum(n for _, n in v) <= 32) <= 1


def test_empty(spark):
    assert p.packed_digests(helpers.empty(spark), VOCABULARY, 2).count() == 0


def test_crc():
    assert p.crc32_ids([1, 2]) == zlib.crc32(b"\1\0\0\0\2\0\0\0")


if __name__ == "__main__":
    pytest.main([__file__])
