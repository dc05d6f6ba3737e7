import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

import helpers
from cartolith.llm import tokenbin as b
from cartolith.llm.common import scratch_path
from cartolith.llm.encoding import MemoEncoder
from cartolith.llm.queries import vocabulary

VOCABULARY = vocabulary("byte_bpe_50k.json")


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(VOCABULARY)
    return t


@given(st.lists(st.integers(0, 65535), max_size=300), st.sampled_from(["byte", "bit"]), st.sampled_from([2, 4]), st.sampled_from([1, 7, 64]))
@settings(max_examples=200, deadline=None)
def test_frames_round_trip(ids, kind, width, block):
    x = np.array(ids, dtype=f"<u{width}")
    lengths = [len(ids)] if ids else []
    got, docs = b.decode_frame(b.encode_frame(x, lengths, kind, block))
    assert got.dtype == x.dtype and (got == x).all() and docs.tolist() == lengths


def test_planes_are_bytes_and_bits():
    x = np.array([0x0102, 0x0304], dtype="<u2")
    assert b.to_planes(x, "byte") == [b"\x02\x04", b"\x01\x03"]
    bits = b.to_planes(x, "bit")
    assert len(bits) == 16 and bits[1] == b"\x01" and bits[2] == b"\x02"


def test_damage_is_seen():
    frame = bytearray(b.encode_frame(np.arange(1000, dtype="<u2"), [1000]))
    with pytest.raises(ValueError):
        b.decode_frame(b"XXXX" + bytes(frame[4:]))
    at = b.HEAD.size + 4
    frame[at] ^= 1
    with pytest.raises(ValueError):
        b.decode_frame(bytes(frame))


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_documents_come_back_in_order(spark, kind):
    docs = helpers.documents(spark)
    path = scratch_path(spark, "t")
    b.write_frames(docs, path, VOCABULARY, 0, kind, block=1000, frame_ids=3000, shard_rows=20)
    got = sorted(b.read_documents(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    t = library()
    at, left = 0, {}
    for d in helpers.rows_of(docs):
        ids = np.array(t.encode(d["text"] or "", add_special_tokens=False).ids + [0], dtype="<u4")
        left.setdefault(d["doc_id"], []).append(ids.tobytes())
    last = None
    for r in got:
        assert r.start == at and r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.n_tokens
        left[r.doc_id].remove(bytes(r.ids))
        at += r.n_tokens
        assert last is None or (r.doc_id is not None and r.doc_id >= last)
        last = r.doc_id if r.doc_id is not None else last
    assert not any(left.values())
    assert spark.read.parquet(path).select("shard").distinct().count() > 1


def test_query_shape_and_empty(spark):
    assert b.stored_documents(helpers.documents(spark), VOCABULARY, 0).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert b.stored_documents(helpers.empty(spark), VOCABULARY, 0).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_memo_gives_the_library_s_ids(name):
    rnd = random.Random(6)
    letters = list("ab  \n\t'sStT1.,0\x1c\x85\xa0éß́Σς中 <|endoftext|>\r\0\1")
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(30))) for _ in range(20_000)]
    texts += ["", " ", "a <|endoftext|> b", " x", "\nfoo", "foo\n", "foo ", "İ, i̇.", "a<|endoftext|>b <|ENDOFTEXT|> <|startoftext|>,", "x, y. <|EndOfText|>z", "x" * 5000, helpers.words(rnd, 2000), "It's, don't. 3.14,5\nNext"]
    e = MemoEncoder(vocabulary(name), memo_bytes=100_000)
    got = []
    for i in range(0, len(texts), 512):
        got += e.encode(texts[i : i + 512])
    from tokenizers import Tokenizer

    untouched = Tokenizer.from_file(vocabulary(name))
    want = [np.array(x.ids, dtype=e.dtype).tobytes() for x in untouched.encode_batch(texts, add_special_tokens=False)]
    assert [t for t, g, w in zip(texts, got, want) if g != w] == []
    assert e._held <= 100_000 + 512 * 40 * 250
    e.settle()
    assert not e._old and e.encode(texts[:50]) == want[:50]


def test_added_tokens_have_their_own_ids():
    for name, told in (("byte_bpe_50k.json", 50256), ("word_bpe_49k.json", 49407)):
        e = MemoEncoder(vocabulary(name))
        assert told in np.frombuffer(e.encode(["a <|endoftext|> b"])[0], dtype=e.dtype)
