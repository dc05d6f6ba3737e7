import hashlib
import random
import zlib

import pytest

import helpers
from cartolith.llm import media


def want(text):
    raw = (text or "").encode()
    data = raw + b" " * (-len(raw) % 192 if raw else 192)
    return len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-16:])


@pytest.mark.parametrize("bits", [None, 4096, 0])
def test_round_trip(spark, bits):
    """With a small bitmap nearly all payloads go the way of shared chunks; the values are the same."""
    docs = helpers.documents(spark)
    got = media.stored_media(docs, bits).collect()
    told = lambda r: (r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)
    assert sorted(map(repr, map(told, got))) == sorted(repr((d["doc_id"], *want(d["text"]))) for d in helpers.rows_of(docs))
    stored = {}
    for r in got:
        assert stored.setdefault(r.payload_sha256, (r.media_bytes, r.media_sha256, r.feature)) == (r.media_bytes, r.media_sha256, r.feature)
    data = media.payload_of("one")
    import zstandard

    frames = [zstandard.ZstdCompressor(level=media.LEVEL).compress(c) for c in media.chunks_of(data)]
    form = media.manifest([media.digest_of(c) for c in media.chunks_of(data)], [len(c) for c in media.chunks_of(data)]) + b"".join(frames)
    assert stored[hashlib.sha256(data).hexdigest()][:2] == (len(form), hashlib.sha256(form).hexdigest())


def test_chunks_are_stored_once(spark):
    rnd = random.Random(1)
    long = helpers.words(rnd, 8000)
    docs = spark.createDataFrame([(i, f"{i} " + long) for i in range(12)], "doc_id long, text string")
    alone, lists, chunks = media.store(docs)
    assert alone.count() == 0 and lists.count() == 12
    total = sum(len(media.chunks_of(media.payload_of(f"{i} " + long))) for i in range(12))
    assert chunks.count() == chunks.select("digest").distinct().count() < total / 4


def test_cuts_follow_content():
    rnd = random.Random(2)
    text = helpers.words(rnd, 20_000).encode()
    a, b = media.chunks_of(text), media.chunks_of(b"something in front " + text)
    assert b"".join(a) == text and len(set(a) & set(b)) >= len(a) - 3
    assert all(media.LEAST <= len(c) <= media.MOST for c in a[:-1]) and len(a[-1]) <= media.MOST
    assert media.chunks_of(b"x" * 100_000) == [b"x" * media.MOST] * (100_000 // media.MOST) + [b"x" * (100_000 % media.MOST)]


def test_rolling_hash_is_the_sum_of_its_window():
    data = bytes(random.Random(3).randrange(256) for _ in range(500))
    h = media.gear_hashes(data)
    for i in (0, 5, 31, 32, 499):
        want_ = sum(int(media.GEAR[data[i - k]]) << k for k in range(min(i + 1, 32))) & 0xFFFFFFFF
        assert int(h[i]) == want_


def test_damage_is_seen():
    c = media.chunks_of(media.payload_of("x" * 5000))
    import zstandard

    z = zstandard.ZstdCompressor()
    with pytest.raises(ValueError):
        media.rebuild([media.digest_of(x) for x in c], [z.compress(x[::-1] + b"!") for x in c])


def test_empty(spark):
    assert media.stored_media(helpers.empty(spark)).count() == 0


def test_the_bitmap_grows_with_the_input(spark, monkeypatch):
    docs = helpers.documents(spark)
    assert media.bits_for(helpers.empty(spark)) == media.LEAST_BITS <= media.bits_for(docs) <= media.MOST_BITS
    monkeypatch.setattr(media, "LEAST_BITS", 1)
    monkeypatch.setattr(media, "MOST_BITS", 4)
    assert media.bits_for(docs) == 0
