import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from cartolith.llm import url_filter as u
from cartolith.llm.queries import RULES


def brute(url, rules=RULES):
    if url is None or "://" not in url:
        host, path = "", ""
    else:
        rest = url.split("://", 1)[1]
        end = min([rest.find(c) for c in "/?#" if c in rest] + [len(rest)])
        host = "".join(c.lower() if c.isascii() else c for c in rest[:end])
        rest = rest[end:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest] + [len(rest)])]
    fits = [(h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits, key=lambda f: len(f[0]), default=(None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://net", "http://net/", "http://NET/x?y#z", "https://a.example.net/en/1", "http://example.net/EN/", "http://xexample.net/en/",
    "ftp://b.a.example.com/de/?q", "http://example.com/de", "http://a.org/fr/x", "http://fr.org?x=/fr/", "http://x/y://z", "a://b.net/c://d", "http://..net/", "http://ünet.net/ü", "http://net:80/", "http://u@net/a\nb",
]


@pytest.fixture(scope="module")
def pages(spark):
    rnd = random.Random(3)
    part = lambda: rnd.choice(["net", "org", "com", "example", "a", "en", "", "www"])
    urls = URLS * 2 + ["http" + "://" + ".".join(part() for _ in range(rnd.randrange(5))) + "/" + "/".join(part() for _ in range(rnd.randrange(4))) for _ in range(400)] + ["http://a.net/" + "x" * 100_000]
    rows = [(None if i == 3 else i, x, None, "h", "r") for i, x in enumerate(urls)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")


def check(df, pages, rules=RULES):
    got = sorted(((r.page_id, r.host, r.path, r.rule, r.verdict) for r in df.collect()), key=repr)
    assert got == sorted(((r.page_id, *brute(r.url, rules)) for r in pages.collect()), key=repr)


def test_against_brute_force(pages):
    check(u.judge(pages, RULES), pages)


@pytest.mark.parametrize("most_bytes", [10, 60, 10_000])
def test_every_number_of_parts_gives_the_same(spark, pages, most_bytes):
    more = [*RULES, ("Example.ORG", "/", "block"), ("example", "", "block"), ("a", "/x", "allow"), ("ünet.net", "/", "block"), ("net", "x", "block"), ("en/", "", "block"), ("net", "/", "allow")]
    want = [(u_lower(h), p, v) for h, p, v in more]
    check(u.judge(pages, more, most_bytes=most_bytes), pages, strongest(want))
    check(u.judge(pages, spark.createDataFrame([*more, (None, "/", "block"), ("net", None, "block")], "host string, path string, verdict string"), most_bytes=most_bytes), pages, strongest(want))


def u_lower(host):
    return "".join(c.lower() if c.isascii() else c for c in host)


def strongest(rules):
    return [(h, p, "block" if (h, p, "block") in rules else "allow") for h, p, _ in rules]


def test_no_rules_and_no_pages(spark, pages):
    check(u.judge(pages, []), pages, [])
    check(u.judge(pages, [], most_bytes=1), pages, [])
    assert u.judge(pages.limit(0), RULES).count() == 0
    assert u.judge(pages.limit(0), RULES, most_bytes=1).count() == 0


def test_small_letters_are_those_of_ascii(spark):
    pages = spark.createDataFrame([(1, "http://Ü.com/x"), (2, "http://ü.com/x"), (3, "http://A.Ü.COM/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.judge(pages, [("Ü.com", "/", "block")]).collect()}
    assert got == {1: "block", 2: "allow", 3: "block"}


@pytest.mark.parametrize("same", [False, True])
def test_the_file_and_collisions(tmp_path, same):
    """With ``same`` all digests collide, and only full strings tell rules apart."""
    names = {f"h{i}.example/": "block" if i % 3 else "allow" for i in range(500)}
    key = lambda n: 7 if same else xxhash.xxh64_intdigest(n, seed=42) - (1 << 63)
    u.write_digests(str(tmp_path / "f"), sorted((key(n), n, v) for n, v in names.items()))
    f = u.DigestFile(str(tmp_path / "f"))
    assert list(f.keys) == sorted(f.keys) and len(f.keys) == 500
    asked = ["h1.example/", "nothing", "h0.example/", "h499.example/"]
    found, verdicts = f.find(np.array([key(n) for n in asked]), pa.array(asked))
    assert found.tolist() == [0, 2, 3] and verdicts == [names[asked[i]] for i in found]


def test_parts_cover_the_range(spark):
    keys = [-(1 << 63), -(1 << 62), -1, 0, 1, 1 << 62, (1 << 63) - 1]
    got = [r.p for r in spark.createDataFrame([(k,) for k in keys], "k long").select(u.part_of(F.col("k"), 4).alias("p")).collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 3


def test_a_wrong_verdict_is_refused(spark, pages):
    with pytest.raises(ValueError):
        u.judge(pages, [("a", "/", "maybe")])
    with pytest.raises(Exception, match="maybe"):
        u.judge(pages, spark.createDataFrame([("a", "/", "maybe")], "host string, path string, verdict string")).collect()
