"""URL filters against plain loops over all rules."""

import random
import re

import numpy as np
import pytest

from plumbline.llm import queries, url_filter

RULES = queries.URL_RULES


def plain(url, rules, words=url_filter.WORDS):
    found = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = found.groups() if found else ("", "")
    host = re.sub("[A-Z]", lambda m: m.group().lower(), host)
    best = max(
        (
            (len((h + p).encode()), len(h.encode()), h + p, v)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ),
        default=None,
    )
    if best:
        return host, path, best[2], best[3]
    bad = any(w in words for w in re.split(r"[\x00-/:-@\[-`{-\x7f]+", host) if w)
    return host, path, None, "block" if bad else "allow"


URLS = [
    None, "", "no scheme/en/", "http://", "http://net", "http://net/", "https://EXAMPLE.net/en/x?y#z", "http://www.Example.NET/en/",
    "http://notexample.net/en/", "http://example.net/en", "http://a.example.com/de/1", "http://a.example.com/fr/de/", "ftp://x.org/fr/",
    "http://x.org/FR/", "http://u:p@x.net:80/", "http://x.net:80", "http://x.net?/en/", "http://x.net#/", "a://b://c.net/", "http://casino.example.org/",
    "http://my-casino.example.org", "http://casinos2.example.org/", "http://ünet.net/é\nü", "http://ñ.example.net/en/ü", "://.net/", "http://..net/", "http://x.net//",
]


def judged(spark, urls, rules, **more):
    rows = [(i, u, "x") for i, u in enumerate(urls)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string").repartition(3)
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    got = {r.page_id: tuple(r)[1:] for r in url_filter.judge_urls(pages, listed, **more).collect()}
    return [got[i] for i in range(len(urls))]


def test_given_rules(spark):
    assert judged(spark, URLS, RULES) == [plain(u, RULES) for u in URLS]


def test_random_rules_and_urls(spark):
    rng = random.Random(4)
    label = lambda: rng.choice(["a", "b", "net", "é", "xxx", ""])
    host = lambda n: ".".join(label() for _ in range(rng.randrange(1, n)))
    path = lambda: "".join(rng.choice(["/", "a", "é", "/b"]) for _ in range(rng.randrange(4)))
    rules = {(host(4), path()): rng.choice(["allow", "block"]) for _ in range(60)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [f"s://{host(6)}{rng.choice(['', '/', '?', '#'])}{path()}" for _ in range(1500)]
    got = judged(spark, urls, rules, words=["xxx"])
    assert got == [plain(u, rules, ["xxx"]) for u in urls]
    assert {v for *_, v in got} == {"allow", "block"} and None in {r for *_, r, _ in got}


def test_null_rules_ties_and_empty_lists(spark):
    assert judged(spark, ["s://a.b/c", None], [("B", "/c", "allow"), ("b", "/c", None)]) == [("a.b", "/c", "b/c", "block"), ("", "", None, "allow")]
    assert judged(spark, ["s://a.b/c", None], [(None, None, "block")]) == [("a.b", "/c", None, "allow"), ("", "", "", "block")]
    # Equally long: the longer host wins.
    assert judged(spark, ["s://a.b/en"], [("a.b", "/", "allow"), ("b", "/en", "block")])[0][2:] == ("a.b/", "allow")
    empty = spark.createDataFrame([], "host string, path string, verdict string")
    pages = spark.createDataFrame([(None, "s://porn.b/"), (None, "s://porn.b/"), (1, "s://a/")], "page_id bigint, url string")
    got = url_filter.judge_urls(pages, empty)
    assert sorted((r.page_id or 0, r.verdict) for r in got.collect()) == [(0, "block"), (0, "block"), (1, "allow")]
    assert {r.verdict for r in url_filter.judge_urls(pages, empty, words=()).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), empty).count() == 0


def test_colliding_digests_are_no_match():
    same = lambda strings: np.array([len(s) % 2 for s in strings], dtype=np.uint64)
    entries = [(b"one", 1), (b"three", 3), (b"four", 4), (b"one", 7), (b"", 0)]
    array = url_filter.DigestArray(*url_filter.DigestArray.parts(entries, same))
    asked = [b"two", b"one", b"four", b"five", b"", b"three"]
    at, values = array.find(asked, same)
    assert sorted(zip(at.tolist(), values.tolist(), strict=True)) == [(1, 1), (1, 7), (2, 4), (4, 0), (5, 3)]


def test_long_hosts_take_little(spark):
    urls = ["http://" + "a." * 200_000 + "example.net/en/" + "b" * 400_000, "http://" + "." * 300_000]
    assert judged(spark, urls, RULES) == [plain(u, RULES) for u in urls]


def test_bound_of_the_list(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_BYTES", 100)
    with pytest.raises(ValueError, match="bound"):
        judged(spark, URLS, RULES)


def test_list_is_shared_once(spark):
    first = url_filter.filter_file(spark, spark.createDataFrame(RULES, "host string, path string, verdict string"))
    count = len(spark.sparkContext.listFiles)
    again = url_filter.filter_file(spark, spark.createDataFrame(RULES[::-1], "host string, path string, verdict string"))
    assert first == again and len(spark.sparkContext.listFiles) == count
