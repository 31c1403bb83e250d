import random

import pytest

from gleaner.llm import oracles, urls
from gleaner.llm.queries import URL_RULES, op8_url_filter


def slow(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), len(h), a == "block", h + p, a) for h, p, a in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    *_, rule, action = max(fits, default=(0, 0, False, None, "allow"))
    return host, path, rule, action


def run(spark, rows, rules):
    df = spark.createDataFrame([(i, u, "h", "p", "r", 1) for i, u in rows], "page_id long, url string, host string, path string, rule string, action int")
    return sorted((tuple(r) for r in urls.judge(df, urls.rules_frame(spark, rules)).drop("url").collect()), key=str)


def test_query(spark, sf, oracle, same):
    same(oracle(oracles.OP8), op8_url_filter(spark, sf).toPandas())


ODD = [
    None, "", "no scheme", "http://", "http:///en/", "https://EXAMPLE.com/en/x?y#z", "http://example.com", "http://example.com?/en/", "http://example.com#/en/", "x://y://example.com/en/",
    "http://www.example.com/en/", "http://a.www.example.com/en/b", "http://notexample.com/en/", "http://example.com/EN/", "http://.com/", "http://com/", "http://a..com/", "http://a.net/es", "http://a.net/es/",
    "http://exämple.com/en/", "http://example.com:80/en/", "http://u@example.com/en/", "http://ÉXAMPLE.com/é\n/", "a" * 100_000 + "://b.net/fr/", "http://" + "a." * 50_000 + "net/fr/" + "x/" * 50_000,
]


def test_odd(spark):
    rows = list(enumerate(ODD)) + [(5, ODD[5]), (None, ODD[5]), (None, None)]
    assert run(spark, rows, URL_RULES) == sorted(((i, *slow(u, URL_RULES)) for i, u in rows), key=str)
    assert run(spark, [], URL_RULES) == []
    assert {r[3:] for r in run(spark, rows, [])} == {(None, "allow")}


@pytest.mark.parametrize("seed", range(5))
def test_random_rules(spark, seed):
    rng = random.Random(seed)
    host = lambda: ".".join(rng.choice(["a", "b", "ab", "net"]) for _ in range(rng.randint(1, 4)))
    path = lambda: "".join(rng.choice(["/", "/a", "/b", "b", "/ab/"]) for _ in range(rng.randint(0, 4)))
    rules = list({(h, p): (h, p, rng.choice(["allow", "block"])) for h, p in ((host(), path()) for _ in range(25))}.values())
    rows = [(i, f"http://{host()}/{path().lstrip('/')}") for i in range(150)]
    got, want = run(spark, rows, rules), sorted(((i, *slow(u, rules)) for i, u in rows), key=str)
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and len(g[3] or "") == len(w[3] or "")
        if g[3] == w[3]:
            assert g[4] == w[4]


def test_prefixes_are_confirmed(spark, monkeypatch):
    """With prefixes so short that most collide, the digests still decide."""
    monkeypatch.setattr(urls, "PREFIX_HEX", 1)
    rows = list(enumerate(ODD))
    assert run(spark, rows, URL_RULES) == sorted(((i, *slow(u, URL_RULES)) for i, u in rows), key=str)
