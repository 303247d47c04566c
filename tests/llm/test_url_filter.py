"""URL parts, given rules and mined rules against plain Python."""

import random
import re
from itertools import combinations

from docketry.llm import url_filter as U
from docketry.llm.queries import URL_RULES

ODD = [None, "", "no scheme", "://", "http://", "HTTP://WWW.Example.NET/EN/x", "http://example.net/en/1?x=http://b.net/",
       "http://example.net/english", "https://a.b.example.net/en/", "https://badexample.net/en/", "ftp://x.org/fr/9#top",
       "https://x.org?u=/fr/", "http://example.com/de/1.html", "http://example.com#/de/", "http://É.net/ü", "http://net/",
       "http://net", "x://y://z.net/q", "http://a.net:80/en/", "http://a.net/\nline"]


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return re.sub("[A-Z]", lambda m: m.group().lower(), host), re.match(r"[^?#]*", rest[len(host):]).group()


def given(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def labelled(n=400, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        host = rng.choice(["cheap", "news", "blog", "m"]) + rng.choice([".pills", ".daily", ""]) + ".example." + rng.choice(["info", "org"])
        url = f"http{rng.choice(['', 's'])}://{host}/{rng.choice(['en', 'fr'])}/{i}{rng.choice(['', '?utm=1', '#top'])}"
        rows.append((url, (".pills" in host and "/en/" in url) or rng.random() < .1))
    return rows


def test_verdicts_agree_with_brute_force(spark):
    train = labelled()
    p = U.UrlRules(support=0.02, confidence=0.6)
    urls = [*ODD, *[u for u, _ in labelled(80, 9)], train[0][0], train[0][0]]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = U.mine(spark.createDataFrame(train, "url string, bad boolean"), p)
    got = {r.id: r for r in U.judge(pages, rules, URL_RULES).collect()}
    has = {r.url: set(r.t) for r in spark.createDataFrame(
        [(u,) for u in {*urls, *[u for u, _ in train]} if u is not None], "url string").select("url", U.tokens(U.F.col("url")).alias("t")).collect()}
    mined = {}
    seen = {frozenset(c) for u, bad in train if bad for n in range(1, len(has[u]) + 1) for c in combinations(sorted(has[u]), n)}
    for items in seen:
        both = sum(bad for u, bad in train if items <= has[u])
        if both >= p.support * len(train) and both / sum(items <= has[u] for u, _ in train) >= p.confidence:
            mined[items] = both / sum(items <= has[u] for u, _ in train)
    assert {frozenset(r["items"]) for r in rules.collect()} == set(mined) and mined
    blocked = 0
    for key, url in enumerate(urls):
        host, path = parts(url)
        rule, verdict = given(host, path)
        best = max((c for items, c in mined.items() if url and items <= has[url]), default=None)
        blocked += rule is None and best is not None
        assert (got[key].host, got[key].path, got[key].rule) == (host, path, rule), url
        assert got[key].verdict == (verdict or ("block" if best else "allow")), url
        assert best is None or abs(got[key].confidence - best) < 1e-12
    assert blocked


def test_nothing_mined(spark):
    none = spark.createDataFrame([], "url string, bad boolean")
    pages = spark.createDataFrame([(1, "http://a.info/"), (1, "http://a.info/"), (None, None)], "i long, u string")
    assert [r.verdict for r in U.judge(pages, U.mine(none), URL_RULES).collect()] == ["allow"] * 3
    assert U.judge(pages.limit(0), U.mine(none), URL_RULES).collect() == []


def test_equal_evidence_counts_equally_in_tables_of_any_size(spark):
    few = [(f"http://thin.example.info/{i}", True) for i in range(4)]
    spam = [(f"http://spam.example.info/{i}", True) for i in range(5)]
    for size in (3, 6000):
        good = [(f"http://h{i % 300}.example.org/en/{i}", False) for i in range(size)]
        rules = U.mine(spark.createDataFrame(few + spam + good, "url string, bad boolean"))
        items = {x for r in rules.collect() for x in r["items"]}
        assert "host=spam" in items and "host=thin" not in items
