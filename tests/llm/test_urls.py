import re

import pytest
from pyspark.sql import functions as F

from meridian.llm import urls

PAGES = [
    (1, "http://a.example.com/en/1", '<a href="http://bad2.net/es/1">x</a> <A HREF=\'//c.org/y\'>'), (2, "https://www.example.com/en/x?y#z", '<a href="http://good.com/">'), (3, "HTTP://UPPER.COM/Path?q", "<a href='/local'>"),
    (4, "http://bad.net/es/2", None), (5, "http://bad.net/es/3", ""), (6, "http://links-to-bad.org/", '<a href="http://bad.net/es/2">a</a>' * 3), (7, "nourl", "x"), (8, None, None), (9, "://only.org", ""),
    (10, "http://example.com", ""), (11, "http://notexample.com/en/", ""), (12, "http://x.net/fr/", ""), (13, "http://c.org/a/b?c=/en/", ""), (14, "http://bad.net/other", ""), (4, "http://bad.net/es/2", None), (15, "http://é.com/en/ü#f", ""),
]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def split_url(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.split("[?#]", rest[len(host):], maxsplit=1)[0]


def brute_scores(pages, damping=urls.DAMPING, rounds=200):
    hosts = {}
    for _, u, _ in pages:
        h, p = split_url(u)
        if h:
            hosts.setdefault(h, []).append(brute_rule(h, p)[1])
    edges = {}
    for _, u, html in pages:
        src = split_url(u)[0]
        for href in set(re.findall(r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)""", html or "")):
            dst = split_url("http:" + href if href.startswith("//") else href)[0]
            if src and dst and src != dst:
                edges[src, dst] = edges.get((src, dst), 0) + 1
    out = {}
    for kind, verdict in (("trust", "allow"), ("distrust", "block")):
        way = edges if kind == "trust" else {(b, a): n for (a, b), n in edges.items()}
        names = {*hosts, *(x for e in way for x in e)}
        seed = {h: sum(v == verdict for v in hosts.get(h, [])) / max(1, len(hosts.get(h, []))) for h in names}
        r, total = dict(seed), {h: sum(n for (a, _), n in way.items() if a == h) for h in names}
        for _ in range(rounds):
            r = {h: seed[h] + damping * sum(r[a] * n / total[a] for (a, b), n in way.items() if b == h) for h in names}
        out[kind] = r
    return out


@pytest.mark.parametrize("pages", [PAGES, [p for p in PAGES if not (p[2] or "").strip()]])
def test_judgement(spark, pages, monkeypatch):
    monkeypatch.setattr(urls, "ROUNDS", 60)
    monkeypatch.setattr(urls, "CLOSE", 1e-9)
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("x"), "trust": F.lit(1)})
    scores = brute_scores(pages)
    rows = urls.judge(df).collect()
    assert len(rows) == len(pages)
    by_id = {i: u for i, u, _ in pages}
    for r in rows:
        host, path = split_url(by_id[r.id])
        rule, verdict = brute_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule)
        if host:
            assert r.trust == pytest.approx(scores["trust"][host], abs=1e-4) and r.distrust == pytest.approx(scores["distrust"][host], abs=1e-4)
            verdict = verdict or ("block" if scores["distrust"][host] - scores["trust"][host] > urls.THRESHOLD else "allow")
        assert r.verdict == (verdict or "allow")


def test_unlinked_hosts_do_not_end_the_rounds(spark):
    chain = [(1, "http://w.org/", '<a href="http://x.org/">'), (2, "http://x.org/", '<a href="http://bad.net/es/">'), (3, "http://bad.net/es/", "")]
    rows = urls.judge(spark.createDataFrame(chain + [(i, f"http://h{i}.com/", "") for i in range(10, 10_010)], "page_id long, url string, html string")).where("id < 10").collect()
    scores = brute_scores(chain, rounds=10)
    assert len(rows) == 3 and all(r.distrust == pytest.approx(scores["distrust"][r.host], abs=1e-4) and r.verdict == "block" for r in rows)


def test_distrust_flows_back_along_links(spark):
    rows = {r.id: r.verdict for r in urls.judge(spark.createDataFrame(PAGES, "page_id long, url string, html string")).collect()}
    assert rows[6] == "block" and rows[14] == "block" and rows[13] == "allow"


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
