"""Rules by hand, and trust and distrust against dense power iterations."""

import numpy as np

from obsynth.llm.urls import DAMPING, ROUNDS, judge_pages

PAGES = [
    ("http://a.example.net/en/1", None), ("http://A.Example.NET/de/1", ""), ("https://example.com/de/x?q", '<a href="http://good.org/fr/">'), ("https://example.com/en/x", "<a href=//b.example.com/>"),
    ("https://b.example.com/x", '<a HREF="https://example.net:80/?a">'), ("https://c.org/fr/y#z", '<a href="https://d.org/">'), ("https://d.org/en/", "<a href='/rel'>"), ("no scheme", "x"), (None, None),
    ("http://x.net", None), ("ftp://lone", ""), ("http://evil.test/", '<a href="http://example.com/">' * 3), ("http://notexample.net/en/", ""), ("http://d.org/en/", ""),
]


def dense(edges, seeds, hosts):
    n = {h: i for i, h in enumerate(hosts)}
    move = np.zeros((len(n), len(n)))
    for (s, d), w in edges.items():
        move[n[d], n[s]] += w
    move /= np.maximum(move.sum(0), 1e-300)
    home = np.zeros(len(n))
    for h, w in seeds.items():
        home[n[h]] += w
    home /= max(home.sum(), 1e-300)
    rank = home.copy()
    for _ in range(ROUNDS):
        rank = DAMPING * move @ rank + (1 - DAMPING) * home
    return {h: rank[i] for h, i in n.items()}


def test_pages(spark):
    pages = spark.createDataFrame([(i, u, h, "r", 1) for i, (u, h) in enumerate(PAGES)], "page_id long, url string, html string, rule string, host int")
    got = {r["page_id"]: r for r in judge_pages(pages).collect()}
    said = {i: (r["host"], r["path"], r["rule"]) for i, r in got.items()}
    assert said[0] == ("a.example.net", "/en/1", "example.net/en/") and said[1] == ("a.example.net", "/de/1", "net/")
    assert said[2] == ("example.com", "/de/x", "example.com/de/") and said[3][2] is None and said[5][2] == "org/fr/"
    assert said[7] == said[8] == ("", "", None) and said[9] == ("x.net", "", None) and said[12][2] == "net/"
    edges = {}
    def add(s, d, w=1.0):
        edges[s, d] = edges.get((s, d), 0) + w
    for s, d in (("example.com", "good.org"), ("example.com", "b.example.com"), ("b.example.com", "example.net:80"), ("c.org", "d.org"), ("evil.test", "example.com")):
        add(s, d)
    hosts = {r["host"] for r in got.values() if r["host"]}
    tree = set()
    for h in hosts:
        parts = h.split(".")
        tree |= {(".".join(parts[i:]), ".".join(parts[i + 1 :])) for i in range(len(parts) - 2)}  # up to the registered domain
    for a, b in tree:
        add(a, b)
        add(b, a)
    every = sorted({x for e in edges for x in e} | hosts)
    verdicts = {i: {"net/": "block", "example.com/de/": "block", "example.net/en/": "allow", "org/fr/": "allow"}.get(r["rule"]) for i, r in got.items()}
    seeds = {k: {} for k in ("allow", "block")}
    for i, v in verdicts.items():
        if v:
            seeds[v][got[i]["host"]] = seeds[v].get(got[i]["host"], 0) + 1
    trust = dense(edges, seeds["allow"], every)
    distrust = dense({(b, a): w for (a, b), w in edges.items()}, seeds["block"], every)
    for i, r in got.items():
        assert abs(r["trust"] - trust.get(r["host"], 0)) < 1e-12 and abs(r["distrust"] - distrust.get(r["host"], 0)) < 1e-12
        bad = round(distrust.get(r["host"], 0), 12) > round(trust.get(r["host"], 0), 12)
        assert r["verdict"] == (verdicts[i] or ("block" if bad else "allow"))
    assert got[11]["verdict"] == "block" and got[6]["verdict"] == "allow"
    assert judge_pages(pages.limit(0)).count() == 0


def test_suffixes_pass_nothing_on_and_links_decide(spark):
    """Blocked pages of one .com site leave other .com sites alone; links to and from seeds decide them."""
    pages = [
        ("http://example.com/de/1", None), ("http://en.example.com/x", None), ("http://other.com/", None), ("http://shop.co.uk/", None), ("http://bad.net/", None), ("http://x.bad.co.uk/", '<a href="http://bad.net/">'),
        ("http://linker.com/", '<a href="http://bad.net/1"><a href=//bad.net/2>'), ("http://good.org/fr/", '<a href="http://liked.com/">'), ("http://liked.com/", '<a href="http://bad.net/">' + '<a href="http://good.org/">' * 2 + "<p>" * 50_000),
    ]
    got = {r["host"]: r for r in judge_pages(spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")).collect()}
    verdict = {h: r["verdict"] for h, r in got.items()}
    assert verdict["en.example.com"] == "block" and verdict["other.com"] == "allow" and verdict["shop.co.uk"] == "allow"
    assert verdict["linker.com"] == "block" and verdict["x.bad.co.uk"] == "block"
    assert got["liked.com"]["trust"] > 0 and got["liked.com"]["distrust"] > 0 and got["other.com"]["distrust"] == 0
