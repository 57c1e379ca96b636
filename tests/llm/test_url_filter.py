"""Rules and parsing case by case; propagation against a dense iteration."""

from vouchline.llm import url_filter as uf

CASES = [
    (None, "", "", None), ("no scheme", "", "", None), ("http://A.Net/x?y#z", "a.net", "/x", "net/"), ("http://net", "net", "", None), ("x://net/", "net", "/", "net/"),
    ("http://sub.example.net/en/a", "sub.example.net", "/en/a", "example.net/en/"), ("http://notexample.net/en/", "notexample.net", "/en/", "net/"),
    ("http://example.com/de", "example.com", "/de", None), ("http://m.example.com/de/1", "m.example.com", "/de/1", "example.com/de/"), ("a://É.ORG/fr/?q", "É.org", "/fr/", "org/fr/"),
    ("http://a\nb.net/x\ny", "a\nb.net", "/x\ny", "net/"), ("u://h://k/p", "h:", "//k/p", None), ("http://?x", "", "", None),
]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, None, "r") for i, (u, *_) in enumerate(CASES)] + [(0, None, None, "r")], "page_id long, url string, html string, rule string")
    got = uf.judge(pages).collect()
    assert len(got) == len(CASES) + 1
    for r in got:
        assert (r.host, r.path, r.rule) == CASES[r.page_id][1:], CASES[r.page_id]
        allowed = dict(uf.RULES).get(r.rule)
        assert allowed is None or r.verdict == ("allow" if allowed else "block")
    assert uf.judge(pages.limit(0)).count() == 0


def dense(seeds, edges, kind):
    hosts = sorted({*seeds, *(h for e in edges for h in e[:2])})
    s = {h: seeds.get(h, (0, 0))[kind] for h in hosts}
    ways = [(a, b, w) if kind == 0 else (b, a, w) for a, b, w in edges]
    total = {h: sum(w for a, _, w in ways if a == h) for h in hosts}
    r = dict(s)
    for _ in range(200):
        r = {h: 0.15 * s[h] + 0.85 * (sum(r[a] * w / total[a] for a, b, w in ways if b == h) + (0 if total[h] else r[h])) for h in hosts}
    return r


def test_propagation(spark):
    seeds = {"a": (1.0, 0.0), "b": (0.0, 1.0), "c": (0.25, 0.5), "lone": (0.0, 0.75)}
    edges = [("a", "d", 3), ("a", "c", 1), ("d", "e", 1), ("e", "b", 2), ("f", "b", 5), ("c", "a", 1)]
    got = {r.host: r for r in uf.propagate(spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "source string, target string, weight long")).collect()}
    for k, name in enumerate(("trust", "distrust")):
        for h, v in dense(seeds, edges, k).items():
            assert abs(got[h][name] - v) < 2e-3, (h, name)
    assert got["f"].distrust > got["d"].distrust


def test_links_and_verdicts(spark):
    page = lambda i, h, *to: (i, f"http://{h}/p{i}", "".join(f'<a class=x HREF="{t}">' for t in to))
    pages = spark.createDataFrame([page(1, "bad.net"), page(2, "near.io", "//bad.NET/x", "/local", "https://near.io/y"), page(3, "far.io", "https://ok.io/")], "page_id long, url string, html string")
    got = {r.page_id: r for r in uf.judge(pages).collect()}
    assert [got[i].verdict for i in (1, 2, 3)] == ["block", "block", "allow"]
