"""What verdicts use, against the personalised PageRank of every host, solved directly."""

import random

import numpy as np

from vouchline.llm import url_filter as uf


def exact(hosts, seeds, ways, damping=uf.DAMPING):
    """Each host's personalised PageRank by a linear system, weighted by the seeds."""
    at = {h: i for i, h in enumerate(hosts)}
    step = np.zeros((len(hosts), len(hosts)))
    for a, b, w in ways:
        step[at[a], at[b]] += w
    step[step.sum(1) == 0] = np.eye(len(hosts))[step.sum(1) == 0]
    step /= step.sum(1, keepdims=True)
    ranks = [np.linalg.solve(np.eye(len(hosts)) - damping * step.T, (1 - damping) * np.eye(len(hosts))[i]) for i in range(len(hosts))]
    assert np.allclose(np.sum(ranks, axis=1), 1)
    return {h: float(ranks[at[h]] @ np.array([seeds.get(g, 0.0) for g in hosts])) for h in hosts}


def test_scores_are_personalised_pagerank(spark, monkeypatch):
    rng = random.Random(5)
    hosts = [f"h{i}.io" for i in range(24)]
    edges = {(a, b): rng.randint(1, 4) for a in hosts[:20] for b in rng.sample(hosts, 3) if a != b}
    edges |= {(a, "h3.io"): 2 for a in hosts if a != "h3.io"}  # a hub
    edges = [(a, b, w) for (a, b), w in edges.items()]
    seeds = {h: (rng.random(), rng.random()) for h in rng.sample(hosts, 7)} | {"lone.io": (0.25, 0.5)}
    rows = spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double")
    links = spark.createDataFrame(edges, "source string, target string, weight long")
    every = [*hosts, "lone.io"]
    trust = exact(every, {h: v[0] for h, v in seeds.items()}, [(b, a, w) for a, b, w in edges])
    distrust = exact(every, {h: v[1] for h, v in seeds.items()}, edges)
    for hub in (uf.HUB_LINKS, 5):
        monkeypatch.setattr(uf, "HUB_LINKS", hub)
        got = {r.host: r for r in uf.propagate(rows, links, mean=True).collect()}
        assert sorted(got) == sorted(every)
        for h in every:
            assert abs(got[h].trust - trust[h]) < 1e-6 and abs(got[h].distrust - distrust[h]) < 1e-6, h


def test_sites_are_hosts_that_have_pages(spark):
    hosts = spark.createDataFrame([(h,) for h in ("a.co.uk", "b.co.uk", "blog.a.co.uk", "x.y.blog.a.co.uk", "1.2.3.4", "2.3.4", "uk2")], "host string")
    got = {(r.source, r.target) for r in uf.site_edges(hosts).collect()}
    pairs = [("blog.a.co.uk", "a.co.uk"), ("x.y.blog.a.co.uk", "blog.a.co.uk")]
    assert got == {p for a, b in pairs for p in ((a, b), (b, a))}


def page(i, url, html=""):
    return (i, f"http://{url}", html)


def test_public_suffixes_pass_nothing_on(spark):
    pages = [page(i, f"bad.co.net/{i}") for i in range(3)] + [page(5, "m.example.com/de/1"), page(6, "fine.example.com/x"), page(7, "m.example.com/x", '<a href="//fine.example.com/">')]
    got = {r.page_id: r for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert [got[i].verdict for i in (5, 6, 7)] == ["block", "allow", "block"]
    assert got[6].host_distrust == 0 and got[7].host_distrust == 0.5  # its own share stands, though it links to a clean host


def test_long_html_and_names_by_case(spark):
    html = "<p>" + "x " * 1_000_000 + '<a href="//bad.net/">'
    rows = spark.createDataFrame([(1, "http://near.io/", html, "u"), (2, "http://bad.net/", None, None), (None, None, None, None)], "page_id long, url string, html string, URL string")
    assert sorted((str(r.page_id), r.verdict) for r in uf.judge(rows).collect()) == [("1", "block"), ("2", "block"), ("None", "allow")]
