"""Propagation ends at the fixpoint, not after a number of rounds."""

from vouchline.llm import url_filter as uf


def test_dangling_ends_and_cycles_are_settled(spark):
    seeds = {"a": (1.0, 0.0), "b": (0.0, 1.0)}
    edges = [("a", "b", 1), ("b", "c", 1), ("c", "b", 3), ("c", "end", 1)]
    got = {r.host: r for r in uf.propagate(spark.createDataFrame([(h, *v) for h, v in seeds.items()], "host string, trust double, distrust double"), spark.createDataFrame(edges, "source string, target string, weight long")).collect()}
    hosts = ["a", "b", "c", "end"]
    for k, name in enumerate(("trust", "distrust")):
        ways = [(a, b, w) if k == 0 else (b, a, w) for a, b, w in edges]
        total = {h: sum(w for a, _, w in ways if a == h) for h in hosts}
        seed = {h: seeds.get(h, (0, 0))[k] for h in hosts}
        want = dict(seed)
        for _ in range(400):
            want = {h: 0.15 * seed[h] + 0.85 * (sum(want[a] * w / total[a] for a, b, w in ways if b == h) + (0 if total[h] else want[h])) for h in hosts}
        for h in hosts:
            assert abs(got[h][name] - want[h]) < 1e-6, (h, name)
