"""Verdicts don't depend on how many hosts share a link's target."""

from vouchline.llm import url_filter as uf


def page(i, url, *to):
    return (i, f"http://{url}", "".join(f'<a href="{t}">' for t in to))


def verdicts(spark, pages):
    return {r.page_id: r for r in uf.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}


def test_every_linker_of_a_blocked_host_is_judged_alike(spark):
    pages = [page(0, "bad.net/")] + [page(i, f"near{i}.io/x", "//bad.net/") for i in range(1, 41)]
    pages += [page(50, "mixed.io/x", "//bad.net/", "//fine.io/", "//other.io/"), page(51, "fine.io/x"), page(52, "behind.io/x", "//near1.io/")]
    got = verdicts(spark, pages)
    assert [got[i].verdict for i in range(41)] == ["block"] * 41
    assert [got[i].verdict for i in (50, 51, 52)] == ["allow", "allow", "block"]
    assert abs(got[50].host_distrust - 0.85 / 3) < 1e-6 and abs(got[52].host_distrust - 0.85**2) < 1e-6


def test_a_link_does_not_wipe_out_a_hosts_own_share(spark):
    # two rules within one host: 60 % of its pages are blocked, 40 % have no rule
    own = [page(i, f"m.example.com/de/{i}") for i in range(3)] + [page(i, f"m.example.com/x{i}") for i in (3, 4)]
    for links in ([], [page(9, "linker.io/", "//m.example.com/")]):
        got = verdicts(spark, own + links)
        assert got[3].verdict == got[4].verdict == "block" and got[3].host_distrust >= 0.6 - 1e-9


def test_trusted_linkers_keep_a_host(spark):
    got = verdicts(spark, [page(1, "ok.example.net/en/", "//ring.io/"), page(2, "ring.io/a", "//bad.net/"), page(3, "bad.net/")])
    assert got[2].host_trust == got[2].host_distrust and got[2].verdict == "allow"
