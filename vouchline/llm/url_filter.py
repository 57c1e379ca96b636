"""URL filter: explicit rules first, then personalised PageRank from trusted and blocked seeds over host edges.

A host's seed of trust is the share of its pages that a rule allows, its seed of distrust the share that one blocks.
Trust follows links and distrust goes against them. A host is judged by its personalised PageRank: of a walk that
restarts at the host and else takes one of its links (distrust; trust: one of the links to it), the share of time on
seeds, weighted by them; a host without such a link is walked on for ever. These shares need no scale, as they lie between 0 and 1
whatever the graph's size and however many others link to a seed. They are found for all hosts at once by starting at
the seeds and going the other way (contributions to the seeds), not by a walk a host. A page without a rule is blocked
if its host's distrust is at least ``THRESHOLD`` and over its trust, where each is the larger of that share and the
host's own seed: links to clean hosts don't clear a host whose own pages are blocked. ``propagate`` also has
the flow that keeps mass: PageRank scores with the seeds as teleport.

Host edges have two sources. Links are the absolute and protocol-relative ``href`` targets of the pages; a link
from a host to itself says nothing about either and is left out. Site edges join a host and the next domain above it
that is a host of the pages or a link's target itself, both ways: who runs ``example.com`` answers for
``blog.example.com``. A public suffix such as ``co.uk`` joins nothing, as it has no pages.
All pages of a host pair are counted before the graph is used, so the iteration works on distinct host edges
however hot a host is; a hub's scores are summed in its senders' tasks first and its links dealt to several tasks.

Defined results: a null url, or one without ``://``, has empty host and path, fits no rule, and is allowed;
repeated rows count as pages each; null html has no links, and html of any length is searched whole; an empty
table gives an empty result; other columns, also such that differ in case only, are ignored.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vouchline.llm.common import forget, join_hot, materialise, pick, table

#: (rule, allowed); a rule is a host followed by a path prefix.
RULES = (("net/", False), ("example.net/en/", True), ("example.com/de/", False), ("org/fr/", True))
DAMPING = 0.85
THRESHOLD = 0.5
#: TOLERANCE bounds what all rounds still to come could change.
CHECK_EVERY, TOLERANCE = 8, 1e-6
BROADCAST_HOSTS = 200_000
#: Links that a host sends along from one task; more are dealt to further ones.
HUB_LINKS = 100_000
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_HREF = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def parsed(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty without ``://``. The first match is at the first ``://``."""
    known = F.coalesce(url, F.lit(""))
    return _lower(F.regexp_extract(known, _URL, 1)), F.regexp_extract(known, _URL, 2)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and whether it allows, both null if none fits."""
    rule = allowed = F.lit(None)
    for text, ok in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, prefix = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + prefix)
        rule, allowed = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(ok)).otherwise(allowed)
    return rule.cast("string"), allowed.cast("boolean")


def host_edges(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """source, target, weight of links between different hosts."""
    links = pages.where(f"{host} <> ''").select(F.col(host).alias("source"), F.explode(F.regexp_extract_all(F.coalesce(F.col(html), F.lit("")), F.lit(_HREF), 1)).alias("target"))
    return links.select("source", _lower(F.col("target")).alias("target")).where("source <> target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def site_edges(hosts: DataFrame) -> DataFrame:
    """hosts (host, distinct) -> source, target, weight 1 between every host and the nearest domain above it among the hosts, both ways."""
    labels = hosts.where(~F.col("host").rlike(r"^[0-9.]+(:[0-9]+)?$")).select("host", F.split("host", r"\.").alias("l")).where("size(l) > 1")
    above = labels.select("host", F.posexplode(F.transform(F.sequence(F.lit(2), F.size("l")), lambda i: F.array_join(F.slice("l", i, F.size("l")), "."))).alias("up", "parent"))
    known = above.join(hosts.select(F.col("host").alias("parent")), "parent", "left_semi")
    pairs = known.groupBy("host").agg(F.min_by("parent", "up").alias("parent"))
    both = F.array(F.struct(F.col("host").alias("source"), F.col("parent").alias("target")), F.struct(F.col("parent").alias("source"), F.col("host").alias("target")))
    return pairs.select(F.explode(both).alias("e"), F.lit(1).cast("bigint").alias("weight")).select("e.*", "weight")


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = DAMPING, mean: bool = False) -> DataFrame:
    """seeds (host, trust, distrust) -> host, trust, distrust over all hosts of seeds and edges.

    Without ``mean`` a host deals its score out to its ways on (PageRank with the seeds as teleport). With it a host
    keeps 1 - damping of its seed and takes damping of the mean over its ways in: what its own personalised PageRank,
    walking those ways backwards, holds of the seeds. A host without a way on (with ``mean``: in) keeps what it has.

    Both propagations run as one: flow (kind, a, b, share) sends kind's score from a to b, and one aggregate of
    what is sent and of the seeds makes a round. Every eighth round is a written table, so lineage is short and a
    lost executor repeats eight rounds at most. Rounds go on until the tolerance holds; a round's change shrinks
    by the damping, so their number grows with the log of the seeds' mass only. Without edges there are none.
    """
    if edges.isEmpty():
        return seeds.select("host", *(F.coalesce(c, F.lit(0.0)).alias(c) for c in ("trust", "distrust")))
    ways = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("a"), F.col("target").alias("b"), "weight").unionByName(
        edges.select(F.lit("distrust").alias("kind"), F.col("target").alias("a"), F.col("source").alias("b"), "weight")
    )
    totals = ways.groupBy("kind", F.col("b" if mean else "a").alias("host")).agg(F.sum("weight").alias("total"))
    fan = ways.groupBy("kind", F.col("a").alias("host")).agg((1 + F.floor(F.count(F.lit(1)) / HUB_LINKS)).cast("int").alias("tasks"))
    hosts = seeds.select("host").unionByName(edges.select(F.col("source").alias("host"))).unionByName(edges.select(F.col("target").alias("host"))).distinct()
    stock = hosts.join(seeds, "host", "left").select("host", F.explode(F.create_map(F.lit("trust"), F.coalesce("trust", F.lit(0.0)), F.lit("distrust"), F.coalesce("distrust", F.lit(0.0)))).alias("kind", "seed"))
    # a host without a way on keeps its score: that loop's sum is known, so it takes no rounds
    stock = stock.join(totals, ["kind", "host"], "left").join(fan, ["kind", "host"], "left")
    stock = materialise(stock.select("kind", "host", "seed", F.col("total").isNotNull().alias("flows"), F.coalesce("tasks", F.lit(1)).alias("tasks")), "stock")
    shares = ways.join(totals.withColumnRenamed("host", "b" if mean else "a"), ["kind", "b" if mean else "a"])
    tasks = fan.select("kind", F.col("host").alias("a"), "tasks")
    flow = materialise(shares.join(tasks, ["kind", "a"]).select("kind", "a", "b", (F.col("weight") / F.col("total")).alias("share"), F.pmod(F.xxhash64("b"), F.col("tasks")).cast("int").alias("task")), "flow")
    return _settle(stock, flow, damping, mean).groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))


def _settle(stock: DataFrame, flow: DataFrame, damping: float, mean: bool) -> DataFrame:
    """kind, host, score at the fixpoint."""
    mass = 1.0 if mean else max(1.0, stock.agg(F.sum("seed")).first()[0] or 0.0)
    # after a change of c over the rounds between two checks, all rounds to come change c * q / (1 - q) at most; a flow's
    # ends keep 1 / (1 - damping) of what they get
    q = damping**CHECK_EVERY
    least = TOLERANCE * (1 - q) / q * (1.0 if mean else (1 - damping) ** 2)
    given = stock.select("kind", "host", "seed", "flows", "tasks", F.lit(0.0).alias("got"))
    state = stock.select("kind", "host", F.col("seed").alias("score"), "tasks")
    written = []
    for _ in range(0, math.ceil(math.log(least / mass) / math.log(damping)) + CHECK_EVERY, CHECK_EVERY):
        now = state
        for _ in range(CHECK_EVERY):
            known = now.select("kind", F.col("host").alias("a"), "score", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1)).alias("task"))
            sent = flow.join(known, ["kind", "a", "task"]).select(
                "kind", F.col("b").alias("host"), F.lit(None).cast("double").alias("seed"), F.lit(None).cast("boolean").alias("flows"), F.lit(None).cast("int").alias("tasks"), (F.col("score") * F.col("share")).alias("got")
            )
            got = damping * F.col("got")
            kept = F.col("seed") if mean else F.col("seed") + got / (1 - damping)
            score = F.when(F.col("flows"), (1 - damping) * F.col("seed") + got).otherwise(kept)
            now = given.unionByName(sent).groupBy("kind", "host").agg(*(F.max(c).alias(c) for c in ("seed", "flows", "tasks")), F.sum("got").alias("got")).select("kind", "host", score.alias("score"), "tasks")
        old = state.select("kind", "host", F.col("score").alias("old"))
        after = materialise(now.join(old, ["kind", "host"]), "scores")
        if written:
            forget(written.pop())
        written.append(after)
        state = after.drop("old")
        change = F.abs(F.col("score") - F.col("old"))
        if (after.agg(F.max(change) if mean else F.sum(change)).first()[0] or 0.0) < least:
            break
    return state


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, host, path, rule, verdict, host_trust, host_distrust of every row."""
    rows = pick(pages, id_col, url_col, html_col).toDF("__id", "url", "html")
    host, path = parsed(F.col("url"))
    known = rows.withColumn("host", host).withColumn("path", path)
    rule, allowed = rule_of(F.col("host"), F.col("path"), rules)
    ruled = known.withColumn("rule", rule).withColumn("allowed", allowed)
    share = lambda ok: F.avg(F.when(F.col("allowed") == ok, 1.0).otherwise(0.0))
    seeds = materialise(ruled.where("host <> ''").groupBy("host").agg(share(True).alias("trust"), share(False).alias("distrust"), F.count(F.lit(1)).alias("n")), "seeds")
    links = materialise(host_edges(known), "links")
    met = seeds.select("host").unionByName(links.select(F.col("target").alias("host"))).distinct()
    edges = materialise(links.unionByName(site_edges(met)).groupBy("source", "target").agg(F.sum("weight").alias("weight")), "host-edges")
    scores = propagate(seeds.drop("n"), edges, mean=True)
    most = lambda c: F.greatest(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(f"host_{c}")
    told = materialise(scores.alias("p").join(seeds.alias("s"), F.col("p.host") == F.col("s.host")).select("s.host", most("trust"), most("distrust"), "s.n"), "told")
    bare = ruled.drop("html")
    with_host = join_hot(bare.where("host <> ''"), told, "host", "n", BROADCAST_HOSTS)
    out = with_host.unionByName(bare.where("host = ''").withColumn("host_trust", F.lit(None).cast("double")).withColumn("host_distrust", F.lit(None).cast("double")))
    bad = F.coalesce((F.col("host_distrust") >= THRESHOLD) & (F.col("host_distrust") > F.col("host_trust")), F.lit(False))
    blocked = F.when(F.col("allowed").isNotNull(), ~F.col("allowed")).otherwise(bad)
    return out.select(F.col("__id").alias(id_col), "host", "path", "rule", F.when(blocked, "block").otherwise("allow").alias("verdict"), "host_trust", "host_distrust")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, host, path, rule, verdict, host_trust, host_distrust of all pages."""
    return judge(table(spark, sf_dir, "pages"))
