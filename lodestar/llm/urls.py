"""URL filter: rules, and trust and distrust that spread over the host graph.

Rules (host, path) decide the urls they fit. For the others the graph decides: personalised PageRank flows from hosts
with an allowed url along links, and distrust flows from hosts with a blocked url against the links (a page that links
to a blocked host is suspect). Masses are whole numbers, so that sums don't depend on their order. A host is blocked if
its distrust is over the threshold and over its trust. What a host holds as a seed itself doesn't count against it: a rule that
blocks some of a host's paths says nothing of its others, links to blocked hosts do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import join_uneven, stash

RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
#: Units of all mass of a kind; damping in percent; least distrust of a blocked host, in parts of the mean mass of a host.
UNIT, DAMPING, DISTRUST = 1_000_000_000_000, 85, 0.4
#: Rounds between tables.
TURN = 6
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SALTS = 16


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits, or nulls."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame) -> DataFrame:
    """src, dst, w: links between different hosts in the pages' html, counted; scheme-less `//host` links too."""
    links = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#\"'\s>]+)"), 1)
    found = pages.filter(F.col("html").contains("//")).select(F.col("host").alias("src"), F.explode(links).alias("dst"))
    found = found.select("src", F.translate("dst", UPPER, LOWER).alias("dst"))
    return found.filter("src != '' and dst != '' and src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w"))


def spread(edges: DataFrame, seeds: DataFrame, damping: int = DAMPING) -> DataFrame:
    """kind, node, mass, received (mass without the node's own share as a seed): personalised PageRank for each kind. edges: kind, src, dst, w; seeds: kind, node.

    Rounds go on until no mass moves: masses are whole units that rise from nothing to their fixed point, however far
    from the seeds. A hub's edges are dealt by salt, so its row of mass is copied to SALTS tasks, and contributions are
    summed before they are shuffled. Mass at nodes without edges is dropped.
    """
    sizes = seeds.distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
    base = stash(seeds.distinct().join(F.broadcast(sizes), "kind").select("kind", "node", F.expr(f"{UNIT} div n").alias("seed")), "seeds")  # sizes has one row a kind
    keyed = edges.withColumn("from", F.struct("kind", "src"))
    out = stash(keyed.groupBy("from").agg(F.sum("w").alias("total"), F.count(F.lit(1)).alias("links")), "totals")
    salted = join_uneven(keyed, out, "from", "links", F.col("dst")).select("kind", "src", "dst", "w", "total", F.pmod(F.xxhash64("dst"), F.lit(SALTS)).cast("int").alias("salt"))
    salted = stash(salted, "edges")
    own = base.select("kind", "node", F.expr(f"seed * {100 - damping} div 100").alias("mass"), F.lit(0).cast("long").alias("received"))
    mass, before, k = own, None, 0
    while True:
        copies = mass.filter("mass > 0").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("node", "src")
        moved = salted.join(copies, ["kind", "src", "salt"]).select("kind", F.col("dst").alias("node"), F.expr(f"cast(cast(mass as decimal(20,0)) * {damping} * w div (total * 100) as bigint)").alias("mass")).withColumn("received", F.col("mass"))
        mass = moved.unionByName(own).groupBy("kind", "node").agg(F.sum("mass").alias("mass"), F.sum("received").alias("received"))
        k += 1
        if k % TURN == 0 or k == 1:
            mass = stash(mass, "mass")
            now = mass.agg(F.count(F.lit(1)), F.sum("mass")).first()  # masses only rise, so equal sums are equal masses
            if now == before:
                return mass
            before = now


def judge_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules=RULES, threshold: float = DISTRUST) -> DataFrame:
    """For every row: page_id, host, path, rule, verdict, trust, distrust.

    Null urls and urls without :// have empty host and path and are allowed, as nothing speaks against them; null html
    has no links. Hosts that nothing reaches have no mass and are allowed. Repeated rows each get their row. trust and
    distrust are masses in parts of the mean mass of a host. trust holds a trusted seed's own share, distrust does not
    hold a blocked seed's: a host is blocked for what links to blocked ones, not for one page that a rule blocks on it.
    An empty table gives an empty result. Other columns are dropped.
    """
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    rows = rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    judged = stash(rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled")), "judged")
    links = stash(host_edges(rows), "links")
    edges = links.select(F.lit("trust").alias("kind"), "src", "dst", "w").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
    hosts = judged.filter("host != ''").groupBy("host").agg(F.count(F.lit(1)).alias("pages"), F.max((F.col("ruled") == "allow").cast("int")).alias("good"), F.max((F.col("ruled") == "block").cast("int")).alias("bad"))
    hosts = stash(hosts, "hosts")
    seeds = hosts.filter("good = 1 and coalesce(bad, 0) = 0").select(F.lit("trust").alias("kind"), F.col("host").alias("node")).unionByName(hosts.filter("bad = 1").select(F.lit("distrust").alias("kind"), F.col("host").alias("node")))
    mass = spread(edges, seeds)
    mean = UNIT / max(1, hosts.count())
    of = mass.groupBy(F.col("node").alias("host")).agg(F.sum(F.when(F.col("kind") == "trust", F.col("mass"))).alias("t"), F.sum(F.when(F.col("kind") == "distrust", F.col("received"))).alias("d"))
    of = of.select("host", F.round(F.coalesce("t", F.lit(0)) / mean, 9).alias("trust"), F.round(F.coalesce("d", F.lit(0)) / mean, 9).alias("distrust"))
    of = stash(hosts.select("host", "pages").join(of, "host"), "of")
    out = join_uneven(judged, of, "host", "pages", F.struct("page_id", "path"), "left")
    trust, distrust = F.coalesce("trust", F.lit(0.0)), F.coalesce("distrust", F.lit(0.0))
    method = F.when((distrust > threshold) & (distrust > trust), "block").otherwise("allow")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), trust.alias("trust"), distrust.alias("distrust"))
