"""Operator 5: URL filters: rules on hosts and paths, and link-graph propagation for what no rule decides. DataFrame functions only.

A rule fits its host and all subdomains where the url's path starts with the rule's; the longest wins and its verdict
stands. For the other urls a host's standing decides. A host's trust starts as the share of its pages that rules allow,
its distrust as the share that they block. Personalised PageRank carries trust along the links between hosts, and
distrust against them (who links to a blocked host loses standing): a host's score is its start plus DAMPING times what
comes along its links, each host passing its score on in equal parts. That is PageRank's vector divided by one less
the damping, so a host without links has its start for a score. A host whose distrust exceeds its trust by THRESHOLD is
blocked.

Links are the absolute and protocol-relative href values of the pages; relative ones stay on their host. Pages and
links are summed for each host (pair) before they are shuffled, so a host with a third of all pages costs no more;
scores and links stay tables, whatever their size. Each round's scores are checkpointed. Null urls and those without
`://` have an empty host and path, which no rule fits and no host score blocks. Rows are kept one for one. An empty
table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import checkpointed

#: (verdict, host, path)
RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
#: Rounds end when every score is within CLOSE of its limit; ROUNDS is far beyond what that takes, and reaching it is an error.
DAMPING, ROUNDS, CLOSE, THRESHOLD = 0.85, 1000, 1e-4, 0.5

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LINK = r"""(?i)href\s*=\s*["']?\s*((?:https?:)?//[^"'\s>]+)"""


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, name, start in sorted(rules, key=lambda r: len(r[1] + r[2])):  # a later one, as long or longer, wins
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(start)
        out = F.when(fits, F.struct(F.lit(name + start).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_links(pages: DataFrame, url_col: str, html_col: str) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(host_of(F.col(url_col)).alias("src"), F.explode(F.array_distinct(F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1)))).alias("href"))
    absolute = F.when(F.col("href").startswith("//"), F.concat(F.lit("http:"), F.col("href"))).otherwise(F.col("href"))
    hosts = found.select("src", host_of(absolute).alias("dst"))
    return hosts.where("src <> '' AND dst <> '' AND src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))


def propagated(seeds: DataFrame, links: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(host, trust, distrust) from seeds of the same columns over links (src, dst, n)."""
    links = checkpointed(links)
    seeds = checkpointed(seeds)
    if links.isEmpty():
        return seeds
    way = links.select(F.lit("trust").alias("kind"), "src", "dst", "n").unionByName(links.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    outgoing = way.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    way = checkpointed(way.join(outgoing, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("out")).alias("share")))
    start = seeds.select("host", F.explode(F.create_map(F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust"))).alias("kind", "seed"))
    linked = links.select(F.explode(F.array("src", "dst")).alias("host")).distinct().crossJoin(start.sparkSession.createDataFrame([("trust",), ("distrust",)], "kind string"))  # two rows
    start = checkpointed(start.join(linked, ["kind", "host"], "full").select("kind", "host", F.coalesce("seed", F.lit(0.0)).alias("seed")))
    score = start.select("kind", "host", F.col("seed").alias("score"))
    for _ in range(rounds):
        came = way.join(score, ["kind", "host"]).groupBy("kind", F.col("dst").alias("host")).agg(F.sum(F.col("score") * F.col("share")).alias("came"))
        new = start.join(score, ["kind", "host"]).join(came, ["kind", "host"], "left").withColumn("new", F.col("seed") + DAMPING * F.coalesce("came", F.lit(0.0)))
        new = checkpointed(new.select("kind", "host", F.col("new").alias("score"), F.abs(F.col("new") - F.col("score")).alias("moved")))
        # What moves comes along by DAMPING in sum, so all rounds to come move no host by more than this.
        to_come = (new.agg(F.sum("moved")).first()[0] or 0.0) * DAMPING / (1 - DAMPING)
        score = new.select("kind", "host", "score")
        if to_come <= CLOSE:
            break
    else:
        raise RuntimeError("the scores did not come to rest")
    return score.groupBy("host").agg(*(F.sum(F.when(F.col("kind") == k, F.col("score")).otherwise(0.0)).alias(k) for k in ("trust", "distrust")))


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rules: list[tuple[str, str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """(id, host, path, rule, verdict, trust, distrust) of every page."""
    urls = pages.select(F.col(id_col).alias("id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    ruled = urls.withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
    share = lambda verdict: F.avg(F.when(F.col("fit.verdict") == verdict, 1.0).otherwise(0.0))
    seeds = ruled.where("host <> ''").groupBy("host").agg(share("allow").alias("trust"), share("block").alias("distrust"))
    standing = propagated(seeds, host_links(pages, url_col, html_col))
    both = ruled.join(standing, "host", "left")
    verdict = F.when(F.col("distrust") - F.col("trust") > threshold, "block").otherwise("allow")
    return both.select("id", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), verdict).alias("verdict"), "trust", "distrust")
