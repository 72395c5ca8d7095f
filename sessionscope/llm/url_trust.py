"""URL filter: rules per host and path, and trust over the link graph of hosts.

A host most of whose pages a rule allows is a trusted seed, one most of whose
pages a rule blocks a blocked seed, each by its number of pages.  Personalised PageRank carries trust from the trusted seeds along
the links between hosts; the same walk over reversed links carries distrust from
the blocked seeds to the hosts that link to them.  A host whose distrust exceeds
its trust by the threshold factor is blocked.  A page's verdict is its rule's,
else its host's.  DataFrame operations only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sessionscope.llm.common import cut

Rule = tuple[str, str, str]  # verdict, host, path

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
# the host of an absolute link; links without a host stay within their own
_LINK = r"""(?i)\bhref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def url_host(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end; A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """(verdict, rule) of the longest rule that fits, else null."""
    found = F.lit(None).cast("struct<verdict:string,rule:string>")
    # built from the shortest, so the longest is asked first
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith(f".{rule_host}")) & path.startswith(rule_path)
        found = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule_host + rule_path).alias("rule"))).otherwise(found)
    return found


def host_links(pages: DataFrame, host: str, html_col: str) -> DataFrame:
    """Links between different hosts: src, dst, links."""
    hosts = F.regexp_extract_all(F.coalesce(F.col(html_col), F.lit("")), F.lit(_LINK), F.lit(1))
    return (
        pages.select(F.col(host).alias("src"), F.explode(hosts).alias("dst"))
        .withColumn("dst", F.translate("dst", _UPPER, _LOWER))
        .where("src <> '' and src <> dst")
        .groupBy("src", "dst")
        .agg(F.count("*").alias("links"))
    )


def propagate(edges: DataFrame, seeds: DataFrame, *, damping: float, tolerance: float) -> DataFrame:
    """Personalised PageRank of every kind at once: (kind, host, rank).

    ``edges`` (kind, src, dst, share) hold the part of a host's rank that each of
    its links passes on, ``seeds`` (kind, host, mass) where walks start and start
    anew.  Rank at a host without links is not passed on.  Ends when no host's
    rank changes by more than ``tolerance`` of itself.  A host that a walk has just
    reached changes by all of its rank, so every host that can be reached is, however
    far from the seeds; then the changes shrink by ``damping`` a round, so the walk ends.
    """
    if not 0 <= damping < 1 or tolerance <= 0:
        raise ValueError("damping must be in [0, 1) and tolerance positive")
    edges, seeds = cut(edges, "links"), cut(seeds, "seeds")
    start = seeds.select("kind", "host", (F.col("mass") * (1 - damping)).alias("rank"))
    rank = start
    while True:
        passed = edges.join(rank.withColumnRenamed("host", "src"), ["kind", "src"]).select(
            "kind", F.col("dst").alias("host"), (F.col("rank") * F.col("share") * damping).alias("rank")
        )
        new = passed.unionByName(start).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        was = rank.withColumnRenamed("rank", "was")
        new = cut(
            new.join(was, ["kind", "host"], "left").withColumn("change", F.abs(F.col("rank") - F.coalesce("was", F.lit(0.0))) / F.col("rank")).drop("was"),
            "rank",
        )
        change = new.agg(F.max("change")).first()[0]
        rank = new.drop("change")
        if change is None or change <= tolerance:
            return rank


def host_verdicts(
    pages: DataFrame, links: DataFrame, *, damping: float, tolerance: float, threshold: float
) -> DataFrame:
    """host, trust, distrust, host_verdict; ``pages`` has host and ruled (allow, block or null)."""
    by_rule = lambda kind: F.count(F.when(F.col("ruled") == kind, 1))
    counted = pages.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), by_rule("allow").alias("allowed"), by_rule("block").alias("blocked")
    )
    majority = F.when(F.col("allowed") * 2 > F.col("pages"), "allow").when(F.col("blocked") * 2 > F.col("pages"), "block")
    ruled = cut(counted.select("host", "pages", majority.alias("kind")).where("kind is not null"), "ruled")
    totals = ruled.groupBy("kind").agg(F.sum("pages").alias("all"))  # two rows
    seeds = ruled.join(totals, "kind").select("kind", "host", (F.col("pages") / F.col("all")).alias("mass"))
    links = cut(links, "host-links")
    both = links.select(F.lit("allow").alias("kind"), "src", "dst", "links").unionByName(
        links.select(F.lit("block").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "links")
    )
    out = cut(both.groupBy("kind", "src").agg(F.sum("links").alias("out")), "out")
    edges = both.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("links") / F.col("out")).alias("share"))
    rank = propagate(edges, seeds, damping=damping, tolerance=tolerance)
    part = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    both_ranks = rank.groupBy("host").agg(part("allow").alias("trust"), part("block").alias("distrust"))
    blocked = F.col("distrust") > threshold * F.col("trust")
    return both_ranks.withColumn("host_verdict", F.when(blocked, F.lit("block")).otherwise(F.lit("allow")))


def filter_urls(
    pages: DataFrame,
    rules: Sequence[Rule],
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    damping: float = 0.85,
    tolerance: float = 1e-6,
    threshold: float = 1.0,
) -> DataFrame:
    """page_id, host, path, rule, verdict, trust, distrust for every page.

    Defined cases: a null url, or one without ``://``, has an empty host and path,
    fits no rule and is allowed; a host that no walk reaches, however long, has trust and
    distrust 0 and is allowed; a null html has no links; repeated rows are judged
    each and count each as seeds; of rules of one length the alphabetically last
    wins; an empty table gives no rows; other columns are not read.
    """
    parts = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"), F.col(html_col).alias("html"))
    links = host_links(parts, "host", "html")
    judged = parts.select("page_id", "host", "path", matching_rule(F.col("host"), F.col("path"), rules).alias("r"))
    judged = judged.select("page_id", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("ruled"))
    hosts = cut(
        host_verdicts(judged, links, damping=damping, tolerance=tolerance, threshold=threshold), "hosts"
    )
    return judged.join(hosts, "host", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )
