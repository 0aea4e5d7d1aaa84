"""URL filters: rules by host and path, and for all other pages trust and distrust propagated over host links.

DataFrame functions only.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import discard, stage

#: (verdict, host and path) of the rules that the query applies. Fixed values.
RULES = [
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
]
DAMPING = 0.85
#: A host is blocked when a page of it carries this many times the average page's distrust more than its trust.
THRESHOLD = 2.0

_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(text: Column) -> Column:
    return F.translate(text, ascii_uppercase, ascii_lowercase)


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return _lower(F.coalesce(F.regexp_extract(url, _URL, 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; empty where there is no host part."""
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, else null.

    A rule fits its host and all subdomains if the path starts with the rule's path.
    """
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        value = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def propagate(seeds: DataFrame, edges: DataFrame, tolerance: float = 1e-4) -> DataFrame:
    """Personalised PageRank of several kinds at once: ``kind, host, mass``, each kind's masses summing to 1.

    ``seeds`` (``kind, host, mass``) is where each kind's walks restart, ``edges`` (``kind, src, dst, share``) how a
    host hands on its mass. What a host without links would hand on is lost in each round, which only scales the
    result, so one normalisation at the end stands for sending it back to the seeds. Stops when less than
    ``tolerance`` moves, which shrinks by ``DAMPING`` a round at least: 1e-4 takes 60 rounds or so at most. Each round
    is a join, an aggregation and a staged table, which the next one replaces.
    """
    restart = seeds.select("kind", "host", (F.col("mass") * (1 - DAMPING)).alias("mass"), F.lit(0.0).alias("old"))
    ranks = stage(seeds.select("kind", "host", (F.col("mass") * (1 - DAMPING)).alias("mass")), "ranks")
    change = 1.0
    while change >= tolerance:
        moved = ranks.join(edges, [ranks["kind"] == edges["kind"], F.col("host") == F.col("src")])
        moved = moved.select(ranks["kind"], F.col("dst").alias("host"), (F.col("mass") * F.col("share") * DAMPING).alias("mass"), F.lit(0.0).alias("old"))
        was = ranks.select("kind", "host", F.lit(0.0).alias("mass"), F.col("mass").alias("old"))
        both = stage(moved.unionAll(restart).unionAll(was).groupBy("kind", "host").agg(F.sum("mass").alias("mass"), F.sum("old").alias("old")), "ranks")
        discard(ranks)
        ranks = both.select("kind", "host", "mass")
        change = both.agg(F.sum(F.abs(F.col("mass") - F.col("old")))).first()[0] or 0.0
    totals = ranks.groupBy("kind").agg(F.sum("mass").alias("total"))
    return ranks.join(totals, "kind").select("kind", "host", (F.col("mass") / F.col("total")).alias("mass"))


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES, threshold: float = THRESHOLD) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``: the rule's verdict, else the host's.

    Hosts are nodes; absolute links in ``<a href>`` are edges, weighted by the number of linking pages. Trust starts
    at the pages that allow rules fit and flows along links; distrust starts at blocked pages and flows against them,
    to the hosts that link there. ``score`` is a host's distrust less its trust, each relative to the host's share of
    all pages; above ``threshold`` the host's other pages are blocked.

    Edge cases: a null url or one without ``://`` has empty host and path, fits no rule and is allowed; null html has
    no links; repeated rows are judged alike and weigh as pages; without seeds or links the masses stay where they
    are; an empty table gives no rows; other columns are ignored.
    """
    parsed = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    links = F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)), _lower))
    seen = parsed.withColumn("hit", rule_of(F.col("host"), F.col("path"), rules))
    seen = stage(seen.select("page_id", "host", "path", "hit.rule", "hit.verdict", links.alias("links")), "pages")
    hosts = seen.where("host <> ''").groupBy("host").agg(
        F.count("*").alias("pages"), F.count_if(F.col("verdict") == "allow").alias("trust"), F.count_if(F.col("verdict") == "block").alias("distrust")
    )
    hosts = stage(hosts, "hosts")
    kinds = hosts.select("host", F.stack(F.lit(2), F.lit("trust"), F.col("trust"), F.lit("distrust"), F.col("distrust")).alias("kind", "n")).where("n > 0")
    totals = kinds.groupBy("kind").agg(F.sum("n").alias("total"))
    seeds = stage(kinds.join(totals, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("mass")), "seeds")
    linked = seen.where("host <> ''").select("host", F.explode("links").alias("to"))
    linked = linked.where("to <> '' and to <> host").groupBy("host", "to").agg(F.count("*").alias("n"))
    linked = stage(linked, "links")
    ways = linked.select(F.lit("trust").alias("kind"), F.col("host").alias("src"), F.col("to").alias("dst"), "n")
    ways = ways.unionAll(linked.select(F.lit("distrust"), "to", "host", "n"))
    out = ways.groupBy("kind", "src").agg(F.sum("n").alias("out"))
    edges = stage(ways.join(out, ["kind", "src"]).select("kind", "src", "dst", (F.col("n") / F.col("out")).alias("share")), "edges")
    mass = propagate(seeds, edges).groupBy("host").agg(
        F.sum(F.when(F.col("kind") == "distrust", F.col("mass")).otherwise(-F.col("mass"))).alias("mass")
    )
    every = hosts.agg(F.sum("pages")).first()[0] or 0
    scores = hosts.join(mass, "host").select("host", (F.col("mass") * every / F.col("pages")).alias("score"))
    judged = seen.select("page_id", "host", "path", "rule", "verdict").join(scores, "host", "left")
    by_host = F.when(F.col("score") > threshold, "block").otherwise("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("verdict", by_host).alias("verdict"), "score")
