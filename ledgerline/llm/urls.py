"""URL filters: rules on host and path, and link-graph propagation for the rest.

Host graph: a page's links (absolute, protocol-relative, or relative to its own host), and the hosts with pages that it names in
its text, give edges between hosts, weighted by the pages that have them. Trust starts from pages that a rule allows
only, and flows along the links; distrust starts from blocked pages and flows against them, to hosts that link to bad ones. Both are
personalised PageRanks in units of pages, by joins and sums in Spark; after ``rounds`` rounds what is missing of a rank is at most ``damping ** rounds`` of
its seeds. A host is blocked where its distrust exceeds its trust by more than ``threshold`` pages for each page that it has; so one that
neither reaches is allowed.

Defined results: a null url or one without ``://`` has empty host and path, fits no rule, and is judged as the host
'' is; a null html has no links; repeated rows count as often as they occur; an empty table gives an empty table; other
columns of the input don't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import cut

#: (allow, rule) as host, slash, path. The list is a setting, a few thousand rules at most.
RULES = ((True, "com/"), (False, "example.com/en/"), (True, "www.example.com/en/"), (False, "net/es/"), (False, "net/fr/"))
DAMPING = 0.85
ROUNDS = 20
THRESHOLD = 0.1
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to a slash, question mark, hash or the end; A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """From the host's end up to a question mark, hash or the end; else empty."""
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def rule_of(host: Column, path: Column, rules: Sequence[tuple[bool, str]] = RULES) -> Column:
    """struct(rule, allow) of the longest rule that fits; null where none does."""
    if not rules:
        return F.lit(None).cast("struct<rule:string,allow:boolean>")
    listed = F.array(*[
        F.struct(F.lit(rule).alias("rule"), F.lit(allow).alias("allow"), F.lit(rule.partition("/")[0]).alias("host"), F.lit("/" + rule.partition("/")[2]).alias("path"))
        for allow, rule in sorted(rules, key=lambda r: (-len(r[1]), r[1]))
    ])
    fits = F.filter(listed, lambda r: ((host == r["host"]) | F.endswith(host, F.concat(F.lit("."), r["host"]))) & F.startswith(path, r["path"]))
    first = F.get(fits, F.lit(0))
    return F.when(F.size(fits) > 0, F.struct(first["rule"].alias("rule"), first["allow"].alias("allow")))


def linked_hosts(html: Column, own: Column) -> Column:
    """Distinct hosts that a page links to."""
    links = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"""(?i)\bhref\s*=\s*["']?([^"'\s>]+)"""), 1)
    return F.array_distinct(F.transform(links, lambda x: F.when(F.contains(x, F.lit("://")), host_of(x)).when(F.startswith(x, F.lit("//")), host_of(F.concat(F.lit("http:"), x))).otherwise(own)))


def named_hosts(html: Column) -> Column:
    """Distinct names in a page that have the form of a host."""
    named = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?i)\b((?:[a-z0-9-]+\.)+[a-z][a-z0-9-]+)\b"), 1)
    return F.array_distinct(F.transform(named, lambda x: F.translate(x, _UPPER, _LOWER)))


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS, damping: float = DAMPING) -> DataFrame:
    """(host, trust, distrust) from edges (source, target, weight) and seeds (host, trust, distrust).

    r = (1 - damping) * seed + damping * what arrives; a host passes on its rank by the weights of its edges, along
    them for trust and against them for distrust. A host without edges passes on nothing.
    """
    both = edges.select(F.lit("t").alias("kind"), F.col("source").alias("from"), F.col("target").alias("to"), "weight").unionByName(edges.select(F.lit("d").alias("kind"), F.col("target").alias("from"), F.col("source").alias("to"), "weight"))
    out = both.groupBy("kind", "from").agg(F.sum("weight").alias("all"))
    both = cut(both.join(out, ["kind", "from"]).select("kind", "from", "to", (F.col("weight") / F.col("all")).alias("share")))
    start = seeds.select("host", F.explode(F.array(F.struct(F.lit("t").alias("kind"), F.col("trust").cast("double").alias("seed")), F.struct(F.lit("d").alias("kind"), F.col("distrust").cast("double").alias("seed")))).alias("s")).select("host", "s.*")
    hosts = start.unionByName(both.select(F.col("to").alias("host"), "kind", F.lit(0.0).alias("seed"))).groupBy("host", "kind").agg(F.sum("seed").alias("seed"))
    hosts = cut(hosts)
    rank = hosts.select("host", "kind", F.col("seed").alias("rank"))
    for i in range(rounds):
        moved = both.join(rank.select(F.col("host").alias("from"), "kind", "rank"), ["kind", "from"]).groupBy("kind", F.col("to").alias("host")).agg(F.sum(F.col("rank") * F.col("share")).alias("in"))
        rank = hosts.join(moved, ["kind", "host"], "left").select("host", "kind", ((1 - damping) * F.col("seed") + damping * F.coalesce("in", F.lit(0.0))).alias("rank"))
        if i % 4 == 3 or i == rounds - 1:
            rank = cut(rank)
    pick = lambda k: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(pick("t").alias("trust"), pick("d").alias("distrust"))


def judge(pages: DataFrame, rules: Sequence[tuple[bool, str]] = RULES, rounds: int = ROUNDS, threshold: float = THRESHOLD) -> DataFrame:
    """page_id, host, path, rule, verdict, trust and distrust (of the host) of every page."""
    own = pages.select("page_id", "url", "html").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    own = own.withColumn("found", rule_of(F.col("host"), F.col("path"), rules))
    parsed = own.select("host", F.col("found.allow").alias("allow"), linked_hosts(F.col("html"), F.col("host")).alias("links"), named_hosts(F.col("html")).alias("named"))
    parsed = parsed.select("host", "allow", "links", F.array_except("named", "links").alias("named"))
    links = cut(parsed.groupBy("host", "links", "named").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.when(F.col("allow"), 1).otherwise(0)).alias("good"), F.sum(F.when(~F.col("allow"), 1).otherwise(0)).alias("bad")))
    hosts = links.groupBy("host").agg(F.sum("good").alias("trust"), F.sum("bad").alias("distrust"), F.sum("pages").alias("pages"))
    direct = links.select(F.col("host").alias("source"), F.explode("links").alias("target"), "pages").filter("target != ''")
    # names are summed before they are looked up, so that a name that many pages have is a row a source
    named = links.select(F.col("host").alias("source"), F.explode("named").alias("target"), "pages").groupBy("source", "target").agg(F.sum("pages").alias("pages")).join(hosts.select(F.col("host").alias("target")), "target", "left_semi").select("source", "target", "pages")
    edges = direct.unionByName(named).groupBy("source", "target").agg(F.sum("pages").cast("double").alias("weight"))
    scores = propagate(edges, hosts, rounds).join(hosts.select("host", "pages"), "host").withColumn("blocked", F.col("distrust") - F.col("trust") > threshold * F.col("pages")).drop("pages")
    # the pages again, without their html
    again = own.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.allow").alias("allow"))
    allowed = F.coalesce("allow", ~F.coalesce("blocked", F.lit(False)))
    return again.join(scores, "host", "left").select("page_id", "host", "path", "rule", F.when(allowed, "allow").otherwise("block").alias("verdict"), "trust", "distrust")
