"""URL filter: host and path rules, and trust propagated over the hosts' link graph.

A rule fits its host and all subdomains when the path starts with the rule's path; the longest
fitting rule decides. For other urls the host decides. Hosts whose pages are mostly allowed by rules
are trusted seeds, those mostly blocked are blocked seeds. Trust is a personalised PageRank from
the trusted seeds along links; distrust is one from the blocked seeds against the links (who links
to a blocked host earns distrust). Every seed gives out the same mass, 1, whatever their number, so
that seeds elsewhere in the graph change nothing at a host they don't reach. A host is blocked where
its distrust share exceeds `threshold`. Both run until a round moves less than `tolerance` of all
mass and reaches no new host, however far that is.

Null urls and urls without `://` have an empty host and path, and no links count for them. Null html
has no links. A link's host is read as a page's: a port or user name is part of it. Repeated pages
count once each; pages are read whole, of any length. A host with as many pages allowed as blocked is
no seed; a share equal to the threshold is allowed. Columns besides page_id, url and html are not
read, those of the result may clash with them. An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, measured_side, read_table

# The rules of the contract.
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]

_LINK = r"""(?i)<a\s[^>]*?href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""


def _lower(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url):
    """(host, path) columns of a url column."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host, path, rules) -> tuple:
    """(rule text, its verdict) of the longest rule that fits; nulls where none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        text = F.when(fits, F.lit(h + p)).otherwise(text)
        verdict = F.when(fits, F.lit(kind)).otherwise(verdict)
    return text, verdict


def propagate(edges: DataFrame, seeds: DataFrame, scratch: Scratch, name: str, damping: float, rounds: int | None, tolerance: float) -> DataFrame:
    """Personalised PageRank: edges (src, dst, share of src's links), seeds (host, seed mass).

    A round moves at most 2 * damping^round of all mass, so rounds need no limit of their own (None):
    past that bound only those follow that still reach new hosts. Fails when the tolerance isn't met.
    """
    enough = math.ceil(math.log(tolerance / 2) / math.log(damping)) + 1
    tolerance *= seeds.agg(F.sum("mass")).first()[0] or 1.0
    base = seeds.select("host", ((1 - damping) * F.col("mass")).alias("base"))
    now, step = scratch.write(seeds.select("host", F.col("mass").alias("rank")), f"{name}0"), 0
    while True:
        sent = now.join(edges, now.host == edges.src).groupBy("dst").agg(F.sum(F.col("rank") * F.col("share") * damping).alias("got"))
        new = sent.join(base, sent.dst == base.host, "full_outer").select(F.coalesce("host", "dst").alias("host"), (F.coalesce("got", F.lit(0.0)) + F.coalesce("base", F.lit(0.0))).alias("rank"))
        step += 1
        new = scratch.write(new, f"{name}{step}")
        a, b = now.alias("a"), new.alias("b")
        change = F.sum(F.abs(F.coalesce(F.col("a.rank"), F.lit(0.0)) - F.coalesce(F.col("b.rank"), F.lit(0.0))))
        moved, reached = a.join(b, "host", "full_outer").agg(change, F.count_if(F.col("a.rank").isNull())).first()
        scratch.drop(f"{name}{step - 1}")
        now = new
        if (moved or 0.0) < tolerance and not reached:
            return now
        if step >= (rounds or enough) and (rounds or (moved or 0.0) >= tolerance):
            raise RuntimeError(f"{name}: round {step} moved {moved}, not under {tolerance}, and reached {reached} new hosts")


def judge(pages: DataFrame, rules=RULES, threshold: float = 0.5, damping: float = 0.85, rounds: int | None = None, tolerance: float = 1e-4) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, trust, distrust."""
    scratch = Scratch(pages.sparkSession, "urls")
    host, path = host_and_path(F.col("url"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    target = F.filter(F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(_LINK), F.lit(1)), lambda x: F.length(x) > 0)
    slim = pages.select("page_id", host.alias("host"), path.alias("path"), target.alias("to")).withColumns({"rule": rule, "ruled": verdict})
    slim = scratch.write(slim, "slim")

    links = slim.where("host != ''").select(F.col("host").alias("src"), F.explode("to").alias("dst")).select("src", _lower(F.col("dst")).alias("dst")).where("src != dst")
    links = scratch.write(links.groupBy("src", "dst").agg(F.count("*").alias("n")), "links")
    out = links.groupBy("src").agg(F.sum("n").alias("all"))
    into = links.groupBy("dst").agg(F.sum("n").alias("all"))
    along = links.join(out, "src").select("src", "dst", (F.col("n") / F.col("all")).alias("share"))
    against = links.join(into, "dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), (F.col("n") / F.col("all")).alias("share"))

    per = slim.where("host != ''").groupBy("host").agg(F.count("*").alias("pages"), F.count_if(F.col("ruled") == "allow").alias("good"), F.count_if(F.col("ruled") == "block").alias("bad"))
    per = scratch.write(per, "hosts")
    ranks = {}
    for name, mine, edges in (("trust", "good", along), ("distrust", "bad", against)):
        seeds = per.where(2 * F.col(mine) > F.col("pages")).select("host", F.lit(1.0).alias("mass"))
        ranks[name] = propagate(scratch.write(edges, f"{name}_edges"), seeds, scratch, name, damping, rounds, tolerance).withColumnRenamed("rank", name)
    hosts = ranks["trust"].join(ranks["distrust"], "host", "full_outer").na.fill(0.0, ["trust", "distrust"])
    share = F.col("distrust") / (F.col("trust") + F.col("distrust"))
    hosts = scratch.write(hosts.withColumn("host_verdict", F.when(share > threshold, "block").otherwise("allow")), "verdicts")
    joined = slim.drop("to").join(measured_side(hosts), "host", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("ruled", "host_verdict", F.lit("allow")).alias("verdict"), F.coalesce("trust", F.lit(0.0)).alias("trust"), F.coalesce("distrust", F.lit(0.0)).alias("distrust"))


def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read_table(spark, sf_dir, "pages"))
