"""URL filters: host rules, and for the rest the propagation of trust and distrust over the host graph.

A url's host and path are cut as ``url_parts`` says. A rule (host and path prefix) fits its host and all subdomains; the
longest fitting rule wins, the smaller string among equals. Hosts with pages that rules allow are trusted seeds, hosts
with blocked pages are distrusted ones, each weighted by its number of such pages. Trust runs along the links between
hosts by personalised PageRank, distrust runs against them (who links to a bad host is bad), with damping ``DAMPING``;
mass of hosts without further links returns to the seeds. Rounds go on until the ranks change by less than ``TOLERANCE`` in
all; damping shrinks the change each round, so that takes about 130 rounds at most, of any graph. A host is blocked where distrust exceeds trust by more than
``THRESHOLD``; hosts that neither reaches are allowed.

Links are absolute or scheme-relative href values; relative ones stay inside a host and carry nothing. Null and odd
urls have an empty host, on which no rule fits. Repeated rows are judged alike; an empty table gives an empty result.
Hosts and edges stay distributed, ranks go to kept tables each round; one row of sums a round reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from folio.llm.common import drop, keep, table

RULES = (
    ("com/en/", "block"),
    ("example.com/en/7", "allow"),
    ("net/de/", "allow"),
    ("example.net/de/8", "block"),
    ("org/es/", "block"),
)
DAMPING = 0.85
TOLERANCE = 1e-9
#: Ranks that moved by TOLERANCE in all are at most so far from where they would come to rest; less apart is a tie, and allowed.
THRESHOLD = 2 * TOLERANCE * DAMPING / (1 - DAMPING)

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_HREF = r"""(?i)href\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s<>]+)"""


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://``."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda i: F.coalesce(F.regexp_extract(url, pattern, i), F.lit(""))
    return F.translate(part(1), _UPPER, _UPPER.lower()), part(2)


def _rules_by_host(hosts: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """(host, rules): for each host the rules of its own name and of the domains above it, of as many labels as a rule has at most."""
    rows = [(r.partition("/")[0].translate(str.maketrans(_UPPER, _UPPER.lower())), "".join(r.partition("/")[1:]), r, v) for r, v in rules]
    listed = hosts.sparkSession.createDataFrame(rows, "suffix string, prefix string, rule string, verdict string")
    most = max((suffix.count(".") + 1 for suffix, *_ in rows), default=1)
    labels = F.split("host", r"\.")
    first = F.greatest(F.size(labels) - most + 1, F.lit(1))
    above = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    named = hosts.select("host", F.explode(F.array_distinct(above)).alias("suffix"))
    return (
        named.join(listed, "suffix").groupBy("host")
        .agg(F.collect_set(F.struct("prefix", "rule", "verdict")).alias("rules"))
    )


def _best_rule(path: Column, rules: Column) -> Column:
    fitting = F.filter(rules, lambda r: F.startswith(path, r["prefix"]))
    ranked = F.transform(
        fitting, lambda r: F.struct((-F.length(r["rule"])).alias("n"), r["rule"].alias("rule"), r["verdict"].alias("verdict"))
    )
    return F.array_min(ranked)


def host_links(pages: DataFrame) -> DataFrame:
    """(src, dst, n): links between different hosts."""
    found = pages.select(url_parts(F.col("url"))[0].alias("src"), F.explode(F.regexp_extract_all("html", F.lit(_HREF), 1)).alias("dst"))
    found = found.select("src", F.translate("dst", _UPPER, _UPPER.lower()).alias("dst"))
    return found.where("src <> '' AND src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, trust, distrust) from links (src, dst, n) and seeds (host, allowed, blocked), both counts."""
    way = lambda kind, a, b: links.select(F.lit(kind).alias("kind"), F.col(a).alias("a"), F.col(b).alias("b"), "n")
    arcs = way("trust", "src", "dst").union(way("distrust", "dst", "src"))
    out = arcs.groupBy("kind", "a").agg(F.sum("n").alias("out"))
    arcs = keep(arcs.join(out, ["kind", "a"]).select("kind", "a", "b", (F.col("n") / F.col("out")).alias("share")), "arcs")
    open_hosts = keep(arcs.select("kind", "a").distinct(), "open")
    pick = lambda kind, c: seeds.where(F.col(c) > 0).select(F.lit(kind).alias("kind"), "host", F.col(c).alias("n"))
    seeded = pick("trust", "allowed").union(pick("distrust", "blocked"))
    total = seeded.groupBy("kind").agg(F.sum("n").alias("total"))
    start = keep(seeded.join(total, "kind").select("kind", "host", (F.col("n") / F.col("total")).alias("rank")), "seeds")
    ranks = start
    if not arcs.isEmpty():
        while True:
            at = ranks.withColumnRenamed("host", "a")
            held = at.join(open_hosts, ["kind", "a"]).groupBy("kind").agg(F.sum("rank").alias("m"))
            mass = {r["kind"]: r["m"] for r in held.collect()}  # two rows
            returned = F.when(F.col("kind") == "trust", 1 - DAMPING * mass.get("trust", 0.0)).otherwise(1 - DAMPING * mass.get("distrust", 0.0))
            moved = at.join(arcs, ["kind", "a"]).select("kind", F.col("b").alias("host"), (DAMPING * F.col("rank") * F.col("share")).alias("rank"))
            back = start.select("kind", "host", (F.col("rank") * returned).alias("rank"))
            new = keep(moved.union(back).groupBy("kind", "host").agg(F.sum("rank").alias("rank")), "ranks")
            change = new.unionByName(ranks.withColumn("rank", -F.col("rank"))).groupBy("kind", "host").agg(F.abs(F.sum("rank")).alias("d"))
            moved_by = change.agg(F.sum("d")).first()[0] or 0.0
            if ranks is not start:
                drop(ranks)
            ranks = new
            if moved_by < tolerance:
                break
    side = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0)).alias(kind)
    return ranks.groupBy("host").agg(side("trust"), side("distrust"))


def judge_urls(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, url, host, path, rule (null if none fits) and verdict of every page."""
    host, path = url_parts(F.col("url"))
    parsed = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    hosts = keep(parsed.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    by_host = keep(_rules_by_host(hosts, rules), "rules")
    ruled = parsed.join(by_host, "host").select("host", _best_rule(F.col("path"), F.col("rules")).alias("r")).where("r IS NOT NULL")
    count = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0))
    seeds = keep(ruled.groupBy("host").agg(count("allow").alias("allowed"), count("block").alias("blocked")), "seeded")
    scores = propagate(host_links(pages), seeds)
    facts = keep(hosts.select("host").join(by_host, "host", "left").join(scores, "host", "left"), "facts")
    judged = parsed.join(facts, "host", "left").withColumn("r", _best_rule(F.col("path"), F.col("rules")))
    own = F.when(F.col("distrust") - F.col("trust") > THRESHOLD, "block").otherwise("allow")
    return judged.select(
        "page_id", "url", "host", "path", F.col("r.rule").alias("rule"), F.coalesce("r.verdict", own).alias("verdict"),
        "trust", "distrust",
    )


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule and verdict of every page."""
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


QUERIES = {"op1_url_filter": op1_url_filter}
SQL: dict[str, str] = {}
