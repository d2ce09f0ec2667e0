"""URL rules and trust propagation against plain Python."""

import re

import numpy as np
import pytest

from folio.llm import url_filter as U


def plain_parts(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return ("", "") if not m else ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2])


def plain_rule(host, path):
    best = None
    for rule, verdict in U.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            best = max(best or (0,), (len(rule), rule, verdict))
    return best[1:] if best else None


URLS = ["http://A.example.com/en/7", "https://x.example.com/en/9?q#f", "http://example.net/de/81", "http://q.net/de/1", "http://org/es/", "http://www.org/fr/",
        "http://notexample.com/fr/", None, "", "no scheme", "ftp://h.org?x", "x://y://z.net/de/", "http://.net/de/", "http://É.COM/en/", "http://m.org/es/\nline"]


def test_rules_match_plain_python(spark):
    rows = [(i, u, "<p>") for i, u in enumerate(URLS)] + [(0, URLS[0], None)]
    got = [tuple(r) for r in U.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).select("page_id", "host", "path", "rule", "verdict").collect()]
    assert len(got) == len(rows)
    for page_id, host, path, rule, verdict in got:
        assert (host, path) == plain_parts(URLS[page_id])
        want = plain_rule(host, path)
        assert rule == (want[0] if want else None)
        assert verdict in ("allow", "block")
        if want:
            assert verdict == want[1]


def exact_ranks(arcs, start, hosts):
    """Rank of every host as the solution of the linear equations."""
    at = {h: i for i, h in enumerate(hosts)}
    away = np.zeros((len(hosts), len(hosts)))
    for (a, b), n in arcs.items():
        away[at[b], at[a]] += n
    out = away.sum(axis=0)
    away = np.divide(away, out, where=out > 0, out=np.zeros_like(away))
    back = np.array([start.get(h, 0.0) for h in hosts])
    moves = U.DAMPING * away + np.outer(back, 1 - U.DAMPING * (out > 0))
    rank = np.linalg.solve(np.eye(len(hosts)) - moves + np.outer(back, np.ones(len(hosts))), back)
    return dict(zip(hosts, rank, strict=True))


@pytest.mark.parametrize("long", [False, True])
def test_propagation_matches_linear_solution(spark, long):
    edges = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("c", "d"): 3, ("e", "d"): 1, ("d", "f"): 1}
    seeds = [("a", 3, 0), ("d", 0, 2), ("c", 1, 1)]
    tolerance = 1e-3
    if long:  # distrust runs against 40 links
        edges, seeds = {(f"h{i:02}", f"h{i + 1:02}"): 1 for i in range(40)} | {("h00", "x"): 2}, [("h40", 0, 1), ("x", 1, 0)]
    links = spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long")
    found = U.propagate(links, spark.createDataFrame(seeds, "host string, allowed long, blocked long"), tolerance)
    got = {r.host: (r.trust, r.distrust) for r in found.collect()}
    hosts = sorted({h for e in edges for h in e})
    for side, col in ((0, 1), (1, 2)):
        arcs = edges if not side else {(b, a): n for (a, b), n in edges.items()}
        total = sum(s[col] for s in seeds)
        want = exact_ranks(arcs, {s[0]: s[col] / total for s in seeds if s[col]}, hosts)
        for h in hosts:
            assert got.get(h, (0, 0))[side] == pytest.approx(want[h], abs=tolerance * U.DAMPING / (1 - U.DAMPING))
    if long:
        assert got["h00"][1] > U.THRESHOLD


def test_links_and_empty_table(spark):
    html = """<a href="http://B.org/x">1</a><a href='//c.net?y'>2</a><a href="/local">3</a><a href=https://a.com/self>4</a>"""
    pages = spark.createDataFrame([(1, "http://a.com/", html)], "page_id long, url string, html string")
    assert {(r.src, r.dst, r.n) for r in U.host_links(pages).collect()} == {("a.com", "b.org", 1), ("a.com", "c.net", 1)}
    assert U.judge_urls(pages.where("false")).collect() == []


def test_ties_clashing_columns_and_very_long_urls(spark):
    rules = (("x.org/a", "block"), ("w.x.org/", "allow"), ("x.org/abc", "allow"))
    url = "http://w.x.org/a" + "b" * 1_000_000
    rows = [(1, url, None, "mine", "r"), (2, "http://w.x.org/abc", "", None, None), (2, "http://w.x.org/abc", "", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string, rule string")
    got = U.judge_urls(pages, rules).select("page_id", "host", "rule", "verdict").collect()
    # "w.x.org/" has eight characters, "x.org/abc" nine, "x.org/a" seven.
    assert sorted(map(tuple, got)) == [(1, "w.x.org", "w.x.org/", "allow"), (2, "w.x.org", "x.org/abc", "allow"), (2, "w.x.org", "x.org/abc", "allow")]
    tied = (("x.org/a", "block"), ("w.x.org", "allow"))
    assert {r.rule for r in U.judge_urls(pages, tied).collect()} == {"w.x.org"}


def test_hosts_of_many_labels(spark):
    long = "a." * 30_000 + "example.com"
    rows = [(1, f"http://{long}/en/7", ""), (2, "http://" + "a." * 30_000 + "net/de/", None), (3, "http://example.com.org/en/", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {r.page_id: (r.rule, r.verdict) for r in U.judge_urls(df).collect()} == {1: ("example.com/en/7", "allow"), 2: ("net/de/", "allow"), 3: (None, "allow")}
