"""Outcomes of pages and reputations of hosts, against plain Python."""

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardweave.llm import url_filter as u

ROW = "page_id bigint, url string, html string, host string, n int"
GOOD = "<html><body><h1>title</h1>" + "".join(f"<p>sentence number {i} of a page about rivers and hills</p>" for i in "abcdefghijkl") + "</body></html>"
FARM = "<html><body>" + "<p><a href=/x>more links to follow here</a></p>" * 40 + "</body></html>"


def judged(spark, rows, **options):
    table = spark.createDataFrame([(i, url, html, "clash", 1) for i, (url, html) in enumerate(rows)], ROW)
    return {r.page_id: r for r in u.judge(table.repartition(3), **options).collect()}


def test_pages_alone_tell_two_hosts_apart(spark):
    rows = [(f"https://one.test/{i}", GOOD) for i in range(30)] + [(f"https://two.test/{i}", FARM) for i in range(30)]
    got = judged(spark, rows)
    assert {got[i].verdict for i in range(30)} == {"allow"} and {got[i].verdict for i in range(30, 60)} == {"block"}
    assert {got[i].outcome for i in range(30)} == {0} and {got[i].outcome for i in range(30, 60)} == {1}


@pytest.mark.parametrize("html, url, spam, signs", [
    (GOOD, "http://a.b/c", False, 0), (FARM, "http://a.b/c", False, 2), (None, "http://a.b/c", False, 0), ("", None, False, 0),
    (GOOD, "http://casino-x.b/c", True, 1), (GOOD, "http://a.b/Poker/1", True, 1), ("<p>poker poker poker now</p>", "http://a.b/", True, 1),
    ("<script>" + "var x;" * 1000 + "</script><p>a</p>", "http://a.b/", False, 1), ("<p>pokerface alphabet</p>", "http://a.b/alphabet", False, 0),
    ("<" * 50_000, "http://a.b/", False, 1), ("<a href=x>" * 20_000, "http://a.b/", False, 1), ("<!-- " * 20_000, "http://a.b/", False, 1),
])
def test_signs(spark, html, url, spam, signs):
    rows = spark.createDataFrame([(url, html)], "url string, html string")
    host, path = u.parts(F.col("url"))
    got = u.signs(rows.select(host.alias("host"), path.alias("path"), F.col("html").alias("h")), "h").first()
    assert (got.spam, got.signs) == (spam, signs)


def test_registered_domains(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "x.example.org:80": ("org", "example.org"), "localhost": ("localhost", "localhost"), "1.2.3.4": ("1.2.3.4", "1.2.3.4"), "me@a.b.com": ("com", "b.com"), "": ("", ""), "y.github.io": ("github.io", "y.github.io")}
    rows = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: (r.s, r.d) for r in rows.select("host", *(c.alias(n) for c, n in zip(u.registered(F.col("host")), "sd", strict=True))).collect()} == hosts
    assert rows.select(u.registered(F.lit("a.b.c.d"), ("b.c.d",))[1]).first()[0] == "a.b.c.d"


def plain(hosts):
    """Bounds by host of {host: (suffix, domain, n, bad)}."""

    def fit(groups):
        n, bad = sum(g[0] for g in groups), sum(g[1] for g in groups)
        some = [g for g in groups if g[0]]
        if not n:
            return n, bad, u.STRONGEST
        m = bad / n
        spread, g = m * (1 - m), len(some)
        between = sum(b * b / k for k, b in some) - n * m * m - (g - 1) * spread
        if g < 2 or spread <= 0 or between <= 0:
            return n, bad, u.STRONGEST
        return n, bad, min(u.STRONGEST, max(u.WEAKEST, spread * (n - g) / between - 1))

    domains, suffixes = defaultdict(list), defaultdict(list)
    for s, d, n, bad in hosts.values():
        domains[s, d].append((n, bad))
    domains = {k: fit(v) for k, v in domains.items()}
    for (s, _), (n, bad, _) in domains.items():
        suffixes[s].append((n, bad))
    suffixes = {k: fit(v) for k, v in suffixes.items()}
    n, bad, strength = fit([(a, b) for a, b, _ in suffixes.values()])
    top = (bad + 0.5 * u.FIRST) / (n + u.FIRST)
    s_mean = {k: (b + strength * top) / (a + strength) for k, (a, b, _) in suffixes.items()}
    d_mean = {k: (b + suffixes[k[0]][2] * s_mean[k[0]]) / (a + suffixes[k[0]][2]) for k, (a, b, _) in domains.items()}
    out = {}
    for h, (s, d, n, bad) in hosts.items():
        k = domains[s, d][2]
        mean = (bad + k * d_mean[s, d]) / (n + k)
        out[h] = mean - u.DEVIATIONS * math.sqrt(mean * (1 - mean) / (n + k + 1))
    return out


def test_posterior_equals_plain_sums(spark):
    rng, hosts = random.Random(9), {}
    for d in range(12):
        s, rate = rng.choice(["com", "org", "net"]), rng.random()
        for k in range(rng.randint(1, 6)):
            n = rng.choice([0, 1, 5, 40])
            hosts[f"h{k}.d{d}.{s}"] = (s, f"d{d}.{s}", n, sum(rng.random() < rate for _ in range(n)))
    table = spark.createDataFrame([(h, n + 2, n, b) for h, (_, _, n, b) in hosts.items()], "host string, pages bigint, n bigint, bad bigint")
    got = {r.host: r.bound for r in u.posterior(table).collect()}
    known = plain(hosts)
    assert got.keys() == known.keys() and all(abs(got[h] - known[h]) < 1e-9 for h in known)
    assert u.posterior(table.limit(0)).count() == 0


def test_odd_rows(spark):
    rows = [(None, None), ("no scheme", "x"), ("http://", ""), ("http://a.org/?q", GOOD), ("http://a.org/?q", GOOD), ("http://b.net/#x", "z" * 300_000)]
    got = judged(spark, rows)
    assert len(got) == 6 and got[3][1:] == got[4][1:] and got[0].verdict == "allow" and got[3].rule == "org/" and got[3].reputation is None
    without = spark.createDataFrame([(1, "http://casino.net/a")], "page_id bigint, url string")
    assert u.judge(without, html_col=None).first().outcome == 1
