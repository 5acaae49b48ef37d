"""Main text where names mislead, siblings are alike, hosts are large and pages deep or broken."""

import random
from collections import Counter, defaultdict

import pytest

from cardweave.llm import html_extract


def texts(spark, pages, host="h.org"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return {r.page_id: r.text for r in html_extract.main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(3)).collect()}


def test_an_article_card_does_not_replace_the_main_text(spark):
    page = "<body><div class=x>site name</div><div class=y><p>long main text number {0} goes on and on</p></div><article class=card>see {0}</article></body>"
    got = texts(spark, [page.format(i) for i in range(8)])
    assert got[3] == "long main text number 3 goes on and on\n\nsee 3"
    # Too few pages for a template: most of the text is outside of the article.
    assert "long main text number 0" in texts(spark, [page.format(0)])[0]


def test_constant_nodes_among_equal_siblings_are_template(spark):
    page = "<body><p>same notice</p><p>body {0} one</p><p>body {0} two</p><p>same end</p><div>menu</div><div>more {0}</div></body>"
    got = texts(spark, [page.format(i) for i in range(8)])
    assert got[5] == "body 5 one\n\nbody 5 two\n\nmore 5"
    # Pages that are all alike have no template.
    assert texts(spark, ["<body><p>a</p><p>b</p></body>"] * 8)[0] == "a\n\nb"


def test_late_template_nodes_of_large_hosts_are_found(spark):
    # Each page has 700 names of its own, so a wrapper of 2,000 nodes would be full after three pages.
    page = lambda i: "<body>" + "".join(f"<x{'abcdefghij'[i]}{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}>t{i} {k}</x{'abcdefghij'[i]}{'abcdefghij'[k // 100]}{'abcdefghij'[k // 10 % 10]}{'abcdefghij'[k % 10]}>" for k in range(700)) + ("<section><b>late line</b></section>" if i > 1 else "") + "</body>"
    got = texts(spark, [page(i) for i in range(10)])
    assert not any("late line" in t for t in got.values()) and "t7 699" in got[7]


@pytest.mark.parametrize("page, text", [
    ("<div>" * 100_000 + "x", "x"),
    ("<span>" * 50_000 + "</b>" * 50_000 + "t", "t"),
    ("<p>a" * 100_000, "\n\n".join("a" * 100_000)),
    ("<table>" + "<tr><td>x" * 20_000, "\n\n".join("x" * 20_000)),
    ("<article><div class='post-header'><h1>T</h1></div><p class=share-price>1</p><label>l</label><math>m</math><div class=comments>c</div><div class='ad box'>a</div><video>v</video></article>", "T\n\n1\n\nlmv"),
    ("<div class='article-header'>A</div><div class='site-header'>S</div><article>text of it</article><div class='comment-list'>c</div>", "A\n\ntext of it"),
    ("<head><title>t</title><p>in body", "in body"),
    ("<main><article>a</article><article>b</article></main>", "a\n\nb"),
    ("a &amp; b &#8364; <b>c</b>d <!-- x --> <script>s</script><textarea>f</textarea>e", "a & b \u20ac cd e"),
])
def test_pages(page, text):
    assert html_extract.extract(page, None) == text


def plain(pages):
    """The whole query in one process: texts by id."""
    hosts, keys, inner, outer = Counter(h for _, h, _ in pages), defaultdict(Counter), Counter(), Counter()
    for _, host, page in pages:
        seen = set()
        for _, key, size, inside in html_extract.places(html_extract.parse(page or "")):
            (inner if inside else outer)[host, key] += size
            seen.add(key)
        keys[host].update(seen)
    out = {}
    for i, host, page in pages:
        n, constant, focus = hosts[host], None, False
        if n >= html_extract.MIN_PAGES:
            fixed = {k for k, c in keys[host].items() if c >= html_extract.MIN_PAGES and c >= n * html_extract.MIN_SHARE}
            if sum(c for k, c in keys[host].items() if k not in fixed) >= n * html_extract.MIN_SHARE:
                rest = [k for k in keys[host] if k not in fixed]
                constant, focus = frozenset(fixed), sum(inner[host, k] for k in rest) >= sum(outer[host, k] for k in rest)
        out[i] = html_extract.extract(page, constant, focus)
    return out


def test_the_query_equals_one_process_under_any_partitioning(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcde", k=3))
    rows = []
    for i in range(300):
        host = rng.choice(["a.org", "a.org", "b.org", "c.org", f"{word()}.net"])
        body = "".join(f"<p>{word()} {word()}</p>" for _ in range(rng.randint(0, 3)))
        page = rng.choice([f"<nav>m</nav><div>top {host}</div><article><h1>{word()}</h1>{body}<div>fixed</div></article><div>{word()}</div>", f"<div>same</div>{body}<div class=ad>{word()}", body, "", None])
        rows.append((i, host, page))
    rows.append((300, rows[0][1], rows[0][2]))  # a repeated page
    known = plain([(i, "" if h is None else h, p) for i, h, p in rows])
    for parts in (1, 7):
        table = spark.createDataFrame([(i, f"http://{h}/{i}", p, "x", 1) for i, h, p in rows], "page_id bigint, url string, html string, host string, n bigint")
        got = {r.page_id: r.text for r in html_extract.main_text(table.repartition(parts)).collect()}
        assert got == known
    none = spark.createDataFrame([], "page_id bigint, url string, html string")
    assert html_extract.main_text(none).count() == 0
    odd = spark.createDataFrame([(None, None, "<p>a"), (1, None, None), (1, None, None), (2, "x", "b" * 300_000)], "page_id bigint, url string, html string")
    assert sorted((r.n_chars, r.page_id) for r in html_extract.main_text(odd).filter("page_id is not null").collect()) == [(0, 1), (0, 1), (300_000, 2)]
