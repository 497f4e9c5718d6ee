"""URL rules, edges that pages state, and verdicts of aliases."""

import re

import pytest
from pyspark.sql import functions as F

from accordant.llm import url_filter as U
from accordant.llm.queries import URL_RULES

RULES = [U.rule(r) for r in URL_RULES]


def own(url):
    """(host, path, rule, verdict) of one URL by its rules alone."""
    scheme, mark, rest = (url or "").partition("://")
    host = re.split("[/?#]", rest, maxsplit=1)[0] if mark else ""
    path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fit, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def plain_verdicts(rows, edges):
    """rows: (id, url); edges between addresses. (id, host, path, rule, verdict) of each row."""
    group = {}

    def find(x):
        group.setdefault(x, x)
        while group[x] != x:
            x = group[x]
        return x

    for a, b in edges:
        group[find(a)] = find(b)
    where = [a for _, _, a in rows]
    rules = [own(u) for _, u, _ in rows]
    seen = {}
    for a, r in zip(where, rules):
        if a is not None and r[3]:
            seen.setdefault(find(a), set()).add(r[3])
    return [
        (i, *r[:3], r[3] or ("block" if a is not None and seen.get(find(a)) == {"block"} else "allow")) for (i, _, _), a, r in zip(rows, where, rules)
    ]


PAGES = [
    (1, "http://a.example.org/es/1", None),
    (2, "https://x.net/p", '<head><LINK href="http://a.example.org/es/1?utm_source=feed#top" rel="alternate Canonical"></head>'),
    (3, "https://y.net/q/", "<meta http-equiv=refresh content=\"0; URL='https://x.net/p'\">"),
    (4, "http://Y.net:80/q?utm_medium=z#frag", "<p>canonical</p>"),
    (5, "https://www.shop.com/fr/1", '<link rel=canonical href="https://x.net/p">'),  # allowed itself, so the class is
    (6, "https://z.net/1", '<!-- <link rel="canonical" href="http://b.com/de/"> --><script>"<link rel=canonical href=http://b.com/de/>"</script>'),
    (7, "https://b.com/de/", ""),
    (8, "https://t.net/dir/old", '<link rel="canonical" href="new">'),
    (9, "https://t.net/dir/new", '<link rel="canonical" href="/blocked">'),
    (10, "https://t.net/blocked", '<meta http-equiv="Refresh" content="5;url=//b.com/de/?a=1&amp;b=2">'),
    (11, "https://b.com/de/?a=1&b=2", None),
    (12, None, '<link rel="canonical" href="http://b.com/de/">'),
    (13, "no url", '<link rel="canonical" href="http://b.com/de/">'),
    (14, "https://u.net/", '<link rel="canonical" href="?page=2">'),
    (15, "https://u.net?page=2", '<link rel="canonical" href="https://b.com/de/">'),
    (15, "https://u.net?page=2", '<link rel="canonical" href="https://b.com/de/">'),
    (16, "https://org/", "<link rel=stylesheet href=/x>"),
    (17, "https://aorg/es/", None),
    (18, "https://EXAMPLE.org/en/12", None),
    (None, "https://example.org/en/2", None),
]


@pytest.fixture()
def pages(spark):
    rows = [(i, u, h, "own", 1, "x") for i, u, h in PAGES]
    return spark.createDataFrame(rows, "page_id long, url string, html string, root string, node int, own string").repartition(3)


def key(row):
    return tuple((x is not None, x) for x in row)


def test_verdicts_of_aliases(pages):
    got = {}
    for r in U.judge_urls(pages, RULES).collect():
        got.setdefault(r["page_id"], set()).add((r["rule"], r["verdict"]))
    free = {k: v for k, v in got.items() if next(iter(v))[0] is None}
    assert {k for k, v in free.items() if v == {(None, "block")}} == {8, 9, 10, 14, 15}
    assert {k for k, v in free.items() if v == {(None, "allow")}} == {2, 3, 4, 6, 12, 13, 17}
    assert got[1] == {("example.org/es/", "block")} and got[5] == {("com/fr/", "allow")}
    assert got[16] == {("org/", "allow")} and got[18] == {("example.org/en/1", "block")} and got[None] == {("org/", "allow")}


def test_without_the_allowed_page_its_class_is_blocked(pages):
    got = {r["page_id"]: r["verdict"] for r in U.judge_urls(pages.filter("page_id <> 5"), RULES).collect()}
    assert [got[k] for k in (1, 2, 3, 4)] == ["block"] * 4


def test_long_chains_and_one_target_of_many(spark):
    """A redirect log beside the pages: a chain of 300 addresses and 2,000 aliases of one address."""
    chain = [(f"https://c{k}.net/", f"https://c{k + 1}.net/") for k in range(300)] + [("https://c300.net/", "http://q.com/de/x")]
    star = [(f"http://s{k}.net/a", "http://m.net/a") for k in range(2000)]
    urls = sorted({u for e in chain + star for u in e})
    rows = [(k, u, u.split("://")[1].rstrip("/")) for k, u in enumerate(urls)]
    pages = spark.createDataFrame([r[:2] for r in rows], "page_id long, url string").withColumn("html", F.lit("")).repartition(5)
    edges = spark.createDataFrame(chain + star, "from_url string, to_url string")
    want = plain_verdicts(rows, [tuple(u.split("://")[1].rstrip("/") for u in e) for e in chain + star])
    got = U.judge_urls(pages, RULES, edges).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert sum(w[-1] == "block" for w in want) == 302


def test_rules_alone_on_the_table(spark, sf):
    rows = [(r["page_id"], r["url"], None) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()]
    got = U.judge_urls(spark.read.parquet(f"{sf}/pages.parquet"), RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain_verdicts(rows, []), key=key)


def test_kept_pages_have_their_columns(pages, spark):
    kept = U.keep_allowed(pages, RULES)
    assert kept.columns == pages.columns
    assert {r["page_id"] for r in kept.collect()} == {2, 3, 4, 5, 6, 12, 13, 16, 17, None}
    empty = U.judge_urls(pages.limit(0), RULES)
    assert empty.collect() == [] and U.keep_allowed(pages.limit(0), RULES).collect() == []
    assert U.judge_urls(pages, []).filter("verdict <> 'allow'").collect() == []


def test_rules_are_checked():
    assert U.rule("block Example.ORG/es/") == U.UrlRule("block", "example.org", "/es/")
    for bad in ("deny org/", "allow org", "allow /x", ""):
        with pytest.raises(ValueError):
            U.rule(bad)
