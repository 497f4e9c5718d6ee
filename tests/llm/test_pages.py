"""HTML extraction."""

import collections
import html
import random
import re

import pytest

from accordant.llm import page_text, queries

LONG = "A sentence that only this page has, number {}."


def page(title, body, around=True, tail=""):
    menu = "<nav><ul><li><a href='/a'>Menu</a></li></ul></nav><header>Site name</header>" if around else ""
    return f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{x}}</style><script>var t='</p><p>no';</script></head><body>{menu}{body}{tail}</body></html>"


def common_length(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("letters", [2, 6, 30])
def test_common_lines(letters):
    rng = random.Random(letters)
    for _ in range(500):
        a, b = ([rng.randrange(letters) for _ in range(rng.randint(0, 16))] for _ in "ab")
        got = page_text.common_lines(a, b)
        assert len(got) == common_length(a, b)
        rest = iter(b)
        assert all(any(a[k] == y for y in rest) for k in got)


def test_long_pages_align_in_linear_memory():
    a, b = list(range(20_000)), [x for x in range(20_000) if x % 7]
    assert len(page_text.common_lines(a, b)) == len(b)


CASES = {
    "<article><h1>T</h1><p>a <b>b</b>\n c<br>d</p><div>e</div>f</article>": "T\na b c d\ne\nf",
    "<article><p>x &amp; y &lt;z&gt; &eacute; &#233; &amp &quo</p></article>": "x & y <z> é é & &quo",
    "<article><header><h1>T</h1></header><p>a</p><aside>no</aside><form><p>no</p></form><footer>no</footer></article><footer>no</footer>": "T\na",
    "<div class='ad'>no</div><main><p>a</p><div class=\"cookie-notice\">no</div><section id=comments><p>no</p></section></main><p>no</p>": "a",
    "<article><p>a</p><!-- no --><p hidden>no</p><div role='navigation'>no</div><p>b</article><article class='comment'>no</article>": "a\nb",
    "<div class='has-sidebar'><p>a<p>b</div><div class=sidebar>no</div>": "a\nb",
    "<article><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table><ul><li>x<li>y</ul></article>": "1 2\n3\nx\ny",
    "<article><p>a < b > c</p><p>1 <2</p><p>cut <b": "a < b > c\n1 <2\ncut",
    "<article><p><b>open<br><p>next</p></article><footer>no</footer>": "open\nnext",
    "<div class='ad'>open <article><p>a</p></article>": "a",
    "plain text": "plain text",
    "": "",
    "<article></article><script>no": "",
}


@pytest.mark.parametrize("body", CASES)
def test_structure(body):
    for around in (False, True):
        text = page_text.main_text(page("t", body, around) if body and "<b" != body[-2:] and not body.endswith("no") else body, [])
        assert text == CASES[body]


def test_places_of_urls():
    assert page_text.place_of("https://Me@Www.A.example:8/x/y.html?q=1#z") == ("www.a.example:8", "/x/y")
    assert page_text.place_of("http://a.example") == ("a.example", "")
    assert page_text.place_of("//a.example/x/") == ("a.example", "/x")
    assert page_text.place_of("mailto:x") == page_text.place_of(None) == (None, "")


@pytest.fixture(scope="module")
def site(spark):
    """Pages without article elements: what the nearest page also has goes."""
    rng = random.Random(8)
    rows = []
    for k in range(30):
        own = [LONG.format(f"{k}-{j}-{rng.random()}") for j in range(8)]
        body = "<div>Welcome to the site</div><div>Login here</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights reserved</div>"
        rows.append((k, f"http://one.example/{'news' if k % 2 else 'blog'}/{k:03d}.html", page("t", body), "\n".join(own)))
    rows.append((90, "http://two.example/only", page("t", "<div>Welcome to the site</div><p>alone</p>"), "Welcome to the site\nalone"))
    rows += [(91, u, page("t", "<p>a copy</p><p>of a page</p>"), "a copy\nof a page") for u in ("http://three.example/1", "http://three.example/2")]
    rows += [(92, "http://four.example/a", None, ""), (93, None, page("t", "<p>x</p>"), "x"), (94, "http://four.example/b", "", ""), (None, None, None, "")]
    rows += [(95, "http://five.example/a", page("t", "<article><p>Yes.</p><p>One.</p><li>Share</li></article>"), "Yes.\nOne.")]
    rows += [(96, "http://five.example/b", page("t", "<article><p>Yes.</p><p>Two.</p><li>Share</li></article>"), "Yes.\nTwo.")]
    rows += [(97, "http://six.example/a", page("t", "".join(f"<p>{k}</p>" for k in range(20_000))), "\n".join(map(str, range(20_000))))] * 2
    frame = spark.createDataFrame([(*r[:3], "x", k, [k]) for k, r in enumerate(rows)], "page_id long, url string, html string, text string, k1 int, shared array<int>")
    return frame, [(r[0], r[1], r[3], len(r[3])) for r in rows]


@pytest.mark.parametrize("parts", [1, 7])
def test_shared_lines_go(site, parts):
    frame, want = site
    got = page_text.extract_text(frame.repartition(parts)).collect()
    assert collections.Counter(tuple(r) for r in got) == collections.Counter(want)


def test_no_pages(site):
    assert page_text.extract_text(site[0].limit(0)).count() == 0


def plain_text(page):
    """The article of the driver's pages, which have one template."""
    start, stop = page.find("<article>") + 9, page.find("</article>")
    body = page[start : stop if stop >= 0 else None]
    if stop < 0:
        body = re.sub("<[^>]*$", "", body)
    blocks = (re.sub(r"\s+", " ", html.unescape(re.sub("</?b>", "", x))).strip() for x in re.split("</?(?:p|h1)>|<br>", body))
    return "\n".join(x for x in blocks if x)


def test_op10(spark):
    folder = "/root/testdata/sf0.01"
    got = {r["page_id"]: (r["url"], r["text"], r["n_chars"]) for r in queries.QUERIES["op10_page_text"](spark, folder).collect()}
    rows = spark.read.parquet(f"{folder}/pages.parquet").collect()
    assert len(got) == len(rows)
    for r in rows:
        text = plain_text(r["html"])
        assert got[r["page_id"]] == (r["url"], text, len(text))
