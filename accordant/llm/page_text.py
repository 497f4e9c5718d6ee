"""HTML extraction: nearest-URL page differencing, with the page's own structure beside it.

1. A page becomes text lines, one for each block, in page order. Each line knows whether it stands
   in an element that is no article text by its tag, role or class (menus, footers, forms, ...) and
   how close a container it has (article, main, or the body).
2. Pages are ordered by host and URL path without bringing a host into one task: ranges are sorted
   and numbered, and each page meets the ones before and after it by a join on the number. The
   nearer one is that of the same host with the longer common path.
3. The lines of both are aligned by a longest common subsequence (on hashes of the lines). Shared
   lines are what a site prints on every page; they are deleted.

Differencing alone can't give the text: menus and adverts may differ on every page of a site, and two
pages may carry copies of one article, or by chance an equal short sentence. So structure decides
where it speaks: lines in elements that are no article text go at once, a shared paragraph or
heading inside an article element stays, and a page that shares nearly all its lines with the
nearest one is a copy of it and keeps them. What is left to differencing are lines without such a
mark: on pages without an article element all of them.

Cases: a null or empty page has an empty text; a page without a host is paired with none; equal
pages are copies of each other; a page cut off inside a tag ends before it; unclosed elements
end with their parent; an undefined character reference stays as it is; an empty table gives no
rows. Other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordant.llm.words import small_batches
from accordant.session import number_rows, scratch_path

COPY = 0.9  # a page that shares so much of its text with the nearest one is a copy

#: Elements by what they mean for the text.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "canvas", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split()
)
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "figcaption", "dd", "dt", "td", "th", "tr", "caption"}
NO_TEXT = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head", "object", "audio", "video", "label"}
NO_TEXT_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
NO_TEXT_WORDS = set(
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent gdpr notice notices alert ad ads advert adverts "
    "advertisement advertising sponsor sponsored promo comment comments reply replies respond disqus share sharing social related recommended "
    "newsletter subscribe subscription signup login popup modal overlay widget pagination pager skip".split()
)
LAYOUT_WORDS = {"has", "no", "with", "without"}

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)(?:>|(\Z))""", re.S)
ATTRIBUTE = re.compile(r"""([a-zA-Z_:-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
SPACE = re.compile(r"\s+")


def no_text(tag: str, attributes: str, in_article: bool) -> bool:
    """Is an element no article text, by its tag, role or class?"""
    if tag in NO_TEXT or tag == "header" and not in_article:
        return True
    if not attributes or tag in ("html", "body", "main", "article"):
        found = dict.fromkeys(())
    else:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if found.get("role", "").lower() in NO_TEXT_ROLES or "hidden" in found:
        return True
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        words = re.split(r"[-_]+", name)
        if words[0] not in LAYOUT_WORDS and (words[0] in NO_TEXT_WORDS or words[-1] in NO_TEXT_WORDS):
            return True
    return tag == "article" and bool(re.search(r"comment|reply|teaser", attributes.lower()))


class Lines:
    """The text lines of a page: text, whether it is no article text, container (0 body, 1 main, 2 article), prose."""

    def __init__(self, page: str):
        self.lines: list[tuple[str, bool, int, bool]] = []
        self.stack: list[tuple[str, bool, int]] = []  # tag, no text, container
        self.parts: list[str] = []
        self.prose = False
        at, raw = 0, None
        while True:
            m = TOKEN.search(page, at)
            if m is None:
                self.parts.append(page[at:])
                break
            self.parts.append(page[at : m.start()])
            at = m.end()
            tag = (m[2] or "").lower()
            if not tag or m[4] is not None:
                continue
            if m[1]:
                self.close(tag)
            elif tag in RAW:
                raw = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
                at = raw.end() if raw else len(page)
                self.parts.append(" ")
            else:
                self.open(tag, m[3] or "")
        self.end_line()

    def end_line(self) -> None:
        text = SPACE.sub(" ", html.unescape("".join(self.parts))).strip()
        self.parts = []
        if text:
            skipped = any(x[1] for x in self.stack)
            self.lines.append((text, skipped, max((x[2] for x in self.stack), default=0), self.prose))

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.end_line()
            self.prose = tag in PROSE
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID or attributes.endswith("/") and tag not in BLOCK:
            return
        if tag == "p" and self.stack and self.stack[-1][0] == "p":
            self.stack.pop()
        level = 2 if tag == "article" else 1 if tag == "main" or 'role="main"' in attributes else 0
        if level == 2:  # an article ends what was left open before it
            while self.stack and any(x[1] and x[0] != "aside" and not x[2] for x in self.stack):
                self.stack.pop()
        self.stack.append((tag, no_text(tag, attributes, any(x[2] for x in self.stack)), level))

    def close(self, tag: str) -> None:
        if tag in BLOCK:
            self.end_line()
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        if tag in BLOCK:
            self.prose = next((x[0] in PROSE for x in reversed(self.stack) if x[0] in BLOCK), False)


def verdicts(lines: list[tuple[str, bool, int, bool]]) -> list[int]:
    """What structure says of each line: 0 not of the text, 1 of the text, 2 left to differencing."""
    level = max((x[2] for x in lines if not x[1]), default=0)
    return [0 if skipped or at < level else 1 if at == 2 and prose else 2 for _, skipped, at, prose in lines]


def main_text(page: str | None, shared: list[int] | None) -> str:
    """The article text of a page, given the numbers of the lines that differencing deletes."""
    lines = Lines(page or "").lines
    gone = set(shared or ())
    return "\n".join(x[0] for k, (x, said) in enumerate(zip(lines, verdicts(lines))) if said == 1 or said == 2 and k not in gone)


def place_of(url: str | None) -> tuple[str | None, str]:
    """Host and path of a URL, without query, fragment, suffix and last slash."""
    m = re.match(r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]+)([^?#]*)", url or "")
    if not m:
        return None, ""
    return m[1].lower().rsplit("@", 1)[-1], re.sub(r"(?:/(?:index\.\w+)?|\.\w{2,5})$", "", m[2])


def row_bits(a: list[int], b: dict[int, int], full: int) -> int:
    """After all of a: a zero bit for each place of b where the longest common subsequence grows."""
    v = full
    for x in a:
        own = v & b.get(x, 0)
        v = ((v + own) | (v - own)) & full
    return v


def prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """Length of the longest common subsequence of a and each beginning of b."""
    places: dict[int, int] = {}
    for k, x in enumerate(b):
        places[x] = places.get(x, 0) | 1 << k
    v = row_bits(a, places, (1 << len(b)) - 1)
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), count=len(b), bitorder="little")
    return np.append(0, np.cumsum(1 - bits.astype(np.int64)))


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in a of a longest common subsequence of a and b, in linear memory (Hirschberg), with
    bit-parallel rows."""
    out: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append(a0)
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            out.append(a1 - 1)
            a1, b1 = a1 - 1, b1 - 1
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            if a[a0] in b[b0:b1]:
                out.append(a0)
            continue
        middle = (a0 + a1) // 2
        best = prefix_lengths(a[a0:middle], b[b0:b1]) + prefix_lengths(a[middle:a1][::-1], b[b0:b1][::-1])[::-1]
        cut = b0 + int(best.argmax())
        todo += [(a0, middle, b0, cut), (middle, a1, cut, b1)]
    return sorted(out)


def common_prefix(a: str, b: str) -> int:
    k = 0
    for x, y in zip(a, b):
        if x != y:
            break
        k += 1
    return k


def shared_lines(pages: DataFrame) -> DataFrame:
    """(k1, k2, shared): the numbers of the lines that go, for pages on which differencing deletes any.

    pages: k1, k2, url, html.
    """

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [place_of(u) for u in batch.column(2).to_pylist()]
            lines = [Lines(h or "").lines for h in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_pydict(
                {
                    "k1": batch.column(0),
                    "k2": batch.column(1),
                    "host": pa.array([p[0] for p in places], pa.string()),
                    "path": pa.array([p[1] for p in places], pa.string()),
                    "lines": pa.array([[xxhash.xxh64_intdigest(x[0]) >> 1 for x in page] for page in lines], pa.list_(pa.int64())),
                    # Each line's length, and below it what structure says of it.
                    "sizes": pa.array([[len(x[0]) << 2 | said for x, said in zip(page, verdicts(page))] for page in lines], pa.list_(pa.int64())),
                }
            )

    outlines = pages.mapInArrow(outline, "k1 long, k2 long, host string, path string, lines array<long>, sizes array<long>")
    numbered = number_rows(outlines.filter("host IS NOT NULL"), [F.col(c) for c in ("host", "path", "k1", "k2")], "nth")

    def beside(step: int, name: str) -> DataFrame:
        return numbered.select((F.col("nth") + step).alias("nth"), F.struct("host", "path", "lines").alias(name))

    both = numbered.join(beside(1, "before"), "nth", "left").join(beside(-1, "after"), "nth", "left")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"k1": [], "k2": [], "shared": []}
            for row in batch.to_pylist():
                near = [x for x in (row["before"], row["after"]) if x and x["host"] == row["host"]]
                if not near or not row["lines"]:
                    continue
                other = max(near, key=lambda x: common_prefix(x["path"], row["path"]))
                shared = common_lines(row["lines"], other["lines"])
                own = [n >> 2 if n & 3 else 0 for n in row["sizes"]]  # lengths of lines of the text
                gone = [k for k in shared if row["sizes"][k] & 3 == 2]
                if gone and sum(own[k] for k in shared) < COPY * sum(own):
                    for name, value in (("k1", row["k1"]), ("k2", row["k2"]), ("shared", gone)):
                        out[name].append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(out["k1"], pa.int64()), pa.array(out["k2"], pa.int64()), pa.array(out["shared"], pa.list_(pa.int32()))], names=list(out)
            )

    rows = both.select("k1", "k2", "host", "path", "lines", "sizes", "before", "after")
    found = rows.mapInArrow(compare, "k1 long, k2 long, shared array<int>").dropDuplicates(["k1", "k2"])
    # Written first, so that Spark knows its size and moves the pages only if it is large.
    path = scratch_path(pages.sparkSession, "shared")
    found.write.parquet(path)
    return pages.sparkSession.read.parquet(path)


def extract_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page."""
    small_batches(pages.sparkSession)
    page, url, body = F.col(id_col), F.col(url_col), F.col(html_col)
    keyed = pages.select(
        F.xxhash64(page, url, body).alias("k1"), F.coalesce(page.cast("long"), F.lit(-1)).alias("k2"),
        page.cast("long").alias("page_id"), url.cast("string").alias("url"), F.coalesce(body, F.lit("")).alias("html"),
    )
    found = shared_lines(keyed.select("k1", "k2", "url", "html"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h, s) for h, s in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_pydict(
                {"page_id": batch.column(0), "url": batch.column(1), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            )

    joined = keyed.join(found, ["k1", "k2"], "left").select("page_id", "url", "html", "shared")
    return joined.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
