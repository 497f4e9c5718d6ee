"""URL filters over redirect equivalence: block decisions reach all aliases of a page, allows come first.

Rules name a host and the beginning of a path; the longest rule that fits a URL decides it. URLs without a
rule are judged by their aliases. Nodes are addresses (a URL without what no server tells apart, see
`address`); edges are the redirects (meta refresh) and canonical links that pages state, plus
further edges of the caller, such as a crawl's redirect log. Connected components run as distributed joins
over addresses that have an edge. A component is blocked if a rule blocks one of its pages and no rule
allows one; pages that a rule allows or blocks keep that verdict.

Everything is built-in expressions. Decisions are combined per address and per component before they
go back, so a component or a link target with a third of all pages costs one line a task.

Cases: a null URL or one without `://` has an empty host and path and no rule, it is no alias of any
other and allowed; null or empty html states no edge, very long html is searched whole; of several
statements in one page each is an edge; ties between rules of one length cannot occur, since both
would have the same host and path, and equal rules with opposite verdicts count as allow; repeated rows are judged
each; an empty table gives no row. Only the named columns are read, so others may have any names.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant.operators.graph import connect
from accordant.session import fact_join

ALLOW, BLOCK = "allow", "block"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"^(.*?)://([^/?#]*)([^?#]*)(\?[^#]*)?"  # scheme, host, path, query
TAG = r"(?i)<(?:link|meta)\s[^>]*>"
REFRESH = r"""(?i)^\s*[0-9.]*\s*[;,]\s*url\s*=\s*["']?([^"']*)"""
#: Parameters that tell where a visitor came from, not what is shown.
TRACKING = r"[?&](?:utm_[a-z]+|gclid|fbclid)=[^&]*"
DEFAULT_PORT = r":(?:80|443)$"


@dataclass(frozen=True)
class UrlRule:
    verdict: str
    host: str
    path: str = "/"

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(text: str) -> UrlRule:
    """`block example.org/es/` -> a rule for that host with its subdomains and that beginning of a path."""
    verdict, _, where = text.partition(" ")
    host, slash, path = where.partition("/")
    if verdict not in (ALLOW, BLOCK) or not host or not slash:
        raise ValueError(f"not a rule: {text!r}")
    return UrlRule(verdict, host.translate(str.maketrans(UPPER, LOWER)), slash + path)


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?` or `#`, A to Z lower-cased; empty if there is none."""
    return lower_ascii(F.coalesce(F.regexp_extract(url, f"(?s){URL}", 2), F.lit("")))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, f"(?s){URL}", 3), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query without scheme, default port, tracking parameters, closing slash and fragment.

    Null for what is no URL with a host.
    """
    query = F.regexp_replace(F.regexp_extract(url, f"(?s){URL}", 4), TRACKING, "")
    host = F.regexp_replace(host_of(url), DEFAULT_PORT, "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(host, path, F.regexp_replace(query, "^&", "?")))


def fitting_rule(host: Column, path: Column, rules: Sequence[UrlRule]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.name), r.verdict))
    out = None
    for r in ordered:
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        value = F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return F.lit(None).cast("struct<rule:string,verdict:string>") if out is None else out


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute of one tag, without its quotes; empty if it has none."""
    quoted = F.regexp_extract(tag, rf"""(?i)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(F.regexp_replace(F.trim(F.regexp_replace(quoted, """^["']|["']$""", "")), "&amp;", "&"), "&#38;", "&")


def resolve(base: Column, link: Column) -> Column:
    """A link as a whole URL. A link that begins with a name is taken beside the last part of the path."""
    scheme, host = F.regexp_extract(base, f"(?s){URL}", 1), F.regexp_extract(base, f"(?s){URL}", 2)
    root = F.concat(scheme, F.lit("://"), host)
    return (
        F.when(link.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), link)
        .when(F.startswith(link, F.lit("//")), F.concat(scheme, F.lit(":"), link))
        .when(F.startswith(link, F.lit("/")), F.concat(root, link))
        .when((link == "") | F.startswith(link, F.lit("#")), base)
        .when(F.startswith(link, F.lit("?")), F.concat(root, path_of(base), link))
        .otherwise(F.concat(root, F.regexp_replace(path_of(base), "[^/]*$", ""), F.when(path_of(base) == "", "/").otherwise(""), link))
    )


def stated_edges(pages: DataFrame, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(from_url, to_url): canonical links and meta refreshes of the pages; comments and scripts state none."""
    plain = F.regexp_replace(F.col("html"), r"(?is)<!--.*?-->|<script\b.*?</script\s*>", " ")
    tags = (
        pages.select(F.col(url_col).alias("from_url"), F.col(html_col).alias("html"))
        .filter(F.col("html").rlike(r"(?i)\bcanonical\b|http-equiv"))
        .select("from_url", F.explode(F.regexp_extract_all(plain, F.lit(TAG), F.lit(0))).alias("tag"))
    )
    canonical = F.col("tag").rlike("(?i)^<link") & F.array_contains(F.split(F.lower(attribute(F.col("tag"), "rel")), r"\s+"), "canonical")
    refresh = F.col("tag").rlike("(?i)^<meta") & (F.lower(attribute(F.col("tag"), "http-equiv")) == "refresh")
    target = F.when(canonical, attribute(F.col("tag"), "href")).when(
        refresh, F.trim(F.regexp_extract(attribute(F.col("tag"), "content"), REFRESH, 1))
    )
    return tags.select("from_url", target.alias("link")).filter("link <> ''").select("from_url", resolve(F.col("from_url"), F.col("link")).alias("to_url"))


def alias_classes(edges: DataFrame) -> DataFrame:
    """(node, root): addresses that redirects and canonical links connect; addresses without an edge are left out."""
    ends = edges.select(address(F.col("from_url")).alias("a"), address(F.col("to_url")).alias("b")).filter("a <> b")
    # All that point at one address share its key, and so does the address itself.
    both = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("key")), F.struct(F.col("b").alias("node"), F.col("b").alias("key"))))
    members = ends.select(both.alias("end")).select("end.node", "end.key")
    return connect(members)


def judge_urls(
    pages: DataFrame, rules: Sequence[UrlRule], edges: DataFrame | None = None, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """page_id, host, path, rule, verdict, and root: the smallest address of the page's aliases.

    edges: from_url, to_url of known redirects, beside those that the pages state.
    """
    stated = stated_edges(pages, url_col=url_col, html_col=html_col)
    classes = alias_classes(stated if edges is None else stated.unionByName(edges.select("from_url", "to_url")))
    url = F.col(url_col)
    host, path = host_of(url), path_of(url)
    base = pages.select(
        F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"),
        fitting_rule(host, path, rules).alias("own"), address(url).alias("node"),
    )
    decided = base.filter("node is not null").groupBy("node").agg(
        F.max(F.coalesce(F.col("own.verdict") == BLOCK, F.lit(False))).alias("blocks"),
        F.max(F.coalesce(F.col("own.verdict") == ALLOW, F.lit(False))).alias("allows"),
    )
    rooted = fact_join(decided, classes, ["node"]).withColumn("root", F.coalesce("root", "node"))
    totals = rooted.groupBy("root").agg((F.max("blocks") & ~F.max("allows")).alias("blocked"))
    known = fact_join(rooted.select("node", "root"), totals, ["root"])
    return fact_join(base, known, ["node"]).select(
        "page_id", "host", "path", F.col("own.rule").alias("rule"),
        F.coalesce("own.verdict", F.when(F.col("blocked"), BLOCK).otherwise(ALLOW)).alias("verdict"),
        "root",
    )


def keep_allowed(pages: DataFrame, rules: Sequence[UrlRule], edges: DataFrame | None = None, *, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The pages whose verdict is allow, with all their columns. A verdict belongs to a URL, so equal URLs stay or go together."""
    verdicts = judge_urls(pages, rules, edges, id_col=url_col, url_col=url_col, html_col=html_col)
    blocked = verdicts.filter(F.col("verdict") == BLOCK).select(F.col("page_id").alias(url_col)).distinct()
    return pages.join(blocked, url_col, "left_anti").select(*pages.columns)
