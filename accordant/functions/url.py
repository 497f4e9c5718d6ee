"""URL expressions. Hosts with blanks or non-ASCII letters must survive, so parsing is by pattern."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordant import rules as R
from accordant.functions.text import any_of, clean_text, let
from accordant.session import fact_join

_URL = r"^(?i)(https?):(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?"
FIND_URL = r"(?iU)https?://[^\s<>]+"


def _decode(c: Column) -> Column:
    return F.url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encode(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """Decoded key/value pairs of a query string, in order."""
    items = F.filter(F.split(query, "&"), lambda x: x != "")
    return F.transform(
        items,
        lambda x: F.struct(
            _decode(F.regexp_extract(x, "^([^=]*)", 1)).alias("k"),
            _decode(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def normalize_url(
    c: Column,
    drop_keys: Sequence[str] = R.DROP_QUERY_KEYS,
    drop_prefix: str = R.DROP_QUERY_PREFIX,
) -> Column:
    """Comparable form of an http(s) URL, '' for anything else."""

    def build(text: Column) -> Column:
        # Inside a lambda nothing is shared: what is used several times is bound by `let`.
        path = F.regexp_replace(
            F.regexp_replace(F.regexp_replace(F.regexp_extract(text, _URL, 3), ";[^/]*$", ""), "/{2,}", "/"),
            "/+$",
            "",
        )
        kept = F.filter(
            query_pairs(F.regexp_extract(text, _URL, 4)),
            lambda p: ~F.lower(p["k"]).startswith(drop_prefix) & ~F.lower(p["k"]).isin(*drop_keys),
        )
        query = F.array_join(
            F.transform(
                F.array_sort(kept), lambda p: F.concat(_encode(p["k"]), F.lit("="), _encode(p["v"]))
            ),
            "&",
        )

        def join(netloc: Column) -> Column:
            return F.when(
                netloc.contains("[") == netloc.contains("]"),
                F.concat(
                    F.lower(F.regexp_extract(text, _URL, 1)),
                    F.lit("://"),
                    F.regexp_replace(F.lower(netloc), r"^www\.", ""),
                    let(path, lambda p: F.when((p != "") & ~p.startswith("/"), F.concat(F.lit("/"), p)).otherwise(p)),
                    F.when(~text.contains("?"), "").otherwise(
                        let(query, lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
                    ),
                ),
            ).otherwise("")

        return F.when(text.rlike("^(?i)https?:"), let(F.regexp_extract(text, _URL, 2), join)).otherwise("")

    return let(F.regexp_replace(clean_text(c), "^[<>]+|[<>]+$", ""), build)


def extract_url(c: Column) -> Column:
    return normalize_url(F.regexp_extract(clean_text(c), FIND_URL, 0))


def host_of(url: Column) -> Column:
    """Lower-case host name without user, port and trailing dots."""
    netloc = F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://([^/?#]*)", 1)
    return F.regexp_replace(
        F.lower(F.regexp_extract(F.regexp_replace(netloc, "^.*@", ""), r"^(?:\[([^\]]*)\]|([^:]*))", 0)),
        r"\.+$",
        "",
    )


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host_of(url), r"^www\.", "")


def path_segments(url: Column) -> Column:
    path = F.regexp_extract(url, r"^(?i)[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.filter(F.transform(F.split(path, "/"), lambda s: F.trim(s)), lambda s: s != "")


def url_query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def record_host(apply_url: Column, announcement_url: Column) -> Column:
    """Candidate host of a record: of its application link, else of its announcement."""
    return host_of(normalize_url(F.coalesce(F.nullif(apply_url, F.lit("")), announcement_url)))


def is_plausible_id(c: Column, rules: R.IdRules = R.IdRules()) -> Column:
    def test(v: Column) -> Column:
        return (
            v.rlike("^[a-z0-9_-]{2,255}$")
            & ~v.rlike(r"^(?:19|20)[0-9]{2}$")
            & ~v.isin(*rules.generic_tokens)
            & ~v.rlike(any_of(rules.generic_fragments))
        )

    return let(F.lower(clean_text(c)), test)


def _id_in_url(url: Column, rules: R.IdRules) -> Column:
    """The first acceptable id of one URL: path container, explicit key, then a context key."""

    def acceptable(v: Column) -> Column:
        return v.rlike("^[A-Za-z0-9_-]{%d,}$" % rules.min_length) & is_plausible_id(v, rules)

    def scan(norm: Column) -> Column:
        return let(
            F.struct(
                path_segments(norm).alias("s"), query_pairs(url_query(norm)).alias("q")
            ),
            pick,
        )

    def pick(parts: Column) -> Column:
        segments, pairs = parts["s"], parts["q"]
        inside = F.exists(segments, lambda s: F.lower(s).isin(*rules.containers))
        followers = F.filter(
            segments,
            lambda s, i: (i > 0)
            & F.coalesce(F.lower(F.get(segments, i - 1)).isin(*rules.containers), F.lit(False))
            & acceptable(s),
        )

        def keyed(keys: Sequence[str]) -> Column:
            hits = F.filter(pairs, lambda p: F.lower(p["k"]).isin(*keys) & acceptable(p["v"]))
            return F.get(F.transform(hits, lambda p: p["v"]), F.lit(0))

        unsafe = F.exists(segments, lambda s: F.lower(s).isin(*rules.unsafe_segments))
        return F.when(
            ~unsafe,
            F.coalesce(
                F.get(followers, F.lit(0)),
                keyed(rules.query_keys),
                F.when(inside, keyed(rules.context_query_keys)),
            ),
        )

    return let(normalize_url(url), scan)


def extract_record_id(*columns: Column, rules: R.IdRules = R.IdRules()) -> Column:
    """First id found over the inputs in order: labelled text first, then each URL."""

    def from_text(text: Column) -> Column:
        labelled = F.regexp_extract(text, rules.text_pattern, 1)
        urls = F.regexp_extract_all(text, F.lit(FIND_URL), F.lit(0))
        found = F.filter(F.transform(urls, lambda u: _id_in_url(u, rules)), lambda v: v.isNotNull())
        return F.when(is_plausible_id(labelled, rules), labelled).otherwise(F.get(found, F.lit(0)))

    return F.coalesce(*[let(clean_text(c), from_text) for c in columns])


def id_matches_url(
    url: Column, record_id: Column, rules: R.IdRules = R.IdRules(), normalized: bool = False
) -> Column:
    """True if the URL names exactly this id in a posting position; `normalized` skips that step."""

    def test(parts: Column) -> Column:
        segments, pairs, wanted = parts["s"], parts["q"], parts["id"]
        unsafe = F.exists(segments, lambda s: s.isin(*rules.unsafe_segments))
        in_path = F.exists(
            F.filter(
                segments,
                lambda s, i: (i > 0)
                & (s == wanted)
                & F.coalesce(F.get(segments, i - 1).isin(*rules.containers), F.lit(False)),
            ),
            lambda s: F.lit(True),
        )

        def keyed(keys: Sequence[str]) -> Column:
            return F.exists(
                pairs, lambda p: F.lower(p["k"]).isin(*keys) & (F.lower(F.trim(p["v"])) == wanted)
            )

        inside = F.exists(segments, lambda s: s.isin(*rules.containers))
        return ~unsafe & (in_path | keyed(rules.query_keys) | (inside & keyed(rules.context_query_keys)))

    def with_norm(norm: Column) -> Column:
        parts = F.struct(
            F.transform(path_segments(norm), F.lower).alias("s"),
            query_pairs(url_query(norm)).alias("q"),
            F.lower(F.trim(record_id)).alias("id"),
        )
        return F.coalesce(
            (norm != "") & is_plausible_id(record_id, rules) & let(parts, test), F.lit(False)
        )

    return with_norm(url) if normalized else let(normalize_url(url), with_norm)


def is_direct_url(
    url: Column, record_id: Column, rules: R.IdRules = R.IdRules(), normalized: bool = False
) -> Column:
    """True if the URL points at one posting, by id if known, else by its path shape."""

    def shaped(norm: Column) -> Column:
        path = F.lower(F.regexp_extract(norm, r"^[a-z]+://[^/?#]*([^?#]*)", 1))
        pattern = "/(?:%s)/([a-z0-9_-]{%d,})$" % (any_of(rules.containers), rules.min_length)
        return let(
            F.regexp_extract(path, pattern, 1),
            lambda last: (last != "")
            & ~last.rlike("^20[0-9]{2}$")
            & ~last.rlike(any_of(rules.broad_url_markers))
            & ~last.isin(*rules.generic_terminals),
        )

    return F.when(
        F.coalesce(record_id, F.lit("")) != "", id_matches_url(url, record_id, rules, normalized)
    ).otherwise(shaped(url) if normalized else let(normalize_url(url), shaped))


def _under(host: Column, domains: Sequence[str]) -> Column:
    def test(h: Column) -> Column:
        hit = F.lit(False)
        for domain in domains:
            hit = hit | (h == domain) | h.endswith("." + domain)
        return hit

    # The host may cost several patterns, and inside a lambda every use would work it out again.
    return let(host, test)


def is_aggregator(host: Column, rules: R.ScopeRules = R.ScopeRules()) -> Column:
    return _under(host, rules.aggregators)


def scope_host(c: Column) -> Column:
    """The host that official_scope() judges."""
    return bare_host(_with_scheme(c))


def _with_scheme(c: Column) -> Column:
    return let(F.trim(c), lambda text: F.when(text.contains("://"), text).otherwise(F.concat(F.lit("https://"), text)))


def official_scope(c: Column, rules: R.ScopeRules = R.ScopeRules(), registrable: Column | None = None) -> Column:
    """Trust anchor of a host or URL: struct<domain, scope_path, error>, error null when usable.

    A registrable host needs at least one label in front of its public suffix. `registrable` says
    so where a table of suffixes was joined (mark_registrable); else the suffixes of the rules
    are all there are.
    """

    def build(url: Column) -> Column:
        return let(
            F.struct(bare_host(url).alias("h"), path_segments(url).alias("s")),
            lambda parts: judge(parts["h"], parts["s"]),
        )

    def judge(host: Column, segments: Column) -> Column:
        if registrable is None:
            suffixed = F.lit(False)
            for suffix in rules.public_suffixes:
                suffixed = suffixed | host.endswith("." + suffix)
            suffixed = suffixed & ~host.isin(*rules.public_suffixes)
        else:
            suffixed = F.coalesce(registrable, F.lit(False))
        error = (
            F.when(~host.rlike("^[a-z0-9.-]+$") | (F.length(host) > 253), "bad_host")
            .when(host.rlike(r"^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+$"), "ip_address")
            .when(~suffixed, "public_suffix")
            .when(is_aggregator(host, rules), "aggregator")
            .when(
                host.isin(*rules.shared_parents) | host.rlike(rules.infrastructure_pattern),
                "shared_parent",
            )
            .when(host.isin(*rules.shared_hosts) & (F.size(segments) == 0), "tenant_path_required")
        )
        path = F.when(
            host.isin(*rules.shared_hosts) & (F.size(segments) > 0),
            F.concat(F.lit("/"), F.lower(F.get(segments, F.lit(0)))),
        ).otherwise("")
        return let(
            error,
            lambda e: F.struct(
                F.when(e.isNull(), host).alias("domain"),
                F.when(e.isNull(), path).alias("scope_path"),
                e.alias("error"),
            ),
        )

    return let(_with_scheme(c), build)


def mark_registrable(df: DataFrame, host: Column, suffixes: DataFrame, name: str) -> DataFrame:
    """`df` with a boolean column: does the host have a label in front of its public suffix?

    suffixes: rules of a public suffix list in the column `suffix`, one to a line: plain suffixes, wildcards
    (*.ck) and exceptions (!www.ck). An exception beats all, then the longest rule; a host that no
    rule covers has its last label for a suffix. Hosts meet the rules through the tails of their
    labels, one row for each label of a different host.
    """
    hosts = df.select(host.alias("_host")).filter("_host IS NOT NULL").distinct()
    labels = F.split("_host", r"\.")
    size = F.size(labels)

    def tail(k: Column) -> Column:
        return F.array_join(F.slice(labels, size - k + 1, k), ".")

    wild = lambda k: F.concat(F.lit("*."), tail(k - 1))
    offered = F.flatten(
        F.transform(
            F.sequence(F.lit(1), size),
            lambda k: F.array(
                F.struct(tail(k).alias("suffix"), k.alias("n"), F.lit(0).alias("exception")),
                F.struct(F.when(k > 1, wild(k)).alias("suffix"), k.alias("n"), F.lit(0).alias("exception")),
                F.struct(F.concat(F.lit("!"), tail(k)).alias("suffix"), (k - 1).alias("n"), F.lit(1).alias("exception")),
            ),
        )
    )
    rules = suffixes.select(F.lower(F.trim("suffix")).alias("suffix")).distinct()
    found = (
        hosts.select("_host", F.explode(offered).alias("o")).select("_host", "o.*").join(rules, "suffix")
        .groupBy("_host").agg(F.max(F.struct("exception", "n")).alias("_rule"))
    )
    judged = hosts.join(found, "_host", "left").select("_host", (size > F.coalesce("_rule.n", F.lit(1))).alias(name))
    return fact_join(df.withColumn("_host", host), judged, ["_host"]).drop("_host")


def scope_matches(
    url: Column, domain: Column, scope_path: Column, rules: R.ScopeRules = R.ScopeRules()
) -> Column:
    """True if the URL lies under the trusted domain and, on shared hosts, under its tenant path."""

    def test(parts: Column) -> Column:
        host, path, trusted = parts["h"], parts["p"], F.lower(domain)
        tenant = F.regexp_replace(F.lower(F.coalesce(scope_path, F.lit(""))), "/+$", "")
        in_host = (trusted != "") & ((host == trusted) | host.endswith(F.concat(F.lit("."), trusted)))
        in_path = (tenant != "") & (
            (path == tenant) | path.startswith(F.concat(tenant, F.lit("/")))
        )
        return in_host & (~trusted.isin(*rules.shared_hosts) | in_path)

    parts = F.struct(
        bare_host(url).alias("h"),
        F.concat(F.lit("/"), F.array_join(F.transform(path_segments(url), F.lower), "/")).alias("p"),
    )
    return F.coalesce(let(parts, test), F.lit(False))
