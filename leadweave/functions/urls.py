"""URL canonicalisation: column functions for the parts, frame functions for the chains.

Spark's ``parse_url`` returns NULL on many URLs found in the wild (pipes, underscores in the
host, spaces), so splitting is one RFC 3986 regular expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import (
    ColumnLike, any_of, as_col, barrier, blank_to_null, drop_prefixed, exact_lookup, suffix_lookup, text_or_empty,
)
from leadweave.functions.phones import number_key

_URL = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_HOST = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(\[[^\]]*\]|[^/?#:]*)"
_PORT = r"(?s)^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?(?:\[[^\]]*\]|[^/?#:]*):([^/?#]*)"
_HAS_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"
_BARE_HOST = r"(?U)^[\w-]+(\.[\w-]+)+(/|$)"
_WRAPPER = (
    r"(?i)^\s*(?:[a-z][a-z0-9+.-]*:)?(?://(?:[^/?#]*@)?(?:[^/?#:@]*\.)?google\.[a-z]{2,3}(?:\.[a-z]{2})?(?::\d*)?)?/url\?"
)
PRINTS_TYPE = "array<struct<kind:string,value:string>>"


# ------------------------------------------------------------------ percent coding
def decode_plus(value: Column) -> Column:
    """Percent-decode a query value ('+' is a space); broken escapes stay as written."""
    return F.url_decode(F.regexp_replace(value, "%(?![0-9A-Fa-f]{2})", "%25"))


def unquote(value: Column) -> Column:
    """Percent-decode leaving '+' alone."""
    return F.when(value.contains("%"), decode_plus(F.replace(value, F.lit("+"), F.lit("%2B")))).otherwise(value)


def quote_plus(value: Column) -> Column:
    return F.replace(F.replace(F.url_encode(value), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


# ------------------------------------------------------------------ parts
def url_scheme(url: ColumnLike) -> Column:
    return F.lower(F.regexp_extract(text_or_empty(url), _URL, 1))


def url_host(url: ColumnLike) -> Column:
    """Lower-case host of an absolute URL, '' when there is none."""
    return F.lower(F.regexp_extract(text_or_empty(url), _HOST, 1))


def url_path(url: ColumnLike) -> Column:
    return F.regexp_extract(text_or_empty(url), _URL, 3)


def url_query(url: ColumnLike) -> Column:
    return F.regexp_extract(text_or_empty(url), _URL, 4)


def strip_www(host: Column) -> Column:
    return F.regexp_replace(host, r"^www\.", "")


def site_host(url: ColumnLike) -> Column:
    return strip_www(url_host(url))


def path_segments(path: Column) -> Column:
    return F.filter(F.split(path, "/"), lambda s: s != "")


def is_search_host(host: Column) -> Column:
    return host.rlike(fv.SEARCH_HOST_PATTERN)


def query_pairs(query: Column, keep_blank: bool) -> Column:
    """Decoded key/value pairs in the order written."""
    parts = F.filter(F.split(query, "&"), lambda s: (s != "") if keep_blank else s.rlike("^[^=]*=."))
    return F.transform(
        parts,
        lambda s: F.struct(
            decode_plus(F.regexp_extract(s, r"(?s)^([^=]*)", 1)).alias("key"),
            decode_plus(F.regexp_extract(s, r"(?s)^[^=]*=(.*)$", 1)).alias("value"),
        ),
    )


def encode_pairs(pairs: Column) -> Column:
    """Query text of ``pairs``, values of a repeated key brought together at its first place."""
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    grouped = F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["key"] == k)))
    return F.array_join(
        F.transform(grouped, lambda p: F.concat(quote_plus(p["key"]), F.lit("="), quote_plus(p["value"]))), "&"
    )


# ------------------------------------------------------------------ F1: redirect wrappers
def _unwrap_once(u: Column) -> Column:
    def parameter(name: str) -> Column:
        return blank_to_null(F.regexp_extract(u, rf"(?s)\?(?:[^#]*?&)?{name}=([^&#]+)", 1))

    target = decode_plus(F.coalesce(parameter("q"), parameter("url")))
    return F.when(u.rlike(_WRAPPER), F.coalesce(target, u)).otherwise(u)


def with_unwrapped(df: DataFrame, url: str, out: str, levels: int = 3) -> DataFrame:
    """Target of a search-engine ``/url?q=`` wrapper, followed up to ``levels`` levels (three by the product's rule)."""
    df = df.withColumn(out, F.trim(text_or_empty(url)))
    for _ in range(levels):
        df = df.withColumn(out, _unwrap_once(F.col(out)))
    return barrier(df, out)


# ------------------------------------------------------------------ joining relative links
def _without_dot_segments(path: Column) -> Column:
    parts = F.split(path, "/")
    last = F.regexp_extract(path, r"([^/]*)$", 1)
    kept = F.aggregate(
        F.slice(parts, F.lit(2), F.size(parts)),
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.array_append(acc, s)),
        lambda acc: F.array_join(acc, "/"),
    )
    slash = F.when(last.isin(".", "..") & ~kept.isin(""), "/").otherwise("")
    return F.when(path.contains("/."), F.concat(F.lit("/"), kept, slash)).otherwise(path)


def with_joined(df: DataFrame, base: str, url: str, out: str) -> DataFrame:
    """Absolute form of ``url`` seen on page ``base`` (RFC 3986 reference resolution)."""
    b, u, t = F.col(base), F.col(url), "_join_" + out + "_"
    df = df.withColumns({
        t + "scheme": url_scheme(b),
        t + "origin": F.concat(url_scheme(b), F.lit("://"), F.regexp_extract(text_or_empty(b), _URL, 2)),
        t + "path": url_path(b),
        t + "query": F.regexp_extract(text_or_empty(b), r"(?s)^[^?#]*(\?[^#]+)?", 1),
        t + "own": F.regexp_extract(u, r"(?s)^([^?#]*)", 1),
        t + "rest": F.regexp_extract(u, r"(?s)^[^?#]*(.*)$", 1),
    })
    origin, path, query, own, rest = (F.col(t + x) for x in ("origin", "path", "query", "own", "rest"))
    folder = F.regexp_extract(F.when(path == "", "/").otherwise(path), r"(?s)^(.*/)", 1)
    df = df.withColumn(t + "full", F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)))
    joined = (
        F.when(b.isNull() | (b == ""), u)
        .when(u == "", F.concat(origin, path, query))
        .when(u.rlike(_HAS_SCHEME), u)
        .when(u.startswith("//"), F.concat(F.col(t + "scheme"), F.lit(":"), u))
        .when(u.startswith("?"), F.concat(origin, path, u))
        .when(u.startswith("#"), F.concat(origin, path, query, u))
        .otherwise(F.concat(origin, _without_dot_segments(F.col(t + "full")), rest))
    )
    return barrier(drop_prefixed(df.withColumn(out, joined), t), out)


# ------------------------------------------------------------------ F2: normal form
def with_normalized(df: DataFrame, url: str, out: str, base: str | None = None) -> DataFrame:
    """Absolute http(s) URL without fragment, default port or tracking parameters; NULL if it is none."""
    t = "_norm_" + out + "_"
    df = df.withColumn(t + "u", F.trim(text_or_empty(url)))
    if base is not None:
        df = with_joined(df, base, t + "u", t + "j").withColumn(
            t + "u", F.when(F.col(t + "u") != "", F.col(t + "j")).otherwise("")
        )
    u = F.col(t + "u")
    df = df.withColumn(
        t + "a",
        F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.rlike(_HAS_SCHEME), u)
        .when(u.rlike(_BARE_HOST), F.concat(F.lit("https://"), u)),
    )
    a = F.col(t + "a")
    df = df.withColumns({
        t + "scheme": url_scheme(a), t + "host": url_host(a), t + "port": F.regexp_extract(text_or_empty(a), _PORT, 1),
        t + "path": url_path(a), t + "query": url_query(a),
    })
    scheme, host, port, path, query = (F.col(t + x) for x in ("scheme", "host", "port", "path", "query"))
    df = df.withColumn(
        t + "pairs",
        F.when(query != "", F.filter(query_pairs(query, keep_blank=True), lambda q: ~q["key"].rlike(fv.TRACKING_PARAM_PATTERN))),
    )
    pairs = F.col(t + "pairs")
    df = df.withColumn(
        out,
        F.when(
            scheme.isin("http", "https") & (host != "") & port.rlike(r"^\d*$"),
            F.concat(
                scheme, F.lit("://"), host,
                F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port)),
                F.when(path == "", "/").otherwise(path),
                F.when(F.size(pairs) > 0, F.concat(F.lit("?"), encode_pairs(pairs))).otherwise(""),
            ),
        ),
    )
    return barrier(drop_prefixed(df, t), out)


# ------------------------------------------------------------------ F8: social profiles
def with_social(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds ``<out>_network`` and ``<out>_profile``; both NULL unless the link is a profile page."""
    t = "_soc_" + out + "_"
    u = F.trim(text_or_empty(url))
    df = df.withColumn(
        t + "u",
        F.when(u.startswith("//"), F.concat(F.lit("https:"), u))
        .when(u.rlike("(?i)^https?://"), u)
        .otherwise(F.concat(F.lit("https://"), u)),
    ).withColumn(t + "host", url_host(t + "u"))
    df = df.withColumn(t + "net", suffix_lookup(F.col(t + "host"), fv.SOCIAL_NETWORKS)).withColumn(
        t + "seg", F.when(F.col(t + "net").isNotNull(), path_segments(url_path(t + "u")))
    )
    df = df.withColumns({
        t + "first": F.get(F.col(t + "seg"), F.lit(0)),
        t + "id": F.regexp_extract(url_query(t + "u"), r"(?:^|&)id=(\d+)(?:&|$)", 1),
    })
    network, first, profile_id = F.col(t + "net"), F.col(t + "first"), F.col(t + "id")
    rejected = any_of([
        (network == name) & (first.isin(words) | F.lower(first).isin(words))
        for name, words in fv.SOCIAL_NOT_PROFILE.items()
    ])
    two = F.concat_ws("/", F.slice(F.col(t + "seg"), 1, 2))
    path = F.when(first.isin(fv.SOCIAL_TWO_SEGMENTS), two).otherwise(first)
    path = F.when(network.isin("instagram", "x"), F.lower(path)).otherwise(path)
    own_path = (
        F.when((network == "facebook") & (first == "profile.php"),
               F.when(profile_id != "", F.concat(F.lit("profile.php?id="), profile_id)))
        .when(first.isNull() | rejected | ((network == "tiktok") & ~first.startswith("@")), None)
        .otherwise(path)
    )
    df = df.withColumn(t + "path", own_path)
    profile = F.concat(F.lit("https://"), exact_lookup(network, fv.SOCIAL_CANONICAL_HOST), F.lit("/"), F.col(t + "path"))
    df = df.withColumns({
        out + "_network": F.when(F.col(t + "path").isNotNull(), network),
        out + "_profile": profile,
    })
    return barrier(drop_prefixed(df, t), out + "_network", out + "_profile")


# ------------------------------------------------------------------ F3: kind of link
def with_link_kind(df: DataFrame, url: str, out: str, keep: str | None = None) -> DataFrame:
    """One of the six link kinds, judged from the address alone.

    With ``keep`` the intermediate results stay as ``<keep>target``, ``<keep>normal``,
    ``<keep>host`` and ``<keep>profile`` for callers that need them next.
    """
    t = keep or "_kind_" + out + "_"
    df = with_unwrapped(df, url, t + "target")
    df = with_normalized(df, t + "target", t + "normal")
    df = df.withColumn(t + "host", site_host(t + "normal"))
    df = with_social(df, t + "normal", t + "soc")
    host, normal = F.col(t + "host"), F.col(t + "normal")
    on_maps_path = url_path(normal).startswith("/maps")
    df = df.withColumn(
        out,
        F.when(F.col(t + "target").rlike("(?i)^whatsapp://"), fv.KIND_CONTACT)
        .when(normal.isNull(), fv.KIND_INVALID)
        .when(host.isin(fv.CONTACT_HOSTS), fv.KIND_CONTACT)
        .when(host.isin(fv.AGGREGATOR_HOSTS), fv.KIND_AGGREGATOR)
        .when(F.col(t + "soc_profile").isNotNull(), fv.KIND_SOCIAL)
        .when(host.isin(fv.MAPS_HOSTS) | ((is_search_host(host) | (host == "goo.gl")) & on_maps_path), fv.KIND_MAPS)
        .otherwise(fv.KIND_OWN),
    )
    return barrier(df if keep else drop_prefixed(df, t), out)


# ------------------------------------------------------------------ F4, F5: place pages
def place_key(url: ColumnLike) -> Column:
    """Stable place identifier carried by a map URL: official id, else feature id, else cid."""
    u = text_or_empty(url)
    official = F.regexp_extract(u, fv.PLACE_ID_PATTERN, 1)
    feature = F.lower(F.regexp_extract(u, fv.FEATURE_ID_PATTERN, 1))
    cid = F.regexp_extract(u, fv.CID_PATTERN, 1)
    return (
        F.when(official != "", F.concat(F.lit("place_id:"), official))
        .when(feature != "", F.concat(F.lit("ftid:"), feature))
        .when(cid != "", F.concat(F.lit("cid:"), cid))
    )


def with_canonical_place_url(df: DataFrame, url: str, out: str) -> DataFrame:
    """Place URL without view coordinates or session parameters: one URL per place."""
    t = "_place_" + out + "_"
    df = with_unwrapped(df, url, t + "u")
    df = df.withColumns({t + "host": url_host(t + "u"), t + "path": url_path(t + "u"), t + "query": url_query(t + "u")})
    host, path, query = F.col(t + "host"), F.col(t + "path"), F.col(t + "query")
    df = df.withColumn(
        t + "pairs",
        F.when(query != "", F.filter(query_pairs(query, keep_blank=False), lambda q: q["key"].isin(fv.MAPS_KEPT_PARAMS))),
    )
    pairs = F.col(t + "pairs")
    own_query = F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))
    kept = F.when(F.size(pairs) > 0, F.concat(F.lit("?"), encode_pairs(pairs))).otherwise("")
    without_view = F.regexp_replace(path, fv.MAP_VIEW_PATTERN, "")
    df = df.withColumn(
        out,
        F.when(F.col(url).isNull(), None)
        .when(is_search_host(host), F.concat(F.lit("https://www.google.com"), without_view, kept))
        .when(host == "", F.concat(F.lit("https:"), path, own_query))
        .otherwise(F.concat(F.lit("https://"), host, path, own_query)),
    )
    return barrier(drop_prefixed(df, t), out)


# ------------------------------------------------------------------ F6: site key
def shared_platform_segments(host: Column) -> Column:
    """How many path segments belong to the identity of a site on a shared platform (NULL: own domain)."""
    chain = exact_lookup(host, fv.SHARED_PLATFORM_SEGMENTS)
    for domain, depth in fv.SHARED_SUFFIX_SEGMENTS.items():
        chain = chain.when(host.endswith("." + domain), F.lit(depth))
    return chain


def with_site_key(df: DataFrame, url: str, out: str, normal: str | None = None) -> DataFrame:
    """Join key of a web site: its domain, plus the identifying path on shared platforms."""
    t = "_site_" + out + "_"
    if normal is None:
        df = with_normalized(with_unwrapped(df, url, t + "target"), t + "target", t + "normal")
        normal = t + "normal"
    df = df.withColumn(t + "host", site_host(normal))
    df = df.withColumn(t + "depth", shared_platform_segments(F.col(t + "host")))
    host, depth = F.col(t + "host"), F.col(t + "depth")
    df = df.withColumn(t + "own", F.slice(path_segments(F.lower(url_path(normal))), F.lit(1), F.coalesce(depth, F.lit(0))))
    own = F.col(t + "own")
    df = df.withColumn(
        out,
        F.when(F.col(normal).isNull() | (host == ""), None)
        .when(depth.isNull(), host)
        .when(F.size(own) > 0, F.concat(host, F.lit("/"), F.array_join(own, "/"))),
    )
    return barrier(drop_prefixed(df, t), out)


# ------------------------------------------------------------------ F9: number inside a contact link
def contact_link_digits(url: ColumnLike) -> Column:
    """Digits (8 or more) carried by a contact link."""
    return blank_to_null(F.regexp_extract(text_or_empty(url), fv.LINK_DIGITS_PATTERN, 1))


def shown_link_digits(url: ColumnLike) -> Column:
    """Digits of a direct chat link, any length (the number shown next to a lead)."""
    return blank_to_null(F.regexp_extract(text_or_empty(url), fv.SHOWN_DIGITS_PATTERN, 1))


# ------------------------------------------------------------------ F31 and others
def same_site(url: ColumnLike, host: Column) -> Column:
    return site_host(url) == host


def is_technical_link(url: ColumnLike) -> Column:
    return as_col(url).rlike(fv.TECHNICAL_LINK_PATTERN)


def login_wall_reason(url: ColumnLike) -> Column:
    service = exact_lookup(url_host(url), fv.LOGIN_HOSTS)
    return F.concat(
        F.lit("La web no es pública: pide iniciar sesión en "), service, F.lit(", así que los clientes no pueden verla")
    )


# ------------------------------------------------------------------ D1: fingerprint of a link
def with_link_print(df: DataFrame, url: str, out: str) -> DataFrame:
    """Adds ``<out>_kind`` and ``<out>_value``: what a link says about whose it is (NULL: nothing)."""
    t = "_lp_" + out + "_"
    df = with_link_kind(df, url, t + "kind", keep=t)
    df = with_site_key(df, url, t + "key", normal=t + "normal")
    target, kind = F.col(t + "target"), F.col(t + "kind")
    df = df.withColumns({
        t + "number": number_key(contact_link_digits(target)),
        t + "short": F.lower(F.regexp_extract(
            target, fv.SHORT_LINK_PRINT_PATTERN, 1)),
    })
    number, short = F.col(t + "number"), F.col(t + "short")
    is_contact = kind == fv.KIND_CONTACT
    df = df.withColumn(
        out + "_value",
        F.when(is_contact, F.coalesce(number, blank_to_null(short)))
        .when(kind == fv.KIND_SOCIAL, F.lower(F.col(t + "soc_profile")))
        .when(kind.isin(fv.KIND_OWN, fv.KIND_AGGREGATOR), F.col(t + "key")),
    ).withColumn(
        out + "_kind",
        F.when(F.col(out + "_value").isNull(), None)
        .when(is_contact & number.isNotNull(), fv.PRINT_NUMBER)
        .when(kind == fv.KIND_SOCIAL, fv.PRINT_SOCIAL)
        .otherwise(fv.PRINT_WEB),
    )
    return barrier(drop_prefixed(df, t), out + "_kind", out + "_value")
