"""Facts of each page, computed on the page's own element array.

Everything here is an array expression on one row per page, so no job shuffles elements. Links
are the exception: they are exploded, canonicalised column by column, and folded back with one
partially aggregated ``groupBy`` per page.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadweave import fixed_values as fv
from leadweave.functions import text as tx
from leadweave.functions.expr import barrier, blank_to_null, is_true, suffix_lookup
from leadweave.functions.phones import normalize_phone, phone_from_tel, phones_in_text
from leadweave.functions.urls import (
    same_site, site_host, url_host, with_joined, with_link_kind, with_normalized, with_social, with_unwrapped,
)
from leadweave.operators.skew import hot_safe_lookup

E = "elements"
#: Names of a place catalog that are broadcast at most.
INDEX_BYTES = 16 << 20


def of_tag(*tags: str) -> Column:
    return F.filter(E, lambda e: e["tag"].isin(*tags))


def attr(element: Column, name: str) -> Column:
    return F.trim(F.coalesce(element["attrs"][name], F.lit("")))


def is_inside(element: Column, top: Column) -> Column:
    """Is ``element`` the element ``top`` or under it?"""
    return element["node"].between(top["node"], top["last"])


def subtree(top: Column, elements: Column | str = E) -> Column:
    """An element and everything under it; a slice of the page's array, a filter of any other."""
    if elements is E:
        return F.slice(E, top["node"] + 1, top["last"] - top["node"] + 1)
    return F.filter(elements, lambda e: is_inside(e, top))


def subtree_text(top: Column, elements: Column | str = E, separator: str = " ") -> Column:
    """Text under an element, white space collapsed ('' when there is none)."""
    inner = F.filter(subtree(top, elements), lambda t: t["tag"] == "#text")
    joined = F.array_join(F.transform(inner, lambda t: t["text"]), separator)
    return F.coalesce(F.trim(F.regexp_replace(joined, r"(?U)\s+", " ")), F.lit(""))


def spans(elements: Column) -> Column:
    return F.transform(elements, lambda e: F.struct(e["node"].alias("node"), e["last"].alias("last")))


def in_any(element: Column, tops: Column) -> Column:
    return F.exists(tops, lambda top: is_inside(element, top))


def first(array: Column) -> Column:
    return F.get(array, F.lit(0))


# ------------------------------------------------------------------ X2: visible text
def with_visible_text(pages: DataFrame) -> DataFrame:
    """Adds ``lines`` (one per block, spaces collapsed) and ``visible_text``."""
    skipped = spans(of_tag(*fv.SKIP_TAGS, "title"))
    pages = barrier(pages.withColumn("_skip", skipped), "_skip")
    pages = pages.withColumn(
        "_texts",
        F.transform(
            F.filter(E, lambda e: (e["tag"] == "#text") & ~in_any(e, F.col("_skip"))),
            lambda e: F.struct(e["text"].alias("text"), e["line"].alias("line")),
        ),
    )
    pieces = F.transform(
        "_texts",
        lambda t, i: F.concat(
            F.when((i > 0) & (F.get(F.col("_texts"), i - 1)["line"] != t["line"]), "\n").otherwise(""), t["text"]
        ),
    )
    raw_lines = F.split(F.array_join(pieces, ""), "\n")
    lines = F.filter(
        F.transform(raw_lines, lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), lambda s: s != ""
    )
    pages = pages.withColumn("lines", lines).drop("_skip", "_texts")
    return pages.withColumn("visible_text", F.array_join("lines", "\n"))


# ------------------------------------------------------------------ X3, X4, X10, A13, A14: head and counts
def with_head_facts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Title, meta values (first per name), language, favicon, canonical address, Open Graph map."""
    metas = F.filter(
        F.transform(
            of_tag("meta"),
            lambda m: F.struct(
                F.lower(F.coalesce(blank_to_null(attr(m, "name")), attr(m, "property"))).alias("key"),
                attr(m, "content").alias("content"),
            ),
        ),
        lambda m: (m["key"] != "") & (m["content"] != ""),
    )
    rels = F.flatten(F.transform(
        F.filter(of_tag("link"), lambda e: e["attrs"]["rel"].isNotNull() & e["attrs"]["href"].isNotNull()),
        lambda e: F.transform(
            F.split(F.lower(attr(e, "rel")), r"\s+"),
            lambda r: F.struct(r.alias("rel"), e["attrs"]["href"].alias("href")),
        ),
    ))
    pages = pages.withColumns({"_metas": metas, "_rels": rels})

    def meta(name: str) -> Column:
        return first(F.filter("_metas", lambda m: m["key"] == name))["content"]

    def rel(name: str) -> Column:
        return blank_to_null(first(F.filter("_rels", lambda r: r["rel"] == name))["href"])

    og_keys = F.array_distinct(F.transform(F.filter("_metas", lambda m: m["key"].startswith("og:")), lambda m: m["key"]))
    pages = pages.withColumns({
        "title": blank_to_null(subtree_text(first(of_tag("title")))),
        "meta_description": meta("description"),
        "viewport": meta("viewport"),
        "generator": meta("generator"),
        "lang": blank_to_null(F.coalesce(first(of_tag("html"))["attrs"]["lang"], F.lit(""))),
        "open_graph": F.map_from_entries(F.transform(
            og_keys, lambda k: F.struct(k, first(F.filter("_metas", lambda m: m["key"] == k))["content"])
        )),
        "_icon": F.coalesce(rel("icon"), rel("shortcut"), rel("apple-touch-icon")),
        "_canonical": rel("canonical"),
    })
    pages = with_normalized(pages, "_icon", "favicon", base=url)
    pages = with_normalized(pages, "_canonical", "canonical", base=url)
    return pages.drop("_metas", "_rels", "_icon", "_canonical")


def _at_most(values: Column, limit: int | None) -> Column:
    return values if limit is None else F.slice(values, 1, limit)


def with_structure_facts(pages: DataFrame, max_h2: int | None = None, max_menu: int | None = None) -> DataFrame:
    """Headings, menu labels, forms, images, missing alternative texts and map embeds; the limits cut only where a caller names them."""
    def headings(tag: str) -> Column:
        return F.filter(F.transform(of_tag(tag), lambda e: subtree_text(e)), lambda t: t != "")

    root = F.coalesce(first(of_tag("nav")), first(of_tag("header")))
    pages = barrier(pages.withColumn("_menu", root), "_menu")
    labels = F.transform(
        F.filter(F.coalesce(subtree(F.col("_menu")), F.slice(E, 1, 0)), lambda e: e["tag"] == "a"), lambda e: subtree_text(e))
    return pages.withColumns({
        "h1": headings("h1"),
        "h2": _at_most(headings("h2"), max_h2),
        "menu_items": _at_most(F.array_distinct(F.filter(labels, lambda t: t != "")), max_menu),
        "forms": F.size(of_tag("form")),
        "images": F.size(of_tag("img")),
        "images_without_alt": F.size(F.filter(of_tag("img"), lambda e: attr(e, "alt") == "")),
        "has_map_embed": F.exists(of_tag("iframe"), lambda e: attr(e, "src").rlike(fv.MAP_EMBED_PATTERN)),
    }).drop("_menu")


# ------------------------------------------------------------------ X5: structured data
def json_objects(text: str | None) -> list[dict]:
    """Objects of a JSON-LD text that have a type, in document order: members of arrays and of ``@graph`` at any depth. A text that is no JSON has none."""
    try:
        opened = [iter([json.loads(text or "")])]
    except (ValueError, RecursionError):
        return []
    found = []
    while opened:  # the members being walked, outermost first
        value = next(opened[-1], opened)
        if value is opened:
            opened.pop()
        elif isinstance(value, list):
            opened.append(iter(value))
        elif isinstance(value, dict):
            if "@type" in value:
                kinds = value["@type"] if isinstance(value["@type"], list) else [value["@type"]]
                found.append({"types": [str(k) for k in kinds if k], "body": json.dumps(value, ensure_ascii=False)})
            if "@graph" in value:
                opened.append(iter([value["@graph"]]))
    return found


_TYPED = pa.list_(pa.struct([("types", pa.list_(pa.string())), ("body", pa.string())]))


@F.arrow_udf(T.ArrayType(T.StructType([T.StructField("types", T.ArrayType(T.StringType())), T.StructField("body", T.StringType())])))
def typed_objects(texts: pa.Array) -> pa.Array:
    return pa.array([[o for text in page or [] for o in json_objects(text)] for page in texts.to_pylist()], _TYPED)


def with_structured_data(pages: DataFrame) -> DataFrame:
    """Distinct JSON-LD types and the first business-like object (as JSON text).

    Arrays and ``@graph`` members are followed to any depth, in document order. A tree of unknown depth is the
    one thing here that array functions cannot walk, so the script texts (nothing else of the page) go
    through an Arrow function.
    """
    scripts = F.filter(of_tag("script"), lambda e: F.lower(attr(e, "type")) == "application/ld+json")
    pages = pages.withColumn("_typed", typed_objects(F.transform(scripts, lambda e: e["text"])))
    is_business = lambda t: t.isin(fv.LOCAL_BUSINESS_TYPES) | t.endswith("Business")
    return pages.withColumns({
        "json_ld_types": F.array_distinct(F.flatten(F.transform("_typed", lambda o: o["types"]))),
        "local_business": first(F.filter("_typed", lambda o: F.exists(o["types"], is_business)))["body"],
    }).drop("_typed")


# ------------------------------------------------------------------ X11: site builders (raw HTML)
def with_builders(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``builders array<struct<name,evidence>>`` from the host and from marks in the HTML."""
    host = url_host(url)
    pages = pages.withColumn("_low", F.lower(F.coalesce(F.col(html), F.lit("")))).withColumns({
        "_host": host, "_host_name": suffix_lookup(host, fv.BUILDER_HOSTS),
    })
    low = F.col("_low")

    def hint(name: Column, evidence: Column) -> Column:
        return F.struct(name.alias("name"), evidence.alias("evidence"))

    marks = F.array(*[hint(F.lit(name), F.regexp_extract(low, pattern, 0)) for name, pattern in fv.BUILDER_PATTERNS.items()])
    marks = F.filter(marks, lambda h: (h["evidence"] != "") & ~is_true(h["name"] == F.col("_host_name")))
    by_host = F.filter(F.array(hint(F.col("_host_name"), F.col("_host"))), lambda h: h["name"].isNotNull())
    theme = F.filter(
        F.array(hint(
            F.concat(F.lit("Tema WordPress: "), F.regexp_extract(low, fv.THEME_PATTERN, 1)),
            F.regexp_extract(low, fv.THEME_PATTERN, 0),
        )),
        lambda h: h["evidence"] != "",
    )
    return pages.withColumn("builders", F.concat(by_host, marks, theme)).drop("_low", "_host", "_host_name")


# ------------------------------------------------------------------ X12, F20, X8: text facts
def with_text_facts(pages: DataFrame, max_snippets: int | None = None) -> DataFrame:
    """Trust signals (all snippets of each kind, or the first ``max_snippets``) and copyright years of the visible text."""
    signals = [
        F.transform(
            _at_most(F.filter("lines", lambda s: s.rlike(pattern)), max_snippets),
            lambda s: F.struct(F.lit(kind).alias("kind"), tx.snippet(s, pattern).alias("snippet")),
        )
        for kind, pattern in fv.TRUST_PATTERNS.items()
    ]
    return pages.withColumns({
        "trust_signals": F.concat(*signals),
        "copyright_years": tx.copyright_years("visible_text"),
    })


def with_contact_facts(pages: DataFrame, region: Column | str = "CL") -> DataFrame:
    """``tel_links``, ``emails`` (mail links, then text) and ``phones`` (phone links, then text)."""
    hrefs = F.transform(F.filter(of_tag("a"), lambda e: e["attrs"]["href"].isNotNull()), lambda e: attr(e, "href"))
    mail = F.transform(
        F.filter(hrefs, lambda h: h.rlike("(?i)^mailto:")),
        lambda h: F.lower(F.trim(F.regexp_extract(F.substring(h, F.lit(8), F.length(h)), r"^([^?]*)", 1))),
    )
    written = F.transform(F.regexp_extract_all("visible_text", F.lit(fv.EMAIL_PATTERN), F.lit(0)), lambda m: F.lower(m))
    pages = pages.withColumn("tel_links", F.filter(hrefs, lambda h: h.rlike("(?i)^(?:tel|callto):")))
    linked = F.filter(F.transform("tel_links", lambda h: phone_from_tel(h, region)), lambda p: p.isNotNull())
    return pages.withColumns({
        "emails": F.array_distinct(F.filter(F.concat(mail, written), lambda m: m != "")),
        "phones": F.array_distinct(F.concat(linked, phones_in_text("visible_text", region))),
    })


# ------------------------------------------------------------------ X6: hrefs, one row per link
def page_links(pages: DataFrame, url: str = "url", key: str = "page_id", anchors: bool = False) -> DataFrame:
    """Links of each page in order: ``href`` as found, ``link`` unwrapped and absolute, its kind and profile.

    ``anchors`` keeps links inside the page, which ``link_facts`` reads as links to the page itself.
    """
    links = pages.select(
        key, F.col(url).alias("page_url"),
        F.posexplode(F.transform(
            F.filter(of_tag("a", "area"), lambda e: e["attrs"]["href"].isNotNull()),
            lambda e: F.struct(e["tag"].alias("tag"), attr(e, "href").alias("href")),
        )).alias("position", "_link"),
    ).select(key, "page_url", "position", "_link.*")
    links = links.filter((F.col("href") != "") & (F.lit(anchors) | ~F.col("href").startswith("#")) & ~F.col("href").startswith("javascript:"))
    links = with_unwrapped(links, "href", "target")
    links = with_joined(links, "page_url", "target", "link")
    links = with_normalized(links, "target", "absolute", base="page_url")
    links = with_link_kind(links, "link", "kind")
    return with_social(links, "link", "social")


def link_facts(links: DataFrame, key: str = "page_id", max_internal: int | None = None) -> DataFrame:
    """Per page: distinct hrefs, map links, same-site links (all, or the first ``max_internal``) and profiles per network.

    A link inside the page resolves to the page itself; it counts as an internal link, not as an href.
    """
    entry = F.struct("position", "tag", "href", "link", "absolute", "kind", "social_network", "social_profile")
    folded = links.groupBy(key, "page_url").agg(F.array_sort(F.collect_list(entry)).alias("_links"))
    host = site_host("page_url")
    on_page = F.filter(
        "_links",
        lambda x: (x["tag"] == "a") & x["absolute"].isNotNull() & ~x["href"].rlike("(?i)^(?:tel|callto|mailto):"),
    )
    folded = folded.withColumn("_abs", on_page)
    profiles = F.array_distinct(F.transform(
        F.filter("_abs", lambda x: x["social_profile"].isNotNull()),
        lambda x: F.struct(x["social_network"].alias("network"), x["social_profile"].alias("profile")),
    ))
    internal = F.filter("_abs", lambda x: (x["kind"] != fv.KIND_MAPS) & (host != "") & same_site(x["absolute"], host))
    return folded.select(
        key,
        F.array_distinct(F.transform(F.filter("_links", lambda x: ~x["href"].startswith("#")), lambda x: x["link"])).alias("hrefs"),
        F.array_distinct(F.transform(F.filter("_abs", lambda x: x["kind"] == fv.KIND_MAPS), lambda x: x["absolute"])).alias("maps_links"),
        _at_most(F.array_distinct(F.transform(internal, lambda x: x["absolute"])), max_internal).alias("internal_links"),
        profiles.alias("socials"),
    )


def image_urls(pages: DataFrame, url: str = "url", key: str = "page_id") -> DataFrame:
    """Absolute image addresses of each page, distinct, in order."""
    images = pages.select(
        key, F.col(url).alias("page_url"),
        F.posexplode(F.transform(
            of_tag("img"), lambda e: F.coalesce(blank_to_null(attr(e, "src")), attr(e, "data-src"))
        )).alias("position", "src"),
    ).filter((F.col("src") != "") & ~F.col("src").startswith("data:"))
    images = with_normalized(images, "src", "image", base="page_url").filter(F.col("image").isNotNull())
    return images.groupBy(key).agg(
        F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("position", "image"))), lambda x: x["image"])).alias("images")
    )


def merge_page_lists(pages: DataFrame, *columns: str, site: str = "site_id", order: str = "page_order") -> DataFrame:
    """Distinct list entries over the pages of each site, page order kept.

    Entries are made distinct per site before they are gathered, so a site with very many pages
    gathers each entry once.
    """
    out = None
    for column in columns:
        entries = pages.select(site, order, F.posexplode(column).alias("_at", "_v"))
        once = entries.groupBy(site, "_v").agg(F.min(F.struct(F.col(order).alias("o"), "_at")).alias("_first"))
        merged = once.groupBy(site).agg(F.array_sort(F.collect_list(F.struct("_first", "_v"))).alias("_l")).select(
            site, F.transform("_l", lambda x: x["_v"]).alias(column))
        out = merged if out is None else out.join(merged, site, "full_outer")
    return out


# ------------------------------------------------------------------ X13, J11: places mentioned
def place_mentions(pages: DataFrame, catalog: DataFrame, key: str = "page_id") -> DataFrame:
    """Catalog places named in each page's lines, in order of appearance.

    The catalog is indexed by the first word of each name: a distinct word of a line opens only the
    names that begin with it, so cost grows with the text and not with text times catalog, and no
    n-gram is formed. The index is broadcast up to ``INDEX_BYTES`` of names; a larger one is joined by
    word, frequent words where they are. The exact rule (word boundaries, capitals and context of
    ambiguous names) is checked on the few hits. ``catalog`` is ``place_catalog()`` output.
    """
    lines = pages.select(key, F.posexplode("lines").alias("line_no", "_line")).select(
        key, "line_no", tx.fold_accents("_line").alias("line")
    )
    lines = lines.withColumn("_words", F.regexp_extract_all(F.lower("line"), F.lit(r"(?U)\w+"), F.lit(0)))
    names = catalog.select("name", "folded", "ambiguous", F.regexp_extract_all(F.lower("folded"), F.lit(r"(?U)\w+"), F.lit(0)).alias("_name")).filter(F.size("_name") > 0)
    names = names.select(F.get("_name", F.lit(0)).alias("word"), F.struct(
        "name", "folded", "ambiguous", F.concat(F.lit(" "), F.array_join("_name", " "), F.lit(" ")).alias("spaced")).alias("place"))
    index = names.groupBy("word").agg(F.collect_list("place").alias("_opens"))
    # One row for each distinct word of a line; the line's words, spaced, tell whether the rest of a name follows.
    words = lines.select(key, "line_no", "line", F.concat(F.lit(" "), F.array_join("_words", " "), F.lit(" ")).alias("_spaced"), F.explode(F.array_distinct("_words")).alias("word"))
    size = catalog.agg(F.coalesce(F.sum(F.octet_length("name") + F.octet_length("folded")), F.lit(0))).first()[0]
    opened = words.join(F.broadcast(index), "word") if size <= INDEX_BYTES else hot_safe_lookup(words, index, ["word"], "inner")
    begun = opened.select(key, "line_no", "line", F.explode(F.filter("_opens", lambda p: F.col("_spaced").contains(p["spaced"]))).alias("_place"))
    hits = begun.select(key, "line_no", "line", "_place.name", "_place.folded", "_place.ambiguous")
    quoted = F.concat(F.lit(r"\Q"), F.col("folded"), F.lit(r"\E"))
    upper = F.concat(F.lit(r"\Q"), F.upper("folded"), F.lit(r"\E"))
    pattern = F.when(
        F.col("ambiguous"), F.concat(F.lit(r"(?U)(?<!\w)(?:"), quoted, F.lit("|"), upper, F.lit(r")(?!\w)"))
    ).otherwise(F.concat(F.lit(r"(?iU)(?<!\w)"), quoted, F.lit(r"(?!\w)")))
    hits = hits.withColumn("at", F.regexp_instr("line", pattern)).filter(F.col("at") > 0)
    folded = hits.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(
            "line_no", "at", "name", "ambiguous", F.col("line").rlike(fv.PLACE_CUE_PATTERN).alias("cue")
        ))).alias("_hits")
    )
    folded = barrier(folded.withColumn(
        "_clear", F.array_distinct(F.transform(F.filter("_hits", lambda h: ~h["ambiguous"] | h["cue"]), lambda h: h["line_no"]))
    ), "_clear")
    kept = F.filter("_hits", lambda h: ~h["ambiguous"] | F.array_contains(F.col("_clear"), h["line_no"]))
    return folded.select(key, F.array_distinct(F.transform(kept, lambda h: h["name"])).alias("places")).filter(F.size("places") > 0)


# ------------------------------------------------------------------ all together
def page_facts(parsed: DataFrame, region: Column | str = "CL", url: str = "url", key: str = "page_id") -> DataFrame:
    """The wide fact row of each parsed page (``parse_pages`` output, ``builders`` included if present)."""
    facts = with_visible_text(parsed)
    facts = with_head_facts(facts, url)
    facts = with_structure_facts(facts)
    facts = with_structured_data(facts)
    facts = with_text_facts(facts)
    facts = with_contact_facts(facts, region)
    return facts.drop(E)
