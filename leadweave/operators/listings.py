"""Captured listing pages and place panels to cards, places and businesses.

Input is ``parse_pages`` output. One page holds at most a screenful of cards or one place, so
everything is an array expression on the page row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions import text as tx
from leadweave.functions.expr import barrier, blank_to_null, is_true
from leadweave.functions.phones import normalize_phone
from leadweave.functions.urls import place_key, with_canonical_place_url, with_link_kind, with_normalized, with_social, with_unwrapped
from leadweave.operators.page_facts import attr, first, in_any, is_inside, of_tag, spans, subtree, subtree_text

E = "elements"


def _label(e: Column) -> Column:
    return F.coalesce(e["attrs"]["aria-label"], F.lit(""))


def _labelled() -> Column:
    return F.filter(E, lambda e: e["attrs"]["aria-label"].isNotNull())


# ------------------------------------------------------------------ X19, W7: list pages
def listing_cards(pages: DataFrame, region: str = "CL", key: str = "page_id") -> DataFrame:
    """Cards of each list page in order, one per place: name, url, site link and phone of the card.

    A card is the largest block around a place link that holds no other place link.
    """
    is_place = lambda e: (e["tag"] == "a") & attr(e, "href").contains("/maps/place/")
    pages = pages.withColumn("_places", F.filter(E, is_place))
    pages = barrier(pages, "_places")

    def card(link: Column, at: Column) -> Column:
        """The outermost element around a place link and no other: it begins after the link before and ends before the next."""
        before = F.coalesce(F.get("_places", at - 1)["node"], F.lit(-1))
        after = F.coalesce(F.get("_places", at + 1)["node"], F.lit(2**31 - 1))
        root = first(F.filter(E, lambda e: (e["node"] <= link["node"]) & (e["last"] >= link["node"]) & (e["node"] > before) & (e["last"] < after)))
        return F.struct(link.alias("_link"), F.coalesce(subtree(root), F.slice(E, 1, 0)).alias("_card"))

    # Only the card's own elements travel on, not the page's.
    rows = pages.select(key, F.posexplode(F.transform("_places", card)).alias("_at", "_c")).select(key, "_at", "_c._link", "_c._card")
    site_links = F.filter(
        "_card",
        lambda e: (e["tag"] == "a") & (attr(e, "href") != "") & (
            (e["attrs"]["data-value"] == fv.CARD_SITE_VALUE)
            | _label(e).startswith(fv.CARD_SITE_LABELS[0]) | _label(e).startswith(fv.CARD_SITE_LABELS[1])
        ),
    )
    texts = F.flatten(F.transform(F.filter("_card", lambda e: e["tag"] == "#text"), lambda e: F.split(F.trim(e["text"]), "\n")))
    phones = F.filter(
        F.transform(F.filter(texts, lambda t: F.trim(t).rlike(fv.CARD_PHONE_PATTERN)), lambda t: normalize_phone(t, region)),
        lambda p: p.isNotNull(),
    )
    rows = rows.withColumns({
        "url": attr(F.col("_link"), "href"),
        "name": blank_to_null(F.coalesce(blank_to_null(attr(F.col("_link"), "aria-label")), subtree_text(F.col("_link"), "_card", ""))),
        "_site": attr(first(site_links), "href"),
        "phone_e164": first(phones),
    })
    rows = with_normalized(with_unwrapped(rows, "_site", "_target"), "_target", "_normal")
    rows = with_canonical_place_url(rows, "url", "_canonical").filter(F.col("url") != "")
    rows = rows.select(
        key, "_at", "name", "url", F.coalesce(place_key("url"), "_canonical").alias("place"),
        F.coalesce("_normal", blank_to_null(F.col("_site"))).alias("website"), "phone_e164",
    )
    once = rows.groupBy(key, "place").agg(F.min(F.struct("_at", "name", "url", "website", "phone_e164")).alias("c"))
    packed = once.groupBy(key).agg(F.array_sort(F.collect_list("c")).alias("_cards"))
    return packed.select(key, F.posexplode("_cards").alias("_p", "c")).select(
        key, (F.col("_p") + 1).alias("position"), F.col("c.name").alias("name"), F.col("c.url").alias("url"),
        F.lit(True).alias("card_seen"), F.col("c.website").alias("website"), F.col("c.phone_e164").alias("phone_e164"))


def end_of_list() -> Column:
    """Has the list shown its closing line?"""
    texts = F.array_join(F.transform(of_tag("#text"), lambda e: e["text"]), " ")
    return texts.rlike(fv.END_OF_LIST_PATTERN)


# ------------------------------------------------------------------ X21, X22
def hours_map(labels: Column) -> Column:
    """Weekday to opening hours, first label per day, in weekday order."""
    found = F.filter(
        F.transform(labels, lambda s: F.struct(
            tx.fold_accents(F.lower(F.regexp_extract(s, fv.HOURS_LABEL_PATTERN, 1))).alias("day"),
            F.trim(F.regexp_replace(F.regexp_extract(s, fv.HOURS_LABEL_PATTERN, 2), r"(?U)\s+", " ")).alias("hours"),
        )),
        lambda x: x["day"] != "",
    )
    days = F.array(*[F.struct(F.lit(d).alias("name"), tx.fold_accents(F.lit(d)).alias("plain")) for d in fv.WEEKDAYS])
    entries = F.transform(days, lambda d: F.struct(d["name"].alias("day"), first(F.filter(found, lambda x: x["day"] == d["plain"]))["hours"].alias("hours")))
    return F.map_from_entries(F.filter(entries, lambda e: e["hours"].isNotNull()))


def about_sections(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Titled sections of an about tab as ``about array<struct<title,items>>``.

    Items are the list entries of the heading's block; without entries, its text.
    """
    pages = pages.withColumn("_heads", F.filter(
        F.transform(of_tag("h2"), lambda h: F.struct(
            subtree_text(h).alias("title"), F.get(E, h["parent"]).alias("box"))),
        lambda h: (h["title"] != "") & ~h["title"].rlike(fv.NOT_ABOUT_PATTERN) & h["box"].isNotNull(),
    ))

    def items(h: Column) -> Column:
        entries = F.filter(
            F.transform(
                F.filter(subtree(h["box"]), lambda e: e["tag"] == "li"),
                lambda e: F.coalesce(tx.collapse_spaces(e["attrs"]["aria-label"]), subtree_text(e)),
            ),
            lambda s: s != "",
        )
        body = subtree_text(h["box"])
        rest = F.when(body.startswith(h["title"]), F.trim(F.substring(body, F.length(h["title"]) + 1, F.length(body)))).otherwise(body)
        alone = F.when((body != "") & (body != h["title"]), F.array(rest)).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.when(F.size(entries) > 0, entries).otherwise(alone))

    sections = F.filter(
        F.transform("_heads", lambda h: F.struct(h["title"].alias("title"), items(h).alias("items"))), lambda s: F.size(s["items"]) > 0)
    return pages.withColumn("about", sections).drop("_heads")


def description_of(about: Column) -> Column:
    return F.array_join(first(F.filter(about, lambda s: s["title"].rlike(fv.DESCRIPTION_HEADING_PATTERN)))["items"], " ")


def services_of(about: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(
        F.filter(about, lambda s: s["title"].rlike(fv.SERVICE_HEADING_PATTERN)), lambda s: s["items"])))


# ------------------------------------------------------------------ X20: place panels
def places(panels: DataFrame, catalog: DataFrame | None = None, region: str = "CL", url: str = "url", key: str = "page_id",
           header_levels: int | None = None) -> DataFrame:
    """One place per captured panel (panels without a name drop out).

    ``own`` keeps the elements the business itself publishes (reviews and other businesses are
    outside), ready for ``contact_mentions``.
    """
    main = first(F.filter(E, lambda e: (e["tag"] == "div") & (e["attrs"]["role"] == "main")))
    rows = barrier(panels.withColumn("_main", F.coalesce(main, first(of_tag("body")), first(F.col(E)))), "_main")
    rows = barrier(rows.withColumn("_in", F.coalesce(subtree(F.col("_main")), F.slice(E, 1, 0))).drop(E), "_in")
    rows = rows.withColumn("_h1", first(F.filter("_in", lambda e: e["tag"] == "h1")))
    rows = rows.withColumn("name", blank_to_null(subtree_text(F.col("_h1"), "_in"))).filter(F.col("name").isNotNull())
    # Header: the nearest ancestor of the name that shows rating, reviews or category; ``header_levels`` bounds the search.
    is_mark = lambda e: (
        _label(e).contains("estrellas") | _label(e).contains("reseña")
        | ((e["tag"] == "button") & F.coalesce(e["attrs"]["jsaction"], F.lit("")).contains("category"))
    )
    ancestors = F.reverse(spans(F.filter("_in", lambda e: (e["node"] < F.col("_h1.node")) & (e["last"] >= F.col("_h1.node")))))
    rows = barrier(rows.withColumns({
        "_marks": spans(F.filter("_in", is_mark)), "_above": ancestors if header_levels is None else F.slice(ancestors, 1, header_levels),
    }), "_marks", "_above")
    marked = first(F.filter("_above", lambda top: F.exists("_marks", lambda mark: is_inside(mark, top))))
    own = F.struct(F.col("_h1.node").alias("node"), F.col("_h1.last").alias("last"))
    rows = barrier(rows.withColumn("_top", F.coalesce(marked, first(F.col("_above")), own)), "_top")
    rows = rows.withColumn("_head", subtree(F.col("_top"), "_in"))

    def value_of(test) -> Column:
        node = first(F.filter("_in", test))
        shown = F.coalesce(node["attrs"]["aria-label"], subtree_text(node, "_in"))
        return F.when(node.isNotNull(), tx.collapse_spaces(F.regexp_replace(shown, fv.LABEL_PREFIX_PATTERN, "")))

    item = lambda e: F.coalesce(e["attrs"]["data-item-id"], F.lit(""))
    head_labels = F.transform(F.filter("_head", lambda e: e["attrs"]["aria-label"].isNotNull()), _label)
    rated = first(F.filter(head_labels, lambda s: s.rlike(fv.RATING_LABEL_PATTERN)))
    reviewed = first(F.filter(head_labels, lambda s: s.rlike(fv.REVIEWS_LABEL_PATTERN)))
    category = first(F.filter("_head", lambda e: (e["tag"] == "button") & F.coalesce(e["attrs"]["jsaction"], F.lit("")).contains("category")))
    phone_item = item(first(F.filter("_in", lambda e: item(e).startswith("phone:tel:"))))
    own_regions = spans(F.filter("_in", lambda e: (e["attrs"]["role"] == "region") & _label(e).rlike(fv.OWN_REGION_PATTERN)))
    rows = rows.withColumns({
        "rating": tx.rating_from_label(rated), "review_count": tx.reviews_from_label(reviewed),
        "category": F.when(category.isNotNull(), blank_to_null(subtree_text(category, "_head"))),
        "address": value_of(lambda e: item(e) == "address"),
        "phone_raw": value_of(lambda e: item(e).startswith("phone:tel:")),
        "_tel": F.regexp_replace(phone_item, "^phone:tel:", ""),
        "website_raw": blank_to_null(attr(first(F.filter("_in", lambda e: (e["tag"] == "a") & (item(e) == "authority"))), "href")),
        "opening_hours": hours_map(F.transform(F.filter("_in", lambda e: e["attrs"]["aria-label"].isNotNull()), _label)),
        "_regions": own_regions,
    })
    roots = F.when(F.size("_regions") > 0, F.col("_regions")).otherwise(
        spans(F.filter("_in", lambda e: e["attrs"]["data-item-id"].isNotNull())))
    rows = barrier(rows.withColumn("_roots", roots), "_roots")
    rows = rows.withColumns({
        "own": F.filter("_in", lambda e: in_any(e, F.col("_roots"))),
        "city": tx.address_locality("address"),
        "phone_e164": F.coalesce(normalize_phone("_tel", region), normalize_phone("phone_raw", region)),
        "place_key": place_key(url),
    })
    rows = with_canonical_place_url(rows, url, "maps_url")
    rows = with_link_kind(rows, "website_raw", "_kind", keep="_w_")
    rows = rows.withColumns({
        "website_kind": F.when(F.col("website_raw").isNotNull(), F.col("_kind")),
        "website": F.when(F.col("website_raw").isNotNull() & (F.col("_kind") != fv.KIND_CONTACT), F.col("_w_normal")),
    })
    if catalog is None:
        rows = rows.withColumn("commune", F.lit(None).cast("string"))
    else:
        # Locality to catalog place by folded equality.
        known = catalog.groupBy(F.lower("folded").alias("_folded")).agg(F.max("name").alias("commune"))
        rows = rows.withColumn("_folded", F.lower(tx.fold_accents("city"))).join(known, "_folded", "left")
    return rows.select(
        key, url, "maps_url", "place_key", "name", "category", "address", "city", "commune", "phone_raw", "phone_e164",
        "website_raw", "website", "website_kind", "rating", "review_count", "opening_hours", "own",
    )


def panel_links(found: DataFrame, key: str = "page_id") -> DataFrame:
    """Links of the business's own regions, distinct, in order, with profiles; help pages excluded."""
    rows = found.select(key, F.posexplode(F.transform(
        F.filter("own", lambda e: (e["tag"] == "a") & e["attrs"]["href"].isNotNull()), lambda e: attr(e, "href"))).alias("at", "href"))
    rows = with_unwrapped(rows, "href", "link").filter(
        (F.col("link") != "") & ~F.col("link").startswith("#") & ~F.col("link").rlike(fv.HELP_HOST_PATTERN))
    rows = with_social(rows, "link", "social")
    packed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "link", "social_network", "social_profile"))).alias("_l"))

    def profile(network: str) -> Column:
        return first(F.filter("_l", lambda x: is_true(x["social_network"] == network)))["social_profile"]

    return packed.select(
        key, F.array_distinct(F.transform("_l", lambda x: x["link"])).alias("links"),
        profile("instagram").alias("instagram"), profile("facebook").alias("facebook"))


# ------------------------------------------------------------------ P21
def place_to_business(found: DataFrame) -> DataFrame:
    """Business row of a place: what the listed site really is, and ``maps`` as source of every value present."""
    kind = F.col("website_kind")
    site = F.when(kind.isin(fv.KIND_OWN, fv.KIND_AGGREGATOR), F.col("website"))
    status = (
        F.when(kind.isNull(), fv.SITE_NONE).when(kind == fv.KIND_OWN, None)
        .when(kind.isin(fv.KIND_AGGREGATOR, fv.KIND_SOCIAL), fv.SITE_ONLY_SOCIAL).otherwise(fv.SITE_NONE)
    )
    optional = {c: (F.col(c) if c in found.columns else F.lit(None).cast("string")) for c in ("instagram", "facebook", "description", "whatsapp_url")}
    rows = found.withColumns({**optional, "_site": site})
    services = F.col("services") if "services" in found.columns else F.lit(None).cast("array<string>")
    rows = rows.withColumns({
        "services": F.when(F.size(services) > 0, services),
        "opening_hours": F.when(F.size("opening_hours") > 0, F.col("opening_hours")),
    })
    sourced = {
        "business_name": "name", "category": "category", "phone_raw": "phone_raw", "phone_e164": "phone_e164", "whatsapp_url": "whatsapp_url",
        "website": "_site", "instagram": "instagram", "facebook": "facebook", "address": "address", "city": "city", "commune": "commune",
        "opening_hours": "opening_hours", "rating": "rating", "review_count": "review_count", "services": "services", "description": "description",
    }
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(n).alias("key"), F.lit("maps").alias("value"))) for n, c in sourced.items()]
    original = F.when(
        F.col("website_raw").isNotNull() & (kind != fv.KIND_OWN), F.struct(F.lit("website_maps").alias("key"), F.col("website_raw").alias("value")))
    return rows.select(
        F.col("place_key").alias("place_id"), F.col("maps_url").alias("google_maps_url"), F.col("name").alias("business_name"), "category",
        "phone_raw", "phone_e164", F.col("_site").alias("website"), status.alias("website_status"), "instagram", "facebook", "address", "city",
        "commune", "opening_hours", "rating", "review_count", "services", "description",
        F.map_from_entries(F.array_compact(F.array(*entries, original))).alias("field_sources"),
    )


__all__ = ["about_sections", "description_of", "end_of_list", "hours_map", "listing_cards", "panel_links", "place_to_business", "places", "services_of"]
