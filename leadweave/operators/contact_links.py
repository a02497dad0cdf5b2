"""Contact links on pages.

Only text that can hold a contact link leaves the page row: a cheap pattern test runs on the
element arrays first, and just the hits are exploded, matched, normalised and reduced to one
candidate per page and number with a partially aggregated ``min``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import barrier, exact_lookup, is_true
from leadweave.functions.phones import contact_digits, with_contact_number
from leadweave.functions.text import scan_variants, unescape_entities
from leadweave.functions.urls import with_joined
from leadweave.operators.page_facts import in_any, spans
from leadweave.operators.skew import hot_safe_lookup
from leadweave.session import cut_lineage

E = "elements"
# A text without any of these holds no contact link: the hosts of the link patterns and the app's own scheme.
HINT = r"(?i)" + "|".join(dict.fromkeys([host.replace(".", r"\.") for host in fv.CONTACT_HOSTS if "whatsapp" not in host] + ["whatsapp"]))
MATCHES = "array<struct<kind:string,raw:string,link:string>>"


def placement_rank(placement: Column) -> Column:
    return exact_lookup(placement, fv.PLACEMENT_RANK)


def with_fallback_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """HTML without comments, kept only where it can hold a contact link (run before ``parse_pages``)."""
    return pages.withColumn(
        "fallback_text", F.when(F.col(html).rlike(HINT), F.regexp_replace(html, r"(?s)<!--.*?-->", ""))
    )


# ------------------------------------------------------------------ X16: placement
def _tokens(e: Column) -> Column:
    return F.split(F.lower(F.concat_ws(" ", e["attrs"]["class"], e["attrs"]["id"])), r"\s+")


def with_placement_marks(parsed: DataFrame) -> DataFrame:
    """Spans of floating, footer and header elements; a node's placement follows from its ancestors."""
    def ids(test) -> Column:
        return spans(F.filter(E, lambda e: (e["tag"] != "#text") & is_true(test(e))))

    def role(e: Column) -> Column:
        return F.lower(F.coalesce(e["attrs"]["role"], F.lit("")))

    def has_token(e: Column, words: list[str]) -> Column:
        return F.arrays_overlap(_tokens(e), F.array(*[F.lit(w) for w in words]))

    def footer(e: Column) -> Column:
        return (e["tag"] == "footer") | (role(e) == "contentinfo") | has_token(e, fv.FOOTER_TOKENS)

    marked = parsed.withColumns({
        "_float": ids(lambda e: F.coalesce(e["attrs"]["style"], F.lit("")).rlike(fv.FIXED_STYLE_PATTERN)
                      | F.concat_ws(" ", e["attrs"]["class"], e["attrs"]["id"]).rlike(fv.FLOATING_TOKEN_PATTERN)),
        "_footer": ids(footer),
        "_header": ids(lambda e: e["tag"].isin("header", "nav") | role(e).isin("banner", "navigation")
                       | has_token(e, fv.HEADER_TOKENS)),
    })
    return barrier(marked, "_float", "_footer", "_header")


def placement_of(e: Column) -> Column:
    return (
        F.when(in_any(e, F.col("_float")), "flotante")
        .when(in_any(e, F.col("_footer")), "footer")
        .when(in_any(e, F.col("_header")), "header")
        .otherwise("cuerpo")
    )


# ------------------------------------------------------------------ texts worth scanning
def _scan_texts(parsed: DataFrame, key: str) -> DataFrame:
    """One row per attribute, script, text node or fallback text that may hold a contact link."""
    def context(e: Column) -> Column:
        names = F.array_join(F.map_keys(e["attrs"]), " ")
        return F.concat_ws(" ", F.lower(F.concat_ws(" ", e["attrs"]["class"], e["attrs"]["id"])), names).rlike(fv.CONTACT_CUE_PATTERN)

    def row(e: Column, order: Column, source: str, name: Column, text: Column, place: Column, cue: Column) -> Column:
        return F.struct(
            e["node"].alias("node"), order.alias("sub"), F.lit(source).alias("origin"), name.alias("name"),
            text.alias("text"), place.alias("placement"), cue.alias("cue"),
        )

    none = F.lit(None).cast("string")
    attributes = F.flatten(F.transform(
        F.filter(E, lambda e: ~e["tag"].isin("#text", "script", "style")
                 & (context(e) | F.array_join(F.map_values(e["attrs"]), " ").rlike(HINT))),
        lambda e: F.transform(
            F.map_entries(e["attrs"]),
            lambda kv, i: row(e, i, "attribute", kv["key"], kv["value"], placement_of(e), context(e)),
        ),
    ))
    attributes = F.filter(attributes, lambda a: (a["text"] != "") & (a["cue"] | a["text"].rlike(HINT)))
    scripts = F.transform(
        F.filter(E, lambda e: (e["tag"] == "script") & e["text"].rlike(HINT + "|" + fv.CONTACT_CUE_PATTERN[4:])),
        lambda e: row(
            e, F.lit(0),
            "script", F.lower(F.coalesce(e["attrs"]["type"], F.lit(""))), e["text"],
            F.when(
                (F.lower(F.coalesce(e["attrs"]["type"], F.lit(""))) != "application/ld+json")
                & e["text"].rlike(fv.FLOATING_SCRIPT_PATTERN), "flotante",
            ).otherwise("cuerpo"),
            e["text"].rlike(fv.CONTACT_CUE_PATTERN),
        ),
    )
    # Sub-order after any attribute of the same element: an element's own text comes last.
    texts = F.transform(
        F.filter(E, lambda e: (e["tag"] == "#text") & e["text"].rlike(HINT)),
        lambda e: row(e, F.lit(1000), "text", none, e["text"], placement_of(e), F.lit(False)),
    )
    fallback = F.filter(
        F.array(F.struct(
            F.lit(2**30).alias("node"), F.lit(0).alias("sub"), F.lit("fallback").alias("origin"), none.alias("name"),
            F.col("fallback_text").alias("text"), F.lit("cuerpo").alias("placement"), F.lit(False).alias("cue"),
        )),
        lambda r: r["text"].isNotNull(),
    )
    marked = with_placement_marks(parsed)
    return marked.select(
        key, "region", "page_url", F.explode(F.concat(attributes, scripts, texts, fallback)).alias("_s")
    ).select(key, "region", "page_url", "_s.*")


# ------------------------------------------------------------------ matches inside a text
def _link_matches(text: Column) -> Column:
    """All contact links of a text, in pattern order, each with its raw number and full address."""
    tail = F.lit(f"(?=({fv.LINK_TAIL}))")

    empty = F.array().cast(MATCHES)

    def matches(kind: str, pattern: str, groups: int, hint: str) -> Column:
        full = F.concat(F.lit(pattern), tail)
        whole = F.regexp_extract_all(text, full, F.lit(0))
        rest = F.regexp_extract_all(text, full, F.lit(groups + 1))
        raw = F.regexp_extract_all(text, full, F.lit(1)) if groups else rest
        found = F.transform(
            F.arrays_zip(whole.alias("whole"), rest.alias("rest"), raw.alias("raw")),
            lambda m: F.struct(
                F.lit(kind).alias("kind"), (m["raw"] if groups else F.lit(None).cast("string")).alias("raw"),
                F.concat(m["whole"], m["rest"]).alias("link"),
            ),
        )
        # The full pattern tries every position of the text; a plain word search decides first.
        return F.when(text.rlike(hint), found).otherwise(empty)

    hints = [r"(?i)wa\.me/", r"(?i)whatsapp\.com/send", r"(?i)whatsapp://"]
    parts = [matches("number", pattern, 1, hint) for pattern, hint in zip(fv.NUMBER_LINK_PATTERNS, hints)]
    parts += [matches(kind, pattern, 0, hint) for kind, pattern, hint in (
        ("message", fv.MESSAGE_LINK_PATTERN, r"(?i)wa\.me/message/"), ("shortlink", fv.SHORT_LINK_PATTERN, r"(?i)wa\.link/|walink\.co/"),
        ("group", fv.GROUP_LINK_PATTERN, r"(?i)chat\.whatsapp\.com/"))]
    return F.concat(*parts)


def _plugin_matches(text: Column, near_cue: bool, cue_window: int = fv.CUE_WINDOW) -> Column:
    """Numbers in widget settings; in scripts a cue word must stand within ``cue_window`` characters (a rule of the product)."""
    pattern = F.lit(fv.PLUGIN_NUMBER_PATTERN)
    whole = F.regexp_extract_all(text, pattern, F.lit(0))
    found = F.arrays_zip(whole.alias("whole"), F.regexp_extract_all(text, pattern, F.lit(1)).alias("raw"))
    if near_cue:
        between = F.split(text, fv.PLUGIN_NUMBER_PATTERN)

        def length_of(parts: Column) -> Column:
            return F.aggregate(parts, F.lit(0), lambda n, p: n + F.length(p))

        start = lambda i: length_of(F.slice(between, F.lit(1), i + 1)) + length_of(F.slice(whole, F.lit(1), i))
        from_ = lambda i: F.greatest(start(i) - cue_window, F.lit(0))
        window = lambda m, i: F.substring(
            text, from_(i) + 1, start(i) - from_(i) + F.length(m["whole"]) + cue_window
        )
        found = F.filter(found, lambda m, i: window(m, i).rlike(fv.CONTACT_CUE_PATTERN))
    return F.transform(found, lambda m: F.struct(F.lit("plugin").alias("kind"), m["raw"].alias("raw"), m["whole"].alias("link")))


def _hits(texts: DataFrame, key: str) -> DataFrame:
    """One row per contact mention: kind, raw number, evidence, order of discovery."""
    variants = texts.select("*", F.posexplode(scan_variants(F.col("text"))).alias("variant", "body"))
    body = F.col("body")
    is_script, is_attribute = F.col("origin") == "script", F.col("origin") == "attribute"
    not_ld = F.col("name") != "application/ld+json"
    plugin_name = is_attribute & F.col("cue") & F.col("name").rlike(fv.PLUGIN_ATTRIBUTE_PATTERN)
    empty = F.array().cast(MATCHES)
    own_number = F.when(
        plugin_name & (F.col("variant") == 0),
        F.array(F.struct(
            F.lit("plugin").alias("kind"), F.col("text").alias("raw"),
            F.concat(F.col("name"), F.lit('="'), F.col("text"), F.lit('"')).alias("link"),
        )),
    ).otherwise(empty)
    settings = (
        F.when(is_script & F.col("cue") & not_ld, _plugin_matches(body, near_cue=True))
        .when(is_attribute & F.col("cue") & ~plugin_name & F.ltrim("text").rlike(r"^[{\[]"), _plugin_matches(body, near_cue=False))
        .otherwise(empty)
    )
    # Links of all variants come before settings numbers of the same text. One explode for both:
    # two would read (and parse) the pages twice.
    def staged(matches: Column, stage: int) -> Column:
        return F.transform(matches, lambda m, i: F.struct(F.lit(stage).alias("stage"), i.alias("at"), m.alias("m")))

    columns = [key, "region", "page_url", "node", "sub", "origin", "placement", "variant", "text"]
    found = variants.select(*columns, F.explode(F.concat(staged(_link_matches(body), 0), staged(F.concat(own_number, settings), 1))).alias("_f"))
    found = found.select(*columns, "_f.stage", "_f.at", "_f.m")
    return found.select(
        key, "region", "page_url", "origin", F.col("m.kind").alias("kind"), F.col("m.raw").alias("raw"), F.col("m.link").alias("link"),
        F.when((F.col("stage") == 1) & (F.col("origin") == "script"), "flotante").otherwise(F.col("placement")).alias("placement"),
        F.when((F.col("origin") == "attribute") & (F.col("stage") == 0), F.col("text")).otherwise(F.col("m.link")).alias("evidence"),
        F.struct("node", "sub", "stage", "variant", "at").alias("arrival"),
    )


def https_link(link: Column) -> Column:
    return (
        F.when(link.startswith("//"), F.concat(F.lit("https:"), link))
        .when(link.rlike("(?i)^https?://"), link)
        .otherwise(F.concat(F.lit("https://"), link))
    )


def contact_mentions(parsed: DataFrame, key: str = "page_id", source: str = "web", url: str = "url") -> DataFrame:
    """Every contact mention of parsed pages, normalised.

    ``parsed`` carries ``elements``, optionally ``fallback_text`` and ``region``. ``outcome`` is
    'candidate', 'shortlink' or 'ignored'.
    """
    if "fallback_text" not in parsed.columns:
        parsed = parsed.withColumn("fallback_text", F.lit(None).cast("string"))
    if "region" not in parsed.columns:
        parsed = parsed.withColumn("region", F.lit("CL"))
    hits = _hits(_scan_texts(parsed.withColumn("page_url", F.col(url)), key), key)
    return _classified(hits, key, source)


def _classified(hits: DataFrame, key: str, source: str) -> DataFrame:
    hits = with_contact_number(hits, "raw", "c", F.col("region"))
    kind, link = F.col("kind"), F.trim(F.col("link"))
    numbered = kind.isin("number", "plugin")
    address = F.when(kind == "message", F.regexp_extract(https_link(link), r"^([^?]*)", 1)).when(kind == "shortlink", https_link(link))
    outcome = (
        F.when(numbered & F.col("c_number").isNotNull(), "candidate")
        .when(kind == "message", "candidate")
        .when(kind == "shortlink", "shortlink")
        .otherwise("ignored")
    )
    reason = F.when(kind == "group", fv.GROUP_INVITE_REASON).when(numbered, fv.INVALID_NUMBER_REASON)
    hits = hits.withColumns({"outcome": outcome, "address": address})
    return hits.select(
        key, "outcome", F.lit(source).alias("source"), "page_url", "region",
        F.col("c_number").alias("number"),
        F.when(F.col("c_number").isNotNull(), F.concat(F.lit("https://wa.me/"), F.col("c_number"))).otherwise(F.col("address")).alias("url"),
        "placement",
        F.when(F.col("kind") == "group", F.col("link")).otherwise(F.col("evidence")).alias("evidence"),
        F.col("c_note").alias("note"),
        F.coalesce(F.col("c_broken"), F.lit(False)).alias("broken"),
        F.when(F.col("outcome") == "ignored", reason).alias("reason"),
        # A number of a country outside the plan may work: it is unknown, and only a number that no plan could hold is broken.
        ((F.col("outcome") == "ignored") & numbered & ~contact_digits("raw").rlike(fv.FOREIGN_NUMBER_PATTERN)).alias("ignored_broken"),
        (F.col("origin") == "fallback").cast("int").alias("pass"),
        "arrival",
    )


# ------------------------------------------------------------------ W5: one candidate per page and number
def page_candidates(mentions: DataFrame, key: str = "page_id") -> DataFrame:
    """Best-placed mention per number (or link), earlier pass first; fallback hits only fill gaps."""
    fields = ["source", "page_url", "number", "url", "placement", "evidence", "note", "broken"]
    found = mentions.filter(F.col("outcome") == "candidate").withColumn(
        "_key", F.coalesce("number", F.lower("url"))
    )
    best = found.groupBy(key, "_key").agg(
        F.min(F.struct("pass", placement_rank(F.col("placement")).alias("rank"), "arrival", *fields)).alias("b")
    )
    return best.select(key, *[F.col("b." + f).alias(f) for f in fields], F.col("b.arrival").alias("arrival"))


def pack_candidates(candidates: DataFrame, key: str = "page_id") -> DataFrame:
    """Candidates of a page as one array, numbered ones first, then by placement."""
    order = F.struct(F.col("number").isNull().alias("late"), placement_rank(F.col("placement")).alias("rank"), "arrival", "number", "url", "placement")
    return candidates.groupBy(key).agg(F.array_sort(F.collect_list(order)).alias("candidates"))


def page_shortlinks(mentions: DataFrame, key: str = "page_id") -> DataFrame:
    found = mentions.filter(F.col("outcome") == "shortlink")
    fields = ["source", "page_url", "region", "url", "placement", "evidence"]
    best = found.groupBy(key, F.lower("url").alias("_key")).agg(
        F.min(F.struct("pass", placement_rank(F.col("placement")).alias("rank"), "arrival", *fields)).alias("b")
    )
    return best.select(key, *[F.col("b." + f).alias(f) for f in fields], F.col("b.arrival").alias("arrival"))


def page_ignored(mentions: DataFrame, key: str = "page_id") -> DataFrame:
    """Ignored links with their reason, one per evidence."""
    found = mentions.filter(F.col("outcome") == "ignored")
    best = found.groupBy(key, "evidence").agg(F.min(F.struct("pass", "arrival", "reason", "ignored_broken")).alias("b"))
    return best.select(
        key, "evidence", F.col("b.reason").alias("reason"), F.col("b.ignored_broken").alias("broken"), F.col("b.arrival").alias("arrival")
    )


def floating_pages(mentions: DataFrame, key: str = "page_id") -> DataFrame:
    """Pages with a floating contact button."""
    floats = (F.col("outcome") != "ignored") & (F.col("placement") == "flotante") & (F.col("pass") == 0)
    return mentions.groupBy(key).agg(F.bool_or(floats).alias("floating"))


# ------------------------------------------------------------------ J17: short links
def carries_number(url: Column) -> Column:
    tests = [F.exists(scan_variants(url), lambda v: v.rlike(p)) for p in fv.NUMBER_LINK_PATTERNS]
    return reduce(lambda a, b: a | b, tests)


def redirect_edges(redirects: DataFrame) -> DataFrame:
    """``url, next``: where each captured address leads, absolute. Addresses that lead nowhere have no row.

    ``redirects(url, location[, body[, status]])``: the Location header counts first; without one, a page
    (``status`` 200, where there is such a column) that refreshes itself to another address leads there.
    Several captures of one address count as the one with the smallest target.
    """
    target = F.nullif(F.trim(F.coalesce("location", F.lit(""))), F.lit(""))
    if "body" in redirects.columns:
        refresh = F.nullif(unescape_entities(F.regexp_extract(F.coalesce("body", F.lit("")), fv.META_REFRESH_PATTERN, 1)), F.lit(""))
        page = (F.col("status") == 200) if "status" in redirects.columns else F.lit(True)
        target = F.coalesce(target, F.when(page, refresh))
    found = redirects.select("url", target.alias("_target")).filter(F.col("url").isNotNull() & F.col("_target").isNotNull())
    once = found.groupBy("url").agg(F.min("_target").alias("_target"))
    return with_joined(once, "url", "_target", "next").select("url", "next")


def resolve_short_links(urls: DataFrame, redirects: DataFrame, url: str = "url", max_hops: int | None = None) -> DataFrame:
    """Final contact address of each distinct short link over the redirect table (``redirect_edges``).

    Pointer doubling: every address points some hops ahead, and a round replaces its pointer by the
    pointer of the address it points to, so a chain of n hops takes log2(n) rounds. Addresses whose end
    is known leave the rounds and are only looked up. A pointer also carries the smallest address it
    has passed: where that is the address itself, it lies on a cycle, and all that passed it lead nowhere.

    Links are followed to their end by default; with ``max_hops``, those that end later are unresolved.
    """
    edges = redirect_edges(redirects).withColumn("_ends", carries_number(F.col("next")))
    nothing = F.lit(None).cast("string")
    state = cut_lineage(barrier(edges, "_ends").select(
        "url", F.when(~F.col("_ends"), F.col("next")).alias("at"), F.lit(1).cast("long").alias("hops"), F.col("next").alias("least"),
        F.when(F.col("_ends"), F.col("next")).alias("final_url"), (~F.col("_ends")).alias("open")))
    settled, moving, reach = [state.filter(~F.col("open"))], state.filter("open"), 1
    while not moving.isEmpty() and (max_hops is None or reach < max_hops):
        known = reduce(DataFrame.unionByName, [*settled, moving]).select(
            F.col("url").alias("at"), F.col("at").alias("_at"), F.col("hops").alias("_hops"), F.col("least").alias("_least"), F.col("final_url").alias("_final"), F.col("open").alias("_open"))
        step = hot_safe_lookup(moving, known, ["at"])
        step = step.select(
            "url", F.when(F.col("_open"), F.col("_at")).alias("at"), (F.col("hops") + F.coalesce("_hops", F.lit(0))).alias("hops"),
            F.least("least", F.when(F.col("_open"), F.col("_least"))).alias("least"), F.col("_final").alias("final_url"), F.coalesce("_open", F.lit(False)).alias("open"))
        step = cut_lineage(step)
        going = step.filter("open")
        cycles = going.filter(F.col("least") == F.col("url")).select("least", F.lit(True).alias("_cycle"))
        if not cycles.isEmpty():
            looped = cut_lineage(hot_safe_lookup(going, cycles, ["least"]))
            on_cycle = F.coalesce("_cycle", F.lit(False))
            settled.append(looped.filter(on_cycle).withColumns({"open": F.lit(False), "at": nothing, "final_url": nothing}).drop("_cycle").select(*step.columns))
            going = looped.filter(~on_cycle).select(*step.columns)
        settled.append(step.filter(~F.col("open")))
        moving, reach = going, reach * 2
    ended = reduce(DataFrame.unionByName, settled).filter(F.col("final_url").isNotNull() & (F.lit(True) if max_hops is None else F.col("hops") <= max_hops))
    return urls.select(F.col(url).alias("url")).distinct().join(ended.select("url", "final_url"), "url", "left")


def shortlink_candidates(shortlinks: DataFrame, resolved: DataFrame, key: str = "page_id") -> DataFrame:
    """Mentions that resolved short links add; unresolved ones come out ignored and broken."""
    joined = hot_safe_lookup(cut_lineage(shortlinks), resolved, ["url"])
    dead = joined.filter(F.col("final_url").isNull())
    live = joined.filter(F.col("final_url").isNotNull()).withColumn(
        "shown", F.concat("evidence", F.lit(" → "), "final_url")
    )
    matched = live.select(
        key, "source", "region", "page_url", "placement", "shown", "arrival",
        F.posexplode(F.flatten(F.transform(scan_variants(F.col("final_url")), _link_matches))).alias("at", "m"),
    )
    hits = matched.select(
        key, "region", "page_url", F.lit("shortlink").alias("origin"), F.col("m.kind").alias("kind"), F.col("m.raw").alias("raw"),
        F.col("m.link").alias("link"), "placement", F.col("shown").alias("evidence"), "arrival", "source",
    )
    resolved_mentions = _classified(hits.drop("source"), key, "web")
    ignored = dead.select(
        key, F.lit("ignored").alias("outcome"), "source", "page_url", "region", F.lit(None).cast("string").alias("number"), "url",
        "placement", "evidence", F.lit(None).cast("string").alias("note"), F.lit(False).alias("broken"),
        F.lit(fv.DEAD_SHORT_LINK_REASON).alias("reason"), F.lit(True).alias("ignored_broken"), F.lit(0).alias("pass"), "arrival",
    )
    return resolved_mentions.unionByName(ignored)


# ------------------------------------------------------------------ W4 and J16
def merge_candidates(candidates: DataFrame, site: str = "site_id") -> DataFrame:
    """One candidate per site, source and number (or link): best placement, first arrival on ties."""
    fields = [c for c in candidates.columns if c not in (site, "source", "arrival", "placement")]
    best = candidates.groupBy(site, "source", F.coalesce("number", F.lower("url")).alias("_key")).agg(
        F.min(F.struct(placement_rank(F.col("placement")).alias("rank"), "arrival", "placement", *fields)).alias("b")
    )
    return best.select(site, "source", *[F.col("b." + f).alias(f) for f in ["placement", *fields, "arrival"]])


def broken_links(checked: DataFrame, checks: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Links or images whose last check still fails: ``checks(url, attempt, reason)``, reason NULL when fine."""
    last = checks.groupBy(F.col("url").alias(url)).agg(F.max_by("reason", "attempt").alias("reason")).filter(F.col("reason").isNotNull())
    return hot_safe_lookup(cut_lineage(checked.select(key, url).distinct()), last, [url], "inner").select(key, url, "reason")
