"""What a site turned out to be, from captured fetches and renders."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions import text as tx
from leadweave.functions.expr import barrier, is_true, text_or_empty
from leadweave.operators.page_elements import byte_ranges
from leadweave.functions.urls import login_wall_reason, site_host, url_path, with_link_kind, with_social


# ------------------------------------------------------------------ S3, S4
_META_CHARSET = re.compile(fv.META_CHARSET_PATTERN.encode(), re.IGNORECASE)


def decode_body(body: bytes, header_charset: str | None, max_bytes: int | None = None, head_bytes: int | None = None) -> str:
    """Text of a captured body in the header's charset, else the declared one, else UTF-8.

    Bytes that don't fit are replaced; a charset that Python doesn't know counts as UTF-8.
    """
    body = body if max_bytes is None else body[:max_bytes]
    name = header_charset
    if not name:
        declared = _META_CHARSET.search(body if head_bytes is None else body[:head_bytes])
        name = declared.group(1).decode("ascii", "ignore") if declared else "utf-8"
    try:
        text = body.decode(name, "replace")
    except (LookupError, ValueError):  # no such charset, or one that isn't of text
        text = body.decode("utf-8", "replace")
    return text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates can't leave the worker


def with_decoded_html(fetches: DataFrame, body: str, charset: str, content_type: str, out: str = "html",
                      max_bytes: int | None = None, head_bytes: int | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """Adds ``out``: the text of each HTML body, '' for other content types and NULL bodies.

    ``max_bytes`` cuts bodies and ``head_bytes`` the part searched for a declared charset; by default
    neither is cut. Results leave the worker every ``batch_bytes`` of body.
    """
    ready = fetches.withColumns({
        "_body": F.when(is_html_type(F.col(content_type)), F.col(body).cast("binary")), "_charset": F.trim(F.col(charset).cast("string"))})
    kept = [c for c in fetches.columns if c != out]
    schema = T.StructType([fetches.schema[c] for c in kept] + [T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies, names = batch.column("_body"), batch.column("_charset")
            for begin, end in byte_ranges(bodies, batch_bytes):
                texts = [
                    decode_body(b.as_py(), n.as_py(), max_bytes, head_bytes) if b.is_valid else ""
                    for b, n in zip(bodies[begin:end], names[begin:end])
                ]
                yield pa.RecordBatch.from_arrays([batch.column(c)[begin:end] for c in kept] + [pa.array(texts, pa.string())], names=[*kept, out])

    return ready.select(*kept, "_body", "_charset").mapInArrow(run, schema)


def is_html_type(content_type: Column) -> Column:
    media = F.lower(F.trim(F.regexp_extract(F.coalesce(content_type, F.lit("")), r"^([^;]*)", 1)))
    return media.isin(fv.HTML_CONTENT_TYPES)


# ------------------------------------------------------------------ R27
def is_transient(status: Column, error_kind: Column) -> Column:
    """May waiting help? Server hiccups, timeouts and refused connections; never a missing domain."""
    return is_true(status.isin(fv.TRANSIENT_STATUS)) | is_true(error_kind.isin("timeout", "connect", "http"))


def final_attempt(attempts: DataFrame, max_attempts: int | None = None, site: str = "site_id") -> DataFrame:
    """The outcome that counts: the first attempt that was not transient, else the last allowed one.

    ``attempts(site, attempt, ..., transient, error)``; later attempts after a final one are ignored.
    """
    rest = [c for c in attempts.columns if c not in (site, "attempt")]
    row = F.struct("attempt", *rest)
    allowed = attempts if max_attempts is None else attempts.filter(F.col("attempt") <= max_attempts)
    picked = allowed.groupBy(site).agg(
        F.min_by(row, F.when(~F.col("transient"), F.col("attempt"))).alias("final"), F.max_by(row, "attempt").alias("last")
    )
    picked = picked.select(site, F.coalesce("final", "last").alias("r")).select(site, "r.*")
    again = F.concat(F.col("error"), F.lit(" (se intentó "), F.col("attempt").cast("string"), F.lit(" veces)"))
    return picked.withColumn("error", F.when((F.col("attempt") > 1) & (text_or_empty("error") != ""), again).otherwise(F.col("error")))


# ------------------------------------------------------------------ R1
def site_status(sites: DataFrame, site: str = "site_id") -> DataFrame:
    """The status cascade: one ordered choice over the fetch and render outcomes of each site.

    ``sites`` has ``url`` plus, from the fetch: ``f_final_url, f_status, f_content_type, f_title,
    f_text, f_has_html, f_error, f_tls``; from the render (NULL when the page was not rendered):
    ``r_final_url, r_status, r_title, r_text, r_has_html, r_error``.
    """
    sites = with_link_kind(sites, "url", "kind")
    rendered = F.col("r_has_html") & F.col("r_error").isNull()
    rendered = is_true(rendered)
    fetch_error = text_or_empty("f_error") != ""
    no_answer = text_or_empty("f_error").contains(fv.NO_ANSWER_HINT)
    # Text tests that several branches ask for are columns of their own: each runs once per row.
    bad_status = is_true(F.col("f_status") >= 400)
    # Walls are told apart here only behind an error status; other pages are tested once, on the text finally used.
    sites = sites.withColumns({
        "_wall_fetch": F.when(bad_status, tx.is_bot_wall("f_title", "f_text")), "_wall_render": F.when(bad_status, tx.is_bot_wall("r_title", "r_text")),
    })
    wall_fetch, wall_render = is_true(F.col("_wall_fetch")), is_true(F.col("_wall_render"))
    asks_render = is_true(F.col("f_status").isin(401, 403, 429, 503)) | wall_fetch
    rescued = rendered & (F.coalesce("r_status", F.lit(200)) < 400) & ~wall_render
    blocked = (is_true(F.col("r_has_html")) & wall_render) | is_true(F.col("f_status").isin(403, 429))
    tls = is_true(F.col("f_tls"))
    sites = sites.withColumns({
        "_use_render": (tls & rendered) | (~tls & fetch_error & no_answer & rendered) | (~fetch_error & bad_status & asks_render & rescued),
        "_tls_down": tls & ~rendered,
    })
    early_status = (
        F.when(F.col("kind") == fv.KIND_SOCIAL, fv.SITE_ONLY_SOCIAL)
        .when(F.col("kind") == fv.KIND_CONTACT, fv.SITE_NONE)
        .when(F.col("kind") == fv.KIND_AGGREGATOR, F.when(fetch_error | bad_status | ~is_true(F.col("f_has_html")), fv.SITE_DOWN).otherwise(fv.SITE_ONLY_SOCIAL))
        .when(F.col("kind") != fv.KIND_OWN, fv.SITE_DOWN)
        .when(F.col("_tls_down") & ~is_true(F.col("f_has_html")), fv.SITE_DOWN)
        .when(~tls & fetch_error & ~F.col("_use_render"), fv.SITE_DOWN)
        .when(~fetch_error & bad_status & asks_render & ~rescued, F.when(blocked, fv.SITE_BLOCKED).otherwise(fv.SITE_DOWN))
        .when(~fetch_error & bad_status & ~asks_render, fv.SITE_DOWN)
        .when(~fetch_error & ~bad_status & ~is_true(F.col("f_has_html")) & ~F.col("_use_render"), fv.SITE_DOWN)
    )
    early_reason = (
        F.when(F.col("kind") == fv.KIND_SOCIAL, fv.REASON_SOCIAL_LINK)
        .when(F.col("kind") == fv.KIND_CONTACT, fv.REASON_CONTACT_LINK)
        .when(F.col("kind") == fv.KIND_AGGREGATOR, F.when(fetch_error | bad_status | ~is_true(F.col("f_has_html")), fv.REASON_LINK_PAGE_DOWN).otherwise(fv.REASON_LINK_PAGE_ONLY))
        .when(F.col("kind") != fv.KIND_OWN, fv.REASON_BAD_ADDRESS)
        .when(F.col("_tls_down") & ~is_true(F.col("f_has_html")), fv.TLS_REASON)
        .when(~tls & fetch_error & ~F.col("_use_render"), F.col("f_error"))
        .when(~fetch_error & bad_status & asks_render & ~rescued, F.when(blocked, fv.BOT_WALL_REASON).otherwise(tx.http_error_reason("f_status")))
        .when(~fetch_error & bad_status & ~asks_render, tx.http_error_reason("f_status"))
        .when(
            ~fetch_error & ~bad_status & ~is_true(F.col("f_has_html")) & ~F.col("_use_render"),
            F.concat(F.lit("La dirección no lleva a una página web (es un archivo "), F.coalesce("f_content_type", F.lit("None")), F.lit(")")),
        )
    )
    sites = sites.withColumns({"_early": early_status, "_early_reason": early_reason}).withColumns({
        "_url": F.coalesce(F.when(F.col("_use_render"), F.col("r_final_url")).otherwise(F.col("f_final_url")), F.col("url")),
        "_title": F.when(F.col("_use_render"), F.col("r_title")).otherwise(F.col("f_title")),
        "_text": F.when(F.col("_use_render"), F.col("r_text")).otherwise(F.col("f_text")),
    })
    sites = with_social(sites, "_url", "_landed")
    thin = tx.needs_render("_text") & ~F.col("_use_render") & ~F.col("_tls_down") & rendered
    sites = sites.withColumns({
        "_first_login": login_wall_reason("_url"),
        "_thin": thin,
    }).withColumns({
        "_last_url": F.when(F.col("_thin"), F.col("r_final_url")).otherwise(F.col("_url")),
        "_last_title": F.when(F.col("_thin"), F.col("r_title")).otherwise(F.col("_title")),
        "_last_text": F.when(F.col("_thin"), F.col("r_text")).otherwise(F.col("_text")),
    })
    # What was decided early needs none of the text tests.
    undecided = F.col("_early").isNull()
    sites = sites.withColumn("_login", F.when(undecided, login_wall_reason("_last_url"))).withColumn(
        "_wall", is_true(F.when(undecided & F.col("_login").isNull(), tx.is_bot_wall("_last_title", "_last_text")))
    ).withColumn("_words", F.when(undecided & F.col("_login").isNull() & ~F.col("_wall"), tx.page_words("_last_title", "_last_text")))
    sites = barrier(sites, "_words").withColumn("_dead", F.when(F.col("_words").isNotNull(), tx.dead_reason_of(F.col("_words"), "_last_text")))
    social = F.col("_landed_profile").isNotNull()
    status = (
        F.when(F.col("_early").isNotNull(), F.col("_early"))
        .when(social, fv.SITE_ONLY_SOCIAL)
        .when(F.col("_first_login").isNotNull() | F.col("_login").isNotNull(), fv.SITE_DOWN)
        .when(F.col("_wall"), fv.SITE_BLOCKED)
        .when(F.col("_dead").isNotNull() | F.col("_tls_down"), fv.SITE_DOWN)
        .otherwise(fv.SITE_OK)
    )
    reason = (
        F.when(F.col("_early").isNotNull(), F.col("_early_reason"))
        .when(social, fv.REASON_REDIRECT_SOCIAL)
        .when(F.col("_first_login").isNotNull(), F.col("_first_login"))
        .when(F.col("_login").isNotNull(), F.col("_login"))
        .when(F.col("_wall"), fv.BOT_WALL_REASON)
        .when(F.col("_dead").isNotNull(), F.col("_dead"))
        .when(F.col("_tls_down"), fv.TLS_REASON)
    )
    late = F.col("_early").isNull()
    reads = late & ~social & F.col("_first_login").isNull() & F.col("_login").isNull() & ~F.col("_wall") & F.col("_dead").isNull()
    no_visit = F.col("kind").isin(fv.KIND_SOCIAL, fv.KIND_CONTACT, fv.KIND_INVALID, fv.KIND_MAPS)
    out = sites.select(
        site, "url", "kind", status.alias("status"), reason.alias("reason"),
        F.when(no_visit, None).when(late, F.col("_last_url")).otherwise(F.col("f_final_url")).alias("final_url"),
        (late & F.col("_last_url").startswith("https://")).alias("https"),
        (late & (F.col("_use_render") | F.col("_thin"))).alias("rendered"),
        # A site down only for its certificate still has its contacts read.
        reads.alias("read_content"),
    )
    return barrier(out, "status", "reason", "final_url", "https", "rendered", "read_content")


# ------------------------------------------------------------------ J18: link pages
def own_site_of_link_page(links: DataFrame, key: str = "page_id") -> DataFrame:
    """First link of an aggregator page that leads to a site of the business's own."""
    host, page_host = site_host("link"), site_host("page_url")
    own = links.filter((F.col("kind") == fv.KIND_OWN) & (host != page_host) & ~host.isin(fv.AGGREGATOR_HOSTS))
    return own.groupBy(key).agg(F.min_by("link", "position").alias("own_site"))


# ------------------------------------------------------------------ W14
def pick_inner_pages(links: DataFrame, home: str = "home_url", link: str = "link", site: str = "site_id", limit: int | None = None) -> DataFrame:
    """Inner pages (all, or the first ``limit``) of each site: contact before services before about, shorter paths first."""
    path = F.regexp_replace(F.lower(tx.fold_accents(url_path(link))), "/+$", "")
    ranked = links.withColumn("_path", path)
    priority = F.when(F.lit(False), F.lit(None).cast("int"))
    for n, pattern in enumerate(fv.PAGE_PRIORITY_PATTERNS):
        priority = priority.when(F.col("_path").rlike(pattern), n)
    home_path = F.regexp_replace(url_path(home), "/+$", "")
    ranked = ranked.withColumn("priority", priority).filter(
        F.col("priority").isNotNull() & (F.col("_path") != "") & (F.col("_path") != home_path) & ~F.col("_path").rlike(fv.NOT_A_PAGE_PATTERN)
    )
    # The first link of each folded path stands for it; and only those few rows per site are ordered.
    once = ranked.groupBy(site, "_path", "priority").agg(F.min_by(link, "position").alias(link))
    order = W.partitionBy(site).orderBy("priority", F.length("_path"), link)
    placed = once.withColumn("rank", F.row_number().over(order)).select(site, "rank", link)
    return placed if limit is None else placed.filter(F.col("rank") <= limit)
