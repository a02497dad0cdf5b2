"""Captured pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave.functions import phones as ph
from leadweave.functions import urls as ur
from leadweave.operators import contact_links as cl
from leadweave.operators import page_facts as pf
from leadweave.operators import site_status
from leadweave.operators.page_elements import parse_pages
from leadweave.plans.inputs import Inputs
from leadweave.plans.key_queries import CHAIN
from leadweave.plans.registry import query
from leadweave.session import cut_lineage

_ENTITIES = "replace(replace(replace(replace(replace(replace({t}, '&quot;', chr(34)), '&gt;', '>'), '&copy;', '©'), '&middot;', '·'), '&lt;', '<'), '&amp;', '&')"
_BLOCKS = "address|article|aside|blockquote|br|button|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|header|hr|label|li|main|nav|ol|p|pre|section|table|td|th|tr|ul"
# Visible lines by text surgery: drop what is not shown, break at blocks, strip the other tags.
TEXT_SQL = f"""stripped AS (SELECT page_id, url, site_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(head|script|style|iframe|noscript)[ >].*?</(head|script|style|iframe|noscript)>', '', 'g') AS h FROM {{html_pages}}),
  blocks AS (SELECT page_id, url, site_id, regexp_replace(regexp_replace(h, '(?i)</?({_BLOCKS})( [^>]*)?>', chr(10), 'g'), '<[^>]*>', '', 'g') AS t FROM stripped),
  shown AS (SELECT page_id, url, site_id, [trim(regexp_replace(x, '\\s+', ' ', 'g')) for x in string_split({_ENTITIES.format(t='t')}, chr(10)) if trim(regexp_replace(x, '\\s+', ' ', 'g')) <> ''] AS lines FROM blocks)"""
_ORIGIN = "regexp_extract(url, '^(https?://[^/?#]*)', 1)"
_HREFS = f"""hrefs AS (SELECT page_id, url, [CASE WHEN starts_with(x, '/') THEN {_ORIGIN} || x ELSE x END for x in regexp_extract_all(html, '<a href="([^"]*)"', 1)] AS links FROM {{html_pages}})"""


def parsed(d: Inputs) -> DataFrame:
    return parse_pages(cl.with_fallback_text(d.html_pages), keep=["page_id", "url", "site_id", "fallback_text"])


def _joined(column: str, sep: str = "|"):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), sep)


def _ordered_distinct(values: str) -> str:
    """Distinct list in order of first appearance, in SQL."""
    return f"list_filter({values}, lambda x, i: list_position({values}, x) = i)"


query("X1_elements", "page_id long, links long, items long, paragraphs long, images long, scripts long", """
    SELECT page_id, len(regexp_extract_all(html, '<a ')) AS links, len(regexp_extract_all(html, '<li>')) AS items, len(regexp_extract_all(html, '<p>')) AS paragraphs,
      len(regexp_extract_all(html, '<img ')) AS images, len(regexp_extract_all(html, '<script[ >]')) AS scripts FROM {html_pages}""")(
    lambda d: parsed(d).select("page_id", *[F.size(pf.of_tag(t)).alias(n) for n, t in (("links", "a"), ("items", "li"), ("paragraphs", "p"), ("images", "img"), ("scripts", "script"))]))
query("X2_visible_text", "page_id long, visible_text string", f"WITH {TEXT_SQL} SELECT page_id, array_to_string(lines, chr(10)) AS visible_text FROM shown")(
    lambda d: pf.with_visible_text(parsed(d)))
query("X3_head_facts", "page_id long, title string, meta_description string, lang string, favicon string, canonical string, og_title string", f"""
    SELECT page_id, trim(regexp_replace({_ENTITIES.format(t="regexp_extract(html, '(?s)<title>(.*?)</title>', 1)")}, '\\s+', ' ', 'g')) AS title, 'Desc ' || CAST(page_id AS VARCHAR) AS meta_description,
      regexp_extract(html, '<html lang="([a-z]+)"', 1) AS lang, {_ORIGIN} || '/fav' || CAST(page_id % 5 AS VARCHAR) || '.png' AS favicon, {_ORIGIN} || '/c' || CAST(page_id AS VARCHAR) AS canonical,
      'OG ' || CAST(page_id AS VARCHAR) AS og_title FROM {{html_pages}}""")(
    lambda d: pf.with_head_facts(parsed(d)).withColumn("og_title", F.try_element_at("open_graph", F.lit("og:title"))))
query("X4_headings", "page_id long, h1 string, h2 string", f"""SELECT page_id, trim(regexp_replace({_ENTITIES.format(t="regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)")}, '\\s+', ' ', 'g')) AS h1,
    'Servicios|Zona ' || CAST(page_id AS VARCHAR) AS h2 FROM {{html_pages}}""")(
    lambda d: pf.with_structure_facts(parsed(d)).select("page_id", F.array_join("h1", "|").alias("h1"), F.array_join("h2", "|").alias("h2")))
query("X5_structured_data", "page_id long, types string, business_name string", """SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'Plumber|Thing|Offer|Deep' || CAST(page_id AS VARCHAR) ELSE '' END AS types,
    CASE WHEN page_id % 5 = 0 THEN 'N' || CAST(page_id AS VARCHAR) END AS business_name FROM {html_pages}""")(
    lambda d: pf.with_structured_data(parsed(d)).select("page_id", F.array_join("json_ld_types", "|").alias("types"), F.get_json_object("local_business", "$.name").alias("business_name")))
query("X6_hrefs", "page_id long, hrefs string", f"WITH {_HREFS} SELECT page_id, array_to_string({_ordered_distinct('links')}, '|') AS hrefs FROM hrefs")(
    lambda d: pf.link_facts(pf.page_links(parsed(d))).select("page_id", F.array_join("hrefs", "|").alias("hrefs")))
query("X7_W16_link_facts", "page_id long, internal string, maps string", f"""WITH {_HREFS}, i AS (SELECT page_id, [x for x in links if starts_with(x, {_ORIGIN} || '/')] AS own FROM hrefs)
    SELECT page_id, array_to_string({_ordered_distinct('own')}, '|') AS internal, 'https://www.google.com/maps/place/N' || CAST(page_id AS VARCHAR) AS maps FROM i""")(
    lambda d: pf.link_facts(pf.page_links(parsed(d))).select("page_id", F.array_join("internal_links", "|").alias("internal"), F.array_join("maps_links", "|").alias("maps")))
query("A10_page_profiles", "page_id long, profiles string", "SELECT page_id, 'instagram=https://www.instagram.com/neg' || CAST(page_id AS VARCHAR) AS profiles FROM {html_pages}")(
    lambda d: pf.link_facts(pf.page_links(parsed(d))).select("page_id", F.array_join(F.transform("socials", lambda s: F.concat(s["network"], F.lit("="), s["profile"])), "|").alias("profiles")))
query("X8_emails_in_text", "doc_id long, emails string", r"""WITH e AS (SELECT doc_id, [lower(x) for x in regexp_extract_all(text, '[\w.+-]+@[\w-]+(?:\.[\w-]+)+')] AS m FROM {documents})
    SELECT doc_id, array_to_string(""" + _ordered_distinct("m") + """, '|') AS emails FROM e""")(
    lambda d: pf.with_contact_facts(d.documents.select("doc_id", F.col("text").alias("visible_text"), F.array().cast(
        "array<struct<node:int,parent:int,tag:string,attrs:map<string,string>,text:string,line:int,last:int>>").alias("elements"))).select(
        "doc_id", F.array_join("emails", "|").alias("emails")))
query("X8_X9_page_contacts", "page_id long, tel_links string, first_phone string, first_email string", """SELECT page_id, 'tel:+569' || CAST(40000000 + page_id AS VARCHAR) AS tel_links,
    '+569' || CAST(40000000 + page_id AS VARCHAR) AS first_phone, 'ventas' || CAST(page_id AS VARCHAR) || '@neg.cl' AS first_email FROM {html_pages}""")(
    lambda d: pf.with_contact_facts(pf.with_visible_text(parsed(d))).select(
        "page_id", F.array_join("tel_links", "|").alias("tel_links"), F.get("phones", F.lit(0)).alias("first_phone"), F.get("emails", F.lit(0)).alias("first_email")))
query("X9_phones_in_text", "id long, phones string", """SELECT id, CASE WHEN phone_e164 IS NULL THEN '' ELSE phone_e164 END AS phones FROM {businesses}""")(
    lambda d: d.businesses.select("id", F.concat(F.lit("Llama al "), F.coalesce(ph.pretty_number(F.expr("substr(phone_e164, 2)")), F.lit("")), F.lit(" o escribe. Desde 1998, RUT 76.123.456-7.")).alias("t")).select(
        "id", F.array_join(ph.phones_in_text("t"), "|").alias("phones")))
query("X10_menu", "page_id long, menu string", f"""WITH m AS (SELECT page_id, [trim(x) for x in regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a [^>]*>([^<]*)</a>', 1)] AS items FROM {{html_pages}})
    SELECT page_id, array_to_string({_ordered_distinct('items')}, '|') AS menu FROM m""")(
    lambda d: pf.with_structure_facts(parsed(d)).select("page_id", F.array_join("menu_items", "|").alias("menu")))
query("X11_builders", "page_id long, builders string", "SELECT page_id, CASE WHEN page_id % 6 = 0 THEN 'WordPress|Tema WordPress: astra' ELSE '' END AS builders FROM {html_pages}")(
    lambda d: pf.with_builders(d.html_pages).select("page_id", F.array_join(F.transform("builders", lambda b: b["name"]), "|").alias("builders")))
query("X12_F20_trust_and_years", "page_id long, guarantee string, last_year long", """SELECT page_id, '© ' || CAST(2015 + page_id % 10 AS VARCHAR) || ' Negocio. Garantía total.' AS guarantee,
    2015 + page_id % 10 AS last_year FROM {html_pages}""")(
    lambda d: pf.with_text_facts(pf.with_visible_text(parsed(d))).select(
        "page_id", F.element_at(F.filter("trust_signals", lambda s: s["kind"] == "garantía"), -1)["snippet"].alias("guarantee"), F.array_max("copyright_years").alias("last_year")))


def catalog(d: Inputs) -> DataFrame:
    name = F.expr("translate(n_name, '0123456789_', 'abcdefghij-')")
    return d.nation.select(F.initcap(name).alias("_n"), name.alias("name"), name.alias("folded"), (F.col("n_regionkey") == 0).alias("ambiguous")).drop("_n")


query("X13_J11_place_mentions", "page_id long, places string", """SELECT page_id, translate(n_name, '0123456789_', 'abcdefghij-') AS places FROM {html_pages} JOIN {nation} ON n_nationkey = page_id % 25
    WHERE n_regionkey <> 0 OR page_id % 2 = 0""")(
    lambda d: pf.place_mentions(pf.with_visible_text(parsed(d)), catalog(d)).select("page_id", F.array_join("places", "|").alias("places")))
_CANDIDATES = """SELECT page_id, '569' || CAST(30000000 + page_id * 7 AS VARCHAR) AS number, 'footer' AS placement, 'https://wa.me/569' || CAST(30000000 + page_id * 7 AS VARCHAR) || '?text=Hola' AS evidence FROM {html_pages}
    UNION ALL SELECT page_id, '569' || CAST(50000000 + page_id AS VARCHAR), 'flotante', '"telephone":"569' || CAST(50000000 + page_id AS VARCHAR) || '"' FROM {html_pages} WHERE page_id % 7 = 0"""
query("X14_X15_X16_W5_page_candidates", "page_id long, number string, placement string, evidence string", _CANDIDATES)(lambda d: cl.page_candidates(cl.contact_mentions(parsed(d))))
query("W20_packed_candidates", "page_id long, numbers string", """SELECT page_id, CASE WHEN page_id % 7 = 0 THEN '569' || CAST(50000000 + page_id AS VARCHAR) || '|' ELSE '' END || '569' || CAST(30000000 + page_id * 7 AS VARCHAR) AS numbers FROM {html_pages}""")(
    lambda d: cl.pack_candidates(cl.page_candidates(cl.contact_mentions(parsed(d)))).select("page_id", F.array_join(F.transform("candidates", lambda c: c["number"]), "|").alias("numbers")))
query("X17_ignored_links", "page_id long, evidence string, broken boolean", """SELECT page_id, 'https://chat.whatsapp.com/G' || CAST(page_id AS VARCHAR) AS evidence, false AS broken FROM {html_pages} WHERE page_id % 11 = 0
    UNION ALL SELECT page_id, 'https://wa.me/123', true FROM {html_pages} WHERE page_id % 13 = 0""")(lambda d: cl.page_ignored(cl.contact_mentions(parsed(d))))
query("A14_floating_button", "page_id long, floating boolean", "SELECT page_id, page_id % 7 = 0 AS floating FROM {html_pages}")(lambda d: cl.floating_pages(cl.contact_mentions(parsed(d))))
query("X18_image_urls", "page_id long, images string", f"SELECT page_id, {_ORIGIN} || '/logo' || CAST(page_id % 9 AS VARCHAR) || '.png|' || {_ORIGIN} || '/foto.png' AS images FROM {{html_pages}}")(
    lambda d: pf.image_urls(parsed(d)).select("page_id", F.array_join("images", "|").alias("images")))
query("A13_A14_element_counts", "page_id long, forms long, images long, images_without_alt long, has_map_embed boolean", """
    SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 1 ELSE 0 END AS forms, 3 AS images, 2 AS images_without_alt, page_id % 4 = 0 AS has_map_embed FROM {html_pages}""")(
    lambda d: pf.with_structure_facts(parsed(d)))
query("A16_site_emails", "site_id long, emails string", """SELECT site_id, string_agg('ventas' || CAST(page_id AS VARCHAR) || '@neg.cl', '|' ORDER BY page_id) AS emails FROM {html_pages} GROUP BY 1""")(
    lambda d: pf.merge_page_lists(pf.with_contact_facts(parsed(d).withColumn("visible_text", F.lit(""))).withColumn("page_order", F.col("page_id")), "emails").select("site_id", F.array_join("emails", "|").alias("emails")))

# ------------------------------------------------------------------ J16-J18, U9, W14
query("J16_broken_links", "page_id long, url string, reason string", """
    WITH last AS (SELECT site_id, arg_max(status, attempt) AS status FROM (SELECT site_id, attempt, coalesce(status, 599) AS status FROM {attempts}) x GROUP BY 1)
    SELECT DISTINCT event_id AS page_id, 'u' || CAST(e.user_id AS VARCHAR) AS url, 'La web responde con error ' || status AS reason FROM {events} e JOIN last ON last.site_id = e.user_id WHERE status >= 400""")(
    lambda d: cl.broken_links(
        d.events.select(F.col("event_id").alias("page_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("url")),
        d.attempts.select(F.concat(F.lit("u"), F.col("site_id").cast("string")).alias("url"), "attempt", F.when(
            F.coalesce("status", F.lit(599)) >= 400, F.concat(F.lit("La web responde con error "), F.coalesce("status", F.lit(599)).cast("string"))).alias("reason"))))


def _redirects(d: Inputs) -> DataFrame:
    k = F.col("c_custkey")
    ahead = F.concat(F.lit("/c"), (k - 1).cast("string"))
    refreshing = k % 8 == 3  # every eighth address answers with a page that refreshes itself
    return d.dealt.customer.select(
        F.concat(F.lit("https://wa.link/c"), k.cast("string")).alias("url"),
        F.when(k % 8 == 0, F.concat(F.lit("https://api.whatsapp.com/send?phone=569"), (30000000 + k).cast("string"))).when((k % 8 < 7) & ~refreshing, ahead).alias("location"),
        F.when(refreshing, F.concat(F.lit('<html><head><meta http-equiv="Refresh" content="0; url='), ahead, F.lit('"></head></html>'))).alias("body"),
        F.when(refreshing, 200).otherwise(302).alias("status"))


query("J17_short_links", "url string, final_url string", """SELECT 'https://wa.link/c' || CAST(c_custkey AS VARCHAR) AS url, CASE WHEN c_custkey % 8 <= 6 THEN
    'https://api.whatsapp.com/send?phone=569' || CAST(30000000 + c_custkey - c_custkey % 8 AS VARCHAR) END AS final_url FROM {customer}""")(
    lambda d: cl.resolve_short_links(_redirects(d).select("url"), _redirects(d)))
query("J17_short_link_candidates", "page_id long, outcome string, number string, evidence string", """WITH s AS (SELECT page_id, 'https://wa.link/c' || CAST(page_id AS VARCHAR) AS e FROM {html_pages} WHERE page_id % 17 = 0)
    SELECT page_id, CASE WHEN page_id % 8 <= 6 THEN 'candidate' ELSE 'ignored' END AS outcome, CASE WHEN page_id % 8 <= 6 THEN '569' || CAST(30000000 + page_id - page_id % 8 AS VARCHAR) END AS number,
      CASE WHEN page_id % 8 <= 6 THEN e || ' → https://api.whatsapp.com/send?phone=569' || CAST(30000000 + page_id - page_id % 8 AS VARCHAR) ELSE e END AS evidence FROM s""")(
    lambda d: _resolved(d))


def _resolved(d: Inputs) -> DataFrame:
    short = cut_lineage(cl.page_shortlinks(cl.contact_mentions(parsed(d))))  # read twice
    return cl.shortlink_candidates(short, cl.resolve_short_links(short, _redirects(d)))


query("J18_own_site_of_link_page", "page_id long, own_site string", f"""WITH {CHAIN}, k AS (SELECT CAST(floor(url_id / 20) AS BIGINT) AS page_id, url_id, target, site, kind FROM kinds WHERE kind = 'web_propia' AND site <> 'linktr.ee')
    SELECT page_id, arg_min(target, url_id) AS own_site FROM k GROUP BY 1""")(
    lambda d: site_status.own_site_of_link_page(ur.with_link_kind(ur.with_unwrapped(
        d.urls.select(F.floor(F.col("url_id") / 20).alias("page_id"), F.col("url_id").alias("position"), "url", F.lit("https://linktr.ee/x").alias("page_url")), "url", "link"), "link", "kind")))
query("U9_united_extractions", "site_id long, source string, number string, placement string", """
    WITH c AS (SELECT site_id, number, placement, rank() OVER (PARTITION BY site_id, number ORDER BY CASE placement WHEN 'flotante' THEN 0 ELSE 2 END) AS k FROM (
      SELECT site_id, '569' || CAST(30000000 + page_id * 7 AS VARCHAR) AS number, 'footer' AS placement FROM {html_pages}
      UNION ALL SELECT site_id, '569' || CAST(50000000 + page_id AS VARCHAR), 'flotante' FROM {html_pages} WHERE page_id % 7 = 0) x)
    SELECT DISTINCT site_id, 'web' AS source, number, placement FROM c WHERE k = 1""")(
    lambda d: cl.merge_candidates(cl.page_candidates(cl.contact_mentions(parsed(d))).join(d.html_pages.select("page_id", "site_id"), "page_id").withColumn(
        "arrival", F.struct("page_id", "arrival"))))
_INNER = """SELECT o_custkey AS site_id, o_orderkey AS position, 'https://neg.cl/' || CASE o_orderkey % 7 WHEN 0 THEN 'contacto/' WHEN 1 THEN 'Servicios/a' || CAST(o_orderkey % 50 AS STRING) WHEN 2 THEN 'nosotros'
      WHEN 3 THEN 'blog/x' WHEN 4 THEN 'servicios.pdf' WHEN 5 THEN 'ubicación/' ELSE '' END AS link FROM {orders}"""
query("W14_inner_pages", "site_id long, rank long, link string", f"""WITH l AS ({_INNER.replace('STRING', 'VARCHAR')}), p AS (SELECT *, rtrim(lower(strip_accents(substr(link, 15))), '/') AS path FROM l),
      r AS (SELECT *, CASE WHEN regexp_matches(path, 'contact|ubicacion') THEN 0 WHEN regexp_matches(path, 'servicio') THEN 1 WHEN regexp_matches(path, 'nosotros') THEN 2 END AS pr FROM p WHERE path <> '' AND path NOT LIKE '%.pdf'),
      o AS (SELECT site_id, path, pr, arg_min(link, position) AS link FROM r WHERE pr IS NOT NULL GROUP BY 1, 2, 3)
    SELECT site_id, row_number() OVER (PARTITION BY site_id ORDER BY pr, length(path), link) AS rank, link FROM o""")(
    lambda d: site_status.pick_inner_pages(d.spark.sql(_INNER, orders=d.orders).withColumn("home_url", F.lit("https://neg.cl/"))))
