"""Join keys and scalar functions (F*, D1-D3, J12-J15)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions import phones as ph
from leadweave.functions import text as tx
from leadweave.functions import urls as ur
from leadweave.operators import identity
from leadweave.plans.inputs import Inputs
from leadweave.plans.registry import query

_URL = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"
_UNWRAP = r"""CASE WHEN regexp_matches({u}, '^(https?://([^/?#]*\.)?google\.[a-z]{{2,3}}(\.[a-z]{{2}})?)?/url\?')
    THEN coalesce(nullif(url_decode(replace(regexp_extract({u}, '[?&](q|url)=([^&#]+)', 2), '+', ' ')), ''), {u}) ELSE {u} END"""
# The chain of F1, F2, F3 and F6 in SQL, step by step, over the url view.
CHAIN = f"""
  u0 AS (SELECT url_id, form, url, trim(url) AS t FROM {{urls}}),
  u1 AS (SELECT *, {_UNWRAP.format(u='t')} AS t1 FROM u0),
  u2 AS (SELECT *, {_UNWRAP.format(u='t1')} AS t2 FROM u1),
  u3 AS (SELECT *, {_UNWRAP.format(u='t2')} AS target FROM u2),
  n1 AS (SELECT *, CASE WHEN starts_with(target, '//') THEN 'https:' || target WHEN regexp_matches(target, '(?i)^[a-z][a-z0-9+.-]*:') THEN target
      WHEN regexp_matches(target, '^[\\w-]+(\\.[\\w-]+)+(/|$)') THEN 'https://' || target END AS a FROM u3),
  n2 AS (SELECT *, lower(regexp_extract(a, '{_URL}', 1)) AS scheme, lower(split_part(regexp_extract(a, '{_URL}', 2), ':', 1)) AS host,
      CASE WHEN contains(regexp_extract(a, '{_URL}', 2), ':') THEN split_part(regexp_extract(a, '{_URL}', 2), ':', 2) ELSE '' END AS port,
      regexp_extract(a, '{_URL}', 3) AS path,
      array_to_string([split_part(x, '=', 1) || '=' || url_encode(url_decode(substr(x, length(split_part(x, '=', 1)) + 2))) for x in string_split(regexp_extract(a, '{_URL}', 4), '&') if x <> '' AND NOT regexp_matches(x, '^(utm_|fbclid|gclid)')], '&') AS q FROM n1),
  n3 AS (SELECT *, CASE WHEN scheme IN ('http', 'https') AND host <> '' THEN scheme || '://' || host || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END
      || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS normal, regexp_replace(host, '^www\\.', '') AS site FROM n2),
  soc AS (SELECT *, [x for x in string_split(CASE WHEN path = '' THEN '/' ELSE path END, '/') if x <> ''] AS seg,
      CASE WHEN host = 'instagram.com' OR host LIKE '%.instagram.com' THEN 'instagram' WHEN host = 'facebook.com' OR host LIKE '%.facebook.com' THEN 'facebook'
           WHEN host = 'youtube.com' OR host LIKE '%.youtube.com' THEN 'youtube' END AS net FROM n3),
  prof AS (SELECT *, CASE WHEN normal IS NULL OR net IS NULL OR len(seg) = 0 THEN NULL
      WHEN net = 'facebook' AND seg[1] = 'profile.php' THEN 'https://www.facebook.com/profile.php?id=' || regexp_extract(q, '(^|&)id=(\\d+)', 2)
      WHEN seg[1] IN ('p', 'reel', 'sharer', 'sharer.php', 'watch', 'embed') THEN NULL
      WHEN net = 'youtube' AND seg[1] = 'channel' THEN 'https://www.youtube.com/channel/' || seg[2]
      WHEN net = 'instagram' THEN 'https://www.instagram.com/' || lower(seg[1]) ELSE 'https://www.' || net || '.com/' || seg[1] END AS profile FROM soc),
  kinds AS (SELECT *, CASE WHEN normal IS NULL THEN 'invalido'
      WHEN site IN ('wa.me', 'api.whatsapp.com', 'web.whatsapp.com', 'wa.link', 'walink.co', 'chat.whatsapp.com') THEN 'whatsapp'
      WHEN site IN ('linktr.ee', 'beacons.ai') THEN 'agregador' WHEN profile IS NOT NULL THEN 'red_social'
      WHEN site IN ('maps.google.com', 'maps.app.goo.gl', 'g.page', 'g.co') OR (regexp_matches(site, '(^|\\.)google\\.[a-z]+$') AND starts_with(path, '/maps')) THEN 'google'
      ELSE 'web_propia' END AS kind,
      CASE WHEN site = 'linktr.ee' THEN CASE WHEN len(seg) > 0 THEN site || '/' || lower(seg[1]) END
           WHEN site = 'sites.google.com' THEN site || '/' || lower(array_to_string(seg[1:2], '/'))
           WHEN site = 'google.com' THEN site || '/' || lower(array_to_string(seg[1:2], '/'))
           WHEN site LIKE '%.wixsite.com' THEN site || '/' || lower(seg[1]) ELSE nullif(site, '') END AS key FROM prof)
"""
query("F1_unwrap_redirect", "url_id long, target string", f"WITH {CHAIN} SELECT url_id, target FROM u3")(
    lambda d: ur.with_unwrapped(d.urls, "url", "target"))
query("F2_normalize_url", "url_id long, normal string", f"WITH {CHAIN} SELECT url_id, normal FROM n3")(
    lambda d: ur.with_normalized(ur.with_unwrapped(d.urls, "url", "target"), "target", "normal"))
query("F3_link_kind", "url_id long, kind string", f"WITH {CHAIN} SELECT url_id, kind FROM kinds")(lambda d: ur.with_link_kind(d.urls, "url", "kind"))
query("F4_place_key", "url_id long, place string", """SELECT url_id, CASE WHEN regexp_extract(url, '!1s(0x[0-9A-Fa-f]+:0x[0-9A-Fa-f]+)', 1) <> ''
      THEN 'ftid:' || lower(regexp_extract(url, '!1s(0x[0-9A-Fa-f]+:0x[0-9A-Fa-f]+)', 1))
      WHEN regexp_extract(url, '[?&]cid=(\\d+)', 1) <> '' THEN 'cid:' || regexp_extract(url, '[?&]cid=(\\d+)', 1) END AS place FROM {urls}""")(
    lambda d: d.urls.select("url_id", ur.place_key("url").alias("place")))
query("F5_canonical_place_url", "url_id long, canonical string", f"""WITH {CHAIN}, c AS (
      SELECT url_id, lower(split_part(regexp_extract(target, '{_URL}', 2), ':', 1)) AS h, regexp_extract(target, '{_URL}', 3) AS p, regexp_extract(target, '{_URL}', 4) AS q FROM u3),
    k AS (SELECT *, array_to_string([x for x in string_split(q, '&') if regexp_matches(x, '^(cid|q|query|query_place_id|ftid)=.')], '&') AS kept FROM c)
    SELECT url_id, CASE WHEN regexp_matches(h, '(^|\\.)google\\.[a-z]{{2,3}}(\\.[a-z]{{2}})?$') THEN 'https://www.google.com' || regexp_replace(p, '/@-?[0-9.]+,-?[0-9.]+(,[0-9.]+[a-z]?)*', '')
        || CASE WHEN kept = '' THEN '' ELSE '?' || kept END
      WHEN h = '' THEN 'https:' || p || CASE WHEN q = '' THEN '' ELSE '?' || q END ELSE 'https://' || h || p || CASE WHEN q = '' THEN '' ELSE '?' || q END END AS canonical FROM k""")(
    lambda d: ur.with_canonical_place_url(d.urls, "url", "canonical"))
query("F6_J13_site_key", "url_id long, key string", f"WITH {CHAIN} SELECT url_id, CASE WHEN normal IS NULL THEN NULL ELSE key END AS key FROM kinds")(
    lambda d: ur.with_site_key(d.urls, "url", "key"))
query("F7_F10_number_key", "id long, number_key string", r"""
    SELECT id, CASE WHEN length(g) >= 8 THEN CASE WHEN regexp_full_match(g, '521\d{10}') THEN '52' || substr(g, 4)
      WHEN regexp_full_match(g, '549\d{10}') THEN '54' || substr(g, 4) ELSE g END END AS number_key
    FROM (SELECT id, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM {phones}) AS p""")(
    lambda d: d.phones.select("id", ph.number_key("raw").alias("number_key")))
query("F8_J12_social_profile", "url_id long, network string, profile string", f"""WITH {CHAIN}
    SELECT url_id, CASE WHEN profile IS NOT NULL THEN net END AS network, profile FROM prof""")(
    lambda d: ur.with_social(ur.with_normalized(ur.with_unwrapped(d.urls, "url", "t"), "t", "n"), "n", "s").select(
        "url_id", F.col("s_network").alias("network"), F.col("s_profile").alias("profile")))
query("F9_link_digits", "url_id long, digits string, shown string", r"""SELECT url_id, nullif(regexp_extract(url, '(wa\.me/|phone=)\+?(\d{8,})', 2), '') AS digits,
    nullif(regexp_extract(url, 'wa\.me/(\d+)', 1), '') AS shown FROM {urls}""")(
    lambda d: d.urls.select("url_id", ur.contact_link_digits("url").alias("digits"), ur.shown_link_digits("url").alias("shown")))
# The plan rules in SQL, for the number shapes of the derived input.
_E164 = r"""CASE id % 12 WHEN 0 THEN '+' || g WHEN 1 THEN '+56' || g WHEN 2 THEN '+56' || g WHEN 3 THEN '+' || g WHEN 4 THEN '+52' || substr(g, 4)
    WHEN 5 THEN '+' || g WHEN 6 THEN CASE WHEN regexp_full_match(g, '1305555\d{4}') THEN '+' || g END WHEN 7 THEN '+' || g WHEN 11 THEN '+' || g END"""
_PHONES = f"p AS (SELECT id, raw, {_E164} AS e164 FROM (SELECT id, raw, regexp_replace(raw, '[^0-9]', '', 'g') AS g FROM {{phones}}) AS x)"
query("F11_normalize_phone", "id long, e164 string", f"WITH {_PHONES} SELECT id, e164 FROM p")(
    lambda d: d.phones.select("id", ph.normalize_phone("raw").alias("e164")))
query("F12_F13_mobile_region", "id long, mobile boolean, region string", f"""WITH {_PHONES} SELECT id,
      coalesce(e164 LIKE '+569%' OR e164 LIKE '+549%' OR e164 LIKE '+52%' OR e164 LIKE '+1%' OR e164 LIKE '+346%', false) AS mobile,
      CASE WHEN e164 LIKE '+56%' THEN 'CL' WHEN e164 LIKE '+54%' THEN 'AR' WHEN e164 LIKE '+52%' THEN 'MX' WHEN e164 LIKE '+1%' THEN 'US'
           WHEN e164 LIKE '+34%' THEN 'ES' ELSE 'CL' END AS region FROM p""")(
    lambda d: d.phones.select("id", ph.normalize_phone("raw").alias("e")).select("id", ph.is_probable_mobile("e").alias("mobile"), ph.phone_region("e").alias("region")))
query("F14_pretty_number", "id long, shown string", f"""WITH {_PHONES}, g AS (SELECT id, substr(e164, 2) AS g FROM p) SELECT id, CASE
      WHEN g LIKE '569%' THEN '+56 9 ' || substr(g, 4, 4) || ' ' || substr(g, 8)
      WHEN g LIKE '56%' THEN '+56 ' || substr(g, 3, 2) || ' ' || substr(g, 5, 3) || ' ' || substr(g, 8)
      WHEN g LIKE '549%' THEN '+54 9 ' || substr(g, 4, 2) || ' ' || substr(g, 6, 4) || '-' || substr(g, 10)
      WHEN g LIKE '52%' THEN '+52 ' || substr(g, 3, 2) || ' ' || substr(g, 5, 4) || ' ' || substr(g, 9)
      WHEN g LIKE '1%' THEN '+1 ' || substr(g, 2, 3) || '-' || substr(g, 5, 3) || '-' || substr(g, 8)
      WHEN g LIKE '34%' THEN '+34 ' || substr(g, 3, 3) || ' ' || substr(g, 6, 2) || ' ' || substr(g, 8, 2) || ' ' || substr(g, 10) END AS shown FROM g""")(
    lambda d: d.phones.select("id", ph.normalize_phone("raw").alias("e")).select("id", ph.pretty_number("e").alias("shown")))
query("F15_phone_from_tel", "id long, e164 string", f"""WITH {_PHONES} SELECT id, CASE WHEN id % 7 = 0 THEN NULL ELSE e164 END AS e164 FROM p""")(
    lambda d: d.phones.select("id", F.concat(
        F.when(F.col("id") % 7 == 0, "fax:").when(F.col("id") % 2 == 0, "TEL:").otherwise("callto:"),
        F.replace(F.replace("raw", F.lit("+"), F.lit("%2B")), F.lit(" "), F.lit("%20")), F.lit("?x=1")).alias("href")
    ).select("id", ph.phone_from_tel("href").alias("e164")))
query("F16_contact_number", "id long, number string, broken boolean, noted boolean", f"""WITH {_PHONES}, c AS (
      SELECT id, regexp_replace(raw, '[^0-9]', '', 'g') AS g, CASE WHEN id % 12 = 6 AND NOT regexp_full_match(regexp_replace(raw, '[^0-9]', '', 'g'), '1305555\\d{{4}}') THEN NULL ELSE e164 END AS e164 FROM p)
    SELECT id, CASE WHEN e164 IS NULL THEN NULL WHEN g LIKE '521%' THEN g ELSE substr(e164, 2) END AS number,
      CASE WHEN e164 IS NULL THEN NULL ELSE id % 12 IN (1, 2) END AS broken,
      e164 IS NOT NULL AND id % 12 IN (1, 2) AS noted FROM c""")(
    lambda d: ph.with_contact_number(d.phones, "raw", "c").select("id", F.col("c_number").alias("number"), F.col("c_broken").alias("broken"), F.col("c_note").isNotNull().alias("noted")))
# Numbers of the customers of each nation: region, digits before the tail as written abroad and at home, tail length, mobile, shown pieces of the tail.
_NATIONAL = [
    ("PE", "+519", "9", 8, True, "+51 9", (2, " ", 3, " ", 3)), ("PE", "+511", "01", 7, False, "+51 1 ", (7,)), ("CO", "+573", "3", 9, True, "+57 3", (2, " ", 7)),
    ("CO", "+57601", "601", 7, False, "+57 601 ", (7,)), ("BR", "+55119", "0119", 8, True, "+55 11 9", (4, "-", 4)), ("BR", "+55213", "0213", 7, False, "+55 21 3", (3, "-", 4)),
    ("UY", "+59894", "094", 6, True, "+598 94 ", (3, " ", 3)), ("PY", "+595981", "0981", 6, True, "+595 981 ", (6,)), ("BO", "+5917", "7", 7, True, "+591 7", (7,)),
    ("EC", "+59399", "099", 7, True, "+593 99 ", (3, " ", 4)), ("VE", "+58412", "0412", 7, True, "+58 412-", (7,)), ("CR", "+50688", "88", 6, True, "+506 88", (2, " ", 4)),
    ("PA", "+5076", "6", 7, True, "+507 6", (3, "-", 4)), ("GT", "+5025", "5", 7, True, "+502 5", (3, " ", 4)), ("SV", "+5037", "7", 7, True, "+503 7", (3, " ", 4)),
    ("HN", "+5049", "9", 7, True, "+504 9", (3, "-", 4)), ("NI", "+5058", "8", 7, True, "+505 8", (3, " ", 4)), ("FR", "+336", "06", 8, True, "+33 6 ", (2, " ", 2, " ", 2, " ", 2)),
    ("IT", "+39347", "347", 7, True, "+39 347 ", (3, " ", 4)), ("IT", "+3906", "06", 8, False, "+39 06 ", (4, " ", 4)), ("GB", "+4474", "074", 8, True, "+44 74", (2, " ", 6)),
    ("GB", "+4420", "020", 8, False, "+44 20 ", (4, " ", 4)), ("DE", "+49151", "0151", 8, True, "+49 151", (1, " ", 7)), ("PT", "+35191", "91", 7, True, "+351 91", (1, " ", 3, " ", 3)),
    ("CA", "+1416", "416", 7, True, "+1 416-", (3, "-", 4)),
]


def _tail(row: tuple) -> str:
    return f"lpad(CAST(c_custkey % {10 ** row[3]} AS STRING), {row[3]}, '0')"


def _pieces(row: tuple) -> str:
    at, parts = 1, [f"'{row[5]}'"]
    for piece in row[6]:
        parts.append(f"'{piece}'" if isinstance(piece, str) else f"substr({_tail(row)}, {at}, {piece})")
        at += 0 if isinstance(piece, str) else piece
    return " || ".join(parts)


def _by_nation(shape: Callable[[tuple], str]) -> str:
    return "CASE c_nationkey " + " ".join(f"WHEN {n} THEN {shape(row)}" for n, row in enumerate(_NATIONAL)) + " END"


# A Canadian tail that begins with 0 or 1 is no number: it stays NULL.
_NO_NUMBER = f"c_nationkey = 24 AND {_tail(_NATIONAL[24])} < '2'"
query("F11_F12_F13_F14_F16_number_plan", "id long, e164 string, region string, mobile boolean, shown string, link_number string, broken boolean", f"""
    WITH n AS (SELECT c_custkey AS id, {_by_nation(lambda r: f"'{r[1]}' || " + _tail(r))} AS e164, {_by_nation(lambda r: f"'{r[0]}'")} AS region,
      {_by_nation(lambda r: str(r[4]).lower())} AS mobile, {_by_nation(_pieces)} AS shown, {_NO_NUMBER} AS none FROM {{customer}})
    SELECT id, CASE WHEN NOT none THEN e164 END AS e164, CASE WHEN none THEN 'ZZ' ELSE region END AS region, mobile AND NOT none AS mobile, CASE WHEN NOT none THEN shown END AS shown,
      CASE WHEN NOT none THEN substr(e164, 2) END AS link_number, CASE WHEN NOT none THEN false END AS broken FROM n""")(lambda d: _number_plan(d))


def _number_plan(d: Inputs) -> DataFrame:
    """Even customers write their number as at home (with the trunk digit), odd ones as from abroad."""
    abroad, home = (F.expr(_by_nation(lambda r, i=i: f"'{r[i]}' || " + _tail(r))) for i in (1, 2))
    numbers = d.customer.select(
        F.col("c_custkey").alias("id"), F.expr(_by_nation(lambda r: f"'{r[0]}'")).alias("home"), F.when(F.col("c_custkey") % 2 == 0, home).otherwise(abroad).alias("raw"),
        F.concat(F.lit("https://wa.me/"), F.regexp_replace(abroad, "[+]", "")).alias("link"))
    numbers = numbers.withColumn("e164", ph.normalize_phone("raw", F.col("home"))).withColumn("digits", F.regexp_extract("link", r"(\d+)$", 1))
    return ph.with_contact_number(numbers, "digits", "c", F.col("home")).select(
        "id", "e164", ph.phone_region("e164", "ZZ").alias("region"), ph.is_probable_mobile("e164").alias("mobile"), ph.pretty_number("e164").alias("shown"),
        F.col("c_number").alias("link_number"), F.col("c_broken").alias("broken"))


query("F17_fold_accents", "doc_id long, folded string", "SELECT doc_id, strip_accents(text) AS folded FROM {documents}")(
    lambda d: d.documents.select("doc_id", tx.fold_accents("text").alias("folded")))
query("F18_address_locality", "id long, locality string", "SELECT id, city AS locality FROM {businesses}")(
    lambda d: d.businesses.select("id", tx.address_locality("address").alias("locality")))
query("F19_rating_reviews_labels", "id long, rating double, reviews long", "SELECT id, rating, review_count AS reviews FROM {businesses}")(
    lambda d: d.businesses.select("id", F.concat(F.replace(F.col("rating").cast("string"), F.lit("."), F.lit(",")), F.lit(" estrellas ")).alias("a"),
                                  F.concat(F.regexp_replace(F.col("review_count").cast("string"), r"(\d)(?=(\d{3})$)", "$1."), F.lit(" reseñas")).alias("b")
                                  ).select("id", tx.rating_from_label("a").alias("rating"), tx.reviews_from_label("b").alias("reviews")))
query("F20_copyright_years", "id long, years string", """SELECT id, CASE id % 4 WHEN 0 THEN CAST(2010 + id % 15 AS VARCHAR) WHEN 1 THEN CAST(2001 + id % 20 AS VARCHAR)
      WHEN 2 THEN CAST(2000 + id % 25 AS VARCHAR) ELSE '' END AS years FROM {businesses}""")(
    lambda d: d.businesses.select("id", F.when(F.col("id") % 4 == 0, F.concat(F.lit("© 1999 - "), (2010 + F.col("id") % 15).cast("string"), F.lit(" Neg")))
                                  .when(F.col("id") % 4 == 1, F.concat(F.lit("Todos los derechos reservados "), (2001 + F.col("id") % 20).cast("string")))
                                  .when(F.col("id") % 4 == 2, F.concat((2000 + F.col("id") % 25).cast("string"), F.lit(" · Derechos Reservados")))
                                  .otherwise("Fundada en 1998").alias("text")).select("id", F.array_join(tx.copyright_years("text").cast("array<string>"), ",").alias("years")))
query("F21_W15_snippets", "doc_id long, snippet string", r"""
    WITH l AS (SELECT doc_id, text AS line, strpos(lower(text), 'the') AS pos FROM {documents} WHERE strpos(lower(text), 'the') > 0)
    SELECT doc_id, CASE WHEN length(line) <= 160 THEN line ELSE CASE WHEN pos - 1 - 80 > 0 THEN '…' ELSE '' END
      || trim(substr(line, CAST(greatest(pos - 1 - 80, 0) + 1 AS BIGINT), 160), ' ') || '…' END AS snippet FROM l""")(
    lambda d: d.documents.filter(F.col("text").rlike("(?i)the")).select("doc_id", tx.snippet(F.col("text"), "(?i)the").alias("snippet")))
query("F22_F23_F24_page_texts", "doc_id long, dead string, wall boolean, thin boolean", """
    WITH t AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'Este dominio está a la venta' WHEN 1 THEN 'Sitio en construcción' WHEN 2 THEN 'Just a moment...' ELSE 'Inicio' END AS title, text FROM {documents})
    SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'El dominio está a la venta' WHEN doc_id % 5 = 1 AND length(text) <= 400 THEN 'La web está en construcción o en mantenimiento' END AS dead,
      doc_id % 5 = 2 AS wall, length(trim(text)) < 200 AS thin FROM t""")(
    lambda d: d.documents.withColumn("title", F.when(F.col("doc_id") % 5 == 0, "Este dominio está a la venta").when(F.col("doc_id") % 5 == 1, "Sitio en construcción")
                                     .when(F.col("doc_id") % 5 == 2, "Just a moment...").otherwise("Inicio")).select(
        "doc_id", tx.dead_site_reason("title", "text").alias("dead"), tx.is_bot_wall("title", "text").alias("wall"), tx.needs_render("text").alias("thin")))
_MESSAGES = ["net::ERR_NAME_NOT_RESOLVED at x", "Target closed", "Executable doesn't exist", "boom\nsecond line", "Connection refused", "CDP lost", "SSL handshake", "Timeout 30000ms"]


def _message():
    return F.element_at(F.array(*[F.lit(m) for m in _MESSAGES]), (F.col("event_id") % len(_MESSAGES) + 1).cast("int"))




def _words(values: list[str]) -> str:
    return "CASE event_id % 8 " + " ".join("WHEN {} THEN '{}'".format(i, v.replace("'", "''")) for i, v in enumerate(values)) + " END"


query("F25_error_reasons", "event_id long, friendly string, connect string, browser string", f"""SELECT event_id,
      {_words([fv.FRIENDLY_ERRORS[1][1], fv.FRIENDLY_ERRORS[0][1], fv.FRIENDLY_ERRORS[2][1], 'E: boom', 'E: Connection refused', fv.FRIENDLY_ERRORS[3][1], 'E: SSL handshake', 'E: Timeout 30000ms'])} AS friendly,
      {_words([fv.NO_CONNECTION_REASON] * 4 + [fv.REFUSED_REASON] + [fv.NO_CONNECTION_REASON] * 3)} AS connect,
      {_words([fv.DNS_REASON] + [fv.BROWSER_REASON] * 5 + [fv.TLS_REASON, fv.LOAD_TIMEOUT_REASON])} AS browser FROM {{events}}""")(
    lambda d: d.events.withColumn("m", _message()).select("event_id", tx.friendly_error(F.lit("E"), "m").alias("friendly"), tx.connect_reason("m").alias("connect"),
                                                          tx.browser_error_reason("m").alias("browser")))
query("F28_provenance_text", "id long, shown string, listed string", """SELECT id, CASE id % 3 WHEN 0 THEN 'Google Maps' WHEN 1 THEN 'su web' ELSE city END AS shown,
      CASE WHEN id % 2 = 0 THEN 'ninguno' ELSE city || ' · ' || category END AS listed FROM {businesses}""")(
    lambda d: d.businesses.select(
        "id", tx.provenance_text(F.when(F.col("id") % 3 == 0, "maps").when(F.col("id") % 3 == 1, "web").otherwise(F.col("city"))).alias("shown"),
        tx.provenance_list_text(F.when(F.col("id") % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("city", "category"))).alias("listed")))
query("F29_collapse_spaces", "doc_id long, clean string", r"SELECT doc_id, nullif(trim(regexp_replace(text, '\s+', ' ', 'g')), '') AS clean FROM {documents}")(
    lambda d: d.documents.select("doc_id", tx.collapse_spaces("text").alias("clean")))
query("F30_scan_variants", "url_id long, variants string", """SELECT url_id, CASE WHEN url_decode(replace(url, '&amp;', '&')) <> url THEN url || '|' || url_decode(url) ELSE url END AS variants
    FROM {urls}""")(
    lambda d: d.urls.select("url_id", F.array_join(tx.scan_variants(F.replace("url", F.lit("&"), F.lit("&amp;"))), "|").alias("variants")))
query("F31_same_site", "url_id long, same boolean", f"WITH {CHAIN} SELECT url_id, coalesce(site = 'linktr.ee', false) AS same FROM n3")(
    lambda d: ur.with_normalized(ur.with_unwrapped(d.urls, "url", "t"), "t", "n").select("url_id", ur.same_site("n", F.lit("linktr.ee")).alias("same")))
query("F32_block_reason", "doc_id long, reason string", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Google mostró su página de verificación (captcha).'
      WHEN doc_id % 3 = 1 THEN 'Google mostró un aviso de bloqueo ("Tráfico Inusual").' END AS reason FROM {documents}""")(
    lambda d: d.documents.select("doc_id", tx.block_reason(
        F.when(F.col("doc_id") % 3 == 0, "https://www.google.com/sorry/index").otherwise("https://www.google.com/maps"),
        F.when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Tráfico Inusual "), "text")).otherwise(F.col("text"))).alias("reason")))
query("J14_J15_hosts", "url_id long, builder string, login string, status_text string", """SELECT url_id, CASE WHEN form = 16 THEN 'Wix' WHEN form = 13 THEN 'Google Sites' END AS builder,
      CASE WHEN url_id % 3 = 0 THEN 'La web no es pública: pide iniciar sesión en Google, así que los clientes no pueden verla' END AS login,
      'La web responde con error ' || CASE url_id % 3 WHEN 0 THEN '404 (página no encontrada)' WHEN 1 THEN '503 (servidor caído o en mantenimiento)' ELSE '599 (error del servidor)' END AS status_text
    FROM {urls}""")(
    lambda d: d.urls.select(
        "url_id", ur.suffix_lookup(ur.url_host("url"), fv.BUILDER_HOSTS).alias("builder"),
        ur.login_wall_reason(F.when(F.col("url_id") % 3 == 0, "https://accounts.google.com/v3/x").otherwise("https://sites.google.com/view/x")).alias("login"),
        tx.http_error_reason(F.when(F.col("url_id") % 3 == 0, 404).when(F.col("url_id") % 3 == 1, 503).otherwise(599)).alias("status_text")))

# ------------------------------------------------------------------ D1-D3, W18
query("D1_link_prints", "url_id long, kind string, value string", f"""WITH {CHAIN}, p AS (SELECT url_id, kind, CASE kind
      WHEN 'whatsapp' THEN coalesce(regexp_replace(nullif(regexp_extract(target, '(wa\\.me/|phone=)(\\d{{8,}})', 2), ''), '^521(\\d{{10}})$', '52\\1'), lower(nullif(regexp_extract(target, 'wa\\.me/message/[^/?#\\s]+', 0), '')))
      WHEN 'red_social' THEN lower(profile) WHEN 'web_propia' THEN key WHEN 'agregador' THEN key END AS value FROM kinds)
    SELECT url_id, CASE WHEN value IS NULL THEN NULL WHEN kind = 'red_social' THEN 'red' WHEN kind = 'whatsapp' AND value NOT LIKE 'wa.me%' THEN 'numero' ELSE 'web' END AS kind, value FROM p""")(
    lambda d: ur.with_link_print(d.urls, "url", "p").select("url_id", F.col("p_kind").alias("kind"), F.col("p_value").alias("value")))
# Fingerprints of the derived businesses in SQL (shapes are known by construction).
PRINTS_SQL = """
  raw_prints AS (
    SELECT id, 'numero' AS kind, substr(phone_e164, 2) AS value, 0 AS slot FROM {businesses} WHERE phone_e164 IS NOT NULL
    UNION ALL SELECT id, 'numero', regexp_extract(whatsapp_url, 'wa.me/([0-9]{8,})', 1), 1 FROM {businesses} WHERE whatsapp_url LIKE '%wa.me/569%'
    UNION ALL SELECT id, CASE WHEN website LIKE '%instagram%' THEN 'red' ELSE 'web' END,
      CASE WHEN website LIKE '%instagram%' THEN lower(rtrim(website, '/')) WHEN website LIKE '%linktr.ee%' THEN lower(substr(website, 9))
           ELSE regexp_extract(website, 'www\\.(n[0-9]+\\.cl)', 1) END, 10 FROM {businesses} WHERE website IS NOT NULL
    UNION ALL SELECT id, 'web', lower(substr(website_maps, 9)), 11 FROM {businesses} WHERE website_maps IS NOT NULL
    UNION ALL SELECT id, 'red', lower(rtrim(instagram, '/')), 20 FROM {businesses} WHERE instagram IS NOT NULL
    UNION ALL SELECT id, 'red', lower('https://www.facebook.com/' || substr(facebook, 24)), 21 FROM {businesses} WHERE facebook IS NOT NULL),
  prints AS (SELECT id, kind, value, min(CASE kind WHEN 'numero' THEN 0 WHEN 'web' THEN 1 ELSE 2 END * 100 + slot) AS ord FROM raw_prints GROUP BY 1, 2, 3)
"""
query("D2_W18_business_prints", "id long, kind string, value string, position long", f"""WITH {PRINTS_SQL}
    SELECT id, kind, value, row_number() OVER (PARTITION BY id ORDER BY ord) AS position FROM prints""")(
    lambda d: _ordered(identity.business_prints(d.businesses_full()), "id"))
query("D3_card_prints", "id long, kind string, value string, position long", f"""WITH {PRINTS_SQL}, c AS (
      SELECT id, kind, value, min(CASE kind WHEN 'numero' THEN 0 WHEN 'web' THEN 1 ELSE 2 END) AS ord FROM raw_prints WHERE slot IN (0, 10) GROUP BY 1, 2, 3)
    SELECT id, kind, value, row_number() OVER (PARTITION BY id ORDER BY ord) AS position FROM c""")(
    lambda d: _ordered(identity.card_prints(d.businesses.select("id", "website", "phone_e164"), "id"), "id"))


def _ordered(prints, owner):
    from pyspark.sql.window import Window as W
    return prints.select(owner, "kind", "value", F.row_number().over(W.partitionBy(owner).orderBy("print_order")).alias("position"))
