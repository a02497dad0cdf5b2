"""Contact fusion, actions, attempts, scores and judgments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions import scoring
from leadweave.operators import actions, contact_links, fusion, judgments, leads, site_status, verification
from leadweave.operators.page_elements import parse_pages
from leadweave.plans.inputs import Inputs
from leadweave.plans.registry import query
from leadweave.session import cut_lineage

_RANKS = """CASE source WHEN 'manual' THEN -1 WHEN 'maps' THEN 0 WHEN 'web' THEN 1 WHEN 'linktree' THEN 2 ELSE 3 END AS sr,
  CASE placement WHEN 'flotante' THEN 0 WHEN 'header' THEN 0 WHEN 'cuerpo' THEN 1 ELSE 2 END AS pr"""
RANKED_SQL = f"""c0 AS (SELECT *, {_RANKS}, CASE WHEN number IS NULL THEN 'https://wa.me/message/M' || CAST(arrival AS VARCHAR) ELSE 'https://wa.me/' || number END AS url,
    'ev' || CAST(arrival AS VARCHAR) AS evidence FROM {{candidates}}),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY sr, number IS NULL, pr, arrival) AS candidate_rank FROM c0)"""
DECISION_SQL = f"""{RANKED_SQL},
  best AS (SELECT * FROM ranked WHERE candidate_rank = 1),
  per AS (SELECT site_id, count(DISTINCT number) AS numbers, bool_or(broken) AS broken FROM ranked GROUP BY 1),
  src AS (SELECT r.site_id, count(DISTINCT r.source) AS n, string_agg(DISTINCT r.source, ',' ORDER BY r.source) AS names FROM ranked r JOIN best b ON b.site_id = r.site_id AND b.number = r.number GROUP BY 1),
  decided AS (SELECT z.id AS site_id, CASE WHEN b.site_id IS NOT NULL THEN 'VERIFICADO' WHEN z.phone_e164 IS NOT NULL THEN 'NO CONFIRMADO' ELSE 'NO ENCONTRADO' END AS whatsapp_status,
      b.url AS whatsapp_url, b.source AS whatsapp_source, b.evidence AS whatsapp_evidence, coalesce(numbers > 1, false) AS whatsapp_multiple_numbers,
      CASE WHEN b.site_id IS NULL THEN NULL WHEN b.source = 'manual' THEN 'ALTA' WHEN b.number IS NULL THEN 'MEDIA' WHEN n >= 2 OR coalesce('+' || b.number = z.phone_e164, false) THEN 'ALTA' ELSE 'MEDIA' END AS whatsapp_confidence,
      coalesce(per.broken, false) AS whatsapp_broken_button, n, coalesce('+' || b.number = z.phone_e164, false) AS same, b.number, src.names
    FROM {{businesses}} z LEFT JOIN best b ON b.site_id = z.id LEFT JOIN per ON per.site_id = z.id LEFT JOIN src ON src.site_id = z.id)"""


def candidates(d: Inputs) -> DataFrame:
    return d.candidates.withColumns({
        "url": F.when(F.col("number").isNull(), F.concat(F.lit("https://wa.me/message/M"), F.col("arrival").cast("string"))).otherwise(F.concat(F.lit("https://wa.me/"), "number")),
        "evidence": F.concat(F.lit("ev"), F.col("arrival").cast("string"))})


def _decide(d: Inputs) -> DataFrame:
    return fusion.decide_contacts(d.businesses.select(F.col("id").alias("site_id"), "phone_e164"), candidates(d))


query("W3_rank_candidates", "site_id long, arrival long, candidate_rank long", f"WITH {RANKED_SQL} SELECT site_id, arrival, candidate_rank FROM ranked")(
    lambda d: fusion.rank_candidates(candidates(d)))
query("W4_merge_candidates", "site_id long, source string, url string, placement string, arrival long", f"""WITH {RANKED_SQL} SELECT site_id, source, url, placement, arrival FROM (
    SELECT *, row_number() OVER (PARTITION BY site_id, source, coalesce(number, lower(url)) ORDER BY pr, arrival) AS k FROM ranked) x WHERE k = 1""")(
    lambda d: contact_links.merge_candidates(candidates(d)))
_DECISION_OUT = ("site_id long, whatsapp_status string, whatsapp_url string, whatsapp_source string, whatsapp_evidence string, whatsapp_multiple_numbers boolean, "
                 "whatsapp_confidence string, whatsapp_broken_button boolean")
query("R2_A8_contact_decision", _DECISION_OUT, f"WITH {DECISION_SQL} SELECT * FROM decided")(_decide)
query("R3_A9_confidence_reason", "site_id long, confidence_reason string", f"""WITH {DECISION_SQL},
    ns AS (SELECT r.site_id, string_agg(w, ' y ' ORDER BY sr) AS words FROM (SELECT DISTINCT r.site_id, r.sr, CASE r.source WHEN 'manual' THEN 'tu confirmación' WHEN 'maps' THEN 'Google Maps'
        WHEN 'web' THEN 'su web' WHEN 'linktree' THEN 'su Linktree' ELSE 'otra fuente' END AS w FROM ranked r JOIN best b ON b.site_id = r.site_id AND b.number = r.number) r GROUP BY 1)
    SELECT d.site_id, CASE WHEN whatsapp_source IS NULL THEN NULL WHEN whatsapp_source = 'manual' THEN 'Confirmado por ti: abriste el chat y el WhatsApp existe.'
      WHEN number IS NULL THEN 'Enlace de WhatsApp sin número visible (wa.me/message).' WHEN n >= 2 THEN 'El mismo número aparece en ' || words || '.'
      WHEN same THEN 'Publicado en ' || words || ' y coincide con el teléfono de la ficha de Maps.' ELSE 'Publicado solo en ' || words || '.' END AS confidence_reason
    FROM decided d LEFT JOIN ns ON ns.site_id = d.site_id""")(_decide)
query("A15_broken_evidence", "site_id long, evidence string, position long", f"""WITH {RANKED_SQL} SELECT site_id, evidence, row_number() OVER (PARTITION BY site_id ORDER BY candidate_rank) AS position
    FROM ranked WHERE broken""")(lambda d: fusion.broken_evidence(candidates(d)))
query("J20_candidate_report", "site_id long, arrival long, number string, source string, placement string", """
    SELECT site_id, arrival, CASE WHEN number IS NOT NULL THEN '+56 9 ' || substr(number, 4, 4) || ' ' || substr(number, 8) END AS number,
      CASE source WHEN 'maps' THEN 'Google Maps' WHEN 'web' THEN 'su web' WHEN 'linktree' THEN 'su Linktree' WHEN 'manual' THEN 'confirmado por ti' ELSE 'otra fuente enlazada por el negocio' END AS source,
      CASE placement WHEN 'flotante' THEN 'botón flotante' WHEN 'header' THEN 'menú o encabezado' WHEN 'cuerpo' THEN 'contenido' ELSE 'pie de página' END AS placement FROM {candidates}""")(
    lambda d: judgments.candidate_report(candidates(d)))
# Stored candidates of other sources plus fresh web ones, then decided again.
_REFRESHED = f"""c1 AS (SELECT site_id, 0 AS batch, arrival, source, placement, number FROM {{candidates}} WHERE source NOT IN ('web', 'linktree')
    UNION ALL SELECT id, 1, id, 'web', 'cuerpo', substr(phone_e164, 2) FROM {{businesses}} WHERE phone_e164 LIKE '+569%'),
  k AS (SELECT *, {_RANKS} FROM c1), b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY sr, number IS NULL, pr, batch, arrival) AS rn FROM k) x WHERE rn = 1)"""


def _refreshed(d: Inputs) -> DataFrame:
    fresh = d.businesses.filter("phone_e164 LIKE '+569%'").select(
        F.col("id").alias("site_id"), F.lit("web").alias("source"), F.lit("cuerpo").alias("placement"), F.expr("substr(phone_e164, 2)").alias("number"),
        F.concat(F.lit("https://wa.me/"), F.expr("substr(phone_e164, 2)")).alias("url"), F.lit("nuevo").alias("evidence"), F.lit(False).alias("broken"), F.col("id").alias("arrival"))
    return fusion.replace_sources(candidates(d), fresh, ["web", "linktree"])


query("U6_J22_replace_sources", "site_id long, whatsapp_url string, whatsapp_source string", f"""WITH {_REFRESHED} SELECT z.id AS site_id,
      CASE WHEN b.site_id IS NULL THEN NULL WHEN number IS NULL THEN 'https://wa.me/message/M' || CAST(arrival AS VARCHAR) ELSE 'https://wa.me/' || number END AS whatsapp_url, source AS whatsapp_source
    FROM {{businesses}} z LEFT JOIN b ON b.site_id = z.id""")(
    lambda d: fusion.decide_contacts(d.businesses.select(F.col("id").alias("site_id"), "phone_e164"), _refreshed(d)))


def _written(d: Inputs, complete: bool) -> DataFrame:
    stored = d.businesses.select(F.col("id").alias("site_id"), "whatsapp_status", "whatsapp_url", F.lit("maps").alias("whatsapp_source"), F.lit("viejo").alias("whatsapp_evidence"),
                                 F.lit(True).alias("whatsapp_multiple_numbers"), "whatsapp_confidence", "whatsapp_broken_button")
    return fusion.write_decision(stored, _decide(d), complete)


query("U16_partial_write", "site_id long, whatsapp_status string, whatsapp_url string, whatsapp_multiple_numbers boolean, whatsapp_confidence string", f"""WITH {DECISION_SQL}
    SELECT site_id, CASE WHEN d.whatsapp_status <> 'NO ENCONTRADO' THEN d.whatsapp_status ELSE z.whatsapp_status END AS whatsapp_status, coalesce(d.whatsapp_url, z.whatsapp_url) AS whatsapp_url,
      true AS whatsapp_multiple_numbers, coalesce(d.whatsapp_confidence, z.whatsapp_confidence) AS whatsapp_confidence FROM decided d JOIN {{businesses}} z ON z.id = d.site_id""")(
    lambda d: _written(d, False))
query("U16_complete_write", _DECISION_OUT, f"WITH {DECISION_SQL} SELECT * FROM decided")(lambda d: _written(d, True))
query("U15_apply_site_status", "id long, website string, website_status string, instagram string, note string, old_site string", """
    WITH v AS (SELECT event_id % (SELECT count(*) FROM {customer}) AS id, max(event_id) AS e FROM {events} GROUP BY 1),
      w AS (SELECT id, CASE WHEN e % 3 = 0 THEN 'CAIDO' ELSE 'OK' END AS status, CASE WHEN e % 3 = 0 THEN 'fallo' END AS reason, 'https://final' || CAST(e AS VARCHAR) || '.cl/' AS final_url FROM v)
    SELECT b.id, CASE WHEN status = 'OK' THEN final_url ELSE website END AS website, coalesce(status, website_status) AS website_status, coalesce(instagram, 'https://www.instagram.com/z') AS instagram,
      CASE WHEN status IS NOT NULL THEN 'web: ' || coalesce(reason, 'la web abre correctamente') ELSE status_note END AS note,
      CASE WHEN website_maps IS NOT NULL THEN website_maps WHEN status = 'OK' THEN website END AS old_site
    FROM {businesses} b LEFT JOIN w ON w.id = b.id""")(lambda d: _verified(d))


def _verified(d: Inputs) -> DataFrame:
    n = d.customer.count()
    v = d.events.groupBy((F.col("event_id") % n).alias("id")).agg(F.max("event_id").alias("e"))
    v = v.select("id", F.when(F.col("e") % 3 == 0, "CAIDO").otherwise("OK").alias("status"), F.when(F.col("e") % 3 == 0, "fallo").alias("reason"),
                 F.concat(F.lit("https://final"), F.col("e").cast("string"), F.lit(".cl/")).alias("final_url"), F.lit(False).alias("from_linktree"),
                 F.lit(None).cast("string").alias("linktree_url"), F.lit("https://www.instagram.com/z").alias("instagram"), F.lit(None).cast("string").alias("facebook"))
    out = fusion.apply_site_status(d.businesses_full(), v, "id")
    return out.withColumns({"note": F.try_element_at("field_sources", F.lit("website_status")), "old_site": F.try_element_at("field_sources", F.lit("website_maps"))})


# ------------------------------------------------------------------ J18, U15, U6: captured pages to the final decision
# Customers by form: 0 link page with an own site, 1 without, 2 closed; 3 own site with a link page, 4 alone, 5 down; 6 own site not captured yet, 7 no address.
_FORMS = f"""f AS (SELECT c_custkey AS site_id, c_custkey % 8 AS form, '569' || CAST(30000000 + c_custkey AS VARCHAR) AS low, '569' || CAST(40000000 + c_custkey AS VARCHAR) AS high,
      'https://own' || CAST(c_custkey AS VARCHAR) || '.cl/' AS own, 'https://linktr.ee/n' || CAST(c_custkey AS VARCHAR) AS page, CASE WHEN c_custkey % 5 = 0 THEN '569' || CAST(70000000 + c_custkey AS VARCHAR) END AS maps FROM {{customer}}),
    n AS (SELECT *, CASE WHEN form IN (0, 4) THEN high WHEN form IN (1, 3) THEN low END AS found, CASE WHEN form IN (0, 4) THEN 'web' WHEN form IN (1, 3) THEN 'linktree' END AS found_in FROM f)"""
query("J18_U15_U6_verified_contacts", "site_id long, website string, website_status string, instagram string, whatsapp_status string, whatsapp_url string, whatsapp_source string, multiple boolean, site_source string",
      f"""WITH {_FORMS} SELECT site_id, CASE WHEN form = 0 THEN own WHEN form IN (3, 4, 5) THEN own WHEN form = 7 THEN NULL ELSE page END AS website,
      CASE WHEN form IN (0, 3, 4) THEN '{fv.SITE_OK}' WHEN form = 1 THEN '{fv.SITE_ONLY_SOCIAL}' WHEN form IN (2, 5) THEN '{fv.SITE_DOWN}' ELSE 'VIEJO' END AS website_status,
      CASE WHEN form IN (0, 1, 3) THEN 'https://www.instagram.com/n' || CAST(site_id AS VARCHAR) END AS instagram,
      CASE WHEN form > 5 THEN 'VIEJO' WHEN maps IS NOT NULL OR found IS NOT NULL THEN '{fv.CONTACT_VERIFIED}' ELSE '{fv.CONTACT_NOT_FOUND}' END AS whatsapp_status,
      CASE WHEN form > 5 THEN 'https://wa.me/1' ELSE 'https://wa.me/' || coalesce(maps, found) END AS whatsapp_url,
      CASE WHEN form > 5 THEN 'vieja' WHEN maps IS NOT NULL THEN 'maps' ELSE found_in END AS whatsapp_source, form <= 5 AND (form = 0 OR (maps IS NOT NULL AND found IS NOT NULL)) AS multiple,
      CASE WHEN form = 0 THEN 'web propia enlazada desde su Linktree (' || page || ')' END AS site_source FROM n""")(
    lambda d: verification.verify_businesses(*_to_verify(d)).businesses.withColumns({
        "multiple": F.col("whatsapp_multiple_numbers"), "site_source": F.try_element_at("field_sources", F.lit("website"))}))
query("J18_addresses_to_capture", "address string", f"WITH {_FORMS} SELECT own AS address FROM n WHERE form = 6")(lambda d: verification.verify_businesses(*_to_verify(d)).to_capture)


def _to_verify(d: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Businesses with their last decision, stored candidates (of Maps, and stale ones of the web), captured pages."""
    k, form = F.col("c_custkey"), F.col("c_custkey") % 8
    number = lambda base: F.concat(F.lit("569"), (base + k).cast("string"))
    own, page = F.concat(F.lit("https://own"), k.cast("string"), F.lit(".cl/")), F.concat(F.lit("https://linktr.ee/n"), k.cast("string"))
    none = F.lit(None).cast("string")
    businesses = d.dealt.customer.select(
        k.alias("site_id"), F.when(form.isin(3, 4, 5), own).when(form != 7, page).alias("website"), F.lit("VIEJO").alias("website_status"), none.alias("instagram"), none.alias("facebook"),
        F.create_map().cast("map<string,string>").alias("field_sources"), none.alias("phone_e164"), F.lit("VIEJO").alias("whatsapp_status"), F.lit("https://wa.me/1").alias("whatsapp_url"),
        F.lit("vieja").alias("whatsapp_source"), none.alias("whatsapp_evidence"), F.lit(False).alias("whatsapp_multiple_numbers"), none.alias("whatsapp_confidence"), F.lit(False).alias("whatsapp_broken_button"))
    stored = d.customer.select(k.alias("site_id"), F.explode(F.array_compact(F.array(
        F.when(k % 5 == 0, F.struct(F.lit("maps").alias("source"), number(70_000_000).alias("number"))),
        F.struct(F.lit("web").alias("source"), number(80_000_000).alias("number"))))).alias("c")).select("site_id", "c.*").withColumns({
            "url": F.concat(F.lit("https://wa.me/"), "number"), "placement": F.lit("cuerpo"), "evidence": F.lit("e"), "broken": F.lit(False), "arrival": F.lit(0)})
    link = lambda url: F.concat(F.lit('<a href="'), url, F.lit('">x</a>'))
    chat = lambda base: link(F.concat(F.lit("https://wa.me/"), number(base)))
    profile = link(F.concat(F.lit("https://www.instagram.com/n"), k.cast("string"), F.lit("/")))
    on_link_page = F.when(form.isin(0, 1, 2, 3, 6), F.concat(F.lit("<body>"), chat(30_000_000), profile, F.when(form.isin(0, 6), link(own)).otherwise("")))
    on_site = F.when(form.isin(0, 3, 4, 5), F.concat(F.lit("<body>"), F.when(form != 3, chat(40_000_000)).otherwise(""), F.when(form == 3, link(page)).otherwise("")))
    capture = lambda n, url, html, fine: F.when(html.isNotNull(), F.struct(
        (k * 2 + n).alias("page_id"), url.alias("url"), html.alias("html"), fine.alias("read_content"), F.when(fine, fv.SITE_OK).otherwise(fv.SITE_DOWN).alias("status"),
        F.when(~fine, "fallo").alias("reason"), url.alias("final_url")))
    pages = d.dealt.customer.select(F.explode(F.array_compact(F.array(capture(0, page, on_link_page, form != 2), capture(1, own, on_site, form != 5)))).alias("p")).select("p.*")
    return businesses, stored, cut_lineage(parse_pages(pages))


# ------------------------------------------------------------------ U10, U11
query("U10_U11_manual_actions", "id long, whatsapp_check string, whatsapp_confidence string, discarded boolean, confirmed_number string", """
    WITH a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY ts DESC, event_id DESC) AS rn FROM {actions} WHERE action <> 'view') x WHERE rn = 1),
      n AS (SELECT b.*, a.action, CASE WHEN whatsapp_status = 'VERIFICADO' AND regexp_extract(whatsapp_url, 'wa\\.me/(\\d+)', 1) <> '' THEN regexp_extract(whatsapp_url, 'wa\\.me/(\\d+)', 1)
        WHEN phone_e164 LIKE '+569%' THEN substr(phone_e164, 2) END AS number FROM {businesses} b LEFT JOIN a ON a.business_id = b.id)
    SELECT id, CASE WHEN action = 'confirm' AND number IS NOT NULL THEN 'EXISTE' WHEN action = 'discard' THEN 'NO_EXISTE' WHEN action = 'restore' THEN NULL ELSE whatsapp_check END AS whatsapp_check,
      CASE WHEN action = 'confirm' AND number IS NOT NULL THEN 'ALTA' ELSE whatsapp_confidence END AS whatsapp_confidence,
      CASE WHEN action = 'confirm' AND number IS NOT NULL THEN false WHEN action = 'discard' THEN true WHEN action = 'restore' THEN false ELSE discard_reason IS NOT NULL END AS discarded,
      CASE WHEN action = 'confirm' THEN number END AS confirmed_number FROM n""")(
    lambda d: actions.apply_actions(d.businesses_full(), d.actions.withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("discarded", F.col("discarded_at").isNotNull()))

# ------------------------------------------------------------------ R27, A18-like maxima are in page queries
query("R27_final_attempt", "site_id long, attempt long, status long, error string", f"""
    WITH t AS (SELECT *, coalesce(status IN ({', '.join(map(str, fv.TRANSIENT_STATUS))}), false) OR coalesce(error_kind IN ('timeout', 'connect', 'http'), false) AS transient FROM {{attempts}}),
      p AS (SELECT *, row_number() OVER (PARTITION BY site_id ORDER BY transient, CASE WHEN transient THEN -attempt ELSE attempt END) AS rn FROM t)
    SELECT site_id, attempt, status, CASE WHEN attempt > 1 AND error IS NOT NULL THEN error || ' (se intentó ' || CAST(attempt AS VARCHAR) || ' veces)' ELSE error END AS error FROM p WHERE rn = 1""")(
    lambda d: site_status.final_attempt(d.attempts.withColumn("transient", site_status.is_transient(F.col("status"), F.col("error_kind")))))

# ------------------------------------------------------------------ R4-R7, S6, A11, R25, J19
_SPEED = """CASE WHEN psi IS NOT NULL THEN greatest(1, CAST(round_even(psi / 10.0, 0) AS BIGINT)) WHEN load_ms < 1500 THEN 10 WHEN load_ms < 2500 THEN 8 WHEN load_ms < 4000 THEN 6
    WHEN load_ms < 6000 THEN 4 WHEN load_ms < 9000 THEN 2 ELSE 1 END"""
_LINKS = "CASE WHEN n_errors <= 0 THEN 10 WHEN n_errors <= 1 THEN 8 WHEN n_errors <= 3 THEN 6 WHEN n_errors <= 6 THEN 4 ELSE 2 END"
query("R4_speed_score", "id long, score long", f"SELECT id, {_SPEED} AS score FROM {{analyses}}")(lambda d: d.analyses.select("id", scoring.speed_score("load_ms", "psi").alias("score")))
query("R5_links_score", "id long, score long, reason string", f"""SELECT id, {_LINKS} AS score, CASE WHEN n_errors = 0 THEN 'Ningún enlace o botón roto.'
    ELSE CAST(n_errors AS VARCHAR) || ' enlace(s) o botón(es) que no funcionan.' END AS reason FROM {{analyses}}""")(
    lambda d: d.analyses.select("id", scoring.links_score("n_errors").alias("score"), scoring.links_reason("n_errors").alias("reason")))
query("R6_opportunity_level", "id long, level string", """SELECT a.id, CASE WHEN website IS NULL THEN CASE WHEN coalesce(rating, 0) >= 4.3 AND coalesce(review_count, 0) >= 20 THEN 'ALTA' ELSE 'MEDIA' END
      WHEN website_score IS NULL THEN NULL WHEN website_score < 50 THEN CASE WHEN coalesce(rating, 0) >= 4.3 AND coalesce(review_count, 0) >= 20 THEN 'ALTA' ELSE 'MEDIA' END
      WHEN website_score < 70 THEN 'MEDIA' ELSE 'BAJA' END AS level FROM {analyses} a JOIN {businesses} b ON b.id = a.business_id""")(
    lambda d: d.analyses.select("id", "business_id", "website_score").join(d.businesses.select(F.col("id").alias("business_id"), "website", "rating", "review_count"), "business_id").select(
        "id", scoring.opportunity_level("website_score", F.col("website").isNotNull(), "rating", "review_count").alias("level")))
query("R7_code_scores", "site_id long, id long, score long, origin string", f"""SELECT id AS site_id, 5 AS id, {_SPEED} AS score, 'codigo' AS origin FROM {{analyses}}
    UNION ALL SELECT id, 9, {_LINKS}, 'codigo' FROM {{analyses}}""")(
    lambda d: judgments.code_scores(d.analyses.select(F.col("id").alias("site_id"), "load_ms", "psi", F.col("n_errors").alias("link_errors"))))
query("S6_rubric", "id long, name string, scored_by string, uses long", """SELECT r.id, CASE r.id """ + " ".join(
    f"WHEN {i} THEN '{n}'" for i, n, _ in fv.RUBRIC_PARAMS) + """ END AS name, CASE WHEN r.id IN (5, 9) THEN 'codigo' ELSE 'ia' END AS scored_by, count(*) AS uses
    FROM (SELECT event_id % 10 + 1 AS id FROM {events}) r GROUP BY 1""")(
    lambda d: d.events.select((F.col("event_id") % 10 + 1).cast("int").alias("id")).join(judgments.rubric(d.spark), "id").groupBy("id", "name", "scored_by").agg(F.count("*").alias("uses")))
# Judged parameters of each part: its order lines name a parameter and give the score.
query("A11_R25_total_score", "site_id long, website_score long, error string", f"""
    WITH s AS (SELECT l_partkey AS site_id, l_suppkey % 10 + 1 AS id, min(l_linenumber) AS score FROM {{lineitem}} GROUP BY 1, 2
        UNION ALL SELECT p_partkey, 11, 1 FROM {{part}} WHERE p_size = 1),
      p AS (SELECT site_id, count(DISTINCT id) FILTER (WHERE id <= 10) AS k, count(*) FILTER (WHERE id > 10) AS other, sum(score) AS total FROM s GROUP BY 1)
    SELECT site_id, CASE WHEN k = 10 AND other = 0 THEN total END AS website_score, CASE WHEN k = 10 AND other = 0 THEN NULL ELSE '{fv.MISSING_PARAMS_ERROR}' END AS error FROM p""")(
    lambda d: judgments.total_scores(
        d.lineitem.groupBy(F.col("l_partkey").alias("site_id"), (F.col("l_suppkey") % 10 + 1).alias("id")).agg(F.min("l_linenumber").alias("score")).unionByName(
            d.part.filter("p_size = 1").select(F.col("p_partkey").alias("site_id"), F.lit(11).cast("long").alias("id"), F.lit(1).alias("score")))))
query("J19_rubric_rows", "business_id long, id long, score long", """
    WITH a AS (SELECT DISTINCT business_id FROM {analyses}), p AS (SELECT unnest(range(1, 11)) AS id)
    SELECT business_id, id, CASE WHEN (business_id + id) % 3 = 0 THEN (business_id + id) % 10 END AS score FROM a, p""")(
    lambda d: judgments.rubric_rows(d.analyses.select("business_id").distinct().withColumn("rubric_scores", F.map_from_entries(F.transform(
        F.filter(F.sequence(F.lit(1), F.lit(10)), lambda i: (F.col("business_id") + i) % 3 == 0),
        lambda i: F.struct(i.cast("string").alias("key"), F.struct(((F.col("business_id") + i) % 10).alias("score"), F.lit("r").alias("reason")).alias("value"))))), judgments.rubric(d.spark)))
query("J20_labelled_checks", "id long, label string, ok boolean, position long", """
    SELECT id, label, ok, row_number() OVER (PARTITION BY id ORDER BY o) AS position FROM (
      SELECT id, 'otro' AS label, true AS ok, 99 AS o FROM {businesses}
      UNION ALL SELECT id, 'Mapa o enlace a su ficha de Google', id % 2 = 0, 6 FROM {businesses}
      UNION ALL SELECT id, 'Un solo título principal (H1)', NULL, 1 FROM {businesses}) x""")(
    lambda d: judgments.labelled_checks(d.businesses.select("id", F.create_map(
        F.lit("otro"), F.struct(F.lit(True).alias("ok"), F.lit("x").alias("detail")), F.lit("mapa"), F.struct((F.col("id") % 2 == 0).alias("ok"), F.lit("y").alias("detail")),
        F.lit("h1_unico"), F.struct(F.lit(None).cast("boolean").alias("ok"), F.lit(None).cast("string").alias("detail"))).alias("seo_local")), "seo_local", fv.SEO_LABELS, "id"))
query("J20_source_rows", "id long, label string, source string, position long", """
    SELECT id, label, source, row_number() OVER (PARTITION BY id ORDER BY o) AS position FROM (
      SELECT id, 'Lo que Maps mostraba como «Sitio web»' AS label, website_maps AS source, 8 AS o FROM {businesses} WHERE website_maps IS NOT NULL
      UNION ALL SELECT id, 'Estado de la web', status_note, 9 FROM {businesses} WHERE status_note IS NOT NULL) x""")(
    lambda d: judgments.source_rows(d.businesses_full()))

# ------------------------------------------------------------------ S13, R28, A21
_RESPONSE = """'{"parametros":[{"id":' || CAST(conv_id % 12 AS STRING) || ',"puntaje":' || CAST(turn + 8 AS STRING) || ',"justificacion":"j","evidencia":["e"]},{"id":' || CAST(conv_id % 12 AS STRING)
      || ',"puntaje":3,"justificacion":"j","evidencia":["e"]},{"id":8,"puntaje":0,"justificacion":"j","evidencia":[" "]}],"problemas":[{"titulo":"P","impacto":"i","parametro":1,"evidencia":[]},'
      || '{"titulo":"Q","impacto":"i","parametro":1,"evidencia":["x"]}],"oportunidades":[],"puntos_fuertes":[{"titulo":"F","evidencia":["x"]}],"diferenciadores":{"ok":true,"detalle":"d"}}'"""


def _responses(d: Inputs) -> DataFrame:
    return d.conversations.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("site_id"), "conv_id", "turn",
        F.when(F.col("turn") == 2, "refusal").when(F.col("turn") == 3, "max_tokens").otherwise("end_turn").alias("stop_reason"),
        F.when(F.col("role") == "user", F.expr(_RESPONSE)).otherwise(F.col("text")).alias("response"))


_ERROR_SQL = f"CASE WHEN turn = 2 THEN '{fv.REFUSED_ERROR}' WHEN turn = 3 THEN '{fv.CUT_ERROR}' WHEN role <> 'user' THEN '{fv.FORMAT_ERROR}' END"
query("S13_responses", "site_id long, error string", f"SELECT conv_id * 100 + turn AS site_id, {_ERROR_SQL} AS error FROM {{conversations}}")(lambda d: judgments.read_responses(_responses(d)))
query("R28_A21_clean_answers", "site_id long, ids string, scores string, problems long, strengths long, discarded string", f"""
    WITH c AS (SELECT conv_id * 100 + turn AS site_id, conv_id % 12 AS i, turn, {_ERROR_SQL} AS error FROM {{conversations}}),
      u AS (SELECT *, i IN (1, 2, 3, 4, 6, 7, 8, 10) AS allowed FROM c WHERE error IS NULL)
    SELECT site_id, CASE WHEN allowed THEN CAST(i AS VARCHAR) ELSE '' END AS ids, CASE WHEN allowed THEN CAST(least(10, greatest(1, turn + 8)) AS VARCHAR) ELSE '' END AS scores, 1 AS problems, 1 AS strengths,
      CASE WHEN allowed THEN 'Parámetro ' || i || ' repetido o que no le corresponde a la IA' ELSE 'Parámetro ' || i || ' repetido o que no le corresponde a la IA|Parámetro ' || i || ' repetido o que no le corresponde a la IA' END
      || CASE WHEN i = 8 THEN '|Parámetro 8 repetido o que no le corresponde a la IA' ELSE '|Parámetro 8 sin evidencia' END || '|Problema sin evidencia: P' AS discarded FROM u""")(
    lambda d: judgments.clean_answers(judgments.read_responses(_responses(d)).filter("error IS NULL")).select(
        "site_id", F.array_join(F.transform("params", lambda p: p["id"].cast("string")), ",").alias("ids"), F.array_join(F.transform("params", lambda p: p["puntaje"].cast("string")), ",").alias("scores"),
        F.size("problemas").alias("problems"), F.size("puntos_fuertes").alias("strengths"), F.array_join("discarded", "|").alias("discarded")))
