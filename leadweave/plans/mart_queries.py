"""Lead mart: predicates, joins, windows, counters (P*, J1-J3, J7, W*, A*)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions import text as tx
from leadweave.functions.urls import is_technical_link, with_link_kind
from leadweave.operators import judgments, leads
from leadweave.plans.inputs import Inputs
from leadweave.plans.registry import query

MOBILE = "coalesce(phone_e164 LIKE '+569%', false)"
CONTACTABLE = f"(whatsapp_status = 'VERIFICADO' OR {MOBILE})"
IS_LEAD = (
    f"discard_reason IS NULL AND duplicate_reason IS NULL AND coalesce(website_status = 'OK', false) AND {CONTACTABLE}"
)
PROSPECTED = (
    f"duplicate_reason IS NULL AND (discard_reason IS NOT NULL OR (coalesce(website_status = 'OK', false) AND {CONTACTABLE}))"
)
STATE = f"""CASE WHEN whatsapp_status = 'VERIFICADO' AND coalesce(whatsapp_check = 'EXISTE', false) THEN 'confirmado'
  WHEN whatsapp_status = 'VERIFICADO' THEN 'verificado' WHEN {MOBILE} THEN 'por_probar' ELSE 'sin_whatsapp' END"""
LEVEL_NO_SITE = "CASE WHEN coalesce(rating, 0) >= 4.3 AND coalesce(review_count, 0) >= 20 THEN 'ALTA' ELSE 'MEDIA' END"
OWN = "(website IS NOT NULL AND coalesce(website_status = 'OK', true))"
# The lead rows of all days, as SQL: one row per business found by any search.
LEADS_SQL = f"""
  found AS (SELECT business_id AS id, min(search_id) AS search_id FROM {{search_results}} GROUP BY 1),
  first AS (SELECT f.id, f.search_id, min(position) AS position FROM found f JOIN {{search_results}} r
            ON r.business_id = f.id AND r.search_id = f.search_id GROUP BY 1, 2),
  latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY analyzed_at DESC, id DESC) AS rn FROM {{analyses}}) x WHERE rn = 1),
  leads AS (
    SELECT b.id, b.business_name AS name, b.city, s.query, f.search_id, f.position, {STATE} AS whatsapp_state,
      CASE WHEN whatsapp_status = 'VERIFICADO' THEN whatsapp_url WHEN {MOBILE} THEN 'https://wa.me/' || substr(phone_e164, 2) END AS whatsapp_url,
      whatsapp_confidence AS confidence, website, coalesce(website_status, 'POR VERIFICAR') AS website_status,
      CASE WHEN coalesce(website_status = 'OK', false) THEN NULL ELSE replace(status_note, 'web: ', '') END AS website_reason,
      rating, review_count AS reviews, discard_reason IS NOT NULL AS discarded,
      CASE WHEN l.id IS NOT NULL THEN l.n_findings WHEN website_status IN ('SIN_WEB', 'SOLO_REDES', 'CAIDO') THEN 1 ELSE 0 END AS findings,
      CASE WHEN l.id IS NOT NULL THEN l.n_serious WHEN website_status IN ('SIN_WEB', 'SOLO_REDES', 'CAIDO') THEN 1 ELSE 0 END AS serious,
      l.website_score AS score, CASE WHEN NOT {OWN} THEN {LEVEL_NO_SITE} ELSE l.opportunity_level END AS opportunity,
      l.id IS NULL AND coalesce(website_status = 'OK', false) AS review_pending, l.error AS review_error,
      {IS_LEAD.replace('discard_reason', 'b.discard_reason')} AS is_lead
    FROM {{businesses}} b JOIN first f ON f.id = b.id JOIN {{searches}} s ON s.id = f.search_id LEFT JOIN latest l ON l.business_id = b.id)
"""
RANK_SQL = """CASE WHEN whatsapp_state = 'confirmado' THEN 0 WHEN whatsapp_state = 'verificado' THEN CASE WHEN confidence = 'ALTA' THEN 1 ELSE 2 END
  WHEN whatsapp_state = 'por_probar' THEN 3 ELSE 4 END"""
BAD_SQL = "(website_status = 'OK' AND CASE WHEN score IS NOT NULL THEN score < 50 ELSE serious > 0 END)"


def all_leads(d: Inputs, include_discarded: bool = False) -> DataFrame:
    return leads.leads_of_day(d.searches_full(), d.search_results, d.businesses_full(), d.analyses_full(), None, include_discarded=include_discarded)


def ranked(rows: DataFrame, order: str) -> DataFrame:
    """Rows with their place in a named order. The window serves the comparison only: a list page takes the top rows."""
    from pyspark.sql.window import Window as W
    return rows.select("id", F.row_number().over(W.partitionBy("query").orderBy(*leads.sort_keys(order, ["position", "id"]))).alias("place"))


# ------------------------------------------------------------------ S1
query("S1_scan_businesses", "id long, business_name string, city string, phone_e164 string, website string, rating double, review_count long",
      "SELECT id, business_name, city, phone_e164, website, rating, review_count FROM {businesses}")(
    lambda d: d.businesses_full().orderBy("id"))
query("S1_scan_contacted", "id long, name string, phone_e164 string, status string", "SELECT id, name, phone_e164, status FROM {contacted}")(
    lambda d: d.contacted.orderBy(F.desc("id")))

# ------------------------------------------------------------------ P1-P18
query("P1_is_lead", "id long", f"SELECT id FROM {{businesses}} WHERE {IS_LEAD}")(lambda d: d.businesses_full().filter(leads.is_lead()))
query("P2_already_prospected", "id long", f"SELECT id FROM {{businesses}} WHERE {PROSPECTED}")(
    lambda d: d.businesses_full().filter(leads.already_prospected()))
query("P3_card_may_have_site", "id long", """
    SELECT id FROM {businesses} WHERE id % 4 = 0 OR (website IS NOT NULL AND website NOT LIKE '%instagram%')""")(
    lambda d: with_link_kind(d.businesses.withColumn("card_seen", F.col("id") % 4 != 0), "website", "card_kind").filter(leads.card_may_have_site()))


def _filter_query(name: str, condition: str) -> None:
    query(f"{name[0]}_filter_{name[1]}", "id long", f"WITH {LEADS_SQL} SELECT id FROM leads WHERE is_lead AND {condition}")(
        lambda d: leads.filter_leads(all_leads(d), [name[1]]))


_filter_query(("P4", "whatsapp"), "whatsapp_state IN ('verificado', 'confirmado')")
_filter_query(("P5", "probar"), "whatsapp_state = 'por_probar'")
_filter_query(("P6", "web_mala"), BAD_SQL)
_filter_query(("P7", "rating"), "coalesce(rating, 0) > 4.5")
_filter_query(("P8", "resenas"), "coalesce(reviews, 0) > 100")
_filter_query(("P9", "whatsapp_web_mala"), f"whatsapp_state IN ('verificado', 'confirmado') AND {BAD_SQL}")
_filter_query(("P10", "oportunidad"), "opportunity = 'ALTA'")
query("P11_filter_combined", "id long, query string", f"""WITH {LEADS_SQL} SELECT id, query FROM leads
    WHERE is_lead AND whatsapp_state IN ('verificado', 'confirmado') AND coalesce(rating, 0) > 4.5 AND query = '2-HIGH'""")(
    lambda d: leads.filter_leads(all_leads(d), ["whatsapp", "rating", "unknown name"], "2-HIGH"))
query("P12_searches_of_day", "id long, query string", """
    SELECT id, query FROM {searches} WHERE created_at >= TIMESTAMP '1997-05-28 04:00:00' AND created_at < TIMESTAMP '1997-05-29 04:00:00'""")(
    lambda d: leads.searches_of_day(d.searches_full(), "1997-05-28", "America/Santiago"))
query("P13_include_discarded", "id long, discarded boolean", f"WITH {LEADS_SQL} SELECT id, discarded FROM leads WHERE is_lead OR discarded")(
    lambda d: all_leads(d, include_discarded=True))
_NOW = "2024-01-31 00:00:00"
query("P14_needs_analysis", "id long", f"""SELECT b.id FROM {{businesses}} b WHERE NOT EXISTS (SELECT 1 FROM {{analyses}} a
    WHERE a.business_id = b.id AND a.error IS NULL AND a.analyzed_at > TIMESTAMP '{_NOW}' - INTERVAL 10 DAY)""")(
    lambda d: leads.needs_analysis(d.businesses_full(), d.analyses_full(), F.to_timestamp(F.lit(_NOW)), 10))
query("P15_pending_reviews", "id long", f"""SELECT b.id FROM {{businesses}} b WHERE website IS NOT NULL AND {IS_LEAD} AND NOT EXISTS (
    SELECT 1 FROM {{analyses}} a WHERE a.business_id = b.id AND a.error IS NULL AND a.analyzed_at > TIMESTAMP '{_NOW}' - INTERVAL 10 DAY)""")(
    lambda d: leads.pending_reviews(d.businesses_full(), d.analyses_full(), F.to_timestamp(F.lit(_NOW)), 10))
query("P16_review_pending", "id long, review_pending boolean", f"WITH {LEADS_SQL} SELECT id, review_pending FROM leads WHERE is_lead")(all_leads)
query("P17_technical_links", "url_id long, link string", """SELECT url_id, link FROM (SELECT url_id, 'https://n.cl/' ||
      CASE url_id % 5 WHEN 0 THEN 'wp-admin/x' WHEN 1 THEN 'feed' WHEN 2 THEN 'imunify-bot-check?a' WHEN 3 THEN 'feedback' ELSE 'contacto' END AS link FROM {urls}) AS u
    WHERE NOT regexp_matches(link, '/(wp-admin|wp-login\\.php|wp-json|xmlrpc\\.php|cdn-cgi|imunify[\\w-]*|feed|comments/feed)(/|$|\\?)')""")(
    lambda d: d.urls.select("url_id", F.concat(F.lit("https://n.cl/"), F.element_at(
        F.array(*[F.lit(x) for x in ("wp-admin/x", "feed", "imunify-bot-check?a", "feedback", "contacto")]), (F.col("url_id") % 5 + 1).cast("int"))).alias("link")
    ).filter(~is_technical_link("link")))
query("P18_duplicates_hidden", "id long, name string, reason string, query string", """
    SELECT b.id, business_name AS name, duplicate_reason AS reason, q.query FROM {businesses} b JOIN (
      SELECT business_id, s.query, row_number() OVER (PARTITION BY business_id ORDER BY search_id, position) AS rn
      FROM {search_results} r JOIN {searches} s ON s.id = r.search_id) q ON q.business_id = b.id AND rn = 1 WHERE duplicate_reason IS NOT NULL""")(
    lambda d: leads.duplicates_of_searches(d.searches_full(), d.search_results, d.businesses_full()))
_LEAD_OUT = (
    "id long, name string, city string, query string, position long, whatsapp_state string, whatsapp_url string, confidence string, website string, "
    "website_status string, website_reason string, rating double, reviews long, discarded boolean, findings long, score long, opportunity string, "
    "review_pending boolean, review_error string"
)
query("P19_lead_rows", _LEAD_OUT, f"WITH {LEADS_SQL} SELECT * FROM leads WHERE is_lead OR discarded")(
    lambda d: all_leads(d, include_discarded=True).withColumn("findings", F.size("findings")))
query("P20_contact_state", "id long, whatsapp_state string, shown_url string", f"""SELECT id, {STATE} AS whatsapp_state,
    CASE WHEN whatsapp_status = 'VERIFICADO' THEN whatsapp_url WHEN {MOBILE} THEN 'https://wa.me/' || substr(phone_e164, 2) END AS shown_url FROM {{businesses}}""")(
    lambda d: d.businesses_full().select("id", leads.contact_state().alias("whatsapp_state"), leads.contact_url().alias("shown_url")))

# ------------------------------------------------------------------ J1-J3, J7
query("J1_businesses_of_search", "search_id long, position long, id long, business_name string", """
    SELECT search_id, position, b.id, business_name FROM {search_results} r JOIN {businesses} b ON b.id = r.business_id JOIN {searches} s ON s.id = r.search_id""")(
    lambda d: leads.businesses_of_searches(d.businesses_full(), d.search_results, d.searches_full()))
query("J2_businesses_of_searches", "search_id long, position long, id long", """
    SELECT search_id, position, b.id FROM {search_results} r JOIN {businesses} b ON b.id = r.business_id
    WHERE search_id IN (SELECT id FROM {searches} WHERE status = 'TERMINADA')""")(
    lambda d: leads.businesses_of_searches(d.businesses_full(), d.search_results, d.searches_full().filter("status = 'TERMINADA'")))
query("J3_first_search", "business_id long, query string, position long", """
    SELECT business_id, query, position FROM (SELECT r.business_id, s.query, r.position,
      row_number() OVER (PARTITION BY business_id ORDER BY created_at, search_id) AS rn
      FROM {search_results} r JOIN {searches} s ON s.id = r.search_id) x WHERE rn = 1""")(
    lambda d: leads.first_search(d.search_results, d.searches_full()))
query("J7_latest_analysis_joined", "id long, analysis_id long, score long", """
    SELECT b.id, a.id AS analysis_id, a.website_score AS score FROM {businesses} b LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY analyzed_at DESC, id DESC) AS rn FROM {analyses}) a ON a.business_id = b.id AND rn = 1""")(
    lambda d: d.businesses.select("id").join(leads.latest_analysis(d.analyses_full()).select(
        F.col("business_id").alias("id"), F.col("id").alias("analysis_id"), F.col("website_score").alias("score")
    ), "id", "left"))
query("J21_business_report", "id long, name string, query string, position long, analyses long, latest_id long, latest_score long, latest_findings long, rubric_rows long", """
    WITH fs AS (SELECT business_id, query, position FROM (SELECT r.business_id, s.query, r.position,
        row_number() OVER (PARTITION BY business_id ORDER BY created_at, search_id) AS rn FROM {search_results} r JOIN {searches} s ON s.id = r.search_id) x WHERE rn = 1),
      la AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY analyzed_at DESC, id DESC) AS rn,
        count(*) OVER (PARTITION BY business_id) AS n FROM {analyses}) x WHERE rn = 1)
    SELECT b.id, business_name AS name, coalesce(query, '') AS query, coalesce(position, 0) AS position, coalesce(n, 0) AS analyses, la.id AS latest_id,
      website_score AS latest_score, n_findings AS latest_findings, CASE WHEN la.id IS NULL THEN 0 ELSE 10 END AS rubric_rows
    FROM {businesses} b LEFT JOIN fs ON fs.business_id = b.id LEFT JOIN la ON la.business_id = b.id""")(
    lambda d: _report(d))


def _report(d: Inputs) -> DataFrame:
    """Business, first search, latest analysis with its rubric rows and the number of analyses."""
    history = leads.analysis_history(d.analyses_full())
    latest = history.filter("position = 1").select(
        F.col("business_id").alias("id"), F.col("id").alias("latest_id"), F.col("score").alias("latest_score"), F.col("findings").alias("latest_findings"))
    counts = history.groupBy(F.col("business_id").alias("id")).agg(F.count("*").alias("analyses"))
    scored = d.analyses.select("business_id").distinct().withColumn("rubric_scores", F.create_map().cast("map<string,struct<score:int,reason:string>>"))
    rubric = judgments.rubric_rows(scored, judgments.rubric(d.spark)).groupBy(F.col("business_id").alias("id")).agg(F.count("*").alias("rubric_rows"))
    first = leads.first_search(d.search_results, d.searches_full()).withColumnRenamed("business_id", "id")
    joined = d.businesses.select("id", F.col("business_name").alias("name")).join(first, "id", "left").join(latest, "id", "left").join(counts, "id", "left").join(rubric, "id", "left")
    return joined.fillna({"query": "", "position": 0, "analyses": 0, "rubric_rows": 0})


# ------------------------------------------------------------------ W1, W2, W8-W13
query("W1_latest_successful", "business_id long, id long", """
    SELECT business_id, id FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY analyzed_at DESC, id DESC) AS rn
      FROM {analyses} WHERE error IS NULL) x WHERE rn = 1""")(lambda d: leads.latest_analysis(d.analyses_full(), successful_only=True))
query("W2_first_found", "business_id long, search_id long, position long", """
    SELECT business_id, search_id, position FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY search_id, position) AS rn
      FROM {search_results}) x WHERE rn = 1""")(lambda d: leads.first_found(d.search_results))
query("W8_analysis_history", "business_id long, id long, position long, findings long", """
    SELECT business_id, id, n_findings AS findings, row_number() OVER (PARTITION BY business_id ORDER BY analyzed_at DESC, id DESC) AS position FROM {analyses}""")(
    lambda d: leads.analysis_history(d.analyses_full()))
query("W9_newest_searches", "id long, query string", "SELECT id, query FROM {searches} ORDER BY created_at DESC, id DESC LIMIT 50")(
    lambda d: leads.newest_searches(d.searches_full(), 50))


def _sort_query(key: str, order: str, sql_order: str) -> None:
    query(key, "id long, place long", f"""WITH {LEADS_SQL} SELECT id, row_number() OVER (PARTITION BY query ORDER BY {sql_order}, position, id) AS place
        FROM leads WHERE is_lead""")(lambda d: ranked(all_leads(d), order))


_sort_query("W10_sort_contact", "whatsapp", f"{RANK_SQL}, coalesce(reviews, 0) DESC")
_sort_query("W11_sort_opportunity", "oportunidad", f"""CASE opportunity WHEN 'ALTA' THEN 0 WHEN 'MEDIA' THEN 1 WHEN 'BAJA' THEN 3 ELSE 2 END,
    serious DESC, findings DESC, {RANK_SQL}, coalesce(reviews, 0) DESC""")
_sort_query("W12_sort_reviews", "resenas", f"coalesce(reviews, 0) DESC, {RANK_SQL}")
_sort_query("W12_sort_rating", "rating", "coalesce(rating, 0) DESC, coalesce(reviews, 0) DESC")
_sort_query("W12_sort_name", "nombre", "lower(name)")
_sort_query("W12_sort_unknown", "no existe", f"{RANK_SQL}, coalesce(reviews, 0) DESC")

# ------------------------------------------------------------------ A1, A2, A4, A5, A7, A12, A20
_FOUND = "{search_results} r JOIN {businesses} b ON b.id = r.business_id"
query("A1_listing_counters", "search_id long, businesses_found long, websites_found long, whatsapp_verified long", f"""
    SELECT search_id, count(*) AS businesses_found, count(*) FILTER (WHERE website IS NOT NULL AND website_status IS NULL) AS websites_found,
      count(*) FILTER (WHERE whatsapp_status = 'VERIFICADO') AS whatsapp_verified FROM {_FOUND} GROUP BY 1""")(
    lambda d: leads.listing_counters(leads.businesses_of_searches(d.businesses_full(), d.search_results, d.searches_full())))
query("A2_A20_verification_counters", "search_id long, businesses long, websites_found long, whatsapp_verified long, with_both long", f"""
    SELECT search_id, count(*) AS businesses, count(*) FILTER (WHERE website_status = 'OK') AS websites_found,
      count(*) FILTER (WHERE whatsapp_status = 'VERIFICADO') AS whatsapp_verified,
      count(*) FILTER (WHERE website_status = 'OK' AND whatsapp_status = 'VERIFICADO') AS with_both FROM {_FOUND} GROUP BY 1""")(
    lambda d: leads.verification_counters(leads.businesses_of_searches(d.businesses_full(), d.search_results, d.searches_full())))
_ROLLUP = f"""
    WITH s AS (SELECT id, query, created_at, CAST(created_at - INTERVAL 3 HOUR AS DATE) AS day FROM {{src}}),
      q AS (SELECT day, query, min(created_at) AS c, max(id) AS i FROM (SELECT *, min(created_at) OVER (PARTITION BY day, query) AS m FROM s) x
            WHERE created_at = m GROUP BY 1, 2),
      qs AS (SELECT day, string_agg(query, '|' ORDER BY c, i DESC) AS queries FROM q GROUP BY 1),
      n AS (SELECT day, count(DISTINCT r.business_id) AS leads FROM s JOIN {{search_results}} r ON r.search_id = s.id JOIN {{businesses}} b ON b.id = r.business_id
            WHERE {IS_LEAD} GROUP BY 1)
    SELECT strftime(qs.day, '%Y-%m-%d') AS day, coalesce(leads, 0) AS leads, queries FROM qs LEFT JOIN n ON n.day = qs.day"""


def _rolled(d: Inputs, recent: int | None, days: int | None) -> DataFrame:
    out = leads.day_rollup(d.searches_full(), d.search_results, d.businesses_full(), "-03:00", recent, days)
    return out.withColumns({"day": F.date_format("day", "yyyy-MM-dd"), "queries": F.array_join("queries", "|")})


query("A4_day_rollup", "day string, leads long, queries string", _ROLLUP.replace("{src}", "{searches}"))(lambda d: _rolled(d, None, None))
query("W13_recent_days", "day string, leads long, queries string",
      _ROLLUP.replace("{src}", "(SELECT * FROM {searches} ORDER BY created_at DESC, id DESC LIMIT 500) AS t") + " ORDER BY day DESC LIMIT 30")(
    lambda d: _rolled(d, fv.SEARCH_LIST_LIMIT, fv.DAY_LIST_LIMIT))
query("A5_list_summary", "total long, pending long, shown long, verified long, to_test long, high_opportunity long", f"""WITH {LEADS_SQL}
    SELECT count(*) AS total, count(*) FILTER (WHERE review_pending) AS pending, count(*) FILTER (WHERE coalesce(rating, 0) > 4.5) AS shown,
      count(*) FILTER (WHERE coalesce(rating, 0) > 4.5 AND whatsapp_state IN ('verificado', 'confirmado')) AS verified,
      count(*) FILTER (WHERE coalesce(rating, 0) > 4.5 AND whatsapp_state = 'por_probar') AS to_test,
      count(*) FILTER (WHERE coalesce(rating, 0) > 4.5 AND opportunity = 'ALTA') AS high_opportunity FROM leads WHERE is_lead""")(
    lambda d: leads.list_summary(all_leads(d), ["rating"]))
query("A5_pending_ids", "id long", f"WITH {LEADS_SQL} SELECT id FROM leads WHERE is_lead AND review_pending")(lambda d: leads.pending_ids(all_leads(d)))
query("A7_count_contacted", "contacted long", "SELECT count(*) AS contacted FROM {contacted}")(lambda d: d.contacted.agg(F.count("*").alias("contacted")))
query("A12_finding_counts", "id long, findings long, serious long", "SELECT id, n_findings AS findings, n_serious AS serious FROM {analyses}")(
    lambda d: d.analyses_full().select("id", F.size("findings").alias("findings"), leads.serious_findings().alias("serious")))

# ------------------------------------------------------------------ P22, F26, F27
query("P22_summaries", "nombre string, web string, web_estado string, whatsapp_estado string, telefono string, resenas long", """
    SELECT business_name AS nombre, website AS web, coalesce(website_status, 'POR VERIFICAR') AS web_estado, whatsapp_status AS whatsapp_estado,
      substr(phone_e164, 2) AS telefono, review_count AS resenas FROM {businesses}""")(
    lambda d: judgments.business_summary(d.businesses_full().withColumns({
        "position": F.lit(1), "created": F.lit(True), "whatsapp_evidence": F.col("whatsapp_url"), "website_raw": F.col("website"), "commune": F.lit(None).cast("string"),
        "opening_hours": F.lit(None).cast("string"), "description": F.lit(None).cast("string"), "services": F.lit(None).cast("string")})))
_DAYS = ", ".join(f"'{x}'" for x in fv.DAY_NAMES)
_MONTHS = ", ".join(f"'{x}'" for x in fv.MONTH_NAMES)
query("F26_dates", "id long, day string, clock string, long_date string", f"""
    SELECT id, strftime(CAST(created_at - INTERVAL 3 HOUR AS DATE), '%Y-%m-%d') AS day, strftime(created_at - INTERVAL 3 HOUR, '%d-%m-%Y %H:%M') AS clock,
      ([{_DAYS}])[isodow(created_at - INTERVAL 3 HOUR)] || ' ' || day(created_at - INTERVAL 3 HOUR) || ' de ' || ([{_MONTHS}])[month(created_at - INTERVAL 3 HOUR)] AS long_date
    FROM {{searches}}""")(
    lambda d: d.searches_full().select("id", F.date_format(tx.local_day("created_at", "-03:00"), "yyyy-MM-dd").alias("day"),
                                       tx.local_time("created_at", "-03:00").alias("clock"), tx.spanish_date(tx.local_day("created_at", "-03:00")).alias("long_date")))
query("F27_decimal_comma", "id long, shown string", "SELECT id, replace(printf('%.1f', rating), '.', ',') AS shown FROM {businesses}")(
    lambda d: d.businesses.select("id", tx.decimal_comma("rating").alias("shown")))
