"""Listing pages, place panels, sources and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.phones import pretty_number
from leadweave.operators import judgments, leads, listings, site_status
from leadweave.operators.page_elements import parse_pages
from leadweave.plans.fusion_queries import _ERROR_SQL, _responses
from leadweave.plans.inputs import Inputs
from leadweave.plans.mart_queries import LEADS_SQL, all_leads, ranked
from leadweave.plans.registry import query
from leadweave.session import work_folder
from leadweave.sources import exports, plugins, scans


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _s(name: str) -> Column:
    return F.col(name).cast("string")


# ------------------------------------------------------------------ X19, W7: one list page per run of forty businesses
def list_pages(d: Inputs) -> DataFrame:
    card = _text(
        '<div class="card"><a href="https://www.google.com/maps/place/N', _s("id"), "/data=!1s0x", _s("id"), ':0x1!8m2?entry=t" aria-label="', F.col("business_name"), '"></a>',
        "<div><span>Gasfíter</span><span>", F.coalesce(pretty_number(F.expr("substr(phone_e164, 2)")), F.lit("sin fono")), "</span>",
        F.when(F.col("website").isNotNull(), _text('<a data-value="Sitio web" href="/url?q=', F.col("website"), '&amp;sa=U">Sitio web</a>')).otherwise(""), "</div></div>")
    cards = d.businesses.select((F.floor(F.col("id") / 40)).alias("page_id"), "id", card.alias("card"))
    packed = cards.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("id", "card"))).alias("c"))
    body = F.array_join(F.transform("c", lambda c: c["card"]), "")
    again = F.get("c", F.lit(0))["card"]  # the list repeats its first place at the end
    return packed.select("page_id", F.lit("https://www.google.com/maps/search/x").alias("url"), _text(
        '<html><body><div role="feed">', body, again, "</div><p>Has llegado al final de la lista.</p></body></html>").alias("html"))


query("X19_W7_listing_cards", "page_id long, position long, name string, place_id long, website string, phone_e164 string", """
    SELECT CAST(floor(id / 40) AS BIGINT) AS page_id, id % 40 + 1 AS position, business_name AS name, id AS place_id, replace(website, '?utm_source=maps', '') AS website, phone_e164 FROM {businesses}""")(
    lambda d: listings.listing_cards(parse_pages(list_pages(d))).withColumn("place_id", F.regexp_extract("url", r"/N(\d+)/", 1).cast("long")))
query("X19_end_of_list", "page_id long, ended boolean", "SELECT DISTINCT CAST(floor(id / 40) AS BIGINT) AS page_id, true AS ended FROM {businesses}")(
    lambda d: parse_pages(list_pages(d)).select("page_id", listings.end_of_list().alias("ended")))


# ------------------------------------------------------------------ X20-X22, P21: one panel per business
def panels(d: Inputs) -> DataFrame:
    reviews = F.regexp_replace(_s("review_count"), r"(\d)(?=(\d{3})$)", "$1.")
    html = _text(
        '<div role="main"><div><div><h1>', F.col("business_name"), "</h1>",
        F.when(F.col("rating").isNotNull(), _text('<span role="img" aria-label="', F.replace(_s("rating"), F.lit("."), F.lit(",")), ' estrellas "></span>')).otherwise(""),
        F.when(F.col("review_count").isNotNull(), _text('<span role="img" aria-label="', reviews, ' reseñas">(x)</span>')).otherwise(""),
        '<button jsaction="pane.x.category">', F.col("category"), "</button></div></div>",
        '<div role="region" aria-label="Información de ', F.col("business_name"), '"><button data-item-id="address" aria-label="Dirección: ', F.col("address"), ' "></button>',
        F.when(F.col("phone_e164").isNotNull(), _text('<button data-item-id="phone:tel:', F.col("phone_e164"), '" aria-label="Teléfono: ', F.expr("substr(phone_e164, 4)"), ' "></button>')).otherwise(""),
        F.when(F.col("website").isNotNull(), _text('<a data-item-id="authority" href="/url?q=', F.col("website"), '&amp;sa=U">Sitio</a>')).otherwise(""),
        F.when(F.col("instagram").isNotNull(), _text('<a href="', F.col("instagram"), '">IG</a>')).otherwise(""),
        '<a href="https://support.google.com/x">Ayuda</a>',
        '<button aria-label="lunes, De ', (F.col("id") % 12).cast("string"), ' a 18, Copiar el horario"></button><button aria-label="domingo, Cerrado, Copiar el horario"></button></div>',
        '<div class="review">Me atendió por <a href="https://wa.me/56911111111">wa.me/56911111111</a></div>',
        "<div><h2>Del propietario</h2><p>Descripción de ", _s("id"), "</p></div><div><h2>Opciones de servicio</h2><ul><li aria-label=\"Ofrece domicilio\">A</li><li>Retiro</li></ul></div>",
        "<div><h2>Reseñas</h2><ul><li>no</li></ul></div></div>")
    return d.dealt.businesses.select(F.col("id").alias("page_id"), _text("https://www.google.com/maps/place/n", _s("id"), "/@-34.1,-70.7,17z?hl=es").alias("url"), html.alias("html"))


def _catalog(d: Inputs) -> DataFrame:
    name = F.expr("translate(n_name, '0123456789_', 'abcdefghij-')")
    return d.nation.select(name.alias("name"), name.alias("folded"), F.lit(False).alias("ambiguous"))


def _places(d: Inputs) -> DataFrame:
    return listings.places(parse_pages(panels(d)), _catalog(d))


_SITE_KIND = "CASE WHEN website IS NULL THEN NULL WHEN website LIKE '%instagram%' THEN 'red_social' WHEN website LIKE '%linktr.ee%' THEN 'agregador' ELSE 'web_propia' END"
query("X20_place_panels", "page_id long, maps_url string, name string, category string, address string, city string, commune string, phone_e164 string, website string, website_kind string, rating double, reviews long", f"""
    SELECT id AS page_id, google_maps_url AS maps_url, business_name AS name, category, address, city, city AS commune, phone_e164, replace(website, '?utm_source=maps', '') AS website, {_SITE_KIND} AS website_kind,
      rating, review_count AS reviews FROM {{businesses}}""")(lambda d: _places(d).withColumnRenamed("review_count", "reviews"))
query("X20_panel_links", "page_id long, links long, instagram string", """SELECT id AS page_id, CASE WHEN website IS NULL THEN 0 ELSE 1 END + CASE WHEN instagram IS NULL THEN 0 ELSE 1 END AS links,
    CASE WHEN website LIKE '%instagram%' THEN lower(rtrim(website, '/')) WHEN instagram IS NOT NULL THEN lower(rtrim(instagram, '/')) END AS instagram FROM {businesses} WHERE website IS NOT NULL OR instagram IS NOT NULL""")(
    lambda d: listings.panel_links(_places(d)).select("page_id", F.size("links").alias("links"), "instagram"))
query("X21_opening_hours", "page_id long, monday string, sunday string, days long", "SELECT id AS page_id, 'De ' || CAST(id % 12 AS VARCHAR) || ' a 18' AS monday, 'Cerrado' AS sunday, 2 AS days FROM {businesses}")(
    lambda d: _places(d).select("page_id", F.try_element_at("opening_hours", F.lit("lunes")).alias("monday"), F.try_element_at("opening_hours", F.lit("domingo")).alias("sunday"), F.size("opening_hours").alias("days")))
query("X22_about_sections", "page_id long, sections string, description string, services string", """SELECT id AS page_id, 'Del propietario|Opciones de servicio' AS sections, 'Descripción de ' || CAST(id AS VARCHAR) AS description,
    'Ofrece domicilio|Retiro' AS services FROM {businesses}""")(
    lambda d: listings.about_sections(parse_pages(panels(d))).select("page_id", F.array_join(F.transform("about", lambda s: s["title"]), "|").alias("sections"),
                                                                      listings.description_of(F.col("about")).alias("description"), F.array_join(listings.services_of(F.col("about")), "|").alias("services")))
query("P21_place_to_business", "google_maps_url string, business_name string, website string, website_status string, sourced long, website_maps string", f"""
    SELECT google_maps_url, business_name, CASE WHEN {_SITE_KIND} IN ('web_propia', 'agregador') THEN replace(website, '?utm_source=maps', '') END AS website,
      CASE WHEN website IS NULL THEN 'SIN_WEB' WHEN {_SITE_KIND} = 'web_propia' THEN NULL ELSE 'SOLO_REDES' END AS website_status,
      6 + CASE WHEN phone_e164 IS NULL THEN 0 ELSE 2 END + CASE WHEN rating IS NULL THEN 0 ELSE 1 END + CASE WHEN review_count IS NULL THEN 0 ELSE 1 END + CASE WHEN website IS NULL THEN 0 ELSE 1 END
        + CASE WHEN {_SITE_KIND} = 'agregador' THEN 1 ELSE 0 END AS sourced,
      CASE WHEN {_SITE_KIND} IN ('red_social', 'agregador') THEN '/url?q=' || website || '&sa=U' END AS website_maps FROM {{businesses}}""")(
    lambda d: listings.place_to_business(_places(d)).withColumns({"sourced": F.size("field_sources"), "website_maps": F.try_element_at("field_sources", F.lit("website_maps"))}))

# ------------------------------------------------------------------ S2-S5
query("S2_contact_text", "line string, lines long", "SELECT line, count(*) AS lines FROM {contact_lines} WHERE trim(line) <> '' GROUP BY 1")(lambda d: _contact_text(d))


def _contact_text(d: Inputs) -> DataFrame:
    folder = work_folder(d.spark, "lines")
    d.contact_lines.select("line").write.text(folder)
    return scans.contact_lines(d.spark, folder).groupBy("line").agg(F.count("*").alias("lines"))


query("S3_S4_decoded_pages", "doc_id long, html string", """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'Hola ' || CAST(doc_id AS VARCHAR) || chr(65533) WHEN doc_id % 11 = 1 THEN '“Hola ' || CAST(doc_id AS VARCHAR) || '”'
      WHEN doc_id % 11 = 2 THEN 'При ' || CAST(doc_id AS VARCHAR) WHEN doc_id % 5 = 4 THEN '' WHEN doc_id % 5 = 3 THEN '<meta charset="iso-8859-1">' || 'áéñ ' || CAST(doc_id AS VARCHAR) ELSE text END AS html FROM {documents}""")(
    lambda d: _decoded(d))


def _decoded(d: Inputs) -> DataFrame:
    """Bodies in several charsets: a cut UTF-8 character, windows-1252 quotes, windows-1251 letters, declared, named and unknown ones."""
    number, kind = F.encode(_s("doc_id"), "UTF-8"), F.col("doc_id") % 11
    body = F.when(kind == 0, F.concat(F.encode(F.lit("Hola "), "UTF-8"), number, F.unhex(F.lit("C3")))).when(
        kind == 1, F.concat(F.unhex(F.lit("93486F6C6120")), number, F.unhex(F.lit("94")))).when(kind == 2, F.concat(F.unhex(F.lit("CFF0E820")), number)).when(
        F.col("doc_id") % 5 == 3, F.encode(_text('<meta charset="iso-8859-1">', "áéñ ", _s("doc_id")), "ISO-8859-1")).when(
        F.col("doc_id") % 5 == 2, F.encode("text", "UTF-16")).otherwise(F.encode("text", "UTF-8"))
    charset = F.when(kind == 0, F.lit(None)).when(kind == 1, "windows-1252").when(kind == 2, "windows-1251").when(F.col("doc_id") % 5 == 2, "utf-16").when(F.col("doc_id") % 5 == 1, "no-such-charset")
    html = F.when((kind > 2) & (F.col("doc_id") % 5 == 4), "application/pdf").otherwise("text/html; charset=x")
    return site_status.with_decoded_html(d.documents.select("doc_id", body.alias("body"), charset.alias("charset"), html.alias("type")), "body", "charset", "type").select("doc_id", "html")


query("S5_place_catalog", "name string, folded string, ambiguous boolean", """SELECT DISTINCT 'Ñandú ' || n_name AS name, 'Nandu ' || n_name AS folded, n_regionkey = 0 AS ambiguous FROM {nation}""")(lambda d: _catalog_file(d))


def _catalog_file(d: Inputs) -> DataFrame:
    name = _text("Ñandú ", F.col("n_name"))
    regions = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(name).alias("names"), F.collect_list(F.when(F.col("n_regionkey") == 0, name)).alias("amb"))
    # One document for each region: a catalog is read from as many files as there are.
    documents = regions.select(F.to_json(F.struct(F.create_map("r_name", "names").alias("regiones"), F.col("amb").alias("ambiguas"))).alias("value"))
    folder = work_folder(d.spark, "catalog")
    documents.write.text(folder)
    return scans.place_catalog(d.spark, folder)


# ------------------------------------------------------------------ S7, S8: log lines of the event table
def _logs(d: Inputs) -> DataFrame:
    level = F.rpad(F.when(F.col("event_type") == "error", "ERROR").otherwise("INFO"), 7, " ")
    line = F.when(F.col("event_id") % 50 == 0, "  traza sin formato").otherwise(_text(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), " | ", level, " | ", F.col("event_type"), " ", _s("user_id")))
    return scans.parse_log_lines(d.events.select(line.alias("value"), F.to_date("ts").alias("day"), F.col("event_id").alias("line_no")))


_LOG_SQL = """SELECT event_id AS line_no, CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_type = 'error' THEN 'ERROR' ELSE 'INFO' END AS level,
    CASE WHEN event_id % 50 = 0 THEN '  traza sin formato' ELSE event_type || ' ' || CAST(user_id AS VARCHAR) END AS message, CAST(ts AS DATE) AS day FROM {events}"""
query("S7_log_lines", "line_no long, level string, message string", _LOG_SQL)(_logs)
query("S7_last_log_lines", "line_no long, message string", f"SELECT line_no, message FROM ({_LOG_SQL}) l WHERE day = DATE '2024-01-15' ORDER BY line_no DESC")(
    lambda d: scans.last_log_lines(_logs(d), F.lit("2024-01-15").cast("date")))
query("S8_kept_logs", "line_no long", f"SELECT line_no FROM ({_LOG_SQL}) l WHERE day >= DATE '2024-02-10' - INTERVAL 30 DAY")(lambda d: scans.kept_logs(_logs(d), F.lit("2024-02-10").cast("date")))

# ------------------------------------------------------------------ S9-S12
_CSV = [f"c{i}" for i in range(len(fv.CSV_COLUMNS))]
_CSV_SQL = f"""WITH {LEADS_SQL}, x AS (SELECT l.*, b.category, b.whatsapp_broken_button, b.address, b.instagram, b.facebook, b.google_maps_url, b.phone_e164 FROM leads l JOIN {{businesses}} b ON b.id = l.id WHERE is_lead AND {{{{extra}}}}),
    n AS (SELECT *, regexp_extract(whatsapp_url, 'wa\\.me/(\\d+)', 1) AS g FROM x)
    SELECT name AS c0, category AS c1, city AS c2, coalesce(whatsapp_url, '') AS c3, CASE WHEN g <> '' THEN '+56 9 ' || substr(g, 4, 4) || ' ' || substr(g, 8) ELSE '' END AS c4,
      CASE whatsapp_state WHEN 'confirmado' THEN 'Confirmado por ti' WHEN 'verificado' THEN 'Verificado (publicado por el negocio)' WHEN 'por_probar' THEN 'Por probar (celular)' ELSE 'Sin WhatsApp' END AS c5,
      coalesce(confidence, '') AS c6, '' AS c7, CASE WHEN whatsapp_broken_button THEN 'sí' ELSE 'no' END AS c8, coalesce(substr(phone_e164, 2), '') AS c9, coalesce(website, '') AS c10, website_status AS c11,
      coalesce(website_reason, '') AS c12, array_to_string([CASE WHEN findings >= 1 THEN 'Hallazgo ' || i END for i in range(1, findings + 1)], ' | ') AS c13, coalesce(CAST(score AS VARCHAR), '') AS c14, coalesce(opportunity, '') AS c15,
      coalesce(replace(printf('%.1f', rating), '.', ','), '') AS c16, coalesce(CAST(reviews AS VARCHAR), '') AS c17, address AS c18, coalesce(instagram, '') AS c19, coalesce(facebook, '') AS c20,
      google_maps_url AS c21, query AS c22 FROM n"""
query("S9_csv_rows", ", ".join(f"{c} string" for c in _CSV), _CSV_SQL.replace("{{extra}}", "true"))(lambda d: exports.csv_rows(all_leads(d)).toDF(*_CSV))


def _exported(d: Inputs) -> DataFrame:
    folder = work_folder(d.spark, "export")
    exports.export_day(all_leads(d), folder, ["rating"])
    back = d.spark.read.option("sep", ";").option("header", True).option("escape", '"').csv(folder)
    return back.toDF(*_CSV).fillna("")


query("S10_filtered_export", ", ".join(f"{c} string" for c in _CSV), _CSV_SQL.replace("{{extra}}", "coalesce(l.rating, 0) > 4.5"))(_exported)
query("S11_json_documents", "document string", """SELECT '{"id":' || id || ',"business_name":"' || business_name || '","city":"' || city || '","website":' || coalesce('"' || website || '"', 'null') || '}' AS document FROM {businesses}""")(
    lambda d: exports.json_documents(d.businesses.select("id", "business_name", "city", "website")))
query("S12_evidence_documents", "site_id long, name string, findings long, visible_text string", """SELECT doc_id AS site_id, 'Doc ' || CAST(doc_id AS VARCHAR) AS name, 1 AS findings, text AS visible_text FROM {documents}""")(
    lambda d: exports.evidence_documents(d.documents.select(
        F.col("doc_id").alias("site_id"), _text("Doc ", _s("doc_id")).alias("business_name"), F.lit(None).cast("string").alias("city"), F.lit(4.5).alias("rating"), F.lit(3).alias("review_count"), F.col("source").alias("category"),
        F.lit("https://neg.cl/").alias("url"), F.struct(F.col("n_chars")).alias("facts"), F.array(F.struct(F.lit("x").alias("code"), F.lit("y").alias("capture"))).alias("findings"),
        F.array(F.struct(F.lit(9).alias("id"))).alias("code_scores"), F.col("text").alias("visible_text"))).select(
        "site_id", F.get_json_object("document", "$.negocio.nombre").alias("name"), F.size(F.from_json(F.get_json_object("document", "$.hallazgos_automaticos"), "array<map<string,string>>")).alias("findings"), "visible_text"))
query("S14_place_cards", "run_id long, listings long", "SELECT run_id, count(*) AS listings FROM {listings} GROUP BY 1")(lambda d: _cards(d))


def _card_rows(d: Inputs) -> DataFrame:
    folder = work_folder(d.spark, "cards")
    d.listings.select("run_id", F.col("position").cast("int").alias("position"), F.lit("n").alias("name"), F.col("place").alias("url"), F.lit(True).alias("card_seen"),
                      F.lit(None).cast("string").alias("website"), F.lit(None).cast("string").alias("phone_e164")).write.parquet(folder)
    return scans.place_cards(d.spark, folder)


def _cards(d: Inputs) -> DataFrame:
    return _card_rows(d).groupBy("run_id").agg(F.count("*").alias("listings"))


query("E3_card_rows", "run_id long, position long, name string, url string, card_seen boolean, website string", """SELECT run_id, position, 'n' AS name, place AS url, true AS card_seen,
    NULL AS website FROM {listings}""")(_card_rows)


query("P23_compact_facts", "page_id long, columns string", "SELECT page_id, 'page_id,title,enlaces_internos' AS columns FROM {html_pages}")(
    lambda d: judgments.compact_facts(d.html_pages.select("page_id", F.col("url").alias("title"), F.col("html").alias("visible_text"), F.array("url").alias("internal_links"))).transform(
        lambda x: x.withColumn("columns", F.lit(",".join(x.columns)))))
query("E1_E2_named_registries", "id long, filters_passed long, place long", f"""WITH {LEADS_SQL}, l AS (SELECT * FROM leads WHERE is_lead) SELECT id,
      CASE WHEN whatsapp_state IN ('verificado', 'confirmado') THEN 1 ELSE 0 END + CASE WHEN whatsapp_state = 'por_probar' THEN 1 ELSE 0 END + CASE WHEN coalesce(rating, 0) > 4.5 THEN 1 ELSE 0 END
      + CASE WHEN coalesce(reviews, 0) > 100 THEN 1 ELSE 0 END + CASE WHEN opportunity = 'ALTA' THEN 1 ELSE 0 END AS filters_passed,
      row_number() OVER (PARTITION BY query ORDER BY coalesce(rating, 0) DESC, coalesce(reviews, 0) DESC, position, id) AS place FROM l""")(
    lambda d: all_leads(d).select("id", sum(F.when(leads.FILTERS[n](), 1).otherwise(0) for n in ("whatsapp", "probar", "rating", "resenas", "oportunidad")).alias("filters_passed")).join(
        ranked(all_leads(d), "rating"), "id"))
query("U8_append_analyses", "business_id long, analyses long, failed long", """
    SELECT business_id, count(*) AS analyses, count(error) AS failed FROM {analyses} GROUP BY 1""")(lambda d: _appended(d))


def _appended(d: Inputs) -> DataFrame:
    """The history after two appends: the failed analyses first, then the others."""
    folder = work_folder(d.spark, "analyses")
    exports.append_analyses(d.analyses.filter("error IS NOT NULL"), folder)
    exports.append_analyses(d.analyses.filter("error IS NULL"), folder)
    return d.spark.read.parquet(folder).groupBy("business_id").agg(F.count("*").alias("analyses"), F.count("error").alias("failed"))


# ------------------------------------------------------------------ E3-E5: what a user plugs in are plain frames
query("E3_E4_E5_plugged_frames", "listings long, answers long, unusable long, places long", f"""
    SELECT (SELECT count(*) FROM {{listings}}) AS listings, count(*) FILTER (WHERE turn NOT IN (2, 3) AND role = 'user') AS answers,
      count(*) FILTER (WHERE turn IN (2, 3) OR role <> 'user') AS unusable, (SELECT count(*) FROM {{nation}}) AS places FROM {{conversations}}""")(lambda d: _plugged(d))


def _plugged(d: Inputs) -> DataFrame:
    """Any frame of cards, of model responses or of catalog names takes the place of the built-in source."""
    answers = judgments.read_responses(_responses(d)).agg(
        F.count_if(F.col("error").isNull()).alias("answers"), F.count_if(F.col("error").isNotNull()).alias("unusable")).withColumn("one", F.lit(1))
    cards = _cards(d).agg(F.sum("listings").alias("listings")).withColumn("one", F.lit(1))
    names = _catalog_file(d).agg(F.count("*").alias("places")).withColumn("one", F.lit(1))
    return answers.join(cards, "one").join(names, "one")


def _written(d: Inputs, documents: DataFrame, key: str) -> str:
    """JSON lines in one folder for each key, as a capturing program leaves them."""
    folder = work_folder(d.spark, "capture")
    documents.write.partitionBy(key).text(folder)
    plugins.register_sources(d.spark)
    return folder


query("E3_plugged_cards", "run_id long, position long, name string, url string, card_seen boolean, website string", """SELECT run_id, position, 'n' || CAST(position AS VARCHAR) AS name, place AS url, position % 2 = 0 AS card_seen,
    CASE WHEN position % 3 = 0 THEN 'https://n.cl/' || CAST(run_id AS VARCHAR) END AS website FROM {listings}""")(lambda d: _plugged_cards(d))


def _plugged_cards(d: Inputs) -> DataFrame:
    card = F.to_json(F.struct("position", _text("n", _s("position")).alias("name"), F.col("place").alias("url"), (F.col("position") % 2 == 0).alias("card_seen"),
                              F.when(F.col("position") % 3 == 0, _text("https://n.cl/", _s("run_id"))).alias("website")))
    folder = _written(d, d.listings.repartition("run_id").select("run_id", card.alias("value")), "run_id")
    return d.spark.read.format("captured_cards").load(folder)


query("E4_plugged_judgments", "site_id long, error string, params long, problems long, strengths long", f"""WITH c AS (SELECT conv_id * 100 + turn AS site_id, {_ERROR_SQL} AS error FROM {{conversations}})
    SELECT site_id, error, CASE WHEN error IS NULL THEN 3 END AS params, CASE WHEN error IS NULL THEN 2 END AS problems, CASE WHEN error IS NULL THEN 1 END AS strengths FROM c""")(lambda d: _plugged_judgments(d))


def _plugged_judgments(d: Inputs) -> DataFrame:
    answers = _responses(d).select(
        F.to_json(F.struct("site_id", "stop_reason", "response")).alias("value"), _text("m", (F.col("conv_id") % 3).cast("string")).alias("provider"))
    read = d.spark.read.format("captured_judgments").load(_written(d, answers, "provider"))
    size = lambda name: F.when(F.col("error").isNull(), F.size(F.col("answer")[name]))
    return judgments.read_responses(read).select("site_id", "error", size("parametros").alias("params"), size("problemas").alias("problems"), size("puntos_fuertes").alias("strengths"))


query("E5_plugged_catalog", "country string, name string, folded string, ambiguous boolean", """SELECT DISTINCT upper(r_name) AS country, 'Ñandú ' || n_name AS name, 'Nandu ' || n_name AS folded, n_regionkey = 0 AS ambiguous
    FROM {nation} JOIN {region} ON r_regionkey = n_regionkey""")(lambda d: _plugged_catalog(d))


def _plugged_catalog(d: Inputs) -> DataFrame:
    """The place names of the nations, one document for each region; each name with the country its folder names."""
    name = _text("Ñandú ", F.col("n_name"))
    regions = d.nation.join(d.region, F.col("n_regionkey") == F.col("r_regionkey")).groupBy("r_name").agg(F.collect_list(name).alias("names"), F.collect_list(F.when(F.col("n_regionkey") == 0, name)).alias("amb"))
    documents = regions.select(F.to_json(F.struct(F.create_map("r_name", "names").alias("regiones"), F.col("amb").alias("ambiguas"))).alias("value"), F.upper("r_name").alias("country"))
    rows = d.spark.read.format("region_catalogs").load(_written(d, documents, "country"))
    return rows.select("country", "name").distinct().join(plugins.catalog_names(rows), "name")
