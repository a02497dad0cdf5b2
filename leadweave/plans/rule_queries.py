"""Site status, findings, checks and analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions import phones as ph
from leadweave.operators import actions, findings, judgments, site_status
from leadweave.plans.inputs import Inputs
from leadweave.plans.registry import query

TODAY = "2026-12-01"


# ------------------------------------------------------------------ R1: one scenario per event, by its number
def fetched_sites(d: Inputs) -> DataFrame:
    k = F.col("event_id") % 16
    long_text = F.rpad(F.lit("Gasfitería a domicilio. "), 400, "texto ")
    case = lambda table, other=None: _case(k, table, other)
    none = F.lit(None).cast("string")
    return d.dealt.events.select(
        F.col("event_id").alias("site_id"),
        case({1: "https://www.instagram.com/x", 2: "https://wa.me/56987654321", 3: "https://linktr.ee/x", 4: "tel:123"}, F.lit("https://neg.cl/")).alias("url"),
        case({5: none, 14: none, 10: "https://www.instagram.com/neg/", 11: "https://accounts.google.com/v3/signin", 3: "https://linktr.ee/x"}, F.lit("https://neg.cl/inicio")).alias("f_final_url"),
        case({5: F.lit(None).cast("int"), 14: F.lit(None).cast("int"), 6: F.lit(404), 7: F.lit(403), 8: F.lit(503)}, F.lit(200)).alias("f_status"),
        case({15: "application/pdf"}, F.lit("text/html")).alias("f_content_type"),
        case({9: "Domain for sale"}, F.lit("Negocio")).alias("f_title"),
        case({13: "Cargando", 15: ""}, long_text).alias("f_text"),
        (~k.isin(5, 14, 15)).alias("f_has_html"),
        case({5: fv.DNS_REASON, 14: "La web no respondió en 15 segundos"}, none).alias("f_error"),
        (k == 12).alias("f_tls"),
        case({8: "https://neg.cl/r", 13: "https://neg.cl/r", 14: "https://neg.cl/r"}, none).alias("r_final_url"),
        F.when(k.isin(8, 13, 14), 200).alias("r_status"),
        case({13: "Just a moment..."}, F.lit("Negocio")).alias("r_title"),
        F.when(k.isin(8, 14), long_text).when(k == 13, "x").alias("r_text"),
        F.when(k.isin(8, 13, 14), True).alias("r_has_html"), none.alias("r_error"),
    )


def _case(k, table, other):
    chain = F.when(F.lit(False), F.lit(None))
    for n, value in table.items():
        chain = chain.when(k == n, F.lit(value) if isinstance(value, str) else value)
    return chain.otherwise(other)


_REASONS = {1: fv.REASON_SOCIAL_LINK, 2: fv.REASON_CONTACT_LINK, 3: fv.REASON_LINK_PAGE_ONLY, 4: fv.REASON_BAD_ADDRESS, 5: fv.DNS_REASON,
            6: "La web responde con error 404 (página no encontrada)", 7: fv.BOT_WALL_REASON, 9: "El dominio está a la venta", 10: fv.REASON_REDIRECT_SOCIAL,
            11: "La web no es pública: pide iniciar sesión en Google, así que los clientes no pueden verla", 12: fv.TLS_REASON, 13: fv.BOT_WALL_REASON,
            15: "La dirección no lleva a una página web (es un archivo application/pdf)"}
query("R1_site_status", "site_id long, status string, reason string, rendered boolean, read_content boolean", f"""SELECT event_id AS site_id,
      CASE WHEN event_id % 16 IN (0, 8, 14) THEN 'OK' WHEN event_id % 16 IN (1, 3, 10) THEN 'SOLO_REDES' WHEN event_id % 16 = 2 THEN 'SIN_WEB' WHEN event_id % 16 IN (7, 13) THEN 'BLOQUEADO' ELSE 'CAIDO' END AS status,
      CASE event_id % 16 {' '.join(f"WHEN {k} THEN '{v}'" for k, v in _REASONS.items())} END AS reason, event_id % 16 IN (8, 13, 14) AS rendered, event_id % 16 IN (0, 8, 12, 14) AS read_content FROM {{events}}""")(
    lambda d: site_status.site_status(fetched_sites(d)))
query("R8_status_findings", "id long, code string, title string, detail string, evidence string", """SELECT id, CASE website_status WHEN 'SIN_WEB' THEN 'sin_web' WHEN 'SOLO_REDES' THEN 'solo_redes' ELSE 'web_caida' END AS code,
      CASE website_status WHEN 'SIN_WEB' THEN 'No tiene web propia' WHEN 'SOLO_REDES' THEN 'Usa ' || CASE WHEN instagram IS NOT NULL AND facebook IS NOT NULL THEN 'Instagram y Facebook' WHEN instagram IS NOT NULL THEN 'Instagram'
        WHEN facebook IS NOT NULL THEN 'Facebook' ELSE 'redes sociales o una página de enlaces' END || ' en vez de una web propia' ELSE 'Su web no funciona' END AS title,
      CASE website_status WHEN 'SIN_WEB' THEN 'Quien lo busca en Google solo encuentra su ficha de Maps.' WHEN 'SOLO_REDES' THEN 'No tiene un sitio propio que muestre sus servicios y genere confianza.'
        ELSE coalesce(replace(status_note, 'web: ', ''), 'La web no abre.') END AS detail,
      CASE website_status WHEN 'SIN_WEB' THEN '' WHEN 'SOLO_REDES' THEN coalesce(website_maps, website, '') ELSE coalesce(website, '') END AS evidence
    FROM {businesses} WHERE website_status IN ('SIN_WEB', 'SOLO_REDES', 'CAIDO')""")(
    lambda d: d.businesses_full().select("id", F.explode(findings.status_findings()).alias("f")).select(
        "id", "f.code", "f.title", "f.detail", F.array_join("f.evidence", "|").alias("evidence")))


# ------------------------------------------------------------------ R9-R24: reviewed sites, one per business
def reviewed_sites(d: Inputs) -> DataFrame:
    k = F.col("id")
    texts = F.array().cast("array<string>")

    def one_of(test, *values: str):
        return F.when(test, F.array(*[F.lit(v) for v in values])).otherwise(texts)

    broken = lambda test, *urls: F.when(test, F.array(*[F.struct(F.lit(u).alias("url"), F.lit("error").alias("reason")) for u in urls])).otherwise(
        F.array().cast("array<struct<url:string,reason:string>>"))
    return d.businesses.select(
        k.alias("site_id"), "business_name", "city", "rating", "review_count", "phone_e164",
        _case(k % 10, {0: "CAIDO", 1: "SOLO_REDES", 2: "BLOQUEADO"}, F.lit("OK")).alias("status"), F.when(k % 20 == 0, "motivo").alias("reason"),
        F.lit("https://neg.cl/").alias("url"), F.when(k % 2 == 0, "http://neg.cl/").otherwise("https://neg.cl/").alias("final_url"),
        one_of(k % 5 == 0, "Llamar").alias("fakes_desktop"), one_of(k % 7 == 0, "Cotiza", "Llamar").alias("fakes_mobile"),
        one_of(k % 3 == 0, "x").alias("ctas_desktop"), one_of(k % 4 == 0, "x").alias("ctas_mobile"), F.lit(False).alias("wa_first_desktop"), (k % 2 == 0).alias("wa_first_mobile"),
        (k % 6 == 0).alias("tel_first_desktop"), F.lit(False).alias("tel_first_mobile"), ((k * 137) % 12000).cast("int").alias("load_ms"), F.when(k % 4 == 0, (k % 101).cast("int")).alias("psi"),
        F.lit(30).alias("requests"), F.lit(900).alias("weight_kb"), F.when(k % 8 == 0, 980).otherwise(390).alias("layout_width"), F.when(k % 9 == 0, 500).otherwise(390).alias("scroll_width"),
        F.lit(True).alias("has_desktop"), (k % 11 != 0).alias("has_mobile"), F.lit("d.jpg").alias("shot_desktop"), F.lit(None).cast("string").alias("shot_desktop_full"),
        F.when(k % 2 == 0, "m.jpg").alias("shot_mobile"), F.lit("mf.jpg").alias("shot_mobile_full"),
        one_of(k % 13 == 0, "https://wa.me/123").alias("wa_broken"), (k % 3 != 1).alias("wa_on_site"), broken(k % 5 == 1, "a", "b").alias("broken_links"), broken(k % 6 == 1, "i").alias("broken_images"),
        F.lit(True).alias("has_facts"), F.when(k % 2 == 0, F.concat(F.lit("Negocio en "), "city")).otherwise("Negocio").alias("title"),
        F.when(k % 3 == 0, F.array(F.lit("A"))).otherwise(F.array(F.lit("A"), F.lit("B"))).alias("h1"), F.array(F.lit("Zona")).alias("h2"), F.array(F.lit("Inicio")).alias("menu_items"),
        F.when(k % 4 != 0, "Desc").alias("meta_description"), F.lit(None).cast("string").alias("viewport"), one_of(k % 4 != 1, "+56987654321").alias("phones"), one_of(k % 4 != 1, "tel:1").alias("tel_links"),
        F.when(k % 3 == 0, F.array(F.lit("testimonios"))).when(k % 3 == 1, F.array(F.lit("garantía"))).otherwise(texts).alias("trust_kinds"), one_of(k % 5 == 2, "Rancagua").alias("places"),
        F.array(F.struct(F.when(k % 6 == 2, "Wix").otherwise("WordPress").alias("name"), F.lit("ev").alias("evidence"))).alias("builders"),
        F.array((2010 + k % 16).cast("int")).alias("copyright_years"), (k % 5 == 0).alias("has_map"), (k % 6 == 0).alias("has_local_business"),
        F.concat(F.lit("Bienvenidos a "), "business_name", F.when(k % 3 == 0, F.concat(F.lit(" en "), "city")).otherwise(""), F.when(k % 2 == 0, " Horario lunes. Servicios").otherwise("")).alias("visible_text"),
    )


_SITES = """s0 AS (SELECT id AS k, city, CASE WHEN id % 4 = 0 THEN greatest(1, CAST(round_even((id % 101) / 10.0, 0) AS BIGINT)) WHEN (id * 137) % 12000 < 1500 THEN 10 WHEN (id * 137) % 12000 < 2500 THEN 8
      WHEN (id * 137) % 12000 < 4000 THEN 6 WHEN (id * 137) % 12000 < 6000 THEN 4 WHEN (id * 137) % 12000 < 9000 THEN 2 ELSE 1 END AS speed, id % 5 = 2 OR id % 3 = 0 AS covers,
      id % 2 = 0 OR (id % 5 = 2 AND false) AS title_place FROM {businesses}),
  s AS (SELECT *, CASE WHEN title_place THEN 0 ELSE 1 END + CASE WHEN k % 3 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 4 <> 0 THEN 0 ELSE 1 END + CASE WHEN covers THEN 0 ELSE 1 END
      + CASE WHEN k % 4 <> 1 AND covers THEN 0 ELSE 1 END + CASE WHEN k % 6 = 0 THEN 0 ELSE 1 END + CASE WHEN k % 5 = 0 THEN 0 ELSE 1 END AS missing FROM s0)"""
_CODES = f"""{_SITES}, codes AS (SELECT k, CASE WHEN k % 10 = 0 THEN 'web_caida' WHEN k % 10 = 1 THEN 'solo_redes' WHEN k % 10 = 2 THEN '' ELSE concat_ws(',',
    CASE WHEN k % 5 = 0 OR k % 7 = 0 THEN 'boton_falso' END, CASE WHEN k % 13 = 0 THEN 'whatsapp_roto' END, CASE WHEN k % 3 = 1 THEN 'sin_whatsapp_web' END,
    CASE WHEN k % 8 = 0 AND k % 11 <> 0 THEN 'no_adaptada_celular' END, CASE WHEN speed <= 2 THEN 'lenta' END,
    CASE WHEN k % 3 <> 1 AND k % 11 <> 0 AND k % 2 = 1 THEN 'whatsapp_escondido_celular' END,
    CASE WHEN k % 3 <> 0 AND k % 6 <> 0 AND (k % 11 = 0 OR (k % 4 <> 0 AND k % 2 = 1)) THEN 'sin_llamado_accion' END,
    CASE WHEN k % 8 <> 0 AND k % 9 = 0 AND k % 11 <> 0 THEN 'se_sale_celular' END, CASE WHEN speed > 2 AND speed <= 4 THEN 'lenta' END, CASE WHEN k % 2 = 0 THEN 'sin_https' END,
    CASE WHEN k % 3 <> 0 THEN 'sin_testimonios' END, CASE WHEN k % 5 = 1 THEN 'enlaces_rotos' END, CASE WHEN k % 6 = 1 THEN 'imagenes_rotas' END,
    CASE WHEN 2010 + k % 16 <= 2024 THEN 'copyright_antiguo' END, CASE WHEN NOT covers THEN 'sin_cobertura' END, CASE WHEN missing >= 3 THEN 'seo_local_debil' END,
    CASE WHEN k % 4 = 1 THEN 'sin_telefono_click' END, CASE WHEN k % 6 = 2 THEN 'plantilla' END) END AS codes FROM s)"""


def _reviewed(d: Inputs) -> DataFrame:
    return findings.review_sites(reviewed_sites(d), F.lit(TODAY).cast("date"))


query("R9_R22_W17_review_findings", "site_id long, codes string", f"WITH {_CODES} SELECT k AS site_id, codes FROM codes")(
    lambda d: _reviewed(d).select("site_id", F.array_join(F.transform("findings", lambda f: f["code"]), ",").alias("codes")))
query("R10_R16_R20_finding_texts", "site_id long, title string", f"""WITH {_CODES}
    SELECT k AS site_id, CASE WHEN k % 5 = 0 AND k % 7 = 0 THEN 'Los botones “Llamar”, “Cotiza” no hacen nada al tocarlos' WHEN k % 5 = 0 THEN 'El botón “Llamar” no hace nada al tocarlo'
      ELSE 'Los botones “Cotiza”, “Llamar” no hacen nada al tocarlos' END AS title FROM codes WHERE codes LIKE '%boton_falso%'
    UNION ALL SELECT k, CASE WHEN (k * 137) % 12000 = 0 THEN 'La web es lenta' ELSE 'La web tarda ' || replace(printf('%.1f', ((k * 137) % 12000) / 1000.0), '.', ',') || ' s en cargar' END FROM codes WHERE codes LIKE '%lenta%'
    UNION ALL SELECT k, 'El pie de página muestra el año ' || (2010 + k % 16) || ': la web se ve desactualizada' FROM codes WHERE codes LIKE '%copyright%'""")(
    lambda d: _reviewed(d).select("site_id", F.explode("findings").alias("f")).filter(F.col("f.code").isin("boton_falso", "lenta", "copyright_antiguo")).select("site_id", "f.title"))
query("R23_A19_seo_checks", "site_id long, passed string, missing long", f"""WITH {_SITES} SELECT k AS site_id, concat_ws(',', CASE WHEN title_place THEN 'titulo_con_ciudad' END, CASE WHEN k % 3 = 0 THEN 'h1_unico' END,
      CASE WHEN k % 4 <> 0 THEN 'meta_descripcion' END, CASE WHEN covers THEN 'cobertura' END, CASE WHEN k % 4 <> 1 AND covers THEN 'nombre_direccion_telefono' END,
      CASE WHEN k % 6 = 0 THEN 'datos_estructurados' END, CASE WHEN k % 5 = 0 THEN 'mapa' END) AS passed, missing FROM s WHERE k % 10 > 2""")(
    lambda d: _reviewed(d).filter("status = 'OK'").select(
        "site_id", F.array_join(F.transform(F.filter("seo_local", lambda c: c["ok"]), lambda c: c["key"]), ",").alias("passed"), F.size(F.filter("seo_local", lambda c: ~c["ok"])).alias("missing")))
query("R24_info_checklist", "site_id long, passed string, open_items string", f"""WITH {_SITES} SELECT k AS site_id, concat_ws(',', CASE WHEN k % 2 = 0 THEN 'servicios' END, CASE WHEN covers THEN 'cobertura' END,
      CASE WHEN k % 4 <> 1 THEN 'telefono' END, CASE WHEN k % 3 <> 1 THEN 'whatsapp' END, CASE WHEN k % 2 = 0 THEN 'horarios' END, CASE WHEN k % 3 = 0 THEN 'testimonios' END,
      CASE WHEN k % 3 = 1 THEN 'confianza' END) AS passed, 'diferenciadores' AS open_items FROM s WHERE k % 10 > 2""")(
    lambda d: _reviewed(d).filter("status = 'OK'").select(
        "site_id", F.array_join(F.transform(F.filter("info_checklist", lambda c: F.coalesce(c["ok"], F.lit(False))), lambda c: c["key"]), ",").alias("passed"),
        F.array_join(F.transform(F.filter("info_checklist", lambda c: c["ok"].isNull()), lambda c: c["key"]), ",").alias("open_items")))
query("A17_link_errors", "site_id long, errors long, first string", f"""WITH {_SITES} SELECT k AS site_id,
      CASE WHEN k % 10 <= 2 THEN 0 ELSE CASE WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 1 THEN 2 ELSE 0 END END AS errors,
      CASE WHEN k % 10 <= 2 THEN NULL WHEN k % 5 = 0 THEN 'Botón sin enlace: Llamar' WHEN k % 7 = 0 THEN 'Botón sin enlace: Cotiza' WHEN k % 13 = 0 THEN 'WhatsApp roto: https://wa.me/123'
        WHEN k % 5 = 1 THEN 'Enlace roto: a' END AS first FROM s""")(
    lambda d: _reviewed(d).select("site_id", F.size("link_errors").alias("errors"), F.get("link_errors", F.lit(0)).alias("first")))
query("F33_A18_flags", "site_id long, overflow boolean, zoomed_out boolean, last_year long", """SELECT id AS site_id, id % 11 <> 0 AND CASE WHEN id % 9 = 0 THEN 500 ELSE 390 END > CASE WHEN id % 8 = 0 THEN 980 ELSE 390 END + 2 AS overflow,
    id % 11 <> 0 AND id % 8 = 0 AS zoomed_out, 2010 + id % 16 AS last_year FROM {businesses}""")(
    lambda d: findings.with_site_flags(reviewed_sites(d)).withColumn("last_year", F.array_max("copyright_years")))
query("R26_region_of_site", "site_id long, region string", """SELECT id AS site_id, CASE id % 12 WHEN 4 THEN 'MX' WHEN 5 THEN 'AR' WHEN 6 THEN 'US' WHEN 7 THEN 'ES' WHEN 11 THEN 'ES' ELSE 'CL' END AS region FROM {phones}""")(
    lambda d: d.phones.select(F.col("id").alias("site_id"), ph.normalize_phone("raw").alias("e164")).select("site_id", ph.phone_region("e164").alias("region")))
query("P24_P25_analysis_rows", "site_id long, scores string, shots string, opportunity_level string, rubric_version string", f"""WITH {_SITES}, e AS (SELECT *,
      CASE WHEN k % 10 <= 2 THEN 0 ELSE CASE WHEN k % 7 = 0 THEN 2 WHEN k % 5 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN k % 5 = 1 THEN 2 ELSE 0 END END AS errors FROM s)
    SELECT k AS site_id, '5=' || speed || ',9=' || CASE WHEN errors <= 0 THEN 10 WHEN errors <= 1 THEN 8 WHEN errors <= 3 THEN 6 WHEN errors <= 6 THEN 4 ELSE 2 END AS scores,
      CASE WHEN k % 2 = 0 THEN 'celular,celular_completa,escritorio' ELSE 'celular_completa,escritorio' END AS shots, CAST(NULL AS VARCHAR) AS opportunity_level, '{fv.RUBRIC_VERSION}' AS rubric_version FROM e""")(
    lambda d: _analysis_rows(d))


def _analysis_rows(d: Inputs) -> DataFrame:
    reviewed = _reviewed(d)
    measured = reviewed.select("site_id", "load_ms", "psi", F.size("link_errors").alias("link_errors"))
    built = judgments.build_analyses(reviewed, judgments.code_scores(measured), None)
    pairs = F.transform(F.array_sort(F.transform(F.map_values("rubric_scores"), lambda s: F.struct(s["id"].alias("id"), s["score"].alias("score")))), lambda s: F.concat(s["id"].cast("string"), F.lit("="), s["score"].cast("string")))
    return built.select("site_id", F.array_join(pairs, ",").alias("scores"), F.array_join(F.array_sort(F.map_keys("screenshots")), ",").alias("shots"), "opportunity_level", "rubric_version")


# ------------------------------------------------------------------ R29: runs are users, their events end them
query("R29_run_states", "run_id long, status string, message string", """
    WITH c AS (SELECT user_id AS run_id, count(*) FILTER (WHERE event_type = 'purchase') AS leads, count(*) FILTER (WHERE event_type = 'view') AS dup FROM {events} GROUP BY 1),
      w AS (SELECT o_custkey % (SELECT count(DISTINCT user_id) FROM {events}) AS run_id, max(CASE WHEN o_totalprice > 499000 THEN 3 WHEN o_totalprice > 498000 THEN 2 WHEN o_totalprice > 495000 THEN 1 ELSE 0 END) AS r FROM {orders} GROUP BY 1)
    SELECT c.run_id, CASE coalesce(r, 0) WHEN 3 THEN 'BLOQUEADO' WHEN 2 THEN 'FALLIDA' WHEN 1 THEN 'DETENIDA' ELSE 'TERMINADA' END AS status,
      CASE coalesce(r, 0) WHEN 3 THEN '⛔ Google bloqueó la búsqueda: x Se guardaron ' || leads || ' leads.' WHEN 2 THEN '✖ La búsqueda falló: x' WHEN 1 THEN 'Detenida por ti: ' || leads || ' leads guardados.'
          || CASE WHEN dup > 0 THEN ' ' || dup || ' repetidos saltados.' ELSE '' END
        ELSE CASE WHEN leads >= 14 THEN 'Listo: ' || leads || ' leads nuevos.' ELSE 'La búsqueda no tenía más negocios nuevos: ' || leads || ' de 14 leads.' END
          || CASE WHEN dup > 0 THEN ' ' || dup || ' repetidos saltados.' ELSE '' END || CASE WHEN leads >= 14 THEN '' ELSE ' Prueba otra búsqueda para completar el día.' END END AS message
    FROM c LEFT JOIN w ON w.run_id = c.run_id""")(lambda d: _runs(d))


def _runs(d: Inputs) -> DataFrame:
    users = d.events.select("user_id").distinct().count()
    counters = d.events.groupBy(F.col("user_id").alias("run_id")).agg(
        F.count_if(F.col("event_type") == "purchase").alias("leads"), F.count_if(F.col("event_type") == "view").alias("duplicates")).withColumns(
        {"target": F.lit(14), "no_website": F.lit(0), "webs_total": F.lit(0), "webs_done": F.lit(0)})
    ends = d.orders.select((F.col("o_custkey") % users).alias("run_id"), F.when(F.col("o_totalprice") > 499000, "blocked").when(F.col("o_totalprice") > 498000, "failed").when(
        F.col("o_totalprice") > 495000, "stopped").alias("event"), F.lit("x").alias("error"))
    return actions.run_states(counters, ends)
