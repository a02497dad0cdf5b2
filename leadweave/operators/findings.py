"""Rule findings, local-SEO checks and the information checklist."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import barrier, blank_to_null, is_true
from leadweave.functions.scoring import speed_reason, speed_score
from leadweave.functions.text import fold_accents
from leadweave.schemas import FINDING_DDL

NO_TEXTS = "array<string>"


def finding(
    code: str, title: Column | str, detail: Column | str | None, severity: Column | str,
    evidence: Column | None = None, param: int | None = None, capture: Column | None = None,
) -> Column:
    def text(value: Column | str | None) -> Column:
        return (F.lit(value) if value is None or isinstance(value, str) else value).cast("string")

    return F.struct(
        F.lit(code).alias("code"), text(title).alias("title"), text(detail).alias("detail"),
        (F.array().cast(NO_TEXTS) if evidence is None else evidence).alias("evidence"), text(severity).alias("severity"),
        F.lit(param).cast("int").alias("param"), text(capture).alias("capture"),
    )


def _only(condition: Column, value: Column) -> Column:
    return F.when(is_true(condition), value)


def status_findings() -> Column:
    """Findings that follow from the stored site status, without opening the site."""
    sources = F.col("field_sources")
    reason = blank_to_null(F.regexp_replace(F.coalesce(sources["website_status"], F.lit("")), "^web: ", ""))
    networks = F.concat_ws(" y ", F.when(F.coalesce("instagram", F.lit("")) != "", "Instagram"), F.when(F.coalesce("facebook", F.lit("")) != "", "Facebook"))
    where = F.coalesce(blank_to_null(networks), F.lit("redes sociales o una página de enlaces"))
    shown = F.coalesce(blank_to_null(F.coalesce(sources["website_maps"], F.lit(""))), F.col("website"), F.lit(""))
    status = F.col("website_status")
    one = (
        F.when(status == fv.SITE_NONE, finding("sin_web", "No tiene web propia", "Quien lo busca en Google solo encuentra su ficha de Maps.", "alta"))
        .when(status == fv.SITE_ONLY_SOCIAL, finding(
            "solo_redes", F.concat(F.lit("Usa "), where, F.lit(" en vez de una web propia")),
            "No tiene un sitio propio que muestre sus servicios y genere confianza.", "alta", F.array(shown)))
        .when(status == fv.SITE_DOWN, finding(
            "web_caida", "Su web no funciona", F.coalesce(reason, F.lit("La web no abre.")), "alta", F.array(F.coalesce("website", F.lit("")))))
    )
    return F.array_compact(F.array(one)).cast(f"array<{FINDING_DDL}>")


# ------------------------------------------------------------------ reviewed sites
# One row per site with: status, reason, url, final_url; fakes_desktop, fakes_mobile,
# ctas_desktop, ctas_mobile, wa_first_desktop/_mobile, tel_first_desktop/_mobile, load_ms, psi,
# requests, weight_kb, layout_width, scroll_width, has_desktop, has_mobile, shot_desktop,
# shot_mobile, shot_mobile_full; wa_broken, wa_on_site; broken_links, broken_images
# (array<struct<url,reason>>); and the page facts (has_facts, title, h1, h2, menu_items,
# meta_description, viewport, phones, tel_links, trust_kinds, places, builders,
# copyright_years, has_map, has_local_business, visible_text) plus business_name and city.

def _at_most(values: Column | str, limit: int | None) -> Column:
    return (F.col(values) if isinstance(values, str) else values) if limit is None else F.slice(values, 1, limit)


def with_site_flags(sites: DataFrame, name_words_needed: int = 2) -> DataFrame:
    """F33 and the intermediate values the rules share. A name counts as seen by its first ``name_words_needed`` longer words (a rule of the product)."""
    text = F.lower(fold_accents(F.coalesce("visible_text", F.lit(""))))
    name_words = F.slice(F.filter(
        F.split(F.trim(F.lower(fold_accents(F.coalesce("business_name", F.lit(""))))), r"\s+"), lambda w: F.length(w) >= 4
    ), 1, name_words_needed)
    sites = sites.withColumns({
        "_text": text,
        "_city": F.lower(fold_accents(F.coalesce("city", F.lit("")))),
        "_fakes": F.array_distinct(F.concat(F.coalesce("fakes_desktop", F.array().cast(NO_TEXTS)), F.coalesce("fakes_mobile", F.array().cast(NO_TEXTS)))),
        "_name_words": name_words,
        "_speed": speed_score("load_ms", "psi"),
        "overflow": is_true(F.col("has_mobile") & (F.col("scroll_width") > F.col("layout_width") + 2)),
        "zoomed_out": is_true(F.col("has_mobile") & (F.col("layout_width") > 390 + 10)),
    })
    in_title = F.exists(
        F.filter(F.array_append(F.transform(F.coalesce("places", F.array().cast(NO_TEXTS)), lambda p: F.lower(fold_accents(p))), F.col("_city")), lambda p: p != ""),
        lambda p: F.lower(fold_accents(F.coalesce("title", F.lit("")))).contains(p),
    )
    return sites.withColumns({
        "_covers": (F.size("places") > 0) | ((F.col("_city") != "") & F.col("_text").contains(F.col("_city"))),
        "_title_place": in_title,
        "_name_seen": (F.size("_name_words") > 0) & F.forall("_name_words", lambda w: F.col("_text").contains(w)),
    })


def _check(key: str, ok: Column, detail: Column | str) -> Column:
    return F.struct(F.lit(key).alias("key"), ok.alias("ok"), (F.lit(detail) if isinstance(detail, str) else detail).alias("detail"))


def _yes_no(ok: Column, yes: str, no: str) -> Column:
    return F.when(ok, yes).otherwise(no)


def seo_checks(max_places: int | None = None) -> Column:
    """The seven local-SEO checks, in report order (over ``with_site_flags``); all places are named, or the first ``max_places``."""
    h1 = F.col("h1")
    places = F.col("places")
    area = F.col("_covers")
    together = F.col("_name_seen") & (F.size("phones") > 0) & area
    quoted_title = F.concat(F.lit(": “"), F.coalesce(blank_to_null(F.col("title")), F.lit("(sin título)")), F.lit("”"))
    return F.array(
        _check("titulo_con_ciudad", F.col("_title_place"), F.concat(
            F.lit("El título de la página "), _yes_no(F.col("_title_place"), "menciona", "no menciona"), F.lit(" la ciudad o comuna"), quoted_title)),
        _check("h1_unico", F.size(h1) == 1, F.concat(
            F.lit("Tiene "), F.size(h1).cast("string"), F.lit(" título(s) principal(es) (H1)"),
            F.when(F.size(h1) > 0, F.concat(F.lit(": “"), F.get(h1, F.lit(0)), F.lit("”"))).otherwise(""))),
        _check("meta_descripcion", F.coalesce("meta_description", F.lit("")) != "", _yes_no(
            F.coalesce("meta_description", F.lit("")) != "", "Tiene descripción para Google", "No tiene descripción para Google (meta description)")),
        _check("cobertura", area, F.when(F.size(places) > 0, F.concat(F.lit("Menciona: "), F.array_join(_at_most(places, max_places), ", ")))
               .when(area, "Menciona su ciudad").otherwise("No menciona comunas ni zona de cobertura")),
        _check("nombre_direccion_telefono", together, _yes_no(
            together, "Nombre, zona y teléfono visibles", "Falta mostrar juntos el nombre, la dirección o zona y el teléfono")),
        _check("datos_estructurados", F.col("has_local_business"), _yes_no(
            F.col("has_local_business"), "Tiene datos estructurados de negocio local (LocalBusiness)",
            "No tiene datos estructurados de negocio local (LocalBusiness)")),
        _check("mapa", F.col("has_map"), _yes_no(
            F.col("has_map"), "Tiene mapa o enlace a Google Maps", "No tiene mapa ni enlace a su ficha de Google Maps")),
    )


def info_checks(max_places: int | None = None) -> Column:
    """The nine-item information checklist; one is left NULL for judgment."""
    menu = F.lower(fold_accents(F.array_join(F.concat("menu_items", "h2"), " ")))
    text, kinds = F.col("_text"), F.col("trust_kinds")
    services = menu.rlike(fv.SERVICES_WORD_PATTERN) | text.rlike(fv.SERVICES_WORD_PATTERN)
    phone = (F.size("phones") > 0) | (F.size("tel_links") > 0)
    hours = text.rlike(fv.HOURS_WORD_PATTERN)
    trust = F.arrays_overlap(kinds, F.array(F.lit("certificaciones"), F.lit("garantía"), F.lit("experiencia")))
    testimonials, reviews = F.array_contains(kinds, "testimonios"), F.array_contains(kinds, "reseñas")
    area = F.filter(seo_checks(max_places), lambda c: c["key"] == "cobertura")
    return F.concat(
        F.array(_check("servicios", services, _yes_no(services, "Muestra sus servicios", "No hay una sección clara de servicios"))),
        area,
        F.array(
            _check("telefono", phone, _yes_no(phone, "Muestra teléfono", "No muestra teléfono")),
            _check("whatsapp", F.col("wa_on_site"), _yes_no(F.col("wa_on_site"), "Tiene WhatsApp en la web", "No tiene WhatsApp en la web")),
            _check("horarios", hours, _yes_no(hours, "Indica horarios", "No indica horarios de atención")),
            _check("diferenciadores", F.lit(None).cast("boolean"), "Lo evalúa la IA (qué lo hace distinto de la competencia)"),
            _check("testimonios", testimonials, _yes_no(testimonials, "Tiene testimonios", "No tiene testimonios")),
            _check("resenas", reviews, _yes_no(reviews, "Menciona reseñas o calificaciones", "No muestra reseñas")),
            _check("confianza", trust, _yes_no(
                trust, "Muestra señales de confianza (experiencia, certificaciones o garantía)",
                "No muestra experiencia, certificaciones ni garantías")),
        ),
    )


def _broken_rows(column: str, limit: int | None) -> Column:
    return F.transform(_at_most(column, limit), lambda b: F.concat(b["url"], F.lit(" — "), b["reason"]))


def rule_findings(today: Column, max_names: int | None = None, max_buttons: int | None = None, max_rows: int | None = None, max_places: int | None = None) -> Column:
    """R10-R22 for an open site, in rule order, absent ones dropped (over ``with_site_flags``).

    Button names, broken contact buttons, broken links or images and places are all reported; a caller's limit keeps the first ones.
    """
    fakes = F.col("_fakes")
    named = F.array_join(F.transform(_at_most(fakes, max_names), lambda t: F.concat(F.lit("“"), t, F.lit("”"))), ", ")
    has_desktop, has_mobile, has_facts = F.col("has_desktop"), F.col("has_mobile"), F.col("has_facts")

    def nothing(device: str) -> Column:
        return ~F.col("has_" + device) | (
            (F.size(F.coalesce("ctas_" + device, F.array().cast(NO_TEXTS))) == 0) & ~F.col("wa_first_" + device) & ~F.col("tel_first_" + device)
        )

    seconds = F.col("load_ms") / F.lit(1000.0)
    slow_title = F.when(
        has_desktop & (F.coalesce("load_ms", F.lit(0)) != 0),
        F.concat(F.lit("La web tarda "), F.replace(F.format_string("%.1f", seconds), F.lit("."), F.lit(",")), F.lit(" s en cargar")),
    ).otherwise("La web es lenta")
    files = F.when(has_desktop, F.concat(F.col("requests").cast("string"), F.lit(" archivos, "), F.col("weight_kb").cast("string"), F.lit(" KB")))
    year = F.array_max("copyright_years")
    templates = F.filter("builders", lambda b: b["name"].isin(fv.TEMPLATE_BUILDERS))
    missing = F.transform(F.filter(seo_checks(max_places), lambda c: ~c["ok"]), lambda c: c["detail"])
    shot = F.when(has_desktop, F.col("shot_desktop"))
    rules = [
        _only(F.size(fakes) > 0, finding(
            "boton_falso",
            F.when(F.size(fakes) == 1, F.concat(F.lit("El botón "), named, F.lit(" no hace nada al tocarlo")))
            .otherwise(F.concat(F.lit("Los botones "), named, F.lit(" no hacen nada al tocarlos"))),
            "Se ven como botones, pero no son enlaces: el cliente los toca y no pasa nada.", "alta",
            F.transform(fakes, lambda t: F.concat(F.lit("Elemento sin enlace en la primera pantalla: "), t)), 7, shot)),
        _only(F.size("wa_broken") > 0, finding(
            "whatsapp_roto", "El botón de WhatsApp de la web no funciona",
            "Un cliente que quiere escribir por WhatsApp no logra abrir el chat.", "alta", _at_most("wa_broken", max_buttons), 7)),
        _only(~F.col("wa_on_site"), finding(
            "sin_whatsapp_web", "La web no tiene un botón de WhatsApp",
            "Para escribirle, el cliente tiene que buscar y copiar el número a mano.", "alta", None, 7)),
        _only(F.col("wa_on_site") & has_mobile & ~F.col("wa_first_mobile"), finding(
            "whatsapp_escondido_celular", "En el celular, el WhatsApp no se ve al entrar",
            "Hay que bajar o buscarlo; muchos clientes se van antes de encontrarlo.", "media", None, 7, F.col("shot_mobile"))),
        _only((has_desktop | has_mobile) & nothing("desktop") & nothing("mobile"), finding(
            "sin_llamado_accion", "Al entrar no hay un botón claro para contactar",
            "La primera pantalla no invita a escribir, llamar ni cotizar.", "media", None, 7, shot)),
        _only(has_facts & (F.size("tel_links") == 0), finding(
            "sin_telefono_click", "No hay un teléfono para llamar con un toque",
            "En el celular, el cliente no puede llamar directo desde la web.", "baja", None, 7)),
        _only(F.col("zoomed_out"), finding(
            "no_adaptada_celular", "La web no está adaptada al celular: se ve en miniatura",
            "El cliente tiene que hacer zoom para leer y tocar los botones.", "alta",
            F.array_compact(F.array(
                F.concat(F.lit("En una pantalla de 390 px la página se dibuja con "), F.col("layout_width").cast("string"), F.lit(" px de ancho.")),
                F.when(has_facts & (F.coalesce("viewport", F.lit("")) == ""), "Falta la etiqueta <meta name='viewport'>."))), 6, F.col("shot_mobile"))),
        _only(F.col("overflow") & ~F.col("zoomed_out"), finding(
            "se_sale_celular", "En el celular, la página se sale de la pantalla hacia el lado",
            "Al deslizar, la página se mueve hacia los lados y se ve rota.", "media",
            F.array(F.concat(F.lit("Ancho del contenido: "), F.col("scroll_width").cast("string"), F.lit(" px en una pantalla de "),
                             F.col("layout_width").cast("string"), F.lit(" px."))), 6, F.col("shot_mobile_full"))),
        _only(F.col("_speed") <= 4, finding(
            "lenta", slow_title, "Más de 3 segundos hace que muchos visitantes se vayan antes de verla.",
            F.when(F.col("_speed") <= 2, "alta").otherwise("media"),
            F.array_compact(F.array(speed_reason("load_ms", "psi"), files)), 5)),
        _only(F.col("final_url").startswith("http://"), finding(
            "sin_https", "La web no tiene el candado de seguridad (HTTPS)",
            "Los navegadores la marcan como 'No seguro', lo que espanta a los clientes.", "media", F.array("final_url"), 8)),
        _only(has_facts & ~F.arrays_overlap("trust_kinds", F.array(F.lit("testimonios"), F.lit("reseñas"))), finding(
            "sin_testimonios", "No muestra opiniones ni reseñas de clientes",
            "Nada en la web le confirma al visitante que otros clientes quedaron conformes.", "media", None, 8)),
        _only(F.size("broken_links") > 0, finding(
            "enlaces_rotos", F.concat(F.size("broken_links").cast("string"), F.lit(" enlace(s) de la web llevan a páginas que no existen")),
            "El cliente hace clic y llega a un error.", "media", _broken_rows("broken_links", max_rows), 9)),
        _only(F.size("broken_images") > 0, finding(
            "imagenes_rotas", F.concat(F.size("broken_images").cast("string"), F.lit(" imagen(es) de la web no cargan")),
            "Se ven cuadros vacíos o íconos de imagen rota.", "media", _broken_rows("broken_images", max_rows), 3)),
        _only(has_facts & (year <= F.year(today) - 2), finding(
            "copyright_antiguo", F.concat(F.lit("El pie de página muestra el año "), year.cast("string"), F.lit(": la web se ve desactualizada")),
            "Da la impresión de que nadie la mantiene.", "media", F.array(F.concat(F.lit("Año del copyright: "), year.cast("string"))), 10)),
        _only(has_facts & (F.size(templates) > 0), finding(
            "plantilla", F.concat(F.lit("Hecha con un constructor de plantillas ("), F.get(templates, F.lit(0))["name"], F.lit(")")),
            "Suele verse genérica y parecida a otras webs.", "baja",
            F.transform(templates, lambda b: F.concat(b["name"], F.lit(": "), b["evidence"])), 2)),
        _only(has_facts & ~F.col("_covers"), finding(
            "sin_cobertura", "No dice en qué comunas o zonas atiende",
            "Quien busca el servicio en su comuna no sabe si lo atienden.", "media")),
        _only(has_facts & (F.size(missing) >= 3), finding(
            "seo_local_debil", "A Google le falta información para mostrarla en búsquedas locales",
            F.concat(F.lit("Le faltan "), F.size(missing).cast("string"), F.lit(" elementos de SEO local.")), "media", missing)),
    ]
    return F.array_compact(F.array(*rules)).cast(f"array<{FINDING_DDL}>")


def by_severity(findings: Column) -> Column:
    """Severity order, rule order kept inside a severity."""
    return F.flatten(F.array(*[F.filter(findings, lambda f: f["severity"] == F.lit(s)) for s in fv.SEVERITY_RANK]))


def link_errors() -> Column:
    """Everything that counts as a link error: fake buttons, broken contact buttons, broken links."""
    return F.concat(
        F.transform("_fakes", lambda t: F.concat(F.lit("Botón sin enlace: "), t)),
        F.transform("wa_broken", lambda t: F.concat(F.lit("WhatsApp roto: "), t)),
        F.transform("broken_links", lambda b: F.concat(F.lit("Enlace roto: "), b["url"])),
    )


def review_sites(sites: DataFrame, today: Column, max_names: int | None = None, max_buttons: int | None = None, max_rows: int | None = None, max_places: int | None = None) -> DataFrame:
    """Findings, SEO checks, checklist and link errors of each reviewed site, whole unless a limit is named (``rule_findings``)."""
    flagged = with_site_flags(sites).withColumn("_rules", rule_findings(today, max_names, max_buttons, max_rows, max_places))
    ok = F.col("status") == fv.SITE_OK
    down = finding("web_caida", "Su web no funciona", F.coalesce("reason", F.lit("La web no abre.")), "alta", F.array("url"))
    social = finding(
        "solo_redes", "Su web lleva a redes sociales en vez de a un sitio propio",
        "No tiene un sitio propio que muestre sus servicios y genere confianza.", "alta", F.array(F.coalesce("final_url", "url")))
    short = F.array_compact(F.array(F.when(F.col("status") == fv.SITE_DOWN, down).when(F.col("status") == fv.SITE_ONLY_SOCIAL, social)))
    none = F.array().cast("array<struct<key:string,ok:boolean,detail:string>>")
    facts = ok & F.col("has_facts")
    out = flagged.withColumns({
        "findings": F.when(ok, by_severity(F.col("_rules"))).otherwise(short.cast(f"array<{FINDING_DDL}>")),
        "seo_local": F.when(facts, seo_checks(max_places)).otherwise(none),
        "info_checklist": F.when(facts, info_checks(max_places)).otherwise(none),
        "link_errors": F.when(ok, link_errors()).otherwise(F.array().cast(NO_TEXTS)),
    })
    out = out.drop(*[c for c in out.columns if c.startswith("_")])
    return barrier(out, "findings", "seo_local", "info_checklist", "link_errors")
