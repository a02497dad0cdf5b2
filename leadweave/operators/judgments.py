"""Scores, model judgments and reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions.expr import exact_lookup, is_true
from leadweave.functions.phones import pretty_number
from leadweave.functions.scoring import links_reason, links_score, opportunity_level, speed_reason, speed_score
from leadweave.functions.text import provenance_text

RESPONSE = (
    "parametros array<struct<id:int,puntaje:int,justificacion:string,evidencia:array<string>>>, "
    "problemas array<struct<titulo:string,impacto:string,parametro:int,evidencia:array<string>>>, "
    "oportunidades array<struct<titulo:string,descripcion:string,evidencia:array<string>>>, "
    "puntos_fuertes array<struct<titulo:string,evidencia:array<string>>>, "
    "diferenciadores struct<ok:boolean,detalle:string>"
)


def rubric(spark: SparkSession) -> DataFrame:
    """The ten parameters (id, name, who scores them); small by definition."""
    return spark.createDataFrame(fv.RUBRIC_PARAMS, "id int, name string, scored_by string")


# ------------------------------------------------------------------ R7, A11, R25
def code_scores(measured: DataFrame, site: str = "site_id") -> DataFrame:
    """Parameters 5 (when measured) and 9 (always) of each site: ``measured(site, load_ms, psi, link_errors)``."""
    speed = measured.select(site, F.lit(5).alias("id"), speed_score("load_ms", "psi").alias("score"), speed_reason("load_ms", "psi").alias("reason"))
    links = measured.select(site, F.lit(9).alias("id"), links_score("link_errors").alias("score"), links_reason("link_errors").alias("reason"))
    return speed.filter(F.col("score").isNotNull()).unionByName(links).withColumn("origin", F.lit("codigo"))


def total_scores(scores: DataFrame, site: str = "site_id") -> DataFrame:
    """The total exists only when exactly the ten parameters are scored; else an error text."""
    ids = [p[0] for p in fv.RUBRIC_PARAMS]
    known = F.col("id").isin(ids)
    per = scores.groupBy(site).agg(
        F.count_distinct(F.when(known, F.col("id"))).alias("_known"), F.count_if(~known).alias("_other"), F.sum("score").alias("_sum")
    )
    complete = (F.col("_known") == len(ids)) & (F.col("_other") == 0)
    return per.select(
        site, F.when(complete, F.col("_sum")).alias("website_score"), F.when(~complete, fv.MISSING_PARAMS_ERROR).alias("error")
    )


# ------------------------------------------------------------------ S13
def read_responses(responses: DataFrame) -> DataFrame:
    """Parsed answer of each response, or the reason it cannot be used."""
    parsed = F.from_json("response", RESPONSE)
    # A valid answer has all five sections; lenient parsing alone would accept a partial one.
    complete = F.col("_a.parametros").isNotNull() & F.col("_a.problemas").isNotNull() & F.col("_a.oportunidades").isNotNull() \
        & F.col("_a.puntos_fuertes").isNotNull() & F.col("_a.diferenciadores").isNotNull()
    out = responses.withColumn("_a", parsed)
    error = (
        F.when(F.col("stop_reason") == "refusal", fv.REFUSED_ERROR)
        .when(F.col("stop_reason") == "max_tokens", fv.CUT_ERROR)
        .when(~is_true(complete), fv.FORMAT_ERROR)
    )
    return out.withColumn("error", error).withColumn("answer", F.when(F.col("error").isNull(), F.col("_a"))).drop("_a")


# ------------------------------------------------------------------ R28, A21
def _has_evidence(items: Column) -> Column:
    return is_true(F.exists(items, lambda e: F.trim(e) != ""))


def clean_answers(answers: DataFrame, caps: dict[str, int] | None = None) -> DataFrame:
    """Answers reduced to what carries evidence, plus the log of what was dropped.

    All items with evidence stay; ``caps`` (the product's are ``fixed_values.JUDGMENT_CAPS``) keeps the first ones of a section.

    One projection: an answer is a bounded document, so its lists are handled in place.
    """
    allowed = [p[0] for p in fv.RUBRIC_PARAMS if p[2] == "ia"]
    params = F.col("answer.parametros")
    # A judgment counts when it is the first usable one of its id.
    usable = lambda p: p["id"].isin(allowed) & _has_evidence(p["evidencia"])

    def taken_before(i: Column, p: Column) -> Column:
        return F.exists(F.slice(params, F.lit(1), i), lambda q: usable(q) & (q["id"] == p["id"]))

    kept = F.filter(params, lambda p, i: usable(p) & ~taken_before(i, p))
    ordered = F.array_sort(F.transform(kept, lambda p: F.struct(
        p["id"].alias("id"), F.least(F.lit(10), F.greatest(F.lit(1), p["puntaje"])).alias("puntaje"),
        p["justificacion"].alias("justificacion"), p["evidencia"].alias("evidencia"))))

    def drop_note(p: Column, i: Column) -> Column:
        head = F.concat(F.lit("Parámetro "), p["id"].cast("string"))
        return F.when(
            ~p["id"].isin(allowed) | taken_before(i, p), F.concat(head, F.lit(" repetido o que no le corresponde a la IA"))
        ).when(~_has_evidence(p["evidencia"]), F.concat(head, F.lit(" sin evidencia")))

    notes = [F.transform(params, drop_note)]
    columns = {"params": ordered}
    for section in fv.JUDGMENT_CAPS:
        items = F.col("answer." + section)
        good = F.filter(items, lambda x: _has_evidence(x["evidencia"]))
        columns[section] = good if caps is None or section not in caps else F.slice(good, 1, caps[section])
        word = fv.JUDGMENT_WORDS[section]
        notes.append(_section_notes(items, word))
    columns["discarded"] = F.array_compact(F.concat(*notes))
    return answers.withColumns(columns)


def _section_notes(items: Column, word: str) -> Column:
    return F.transform(items, lambda x: F.when(
        ~_has_evidence(x["evidencia"]), F.concat(F.lit(word + " sin evidencia: "), x["titulo"])))


# ------------------------------------------------------------------ P24, P25
def screenshot_map() -> Column:
    """Labelled screenshots of both devices, absent ones left out."""
    labels = {"escritorio": "shot_desktop", "escritorio_completa": "shot_desktop_full", "celular": "shot_mobile", "celular_completa": "shot_mobile_full"}
    entries = F.map_from_arrays(F.array(*[F.lit(k) for k in labels]), F.array(*[F.col(c) for c in labels.values()]))
    return F.map_filter(entries, lambda k, v: v.isNotNull() & (v != ""))


def build_analyses(reviewed: DataFrame, code: DataFrame, judged: DataFrame | None, site: str = "site_id") -> DataFrame:
    """P25: the analysis row of each reviewed site; scores come in as rows and leave as one map."""
    scores = code.select(site, "id", "score", "reason", F.array().cast("array<string>").alias("evidence"), "origin")
    totals = None
    if judged is not None:
        by_model = judged.select(site, F.explode("params").alias("p")).select(
            site, F.col("p.id").alias("id"), F.col("p.puntaje").alias("score"), F.col("p.justificacion").alias("reason"),
            F.col("p.evidencia").alias("evidence"), F.lit("ia").alias("origin"))
        scores = scores.unionByName(by_model)
        totals = total_scores(scores.join(judged.select(site), site, "left_semi"), site)
    names = F.create_map(*[x for p in fv.RUBRIC_PARAMS for x in (F.lit(p[0]), F.lit(p[1]))])
    packed = scores.groupBy(site).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        F.col("id").cast("string"), F.struct("id", names[F.col("id")].alias("name"), "score", "reason", "evidence", "origin"))))).alias("rubric_scores"))
    out = reviewed.join(packed, site, "left")
    if totals is None:
        out = out.withColumns({"website_score": F.lit(None).cast("long"), "error": F.lit(None).cast("string")})
    else:
        out = out.join(totals, site, "left")
    return out.withColumns({
        "rubric_version": F.lit(fv.RUBRIC_VERSION),
        "opportunity_level": opportunity_level("website_score", F.lit(True), "rating", "review_count"),
        "screenshots": screenshot_map(),
    })


# ------------------------------------------------------------------ J19, J20, J21
def rubric_rows(analyses: DataFrame, rubric_table: DataFrame, key: str = "business_id") -> DataFrame:
    """Always ten rows per analysis, NULL where unscored."""
    params = F.array(*[F.struct(F.lit(p[0]).alias("id"), F.lit(p[1]).alias("name"), F.lit(p[2]).alias("scored_by")) for p in fv.RUBRIC_PARAMS])
    rows = analyses.select(key, "rubric_scores", F.explode(params).alias("p"))
    score = F.try_element_at("rubric_scores", F.col("p.id").cast("string"))
    return rows.select(
        key, F.col("p.id").alias("id"), F.col("p.name").alias("name"), F.col("p.scored_by").alias("scored_by"),
        score["score"].alias("score"), score["reason"].alias("reason"))


def labelled_checks(table: DataFrame, checks: str, labels: dict[str, str], key: str = "business_id") -> DataFrame:
    """Check items in label order, unknown keys after them in their own order."""
    ordinal = exact_lookup(F.col("check"), {k: i for i, k in enumerate(labels)})
    rows = table.select(key, F.posexplode(F.map_entries(checks)).alias("_at", "e")).select(
        key, "_at", F.col("e.key").alias("check"), F.col("e.value.ok").alias("ok"), F.col("e.value.detail").alias("detail"))
    order = W.partitionBy(key).orderBy(F.coalesce(ordinal, F.lit(len(labels))), "_at")
    return rows.select(
        key, F.coalesce(exact_lookup(F.col("check"), labels), F.col("check")).alias("label"), "ok",
        F.coalesce("detail", F.lit("")).alias("detail"), F.row_number().over(order).alias("position"))


def source_rows(businesses: DataFrame, key: str = "id") -> DataFrame:
    """Where each field came from, in plain words."""
    ordinal = exact_lookup(F.col("field"), {k: i for i, k in enumerate(fv.FIELD_LABELS)})
    rows = businesses.select(key, F.posexplode(F.map_entries("field_sources")).alias("_at", "e")).select(
        key, "_at", F.col("e.key").alias("field"), F.col("e.value").alias("source"))
    order = W.partitionBy(key).orderBy(F.coalesce(ordinal, F.lit(len(fv.FIELD_LABELS))), "_at")
    return rows.select(
        key, F.coalesce(exact_lookup(F.col("field"), fv.FIELD_LABELS), F.col("field")).alias("label"),
        provenance_text("source").alias("source"), F.row_number().over(order).alias("position"))


def candidate_report(candidates: DataFrame) -> DataFrame:
    """Every contact candidate with readable number, source and placement."""
    return candidates.withColumns({
        "number": pretty_number("number"),
        "source": F.coalesce(exact_lookup(F.col("source"), fv.SOURCE_NAMES), F.col("source")),
        "placement": F.coalesce(exact_lookup(F.col("placement"), fv.PLACEMENT_NAMES), F.col("placement")),
    })


# ------------------------------------------------------------------ P22, P23
def business_summary(rows: DataFrame) -> DataFrame:
    """Readable summary of stored businesses (``position``, ``created`` and the listed site come along)."""
    return rows.select(
        F.col("position").alias("posicion"), F.col("created").alias("nuevo"), F.col("business_name").alias("nombre"),
        F.col("category").alias("categoria"), F.col("phone_raw").alias("telefono"), F.col("phone_e164").alias("telefono_e164"),
        F.col("whatsapp_status").alias("whatsapp_estado"), "whatsapp_url", F.col("whatsapp_confidence").alias("whatsapp_confianza"),
        F.col("whatsapp_evidence").alias("whatsapp_evidencia"), F.col("website").alias("web"),
        F.coalesce("website_status", F.lit(fv.TO_VERIFY)).alias("web_estado"), F.col("website_raw").alias("sitio_web_en_maps"),
        "instagram", "facebook", F.col("address").alias("direccion"), F.col("city").alias("ciudad"), F.col("commune").alias("comuna"),
        F.col("opening_hours").alias("horario"), "rating", F.col("review_count").alias("resenas"), F.col("description").alias("descripcion"),
        F.col("services").alias("servicios"), F.col("google_maps_url").alias("maps_url"), "place_id",
    )


def verification_summary(rows: DataFrame) -> DataFrame:
    """The site and contact outcome of a verification."""
    return rows.select(
        F.col("business_name").alias("nombre"), F.col("website").alias("web"),
        F.coalesce("website_status", F.lit(fv.TO_VERIFY)).alias("web_estado"), F.coalesce("reason", "error").alias("web_motivo"),
        F.col("whatsapp_status").alias("whatsapp_estado"), "whatsapp_url", F.col("whatsapp_confidence").alias("whatsapp_confianza"),
        F.col("field_sources")["whatsapp_confidence"].alias("whatsapp_por_que"), F.col("whatsapp_source").alias("whatsapp_fuente"),
        F.col("whatsapp_evidence").alias("whatsapp_evidencia"), F.col("whatsapp_multiple_numbers").alias("whatsapp_varios_numeros"),
        F.col("whatsapp_broken_button").alias("whatsapp_boton_roto"), F.col("phone_raw").alias("telefono"),
        F.col("pages_visited").alias("paginas_revisadas"), F.col("linktree_urls").alias("linktree"),
    )


def compact_facts(facts: DataFrame) -> DataFrame:
    """Page facts without the bulky fields; inner links become their number."""
    bulky = [c for c in ("visible_text", "lines", "whatsapp", "elements") if c in facts.columns]
    out = facts.drop(*bulky)
    if "internal_links" in out.columns:
        out = out.withColumn("enlaces_internos", F.size("internal_links")).drop("internal_links")
    return out
