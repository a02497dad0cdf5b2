"""Sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import exact_lookup
from leadweave.functions.text import decimal_comma
from leadweave.operators.leads import filter_leads, sort_leads


def _shown(name: str) -> Column:
    value = F.col(name)
    if name == "whatsapp_state":
        value = F.coalesce(exact_lookup(value, fv.STATE_LABELS), value)
    elif name == "findings":
        value = F.array_join(F.transform(value, lambda f: F.coalesce(f["title"], F.lit(""))), " | ")
    elif name == "broken_button":
        value = F.when(value, "sí").when(~value, "no")
    elif name == "rating":
        value = decimal_comma(value)
    return F.coalesce(value.cast("string"), F.lit(""))


def csv_rows(leads: DataFrame) -> DataFrame:
    """The 23 export columns as text, null as empty."""
    return leads.select(*[_shown(name).alias(title) for title, name in fv.CSV_COLUMNS])


def write_leads_csv(leads: DataFrame, path: str) -> None:
    """S9: ';'-separated files with a byte-order mark before the first header name."""
    rows = csv_rows(leads)
    first = rows.columns[0]
    rows.withColumnRenamed(first, "﻿" + first).write.mode("overwrite").option("sep", ";").option("header", True).option(
        "emptyValue", "").option("quoteAll", False).option("escape", '"').csv(path)


def export_day(leads: DataFrame, path: str, filters: list[str], query: str | None = None, order: str = "whatsapp") -> None:
    """The filtered, sorted list of one day."""
    write_leads_csv(sort_leads(filter_leads(leads, filters, query), order), path)


def json_documents(rows: DataFrame, column: str = "document") -> DataFrame:
    """One JSON document per row (null fields kept)."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias(column))


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def evidence_documents(sites: DataFrame, key: str = "site_id", max_text: int | None = None) -> DataFrame:
    """What a judge of a site sees: business, facts, findings without capture, code scores, whole text.

    ``sites`` carries business columns, ``url``, ``facts`` (struct), ``findings``, ``code_scores``
    and ``visible_text``. Keys of the document are in alphabetical order.
    """
    findings = F.transform("findings", lambda f: f.dropFields("capture"))
    document = F.struct(
        F.col("facts").alias("hechos"), findings.alias("hallazgos_automaticos"),
        F.struct(
            F.col("city").alias("ciudad"), F.col("business_name").alias("nombre"), F.col("rating").alias("rating"),
            F.col("review_count").alias("resenas"), F.col("category").alias("rubro"),
        ).alias("negocio"),
        F.col("code_scores").alias("puntajes_calculados_por_codigo"), F.col("url").alias("url"),
    )
    return sites.select(
        key, F.to_json(document, {"ignoreNullFields": "false"}).alias("document"),
        F.col("visible_text") if max_text is None else F.substring("visible_text", 1, max_text).alias("visible_text"))


def append_analyses(rows: DataFrame, path: str) -> None:
    """U8: add analyses to the append-only history of their businesses."""
    rows.write.mode("append").parquet(path)
