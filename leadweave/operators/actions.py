"""Manual confirmations, discards and restores; state of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.expr import is_true
from leadweave.functions.phones import e164_digits, is_probable_mobile
from leadweave.functions.urls import shown_link_digits


def number_to_check() -> Column:
    """The number a person opened: the verified link's, else the mobile to try."""
    verified = F.when(F.col("whatsapp_status") == fv.CONTACT_VERIFIED, shown_link_digits("whatsapp_url"))
    return F.coalesce(verified, F.when(is_probable_mobile("phone_e164"), e164_digits("phone_e164")))


def latest_actions(actions: DataFrame) -> DataFrame:
    """Newest confirm, discard or restore of each business."""
    return actions.filter(F.col("action").isin("confirm", "discard", "restore")).groupBy("business_id").agg(
        F.max(F.struct("ts", "event_id", "action")).alias("a")).select("business_id", F.col("a.action").alias("action"), F.col("a.ts").alias("acted_at"))


def apply_actions(businesses: DataFrame, actions: DataFrame, reason: str = fv.DISCARD_REASON) -> DataFrame:
    """Check, confidence and discard fields after the latest action of each business.

    Confirming needs a number; where there is none the action has no effect. ``confirmed_number``
    feeds the ``manual`` candidate that ``manual_candidates`` adds before fusing again.
    """
    last = latest_actions(actions).withColumnsRenamed({"business_id": "id", "action": "_action", "acted_at": "_at"})
    rows = businesses.join(last, "id", "left").withColumn("_number", number_to_check())
    confirm = is_true((F.col("_action") == "confirm") & F.col("_number").isNotNull())
    discard, restore = is_true(F.col("_action") == "discard"), is_true(F.col("_action") == "restore")

    def changed(on_confirm, on_discard, on_restore, old: str) -> Column:
        return F.when(confirm, on_confirm).when(discard, on_discard).when(restore, on_restore).otherwise(F.col(old))

    none = F.lit(None)
    updates = {
        "whatsapp_check": changed(F.lit(fv.CHECK_EXISTS), F.lit(fv.CHECK_MISSING), none, "whatsapp_check"),
        "whatsapp_confidence": F.when(confirm, "ALTA").otherwise(F.col("whatsapp_confidence")),
        "discarded_at": changed(none, F.col("_at"), none, "discarded_at"),
        "discard_reason": changed(none, F.lit(reason), none, "discard_reason"),
        "confirmed_number": F.when(confirm, F.col("_number")),
    }
    if "whatsapp_checked_at" in businesses.columns:
        updates["whatsapp_checked_at"] = changed(F.col("_at"), F.col("_at"), none, "whatsapp_checked_at")
    return rows.withColumns(updates).drop("_action", "_at", "_number")


def manual_candidates(acted: DataFrame, tz: str, moment: Column) -> DataFrame:
    """The ``manual`` candidate of each confirmed business."""
    shown = F.date_format(F.from_utc_timestamp(moment, tz), "dd-MM-yyyy HH:mm")
    return acted.filter(F.col("confirmed_number").isNotNull()).select(
        F.col("id").alias("site_id"), F.lit("manual").alias("source"), F.lit("cuerpo").alias("placement"), F.col("confirmed_number").alias("number"),
        F.concat(F.lit("https://wa.me/"), "confirmed_number").alias("url"), F.concat(F.lit("Confirmado a mano el "), shown).alias("evidence"),
        F.lit(False).alias("broken"), F.lit(0).cast("long").alias("arrival"))


def run_states(counters: DataFrame, events: DataFrame) -> DataFrame:
    """Final state and message of each run from its counters and its terminating events.

    ``events(run_id, event, error)`` with event 'blocked', 'failed' or 'stopped'; a run without
    one finished. ``counters`` carries leads, target, no_website, duplicates, webs_total, webs_done.
    """
    rank = F.when(F.col("event") == "blocked", 3).when(F.col("event") == "failed", 2).when(F.col("event") == "stopped", 1)
    worst = events.filter(rank.isNotNull()).groupBy("run_id").agg(F.max(F.struct(rank.alias("rank"), "error")).alias("w"))
    runs = counters.join(worst, "run_id", "left")
    level = F.coalesce("w.rank", F.lit(0))
    status = F.when(level == 3, fv.RUN_BLOCKED).when(level == 2, fv.RUN_FAILED).when(level == 1, fv.RUN_STOPPED).otherwise(fv.RUN_DONE)
    n = lambda c: F.col(c).cast("string")
    extra = F.concat(
        F.when(F.col("webs_total") > 0, F.concat(F.lit(" "), n("webs_done"), F.lit(" webs revisadas."))).otherwise(""),
        F.when(F.col("no_website") > 0, F.concat(F.lit(" "), n("no_website"), F.lit(" sin web o con la web caída (saltados)."))).otherwise(""),
        F.when(F.col("duplicates") > 0, F.concat(F.lit(" "), n("duplicates"), F.lit(" repetidos saltados."))).otherwise(""),
    )
    error = F.coalesce("w.error", F.lit(""))
    message = (
        F.when((level == 0) & (F.col("leads") >= F.col("target")), F.concat(F.lit("Listo: "), n("leads"), F.lit(" leads nuevos."), extra))
        .when(level == 0, F.concat(
            F.lit("La búsqueda no tenía más negocios nuevos: "), n("leads"), F.lit(" de "), n("target"), F.lit(" leads."), extra,
            F.lit(" Prueba otra búsqueda para completar el día.")))
        .when(level == 1, F.concat(F.lit("Detenida por ti: "), n("leads"), F.lit(" leads guardados."), extra))
        .when(level == 3, F.concat(F.lit("⛔ Google bloqueó la búsqueda: "), error, F.lit(" Se guardaron "), n("leads"), F.lit(" leads.")))
        .otherwise(F.concat(F.lit("✖ La búsqueda falló: "), error))
    )
    return runs.select("run_id", status.alias("status"), message.alias("message"))
