"""Fuse contact evidence of all sources into one decision.

Decisions come from partially aggregated minima and bounded sets, so a business with a very
large number of candidates never has to fit in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions.expr import exact_lookup
from leadweave.functions.phones import canonical_number
from leadweave.operators.contact_links import placement_rank


def source_rank(source: Column) -> Column:
    return exact_lookup(source, fv.SOURCE_RANK)


def rank_key() -> Column:
    """Source, numbered before not, placement, arrival."""
    return F.struct(
        source_rank(F.col("source")).alias("source_rank"),
        F.col("number").isNull().alias("no_number"),
        placement_rank(F.col("placement")).alias("placement_rank"),
        F.col("arrival").alias("arrival"),
    )


def rank_candidates(candidates: DataFrame, site: str = "site_id") -> DataFrame:
    """Candidates with their ``candidate_rank`` inside the site (1 is the chosen one)."""
    order = W.partitionBy(site).orderBy(rank_key())
    return candidates.withColumn("candidate_rank", F.row_number().over(order))


def decide_contacts(businesses: DataFrame, candidates: DataFrame, broken: DataFrame | None = None, site: str = "site_id") -> DataFrame:
    """The fused contact decision of every business.

    ``businesses(site, phone_e164)``; ``candidates(site, source, number, url, placement, evidence,
    broken, arrival)``; ``broken(site, evidence)`` adds published buttons known not to work.
    """
    ranked = candidates.withColumn("_rank", rank_key())
    by_number = ranked.groupBy(site, "number", "source").agg(
        F.min(F.struct("_rank", "url", "evidence")).alias("first"), F.bool_or("broken").alias("any_broken"), F.count("*").alias("n"),
    )
    site_level = by_number.groupBy(site).agg(
        F.min(F.struct("first._rank", "first.url", "first.evidence", "source", "number")).alias("best"),
        F.count_distinct("number").alias("numbers"),
        F.bool_or("any_broken").alias("candidate_broken"),
        F.sum("n").alias("candidate_count"),
    )
    sources = (
        by_number.filter(F.col("number").isNotNull())
        .join(site_level.select(site, F.col("best.number").alias("number")), [site, "number"])
        .groupBy(site).agg(F.array_sort(F.collect_set(F.struct(source_rank(F.col("source")).alias("rank"), "source"))).alias("_sources"))
    )
    decided = businesses.join(site_level, site, "left").join(sources, site, "left")
    if broken is not None:
        flagged = broken.filter(F.col("evidence").isNotNull()).groupBy(site).agg(F.lit(True).alias("extra_broken"))
        decided = decided.join(flagged, site, "left")
    else:
        decided = decided.withColumn("extra_broken", F.lit(False))
    best, phone = F.col("best"), F.col("phone_e164")
    names = F.array_join(F.transform("_sources", lambda s: exact_lookup(s["source"], fv.SOURCE_WORDS)), " y ")
    has_phone = phone.isNotNull() & (phone != "")
    two, same = F.size("_sources") >= 2, has_phone & (canonical_number(best["number"]) == canonical_number(phone))
    confidence = (
        F.when(best.isNull(), None)
        .when(best["source"] == "manual", "ALTA")
        .when(best["number"].isNull(), "MEDIA")
        .when(two | same, "ALTA")
        .otherwise("MEDIA")
    )
    reason = (
        F.when(best.isNull(), None)
        .when(best["source"] == "manual", fv.REASON_MANUAL)
        .when(best["number"].isNull(), fv.REASON_NO_NUMBER)
        .when(two, F.concat(F.lit("El mismo número aparece en "), names, F.lit(".")))
        .when(same, F.concat(F.lit("Publicado en "), names, F.lit(" y coincide con el teléfono de la ficha de Maps.")))
        .otherwise(F.concat(F.lit("Publicado solo en "), names, F.lit(".")))
    )
    return decided.select(
        site,
        F.when(best.isNotNull(), fv.CONTACT_VERIFIED).when(has_phone, fv.CONTACT_UNCONFIRMED).otherwise(fv.CONTACT_NOT_FOUND).alias("whatsapp_status"),
        best["url"].alias("whatsapp_url"),
        best["source"].alias("whatsapp_source"),
        best["evidence"].alias("whatsapp_evidence"),
        F.coalesce(F.col("numbers") > 1, F.lit(False)).alias("whatsapp_multiple_numbers"),
        confidence.alias("whatsapp_confidence"),
        reason.alias("confidence_reason"),
        (F.coalesce("candidate_broken", F.lit(False)) | F.coalesce("extra_broken", F.lit(False))).alias("whatsapp_broken_button"),
        F.coalesce("candidate_count", F.lit(0)).alias("candidate_count"),
    )


def broken_evidence(candidates: DataFrame, extra: DataFrame | None = None, site: str = "site_id") -> DataFrame:
    """Distinct evidence of broken buttons, candidates in rank order first, then the extra ones."""
    first = candidates.filter("broken").groupBy(site, "evidence").agg(F.min(rank_key()).alias("_rank")).withColumn("_late", F.lit(0))
    rows = first.select(site, "evidence", "_late", "_rank", F.lit(0).cast("long").alias("_at"))
    if extra is not None:
        late = extra.groupBy(site, "evidence").agg(F.min("at").cast("long").alias("_at")).select(
            site, "evidence", F.lit(1).alias("_late"), F.lit(None).cast(first.schema["_rank"].dataType).alias("_rank"), "_at"
        )
        rows = rows.unionByName(late)
    once = rows.groupBy(site, "evidence").agg(F.min(F.struct("_late", "_rank", "_at")).alias("o"))
    return once.withColumn("position", F.row_number().over(W.partitionBy(site).orderBy("o"))).select(site, "evidence", "position")


def replace_sources(stored: DataFrame, fresh: DataFrame, sources: list[str], site: str = "site_id") -> DataFrame:
    """Stored candidates of other sources followed by the fresh ones."""
    columns = [c for c in stored.columns if c != "arrival"]
    kept = stored.filter(~F.col("source").isin(sources)).withColumn("arrival", F.struct(F.lit(0).alias("batch"), F.col("arrival").cast("long").alias("at")))
    new = fresh.withColumn("arrival", F.struct(F.lit(1).alias("batch"), F.col("arrival").cast("long").alias("at")))
    return kept.select(*columns, "arrival").unionByName(new.select(*columns, "arrival"))


DECISION_COLUMNS = [
    "whatsapp_status", "whatsapp_url", "whatsapp_source", "whatsapp_evidence", "whatsapp_multiple_numbers",
    "whatsapp_confidence", "whatsapp_broken_button",
]


def write_decision(businesses: DataFrame, decisions: DataFrame, complete: bool, site: str = "site_id") -> DataFrame:
    """U16: put decisions on businesses; a partial write keeps what the decision does not add."""
    new = decisions.select(site, *[F.col(c).alias("_new_" + c) for c in DECISION_COLUMNS], F.lit(True).alias("_decided"))
    joined = businesses.join(new, site, "left")
    changes = {}
    for name in DECISION_COLUMNS:
        fresh, old = F.col("_new_" + name), F.col(name)
        if complete:
            changes[name] = F.when(F.col("_decided"), fresh).otherwise(old)
        elif name == "whatsapp_status":
            changes[name] = F.when(fresh != fv.CONTACT_NOT_FOUND, fresh).otherwise(old)
        elif name in ("whatsapp_multiple_numbers", "whatsapp_broken_button"):
            changes[name] = F.coalesce(F.when(fresh, fresh), old)
        else:
            changes[name] = F.coalesce(fresh, old)
    return joined.withColumns(changes).drop("_decided", *["_new_" + c for c in DECISION_COLUMNS])


def apply_site_status(businesses: DataFrame, verified: DataFrame, site: str = "site_id") -> DataFrame:
    """U15 (site part): status, reason, final address and first profiles of a verification.

    ``verified(site, status, reason, final_url, from_linktree, linktree_url, instagram, facebook)``.
    """
    v = verified.select(site, *[F.col(c).alias("_v_" + c) for c in verified.columns if c != site])
    joined = businesses.join(v, site, "left")
    seen = F.col("_v_status").isNotNull()
    working = F.when(F.col("_v_status") == fv.SITE_OK, F.col("_v_final_url"))
    moved = working.isNotNull() & ~working.eqNullSafe(F.col("website"))
    note = F.concat(F.lit("web: "), F.coalesce(F.col("_v_reason"), F.lit("la web abre correctamente")))
    website_source = F.when(
        F.col("_v_from_linktree"), F.concat(F.lit("web propia enlazada desde su Linktree ("), F.col("_v_linktree_url"), F.lit(")"))
    ).otherwise("web (URL final después de redirecciones)")

    def entry(key: str, value: Column, condition: Column) -> Column:
        return F.when(condition, F.map_from_arrays(F.array(F.lit(key)), F.array(value))).otherwise(F.create_map().cast("map<string,string>"))

    sources = F.coalesce("field_sources", F.create_map().cast("map<string,string>"))
    had_maps = F.map_contains_key(sources, F.lit("website_maps"))
    new_instagram = F.col("instagram").isNull() & F.col("_v_instagram").isNotNull()
    new_facebook = F.col("facebook").isNull() & F.col("_v_facebook").isNotNull()
    updates = [
        entry("website_status", note, seen),
        entry("website_maps", F.col("website"), moved & ~had_maps),
        entry("website", website_source, moved),
        entry("instagram", F.lit("web"), new_instagram),
        entry("facebook", F.lit("web"), new_facebook),
    ]
    merged = sources
    for update in updates:
        merged = merge_maps(merged, update)
    return joined.withColumns({
        "field_sources": merged,
        "website_status": F.when(seen, F.col("_v_status")).otherwise(F.col("website_status")),
        "website": F.when(moved, working).otherwise(F.col("website")),
        "instagram": F.coalesce("instagram", "_v_instagram"),
        "facebook": F.coalesce("facebook", "_v_facebook"),
    }).drop(*[c for c in v.columns if c != site])


def merge_maps(old: Column, new: Column) -> Column:
    """Key-wise union, the right side wins (independent of the session's duplicate-key policy)."""
    return F.map_zip_with(old, new, lambda k, a, b: F.coalesce(b, a))
