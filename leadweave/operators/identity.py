"""Business identity, snapshots and fingerprints.

There is no table format with row updates here: every change is snapshot in, snapshot out. A
job never overwrites the snapshot it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions.expr import blank_to_null, exact_lookup
from leadweave.functions.phones import number_key
from leadweave.functions.urls import contact_link_digits, place_key, with_canonical_place_url, with_link_print, with_social
from leadweave.operators.fusion import merge_maps
from leadweave.operators.skew import lookup_known


# ------------------------------------------------------------------ J4
def find_business(lookups: DataFrame, businesses: DataFrame, place: str = "place_id", url: str = "canonical_url") -> DataFrame:
    """Adds ``business_id``: match by place id; when missing or unmatched, by canonical URL."""
    by_place = businesses.filter(F.col("place_id").isNotNull()).groupBy(F.col("place_id").alias(place)).agg(F.min("id").alias("_by_place"))
    by_url = businesses.filter(F.col("google_maps_url").isNotNull()).groupBy(F.col("google_maps_url").alias(url)).agg(F.min("id").alias("_by_url"))
    found = lookup_known(lookup_known(lookups, by_place, place), by_url, url)
    return found.withColumn("business_id", F.coalesce("_by_place", "_by_url")).drop("_by_place", "_by_url")


# ------------------------------------------------------------------ U1
def upsert_businesses(snapshot: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """New snapshot after a batch of partial businesses (NULL means not supplied).

    With an ``arrival`` column the batch may hold a place several times; without it, once.

    Supplied fields overwrite, provenance merges key by key, first-seen time stays. ``created``
    tells inserted rows. New ids continue after the highest stored one, in place order.
    """
    batch = with_canonical_place_url(batch, "google_maps_url", "_canonical")
    batch = batch.withColumns({
        "google_maps_url": F.col("_canonical"),
        "place_id": F.coalesce("place_id", place_key("_canonical")),
    }).drop("_canonical")
    matched = find_business(batch, snapshot, "place_id", "google_maps_url")
    fields = [c for c in batch.columns if c != "id" and c in snapshot.columns]
    if "arrival" in batch.columns:
        # The same place seen twice in one batch: later supplied values win, field by field.
        identity = F.coalesce(
            F.concat(F.lit("b"), F.col("business_id").cast("string")), F.concat(F.lit("p"), F.col("place_id")), F.col("google_maps_url")
        )
        last = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col("arrival"))).alias(c) for c in fields if c != "field_sources"]
        if "field_sources" in fields:
            maps = F.transform(F.array_sort(F.collect_list(F.struct("arrival", F.map_entries("field_sources").alias("m")))), lambda x: F.map_from_entries(x["m"]))
            last.append(F.aggregate(maps, F.create_map().cast("map<string,string>"), merge_maps).alias("field_sources"))
        matched = matched.groupBy(identity.alias("_same")).agg(F.max("business_id").alias("business_id"), *last).drop("_same")
    incoming = matched.select(F.col("business_id").alias("_id"), *[F.col(c).alias("_in_" + c) for c in fields], F.lit(True).alias("_given"))
    # Updates and inserts go apart: a full outer join would send every insert, whose id is NULL, to one task.
    updated = snapshot.join(incoming.filter(F.col("_id").isNotNull()), snapshot["id"] == incoming["_id"], "left")
    inserted = incoming.filter(F.col("_id").isNull()).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in snapshot.schema], "*")
    joined = updated.unionByName(inserted)
    columns: dict[str, Column] = {}
    for name in snapshot.columns:
        if name in ("id", "first_seen_at", "updated_at"):
            continue
        if name not in fields:
            columns[name] = F.col(name)
        elif name == "field_sources":
            empty = F.create_map().cast("map<string,string>")
            columns[name] = merge_maps(F.coalesce(name, empty), F.coalesce("_in_" + name, empty))
        else:
            columns[name] = F.coalesce("_in_" + name, name)
    given = F.coalesce("_given", F.lit(False))
    created = F.col("id").isNull()
    merged = joined.select(
        "id", *[c.alias(n) for n, c in columns.items()],
        F.when(created, now).otherwise(F.col("first_seen_at")).alias("first_seen_at"),
        F.when(given, now).otherwise(F.col("updated_at")).alias("updated_at"),
        created.alias("created"), given.alias("touched"),
    )
    return with_new_ids(merged, snapshot, ["google_maps_url"])


def with_new_ids(rows: DataFrame, snapshot: DataFrame, order: list[str], id_column: str = "id") -> DataFrame:
    """Consecutive ids for rows without one, after the snapshot's highest, in ``order``.

    Counts per range partition give every partition its offset, so no task sees all rows.
    """
    new = rows.filter(F.col(id_column).isNull()).repartitionByRange(*order).sortWithinPartitions(*order)
    new = new.withColumn("_part", F.spark_partition_id()).withColumn("_mono", F.monotonically_increasing_id())
    from leadweave.session import cut_lineage

    new = cut_lineage(new)
    sizes = new.groupBy("_part").agg(F.count("*").alias("n"), F.min("_mono").alias("start"))
    # One row per partition: the running total over them is a tiny window.
    offsets = sizes.withColumn(
        "_offset", F.coalesce(F.sum("n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ).select("_part", "start", "_offset")
    top = snapshot.agg(F.coalesce(F.max(id_column), F.lit(0)).alias("top")).first()["top"]
    numbered = new.join(F.broadcast(offsets), "_part").withColumn(
        id_column, F.lit(top) + F.col("_offset") + (F.col("_mono") - F.col("start")) + 1
    )
    return rows.filter(F.col(id_column).isNotNull()).unionByName(numbered.select(*rows.columns))


# ------------------------------------------------------------------ U2, U13
def update_columns(snapshot: DataFrame, changes: DataFrame, key: str = "id", now: Column | None = None) -> DataFrame:
    """Overwrite the columns of ``changes`` (NULL included) on the rows it names.

    A column the table does not have is an error. Ids that do not exist are returned by
    ``missing_ids``.
    """
    unknown = [c for c in changes.columns if c not in snapshot.columns]
    if unknown:
        raise ValueError(f"unknown columns: {unknown}")
    names = [c for c in changes.columns if c != key]
    new = changes.select(key, *[F.col(c).alias("_c_" + c) for c in names], F.lit(True).alias("_changed"))
    joined = snapshot.join(new, key, "left")
    updates = {c: F.when(F.col("_changed"), F.col("_c_" + c)).otherwise(F.col(c)) for c in names}
    if now is not None and "updated_at" in snapshot.columns:
        updates["updated_at"] = F.when(F.col("_changed"), now).otherwise(F.col("updated_at"))
    return joined.withColumns(updates).drop("_changed", *["_c_" + c for c in names])


def unmark_duplicates(snapshot: DataFrame, prints: DataFrame, cleared: DataFrame, key: str = "id", owner: str = "business_id",
                      reason: str = "duplicate_reason") -> tuple[DataFrame, DataFrame]:
    """U13, back: the businesses of ``cleared`` (column ``key``) are no duplicates any more.

    Returns the snapshot without their reason and the print registry with the prints of ``prints``
    (all prints of businesses, ``owner`` among the columns) that the cleared ones had given up.
    ``prints`` has a boolean column ``registered``; businesses that were no duplicates change nothing.
    """
    names = cleared.select(F.col(key).alias("_cleared")).distinct()
    marked = snapshot.join(names, F.col(key) == F.col("_cleared"), "left")
    was = marked.filter(F.col("_cleared").isNotNull() & F.col(reason).isNotNull()).select(F.col("_cleared").alias("_free"))
    plain = marked.withColumn(reason, F.when(F.col("_cleared").isNull(), F.col(reason))).drop("_cleared")
    freed = prints.join(was, F.col(owner) == F.col("_free"), "left")
    return plain, freed.withColumn("registered", F.col("registered") | F.col("_free").isNotNull()).drop("_free")


def missing_ids(snapshot: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    return changes.join(snapshot, key, "left_anti").select(key)


# ------------------------------------------------------------------ U3
def upsert_search_results(links: DataFrame, batch: DataFrame) -> DataFrame:
    """One row per search and business; the batch overwrites the position."""
    rows = links.select("search_id", "business_id", "position", F.lit(0).alias("_new")).unionByName(
        batch.select("search_id", "business_id", "position", F.lit(1).alias("_new"))
    )
    return rows.groupBy("search_id", "business_id").agg(F.max_by("position", F.struct("_new", "position")).alias("position"))


# ------------------------------------------------------------------ U5
def upsert_contacted(contacted: DataFrame, batch: DataFrame, now: Column) -> DataFrame:
    """New contact list after a batch of parsed lines (``line_no`` gives their order).

    Non-empty fields overwrite; repeats of a number inside the batch apply in line order.
    ``added`` and ``updated`` count the lines of each number that inserted or changed it.
    """
    fields = ["name", "phone_raw", "status", "contacted_on", "note"]
    last = {f: F.max_by(f, F.when(F.coalesce(f, F.lit("")) != "", F.col("line_no"))) for f in fields}
    folded = batch.groupBy("phone_e164").agg(
        F.count("*").alias("_lines"), F.min("line_no").alias("_first"), *[c.alias("_in_" + f) for f, c in last.items()]
    )
    joined = contacted.join(folded, "phone_e164", "full_outer")
    created = F.col("id").isNull()
    merged = joined.select(
        "id", *[F.coalesce(blank_to_null(F.col("_in_" + f)), F.col(f)).alias(f) if f != "phone_e164" else F.col(f) for f in fields],
        "phone_e164", F.when(created, now).otherwise(F.col("imported_at")).alias("imported_at"),
        F.when(created, 1).otherwise(0).alias("added"),
        F.coalesce(F.col("_lines") - F.when(created, 1).otherwise(0), F.lit(0)).alias("updated"),
        "_first",
    )
    return with_new_ids(merged, contacted, ["_first", "phone_e164"]).drop("_first")


# ------------------------------------------------------------------ D1-D3, W18: fingerprints
def print_rank(kind: Column) -> Column:
    return exact_lookup(kind, fv.PRINT_RANK)


def distinct_prints(rows: DataFrame, owner: str) -> DataFrame:
    """Distinct prints per owner with their order: kind rank, then where they first appeared."""
    once = rows.filter(F.coalesce("value", F.lit("")) != "").groupBy(owner, "kind", "value").agg(F.min("slot").alias("slot"))
    return once.select(owner, "kind", "value", F.struct(print_rank(F.col("kind")).alias("kind_rank"), "slot").alias("print_order"))


# Where a print comes from; the slots order prints of one kind.
SLOT_PHONE, SLOT_CONTACT, SLOT_CANDIDATES = 0, 1, 2
SLOT_SITE, SLOT_ORIGINAL_SITE = 1_000_000, 1_000_001
SLOT_PROFILES = 2_000_000


def business_print_rows(businesses: DataFrame, owner: str = "id") -> DataFrame:
    """Every fingerprint a business carries, with the slot it comes from (not yet distinct)."""
    columns = businesses.columns
    candidates = F.col("whatsapp_candidates") if "whatsapp_candidates" in columns else F.array().cast("array<struct<number:string>>")
    original = F.col("field_sources")["website_maps"] if "field_sources" in columns else F.lit(None).cast("string")
    numbers = F.concat(
        F.array("phone_e164", contact_link_digits("whatsapp_url")),
        F.coalesce(F.transform(candidates, lambda c: c["number"]), F.array().cast("array<string>")),
    )
    by_number = businesses.select(owner, F.posexplode(numbers).alias("slot", "raw")).select(
        owner, F.lit(fv.PRINT_NUMBER).alias("kind"), number_key("raw").alias("value"), "slot"
    )
    links = businesses.select(owner, F.posexplode(F.array("website", original)).alias("slot", "url")).filter(F.coalesce("url", F.lit("")) != "")
    by_link = with_link_print(links, "url", "print").select(
        owner, F.col("print_kind").alias("kind"), F.col("print_value").alias("value"), (F.col("slot") + SLOT_SITE).alias("slot")
    )
    profiles = businesses.select(owner, F.posexplode(F.array("instagram", "facebook")).alias("slot", "url")).filter(F.coalesce("url", F.lit("")) != "")
    by_profile = with_social(profiles, "url", "p").select(
        owner, F.lit(fv.PRINT_SOCIAL).alias("kind"), F.lower("p_profile").alias("value"), (F.col("slot") + SLOT_PROFILES).alias("slot")
    )
    return by_number.unionByName(by_link).unionByName(by_profile).filter(F.coalesce("value", F.lit("")) != "")


def business_prints(businesses: DataFrame, owner: str = "id") -> DataFrame:
    """Distinct fingerprints of each business: phone, contact numbers, site, original site, two profiles."""
    return distinct_prints(business_print_rows(businesses, owner), owner)


def card_prints(cards: DataFrame, owner: str = "listing_id") -> DataFrame:
    """D3: fingerprints visible on a listing card: its site link and phone."""
    by_link = with_link_print(cards.filter(F.coalesce("website", F.lit("")) != ""), "website", "print").select(
        owner, F.col("print_kind").alias("kind"), F.col("print_value").alias("value"), F.lit(0).alias("slot")
    )
    by_number = cards.select(owner, F.lit(fv.PRINT_NUMBER).alias("kind"), number_key("phone_e164").alias("value"), F.lit(1).alias("slot"))
    return distinct_prints(by_link.unionByName(by_number), owner)


# ------------------------------------------------------------------ U4, U14
def replace_prints(fingerprints: DataFrame, fresh: DataFrame, now: Column) -> DataFrame:
    """U4: the owners named in ``fresh(business_id, contacted_id, kind, value, print_order)`` get exactly those prints.

    An owner row with NULL kind clears its prints.
    """
    owner = F.concat_ws(":", F.when(F.col("business_id").isNotNull(), "b").otherwise("c"), F.coalesce("business_id", "contacted_id").cast("string"))
    owners = fresh.select(owner.alias("_owner")).distinct()
    kept = fingerprints.withColumn("_owner", owner).join(owners, "_owner", "left_anti").drop("_owner")
    new = fresh.filter(F.col("value").isNotNull()).groupBy("business_id", "contacted_id", "kind", "value").agg(F.min("print_order").alias("print_order"))
    new = new.select(
        F.lit(None).cast("long").alias("id"), "kind", "value", "business_id", "contacted_id", now.alias("created_at"), "print_order"
    )
    merged = kept.withColumn("print_order", F.lit(None).cast(new.schema["print_order"].dataType)).unionByName(new)
    order = ["contacted_id", "business_id", "print_order", "kind", "value"]
    return with_new_ids(merged, fingerprints, order).drop("print_order")
