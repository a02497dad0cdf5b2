"""Listings decided as they arrive, with Structured Streaming.

State is a ``SnapshotStore``: each batch reads the one snapshot before its own number and commits its
outcomes, place keys, businesses (U1), search links (U3) and fingerprints (U14) together, so a batch that
is replayed after a failure, at whatever point, leaves the same state, and a batch reads as many
folders as the first one did.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadweave.operators.identity import find_business, replace_prints, upsert_businesses, upsert_search_results
from leadweave.operators.suppression import suppress_repeats
from leadweave.session import cut_lineage
from leadweave.streaming.snapshots import SnapshotStore

TABLES = {
    "outcomes": ("listing_id long, run_id long, position int, rank long, outcome string, stage string, "
                 "shared_kind string, shared_value string, repeat_of long"),
    "place_keys": "value string, run_id long, listing_id long",
    "businesses": "id long, place_id string, google_maps_url string, business_name string, first_seen_at timestamp, updated_at timestamp",
    "links": "search_id long, business_id long, position int",
    "prints": "id long, kind string, value string, business_id long, contacted_id long, created_at timestamp",
}
KEYS = {"businesses": ["id"], "links": ["search_id", "business_id"]}


def intake_store(spark: SparkSession, root: str, most_folders: int = 8) -> SnapshotStore:
    return SnapshotStore(spark, root, TABLES, KEYS, most_folders)


def opened_listings(outcomes: DataFrame) -> DataFrame:
    """Listings whose place was opened and read."""
    late = F.col("outcome").isin("duplicate", "no_website") & F.col("stage").isin("place", "post")
    return outcomes.filter(F.col("outcome").isin("lead", "not_lead") | late)


def decide_batch(
    store: SnapshotStore, batch: DataFrame, batch_id: int, target: int, expand: Callable[[DataFrame], tuple[DataFrame, DataFrame]],
    now: Column, max_listings: int | None = None,
) -> None:
    """One micro-batch: drop listings already seen in their run (T3), decide the rest against stored prints and store what follows.

    ``batch`` has the columns of ``suppress_repeats``' listings (without the ``_stored`` flags and the target)
    and ``place_id, google_maps_url, business_name`` of the place; ``expand`` gives the fingerprint checks
    and place keys of listings. ``now`` stamps what is stored.
    """
    before = {name: store.read(name, before=batch_id) for name in TABLES}
    seen = before["outcomes"]
    fresh = cut_lineage(batch.join(seen.select("run_id", "listing_id"), ["run_id", "listing_id"], "left_anti"))
    checks, keys = expand(fresh)
    known = before["place_keys"].select("value").distinct()
    prints = before["prints"].select("kind", "value").distinct()
    known_ids = keys.join(known, "value", "left_semi").select("listing_id").distinct().withColumn("_known", F.lit(True))
    hits = checks.join(prints, ["kind", "value"], "left_semi").groupBy("listing_id").agg(
        *[F.bool_or(F.col("stage") == s).alias(f"_{s}") for s in ("card", "place", "post")])
    accepted = seen.filter(F.col("outcome") == "lead").groupBy("run_id").agg(F.count("*").alias("_done"))
    listings = fresh.join(known_ids, "listing_id", "left").join(hits, "listing_id", "left").join(accepted, "run_id", "left")
    listings = listings.withColumns({
        "known_stored": F.coalesce("_known", F.lit(False)) | (F.col("known_stored") if "known_stored" in batch.columns else F.lit(False)),
        **{f"{s}_stored": F.coalesce(f"_{s}", F.lit(False)) for s in ("card", "place", "post")},
        "target": F.greatest(F.lit(target) - F.coalesce("_done", F.lit(0)), F.lit(0)),
    }).drop("_known", "_card", "_place", "_post", "_done")
    outcomes = cut_lineage(suppress_repeats(listings, checks, keys, max_listings))
    opened, leads = opened_listings(outcomes), outcomes.filter(F.col("outcome") == "lead")
    # A place read in several runs of one batch is one business; later values win.
    places = fresh.join(opened.select("run_id", "listing_id"), ["run_id", "listing_id"])
    merged = upsert_businesses(before["businesses"], places.select("place_id", "google_maps_url", "business_name", F.col("rank").alias("arrival")), now)
    businesses = cut_lineage(merged.filter("touched").drop("created", "touched"))
    # U3 and U14 name businesses by the ids they have now.
    owned = cut_lineage(find_business(places.select("run_id", "listing_id", "position", "place_id", F.col("google_maps_url").alias("canonical_url")), businesses))
    links = upsert_search_results(before["links"].limit(0), owned.select(F.col("run_id").alias("search_id"), "business_id", "position"))
    owners = owned.join(leads.select("run_id", "listing_id"), ["run_id", "listing_id"]).select("listing_id", "business_id")
    left = checks.filter(F.col("stage") == "post").join(owners, "listing_id").select(
        "business_id", F.lit(None).cast("long").alias("contacted_id"), "kind", "value", "print_order")
    registered = replace_prints(before["prints"], left, now).join(owners.select("business_id").distinct(), "business_id", "left_semi")
    store.commit(batch_id, {
        "outcomes": outcomes, "place_keys": keys.join(opened.select("listing_id", "run_id"), "listing_id"), "businesses": businesses, "links": links, "prints": registered})


def start_intake(
    listings: DataFrame, store: SnapshotStore, target: int, expand: Callable[[DataFrame], tuple[DataFrame, DataFrame]], now: Column,
    max_listings: int | None = None, trigger: dict | None = None,
) -> StreamingQuery:
    """Start deciding a stream of listings; the store holds what is decided."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        decide_batch(store, batch, batch_id, target, expand, now, max_listings)

    return listings.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{store.root}/_progress").trigger(
        **(trigger or {"availableNow": True})).start()


def _batch_path(root: str, name: str, batch_id: int) -> str:
    return f"{root.rstrip('/')}/{name}/batch={batch_id:012d}"


def start_counters(outcomes: DataFrame, root: str, trigger: dict | None = None) -> StreamingQuery:
    """Keep running counters of a stream as files: each batch writes the counters it changed, a replayed one writes them again."""
    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(_batch_path(root, "counters", batch_id))

    return live_counters(outcomes).writeStream.outputMode("update").foreachBatch(on_batch).option(
        "checkpointLocation", f"{root.rstrip('/')}/_counting").trigger(**(trigger or {"availableNow": True})).start()


def read_counters(spark: SparkSession, root: str) -> DataFrame:
    """The newest value of every counter: ``run_id, outcome, n``."""
    changes = spark.read.schema("run_id long, outcome string, count long, batch long").parquet(f"{root.rstrip('/')}/counters")
    return changes.groupBy("run_id", "outcome").agg(F.max_by("count", "batch").alias("n"))


def live_counters(outcomes: DataFrame) -> DataFrame:
    """Running outcome counts per run over a stream of outcomes (update mode; one row per run and outcome)."""
    return outcomes.groupBy("run_id", "outcome").count()
