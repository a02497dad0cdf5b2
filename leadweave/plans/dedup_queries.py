"""Identity, upserts, fingerprints and suppression (J4-J6, J8-J10, U*, D4-D6, A3, A6, X23, T1-T3)."""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.operators import contact_import, identity, leads, suppression
from leadweave.operators.fusion import merge_maps
from leadweave.plans.inputs import Inputs
from leadweave.plans.key_queries import PRINTS_SQL
from leadweave.plans.mart_queries import IS_LEAD, PROSPECTED
from leadweave.plans.registry import query
from leadweave.schemas import upgrade
from leadweave.session import cut_lineage, work_folder
from leadweave.streaming import intake

_PRETTY = """CASE WHEN {v} LIKE '569%' THEN '+56 9 ' || substr({v}, 4, 4) || ' ' || substr({v}, 8) WHEN {v} LIKE '562%' THEN '+56 2 ' || substr({v}, 4, 4) || ' ' || substr({v}, 8) ELSE '+' || {v} END"""


def now():
    return F.to_timestamp(F.lit("2024-02-01 00:00:00"))


# ------------------------------------------------------------------ stored fingerprints
# Every tenth contacted owner is missing from the contact list: its prints are orphans.
FINGERPRINTS_SQL = f"""{PRINTS_SQL},
  fingerprints AS (
    SELECT id AS fid, 'numero' AS kind, substr(phone_e164, 2) AS value, CAST(NULL AS BIGINT) AS business_id,
      CASE WHEN id % 10 = 0 THEN id + 100000000 ELSE id END AS contacted_id FROM {{contacted}}
    UNION ALL SELECT 1000000000 + b.id * 100 + row_number() OVER (PARTITION BY b.id ORDER BY ord), kind, value, b.id, NULL
      FROM {{businesses}} b JOIN prints ON prints.id = b.id WHERE {PROSPECTED})"""


def fingerprints(d: Inputs) -> DataFrame:
    from pyspark.sql.window import Window as W
    people = d.contacted.select(
        "id", F.lit(fv.PRINT_NUMBER).alias("kind"), F.regexp_replace("phone_e164", r"^\+", "").alias("value"), F.lit(None).cast("long").alias("business_id"),
        F.when(F.col("id") % 10 == 0, F.col("id") + 100_000_000).otherwise(F.col("id")).alias("contacted_id"))
    own = identity.business_prints(d.businesses_full().filter(leads.already_prospected()))
    own = own.select(
        (F.lit(1_000_000_000) + F.col("id") * 100 + F.row_number().over(W.partitionBy("id").orderBy("print_order"))).alias("id"), "kind", "value",
        F.col("id").alias("business_id"), F.lit(None).cast("long").alias("contacted_id"))
    return people.unionByName(own)


def _listings_and_first_run(d: Inputs) -> DataFrame:
    """Listings with the first of all runs that returned their business, at any position."""
    first = d.search_results.groupBy(F.col("business_id").alias("listing_id")).agg(F.min("search_id").alias("first_run"))
    return d.listings.join(first, "listing_id", "left")


# ------------------------------------------------------------------ J4
query("J4_find_business", "lookup_id long, business_id long", """
    WITH l AS (SELECT event_id AS lookup_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE 'place_id:ChI' || lpad(CAST(event_id % 4000 AS VARCHAR), 12, '0') END AS place_id,
        'https://www.google.com/maps/place/n' || CAST(event_id % 2500 AS VARCHAR) AS url FROM {events})
    SELECT lookup_id, coalesce(p.id, u.id) AS business_id FROM l LEFT JOIN {businesses} p ON p.place_id = l.place_id LEFT JOIN {businesses} u ON u.google_maps_url = l.url""")(
    lambda d: identity.find_business(d.events.select(
        F.col("event_id").alias("lookup_id"),
        F.when(F.col("event_id") % 3 != 0, F.concat(F.lit("place_id:ChI"), F.lpad((F.col("event_id") % 4000).cast("string"), 12, "0"))).alias("place_id"),
        F.concat(F.lit("https://www.google.com/maps/place/n"), (F.col("event_id") % 2500).cast("string")).alias("canonical_url")), d.businesses))

# ------------------------------------------------------------------ J5, J6, J8, J9, W6
query("J5_W6_fingerprint_match", "id long, kind string, value string, contacted_id long, business_id long", f"""WITH {FINGERPRINTS_SQL}
    SELECT id, kind, value, contacted_id, business_id FROM (SELECT p.id, p.kind, p.value, f.contacted_id, f.business_id,
      row_number() OVER (PARTITION BY p.id, p.kind, p.value ORDER BY f.contacted_id IS NULL, f.fid) AS rn
      FROM prints p JOIN fingerprints f ON f.kind = p.kind AND f.value = p.value WHERE f.business_id IS NULL OR f.business_id <> p.id) x WHERE rn = 1""")(
    lambda d: suppression.match_prints(
        identity.business_prints(d.businesses_full()), suppression.owner_of_prints(fingerprints(d), d.contacted, d.businesses_full())).select(
        "id", "kind", "value", F.col("match.contacted_id").alias("contacted_id"), F.col("match.business_id").alias("business_id")))
_J6 = f"""WITH {FINGERPRINTS_SQL},
    m AS (SELECT p.id, p.kind, p.value, p.ord, f.contacted_id, f.business_id, row_number() OVER (PARTITION BY p.id, p.kind, p.value ORDER BY f.contacted_id IS NULL, f.fid) AS rn
      FROM prints p JOIN fingerprints f ON f.kind = p.kind AND f.value = p.value WHERE (f.business_id IS NULL OR f.business_id <> p.id) AND {{{{extra}}}}),
    o AS (SELECT m.*, c.name AS cname, c.status, c.contacted_on, b.business_name, b.discard_reason FROM m LEFT JOIN {{contacted}} c ON c.id = m.contacted_id
      LEFT JOIN {{businesses}} b ON b.id = m.business_id WHERE rn = 1 AND (c.id IS NOT NULL OR b.id IS NOT NULL)),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ord) AS k FROM o)
    SELECT id, kind, value, business_id AS duplicate_of_id, contacted_id, 'Tiene ' || CASE kind WHEN 'numero' THEN 'el mismo número (' || {_PRETTY.format(v='value')} || ')'
        WHEN 'web' THEN 'la misma web (' || value || ')' ELSE 'la misma red social (' || value || ')' END
      || CASE WHEN contacted_id IS NOT NULL THEN ' que «' || cname || '», a quien ya contactaste' || CASE WHEN status IS NULL AND contacted_on IS NULL THEN ''
           ELSE ' (' || concat_ws(', ', status, contacted_on) || ')' END || '.'
         WHEN discard_reason IS NOT NULL THEN ' que «' || business_name || '» (lo descartaste).' ELSE ' que «' || business_name || '», que ya apareció en tus leads.' END AS duplicate_reason
    FROM r WHERE k = 1"""
_DUP_OUT = "id long, kind string, value string, duplicate_of_id long, contacted_id long, duplicate_reason string"
query("J6_find_duplicates", _DUP_OUT, _J6.replace("{{extra}}", "true"))(
    lambda d: suppression.find_duplicates(
        identity.business_prints(d.businesses_full()), suppression.owner_of_prints(fingerprints(d), d.contacted, d.businesses_full())))
query("J8_D6_flag_contacted", _DUP_OUT, _J6.replace("{{extra}}", """f.contacted_id IS NOT NULL AND p.kind = 'numero'
      AND p.id IN (SELECT id FROM {businesses} WHERE duplicate_reason IS NULL AND discard_reason IS NULL)"""))(
    lambda d: suppression.flag_contacted(d.businesses_full(), fingerprints(d), d.contacted))
query("J9_backfill_prints", "id long, kind string, value string", f"""WITH {PRINTS_SQL} SELECT p.id, kind, value FROM prints p JOIN {{businesses}} b ON b.id = p.id
    WHERE {PROSPECTED} AND NOT EXISTS (SELECT 1 FROM {{listings}} l JOIN {{search_results}} r ON r.business_id = l.listing_id WHERE l.listing_id = b.id AND r.search_id < l.run_id)""")(
    lambda d: suppression.missing_prints(
        d.businesses_full(), _listings_and_first_run(d).filter("first_run < run_id").select(F.col("listing_id").alias("business_id")), leads.already_prospected()))
query("J10_locality_to_place", "id long, commune string", """WITH c AS (SELECT translate(n_name, '0123456789_', 'abcdefghij-') AS name FROM {nation})
    SELECT b.id, c.name AS commune FROM {businesses} b LEFT JOIN c ON lower(c.name) = lower(b.city)""")(
    lambda d: d.businesses.select("id", F.lower("city").alias("folded")).join(d.nation.select(
        F.expr("translate(n_name, '0123456789_', 'abcdefghij-')").alias("commune"), F.lower(F.expr("translate(n_name, '0123456789_', 'abcdefghij-')")).alias("folded")), "folded", "left"))

# ------------------------------------------------------------------ D4, D5, A3, W19
_CHECKS_SQL = f"""{PRINTS_SQL},
  owned AS (SELECT 'numero' AS kind, substr(phone_e164, 2) AS value FROM {{contacted}}),
  tagged AS (SELECT id, slot, kind || '=' || value AS p, EXISTS (SELECT 1 FROM owned o WHERE o.kind = r.kind AND o.value = r.value) AS stored FROM raw_prints r),
  li AS (SELECT l.*,
      coalesce(list(p) FILTER (WHERE slot IN (0, 10)), CAST([] AS VARCHAR[])) AS card, coalesce(bool_or(stored) FILTER (WHERE slot IN (0, 10)), false) AS card_stored,
      coalesce(list(p) FILTER (WHERE slot <> 1), CAST([] AS VARCHAR[])) AS place_prints, coalesce(bool_or(stored) FILTER (WHERE slot <> 1), false) AS place_stored,
      coalesce(list(p) FILTER (WHERE p IS NOT NULL), CAST([] AS VARCHAR[])) AS post, coalesce(bool_or(stored), false) AS post_stored
    FROM {{listings}} l LEFT JOIN tagged t ON t.id = l.listing_id GROUP BY ALL)"""
_WALK = f"""WITH RECURSIVE {_CHECKS_SQL},
  walk AS (
    SELECT CAST(-1 AS BIGINT) AS n, CAST(-1 AS BIGINT) AS run, CAST(0 AS BIGINT) AS got, CAST([] AS VARCHAR[]) AS acc, CAST([] AS VARCHAR[]) AS opn,
      CAST(NULL AS VARCHAR) AS outcome
    UNION ALL
    SELECT rank, run_id, g + CASE WHEN o = 'lead' THEN 1 ELSE 0 END, CASE WHEN o = 'lead' THEN list_concat(acc, post) ELSE acc END,
      CASE WHEN o IN ('lead', 'not_lead', 'duplicate:place', 'duplicate:post', 'no_website:place') THEN list_append(opn, place) ELSE opn END, o
    FROM (SELECT *, CASE WHEN g >= target THEN 'untouched' WHEN known_stored OR list_contains(opn, place) THEN 'skipped' WHEN NOT card_has_site THEN 'no_website:card'
        WHEN card_stored OR list_has_any(acc, card) THEN 'duplicate:card' WHEN NOT readable THEN 'unreadable'
        WHEN place_stored OR list_has_any(acc, place_prints) THEN 'duplicate:place' WHEN NOT site_open THEN 'no_website:place' WHEN NOT is_lead THEN 'not_lead'
        WHEN post_stored OR list_has_any(acc, post) THEN 'duplicate:post' ELSE 'lead' END AS o
      FROM (SELECT l.*, w.acc, w.opn, CASE WHEN w.run = l.run_id THEN w.got ELSE 0 END AS g FROM walk w JOIN li l ON l.rank = w.n + 1) x) y)"""


def listing_inputs(d: Inputs) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Listings with their stored-match flags, print checks per stage, and place keys."""
    rows = cut_lineage(identity.business_print_rows(d.businesses_full(), "id").withColumnRenamed("id", "listing_id"))
    stages = {"card": F.col("slot").isin(identity.SLOT_PHONE, identity.SLOT_SITE), "place": F.col("slot") != identity.SLOT_CONTACT, "post": F.lit(True)}
    parts = [identity.distinct_prints(rows.filter(test), "listing_id").withColumn("stage", F.lit(stage)) for stage, test in stages.items()]
    checks = parts[0].unionByName(parts[1]).unionByName(parts[2])
    stored = d.contacted.select(F.lit(fv.PRINT_NUMBER).alias("kind"), F.regexp_replace("phone_e164", r"^\+", "").alias("value"))
    hits = checks.join(stored, ["kind", "value"], "left_semi").groupBy("listing_id").agg(
        *[F.bool_or(F.col("stage") == s).alias(f"{s}_stored") for s in ("card", "place", "post")])
    listings = d.listings.join(hits, "listing_id", "left").fillna(False, ["card_stored", "place_stored", "post_stored"])
    return listings, checks, d.listings.select("listing_id", F.col("place").alias("value"))


def with_stage(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn(
        "outcome", F.when(F.col("outcome").isin("duplicate", "no_website"), F.concat_ws(":", "outcome", "stage")).otherwise(F.col("outcome")))


def _outcomes(d: Inputs) -> DataFrame:
    return with_stage(suppression.suppress_repeats(*listing_inputs(d)))


query("D4_W19_first_seen_suppression", "listing_id long, outcome string", f"{_WALK} SELECT n AS listing_id, outcome FROM walk WHERE n >= 0")(_outcomes)
query("A3_run_counters", "run_id long, leads long, skipped long, duplicates long, no_website long, untouched long", f"""{_WALK}
    SELECT run AS run_id, count(*) FILTER (WHERE outcome = 'lead') AS leads, count(*) FILTER (WHERE outcome = 'skipped') AS skipped,
      count(*) FILTER (WHERE outcome LIKE 'duplicate%') AS duplicates, count(*) FILTER (WHERE outcome LIKE 'no_website%') AS no_website,
      count(*) FILTER (WHERE outcome = 'untouched') AS untouched FROM walk WHERE n >= 0 GROUP BY 1""")(
    lambda d: suppression.run_counters(suppression.suppress_repeats(*listing_inputs(d))))
query("D5_known_places", "listing_id long", "SELECT listing_id FROM {listings} l WHERE NOT EXISTS (SELECT 1 FROM {search_results} r WHERE r.business_id = l.listing_id AND r.search_id < l.run_id)")(
    lambda d: _listings_and_first_run(d).filter(~F.coalesce(F.col("first_run") < F.col("run_id"), F.lit(False))).drop("first_run"))


def _streamed(d: Inputs) -> DataFrame:
    """The same listings decided as a growing feed of files, one micro-batch after another, and everything the batches stored."""
    spark, root = d.spark, work_folder(d.spark, "intake")
    listings, checks, keys = listing_inputs(d)
    checks, keys = cut_lineage(checks), cut_lineage(keys)
    feed_columns = [c for c in listings.columns if not c.endswith("_stored") or c == "known_stored"]
    bounds = listings.agg(F.max("rank")).first()[0] // 4 + 1
    shown = listings.select(
        *[c for c in feed_columns if c not in ("target", "place")], F.col("place").alias("place_id"),
        F.concat(F.lit("https://www.google.com/maps/place/"), F.regexp_replace("place", ":", "")).alias("google_maps_url"),
        F.concat(F.lit("Negocio "), F.col("listing_id").cast("string")).alias("business_name"))
    store = intake.intake_store(spark, root, most_folders=3)
    stored = d.contacted.select(
        F.col("id"), F.lit(fv.PRINT_NUMBER).alias("kind"), F.regexp_replace("phone_e164", r"^\+", "").alias("value"), F.lit(None).cast("long").alias("business_id"),
        F.col("id").alias("contacted_id"), now().alias("created_at"))
    store.commit(-1, {"prints": stored})  # what was known before the first batch

    def expand(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        ids = batch.select("listing_id")
        return checks.join(ids, "listing_id", "left_semi"), keys.join(ids, "listing_id", "left_semi")

    for part in range(4):  # the feed grows in rank order; each run of the stream decides what is new in it
        shown.filter(F.floor(F.col("rank") / bounds) == part).write.mode("append").parquet(f"{root}/feed")
        feed = spark.readStream.schema(shown.schema).parquet(f"{root}/feed")
        intake.start_intake(feed, store, 12, expand, now()).awaitTermination()
    outcomes = store.read("outcomes")
    opened = intake.opened_listings(outcomes).join(d.listings.select("listing_id", F.col("place").alias("place_id")), "listing_id").join(
        store.read("businesses").select("place_id", F.col("id").alias("business_id"), "business_name"), "place_id")
    linked = opened.join(store.read("links").select(F.col("search_id").alias("run_id"), "business_id", F.col("position").alias("link_position")), ["run_id", "business_id"])
    owned = store.read("prints").filter("business_id IS NOT NULL").groupBy("business_id").agg(
        F.array_join(F.array_sort(F.collect_list(F.concat("kind", F.lit("="), "value"))), "|").alias("prints"))
    stored_rows = linked.join(owned, "business_id", "left").select("listing_id", "business_id", "business_name", "link_position", "prints")
    return with_stage(outcomes).join(stored_rows, "listing_id", "left")


query("T1_T3_incremental_intake", "listing_id long, outcome string, business_id long, business_name string, link_position long, prints string", f"""{_WALK},
  placed AS (SELECT n, outcome, position, 'Negocio ' || n AS business_name, CASE WHEN outcome = 'lead' AND len(post) > 0 THEN array_to_string(list_sort(list_distinct(post)), '|') END AS prints,
      row_number() OVER (ORDER BY n // ((SELECT max(rank) FROM {{listings}}) // 4 + 1), replace(place, ':', '')) AS business_id
    FROM walk JOIN li ON li.rank = walk.n WHERE outcome IN ('lead', 'not_lead', 'duplicate:place', 'duplicate:post', 'no_website:place'))
    SELECT w.n AS listing_id, w.outcome, p.business_id, p.business_name, p.position AS link_position, p.prints FROM walk w LEFT JOIN placed p ON p.n = w.n WHERE w.n >= 0""")(_streamed)


def _live(d: Inputs) -> DataFrame:
    """Running counters over a stream of event outcomes, read back after the stream is drained."""
    spark, root = d.spark, work_folder(d.spark, "live")
    d.events.select((F.col("user_id") % 7).alias("run_id"), F.col("event_type").alias("outcome")).repartition(3).write.parquet(f"{root}/outcomes")
    stream = spark.readStream.schema("run_id long, outcome string").option("maxFilesPerTrigger", 1).parquet(f"{root}/outcomes")
    intake.start_counters(stream, root).awaitTermination()
    return intake.read_counters(spark, root)


query("T2_live_counters", "run_id long, outcome string, n long", "SELECT user_id % 7 AS run_id, event_type AS outcome, count(*) AS n FROM {events} GROUP BY 1, 2")(_live)


# ------------------------------------------------------------------ U1-U5, U7, U12-U14
def _batch(d: Inputs) -> DataFrame:
    n = d.customer.count()
    shifted = F.col("id") + n // 2
    return d.businesses.select(
        F.concat(F.lit("place_id:ChI"), F.lpad(shifted.cast("string"), 12, "0")).alias("place_id"),
        F.concat(F.lit("https://www.google.com/maps/place/n"), shifted.cast("string"), F.lit("/@-34.1,-70.7,17z?entry=ttu")).alias("google_maps_url"),
        F.concat(F.lit("Nuevo "), "business_name").alias("business_name"), F.when(F.col("id") % 2 == 0, F.col("city")).alias("city"),
        F.create_map(F.lit("city"), F.lit("maps")).alias("field_sources"))


def _snapshot(d: Inputs) -> DataFrame:
    return d.businesses_full().select("id", "place_id", "google_maps_url", "business_name", "city", "website", "field_sources").withColumns({
        "first_seen_at": F.to_timestamp(F.lit("2024-01-01 00:00:00")), "updated_at": F.to_timestamp(F.lit("2024-01-01 00:00:00"))})


query("U1_upsert_businesses", "id long, place_id string, business_name string, city string, website string, city_source string, created boolean, touched boolean", """
    WITH n AS (SELECT count(*) AS c, CAST(floor(count(*) / 2) AS BIGINT) AS h FROM {customer}),
      inc AS (SELECT id + h AS tid, 'Nuevo ' || business_name AS business_name, CASE WHEN id % 2 = 0 THEN city END AS city FROM {businesses}, n),
      fresh AS (SELECT *, 'https://www.google.com/maps/place/n' || CAST(tid AS VARCHAR) AS url FROM inc WHERE tid NOT IN (SELECT id FROM {businesses}))
    SELECT b.id, b.place_id, coalesce(i.business_name, b.business_name) AS business_name, coalesce(i.city, b.city) AS city, b.website,
      CASE WHEN i.tid IS NOT NULL THEN 'maps' END AS city_source, false AS created, i.tid IS NOT NULL AS touched FROM {businesses} b LEFT JOIN inc i ON i.tid = b.id
    UNION ALL SELECT (SELECT max(id) FROM {businesses}) + row_number() OVER (ORDER BY url), 'place_id:ChI' || lpad(CAST(tid AS VARCHAR), 12, '0'), business_name, city, NULL,
      'maps', true, true FROM fresh""")(
    lambda d: identity.upsert_businesses(_snapshot(d), _batch(d), now()).withColumn("city_source", F.try_element_at("field_sources", F.lit("city"))))
query("U2_update_columns", "id long, business_name string, city string, website string", """
    SELECT b.id, b.business_name, CASE WHEN c.id IS NOT NULL THEN NULL ELSE b.city END AS city, coalesce(c.website, b.website) AS website FROM {businesses} b
    LEFT JOIN (SELECT id, 'https://x' || CAST(id AS VARCHAR) || '.cl/' AS website FROM {contacted}) c ON c.id = b.id""")(
    lambda d: identity.update_columns(_snapshot(d), d.contacted.select("id", F.lit(None).cast("string").alias("city"), F.concat(F.lit("https://x"), F.col("id").cast("string"), F.lit(".cl/")).alias("website"))))
query("U3_link_upsert", "search_id long, business_id long, position long", """
    SELECT coalesce(r.search_id, n.search_id) AS search_id, coalesce(r.business_id, n.business_id) AS business_id, coalesce(n.position, r.position) AS position
    FROM {search_results} r FULL JOIN (SELECT id AS search_id, id % 100 AS business_id, 99 AS position FROM {searches}) n ON n.search_id = r.search_id AND n.business_id = r.business_id""")(
    lambda d: identity.upsert_search_results(d.search_results, d.searches.select(F.col("id").alias("search_id"), (F.col("id") % 100).alias("business_id"), F.lit(99).alias("position"))))


def _fresh_prints(d: Inputs) -> DataFrame:
    b = d.businesses_full().filter(leads.is_lead())
    order = "print_order"
    return identity.business_prints(b).select(F.col("id").alias("business_id"), F.lit(None).cast("long").alias("contacted_id"), "kind", "value", order)


query("U4_U14_replace_prints", "kind string, value string, business_id long, contacted_id long", f"""WITH {FINGERPRINTS_SQL}
    SELECT kind, value, business_id, contacted_id FROM fingerprints WHERE business_id IS NULL OR business_id NOT IN (SELECT id FROM {{businesses}} WHERE {IS_LEAD})
    UNION ALL SELECT kind, value, id, NULL FROM prints WHERE id IN (SELECT id FROM {{businesses}} WHERE {IS_LEAD})""")(
    lambda d: identity.replace_prints(fingerprints(d).withColumn("created_at", now()), _fresh_prints(d), now()))
query("U7_merge_maps", "id long, a string, b string, c string", """SELECT id, CASE WHEN id % 2 = 0 THEN coalesce(website, business_name) ELSE business_name END AS a, city AS b, CASE WHEN id % 2 = 0 THEN phone_e164 END AS c FROM {businesses}""")(
    lambda d: d.businesses.select("id", merge_maps(
        F.create_map(F.lit("a"), "business_name", F.lit("b"), "city"),
        F.when(F.col("id") % 2 == 0, F.create_map(F.lit("a"), "website", F.lit("c"), "phone_e164")).otherwise(F.create_map().cast("map<string,string>"))).alias("m")
    ).select("id", F.try_element_at("m", F.lit("a")).alias("a"), F.try_element_at("m", F.lit("b")).alias("b"), F.try_element_at("m", F.lit("c")).alias("c")))
query("U12_schema_upgrade", "id long, business_name string, broken boolean, duplicate_reason string, columns long", """
    SELECT id, business_name, false AS broken, CAST(NULL AS VARCHAR) AS duplicate_reason, 37 AS columns FROM {businesses}""")(
    lambda d: upgrade(d.businesses.select("id", "place_id", "google_maps_url", "business_name"), "businesses").transform(
        lambda x: x.withColumns({"broken": F.col("whatsapp_broken_button"), "columns": F.lit(len(x.columns))})))
query("U13_mark_duplicates", "id long, duplicate_of_id long, marked boolean", _J6.replace("{{extra}}", "true").replace(
    "SELECT id, kind, value, business_id AS duplicate_of_id", "SELECT id, business_id AS duplicate_of_id, true AS marked, kind, value"))(
    lambda d: identity.update_columns(
        d.businesses_full().select("id", F.lit(None).cast("long").alias("duplicate_of_id"), F.lit(None).cast("string").alias("duplicate_reason")),
        suppression.find_duplicates(identity.business_prints(d.businesses_full()), suppression.owner_of_prints(fingerprints(d), d.contacted, d.businesses_full())).select(
            "id", "duplicate_of_id", "duplicate_reason")).withColumn("marked", F.col("duplicate_reason").isNotNull()).filter("marked"))



def _unmarked(d: Inputs) -> DataFrame:
    """Every third business is no duplicate any more: its reason goes and its prints count again."""
    businesses = d.businesses_full()
    own = identity.business_prints(businesses).join(businesses.select("id", F.col("duplicate_reason").isNull().alias("registered")), "id")
    plain, prints = identity.unmark_duplicates(businesses, own.withColumnRenamed("id", "business_id"), businesses.filter("id % 3 = 0").select("id"))
    counted = prints.groupBy(F.col("business_id").alias("id")).agg(F.count_if("registered").alias("registered"), F.count("*").alias("prints"))
    return plain.select("id", "duplicate_reason").join(counted, "id", "left").fillna(0, ["registered", "prints"])


query("U13_unmark_duplicates", "id long, duplicate_reason string, registered long, prints long", f"""WITH {PRINTS_SQL},
    n AS (SELECT id, count(*) AS prints FROM prints GROUP BY 1)
    SELECT b.id, CASE WHEN b.id % 3 = 0 THEN NULL ELSE duplicate_reason END AS duplicate_reason,
      CASE WHEN b.id % 3 = 0 OR duplicate_reason IS NULL THEN coalesce(prints, 0) ELSE 0 END AS registered, coalesce(prints, 0) AS prints
    FROM {{businesses}} b LEFT JOIN n ON n.id = b.id""")(_unmarked)

# ------------------------------------------------------------------ X23, A6, U5
_LINES = r"""lines AS (SELECT line_no, trim(line) AS line, line_no % 6 AS k, '+5693' || CAST(1000000 + line_no % 400 AS VARCHAR) AS e164 FROM {contact_lines} WHERE line_no % 6 <> 4),
  parsed AS (SELECT line_no, k <> 3 AS ok, CASE k WHEN 0 THEN 'taller ' || line_no WHEN 1 THEN 'estudio ' || line_no WHEN 2 THEN 'sin columnas ' || line_no WHEN 5 THEN '(sin nombre)' END AS name,
    CASE WHEN k <> 3 THEN e164 END AS phone_e164, CASE k WHEN 0 THEN 'contactado' WHEN 2 THEN 'contactado' END AS status,
    CASE k WHEN 0 THEN '1:39 pm, lunes 30' WHEN 1 THEN '7:00 pm, martes 2' END AS contacted_on, CASE k WHEN 1 THEN 'checked' END AS note FROM lines)"""
query("X23_contact_lines", "line_no long, ok boolean, name string, phone_e164 string, status string, contacted_on string, note string", f"WITH {_LINES} SELECT * FROM parsed")(
    lambda d: contact_import.parse_contact_lines(d.contact_lines))
query("A6_import_totals", "action string, lines long", f"""WITH {_LINES}, g AS (SELECT phone_e164, count(*) AS n FROM parsed WHERE ok GROUP BY 1),
      k AS (SELECT n, phone_e164 IN (SELECT phone_e164 FROM {{contacted}}) AS known FROM g)
    SELECT 'added' AS action, count(*) FILTER (WHERE NOT known) AS lines FROM k UNION ALL SELECT 'updated', sum(n - CASE WHEN known THEN 0 ELSE 1 END) FROM k
    UNION ALL SELECT 'invalid', count(*) FILTER (WHERE NOT ok) FROM parsed""")(
    lambda d: contact_import.import_totals(contact_import.parse_contact_lines(d.contact_lines), d.contacted))
query("U5_upsert_contacted", "id long, phone_e164 string, name string, status string, added long, updated long", f"""WITH {_LINES},
      g AS (SELECT phone_e164, count(*) AS n, min(line_no) AS first, arg_max(name, line_no) AS name, arg_max(status, line_no) FILTER (WHERE status IS NOT NULL) AS status FROM parsed WHERE ok GROUP BY 1),
      j AS (SELECT c.id, coalesce(c.phone_e164, g.phone_e164) AS phone_e164, coalesce(g.name, c.name) AS name, coalesce(g.status, c.status) AS status, g.n, g.first FROM {{contacted}} c FULL JOIN g ON g.phone_e164 = c.phone_e164)
    SELECT CASE WHEN id IS NULL THEN (SELECT max(id) FROM {{contacted}}) + row_number() OVER (PARTITION BY id IS NULL ORDER BY first) ELSE id END AS id, phone_e164, name, status,
      CASE WHEN id IS NULL THEN 1 ELSE 0 END AS added, coalesce(n, 0) - CASE WHEN id IS NULL THEN 1 ELSE 0 END AS updated FROM j""")(
    lambda d: identity.upsert_contacted(
        d.contacted.withColumns({"phone_raw": F.col("phone_e164"), "note": F.lit(None).cast("string"), "imported_at": now()}),
        contact_import.parse_contact_lines(d.contact_lines).filter("ok"), now()))
