"""First-seen suppression of repeated businesses.

The sequential rule (listings in run order, a listing is dropped when an earlier *accepted* one
or a stored owner shares a fingerprint with it, a run stops at its target) is evaluated in
parallel rounds. A round decides every listing whose answer no longer depends on an undecided
earlier one; the earliest undecided listing always qualifies, so the loop ends, and it ends with
exactly the sequential result. Per fingerprint a round only needs two numbers, the lowest
accepted and the lowest undecided rank, which are partial aggregates: no pair of listings is
ever formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions.phones import pretty_number
from leadweave.operators.identity import business_prints, print_rank
from leadweave.operators.skew import hot_safe_lookup, lookup_known
from leadweave.session import cut_lineage

RANK = "rank long"


# ------------------------------------------------------------------ J5, J6: stored owners
def owner_of_prints(fingerprints: DataFrame, contacted: DataFrame, businesses: DataFrame, contacted_only: bool = False) -> DataFrame:
    """Per stored fingerprint its owners, best first: contacted people, then the oldest print.

    The two best are kept because a business never matches itself: if the best owner is the
    asking business, the second one answers. ``has_owner`` says whether the owner still exists.
    """
    prints = fingerprints.filter(F.col("contacted_id").isNotNull()) if contacted_only else fingerprints
    people = contacted.select(
        F.col("id").alias("contacted_id"), F.col("name").alias("_cname"), F.concat_ws(
            ", ", F.nullif("status", F.lit("")), F.nullif("contacted_on", F.lit(""))).alias("_cdetail"), F.lit(True).alias("_c"),
    )
    stored = businesses.select(
        F.col("id").alias("business_id"), F.col("business_name").alias("_bname"), F.col("discarded_at").isNotNull().alias("_gone"), F.lit(True).alias("_b")
    )
    owned = lookup_known(lookup_known(prints, people, "contacted_id"), stored, "business_id")
    row = F.struct(
        F.col("contacted_id").isNull().alias("late"), "id", "contacted_id", "business_id",
        F.coalesce(F.when(F.col("contacted_id").isNotNull(), F.col("_c")).otherwise(F.col("_b")), F.lit(False)).alias("has_owner"),
        F.coalesce("_cname", "_bname").alias("owner_name"), F.col("_cdetail").alias("detail"), F.coalesce("_gone", F.lit(False)).alias("gone"),
    )
    # First by owner, then across owners: bounded state per group, no list of owners.
    per_owner = cut_lineage(owned.groupBy("kind", "value", "contacted_id", "business_id").agg(F.min(row).alias("row")))
    best = per_owner.groupBy("kind", "value").agg(F.min("row").alias("first"))
    rest = per_owner.join(best, ["kind", "value"]).filter(~F.col("row").eqNullSafe(F.col("first")))
    second = rest.groupBy("kind", "value").agg(F.min("row").alias("second"))
    return best.join(second, ["kind", "value"], "left")


def match_prints(prints: DataFrame, owners: DataFrame, owner: str = "id", own_business: str | None = "id") -> DataFrame:
    """The matching stored owner of each print (own prints excluded), as ``match``."""
    joined = hot_safe_lookup(cut_lineage(prints), owners, ["kind", "value"], "inner")
    if own_business is None:
        return joined.withColumn("match", F.col("first"))
    is_self = F.coalesce(F.col("first.business_id") == F.col(own_business), F.lit(False))
    return joined.withColumn("match", F.when(is_self, F.col("second")).otherwise(F.col("first"))).filter(F.col("match").isNotNull())


def shared_thing(kind: Column, value: Column) -> Column:
    return (
        F.when(kind == fv.PRINT_NUMBER, F.concat(F.lit("el mismo número ("), pretty_number(value), F.lit(")")))
        .when(kind == fv.PRINT_WEB, F.concat(F.lit("la misma web ("), value, F.lit(")")))
        .otherwise(F.concat(F.lit("la misma red social ("), value, F.lit(")")))
    )


def duplicate_reason(kind: Column, value: Column, match: Column) -> Column:
    """Why a business is a repeat, in words."""
    detail = F.when(F.coalesce(match["detail"], F.lit("")) != "", F.concat(F.lit(" ("), match["detail"], F.lit(")"))).otherwise("")
    head = F.concat(F.lit("Tiene "), shared_thing(kind, value), F.lit(" que «"), match["owner_name"], F.lit("»"))
    state = F.when(match["gone"], " (lo descartaste)").otherwise(", que ya apareció en tus leads")
    return F.when(match["contacted_id"].isNotNull(), F.concat(head, F.lit(", a quien ya contactaste"), detail, F.lit("."))).otherwise(
        F.concat(head, state, F.lit("."))
    )


def find_duplicates(prints: DataFrame, owners: DataFrame, owner: str = "id", own_business: str | None = "id") -> DataFrame:
    """Per asking business, its first print (in print order) that matches an existing owner."""
    matched = match_prints(prints, owners, owner, own_business).filter(F.col("match.has_owner"))
    first = matched.groupBy(owner).agg(F.min(F.struct("print_order", "kind", "value", "match")).alias("hit"))
    return first.select(
        owner, F.col("hit.kind").alias("kind"), F.col("hit.value").alias("value"),
        F.col("hit.match.business_id").alias("duplicate_of_id"), F.col("hit.match.contacted_id").alias("contacted_id"),
        duplicate_reason(F.col("hit.kind"), F.col("hit.value"), F.col("hit.match")).alias("duplicate_reason"),
    )


def flag_contacted(businesses: DataFrame, fingerprints: DataFrame, contacted: DataFrame) -> DataFrame:
    """Stored businesses whose number matches a contacted person, with the reason."""
    open_ones = businesses.filter((F.coalesce("duplicate_reason", F.lit("")) == "") & F.col("discarded_at").isNull())
    numbers = business_prints(open_ones).filter(F.col("kind") == fv.PRINT_NUMBER)
    return find_duplicates(numbers, owner_of_prints(fingerprints, contacted, businesses, contacted_only=True))


def missing_prints(businesses: DataFrame, fingerprints: DataFrame, prospected: Column) -> DataFrame:
    """Prints of prospected businesses that have none stored yet."""
    done = fingerprints.filter(F.col("business_id").isNotNull()).select(F.col("business_id").alias("id"))
    return business_prints(businesses.filter(prospected).join(done, "id", "left_anti"))


# ------------------------------------------------------------------ D4
# ``listings``: listing_id, run_id, position, rank (global order of run and position), target,
#   static outcome flags: known_stored, card_has_site, card_stored, readable, place_stored,
#   site_open (its status when it is not: site_gone), is_lead, post_stored.
# ``checks``: listing_id, stage ('card' | 'place' | 'post'), kind, value, print_order.
# ``keys``: listing_id, value: identifiers of the place (place id, canonical URL).

def _registrations(listings: DataFrame, checks: DataFrame, keys: DataFrame) -> DataFrame:
    """What a listing leaves behind: place keys once opened, post-verification prints once accepted."""
    own = listings.select("listing_id", "rank", "run_id")
    placed = keys.join(own, "listing_id").select("listing_id", "rank", F.lit("key").alias("kind"), "value", F.lit("opened").alias("needs"))
    left = checks.filter(F.col("stage") == "post").join(own, "listing_id").select(
        "listing_id", "rank", "kind", "value", F.lit("accepted").alias("needs")
    )
    return placed.unionByName(left)


def _in_limit(max_listings: int | None) -> Column:
    return F.lit(True) if max_listings is None else F.coalesce(F.col("position") <= max_listings, F.lit(False))


def decide_listings(listings: DataFrame, checks: DataFrame, keys: DataFrame, max_listings: int | None = None) -> DataFrame:
    """Opened and accepted listings of all runs: ``listing_id, run_id, rank, opened, accepted``.

    ``max_listings`` leaves out listings at later positions of a run; by default all take part.
    """
    may_open = ~F.col("known_stored") & F.col("card_has_site") & ~F.col("card_stored") & F.col("readable")
    may_accept = may_open & ~F.col("place_stored") & F.col("site_open") & F.col("is_lead") & ~F.col("post_stored")
    open_state = listings.filter(_in_limit(max_listings)).select(
        "listing_id", "run_id", "rank", "target", may_open.alias("_open"), may_accept.alias("_accept"),
        F.lit(0).cast("long").alias("before"), F.lit(False).alias("hit_key"), F.lit(False).alias("hit_card"), F.lit(False).alias("hit_any"),
    ).filter("_open").withColumn("opened", F.lit(None).cast("boolean")).withColumn(
        "accepted", F.when(~F.col("_accept"), F.lit(False))
    ).drop("_open", "_accept")
    state = cut_lineage(open_state)
    # Only listings that can be opened take part. Evaluation is semi-naive: hits stay on the listing, so a round reads
    # what open listings ask and leave behind and what was registered in the round before, nothing older.
    asks = keys.select("listing_id", F.lit("key").alias("stage"), F.lit("key").alias("kind"), "value").unionByName(
        checks.select("listing_id", "stage", "kind", "value")
    ).distinct().join(state.select("listing_id", "rank"), "listing_id")
    asks = cut_lineage(asks)
    leaves = cut_lineage(_registrations(state, checks, keys).distinct())
    settled: list[DataFrame] = []
    newly: DataFrame | None = None
    left = kept = state.count()
    while left:
        active = state.select("listing_id", "rank", "run_id", "opened", "accepted")
        pool = active if newly is None else active.unionByName(newly.select(*active.columns))
        registered = leaves.join(pool.select("listing_id", "opened", "accepted"), "listing_id").select(
            "kind", "value", "rank", F.when(F.col("needs") == "opened", F.col("opened")).otherwise(F.col("accepted")).alias("state")
        ).filter(F.col("state").isNull() | F.col("state"))
        per_print = registered.groupBy("kind", "value").agg(
            F.min(F.when(F.col("state"), F.col("rank"))).alias("lo"), F.min(F.when(F.col("state").isNull(), F.col("rank"))).alias("maybe")
        )
        met = hot_safe_lookup(asks, per_print, ["kind", "value"], "inner")
        definite, possible = F.coalesce(F.col("lo") < F.col("rank"), F.lit(False)), F.coalesce(F.col("maybe") < F.col("rank"), F.lit(False))

        def any_at(test: Column, *stages: str) -> Column:
            return F.bool_or(test & F.col("stage").isin(*stages))

        met = met.groupBy("listing_id").agg(
            any_at(definite, "key").alias("d_key"), any_at(definite, "card").alias("d_card"), any_at(definite, "card", "place", "post").alias("d_any"),
            any_at(possible, "key").alias("p_key"), any_at(possible, "card").alias("p_card"), any_at(possible, "card", "place", "post").alias("p_any"),
        )
        in_run = W.partitionBy("run_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        counted = pool.join(state.select("listing_id", "target", "before", "hit_key", "hit_card", "hit_any"), "listing_id", "left").withColumns({
            "more": F.coalesce(F.count_if(F.col("accepted")).over(in_run), F.lit(0)) if newly is not None else F.lit(0).cast("long"),
            "open_before": F.count_if(F.col("accepted").isNull()).over(in_run),
        }).filter(F.col("target").isNotNull())
        if newly is not None:
            # Already-settled rows of earlier rounds are in ``before``; the window adds the newly accepted ones.
            counted = counted.withColumn("before", F.col("before") + F.col("more"))
        step = counted.join(met, "listing_id", "left")

        def seen(name: str) -> Column:
            return F.coalesce(F.col(name), F.lit(False))

        hit_key, hit_card, hit_any = (F.col("hit_" + n) | seen("d_" + n) for n in ("key", "card", "any"))
        cut = F.col("before") >= F.col("target")
        surely_in = (F.col("before") + F.col("open_before")) < F.col("target")
        closed = cut | hit_key | hit_card
        opened = F.when(F.col("opened").isNotNull(), F.col("opened")).when(closed, False).when(
            surely_in & ~seen("p_key") & ~seen("p_card"), True
        )
        accepted = F.when(F.col("accepted").isNotNull(), F.col("accepted")).when(closed | hit_any, False).when(
            surely_in & ~seen("p_key") & ~seen("p_any"), True
        )
        decided = step.select(
            "listing_id", "run_id", "rank", "target", "before", hit_key.alias("hit_key"), hit_card.alias("hit_card"), hit_any.alias("hit_any"),
            opened.alias("opened"), accepted.alias("accepted"),
            F.coalesce(opened & F.col("opened").isNull(), F.lit(False)).alias("new_open"),
            F.coalesce(accepted & F.col("accepted").isNull(), F.lit(False)).alias("new_accept"),
        )
        decided = cut_lineage(decided)
        done = F.col("opened").isNotNull() & F.col("accepted").isNotNull()
        settled.append(decided.filter(done).select("listing_id", "run_id", "rank", "opened", "accepted"))
        # A listing half decided stays; what it newly leaves behind still counts for the others.
        newly = decided.filter(done & (F.col("opened") | F.col("accepted"))).select("listing_id", "rank", "run_id", "opened", "accepted")
        state = decided.filter(~done).drop("new_open", "new_accept")
        left = state.count()
        if left * 2 <= kept:  # written anew only when half is gone, so all rewriting together is at most as much as there was
            kept, alive = left, state.select("listing_id")
            asks = cut_lineage(asks.join(alive, "listing_id", "left_semi"))
            leaves = cut_lineage(leaves.join(alive.unionByName(newly.select("listing_id")), "listing_id", "left_semi"))
    if not settled:
        return state.select("listing_id", "run_id", "rank", "opened", "accepted")
    out = settled[0]
    for part in settled[1:]:
        out = out.unionByName(part)
    return out


def suppress_repeats(
    listings: DataFrame, checks: DataFrame, keys: DataFrame, max_listings: int | None = None
) -> DataFrame:
    """The outcome of every listing, with the accepted listing and print that made it a repeat.

    Outcomes, in the order they are tested: ``untouched`` (after the target or the limit),
    ``skipped``, ``no_website``, ``duplicate``, ``unreadable``, ``duplicate``, ``no_website``,
    ``not_lead``, ``duplicate``, ``lead``. ``stage`` tells the three duplicate tests apart.
    """
    # Inputs are read many times over the rounds: materialise them once.
    listings, checks, keys = cut_lineage(listings), cut_lineage(checks), cut_lineage(keys)
    verdicts = decide_listings(listings, checks, keys, max_listings)
    verdicts = cut_lineage(verdicts)
    leaves = _registrations(listings, checks, keys).join(verdicts.select("listing_id", "opened", "accepted"), "listing_id").filter(
        F.when(F.col("needs") == "opened", F.col("opened")).otherwise(F.col("accepted"))
    )
    first = leaves.groupBy("kind", "value").agg(F.min(F.struct("rank", "listing_id")).alias("by"))
    key_type = checks.schema["print_order"].dataType
    asks = keys.select("listing_id", F.lit("key").alias("stage"), F.lit("key").alias("kind"), "value", F.lit(None).cast(key_type).alias("print_order"))
    asks = asks.unionByName(checks.select("listing_id", "stage", "kind", "value", "print_order")).join(listings.select("listing_id", "rank"), "listing_id")
    met = hot_safe_lookup(asks, first, ["kind", "value"], "inner").filter(F.col("by.rank") < F.col("rank"))

    def at(stage: str) -> Column:
        return F.min(F.when(F.col("stage") == stage, F.struct("print_order", "kind", "value", F.col("by.listing_id").alias("listing_id")))).alias("_" + stage)

    hits = met.groupBy("listing_id").agg(at("key"), at("card"), at("place"), at("post"))
    accepted = verdicts.filter("accepted").select("listing_id", F.lit(1).alias("_accepted"))
    in_limit = listings.filter(_in_limit(max_listings))
    in_run = W.partitionBy("run_id").orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
    counted = in_limit.join(accepted, "listing_id", "left").withColumn(
        "_before", F.coalesce(F.sum(F.coalesce("_accepted", F.lit(0))).over(in_run), F.lit(0))
    )
    beyond = listings.filter(~_in_limit(max_listings)).withColumns({"_accepted": F.lit(None).cast("int"), "_before": F.lit(2**40)})
    full = counted.unionByName(beyond).join(hits, "listing_id", "left")

    def dup(stage: str) -> Column:
        return F.col(stage + "_stored") | F.col("_" + stage).isNotNull()

    # One ordered choice; the part after the colon tells at which stage it was made.
    verdict = (
        F.when(F.col("_before") >= F.col("target"), "untouched")
        .when(F.col("known_stored") | F.col("_key").isNotNull(), "skipped")
        .when(~F.col("card_has_site"), "no_website:card")
        .when(dup("card"), "duplicate:card")
        .when(~F.col("readable"), "unreadable")
        .when(dup("place"), "duplicate:place")
        .when(~F.col("site_open"), "no_website:place")
        .when(~F.col("is_lead"), "not_lead")
        .when(dup("post"), "duplicate:post")
        .otherwise("lead")
    )
    full = full.withColumn("_v", verdict)
    outcome = F.substring_index("_v", ":", 1)
    stage = F.when(F.col("_v").contains(":"), F.substring_index("_v", ":", -1))
    by = F.when(outcome == "duplicate", F.when(stage == "card", F.col("_card")).when(stage == "place", F.col("_place")).otherwise(F.col("_post")))
    return full.select(
        "listing_id", "run_id", "position", "rank", outcome.alias("outcome"), stage.alias("stage"),
        by["kind"].alias("shared_kind"), by["value"].alias("shared_value"), by["listing_id"].alias("repeat_of"),
    )


def run_counters(outcomes: DataFrame) -> DataFrame:
    """A3: outcome counts per run."""
    def n(*names: str) -> Column:
        return F.count_if(F.col("outcome").isin(*names))

    opened = n("lead", "not_lead", "unreadable") + F.count_if(F.col("outcome").isin("duplicate", "no_website") & F.col("stage").isin("place", "post"))
    return outcomes.groupBy("run_id").agg(
        n("lead").alias("leads"), opened.alias("reviewed"), n("skipped").alias("skipped"), n("duplicate").alias("duplicates"),
        n("no_website").alias("no_website"), n("untouched").alias("untouched"),
    )


__all__ = ["decide_listings", "duplicate_reason", "find_duplicates", "flag_contacted", "match_prints", "missing_prints",
           "owner_of_prints", "print_rank", "run_counters", "suppress_repeats"]
