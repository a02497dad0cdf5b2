"""The lead mart: predicates, lead rows, named filters and sorts, day lists and counters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from leadweave import fixed_values as fv
from leadweave.functions import text as tx
from leadweave.functions.expr import ColumnLike, as_col, blank_to_null, exact_lookup, is_true
from leadweave.functions.phones import e164_digits, is_probable_mobile, pretty_number
from leadweave.functions.scoring import opportunity_level
from leadweave.functions.urls import shown_link_digits
from leadweave.operators.findings import status_findings


# ------------------------------------------------------------------ P1-P3, P15-P18
def has_text(column: ColumnLike) -> Column:
    return F.coalesce(as_col(column), F.lit("")) != ""


def is_contactable() -> Column:
    return (F.col("whatsapp_status") == fv.CONTACT_VERIFIED) | is_probable_mobile("phone_e164")


def is_lead() -> Column:
    """Site open, contactable, neither discarded nor a duplicate. Never NULL."""
    return (
        F.col("discarded_at").isNull() & ~has_text("duplicate_reason")
        & is_true(F.col("website_status") == fv.SITE_OK) & is_true(is_contactable())
    )


def already_prospected() -> Column:
    """Its fingerprints must not come back (leads and discarded ones, not duplicates)."""
    live = is_true(F.col("website_status") == fv.SITE_OK) & is_true(is_contactable())
    return ~has_text("duplicate_reason") & (F.col("discarded_at").isNotNull() | live)


def card_may_have_site(kind: ColumnLike = "card_kind") -> Column:
    """An unread card passes; a read one needs a site of its own or a link page (``kind`` from F3)."""
    return ~F.col("card_seen") | (has_text("website") & as_col(kind).isin(fv.KIND_OWN, fv.KIND_AGGREGATOR))


def is_duplicate() -> Column:
    return has_text("duplicate_reason")


# ------------------------------------------------------------------ W1, W2, W8, J1-J3, J7
def latest_analysis(analyses: DataFrame, successful_only: bool = False) -> DataFrame:
    """Newest analysis of each business (then highest id)."""
    if successful_only:
        analyses = analyses.filter(F.col("error").isNull())
    rest = [c for c in analyses.columns if c not in ("business_id", "analyzed_at", "id")]
    # Ordering columns lead; maps cannot be compared, so the row is picked by max_by.
    newest = analyses.groupBy("business_id").agg(
        F.max_by(F.struct("analyzed_at", "id", *rest), F.struct("analyzed_at", "id")).alias("a")
    )
    return newest.select("business_id", "a.*")


def first_found(search_results: DataFrame) -> DataFrame:
    """The first search and position that found each business."""
    first = search_results.groupBy("business_id").agg(F.min(F.struct("search_id", "position")).alias("f"))
    return first.select("business_id", "f.search_id", "f.position")


def businesses_of_searches(businesses: DataFrame, search_results: DataFrame, searches: DataFrame) -> DataFrame:
    """Search id, position and business of the given searches."""
    wanted = searches.select(F.col("id").alias("search_id"))
    found = search_results.join(wanted, "search_id", "left_semi")
    return found.join(businesses, found["business_id"] == businesses["id"]).drop("business_id")


def first_search(search_results: DataFrame, searches: DataFrame) -> DataFrame:
    """Query and position of the earliest search that found each business."""
    joined = search_results.join(
        searches.select(F.col("id").alias("search_id"), "query", "created_at"), "search_id"
    )
    first = joined.groupBy("business_id").agg(F.min(F.struct("created_at", "search_id", "query", "position")).alias("f"))
    return first.select("business_id", F.col("f.query").alias("query"), F.col("f.position").alias("position"))


def analysis_history(analyses: DataFrame) -> DataFrame:
    """Analyses newest first within each business, with their number of findings."""
    order = W.partitionBy("business_id").orderBy(F.desc("analyzed_at"), F.desc("id"))
    return analyses.select(
        "business_id", "id", "analyzed_at", F.col("website_score").alias("score"), F.size("findings").alias("findings"),
        "model_name", "error", F.row_number().over(order).alias("position"),
    )


def newest_searches(searches: DataFrame, limit: int) -> DataFrame:
    """Bounded by the limit the page asks for (TakeOrdered, no full sort)."""
    return searches.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


# ------------------------------------------------------------------ P12, P14
def searches_of_day(searches: DataFrame, day: str, tz: str) -> DataFrame:
    """Searches created in the half-open local day; plain comparisons, so they reach the scan."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), tz)
    end = F.to_utc_timestamp(F.lit(day).cast("timestamp") + F.expr("INTERVAL 1 DAY"), tz)
    return searches.filter((F.col("created_at") >= start) & (F.col("created_at") < end))


def needs_analysis(businesses: DataFrame, analyses: DataFrame, now: Column, max_age_days: int = fv.FRESH_DAYS) -> DataFrame:
    """Businesses without an error-free analysis younger than the limit."""
    fresh = analyses.filter(F.col("error").isNull()).groupBy(F.col("business_id").alias("id")).agg(F.max("analyzed_at").alias("_at"))
    fresh = fresh.filter(F.col("_at") > now - F.make_dt_interval(F.lit(max_age_days)))
    return businesses.join(fresh, "id", "left_anti")


def pending_reviews(businesses: DataFrame, analyses: DataFrame, now: Column, max_age_days: int = fv.FRESH_DAYS) -> DataFrame:
    """Leads with an open site whose analysis is missing or stale."""
    return needs_analysis(businesses.filter(has_text("website") & is_lead()), analyses, now, max_age_days)


# ------------------------------------------------------------------ P19, P20: lead rows
def contact_state() -> Column:
    return (
        F.when((F.col("whatsapp_status") == fv.CONTACT_VERIFIED) & is_true(F.col("whatsapp_check") == fv.CHECK_EXISTS), "confirmado")
        .when(F.col("whatsapp_status") == fv.CONTACT_VERIFIED, "verificado")
        .when(is_probable_mobile("phone_e164"), "por_probar")
        .otherwise("sin_whatsapp")
    )


def contact_url() -> Column:
    """The verified link, or a trial link built for display only."""
    return F.when(F.col("whatsapp_status") == fv.CONTACT_VERIFIED, F.col("whatsapp_url")).when(
        is_probable_mobile("phone_e164"), F.concat(F.lit("https://wa.me/"), e164_digits("phone_e164"))
    )


def lead_rows(found: DataFrame, analyses: DataFrame) -> DataFrame:
    """The mart row of each found business: ``found`` has business columns plus query and position.

    ``analyses`` is the latest analysis per business. One projection over one left join.
    """
    latest = analyses.select(
        F.col("business_id").alias("id"), F.lit(True).alias("_analyzed"),
        F.col("findings").alias("_findings"), F.col("website_score").alias("_score"), F.col("opportunity_level").alias("_level"),
        F.col("screenshots").alias("_shots"), F.col("error").alias("_error"), F.col("main_problems").alias("_problems"),
        F.col("opportunities").alias("_opportunities"), F.col("strengths").alias("_strengths"),
    )
    joined = found.join(latest, "id", "left").withColumn("_url", contact_url())
    analyzed = F.coalesce("_analyzed", F.lit(False))
    own_site = has_text("website") & F.coalesce(F.col("website_status") == fv.SITE_OK, F.lit(True))
    sources = F.col("field_sources")
    reason = blank_to_null(F.regexp_replace(F.coalesce(sources["website_status"], F.lit("")), "^web: ", ""))
    no_text = F.array().cast("array<string>")
    return joined.select(
        "id", F.col("business_name").alias("name"), "category", "city", "address", "query", "position",
        contact_state().alias("whatsapp_state"),
        F.col("_url").alias("whatsapp_url"),
        pretty_number(shown_link_digits("_url")).alias("whatsapp_number"),
        F.col("whatsapp_confidence").alias("confidence"),
        sources["whatsapp_confidence"].alias("confidence_reason"),
        F.col("whatsapp_broken_button").alias("broken_button"),
        "whatsapp_check", F.col("phone_raw").alias("phone"), "website",
        F.coalesce("website_status", F.lit(fv.TO_VERIFY)).alias("website_status"),
        F.when(~is_true(F.col("website_status") == fv.SITE_OK), reason).alias("website_reason"),
        "rating", F.col("review_count").alias("reviews"), F.col("google_maps_url").alias("maps_url"), "instagram", "facebook",
        F.col("discarded_at").isNotNull().alias("discarded"),
        F.when(analyzed, F.col("_findings")).otherwise(status_findings()).alias("findings"),
        F.col("_score").alias("score"),
        F.when(~own_site, opportunity_level(F.lit(None).cast("int"), F.lit(False), "rating", "review_count"))
        .otherwise(F.col("_level")).alias("opportunity"),
        F.coalesce("_shots", F.create_map().cast("map<string,string>")).alias("screenshots"),
        (~analyzed & is_true(F.col("website_status") == fv.SITE_OK)).alias("review_pending"),
        F.col("_error").alias("review_error"),
        F.coalesce("_problems", no_text).alias("problems"),
        F.coalesce("_opportunities", no_text).alias("opportunities"),
        F.coalesce("_strengths", no_text).alias("strengths"),
    )


def leads_of_day(
    searches: DataFrame, search_results: DataFrame, businesses: DataFrame, analyses: DataFrame,
    day: str | None, tz: str = "UTC", include_discarded: bool = False,
) -> DataFrame:
    """The lead list of a local day (every day with ``None``): each business once, where first found."""
    wanted = searches if day is None else searches_of_day(searches, day, tz)
    found = search_results.join(wanted.select(F.col("id").alias("search_id")), "search_id", "left_semi")
    first = first_found(found).withColumnRenamed("business_id", "id")
    keep = is_lead() | (F.col("discarded_at").isNotNull() if include_discarded else F.lit(False))
    leads = businesses.filter(keep).join(first, "id")
    leads = leads.join(wanted.select(F.col("id").alias("search_id"), "query"), "search_id")
    chosen = analyses.join(leads.select(F.col("id").alias("business_id")), "business_id", "left_semi")
    return lead_rows(leads, latest_analysis(chosen))


def duplicates_of_searches(searches: DataFrame, search_results: DataFrame, businesses: DataFrame) -> DataFrame:
    """Businesses hidden as duplicates, once each, with their reason."""
    found = search_results.join(searches.select(F.col("id").alias("search_id"), "query"), "search_id")
    first = found.groupBy(F.col("business_id").alias("id")).agg(F.min(F.struct("search_id", "position", "query")).alias("f"))
    hidden = businesses.filter(is_duplicate()).join(first, "id")
    return hidden.select(
        "id", F.col("business_name").alias("name"), F.col("duplicate_reason").alias("reason"),
        F.col("google_maps_url").alias("maps_url"), F.col("f.query").alias("query"),
    )


# ------------------------------------------------------------------ P4-P11, E1: named filters
def serious_findings(findings: ColumnLike = "findings") -> Column:
    return F.size(F.filter(as_col(findings), lambda f: f["severity"] == "alta"))


def has_contact() -> Column:
    return F.col("whatsapp_state").isin("verificado", "confirmado")


def bad_site() -> Column:
    return (F.col("website_status") == fv.SITE_OK) & F.when(
        F.col("score").isNotNull(), F.col("score") < fv.HIGH_SCORE_BELOW
    ).otherwise(serious_findings() > 0)


FILTERS: dict[str, Callable[[], Column]] = {
    "whatsapp": has_contact,
    "probar": lambda: F.col("whatsapp_state") == "por_probar",
    "web_mala": bad_site,
    "rating": lambda: F.coalesce("rating", F.lit(0.0)) > 4.5,
    "resenas": lambda: F.coalesce("reviews", F.lit(0)) > 100,
    "whatsapp_web_mala": lambda: has_contact() & bad_site(),
    "oportunidad": lambda: is_true(F.col("opportunity") == "ALTA"),
}


def filter_condition(filters: Iterable[str] = (), query: str | None = None) -> Column:
    """All chosen filters at once; unknown names are ignored."""
    tests = [is_true(FILTERS[name]()) for name in filters if name in FILTERS]
    if query:
        tests.append(F.col("query") == query)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def filter_leads(leads: DataFrame, filters: Iterable[str] = (), query: str | None = None) -> DataFrame:
    return leads.filter(filter_condition(filters, query))


# ------------------------------------------------------------------ W10-W12, E2: named sorts
def contact_rank() -> Column:
    rank = exact_lookup(F.col("whatsapp_state"), fv.CONTACT_STATE_RANK)
    weaker = (F.col("whatsapp_state") == "verificado") & ~is_true(F.col("confidence") == "ALTA")
    return F.when(weaker, 2).otherwise(rank)


def opportunity_rank() -> Column:
    return F.coalesce(exact_lookup(F.col("opportunity"), fv.OPPORTUNITY_RANK), F.lit(fv.OPPORTUNITY_RANK_NONE))


def _reviews() -> Column:
    return F.desc_nulls_last(F.coalesce("reviews", F.lit(0)))


SORTS: dict[str, Callable[[], list[Column]]] = {
    "whatsapp": lambda: [contact_rank(), _reviews()],
    "oportunidad": lambda: [
        opportunity_rank(), F.desc(serious_findings()), F.desc(F.size("findings")), contact_rank(), _reviews(),
    ],
    "resenas": lambda: [_reviews(), contact_rank()],
    "rating": lambda: [F.desc(F.coalesce("rating", F.lit(0.0))), _reviews()],
    "nombre": lambda: [F.lower("name")],
}


def sort_keys(order: str, ties: Iterable[str] = ("position", "id")) -> list[Column]:
    """Sort columns of a named order; unknown names mean the contact order. ``ties`` keep found order."""
    return SORTS.get(order, SORTS["whatsapp"])() + [F.col(t) for t in ties]


def sort_leads(leads: DataFrame, order: str = "whatsapp", ties: Iterable[str] = ("position", "id")) -> DataFrame:
    return leads.orderBy(*sort_keys(order, ties))


# ------------------------------------------------------------------ A1, A2, A4, A5, A20
def listing_counters(found: DataFrame) -> DataFrame:
    """A1: per search, businesses, sites still to verify and verified contacts."""
    return found.groupBy("search_id").agg(
        F.count("*").alias("businesses_found"),
        F.count_if(has_text("website") & F.col("website_status").isNull()).alias("websites_found"),
        F.count_if(F.col("whatsapp_status") == fv.CONTACT_VERIFIED).alias("whatsapp_verified"),
    )


def verification_counters(found: DataFrame) -> DataFrame:
    """A2: per search, open sites and verified contacts after verification (and both at once, A20)."""
    open_site = is_true(F.col("website_status") == fv.SITE_OK)
    verified = F.col("whatsapp_status") == fv.CONTACT_VERIFIED
    return found.groupBy("search_id").agg(
        F.count_if(open_site).alias("websites_found"), F.count_if(verified).alias("whatsapp_verified"),
        F.count_if(open_site & verified).alias("with_both"), F.count("*").alias("businesses"),
    )


def day_rollup(
    searches: DataFrame, search_results: DataFrame, businesses: DataFrame, tz: str,
    recent: int | None = None, days: int | None = None,
) -> DataFrame:
    """Per local day, distinct current leads and the distinct queries in first-seen order.

    Leads are counted per (day, business) first, so no distinct set is held for a busy day. All
    searches and days count; ``recent`` (newest searches considered) and ``days`` (days shown) limit a report.
    """
    considered = newest_searches(searches, recent) if recent else searches
    dated = considered.select(F.col("id").alias("search_id"), "query", "created_at", tx.local_day("created_at", tz).alias("day"))
    firsts = dated.groupBy("day", "query").agg(F.min(F.struct("created_at", F.negative("search_id").alias("late"))).alias("seen"))
    queries = firsts.groupBy("day").agg(F.array_sort(F.collect_list(F.struct("seen", "query"))).alias("_q"))
    leads = businesses.filter(is_lead()).select(F.col("id").alias("business_id"))
    pairs = search_results.join(dated.select("search_id", "day"), "search_id").join(leads, "business_id", "left_semi")
    counts = pairs.select("day", "business_id").distinct().groupBy("day").agg(F.count("*").alias("leads"))
    rolled = queries.join(counts, "day", "left").select(
        "day", F.coalesce("leads", F.lit(0)).alias("leads"), F.transform("_q", lambda q: q["query"]).alias("queries")
    )
    return rolled.orderBy(F.desc("day")).limit(days) if days else rolled


def list_summary(leads: DataFrame, filters: Iterable[str] = (), query: str | None = None) -> DataFrame:
    """A5: totals of the whole list and of its filtered part, in one pass."""
    shown = filter_condition(filters, query)
    return leads.agg(
        F.count("*").alias("total"),
        F.count_if("review_pending").alias("pending"),
        F.count_if(shown).alias("shown"),
        F.count_if(shown & has_contact()).alias("verified"),
        F.count_if(shown & (F.col("whatsapp_state") == "por_probar")).alias("to_test"),
        F.count_if(shown & is_true(F.col("opportunity") == "ALTA")).alias("high_opportunity"),
    )


def pending_ids(all_leads: DataFrame) -> DataFrame:
    return all_leads.filter("review_pending").select("id")
