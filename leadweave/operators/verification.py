"""From captured pages to the verified site and the contact decision of every business.

A site is read in at most three steps, each a join of addresses to captured pages: the address the
business lists; the own site a link page leads to; the link pages that read sites lead to. Pages of
many sites (a shared link) are looked up with ``hot_safe_lookup``. What each page says about contacts
is extracted once per page, not once per site, and is joined to the sites that read it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadweave import fixed_values as fv
from leadweave.functions.urls import site_host, with_link_kind, with_normalized
from leadweave.operators import contact_links as cl
from leadweave.operators import fusion
from leadweave.operators.page_facts import page_links
from leadweave.operators.skew import hot_safe_lookup
from leadweave.session import cut_lineage

FRESH_SOURCES = ["web", "linktree"]
PAGE_COLUMNS = ["page_id", "read_content", "status", "reason", "final_url"]


def page_targets(pages: DataFrame) -> DataFrame:
    """Where each page leads: ``own_site``, ``link_pages`` in order, first profile of each network.

    ``pages(page_id, url, read_content, status, reason, final_url, elements)``; ``address`` is the
    normal form of ``url``. Of several captures of one address the one with the largest id counts.
    """
    links = page_links(pages.filter("read_content"))
    links = with_normalized(links, "link", "target_address")
    host = site_host("link")
    own = (F.col("kind") == fv.KIND_OWN) & (host != site_host("page_url")) & ~host.isin(fv.AGGREGATOR_HOSTS)
    at = lambda condition, column: F.min(F.when(condition, F.struct("position", column)))[column]
    found = links.groupBy("page_id").agg(
        at(own, "target_address").alias("own_site"),
        F.collect_list(F.when(F.col("kind") == fv.KIND_AGGREGATOR, F.struct("position", "target_address"))).alias("_pages"),
        *[at(F.col("social_network") == network, "social_profile").alias(network) for network in ("instagram", "facebook")])
    found = found.withColumn("link_pages", F.array_distinct(F.transform(F.array_sort("_pages"), lambda x: x["target_address"]))).drop("_pages")
    addressed = with_normalized(pages.select(*PAGE_COLUMNS, "url"), "url", "address").join(found, "page_id", "left")
    fields = [*PAGE_COLUMNS, "own_site", "link_pages", "instagram", "facebook"]
    return addressed.filter("address IS NOT NULL").groupBy("address").agg(F.max_by(F.struct(*fields), "page_id").alias("p")).select("address", "p.*")


def reading_plan(sites: DataFrame, targets: DataFrame, site: str = "site_id") -> DataFrame:
    """Every (site, address) to read, with its page where it is captured.

    ``step`` 0 is the listed address, 1 the own site behind a link page, 2 a link page that a read
    site leads to (``place`` is its order there). ``source`` tells what its contacts count as. Rows
    without ``page_id`` are still to be captured.
    """
    listed = with_normalized(with_link_kind(sites.select(site, "website"), "website", "kind"), "website", "address")
    listed = listed.filter(F.col("address").isNotNull() & F.col("kind").isin(fv.KIND_OWN, fv.KIND_AGGREGATOR))
    source = F.when(F.col("kind") == fv.KIND_AGGREGATOR, "linktree").otherwise("web")
    targets = cut_lineage(targets)

    def captured(rows: DataFrame) -> DataFrame:
        return cut_lineage(hot_safe_lookup(cut_lineage(rows), targets, ["address"]))

    first = captured(listed.select(site, "address", source.alias("source"), F.lit(0).alias("step"), F.lit(0).alias("place")))
    behind = first.filter("source = 'linktree' AND read_content AND own_site IS NOT NULL")
    second = captured(behind.select(site, F.col("own_site").alias("address"), F.lit("web").alias("source"), F.lit(1).alias("step"), F.lit(0).alias("place")))
    known = first.unionByName(second)
    leads = known.filter("source = 'web' AND read_content").select(site, F.posexplode("link_pages").alias("place", "address"))
    new = leads.groupBy(site, "address").agg(F.min("place").alias("place")).join(first.select(site, "address"), [site, "address"], "left_anti")
    third = captured(new.select(site, "address", F.lit("linktree").alias("source"), F.lit(2).alias("step"), "place"))
    return known.unionByName(third)


def site_results(plan: DataFrame, site: str = "site_id") -> DataFrame:
    """The verification of each site, as ``apply_site_status`` takes it. Sites whose listed address or own site isn't captured are left out."""
    at = lambda step, column: F.max(F.when(F.col("step") == step, F.col(column)))
    order = F.struct(F.col("source") != "web", "step", "place")
    per_site = plan.groupBy(site).agg(
        at(0, "source").alias("_source"), at(0, "address").alias("_listed"), at(0, "page_id").alias("_page"), at(0, "read_content").alias("_read"),
        *[at(step, column).alias(f"_{column}{step}") for step in (0, 1) for column in ("status", "reason", "final_url")],
        at(1, "address").alias("_own"), at(1, "page_id").alias("_own_page"),
        *[F.min(F.when(F.col(n).isNotNull() & F.col("read_content"), F.struct(order, n)))[n].alias(n) for n in ("instagram", "facebook")])
    per_site = per_site.filter(F.col("_page").isNotNull() & (F.col("_own").isNull() | F.col("_own_page").isNotNull()))
    on_link_page, has_own = F.col("_source") == "linktree", F.col("_own").isNotNull()
    down = on_link_page & ~F.coalesce("_read", F.lit(False))

    def result(column: str, closed: Column | str | None, alone: Column | str | None) -> Column:
        return F.when(has_own, F.col(f"_{column}1")).when(down, closed).when(on_link_page, alone).otherwise(F.col(f"_{column}0")).alias(column)

    return per_site.select(
        site, result("status", fv.SITE_DOWN, fv.SITE_ONLY_SOCIAL), result("reason", fv.REASON_LINK_PAGE_DOWN, fv.REASON_LINK_PAGE_ONLY),
        result("final_url", None, F.col("_final_url0")), has_own.alias("from_linktree"), F.when(on_link_page, F.col("_listed")).alias("linktree_url"), "instagram", "facebook")


def site_candidates(plan: DataFrame, mentions: DataFrame, site: str = "site_id") -> DataFrame:
    """Contact candidates of each site from all pages it reads, one for each source and number; ``mentions`` are those of the pages."""
    found = cl.page_candidates(mentions).drop("source")
    reads = plan.filter("read_content").select(site, "page_id", "source", "step", "place")
    at = F.array(*[F.col(c).cast("long") for c in ("step", "place")], *[F.col("arrival." + c).cast("long") for c in ("node", "sub", "stage", "variant", "at")])
    return cl.merge_candidates(found.join(reads, "page_id").withColumn("arrival", at).drop("page_id", "step", "place"), site)


class Verified(NamedTuple):
    businesses: DataFrame
    candidates: DataFrame
    to_capture: DataFrame


def verify_businesses(businesses: DataFrame, stored: DataFrame, pages: DataFrame, site: str = "site_id") -> Verified:
    """Verification followed by fusion.

    ``businesses`` has the site and decision columns, ``stored(site, source, number, url, placement,
    evidence, broken, arrival)`` the candidates known so far. Of verified businesses the candidates
    of web and link pages are replaced by the fresh ones and the contact is decided anew; all other
    businesses and candidates stay as they are. ``to_capture`` lists the addresses whose pages are missing.
    Null and foreign addresses are not read.
    """
    plan = cut_lineage(reading_plan(businesses, page_targets(pages), site))
    results = cut_lineage(site_results(plan, site))
    verified = results.select(site)
    mentions = cut_lineage(cl.contact_mentions(pages.filter("read_content")))
    fresh = site_candidates(plan.join(verified, site, "left_semi"), mentions, site)
    columns = [site, "source", "number", "url", "placement", "evidence", "broken"]
    kept = stored.select(*columns, F.array(F.lit(0).cast("long"), F.col("arrival").cast("long")).alias("arrival"))
    replaced = kept.join(verified.withColumn("source", F.explode(F.array(*map(F.lit, FRESH_SOURCES)))), [site, "source"], "left_anti").select(*columns, "arrival")
    new = fresh.select(*columns, F.concat(F.array(F.lit(1).cast("long")), "arrival").alias("arrival"))
    candidates = cut_lineage(replaced.unionByName(new))
    broken = mentions.filter("ignored_broken").select("page_id", "evidence").join(
        plan.filter("read_content").select(site, "page_id"), "page_id").select(site, "evidence")
    decided = fusion.decide_contacts(
        businesses.select(site, "phone_e164").join(verified, site, "left_semi"), candidates.join(verified, site, "left_semi"), broken, site)
    checked = fusion.apply_site_status(businesses, results, site)
    return Verified(
        fusion.write_decision(checked, decided, True, site), candidates,
        plan.filter("page_id IS NULL").select("address").distinct())
