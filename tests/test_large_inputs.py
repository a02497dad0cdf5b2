"""Work per row is dealt out and done once, whatever the files look like."""

import inspect

import pytest

from leadweave.operators import contact_links as cl
from leadweave.operators.page_elements import page_nodes, parse_pages
from leadweave.plans import fusion_queries, page_queries
from leadweave.plans.inputs import Inputs


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    """A hundred customers and forty pages, each table in one small file."""
    folder = str(tmp_path_factory.mktemp("one_file"))
    spark.range(100).coalesce(1).selectExpr("id AS c_custkey").write.parquet(f"{folder}/customer.parquet")
    spark.sql("SELECT id AS n_nationkey, 'CHILE' AS n_name FROM range(25)").coalesce(1).write.parquet(f"{folder}/nation.parquet")
    spark.range(40).coalesce(1).selectExpr("id AS page_id", "'https://n' || id || '.cl/' AS url", "'<html><head></head><body>x</body></html>' AS html").write.parquet(f"{folder}/pages.parquet")
    return Inputs(spark, folder)


def test_captured_pages_use_all_slots(spark, inputs):
    businesses, _, pages = fusion_queries._to_verify(inputs)
    slots = spark.sparkContext.defaultParallelism
    assert businesses.rdd.getNumPartitions() == slots
    assert len(pages.inputFiles()) == slots  # one for each task that parsed


def test_short_links_are_found_once(monkeypatch, inputs):
    used = []
    candidates = cl.shortlink_candidates
    monkeypatch.setattr(cl, "shortlink_candidates", lambda short, resolved: used.append(short) or candidates(short, resolved))
    assert page_queries._redirects(inputs).rdd.getNumPartitions() == inputs.spark.sparkContext.defaultParallelism
    got = {r["page_id"]: (r["outcome"], r["number"]) for r in page_queries._resolved(inputs).collect()}
    assert got == {0: ("candidate", "56930000000"), 17: ("candidate", "56930000016"), 34: ("candidate", "56930000032")}
    assert not any("pages.parquet" in f for f in used[0].inputFiles())  # its pages are not parsed again


def test_pages_are_parsed_in_small_pieces():
    assert inspect.signature(parse_pages).parameters["batch_bytes"].default <= 1 << 19
    attrs = [n[3] for n in page_nodes("<p>a<b x=1>c</b>d</p><title>t</title>") if n[2] == "#text"]
    assert len(attrs) == 4 and len({id(a) for a in attrs}) == 1
