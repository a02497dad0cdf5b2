"""Untidy rows: bad bytes, charsets, names across punctuation, links of other countries, empty keys."""

import pytest
from pyspark.sql import functions as F

from leadweave.functions import text as tx
from leadweave.operators import contact_links as cl
from leadweave.operators import identity, page_facts as pf
from leadweave.operators.page_elements import parse_pages
from leadweave.operators.site_status import decode_body, with_decoded_html


@pytest.mark.parametrize(("body", "charset", "text"), [
    (b"Hola\xc3", None, "Hola�"), (b"\x93Hola\x94", "windows-1252", "“Hola”"), (b"\xcf\xf0\xe8", "windows-1251", "При"), (b"\xc3\xa1", "no-such-charset", "á"),
    (b"<meta charset=iso-8859-1>\xe1", None, "<meta charset=iso-8859-1>á"), (b" " * 9000 + b"<meta charset='latin-1'>\xe1", "", " " * 9000 + "<meta charset='latin-1'>á"),
    (b"abc", "base64", "abc"), (b"", None, "")])
def test_decode_body(body, charset, text):
    assert decode_body(body, charset) == text


def test_decoded_html_in_small_batches(spark):
    rows = [(1, b"x" * 50, None, "text/html"), (2, None, None, "text/html"), (3, b"%PDF", None, "application/pdf"), (4, b"caf\xe9", "latin-1", "TEXT/HTML; charset=x")]
    got = with_decoded_html(spark.createDataFrame(rows, "id long, body binary, charset string, type string"), "body", "charset", "type", batch_bytes=10)
    assert {r["id"]: r["html"] for r in got.collect()} == {1: "x" * 50, 2: "", 3: "", 4: "café"}
    cut = with_decoded_html(spark.createDataFrame(rows, "id long, body binary, charset string, type string"), "body", "charset", "type", max_bytes=3)
    assert {r["html"] for r in cut.collect()} == {"xxx", "", "caf"}


def pages(spark, *bodies):
    return spark.createDataFrame([(k, "https://neg.cl/inicio", b, "CL") for k, b in enumerate(bodies)], "page_id long, url string, html string, region string")


def test_headings_and_menu_are_whole(spark):
    body = "<nav>" + "".join(f"<a href='/p{k}'>M{k}</a>" for k in range(60)) + "</nav>" + "".join(f"<h2>T{k}</h2>" for k in range(50))
    row = pf.with_structure_facts(parse_pages(pages(spark, body))).first()
    assert len(row["h2"]) == 50 and len(row["menu_items"]) == 60
    cut = pf.with_structure_facts(parse_pages(pages(spark, body)), max_h2=30, max_menu=40).first()
    assert len(cut["h2"]) == 30 and len(cut["menu_items"]) == 40


def test_links_inside_the_page_and_area_profiles(spark):
    body = "<a href='#servicios'>S</a><a href='/a'>A</a><map><area href='https://instagram.com/otro'></map><a href='https://instagram.com/mio'>I</a>"
    row = pf.link_facts(pf.page_links(parse_pages(pages(spark, body)), anchors=True)).first()
    assert set(row["internal_links"]) == {"https://neg.cl/inicio", "https://neg.cl/a"}
    assert [s["profile"].rstrip("/").lower() for s in row["socials"]] == ["https://www.instagram.com/mio"]
    assert not [h for h in row["hrefs"] if h and "#" in h]


def test_place_names_across_punctuation_and_long_names(spark):
    catalog = spark.createDataFrame([("Rancagua", "Rancagua", False), ("Machalí", "Machali", False), ("San Pedro de la Paz del Sur", "San Pedro de la Paz del Sur", False)], "name string, folded string, ambiguous boolean")
    lines = spark.createDataFrame([(1, ["Atendemos Rancagua-Machali.", "y San Pedro de la Paz del Sur"]), (2, ["nada"]), (3, ["Rancaguas"])], "page_id long, lines array<string>")
    assert {r["page_id"]: r["places"] for r in pf.place_mentions(lines, catalog).collect()} == {1: ["Rancagua", "Machalí", "San Pedro de la Paz del Sur"]}
    assert pf.place_mentions(lines, catalog.limit(0)).count() == 0


def test_short_link_host_and_foreign_number(spark):
    body = "<a href='https://walink.co/abc12'>Escribir</a><a href='https://wa.me/51987654321'>Perú</a><a href='https://wa.me/819012345678'>Japón</a><a href='https://wa.me/123'>mal</a>"
    found = cl.contact_mentions(parse_pages(cl.with_fallback_text(pages(spark, body)), keep=["page_id", "url", "region", "fallback_text"])).collect()
    assert any(r["outcome"] == "shortlink" and "walink.co/abc12" in r["url"] for r in found)
    broken = {r["evidence"]: r["ignored_broken"] for r in found if r["outcome"] == "ignored"}
    assert [v for e, v in broken.items() if "819012345678" in e] == [False]
    assert {(r["number"], r["broken"]) for r in found if r["outcome"] == "candidate"} == {("51987654321", False)}


def test_numeric_references(apply):
    assert apply(["&#109;ail &#x1F600; &#xe1; &amp; &#99999;", "plain", None], lambda d: tx.unescape_entities(F.col("a"))) == ["mail &#x1F600; á & &#99999;", "plain", None]


def test_short_links_of_any_length_and_loops(spark):
    chain = [(f"https://wa.link/c{k}", f"/c{k - 1}") for k in range(1, 13)] + [("https://wa.link/c0", "https://wa.me/56912345678"), ("https://wa.link/l1", "/l2"), ("https://wa.link/l2", "/l1")]
    table = spark.createDataFrame(chain, "url string, location string")
    got = {r["url"]: r["final_url"] for r in cl.resolve_short_links(table.select("url"), table).collect()}
    assert got["https://wa.link/c12"] == "https://wa.me/56912345678" and got["https://wa.link/l1"] is None
    assert {r["url"]: r["final_url"] for r in cl.resolve_short_links(table.select("url"), table, max_hops=5).collect()}["https://wa.link/c12"] is None


SNAPSHOT = "id long, place_id string, google_maps_url string, business_name string, first_seen_at timestamp, updated_at timestamp"


def test_first_load_is_all_inserts(spark):
    batch = spark.createDataFrame([(None if k % 2 else f"place_id:P{k}", f"https://www.google.com/maps/place/n{k}", f"N{k}") for k in range(200)], "place_id string, google_maps_url string, business_name string")
    empty = spark.createDataFrame([], SNAPSHOT)
    rows = identity.upsert_businesses(empty, batch, F.lit("2024-01-01").cast("timestamp")).collect()
    assert sorted(r["id"] for r in rows) == list(range(1, 201)) and all(r["created"] and r["touched"] for r in rows)


def test_missing_keys_match_nothing(spark):
    known = spark.createDataFrame([(1, "p1", "u1"), (2, None, "u2")], "id long, place_id string, google_maps_url string")
    asked = spark.createDataFrame([("p1", None, 0), (None, "u2", 1), (None, None, 2), (None, None, 3), ("p9", "u1", 4)], "place_id string, canonical_url string, n long")
    assert {r["n"]: r["business_id"] for r in identity.find_business(asked, known).collect()} == {0: 1, 1: 2, 2: None, 3: None, 4: 1}


def test_unmark_duplicates(spark):
    snapshot = spark.createDataFrame([(1, "misma web"), (2, "misma web"), (3, None)], "id long, duplicate_reason string")
    prints = spark.createDataFrame([(1, "a", False), (2, "b", False), (3, "c", False)], "business_id long, value string, registered boolean")
    plain, registry = identity.unmark_duplicates(snapshot, prints, spark.createDataFrame([(1,), (3,), (1,)], "id long"))
    assert {r["id"]: r["duplicate_reason"] for r in plain.collect()} == {1: None, 2: "misma web", 3: None}
    assert {r["value"]: r["registered"] for r in registry.collect()} == {"a": True, "b": False, "c": False}
