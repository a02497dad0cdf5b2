"""Captured pages to verified sites and contact decisions."""

from leadweave.operators import verification
from leadweave.operators.page_elements import parse_pages

PAGES = "page_id long, url string, html string, read_content boolean, status string, reason string, final_url string"
STORED = "site_id long, source string, number string, url string, placement string, evidence string, broken boolean, arrival long"


def businesses(spark, sites):
    old = ["VIEJO", "u", "vieja", None, False, None, False]
    schema = ("site_id long, website string, website_status string, instagram string, facebook string, field_sources map<string,string>, phone_e164 string, whatsapp_status string, "
              "whatsapp_url string, whatsapp_source string, whatsapp_evidence string, whatsapp_multiple_numbers boolean, whatsapp_confidence string, whatsapp_broken_button boolean")
    return spark.createDataFrame([(site, url, "V", None, None, {}, None, *old) for site, url in sites], schema)


def page(page_id, url, body, fine=True):
    return page_id, url, f"<body>{body}</body>", fine, "OK" if fine else "CAIDO", None if fine else "fallo", url


def chat(number):
    return f'<a href="https://wa.me/{number}">x</a>'


def links(*urls):
    return "".join(f'<a href="{u}">x</a>' for u in urls)


def run(spark, sites, pages, stored=()):
    parsed = parse_pages(spark.createDataFrame(pages, PAGES))
    done = verification.verify_businesses(businesses(spark, sites), spark.createDataFrame(list(stored), STORED), parsed)
    return ({r["site_id"]: r for r in done.businesses.collect()}, sorted((r["site_id"], r["source"], r["number"]) for r in done.candidates.collect()),
            {r["address"] for r in done.to_capture.collect()})


def test_shared_pages_recaptures_and_missing_ones(spark):
    sites = [(1, "https://linktr.ee/a"), (2, "https://linktr.ee/a"), (3, "https://own.cl"), (4, None), (5, "https://new.cl/"), (6, "https://www.instagram.com/x"), (7, "mal")]
    pages = [
        page(1, "https://linktr.ee/a", chat("56911111111"), False),  # an older capture, closed
        page(2, "https://linktr.ee/a", chat("56922222222") + links("https://own.cl/", "https://linktr.ee/a", "https://www.instagram.com/neg/")),
        page(3, "https://own.cl/", chat("56933333333") + links("https://beacons.ai/b", "https://linktr.ee/a", "https://beacons.ai/gone")),
        page(4, "https://beacons.ai/b", chat("56944444444")), page(5, "https://other.cl/", chat("56955555555")),
    ]
    got, candidates, missing = run(spark, sites, pages, [(3, "web", "1", "u", "cuerpo", "e", False, 0), (3, "maps", "56933333333", "u", "cuerpo", "e", False, 1), (5, "web", "2", "u", "cuerpo", "e", False, 0)])
    assert candidates == sorted(
        [(s, "web", "56933333333") for s in (1, 2, 3)] + [(s, "linktree", n) for s in (1, 2, 3) for n in ("56922222222", "56944444444")] + [(3, "maps", "56933333333"), (5, "web", "2")])
    assert missing == {"https://new.cl/", "https://beacons.ai/gone"}
    assert [(got[s]["website"], got[s]["website_status"], got[s]["whatsapp_source"], got[s]["instagram"]) for s in (1, 3)] == [
        ("https://own.cl/", "OK", "web", "https://www.instagram.com/neg"), ("https://own.cl/", "OK", "maps", "https://www.instagram.com/neg")]
    assert got[3]["whatsapp_confidence"] == "ALTA" and got[1]["field_sources"]["website"].endswith("(https://linktr.ee/a)")
    assert all(got[s]["whatsapp_status"] == "VIEJO" and got[s]["website_status"] == "V" for s in (4, 5, 6, 7))


def test_broken_buttons_and_empty_tables(spark):
    got, candidates, _ = run(spark, [(1, "https://own.cl/")], [page(1, "https://own.cl/", chat("123"))])
    assert got[1]["whatsapp_broken_button"] and candidates == [] and got[1]["whatsapp_status"] == "NO ENCONTRADO"
    got, candidates, missing = run(spark, [(1, "https://own.cl/")], [])
    assert got[1]["whatsapp_status"] == "VIEJO" and missing == {"https://own.cl/"}
    assert run(spark, [], [page(1, "https://own.cl/", "")]) == ({}, [], set())
