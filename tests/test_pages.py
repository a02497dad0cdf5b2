import pytest
from pyspark.sql import functions as F

from leadweave.operators import contact_links as cl
from leadweave.operators import page_facts as pf
from leadweave.operators.page_elements import page_nodes, parse_pages


@pytest.fixture(scope="module")
def parse(spark):
    def run(*pages, region="CL"):
        rows = [(i, "https://www.neg.cl/base/", html, region) for i, html in enumerate(pages)]
        return parse_pages(cl.with_fallback_text(spark.createDataFrame(rows, "page_id long, url string, html string, region string")))
    return run


def test_nodes_of_untidy_html():
    tags = [(n[2], n[1]) for n in page_nodes("<ul><li>a<li>b</ul><p>x<div>y</div><br><IMG src=q><!-- <b> --></i>")]
    assert [t for t, _ in tags] == ["ul", "li", "#text", "li", "#text", "p", "#text", "div", "#text", "br", "img"]
    assert page_nodes("") == [] and page_nodes("a < b")[0][4] == "a < b"


def test_visible_lines(parse):
    html = "<head><title>T</title></head><body>Uno <b>dos</b><script>no</script><div>tres<br>cuatro\ncinco</div><noscript>no</noscript></body>"
    assert pf.with_visible_text(parse(html)).first()["visible_text"] == "Uno dos\ntres\ncuatro\ncinco"


def test_ambiguous_places_need_context(spark, parse):
    catalog = spark.createDataFrame([("Peumo", "Peumo", True), ("Maipú", "Maipu", False), ("Isla de Maipo", "Isla de Maipo", False)], "name string, folded string, ambiguous boolean")
    pages = parse("<p>Un Peumo añoso</p>", "<p>Sector Peumo</p>", "<p>maipu y Peumo</p><p>isla de maipo</p>", "<p>comuna de peumo</p>")
    found = {r["page_id"]: r["places"] for r in pf.place_mentions(pf.with_visible_text(pages), catalog).collect()}
    assert found == {1: ["Peumo"], 2: ["Maipú", "Peumo", "Isla de Maipo"]}


CONTACTS = [
    ('<a href="https://wa.me/56955551234">x</a>', ["56955551234"]),
    ('<a href="wa.me/+56955551234?text=a">x</a>', ["56955551234"]),
    ('<a href="//api.whatsapp.com/send/?text=a&amp;phone=56955551234">x</a>', ["56955551234"]),
    ('<a onclick="go(\'whatsapp://send?phone=56955551234\')">x</a>', ["56955551234"]),
    ('<script>var u = "https:\\/\\/wa.me\\/56955551234"</script>', ["56955551234"]),
    ("<p>Escribe a wa.me/56955551234</p>", ["56955551234"]),
    ('<div class="wa-button" data-phone="+56 9 5555 1234"></div>', ["56955551234"]),
    ('<script>x({whatsapp: "+56 9 5555 1234"})</script>', ["56955551234"]),
    ('<a href="https://wa.me/955551234">x</a>', ["56955551234"]),
    ('<!-- <a href="https://wa.me/56955551234">x</a> -->', []),
    ('<a href="https://mywa.me/56955551234">x</a>', []),
    ("<p>WhatsApp +56 9 5555 1234</p>", []),
    ('<div class="box" data-phone="56955551234"></div>', []),
    ('<script type="application/ld+json">{"telephone":"+56955551234","x":"whatsapp"}</script>', []),
    ('<script>var w = "whatsapp";' + " " * 400 + 'var t = {"phone":"+56223456789"};</script>', []),
    ('<a href="https://chat.whatsapp.com/Ab1">x</a>', []),
]


def test_contact_links(parse):
    found = {}
    for r in cl.page_candidates(cl.contact_mentions(parse(*[c[0] for c in CONTACTS]))).collect():
        found.setdefault(r["page_id"], []).append(r["number"])
    assert [found.get(i, []) for i in range(len(CONTACTS))] == [c[1] for c in CONTACTS]


def test_placement_follows_ancestors(parse):
    link = '<a href="https://wa.me/56955551234">x</a>'
    pages = [f"<header>{link}</header>", f'<footer><nav>{link}</nav></footer>', f'<footer><i class="btn-Float">{link}</i></footer>', f'<p style="position:fixed">{link}</p>', f"<main>{link}</main>",
             f'<div role="banner">{link}</div>', f"<footer>{link}</footer><header>{link}</header>"]
    got = {r["page_id"]: r["placement"] for r in cl.page_candidates(cl.contact_mentions(parse(*pages))).collect()}
    assert [got[i] for i in range(len(pages))] == ["header", "footer", "flotante", "flotante", "cuerpo", "header", "header"]


def test_short_links_are_followed_to_their_end(spark):
    hops = [(f"https://wa.link/{i}", f"/{i - 1}") for i in range(1, 8)] + [("https://wa.link/0", "https://wa.me/56955551234"), ("https://wa.link/loop", "/loop"), ("https://wa.link/dead", None)]
    redirects = spark.createDataFrame(hops, "url string, location string")
    got = {r["url"].rsplit("/", 1)[1]: r["final_url"] for r in cl.resolve_short_links(redirects, redirects).collect()}
    assert {k for k, v in got.items() if v} == {str(k) for k in range(8)} and len(got) == 10
    five = cl.resolve_short_links(redirects, redirects, max_hops=5).filter("final_url IS NOT NULL").collect()
    assert {r["url"].rsplit("/", 1)[1] for r in five} == {"0", "1", "2", "3", "4"}


def test_long_chains_and_cycles_take_logarithmic_rounds(spark, monkeypatch):
    end = [("https://wa.link/0", "https://wa.me/56955551234", None, 302)]
    chain = [(f"https://wa.link/{i}", None if i % 3 == 0 else f"/{i - 1}", f"<meta http-equiv=refresh content='0;url=/{i - 1}'>" if i % 3 == 0 else None, 200 if i % 3 == 0 else 302) for i in range(1, 41)]
    cycle = [(f"https://wa.link/z{i}", f"/z{(i + 1) % 11}", None, 302) for i in range(11)] + [("https://wa.link/a0", "/z3", None, 302)] + [(f"https://wa.link/a{i}", f"/a{i - 1}", None, 302) for i in range(1, 9)]
    other = [("https://wa.link/x", "", "<meta http-equiv='refresh' content='0; url=/1'>", 404), ("https://wa.link/y", None, None, None), ("https://wa.link/q", None, '<META content="0; url=https://wa.me/56955551234?text=a&amp;b=c" http-equiv="refresh">', 200),
             ("https://wa.link/r", None, '<meta http-equiv="refresh" content="0; url=https://wa.me/56955551234?a=1&amp;b=2">', 200), (None, "/1", None, 302)]
    redirects = spark.createDataFrame(end + chain + cycle + other, "url string, location string, body string, status int")
    rounds = []
    plain = cl.hot_safe_lookup
    monkeypatch.setattr(cl, "hot_safe_lookup", lambda rows, lookup, keys, *a: rounds.append(keys) or plain(rows, lookup, keys, *a))
    asked = redirects.select("url").unionByName(redirects.select("url")).unionByName(spark.createDataFrame([("https://wa.link/unknown",)], "url string"))
    got = {r["url"]: r["final_url"] for r in cl.resolve_short_links(asked, redirects).collect()}
    assert {u for u, f in got.items() if f} == {r[0] for r in end + chain} | {"https://wa.link/r"}
    assert got["https://wa.link/r"] == "https://wa.me/56955551234?a=1&b=2" and len(got) == len(end + chain + cycle + other) + 1
    assert sum(keys == ["at"] for keys in rounds) <= 7
    assert cl.resolve_short_links(asked, redirects.limit(0)).filter("final_url IS NULL").count() == len(got)


def test_structured_data_of_any_depth(parse):
    deep = '{"@type":"Dentist","name":"D"}'
    for _ in range(60):
        deep = '{"@graph":[[' + deep + "]]}"
    script = lambda text: f'<script type="application/ld+json">{text}</script>'
    pages = parse(
        script('[[[{"@type":["A",null,"B"],"@graph":{"@graph":[{"@type":"C"}]}}]]]') + script("{bad") + script('{"@type":"A"}'), script(deep), script("[" * 100_000), "<p>x</p>",
        script('{"name":"no type","address":{"@type":"Inside"}}'))
    found = {r["page_id"]: r for r in pf.with_structured_data(pages).collect()}
    assert found[0]["json_ld_types"] == ["A", "B", "C"] and found[0]["local_business"] is None
    assert found[1]["json_ld_types"] == ["Dentist"] and '"name": "D"' in found[1]["local_business"]
    assert [found[k]["json_ld_types"] for k in (2, 3, 4)] == [[], [], []]


def test_place_words_need_no_exchange(spark, parse):
    catalog = spark.createDataFrame([("San Juan", "San Juan", False), ("San", "San", False), ("San Juan de la Costa", "San Juan de la Costa", False)], "name string, folded string, ambiguous boolean")
    pages = pf.with_visible_text(parse("<p>en San Juan de la Costa</p>", "<p>San; san  juan</p>", "<p>sanjuan</p>"))
    found = pf.place_mentions(pages, catalog)
    assert {r["page_id"]: r["places"] for r in found.collect()} == {0: ["San", "San Juan", "San Juan de la Costa"], 1: ["San", "San Juan"]}
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_link_work_has_no_python_and_no_nested_loop(spark):
    links = spark.range(10).select(F.col("id"), F.concat(F.lit("https://a.cl/"), F.col("id").cast("string")).alias("url"))
    from leadweave.functions.urls import with_link_print
    plan = with_link_print(links, "url", "p").filter("p_kind = 'web'")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "NestedLoop" not in plan and "Arrow" not in plan and "Python" not in plan
