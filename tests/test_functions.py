import pytest
from pyspark.sql import functions as F

from leadweave.functions import phones as ph
from leadweave.functions import scoring
from leadweave.functions import text as tx
from leadweave.functions import urls as ur


def test_redirect_wrappers(apply):
    rows = ["/url?q=https://a.cl/&sa=U", "https://www.google.es/url?url=https://a.cl/x&z=1", "/url?q=https%3A%2F%2Fa.cl%2F%3Fb%3D1",
            "https://a.cl/url?q=https://b.cl/", "/url?q=/url?q%3D/url%3Fq%253Dhttps://deep.cl/", "/url?z=1"]
    assert apply(rows, lambda d: ur.with_unwrapped(d, "a", "out")) == [
        "https://a.cl/", "https://a.cl/x", "https://a.cl/?b=1", "https://a.cl/url?q=https://b.cl/", "https://deep.cl/", "/url?z=1"]


def test_normal_form(apply):
    rows = [("a.cl", None), ("HTTP://WWW.A.CL:80/X#y", None), ("https://a.cl/?utm_campaign=1&b=2&c=&b=3", None), ("../q?x=a b", "https://a.cl/m/n/o"), ("//c.a.cl/i.png", None),
            ("tel:1", None), ("", "https://a.cl/"), ("#top", "https://a.cl/p?z=1"), ("https://u:p@a.cl:8443", None), ("https://a.cl:99x/", None), (None, None)]
    assert apply(rows, lambda d: ur.with_normalized(d, "a", "out", "b"), "a string, b string") == [
        "https://a.cl/", "http://www.a.cl/X", "https://a.cl/?b=2&b=3&c=", "https://a.cl/m/q?x=a+b", "https://c.a.cl/i.png",
        None, None, "https://a.cl/p?z=1", "https://a.cl:8443/", None, None]


def test_link_kinds(apply):
    rows = ["a.cl", "https://m.facebook.com/a", "https://facebook.com/sharer.php?u=x", "https://wa.link/x", "WhatsApp://send?phone=1", "https://beacons.ai/x",
            "https://www.google.cl/maps/place/x", "https://goo.gl/maps/x", "https://notinstagram.com/x", "mailto:x", None]
    assert apply(rows, lambda d: ur.with_link_kind(d, "a", "out")) == [
        "web_propia", "red_social", "web_propia", "whatsapp", "whatsapp", "agregador", "google", "google", "web_propia", "invalido", "invalido"]


def test_profiles(apply):
    rows = ["instagram.com/Neg_X?x=1", "https://www.tiktok.com/neg", "https://www.tiktok.com/@Neg/video/1", "https://www.linkedin.com/company/Neg/about", "https://x.com/Neg",
            "https://facebook.com/profile.php?id=12&z", "https://facebook.com/profile.php?id=ab", "https://instagram.com/p/1", "https://youtube.com/"]
    assert apply(rows, lambda d: ur.with_social(d, "a", "s").withColumnRenamed("s_profile", "out")) == [
        "https://www.instagram.com/neg_x", None, "https://www.tiktok.com/@Neg", "https://www.linkedin.com/company/Neg", "https://x.com/neg",
        "https://www.facebook.com/profile.php?id=12", None, None, None]


def test_site_keys_and_prints(apply):
    rows = ["https://www.a.cl/x", "https://a.cl", "https://linktr.ee/", "https://fresha.com/es/a/b/c", "https://me.wixsite.com/S/x", None]
    assert apply(rows, lambda d: ur.with_site_key(d, "a", "out")) == ["a.cl", "a.cl", None, "fresha.com/es/a/b", "me.wixsite.com/s", None]
    shown = lambda d: ur.with_link_print(d, "a", "p").withColumn("out", F.concat_ws(" ", "p_kind", "p_value"))
    assert apply(["https://wa.me/+5491123456789", "https://walink.co/Ab?x", "https://Instagram.com/AB/", "https://g.page/x", ""], shown) == [
        "numero 541123456789", "web walink.co/ab", "red https://www.instagram.com/ab", "", ""]


def test_phones(apply):
    rows = [("+56 9 5555 1234", "CL"), ("(2) 2345 6789", "CL"), ("0221 15-456-7890", "AR"), ("011 4567-8901", "AR"), ("+52 1 33 1234 5678", "CL"), ("044 55 1234 5678", "MX"), ("(305) 555-1234", "US"),
            ("612 34 56 78", "ES"), ("+56 9 55", "CL"), ("Anexo", "CL"), (None, "CL")]
    assert apply(rows, lambda d: ph.normalize_phone("a", F.col("b")), "a string, b string") == [
        "+56955551234", "+56223456789", "+5492214567890", "+541145678901", "+523312345678", "+525512345678", "+13055551234", "+34612345678", None, None, None]
    assert apply(["+56955551234", "+56223456789", "+5492214567890", "+541145678901", "+523312345678", None], lambda d: ph.is_probable_mobile("a")) == [True, False, True, False, True, False]
    numbers = [("+56955551234", "CL"), ("955551234", "CL"), ("5213312345678", "MX"), ("12", "CL"), ("%2B56955551234", "CL")]
    assert apply(numbers, lambda d: ph.with_contact_number(d, "a", "c", F.col("b")).withColumn("out", F.concat_ws("/", "c_number", F.col("c_broken").cast("string"))), "a string, b string") == [
        "56955551234/false", "56955551234/true", "5213312345678/false", "", "56955551234/false"]
    assert apply(["tel:%2B56%209%205555%201234?x", "fax:1"], lambda d: ph.phone_from_tel("a")) == ["+56955551234", None]
    assert apply(["Fono +56 9 5555 1234 o (2) 2345 6789, RUT 76.123.456-7, 1998"], lambda d: ph.phones_in_text("a")) == [["+56955551234", "+56223456789"]]


def test_numbers_of_many_countries(apply):
    rows = [("+51 987 654 321", "CL"), ("(01) 234 5678", "PE"), ("+44 (0)20 7946 0958", "CL"), ("06 12 34 56 78", "FR"), ("06 1234 5678", "IT"), ("(416) 555-0199", "US"),
            ("0 11 91234-5678", "BR"), ("+57 601 2345678", "CL"), ("+81 90 1234 5678", "CL"), ("0049 1512 3456789", "CL"), ("", "XX"), (None, None)]
    numbers = ["+51987654321", "+5112345678", "+442079460958", "+33612345678", "+390612345678", "+14165550199", "+5511912345678", "+576012345678", None, "+4915123456789", None, None]
    assert apply(rows, lambda d: ph.normalize_phone("a", F.col("b")), "a string, b string") == numbers
    assert apply(numbers[:8], lambda d: ph.phone_region("a", "ZZ")) == ["PE", "PE", "GB", "FR", "IT", "CA", "BR", "CO"]
    assert apply(numbers[:8], lambda d: ph.is_probable_mobile("a")) == [True, False, False, True, False, True, True, False]
    assert apply(numbers[:8], lambda d: ph.pretty_number("a")) == [
        "+51 987 654 321", "+51 1 2345678", "+44 20 7946 0958", "+33 6 12 34 56 78", "+39 06 1234 5678", "+1 416-555-0199", "+55 11 91234-5678", "+57 601 2345678"]
    assert apply(["Tel. +51 1 2345678, +57 321 1234567 y +56955551234"], lambda d: ph.phones_in_text("a")) == [["+5112345678", "+573211234567", "+56955551234"]]


def test_plan_is_a_table(spark, apply):
    rows = [("JP", "81", "0", r"[1-9]\d{8,9}", r"[7-9]0\d{8}", [(r"^81(\d{2})(\d{4})(\d{4})$", "+81 $1-$2-$3")])]
    schema = "region string, code string, trunk string, valid string, mobile string, display array<struct<pattern:string,shown:string>>"
    plan = ph.plan_from_table(spark.createDataFrame(rows, schema))
    assert apply(["090-1234-5678", "+81 (0)90 1234 5678", "+56955551234"], lambda d: ph.normalize_phone("a", "JP", plan)) == ["+819012345678", "+819012345678", None]
    assert apply(["+819012345678"], lambda d: F.concat_ws("/", ph.phone_region("a", "ZZ", plan), ph.is_probable_mobile("a", plan).cast("string"), ph.pretty_number("a", plan))) == ["JP/true/+81 90-1234-5678"]
    with pytest.raises(ValueError):
        ph.plan_from_table(spark.createDataFrame(rows * 3, schema), max_rows=2)
    with pytest.raises(ValueError):
        ph.NumberingPlan([("A", "5", "", r"\d+", "", ()), ("B", "56", "", r"\d+", "", ())])


def test_texts(apply):
    assert apply(["Ñandú ÁÉ"], lambda d: tx.fold_accents("a")) == ["Nandu AE"]
    assert apply(["© 2018–2022 X", "2010 derechos reservados", "Desde 1998"], lambda d: tx.copyright_years("a")) == [[2022], [2010], []]
    long_line = "x" * 200 + " aquí " + "y" * 200
    shown = apply([long_line, "corta aquí"], lambda d: tx.snippet(F.col("a"), "aquí"))
    assert shown[0].startswith("…x") and shown[0].endswith("y…") and len(shown[0]) == 162 and shown[1] == "corta aquí"
    assert apply(["Av. X 1, 8320000 Ñuñoa, Región Metropolitana, Chile", "Solo calle 1"], lambda d: tx.address_locality("a")) == ["Ñuñoa", None]


def test_score_bands(apply):
    rows = [(None, 45), (None, 55), (None, 3), (1499, None), (1500, None), (9000, None), (None, None)]
    assert apply(rows, lambda d: scoring.speed_score("a", "b"), "a int, b int") == [4, 6, 1, 10, 8, 1, None]
    assert apply([(0,), (1,), (3,), (6,), (7,)], lambda d: scoring.links_score("a"), "a int") == [10, 8, 6, 4, 2]
