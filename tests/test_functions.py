"""Scalar rules, with the cases on which engines usually differ."""

import pytest
from merchloom.functions import media, text, urls
from merchloom.operators import categories, pages
from pyspark.sql import functions as F


def value(spark, f, *inputs):
    df = spark.createDataFrame([inputs], ", ".join(f"c{i} string" for i in range(len(inputs))))
    return df.select(f(*[F.col(f"c{i}") for i in range(len(inputs))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("name", "key"),
    [
        ("Нагрівальний мат Demo 2 м²", "нагрівальнии мат demo 2 м²"),
        ("Ёж — ґанок, їжа!", "еж ґанок іжа"),
        ("Café  «X» 1/2", "cafe x 1 2"),
        ("", ""),
        (None, None),
    ],
)
def test_name_key(spark, name, key):
    assert value(spark, text.name_key, name) == key


@pytest.mark.parametrize(("a", "b", "ratio"), [("", "", 1.0), ("", "a", 0.0), ("abcd", "abce", 0.75), ("ж", "a", 0.0), (None, "a", None)])
def test_similarity(spark, a, b, ratio):
    assert value(spark, text.similarity, a, b) == ratio


@pytest.mark.parametrize(("shown", "price"), [("12 344 ГРН", 12344), ("1 234,50 грн", 50), ("1234", None), ("від 7 грн.", 7), (None, None)])
def test_price(spark, shown, price):
    assert value(spark, text.price, shown) == price


@pytest.mark.parametrize(("shown", "number"), [(" 3,5 ", 3.5), ("230 ±10%", None), ("-5", None), ("1000000000000", None), ("999999999999", 999999999999.0), ("", None)])
def test_spec_number(spark, shown, number):
    got = value(spark, text.spec_number, shown)
    assert (None if got is None else float(got)) == number


def test_codes_and_slugs(spark):
    assert value(spark, lambda s, i: text.product_slug(s, i), "et_market", "a//b c") == "et_market-a-b-c"
    assert value(spark, lambda c, s, i: text.product_sku(c, s, i), " 12 ", "et_market", "x") == "12__et_market__x"
    assert value(spark, lambda c, s, i: text.product_sku(c, s, i), " ", "et_market", "x") is None
    assert value(spark, lambda s: text.base_code(s, categories.SOURCES), "ab 1__in_heat__z") == "AB1"
    assert value(spark, lambda s: text.slug(s, 80, "spec"), "Потужність, Вт") == "potuzhnist-vt"
    assert value(spark, lambda s: text.slug(s, 80, "spec"), "!!!") == "spec"
    assert value(spark, lambda s: text.half_up(s.cast("double"), 3), "0.0625") == 0.063
    assert value(spark, text.filterable, "Площа, М²") is True


def test_descriptions(spark):
    assert value(spark, text.shortened, "x" * 321) == "x" * 317 + "…"
    assert value(spark, text.shortened, "") is None
    assert value(spark, text.escaped_html, "a<b & c\nd") == "a&lt;b &amp; c<br/>\nd"
    assert value(spark, lambda t, n, u: text.spec_display(t, n.cast("decimal(18,6)"), u), "", "2", "м²") == "2 м²"
    assert value(spark, lambda t, n, u: text.spec_display(t, n.cast("decimal(18,6)"), u), "", None, "м²") == "—"


@pytest.mark.parametrize(("url", "leaf"), [("https://h/x/Item-12.html/", "item-12"), ("https://h/ab.html", None), ("x/abcdefgh", None), (None, None)])
def test_leaf_key(spark, url, leaf):
    assert value(spark, urls.leaf_key, url) == leaf


def test_urls(spark):
    assert value(spark, urls.canonical, "https://H.ua//a//b?x=1#y") == "https://h.ua/a/b/"
    assert value(spark, urls.canonical, "not a url") == "not a url"
    assert value(spark, urls.depth, "nothing") == 0
    assert value(spark, lambda u: urls.with_page(u, F.lit(2), "page"), "https://h/a?page=7&b=1#z") == "https://h/a?b=1&page=2#z"
    assert value(spark, lambda u: urls.under_prefixes(u, ["/ua/x"]), "/ua/xy") is False
    assert [urls.resolve(r, "https://h/a/b") for r in ("c", "/c", "#", "javascript:x", "", "//o/p")] == ["https://h/a/c", "https://h/c", None, None, None, "https://o/p"]


def test_media_names(spark):
    name = "ab" * 32 + ".png"
    assert value(spark, media.local_name, f"/api/media/{name}?v=2") == name
    assert value(spark, media.local_name, "/api/media/../etc/passwd") is None
    assert value(spark, lambda u, k: media.ending(u, k), "https://h/x", "image/jpeg") == "jpg"
    assert value(spark, lambda u: media.ending(u), "https://h/x.WEBP?y") == "webp"


def test_category_rules(spark):
    slug = lambda s, u: value(spark, categories.category_slug, s, u)
    assert slug("et_market", "https://et-market.com.ua/teplyj-pol/nagrevatelnye-maty/nagrevatelnyj-kabel/") == categories.CABLES
    assert slug("et_market", "https://et-market.com.ua/avtomatika/nagrevatelnye-maty/") == "et-avtomatika"
    assert slug("in_heat", "https://in-heat.kiev.ua/ua/otoplenie/x/") == "inh-otoplenie"
    assert slug("vsesezon", "https://vsesezon.com.ua/ua/g2181672-kabel") == "vs-2181672"
    assert slug("et_market", None) == categories.ROOT
    assert slug("other", "https://et-market.com.ua/x/") is None
    assert value(spark, categories.is_legacy_slug, "inh-ua") is True
    assert value(spark, categories.is_legacy_slug, "inh-uabc") is False


def test_offer_price(spark):
    assert value(spark, pages.offer_price, '{"@type":"AggregateOffer","lowPrice":"1 200,5","highPrice":"2"}') == 1200.5
    assert value(spark, pages.offer_price, '{"price":7}') == 7.0
    assert value(spark, pages.offer_price, '{"price":"none"}') is None


def test_marks_of_all_scripts_go(spark):
    for marked, plain in (("が", "か"), ("ấ", "a"), ("й", "и"), ("ΐ", "ι"), ("क़", "क"), ("אּ", "א"), ("한", "한")):
        assert value(spark, text.name_key, marked) == plain
