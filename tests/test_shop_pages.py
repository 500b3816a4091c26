"""Shop pages: listings, cards, facets, JSON-LD, pagination and links on hand-written pages."""

import json

from merchloom.functions import dom
from merchloom.operators import pages
from pyspark.sql import functions as F

THUMB = """<div class="product-thumb"><div class="image"><a href="/p/demo-mat.html"><img src="/i/lazy.gif" data-src="/i/x.jpg"></a></div>
<div class="caption"><h4><a href="/p/demo-mat.html"> Demo mat &amp; co </a></h4>(Код: 999001)<p class="price">12&nbsp;344 грн</p></div></div>"""


def frame(spark, *html):
    return spark.createDataFrame([(i, h) for i, h in enumerate(html)], "page_id long, html string")


def test_selectors():
    root = dom.parse('<div id="a" class="x y"><p>1<p class="z">2<span data-k="abc">3</span></div><ul><li>4<li><b>5</b></ul>')
    assert [n.text() for n in root.all("div > p")] == ["1", "23"]
    assert root.first("#a .z span").text() == "3"
    assert root.first("[data-k*=b]").get("data-k") == "abc"
    assert [n.text() for n in root.all("li, .x")] == ["123", "4", "5"]
    assert root.first("ul > b") is None
    assert root.first("li b").outer() == "<b>5</b>"


def test_first_donor_listing(spark):
    block = '<div class="product-thumb"><div class="prod-name"><a href="https://et-market.com.ua/q.htm">Q</a></div><span class="price_span">55</span><input class="polt_id" value="17"><div class="image"><img src="/q.png"></div></div>'
    html = THUMB + THUMB + block + '<div class="product-thumb"><div class="prod-name"><a href="/section/">No page</a></div></div>'
    rows = [r.asDict() for r in pages.listings(frame(spark, html), "et_market", category=F.lit("https://et-market.com.ua/c/")).orderBy("pos").collect()]
    assert [(r["externalId"], r["slug"], r["sku"], r["priceUah"], r["priceVisible"], r["nameUk"]) for r in rows] == [
        ("demo-mat", "demo-mat", "999001", 12344.0, True, "Demo mat & co"),
        ("17", "q", None, 55.0, True, "Q"),
    ]
    assert rows[0]["imageUrl"] is None and rows[1]["imageUrl"] == "https://et-market.com.ua/q.png"
    assert rows[0]["sourceCategoryUrl"] == "https://et-market.com.ua/c/"


def test_first_donor_card(spark):
    html = """<link rel="canonical" href="https://et-market.com.ua/x/item.html"><meta name="description" content=" Short ">
    <div id="content"><h1> Name </h1></div><input name="product_id" value="42"><div class="price_w">1 000 грн</div><div class="model">Код 12345</div>
    <ul class="thumbnails"><li><a class="thumbnail" href="/big.jpg" title="T"></a><li><a class="thumbnail" href="/big.jpg"></a></ul>
    <div itemprop="description"><table class="table"><tbody><tr><td>Тип</td><td> мат </td></tr><tr><td>only</td></tr></tbody></table></div>"""
    r = pages.cards(frame(spark, html), "et_market").first()
    assert (r["externalId"], r["slug"], r["nameUk"], r["priceUah"], r["sku"], r["shortDescription"]) == ("42", "item", "Name", 1000.0, "12345", "Short")
    assert [(i["url"], i["alt"]) for i in r["images"]] == [("https://et-market.com.ua/big.jpg", "T")]
    assert [(s["group"], s["label"], s["value"]) for s in r["specs"]] == [(None, "Тип", "мат")]
    assert "<table" in r["descriptionHtml"]


def test_card_falls_back_to_listing(spark):
    listing = json.dumps({"nameUk": "From list", "sku": "S1", "priceUah": 9.0, "slug": "s", "externalId": "e", "sourceUrl": "https://et-market.com.ua/s.html"})
    df = spark.createDataFrame([(1, "<p>nothing</p>", listing)], "page_id long, html string, listing string")
    r = pages.cards(df, "et_market", listing_col="listing").first()
    assert (r["nameUk"], r["sku"], r["priceUah"], r["externalId"], r["sourceUrl"]) == ("From list", "S1", 9.0, "e", "https://et-market.com.ua/s.html")


def test_second_donor(spark):
    listing = """<div id="catalogSection"><div class="productTable"><a class="name" href="/ua/x/mat.html"><span class="middle">Mat</span></a><span class="changeArticle1">A7</span>
    <div class="wrapper_price"><a class="price">2 260 грн.</a></div><a class="addCart" data-id="88"></a><img class="lazy" data-lazy="/l.jpg" src="/lazy.svg"></div></div>"""
    r = pages.listings(frame(spark, listing), "in_heat").first()
    assert (r["externalId"], r["nameUk"], r["sku"], r["priceUah"], r["bitrixOfferId"], r["imageUrl"]) == ("mat", "Mat", "A7", 2260.0, "88", "https://in-heat.kiev.ua/l.jpg")
    card = """<meta property="og:image" content="/og.jpg"><meta property="og:url" content="/ua/x/mat.html"><meta itemprop="sku" content="B1"><h1 class="changeName">Mat</h1>
    <div id="catalogElement"><div class="picture"><img src="/og.jpg"><img data-lazy="/two.jpg" alt="2"></div></div><div id="detailText"><div class="changeDescription"><img src="/d.png"></div></div>
    <div id="elementProperties"><table class="stats"><tr class="cap"><td>Main</td></tr><tr><td class="name">Power</td><td itemprop="value">5 W</td></tr><tr class="cap"><td>Other</td></tr>
    <tr><td class="name">Kind</td><td itemprop="value"><a>mat</a> more</td></tr></table></div>"""
    r = pages.cards(frame(spark, card), "in_heat").first()
    assert [(s["group"], s["label"], s["value"]) for s in r["specs"]] == [("Main", "Power", "5 W"), ("Other", "Kind", "mat")]
    assert [i["url"] for i in r["images"]] == ["https://in-heat.kiev.ua/og.jpg", "https://in-heat.kiev.ua/two.jpg"]
    assert 'src="https://in-heat.kiev.ua/d.png"' in r["descriptionHtml"] and r["sku"] == "B1" and r["slug"] == "mat"


def test_facets_and_snapshot(spark):
    html = """<div id="ocfilter-content"><div class="list-group-item ocfilter-option"><span class="option-name">Ціна</span><div id="scale-price" class="scale ocf-target" data-range-min="10" data-range-max="90"></div></div>
    <div class="list-group-item ocfilter-option" id="option-m"><span class="option-name">Виробник</span><div class="option-values"><label><input class="ocf-target" name="ocfilter_filter[m]" value="u1"><a>A</a><small class="badge">3</small></label><label><a>B</a></label></div></div>
    <div class="list-group-item ocfilter-option" id="option-e"><span class="option-name">Empty</span></div></div>
    <ul class="pagination"><li class="active"><span>2</span></li><li><a href="?page=9">9</a></li></ul><div>Показано с 17 по <b>32</b> из 569</div>""" + THUMB
    rows = pages.facets(frame(spark, html)).orderBy("pos").collect()
    assert [(r["id"], r["name"], len(r["values"])) for r in rows] == [("price", "Ціна", 0), ("m", "Виробник", 1)]
    assert rows[0]["priceRangeUah"]["max"] == 90 and rows[1]["values"][0].asDict() == {"filterKey": "m", "label": "A", "count": 3, "filterUrl": "u1"}
    s = pages.snapshots(frame(spark, html)).first()
    assert (s["currentPage"], s["totalPages"], s["showingFrom"], s["showingTo"], s["totalProducts"], s["n_products"], s["n_filters"]) == (2, 9, 17, 32, 569, 1, 2)


def test_json_ld(spark):
    product = lambda **x: {"@type": "Product", "name": " N ", "offers": {"url": "/ua/p12-n.html", "price": "1 200,5"}, "image": ["/a.jpg", 5], "brand": "B", "description": "d<e"} | x
    blocks = [
        [product(), product(name="again")],
        product(offers=[{"url": "/p3"}]),
        product(name="", offers={"url": "/p4"}),
        product(name="late", offers={"url": "/p4"}),
        product(offers={"url": "https://vsesezon.com.ua/p5", "@type": "AggregateOffer", "lowPrice": 0}, image="/one.jpg"),
        {"@type": "Thing", "offers": {"url": "/p6"}},
    ]
    html = "".join(f"<script type='application/ld+json'>{json.dumps(b)}</script>" for b in blocks) + "<script type='application/ld+json'>{broken</script>"
    rows = {r["externalId"]: r for r in pages.json_ld_products(frame(spark, html), F.lit("https://vsesezon.com.ua/ua/g1-x?page=2")).collect()}
    assert set(rows) == {"12", "5"}
    r = rows["12"]
    assert (r["nameUk"], r["priceUah"], r["priceVisible"], r["sourceUrl"], r["sourceCategoryUrl"], r["slug"]) == ("N", 1200.5, True, "https://vsesezon.com.ua/ua/p12-n.html", "https://vsesezon.com.ua/ua/g1-x/", "vsesezon-12")
    assert r["descriptionHtml"] == '<div class="import-vsesezon-desc">d&lt;e</div>' and r["specs"][0]["value"] == "B"
    assert rows["5"]["priceVisible"] is False and rows["5"]["imageUrl"] == "/one.jpg"


def test_links_and_pages(spark):
    html = """<title> A
    title </title><h1 class="t">Head <b>ing</b></h1><a href="/g12-x">g</a><a href='https://www.et-market.com.ua/teplyj-pol/a/?page=2'>a</a><a href="rel.html">r</a><a href="#">n</a>
    <a href="/teplyj-pol/b/c.html">p</a><a href="/teplyj-pol/b?filter=1">f</a><link href="/n?page=2" rel="next">"""
    df = frame(spark, html).withColumn("url", F.lit("https://et-market.com.ua/x/y"))
    r = df.select(
        pages.title(F.col("html")).alias("t"), pages.heading(F.col("html")).alias("h"), pages.next_page(F.col("html"), F.col("url")).alias("n"), pages.max_page(F.col("html"), "page").alias("m")
    ).first()
    assert tuple(r) == ("A title", "Head ing", "https://et-market.com.ua/n?page=2", 2)
    found = pages.links(df)
    assert {x["link"] for x in found.collect()} >= {"https://et-market.com.ua/g12-x", "https://et-market.com.ua/x/rel.html", "https://www.et-market.com.ua/teplyj-pol/a/?page=2"}
    assert [x["url"] for x in pages.section_urls(found, "et-market.com.ua", ["teplyj-pol"], 2).collect()] == ["https://www.et-market.com.ua/teplyj-pol/a/"]
    groups = pages.group_urls(found.withColumn("link", F.replace("link", F.lit("et-market"), F.lit("vsesezon"))), "vsesezon.com.ua")
    assert [x["url"] for x in groups.collect()] == ["https://vsesezon.com.ua/ua/g12-x/"]


def test_robot_checks_and_missing_pages(spark):
    df = frame(spark, "adm.tools ___ack", "<p>fine</p>", None)
    usable, blocked = pages.split_blocked(df)
    assert usable.count() == 2 and blocked.count() == 1
    assert pages.listings(df, "et_market").count() == 0
    assert pages.cards(df, "in_heat").count() == 3
    assert pages.facets(df.limit(0)).count() == 0
