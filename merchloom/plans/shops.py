"""Registered queries of the page parsers: the parts table written as the shops' pages and parsed back.

Each query makes whole pages in the markup that the selectors of ``operators.pages`` expect, one or
more for each part, and applies a parser to all of them; its SQL knows the answer from the table alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sql, urls
from ..operators import consolidate, pages, trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Products of a listing page.
PAGE = 20


def query(sql: str):
    """Registers a query with its SQL."""

    def named(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return named


def filled(template: str, **parts: Column) -> Column:
    """A text with columns in place of the names in braces; null columns are left out."""
    pieces = re.split(r"\{(\w+)\}", template)
    return F.concat(*[F.coalesce(parts[p].cast("string"), F.lit("")) if i % 2 else F.lit(p) for i, p in enumerate(pieces)])


def parts_of(spark: SparkSession, d: str) -> DataFrame:
    """Parts with a whole price, which every seventh lacks, and the number of their listing page."""
    part = spark.read.parquet(f"{d}/part.parquet")
    price = F.when(F.col("p_partkey") % 7 != 0, F.floor("p_retailprice").cast("long"))
    return part.select(F.col("p_partkey").alias("key"), F.col("p_name").alias("name"), F.col("p_type").alias("kind"), F.col("p_brand").alias("brand"), F.col("p_size").alias("size"), price.alias("price"), F.expr(f"p_partkey div {PAGE}").alias("page"))


_PARTS = f"""parts AS (SELECT p_partkey AS key, p_name AS name, p_type AS kind, p_brand AS brand, p_size AS size,
  CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice)::BIGINT END AS price, p_partkey // {PAGE} AS page FROM part)"""


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of which a page each is made. Their table is small for these pages, so that its files give few tasks: the rows are dealt anew."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")


def joined(rows: DataFrame, group: str, order: str, block: Column) -> DataFrame:
    """(group, html): the blocks of each group, one after the other."""
    blocks = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), block.alias("html"))))
    return rows.groupBy(group).agg(F.array_join(F.transform(blocks, lambda b: b["html"]), "").alias("html"))


def listing_pages(spark: SparkSession, d: str, source: str) -> DataFrame:
    """(page, html): listing pages of one shop, every block twice, since the first of equal URLs counts."""
    p = parts_of(spark, d)
    c = {x: F.col(x) for x in p.columns}
    if source == "et_market":
        number = F.when(c["key"] % 2 == 0, filled('<input class="polt_id" type="hidden" value="{key}">', **c)).otherwise(filled("<button onclick=\"cart.add('{key}')\">+</button>", **c))
        price = F.when(c["price"].isNotNull(), filled('<span class="price_span">{price}</span>', **c)).otherwise("")
        block = filled('<div class="product-thumb"><div class="image"><a href="/p-{key}.html"><img src="/img/{key}.jpg"></a></div><div class="prod-name"><a href="/p-{key}.html">{name}</a></div>{number}<span>Код: 7{key}</span>{shown}</div>', **c, number=number, shown=price)
        frame = '<html><body><div id="content">{a}{a}</div></body></html>'
    else:
        price = F.when(c["price"].isNotNull(), filled('<div class="wrapper_price"><a class="price">{price} грн</a></div>', **c)).otherwise("")
        block = filled('<div class="productTable"><div class="productColImage"><img class="lazy" src="/lazy.svg" data-lazy="/img/{key}.jpg"></div><a class="name" href="/ua/p-{key}.html"><span class="middle">{name}</span></a>{shown}<span class="changeArticle1">S-{key}</span><a class="addCart" data-id="o{key}">+</a></div>', **c, shown=price)
        frame = '<html><body><div id="catalogSection">{a}{a}</div></body></html>'
    return joined(p, "page", "key", block).select("page", filled(frame, a=F.col("html")).alias("html"))


@query(f"""WITH {_PARTS}, e AS (SELECT page, row_number() OVER (PARTITION BY page ORDER BY key)::INT - 1 AS pos, 'et_market' AS source, key::VARCHAR AS externalId,
    'https://et-market.com.ua/p-' || key || '.html' AS sourceUrl, 'p-' || key AS slug, name AS nameUk, '7' || key AS sku, price::DOUBLE AS priceUah, price IS NOT NULL AS priceVisible,
    'https://et-market.com.ua/img/' || key || '.jpg' AS imageUrl, NULL::VARCHAR AS bitrixOfferId, NULL::VARCHAR AS sourceCategoryUrl FROM parts)
SELECT * FROM e UNION ALL SELECT page, pos, 'in_heat', slug, 'https://in-heat.kiev.ua/ua/' || slug || '.html', slug, nameUk, 'S-' || externalId, priceUah, priceVisible,
    'https://in-heat.kiev.ua/img/' || externalId || '.jpg', 'o' || externalId, NULL FROM e""")
def shop_listings(spark, d):
    return pages.listings(listing_pages(spark, d, "et_market"), "et_market", "page").union(pages.listings(listing_pages(spark, d, "in_heat"), "in_heat", "page"))


def card_pages(spark: SparkSession, d: str, source: str) -> DataFrame:
    p = dealt(parts_of(spark, d))
    c = {x: F.col(x) for x in p.columns}
    if source == "et_market":
        price = F.when(c["price"].isNotNull(), filled('<div class="price_w"><span class="price_span">{price}</span></div>', **c)).otherwise("")
        more = F.when(c["size"] > 25, filled('<li><a class="thumbnail" href="/img/{key}-2.jpg" title="{kind}"></a></li>', **c)).otherwise("")
        html = (
            '<html><head><link rel="canonical" href="https://et-market.com.ua/p-{key}.html"><meta name="description" content="{kind} {brand}"></head><body>'
            '<h1 class="cr-product-title">{name}</h1><input name="product_id" value="{key}">{shown}<span class="sku">Код 7000{key}</span>'
            '<ul class="thumbnails"><li><a class="thumbnail" href="/img/{key}.jpg" title="{name}"></a></li>{more}</ul>'
            '<div itemprop="description"><p>{brand}</p><table class="table"><tbody><tr><td>Тип</td><td>{kind}</td></tr><tr><td> Розмір </td><td>{size}</td></tr></tbody></table></div></body></html>'
        )
    else:
        price = F.when(c["price"].isNotNull(), filled('<div class="wrapper_price"><a class="price">{price} грн</a></div>', **c)).otherwise("")
        more = F.when(c["size"] > 25, filled('<div class="picture"><img data-lazy="/img/{key}-2.jpg" alt="{kind}"></div>', **c)).otherwise("")
        html = (
            '<html><head><link rel="canonical" href="https://in-heat.kiev.ua/ua/p-{key}.html"><meta property="og:image" content="/img/{key}.jpg"><meta name="description" content="{kind} {brand}"></head><body>'
            '<h1 class="changeName">{name}</h1><meta itemprop="sku" content="S-{key}"><div id="catalogElement">{more}{shown}<a class="addCart" data-id="o{key}">+</a></div><div id="detailText"><div class="changeDescription"><p>{brand}</p></div></div>'
            '<div id="elementProperties"><table class="stats"><tr class="cap"><td>Загальні</td></tr><tr><td class="name"><span itemprop="name">Тип</span></td><td itemprop="value">{kind}</td></tr>'
            '<tr><td class="name"><span itemprop="name">Розмір</span></td><td itemprop="value">{size}</td></tr></table></div></body></html>'
        )
    return p.select("key", filled(html, **c, shown=price, more=more).alias("html"))


def flat_cards(cards: DataFrame) -> DataFrame:
    images = F.array_join(F.transform("images", lambda i: F.concat_ws(" ", i["url"], i["alt"])), ";")
    specs = F.array_join(F.transform("specs", lambda s: F.concat_ws("|", s["group"], s["label"], s["value"])), ";")
    return cards.select("page", "source", "externalId", "sourceUrl", "slug", "nameUk", "sku", "priceUah", "priceVisible", "imageUrl", "bitrixOfferId", "shortDescription", images.alias("images"), specs.alias("specs"))


@query(f"""WITH {_PARTS}, e AS (SELECT *, 'https://et-market.com.ua/' AS base, 'https://in-heat.kiev.ua/' AS other FROM parts)
SELECT key AS page, 'et_market' AS source, key::VARCHAR AS externalId, base || 'p-' || key || '.html' AS sourceUrl, 'p-' || key AS slug, name AS nameUk, '7000' || key AS sku, price::DOUBLE AS priceUah, price IS NOT NULL AS priceVisible,
  base || 'img/' || key || '.jpg' AS imageUrl, NULL::VARCHAR AS bitrixOfferId, kind || ' ' || brand AS shortDescription,
  base || 'img/' || key || '.jpg ' || name || CASE WHEN size > 25 THEN ';' || base || 'img/' || key || '-2.jpg ' || kind ELSE '' END AS images, 'Тип|' || kind || ';Розмір|' || size AS specs FROM e
UNION ALL SELECT key, 'in_heat', 'p-' || key, other || 'ua/p-' || key || '.html', 'p-' || key, name, 'S-' || key, price, price IS NOT NULL, other || 'img/' || key || '.jpg', 'o' || key, kind || ' ' || brand,
  other || 'img/' || key || '.jpg ' || name || CASE WHEN size > 25 THEN ';' || other || 'img/' || key || '-2.jpg ' || kind ELSE '' END, 'Загальні|Тип|' || kind || ';Загальні|Розмір|' || size FROM e""")
def shop_cards(spark, d):
    return flat_cards(pages.cards(card_pages(spark, d, "et_market"), "et_market", "key").union(pages.cards(card_pages(spark, d, "in_heat"), "in_heat", "key")))


@query("""SELECT p_brand AS page, 0 AS pos, 'price' AS id, 'Ціна, грн' AS name, floor(min(p_retailprice))::INT AS price_min, floor(max(p_retailprice))::INT AS price_max, NULL::VARCHAR AS filterKey, NULL::VARCHAR AS label, NULL::INT AS count, NULL::VARCHAR AS filterUrl FROM part GROUP BY p_brand
UNION ALL SELECT p_brand, 1, '5', 'Розмір', NULL, NULL, '5', p_size::VARCHAR, count(*)::INT, 'https://et-market.com.ua/teplyj-pol/?size=' || p_size FROM part GROUP BY p_brand, p_size""")
def shop_facets(spark, d):
    counts = parts_of(spark, d).groupBy("brand", "size").agg(F.count("*").alias("n"))
    label = filled('<label><input class="ocf-target" name="ocfilter_filter[5]" value="https://et-market.com.ua/teplyj-pol/?size={size}"><a> {size} </a><small class="badge">{n}</small></label>', size=F.col("size"), n=F.col("n"))
    part = spark.read.parquet(f"{d}/part.parquet")
    ends = part.groupBy(F.col("p_brand").alias("brand")).agg(F.floor(F.min("p_retailprice")).alias("low"), F.floor(F.max("p_retailprice")).alias("high"))
    made = joined(counts, "brand", "size", label).join(ends, "brand")
    html = filled(
        '<html><body><div id="ocfilter-content"><div class="list-group-item ocfilter-option" id="option-p"><div class="option-name">Ціна, грн</div><div id="scale-price" class="scale ocf-target" data-range-min="{low}" data-range-max="{high}"></div></div>'
        '<div class="list-group-item ocfilter-option" id="option-5"><div class="option-name">Розмір</div><div class="option-values">{html}</div></div></div></body></html>',
        **{x: F.col(x) for x in ("low", "high", "html")},
    )
    groups = pages.facets(made.select(F.col("brand").alias("page_id"), html.alias("html")))
    return groups.select("page", "pos", "id", "name", F.col("priceRangeUah.min").alias("price_min"), F.col("priceRangeUah.max").alias("price_max"), F.explode_outer("values").alias("v")).select("page", "pos", "id", "name", "price_min", "price_max", "v.*")


@query(f"""WITH {_PARTS}, g AS (SELECT page, count(*) AS n, min(key) AS low FROM parts GROUP BY page), t AS (SELECT count(*) AS total, max(page) + 1 AS pages FROM parts)
SELECT page, (page + 1)::INT AS "currentPage", pages::INT AS "totalPages", (page * {PAGE} + 1)::INT AS "showingFrom", (page * {PAGE} + n)::INT AS "showingTo", total::INT AS "totalProducts", n AS n_products, 0::BIGINT AS n_filters FROM g, t""")
def shop_pagination(spark, d):
    p = parts_of(spark, d)
    size = p.groupBy("page").agg(F.count("*").alias("n"))
    total = p.agg(F.count("*").alias("total"), (F.max("page") + 1).alias("pages"))
    one = F.col("page") * PAGE
    foot = filled(
        '{html}<ul class="pagination"><li><a href="?page=1">1</a></li><li class="active"><span>{now}</span></li><li><a href="?sort=name&amp;page={pages}">last</a></li></ul><p>Показано с <b>{low}</b> по <b>{high}</b> из <b>{total}</b></p>',
        html=F.col("html"), now=F.col("page") + 1, pages=F.col("pages"), low=one + 1, high=one + F.col("n"), total=F.col("total"),
    )
    made = listing_pages(spark, d, "et_market").join(size, "page").join(F.broadcast(total), F.lit(True))
    return pages.snapshots(made.select(F.col("page").alias("page_id"), foot.alias("html")))


@query("""SELECT p_partkey AS page, CASE p_partkey % 5 WHEN 0 THEN 'https://vsesezon.com.ua/ua/g' || p_size || '/page_2' WHEN 1 THEN 'https://vsesezon.com.ua/ua/g' || p_size || '/page_3'
  WHEN 2 THEN 'https://other.example/x' WHEN 3 THEN 'https://vsesezon.com.ua/ua/g' || p_size || '/page_4' END AS next FROM part""")
def next_page(spark, d):
    p = parts_of(spark, d)
    size, case = {"size": F.col("size")}, F.col("key") % 5
    link = (
        F.when(case == 0, filled('<link rel="next" href="/ua/g{size}/page_2">', **size)).when(case == 1, filled("<LINK href='https://vsesezon.com.ua/ua/g{size}/page_3' rel='next'>", **size))
        .when(case == 2, '<link id="n" rel = "next" href = "https://other.example/x">').when(case == 3, '<link rel="next" href="page_4">').otherwise('<link rel="prev" href="/ua/page_0">')
    )
    html = filled("<html><head>{link}</head><body></body></html>", link=link)
    return p.select(F.col("key").alias("page"), pages.next_page(html, filled("https://vsesezon.com.ua/ua/g{size}/", **size)).alias("next"))


#: Sections of the chained pages, and the pages after which one of them leads back.
GROUPS, BACK = 20, 997


@query(f"""WITH p AS (SELECT p_partkey AS k, p_partkey % {GROUPS} AS g, p_partkey // {GROUPS} AS i, p_size % 4 AS n FROM part WHERE p_partkey % 101 > 0),
stops AS (SELECT g, min(i) AS last FROM p WHERE i % {BACK} = {BACK - 1} OR NOT EXISTS (SELECT 1 FROM p q WHERE q.g = p.g AND q.i = p.i + 1) GROUP BY g)
SELECT 'https://vsesezon.com.ua/ua/g' || g || '/page_0/' AS start, count(*) AS pages, sum(n)::BIGINT AS rows, 'Група ' || g || ', сторінка 0' AS title
FROM p JOIN stops USING (g) WHERE i <= least(last, {consolidate.PAGE_LIMIT} - 1) AND g IN (SELECT g FROM p WHERE i = 0) GROUP BY g""")
def crawl_chain(spark, d):
    """Saved pages linked by rel=next in chains that end, lead back or break off, followed from the first page of each section."""
    p = spark.read.parquet(f"{d}/part.parquet").where("p_partkey % 101 > 0")
    g, i = F.col("p_partkey") % GROUPS, F.expr(f"p_partkey div {GROUPS}")
    to = F.when(i % BACK == BACK - 1, i - 5).otherwise(i + 1)
    html = filled(
        '<html><head><title>Група {g}, сторінка {i}</title><link rel="next" href="/ua/g{g}/page_{to}?x=1"></head><body><ul>{items}</ul></body></html>',
        g=g, i=i, to=to, items=F.repeat(F.lit('<li class="product"></li>'), (F.col("p_size") % 4).cast("int")),
    )
    saved = p.select(filled("https://vsesezon.com.ua/ua/g{g}/page_{i}/", g=g, i=i).alias("url"), html.alias("html"))
    read = saved.select("url", urls.canonical(pages.next_page(F.col("html"), F.col("url"))).alias("next_url"), pages.title(F.col("html")).alias("title"), F.size(F.regexp_extract_all("html", F.lit('<li class="product"'), F.lit(0))).cast("long").alias("n_rows"))
    starts = read.where(F.col("url").endswith("/page_0/")).select(F.col("url").alias("start"))
    return consolidate.chain_stats(consolidate.chains(read, starts), read).select("start", "pages", "rows", "title")


@query("""SELECT DISTINCT CASE p_partkey % 7 WHEN 0 THEN 'https://' ELSE 'https://www.' END || 'et-market.com.ua/teplyj-pol/s-' || p_size || '/' AS url FROM part WHERE p_partkey % 7 IN (0, 1)""")
def section_urls(spark, d):
    base, case = "https://et-market.com.ua/teplyj-pol/", F.col("key") % 7
    s = {"size": F.col("size")}
    link = (
        F.when(case == 0, filled(base + "s-{size}/", **s)).when(case == 1, filled("https://www.et-market.com.ua/teplyj-pol//s-{size}?page=2#top", **s)).when(case == 2, filled(base + "s-{size}.html", **s))
        .when(case == 3, filled(base + "f-{size}/?filter=1", **s)).when(case == 4, filled("https://other.example/teplyj-pol/o-{size}/", **s)).when(case == 5, base).otherwise(filled("https://et-market.com.ua/blog/b-{size}/", **s))
    )
    return pages.section_urls(parts_of(spark, d).select(link.alias("link")), "et-market.com.ua", ["teplyj-pol"], 2)


@query("""SELECT DISTINCT 'https://vsesezon.com.ua/ua/g' || p_partkey // 3 || '-mat/' AS url FROM part WHERE p_partkey % 5 IN (0, 1)""")
def group_urls(spark, d):
    case, k = F.col("key") % 5, {"g": F.expr("key div 3")}
    link = (
        F.when(case == 0, filled("https://vsesezon.com.ua/ua/g{g}-mat", **k)).when(case == 1, filled("https://vsesezon.com.ua/g{g}-mat/?page=3", **k)).when(case == 2, filled("https://vsesezon.com.ua/ua/g{g}-mat.html", **k))
        .when(case == 3, filled("https://other.example/ua/g{g}-mat/", **k)).otherwise(filled("https://vsesezon.com.ua/ua/p{g}-mat/", **k))
    )
    return pages.group_urls(parts_of(spark, d).select(link.alias("link")), "vsesezon.com.ua")


@query(f"""WITH {_PARTS} SELECT key AS page, key::VARCHAR AS "externalId", 'https://vsesezon.com.ua/ua/p' || key || '-x.html' AS "sourceUrl", 'vsesezon-' || key AS slug, name AS "nameUk",
  CASE WHEN size > 10 THEN 'S-' || key END AS sku, CASE WHEN price IS NOT NULL THEN price + CASE WHEN key % 3 = 0 THEN 0.5 ELSE 0 END END::DOUBLE AS "priceUah", price IS NOT NULL AS "priceVisible",
  'https://img.example/' || key || '.jpg' AS "imageUrl", 'https://vsesezon.com.ua/ua/g' || size || '/' AS "sourceCategoryUrl", CASE WHEN size % 2 = 0 THEN 2 ELSE 1 END AS n_images, CASE WHEN size > 20 THEN brand END AS brand FROM parts""")
def json_ld_products(spark, d):
    p = dealt(parts_of(spark, d))
    c = {x: F.col(x) for x in p.columns}
    price = (
        F.when(c["price"].isNull(), '"@type":"Offer"').when(c["key"] % 3 == 0, filled('"@type":"Offer","price":"{price},50"', **c))
        .when(c["key"] % 3 == 1, filled('"@type":"AggregateOffer","lowPrice":{price},"highPrice":99999', **c)).otherwise(filled('"@type":"Offer","price":{price}', **c))
    )
    image = F.when(c["size"] % 2 == 0, filled('["https://img.example/{key}.jpg","https://img.example/{key}-2.jpg"]', **c)).otherwise(filled('"https://img.example/{key}.jpg"', **c))
    sku = F.when(c["size"] > 10, filled(',"sku":" S-{key} "', **c)).otherwise("")
    brand = F.when(c["size"] > 20, filled(',"brand":"{brand}"', **c)).otherwise("")
    item = filled('{"@type":"Product","name":" {name} ","description":"{kind}","image":{image}{sku}{made},"offers":{{price},"url":"/ua/p{key}-x.html"}}', **(c | {"price": price}), image=image, sku=sku, made=brand)
    # A broken block, a list with another kind of object, and the product again under another name, which must not count.
    html = filled('<html><script type="application/ld+json">{broken</script><script type="application/ld+json">[{"@type":"WebSite","name":"x"},{item}]</script><script type=\'application/ld+json\'>{again}</script></html>', broken=F.lit("{"), item=item, again=F.regexp_replace(item, '"name":" ', '"name":" again '))
    made = p.select(F.col("key").alias("page_id"), html.alias("html"), filled("https://vsesezon.com.ua/ua/g{size}", **c).alias("category"))
    found = pages.json_ld_products(made, F.col("category"))
    return found.select("page", "externalId", "sourceUrl", "slug", "nameUk", "sku", "priceUah", "priceVisible", "imageUrl", "sourceCategoryUrl", F.size("images").alias("n_images"), F.try_element_at("specs", F.lit(1))["value"].alias("brand"))


@query(SQL["shop_listings"])
def shop_listings_sql(spark, d):
    """The listing pages again, through the table function of SQL."""
    sql.register(spark)
    rows = "SELECT p.page, l.* FROM {made} p, LATERAL shop_listing(p.html, '%s', NULL) l"
    one, two = (spark.sql(rows % source, made=listing_pages(spark, d, source)) for source in ("et_market", "in_heat"))
    return one.union(two)


@query("""SELECT p_partkey AS page, greatest(1, p_size, p_partkey % 60)::INT AS last FROM part""")
def last_page(spark, d):
    html = filled(
        '<a href="?PAGEN_1=999">before</a><div id="pagenavigation"><a href="/ua/x/?PAGEN_1={size}">last</a><a href="/ua/x/?a=1&amp;PAGEN_1=1">1</a><div class="bx-pagination-container"><ul><li class="bx-active"><span> {n} </span></li><li><a href="#">next</a></li></ul></div></div>',
        size=F.col("size"), n=F.col("key") % 60,
    )
    return parts_of(spark, d).select(F.col("key").alias("page"), pages.last_page(html).alias("last"))


@query("""SELECT DISTINCT 'https://in-heat.kiev.ua/ua/' || CASE WHEN p_partkey % 7 = 1 THEN 'termoregulyatory/' ELSE 'otoplenie/s-' || p_size || '/' END AS url FROM part WHERE p_partkey % 7 IN (0, 1, 6)""")
def menu_urls(spark, d):
    """The second donor's menu: hubs and sections under given prefixes, in the catalogue's language."""
    base, case, s = "https://in-heat.kiev.ua/ua/", F.col("key") % 7, {"size": F.col("size")}
    link = (
        F.when(case == 0, filled(base + "otoplenie/s-{size}/", **s)).when(case == 1, base + "termoregulyatory").when(case == 2, filled(base + "otoplenie/p-{size}.html", **s))
        .when(case == 3, filled("https://in-heat.kiev.ua/otoplenie/s-{size}/", **s)).when(case == 4, filled(base + "tovary/s-{size}/", **s)).when(case == 5, filled("https://other.example/ua/otoplenie/s-{size}/", **s))
        .otherwise(filled("https://www.in-heat.kiev.ua/ua/otoplenie/s-{size}?x=1#top", **s))
    )
    links = trees.held(parts_of(spark, d).select(link.alias("link")))
    found = pages.section_urls(links, "in-heat.kiev.ua", [], 2, language="ua", prefixes=["/ua/otoplenie", "/ua/termoregulyatory/"])
    return found.select(F.regexp_replace("url", "//www\\.", "//").alias("url")).distinct()


@query(f"""WITH {_PARTS} SELECT key AS page, 'et_market' AS source, brand || 'Тип' || kind || ' Розмір ' || size AS text FROM parts UNION ALL SELECT key, 'in_heat', brand FROM parts""")
def card_descriptions(spark, d):
    """The texts of the cards' descriptions, which are markup."""
    found = pages.cards(card_pages(spark, d, "et_market"), "et_market", "key").union(pages.cards(card_pages(spark, d, "in_heat"), "in_heat", "key"))
    return found.select("page", "source", F.regexp_replace("descriptionHtml", "<[^>]*>", "").alias("text"))
