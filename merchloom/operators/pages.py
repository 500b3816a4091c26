"""Shop pages: what regular expressions and JSON functions can read stays in Catalyst; listings,
cards and facets need a document tree and go through Arrow batches, a page at a time.

What differs between the donors is a table of selectors; the evaluation is shared.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from urllib.parse import urlsplit

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import dom, text, urls
from ..functions.arrow import bound_batches
from ..sources.manifests import LISTING_DDL, PRODUCT_DDL

# -- Catalyst only ---------------------------------------------------------------------------


def is_blocked(html: Column) -> Column:
    """Pages of a robot check instead of the shop's; they belong in quarantine."""
    return html.contains("adm.tools") & html.contains("___ack")


def split_blocked(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(usable pages, quarantined pages)."""
    blocked = F.coalesce(is_blocked(F.col(html)), F.lit(False))
    return pages.where(~blocked), pages.where(blocked)


def title(html: Column, limit: int = 240) -> Column:
    """The page title with single spaces, cut to ``limit``; null without one."""
    found = F.substring(text.collapse(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]+)</title>", 1)), 1, limit)
    return F.when(found != "", found)


def heading(html: Column) -> Column:
    """The text of the first h1, without markup; null without one."""
    inner = F.regexp_extract(html, r"(?is)<h1\b[^>]*>(.*?)</h1>", 1)
    found = text.collapse(F.regexp_replace(inner, "(?s)<[^>]*>", ""))
    return F.when(found != "", found)


def hrefs(html: Column) -> Column:
    """The hrefs of all anchors, in order."""
    return F.regexp_extract_all(html, F.lit(r"""(?i)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def links(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page, link): distinct absolute links. References from the site's root, the usual ones, are
    resolved in the JVM, the others by ``urljoin`` in Arrow batches."""
    found = pages.select(F.col(id_col).alias("page"), F.col(url_col).alias("base"), F.explode(F.array_distinct(hrefs(F.col(html_col)))).alias("href"))
    found = found.where((F.trim("href") != "") & ~F.col("href").startswith("#") & ~F.lower("href").startswith("javascript:"))
    plain = F.col("href").startswith("/") & ~F.col("href").startswith("//")
    rooted = found.where(plain).select("page", F.concat(urls.origin_of(F.col("base")), "href").alias("link"))

    @F.pandas_udf("string")
    def joined(base: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([urls.resolve(r, b or "") for b, r in zip(base, ref)], dtype=object)

    other = found.where(~plain).select("page", joined("base", "href").alias("link"))
    return rooted.union(other).where("link IS NOT NULL").distinct()


def max_page(html: Column, parameter: str) -> Column:
    """The largest page number in links of a listing, 1 at least."""
    numbers = F.transform(F.regexp_extract_all(html, F.lit(rf"[?&;]{parameter}=([0-9]{{1,9}})"), F.lit(1)), lambda x: x.cast("int"))
    return F.greatest(F.lit(1), F.coalesce(F.array_max(numbers), F.lit(1)))


def last_page(html: Column) -> Column:
    """The largest page number in the links or the items of the second donor's page navigation, 1 at least."""
    block = F.regexp_extract(html, r"""(?is)<[^>]*\bid\s*=\s*["']pagenavigation["'].*""", 0)
    items = F.transform(F.regexp_extract_all(block, F.lit(r"(?is)<li[^>]*>\s*<span[^>]*>\s*([0-9]{1,9})\s*</span>"), F.lit(1)), lambda x: x.cast("int"))
    return F.greatest(max_page(block, "PAGEN_1"), F.coalesce(F.array_max(items), F.lit(1)))


def shown_counts(html: Column) -> Column:
    """The struct (from, to, total) of the line that tells which products a page shows."""
    # Fixed value: the shop's own words.
    pattern = r"(?iu)Показано\s+с\s+([0-9]+)\s+по\s+([0-9]+)\s+из\s+([0-9]+)"
    plain = F.regexp_replace(html, "(?s)<[^>]*>", " ")
    part = [F.regexp_extract(plain, pattern, i).try_cast("int").alias(n) for i, n in ((1, "showingFrom"), (2, "showingTo"), (3, "totalProducts"))]
    return F.struct(*part)


def pagination(html: Column) -> Column:
    """The struct (currentPage, totalPages, showingFrom, showingTo, totalProducts) of a listing page."""
    active = F.regexp_extract(html, r"""(?is)<li[^>]*class=["'][^"']*\bactive\b[^"']*["'][^>]*>\s*<span[^>]*>\s*([0-9]+)""", 1).try_cast("int")
    now = F.when(active > 0, active).otherwise(1)
    counts = shown_counts(html)
    return F.struct(now.alias("currentPage"), F.greatest(now, max_page(html, "page")).alias("totalPages"), *[counts[c].alias(c) for c in ("showingFrom", "showingTo", "totalProducts")])


def next_page(html: Column, base: Column) -> Column:
    """The link with rel=next, attributes in either order, made absolute from the site's root."""
    quoted = r"""\s*=\s*["']([^"']+)["']"""
    rel = r"""rel\s*=\s*["']next["']"""
    one, two = (F.regexp_extract(html, p, 1) for p in (rf"(?i)<link[^>]*{rel}[^>]*href{quoted}", rf"(?i)<link[^>]*href{quoted}[^>]*{rel}"))
    href = F.when(one != "", one).otherwise(two)
    return F.when(href == "", None).when(href.rlike("(?i)^https?://"), href).when(href.startswith("/"), F.concat(urls.origin_of(base), href)).otherwise(F.concat(F.regexp_replace(base, "[^/]*$", ""), href))


def json_ld(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, item): the objects of all JSON-LD blocks as variants; blocks that are no JSON are skipped."""
    scripts = F.regexp_extract_all(F.col(html_col), F.lit(r"""(?is)<script[^>]*type\s*=\s*["']application/ld\+json["'][^>]*>(.*?)</script>"""), F.lit(1))
    blocks = pages.select(F.col(id_col).alias("page"), F.posexplode(scripts).alias("block", "text")).withColumn("v", F.try_parse_json("text")).where("v IS NOT NULL")
    kind = F.schema_of_variant("v")
    listed = F.when(kind.startswith("ARRAY"), F.expr("try_variant_get(v, '$', 'array<variant>')")).otherwise(F.array("v"))
    return blocks.select("page", "block", F.posexplode(listed).alias("pos", "item"))


def offer_price(offers: Column) -> Column:
    """Price of an offer (a JSON text): the lower, or else the higher, of an aggregate; the first comma is a point."""
    value = lambda path: F.get_json_object(offers, path)
    raw = F.when(value("$['@type']") == "AggregateOffer", F.coalesce(value("$.lowPrice"), value("$.highPrice"))).otherwise(value("$.price"))
    plain = F.regexp_replace(F.regexp_replace(raw, text.SPACE, ""), "^([^,]*),", "$1.")
    return F.regexp_extract(plain, r"^([+-]?[0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")


def json_ld_products(pages: DataFrame, category: Column, id_col: str = "page_id", html_col: str = "html", source: str = "vsesezon", origin: str = "https://vsesezon.com.ua") -> DataFrame:
    """Products from JSON-LD, the first of each id on a page: (page, ...product). Entirely in the JVM."""
    get = lambda path, kind="string": F.expr(f"try_variant_get(item, '{path}', '{kind}')")
    is_text = lambda path: F.schema_of_variant(F.expr(f"try_variant_get(item, '{path}', 'variant')")) == "STRING"
    words = lambda path: F.when(is_text(path), text.js_trim(get(path)))
    offers = F.to_json(F.expr("try_variant_get(item, '$.offers', 'variant')"))
    url = text.js_trim(F.get_json_object(offers, "$.url"))
    absolute = F.when(url.rlike("(?i)^https?://"), url).when(url.startswith("/"), F.concat(F.lit(origin), url)).otherwise(F.concat(F.lit(origin + "/"), url))
    items = json_ld(pages.withColumn("__category", category), id_col, html_col).where(get('$["@type"]') == "Product")
    rows = items.select(
        "page", "block", "pos", absolute.alias("sourceUrl"), F.regexp_extract(absolute, r"(?i)/p([0-9]+)", 1).alias("externalId"), words("$.name").alias("nameUk"),
        words("$.description").alias("description"), words("$.sku").alias("sku"), words("$.brand").alias("brand"), offer_price(offers).alias("priceUah"),
        F.when(is_text("$.image"), F.array(get("$.image"))).otherwise(F.filter(F.coalesce(F.expr("try_variant_get(item, '$.image', 'array<string>')"), F.array().cast("array<string>")), lambda x: x.isNotNull())).alias("urls"),
    ).where((url.isNotNull()) & (F.col("externalId") != ""))
    # The first item of an id counts, even one without a name, which then gives no product.
    rest = [c for c in rows.columns if c not in ("page", "externalId")]
    first = rows.groupBy("page", "externalId").agg(F.min_by(F.struct(*rest), F.struct("block", "pos")).alias("r")).select("page", "externalId", "r.*").where("nameUk <> ''")
    where = pages.select(F.col(id_col).alias("page"), urls.canonical(category).alias("sourceCategoryUrl"))
    block = F.concat(F.lit('<div class="import-vsesezon-desc">'), text.escaped_html(F.col("description")), F.lit("</div>"))
    brand = F.struct(F.lit(None).cast("string").alias("group"), F.lit("Бренд").alias("label"), F.col("brand").alias("value"))
    return first.join(where, "page").select(
        "page", F.lit(source).alias("source"), "externalId", "sourceUrl", F.concat(F.lit(f"{source}-"), "externalId").alias("slug"), "nameUk", F.nullif("sku", F.lit("")).alias("sku"), "priceUah",
        (F.col("priceUah").isNotNull() & (F.col("priceUah") > 0)).alias("priceVisible"), F.try_element_at("urls", F.lit(1)).alias("imageUrl"), F.lit(None).cast("string").alias("bitrixOfferId"), "sourceCategoryUrl",
        text.shortened(F.col("description")).alias("shortDescription"), F.when(F.col("description") != "", block).alias("descriptionHtml"),
        F.transform("urls", lambda u: F.struct(u.alias("url"), F.lit(None).cast("string").alias("alt"))).alias("images"),
        F.when(F.col("brand") != "", F.array(brand)).otherwise(F.array().cast("array<struct<group:string,label:string,value:string>>")).alias("specs"),
    )


def section_urls(found: DataFrame, host: str, first: list[str], least_depth: int, column: str = "link", language: str | None = None, prefixes: list[str] | None = None) -> DataFrame:
    """(url): the distinct canonical section URLs among links: on the host, no page file, no filter or
    search query, no noise, the (language and) first segment among the given ones, deep enough."""
    link = F.col(column)
    parts, path = urls.segments(link), urls.path_of(link)
    ok = (F.regexp_replace(urls.host_of(link), r"^www\.", "") == host) & ~urls.is_page(link) & (F.size(parts) >= least_depth)
    query = F.lower(F.regexp_extract(link, r"\?([^#]*)", 1))
    ok = ok & ~query.contains("filter") & ~query.contains("search")
    if language:
        ok = ok & (F.try_element_at(parts, F.lit(1)) == language) & ~urls.is_noise(path)
    if first:
        ok = ok & F.try_element_at(parts, F.lit(1)).isin(first)
    if prefixes:
        ok = ok & urls.under_prefixes(path, prefixes)
    return found.where(ok).select(urls.canonical(link).alias("url")).distinct()


def group_urls(found: DataFrame, host: str, column: str = "link") -> DataFrame:
    """(url): group pages /ua/g123..., the language put in where it is missing."""
    link = F.regexp_replace(F.col(column), r"(?i)^(https?://[^/]+)/(g[0-9])", "$1/ua/$2")
    path = urls.path_of(link)
    ok = urls.host_of(link).contains(host) & path.rlike(r"(?i)^/ua/g[0-9]+") & ~path.rlike(r"(?i)\.(?:html?|php)$")
    return found.where(ok).select(urls.canonical(link).alias("url")).distinct()


# -- Document trees --------------------------------------------------------------------------

#: Where the parts of listing blocks and product cards stand, by donor: selectors, tried in order;
#: (selector, attribute) reads an attribute. Fixed values.
RULES: dict[str, dict] = {
    "et_market": {
        "base": "https://et-market.com.ua",
        "block": ".product-thumb", "link": (".prod-name a", ".caption h4 a, .caption .name a", ".image a"), "name": (),
        "digits": ("span.price_span", ("input.price-input", "value")), "price": (".price-new, .price",),
        "image": ((".image img", "src"), (".image img", "data-src"), ("a img", "src"), ("a img", "data-src")), "lazy": "lazy",
        "id": (("input.polt_id", "value"),), "id_pattern": r"cart\.add\('(\d+)'", "offer": (), "sku": (), "sku_pattern": r"Код:\s*(\d+)",
        "card": {
            "name": ("h1.cr-product-title", "#content h1", ".product-info h1", "h1.page-title"), "id": (('input[name="product_id"]', "value"),),
            "digits": (".pr_pr_in .price_span, .price_w .price_span, .card_inf_in .price_span",), "price": (".price_w, .product-info .price",), "sku": (), "sku_digits": ".sku, .model",
            "gallery": (("ul.thumbnails a.thumbnail", ("href",), "title"),), "main": (('img[itemprop="image"]', ("src",), "alt"),), "description": ('div[itemprop="description"]', "#tab-description, .product-description"),
            "tables": (('div[itemprop="description"] table.table-bordered tbody tr, div[itemprop="description"] table.table tbody tr', "td", False), ("#tab-specification table tr, .table-attribute tr", "td, th", True)),
            "url": (('link[rel="canonical"]', "href"),), "offer": (),
        },
    },
    "in_heat": {
        "base": "https://in-heat.kiev.ua",
        "block": "#catalogSection .productTable", "link": ("a.name",), "name": ("a.name span.middle",), "digits": (), "price": (".wrapper_price a.price",),
        "image": (("img.lazy", "data-lazy"), ("img.lazy", "src"), (".productColImage img", "src")), "lazy": "lazy.svg",
        "id": (), "id_pattern": None, "offer": (("a.addCart", "data-id"),), "sku": ("span.changeArticle1",), "sku_pattern": None,
        "card": {
            "name": ("h1.changeName", "h1#browse"), "id": (), "digits": (), "price": ("#catalogElement .wrapper_price a.price", ".wrapper_price a.price"),
            "sku": (('meta[itemprop="sku"]', "content"), ("#reviewAnd_article .changeArticle_replace.changeArticle2", "data-first-value"), ("#catalogElement span.changeArticle", "data-first-value"), "#catalogElement span.changeArticle"), "sku_digits": None,
            "og": 'meta[property="og:image"]', "gallery": (("#catalogElement .picture img, #pictureSlider img, .slidesBox img", ("data-lazy", "src"), "alt"),), "main": (), "description": ("#detailText .changeDescription",),
            "grouped": "#elementProperties table.stats tr", "tables": (), "url": (('link[rel="canonical"]', "href"), ('meta[property="og:url"]', "content")), "offer": (("#catalogElement a.addCart", "data-id"), ("a.addCart", "data-id")),
        },
    },
}
_SPACES = re.compile(r"\s+")
_PRICE = re.compile(r"([\d\s]+)\s*грн", re.I)


def _flat(value: str | None) -> str:
    return _SPACES.sub(" ", value or "").strip()


def _read(node: dom.Element, places: tuple) -> str | None:
    """The first text or attribute that is not blank among some places."""
    for place in places:
        selector, attribute = place if isinstance(place, tuple) else (place, None)
        found = node.first(selector)
        value = found and (found.get(attribute) if attribute else found.text())
        if value and value.strip():
            return value.strip()
    return None


def _price(node: dom.Element, rules: dict) -> float | None:
    for place in rules["digits"]:
        value = _read(node, (place,))
        if value and re.fullmatch("[0-9]+", value):
            return float(value)
    m = _PRICE.search(_flat(_read(node, rules["price"])))
    digits = m and _SPACES.sub("", m[1])
    return float(digits) if digits else None


def _stem(url: str) -> str:
    return re.sub(r"\.(html?|php)$", "", urlsplit(url).path.rstrip("/").rpartition("/")[2], flags=re.I) or "item"


def listing_items(html: str, source: str, category: str | None) -> list[dict]:
    """The listing rows of one page; the first of equal URLs."""
    rules, rows = RULES[source], {}
    for block in dom.parse(html).all(rules["block"]):
        link = block.first(*rules["link"])
        url = link and urls.resolve(link.get("href"), rules["base"])
        name = link and (_read(block, rules["name"]) or link.text().strip())
        if not url or not name or not re.search(r"\.html?$", urlsplit(url).path, re.I) or url in rows:
            continue
        slug, markup = _stem(url), block.inner() if rules["id_pattern"] or rules["sku_pattern"] else ""
        found = {k: re.search(p, markup) if (p := rules[f"{k}_pattern"]) else None for k in ("id", "sku")}
        number = _read(block, rules["id"])
        image = _read(block, rules["image"])
        price = _price(block, rules)
        rows[url] = {
            "source": source, "externalId": number if number and number.isdigit() else found["id"][1] if found["id"] else slug, "sourceUrl": url, "slug": slug, "nameUk": name,
            "sku": found["sku"][1] if found["sku"] else _read(block, rules["sku"]), "priceUah": price, "priceVisible": price is not None,
            "imageUrl": urls.resolve(image, rules["base"]) if image and rules["lazy"] not in image else None, "bitrixOfferId": _read(block, rules["offer"]), "sourceCategoryUrl": category,
        }
    return list(rows.values())


def _specs(page: dom.Element, rules: dict) -> list[dict]:
    group, out = None, []
    for row in page.all(rules["grouped"]) if "grouped" in rules else ():
        if "cap" in row.get("class").split() if row.get("class") else False:
            group = _flat(cell.text()) or None if (cell := row.first("td")) else None
            continue
        name, value = row.first("td.name span[itemprop=name]", "td.name"), row.first("td[itemprop=value]")
        label = name and ((name.get("content") or "").strip() or name.text().strip())
        shown = value and (_read(value, ("a",)) or _flat(value.text()))
        if label and shown:
            out.append({"group": group, "label": label, "value": shown})
    for selector, cell, distinct in rules["tables"]:
        if out:
            break
        for row in page.all(selector):
            cells = [_flat(c.text()) for c in row.all(cell)[:2]]
            if len(cells) == 2 and all(cells) and not (distinct and cells[0].lower() == cells[1].lower()):
                out.append({"group": None, "label": cells[0], "value": cells[1]})
    return out


def card(html: str, source: str, listing: dict | None = None) -> dict:
    """The product of one card; what the card lacks comes from its listing row."""
    rules, listing, page = RULES[source], listing or {}, dom.parse(html)
    own, base = rules["card"], rules["base"]
    name = _read(page, own["name"]) or listing.get("nameUk") or ""
    images: dict[str, str | None] = {}
    if "og" in own and (og := _read(page, ((own["og"], "content"),))):
        images[urls.resolve(og, base)] = name
    for places in ("gallery", "main"):
        for selector, attributes, alt in own[places] if not images or places == "gallery" else ():
            for node in page.all(selector):
                raw = next((v for a in attributes if (v := node.get(a))), None)
                if raw and "lazy.svg" not in raw and (url := urls.resolve(raw, base)):
                    images.setdefault(url, node.get(alt) or None)
    block = next((b for s in own["description"] if (b := page.first(s))), None)
    markup = block and re.sub(r'(\ssrc=")(/[^"]+)"', lambda m: f'{m[1]}{urls.resolve(m[2], base)}"', block.inner())
    url = next((u for place in own["url"] if (u := urls.resolve(_read(page, (place,)), base))), None) or listing.get("sourceUrl") or ""
    slug = listing.get("slug") or (_stem(url) if url else "item")
    price = _price(page, own)
    price = listing.get("priceUah") if price is None else price
    page_sku = _read(page, own["sku"]) or ((m := re.search(r"\d{4,}", _read(page, (own["sku_digits"],)) or "")) and m[0] if own["sku_digits"] else None)
    skus = (page_sku, listing.get("sku")) if source == "in_heat" else (listing.get("sku"), page_sku)
    return {
        "source": source, "externalId": _read(page, own["id"]) or listing.get("externalId") or slug, "sourceUrl": url, "slug": slug, "nameUk": name or slug,
        "sku": skus[0] or skus[1], "priceUah": price, "priceVisible": price is not None, "imageUrl": listing.get("imageUrl") or next(iter(images), None),
        "bitrixOfferId": _read(page, own["offer"]) or listing.get("bitrixOfferId"), "sourceCategoryUrl": listing.get("sourceCategoryUrl"),
        "shortDescription": _read(page, (('meta[name="description"]', "content"),)), "descriptionHtml": markup,
        "images": [{"url": u, "alt": a} for u, a in images.items()], "specs": _specs(page, own),
    }


def facet_groups(html: str) -> list[dict]:
    """The filter groups of a listing page: the price range, and groups of values with counts."""
    out = []
    for option in dom.parse(html).all("#ocfilter-content > .list-group-item.ocfilter-option"):
        name = _flat(n.text()) if (n := option.first(".option-name")) else ""
        scale = option.first("#scale-price.scale.ocf-target")
        if scale:
            ends = [scale.get(f"data-range-{x}") or "" for x in ("min", "max")]
            span = dict(zip(("min", "max"), map(int, ends))) if all(re.fullmatch("-?[0-9]+", x) for x in ends) else None
            out.append({"id": "price", "name": name or "Ціна", "values": [], "priceRangeUah": span})
            continue
        values = []
        for label in option.all(".option-values label"):
            target = label.first("input.ocf-target")
            shown, url = _flat(a.text()) if (a := label.first("a")) else "", (target.get("value") or "").strip() if target else ""
            key = re.search(r"ocfilter_filter\[([^\]]+)\]", (target.get("name") or "") if target else "")
            count = re.match("[0-9]+", _read(label, ("small.badge",)) or "")
            if shown and url:
                values.append({"filterKey": key[1] if key else "", "label": shown, "count": int(count[0]) if count else 0, "filterUrl": url})
        if name and values:
            out.append({"id": (option.get("id") or "").removeprefix("option-") or "unknown", "name": name, "values": values, "priceRangeUah": None})
    return out


_FACETS_DDL = "id string, name string, values array<struct<filterKey:string,label:string,count:int,filterUrl:string>>, priceRangeUah struct<min:int,max:int>"


#: Rows of a result that a worker holds at once, besides those of one page.
HELD_ROWS = 1000


def _by_page(pages: DataFrame, ddl: str, rows_of: Callable[[dict], list[dict]]) -> DataFrame:
    """(page, pos, ...): the rows that a function gives for each page. A worker holds a bounded batch of pages and ``HELD_ROWS`` rows."""
    bound_batches(pages.sparkSession)
    ddl = f"page {dict(pages.dtypes)['page']}, pos int, {ddl}"
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for values in zip(*batch.columns):
                r = {name: value.as_py() for name, value in zip(batch.schema.names, values)}
                held.extend({"page": r["page"], "pos": i} | x for i, x in enumerate(rows_of(r)))
                if len(held) >= HELD_ROWS:
                    yield pa.RecordBatch.from_pylist(held, schema)
                    held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema)

    return pages.mapInArrow(made, ddl)


def listings(pages: DataFrame, source: str, id_col: str = "page_id", html_col: str = "html", category: Column | None = None) -> DataFrame:
    """(page, pos, ...listing row) for every product block of every listing page."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"), (category if category is not None else F.lit(None).cast("string")).alias("category"))
    return _by_page(rows, LISTING_DDL, lambda r: listing_items(r["html"], source, r["category"]))


def cards(pages: DataFrame, source: str, id_col: str = "page_id", html_col: str = "html", listing_col: str | None = None) -> DataFrame:
    """(page, pos, ...product): one card for each page; ``listing_col`` holds its listing row as JSON."""
    rows = pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html"), (F.col(listing_col) if listing_col else F.lit(None).cast("string")).alias("listing"))
    return _by_page(rows, PRODUCT_DDL, lambda r: [card(r["html"], source, json.loads(r["listing"]) if r["listing"] else None)])


def facets(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(page, pos, id, name, values, priceRangeUah) for every filter group of every listing page."""
    return _by_page(pages.select(F.col(id_col).alias("page"), F.col(html_col).alias("html")), _FACETS_DDL, lambda r: facet_groups(r["html"]))


def snapshots(pages: DataFrame, source: str = "et_market", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Per listing page: pagination, number of products and number of filter groups."""
    products = listings(pages, source, id_col, html_col).groupBy("page").agg(F.count("*").alias("n_products"))
    groups = facets(pages, id_col, html_col).groupBy("page").agg(F.count("*").alias("n_filters"))
    base = pages.select(F.col(id_col).alias("page"), pagination(F.col(html_col)).alias("p")).select("page", "p.*")
    return base.join(products, "page", "left").join(groups, "page", "left").fillna(0, ["n_products", "n_filters"])
