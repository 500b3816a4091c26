"""The page parsers as table functions of SQL: ``SELECT p.url, l.* FROM pages p, LATERAL shop_listing(p.html, 'et_market', p.url) l``."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import pages
from ..sources.manifests import LISTING_DDL, PRODUCT_DDL
from .arrow import bound_batches


class ShopListing:
    """Listing rows of a page (html, source, category URL), with their place."""

    def eval(self, html: str, source: str, category: str):
        for pos, row in enumerate(pages.listing_items(html, source, category) if html else []):
            yield pos, *row.values()


class ShopCard:
    """The product of a card page (html, source, listing row as JSON)."""

    def eval(self, html: str, source: str, listing: str):
        if html:
            row = pages.card(html, source, json.loads(listing) if listing else None)
            yield *list(row.values())[:-2], [(i["url"], i["alt"]) for i in row["images"]], [(s["group"], s["label"], s["value"]) for s in row["specs"]]


class ShopFacets:
    """Filter values of a listing page (html): a row for each value, and one without a value for a price range."""

    def eval(self, html: str):
        for pos, group in enumerate(pages.facet_groups(html) if html else []):
            span = group["priceRangeUah"] or {}
            for value in group["values"] or [{}]:
                yield pos, group["id"], group["name"], span.get("min"), span.get("max"), value.get("filterKey"), value.get("label"), value.get("count"), value.get("filterUrl")


#: Name, class and columns of each table function; the arguments are those of ``eval``. Null pages give no rows.
FUNCTIONS = (
    ("shop_listing", ShopListing, f"pos int, {LISTING_DDL}"),
    ("shop_card", ShopCard, PRODUCT_DDL),
    ("shop_facets", ShopFacets, "pos int, id string, name string, price_min int, price_max int, filterKey string, label string, `count` int, filterUrl string"),
)


def register(spark: SparkSession) -> None:
    """Makes the table functions known to a session; arguments and rows go to Python and back in Arrow batches."""
    bound_batches(spark)
    for name, kind, columns in FUNCTIONS:
        spark.udtf.register(name, F.udtf(kind, returnType=columns, useArrow=True))
