"""One row per key from many: last, first and deepest wins; detail rows over listing rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls
from .trees import held

#: Most pages of one crawl. Fixed value.
PAGE_LIMIT = 400


def _winner(df: DataFrame, keys: list[str], by: Column, first: Column, largest: bool) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    pick = (F.max_by if largest else F.min_by)(F.struct(*rest), by)
    return df.groupBy(*keys).agg(pick.alias("r"), F.min(first).alias("position")).select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest], "position")


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key in ``order``, at the position of the key's first row."""
    return _winner(df, keys, F.struct(*order), F.struct(*order), True)


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in ``order``."""
    return _winner(df, keys, F.struct(*order), F.struct(*order), False)


def deepest_wins(df: DataFrame, keys: list[str], url_col: str, order: list[str]) -> DataFrame:
    """The row with the deepest URL of each key, the later one of equals, with that URL canonical."""
    placed = df.withColumn("depth", urls.depth(F.col(url_col)))
    won = _winner(placed, keys, F.struct("depth", *order), F.struct(*order), True).drop("depth")
    return won.withColumn(url_col, urls.canonical(F.col(url_col)))


def enrich(listing: DataFrame, detail: DataFrame, keys: list[str]) -> DataFrame:
    """Listing rows with their details: the longer description; the detail's short description;
    images and specs of the detail where it has as many; code and price stay where present;
    visible if either is."""
    a, b = listing.alias("a"), detail.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys]

    def longer(c):
        return F.when(F.coalesce(F.length(f"b.{c}"), F.lit(0)) > F.coalesce(F.length(f"a.{c}"), F.lit(0)), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    def larger(c):
        size = lambda x: F.coalesce(F.size(x), F.lit(0))
        return F.when(F.col(f"b.{keys[0]}").isNotNull() & (size(F.col(f"b.{c}")) >= size(F.col(f"a.{c}"))), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))

    rules = {
        "descriptionHtml": longer, "images": larger, "specs": larger,
        "shortDescription": lambda c: F.coalesce(f"b.{c}", f"a.{c}"),
        "sku": lambda c: F.coalesce(f"a.{c}", f"b.{c}"), "priceUah": lambda c: F.coalesce(f"a.{c}", f"b.{c}"),
        "priceVisible": lambda c: F.col(f"a.{c}") | F.coalesce(f"b.{c}", F.lit(False)),
    }
    return a.join(b, on, "left").select(*[rules[c](c).alias(c) if c in rules and c in detail.columns else F.col(f"a.{c}") for c in listing.columns])


LISTING = ("source", "externalId", "sourceUrl", "slug", "nameUk", "sku", "priceUah", "priceVisible", "imageUrl", "bitrixOfferId", "sourceCategoryUrl")


def as_listing(products: DataFrame) -> DataFrame:
    """The listing columns of full products."""
    return products.select(*[c for c in LISTING if c in products.columns])


def as_product(listing: DataFrame) -> DataFrame:
    """Listing rows as products without details: the listing's image, no specs."""
    image = F.array(F.struct(F.col("imageUrl").alias("url"), F.col("nameUk").alias("alt")))
    none = F.array().cast("array<struct<url:string,alt:string>>")
    return (
        listing.withColumn("shortDescription", F.lit(None).cast("string"))
        .withColumn("descriptionHtml", F.lit(None).cast("string"))
        .withColumn("images", F.when(F.col("imageUrl").isNotNull(), image).otherwise(none))
        .withColumn("specs", F.array().cast("array<struct<group:string,label:string,value:string>>"))
    )


def crawl_stats(pages: DataFrame, category: str, page: str, title: str, order: str) -> DataFrame:
    """Pages, rows and the first title of each category."""
    return pages.groupBy(category).agg(F.countDistinct(page).alias("pages"), F.count("*").alias("rows"), F.min_by(title, order).alias("title"))


def chains(pages: DataFrame, starts: DataFrame, limit: int = PAGE_LIMIT) -> DataFrame:
    """(start, url, place): the pages that a crawl from each of ``starts`` (start) visits by following the ``pages``' links (url, next_url), numbered
    from 0. It ends at a page that is not there or leads nowhere, before a page that it has seen, or after ``limit`` pages.

    The steps of all crawls are ranked together: each round knows twice as many of a crawl's first pages, by links of
    twice the length, so there are as many rounds as the logarithm of the longest crawl (or of the limit)."""
    saved = pages.groupBy("url").agg(F.min("next_url").alias("next_url"))
    hop = held(saved.where("next_url IS NOT NULL AND next_url <> url").join(saved.select(F.col("url").alias("next_url")), "next_url", "left_semi").select("url", "next_url"))
    seen = held(starts.select("start").distinct().join(saved, F.col("start") == F.col("url")).select("start", "url", F.lit(0).alias("place")))
    step, count = 1, seen.count()
    while step < limit:
        more = seen.join(hop, "url").select("start", F.col("next_url").alias("url"), (F.col("place") + step).alias("place"))
        # A page seen before keeps its first place: what follows it is known too.
        seen = held(seen.union(more).groupBy("start", "url").agg(F.min("place").alias("place")))
        now = seen.count()
        if now == count:
            break
        count, step = now, step * 2
        above = hop.select(F.col("url").alias("next_url"), F.col("next_url").alias("further"))
        hop = held(hop.join(above, "next_url").select("url", F.col("further").alias("next_url")))
    return seen.where(F.col("place") < limit)


def chain_stats(visited: DataFrame, pages: DataFrame) -> DataFrame:
    """(start, pages, rows, title) of the crawls ``visited`` (start, url, place): how many pages, the rows on them and the first page's title, of ``pages`` (url, n_rows, title)."""
    own = pages.groupBy("url").agg(F.max("n_rows").alias("n_rows"), F.min("title").alias("title"))
    return visited.join(own, "url").groupBy("start").agg(F.count("*").alias("pages"), F.sum("n_rows").alias("rows"), F.min_by("title", "place").alias("title"))


def detailed(products: DataFrame) -> Column:
    """Number of rows with a description or a spec."""
    return F.count_if(F.col("descriptionHtml").isNotNull() | (F.size("specs") > 0))


def pending_details(stubs: DataFrame, done: DataFrame, first: int, last: int, keys: list[str]) -> DataFrame:
    """Rows of the ordinal range [first, last) whose details are not written yet: what a resumed
    crawl has left to do."""
    return stubs.where(F.col("ordinal").between(first, last - 1)).join(done.select(*keys).distinct(), keys, "left_anti")
