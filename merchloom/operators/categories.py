"""Donor category URLs on the own category tree."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text, urls
from . import trees

#: Slugs of the own tree. Fixed values.
ROOT, MATS, CABLES = "tepla-pidloga", "nagrivalni-maty", "griuchi-kabeli"
PROTECTED = (ROOT, MATS, CABLES)
#: Roots of former imports. Fixed values.
STALE_ROOTS = ("et-market-import", "in-heat-import")


@dataclass(frozen=True)
class Donor:
    """How one donor's category URLs become flat categories."""

    source: str
    host: str
    prefix: str
    deep_prefix: str
    sort_base: int
    labels: dict[str, str] = field(default_factory=dict)
    sort_orders: dict[str, int] = field(default_factory=dict)
    sort_default: int = 0
    showcase: tuple[tuple[str, tuple[str, ...]], ...] = ()
    showcase_root: str | None = None
    language_segment: str | None = None


#: The donors of the catalogue: their hosts, labels, orders and path parts that lead to own sections. Fixed values.
DONORS = (
    Donor(
        "et_market", "et-market.com.ua", "et-", "etm-", 100,
        {
            "teplyj-pol": "Тепла підлога", "termoregulyatory": "Терморегулятори", "snegotayanie": "Сніготанення", "avtomatika": "Автоматика",
            "kondicionery": "Кондиціонери", "akvastorozh": "Аквасторож", "shitovoe-oborudovanie": "Щитове обладнання",
        },
        {"teplyj-pol": 0, "termoregulyatory": 10, "snegotayanie": 20, "avtomatika": 30, "kondicionery": 40, "akvastorozh": 50, "shitovoe-oborudovanie": 60},
        9000, ((CABLES, ("nagrevatelnyj-kabel", "woks-pol")), (MATS, ("nagrevatelnye-maty",))), "teplyj-pol",
    ),
    Donor(
        "in_heat", "in-heat.kiev.ua", "inh-", "inh-", 200,
        {
            "otoplenie": "Опалення та тепла підлога", "termoregulyatory": "Терморегулятори", "sistema-antiobledeneniya": "Сніготанення та антиобледеніння",
            "electrotovary": "Реле напруги та зарядні станції", "tovary": "Супутні товари (підлога)",
        },
        {"otoplenie": 10, "termoregulyatory": 20, "sistema-antiobledeneniya": 30, "electrotovary": 40, "tovary": 50, "misc": 5},
        60, ((CABLES, ("kabel-pod-plitku", "nagrevatelnyj-kabel")), (MATS, ("alyuminivye-nagrevatelnye-maty", "nagrevatelnye-maty"))), None, "ua",
    ),
    Donor("vsesezon", "vsesezon.com.ua", "vs-", "vs-", 400),
)
SOURCES = [d.source for d in DONORS]
GROUP_MODULUS = 8000


class _Url:
    """The parts of a URL that the rules read, as Columns: of a URL column, or of columns that hold them already."""

    def __init__(self, url: Column | None = None):
        self.host = F.col("host") if url is None else urls.host_of(url)
        self.parts = F.col("parts") if url is None else urls.segments(url)
        self.path = F.col("path") if url is None else urls.path_of(url)

    @staticmethod
    def columns(url: Column) -> list[Column]:
        return [urls.host_of(url).alias("host"), urls.segments(url).alias("parts"), urls.path_of(url).alias("path")]

    def part(self, i: int) -> Column:
        return F.try_element_at(self.parts, F.lit(i))


def _by_source(source: Column, value) -> Column:
    """A value for each donor."""
    return reduce(lambda out, d: F.when(source == d.source, value(d)).otherwise(out), reversed(DONORS), F.lit(None))


def group_id(url: Column) -> Column:
    """The digits of a last segment g123...; '0' without."""
    return _group_id(_Url(url))


def _group_id(u: _Url) -> Column:
    digits = F.regexp_extract(F.coalesce(u.part(-1), F.lit("")), r"(?i)^g([0-9]+)", 1)
    return F.when(digits == "", "0").otherwise(digits)


def flat_segment(url: Column, donor: Donor) -> Column:
    """The first segment, or the one after the language; 'misc' without."""
    return _segment(_Url(url), donor)


def _segment(u: _Url, donor: Donor) -> Column:
    if donor.source == "vsesezon":
        return _group_id(u)
    first = F.coalesce(u.part(1), F.lit("misc"))
    if donor.language_segment is None:
        return first
    return F.when((first == donor.language_segment) & (F.size(u.parts) >= 2), u.part(2)).otherwise(first)


def showcase(source: Column, url: Column) -> Column:
    """The own section that a donor URL clearly leads to; else null."""
    return _showcase(source, _Url(url))


def _showcase(source: Column, u: _Url) -> Column:
    path = F.lower(u.path)

    def section(donor: Donor) -> Column:
        found = F.lit(None).cast("string")
        for slug, parts in reversed(donor.showcase):
            found = F.when(reduce(lambda a, b: a | b, [path.contains(p) for p in parts]), slug).otherwise(found)
        return F.when(F.lower(u.part(1)) == donor.showcase_root, found) if donor.showcase_root else found

    return _by_source(source, section)


def humanized(segment: Column) -> Column:
    return F.coalesce(F.nullif(text.collapse(F.replace(segment, F.lit("-"), F.lit(" "))), F.lit("")), segment)


def category_slug(source: Column, url: Column) -> Column:
    """The category of a product: the root without a URL, an own section, or the donor's flat category.
    Null: the source is unknown or the URL is not the donor's; such rows belong in quarantine."""
    return _category_slug(source, url, _Url(url))


def _category_slug(source: Column, url: Column, u: _Url) -> Column:
    own = _by_source(source, lambda d: F.coalesce(u.host, F.lit("")).contains(d.host))
    flat = F.when(own, _by_source(source, lambda d: F.substring(F.concat(F.lit(d.prefix), _segment(u, d)), 1, 200)))
    blank = F.coalesce(url, F.lit("")) == ""
    return F.when(source.isin(SOURCES) & blank, ROOT).otherwise(F.coalesce(F.when(source.isin(SOURCES), _showcase(source, u)), flat))


def longest_titles(keys: DataFrame, titles: DataFrame) -> DataFrame:
    """The longest title below each path prefix, the earlier of equals: ``keys`` (prefix), ``titles`` (path,
    title, position). Titles are exploded into the prefixes of their paths, so this is an equi-join."""
    parts = F.array_remove(F.split("path", "/"), "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("parts"), F.lit(1))), lambda i: F.concat(F.lit("/"), F.array_join(F.slice("parts", 1, i), "/")))
    below = titles.withColumn("parts", parts).where(F.size("parts") > 0).select("title", "position", F.explode(prefixes).alias("prefix"))
    best = below.groupBy("prefix").agg(F.max_by("title", F.struct(F.length("title"), -F.col("position"))).alias("title"))
    return keys.join(best, "prefix", "left").select("prefix", "title")


def flat_categories(urls_seen: DataFrame, titles: DataFrame) -> DataFrame:
    """(slug, name_uk, parent_slug, sort_order, keep_sort) of the flat categories that ``urls_seen`` (source, url)
    needs; ``titles`` (url, title, position) are the crawled titles."""
    # URLs are taken apart once and the parts held: folded into every rule, their expressions outgrow code generation.
    # Slugs are few: names are looked up for the distinct slugs.
    parsed = trees.held(urls_seen.distinct().select("source", "url", *_Url.columns(F.col("url"))))
    slugged = parsed.select("source", "url", _category_slug(F.col("source"), F.col("url"), _Url()).alias("slug"), _by_source(F.col("source"), lambda d: _segment(_Url(), d)).alias("segment"))
    seen = slugged.where(F.col("slug").isNotNull() & ~F.col("slug").isin(*PROTECTED))
    grouped = F.col("source") == "vsesezon"
    paths = titles.select(urls.path_of(F.col("url")).alias("path"), "title", "position").where("path IS NOT NULL")
    lead = F.when(F.col("source") == "in_heat", "/ua/").otherwise("/")
    keyed = seen.where(~grouped).select("source", "slug", "segment").distinct().withColumn("prefix", F.concat(lead, "segment"))
    titled = keyed.join(longest_titles(keyed.select("prefix").distinct(), paths), "prefix", "left")
    named = [d for d in DONORS if d.labels]
    label = _by_key(named, lambda d: d.labels, F.substring(F.coalesce(F.nullif("title", F.lit("")), humanized(F.col("segment"))), 1, 240))
    base = {d.source: d.sort_base for d in DONORS}
    order = _by_source(F.col("source"), lambda d: F.lit(d.sort_base + d.sort_default))
    order = _by_key(named, lambda d: {k: base[d.source] + v for k, v in d.sort_orders.items()}, order)
    flat = titled.select("slug", label.alias("name_uk"), order.cast("int").alias("sort_order"), F.lit(False).alias("keep_sort"))
    # Groups are named by the crawled title of their page.
    by_url = titles.groupBy(urls.canonical(F.col("url")).alias("key")).agg(F.max_by("title", "position").alias("by_url"))
    pages = seen.where(grouped).select("slug", "segment", urls.canonical(F.col("url")).alias("key")).join(by_url, "key", "left")
    title = F.max(F.coalesce("by_url", F.concat(F.lit("Vsesezon · група "), "segment")))
    number = F.pmod(F.min("segment").cast("long"), F.lit(GROUP_MODULUS))
    groups = pages.groupBy("slug").agg(title.alias("name_uk"), (base["vsesezon"] + number).cast("int").alias("sort_order"), F.lit(True).alias("keep_sort"))
    return flat.unionByName(groups).withColumn("parent_slug", F.lit(ROOT))


def _by_key(donors: list[Donor], table_of, default: Column) -> Column:
    """The entry of a donor's table for the segment, or else the default: one lookup in a constant map."""
    pairs = [x for d in donors for k, v in table_of(d).items() for x in (F.lit(f"{d.source}/{k}"), F.lit(v))]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.concat_ws("/", "source", "segment")), default)


def deep_tree(urls_seen: DataFrame, titles: DataFrame) -> DataFrame:
    """(slug, name_uk, parent_slug, sort_order): one category for each prefix of the paths of ``urls_seen``
    (url, prefix), with its crawled title or its humanised segment."""
    parts = urls.segments(F.col("url"))
    levels = urls_seen.distinct().withColumn("parts", parts).where(F.size("parts") > 0)
    levels = levels.select("prefix", "parts", urls.origin_of(F.col("url")).alias("origin"), F.explode(F.sequence(F.lit(1), F.size("parts"))).alias("i"))
    joined = lambda n: F.substring(F.concat("prefix", F.array_join(F.slice("parts", 1, n), "-")), 1, 200)
    key = F.concat("origin", F.lit("/"), F.array_join(F.slice("parts", 1, F.col("i")), "/"), F.lit("/"))
    rows = levels.select(joined(F.col("i")).alias("slug"), F.when(F.col("i") > 1, joined(F.col("i") - 1)).otherwise(ROOT).alias("parent_slug"), (F.col("i") * 10).alias("sort_order"), key.alias("key"), F.element_at("parts", F.col("i")).alias("segment")).distinct()
    by_url = titles.groupBy(urls.canonical(F.col("url")).alias("key")).agg(F.max_by("title", "position").alias("title"))
    named = rows.join(by_url, "key", "left").withColumn("name_uk", F.substring(F.coalesce(F.nullif("title", F.lit("")), humanized(F.col("segment"))), 1, 240))
    # Truncated or dashed segments can meet in one slug; the last in order of the key stays, as repeated upserts leave it.
    return named.groupBy("slug").agg(F.max_by(F.struct("name_uk", "parent_slug", "sort_order"), "key").alias("r")).select("slug", "r.*")


def rebucketed(products: DataFrame) -> DataFrame:
    """``products`` (…, external_source, source_category_url, category_slug) with the category that the URL leads
    to, and whether it differs; products that lead nowhere stay."""
    target = F.when(F.col("external_source").isin(SOURCES), showcase(F.col("external_source"), text.js_trim(F.col("source_category_url"))))
    moved = target.isNotNull() & ~target.eqNullSafe(F.col("category_slug"))
    return products.withColumn("moved", moved).withColumn("category_slug", F.coalesce(target, F.col("category_slug")))


def is_legacy_slug(slug: Column) -> Column:
    return slug.rlike(r"^(?:etm-|inh-ua(?:-|$))") & ~slug.isin(*PROTECTED)


def prune_legacy(sections: DataFrame, used: DataFrame) -> DataFrame:
    """(id, kept) of ``sections`` (id, slug, parent): legacy leaves without products go until none is left; then the
    stale roots go that have neither sections nor products any more. ``used`` (id): the sections of products. A null slug is neither legacy nor stale."""
    occupied = used.select("id").distinct().withColumn("occupied", F.lit(True))
    nodes = sections.select("id", F.coalesce("slug", F.lit("")).alias("slug"), "parent").join(occupied, "id", "left").withColumn("occupied", F.coalesce("occupied", F.lit(False)))
    judged = trees.marked(nodes, F.col("occupied"), ~is_legacy_slug(F.col("slug")))
    parents = judged.where("kept AND parent IS NOT NULL").select(F.col("parent").alias("id")).distinct().withColumn("above", F.lit(True))
    stale = F.col("slug").isin(*STALE_ROOTS) & ~F.col("occupied") & F.col("above").isNull()
    return judged.join(parents, "id", "left").select("id", (F.col("kept") & ~stale).alias("kept"))
