"""Rules of the catalogue against plain versions, on small tables."""

import json
import random

import pandas as pd
import pytest
from merchloom.functions import text
from merchloom.operators import categories, consolidate, maintenance, pages, reports, serving, similarity, trees, upsert
from merchloom.plans import catalogue, imports, proxies
from merchloom.sources import manifests, tables
from pyspark.sql import functions as F


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def plain_resolve(rows, order, least):
    """Row by row: all pairs of a block, most similar first."""
    pairs = []
    for i, (id_a, key_a, src_a) in enumerate(rows):
        for id_b, key_b, src_b in rows[i + 1 :]:
            if src_a != src_b and key_a[:12] == key_b[:12] and min(len(key_a), len(key_b)) >= 15:
                s = 1 - distance(key_a, key_b) / max(len(key_a), len(key_b))
                if s >= least:
                    pairs.append((-s, id_a, id_b))
    source, to = {r[0]: r[2] for r in rows}, {}

    def end(x):
        while x in to:
            x = to[x]
        return x

    for _, a, b in sorted(pairs):
        a, b = end(a), end(b)
        if source[a] != source[b]:
            keep, lose = sorted((a, b), key=lambda x: (order.index(source[x]), x))
            to[lose] = keep
    return {x: end(x) for x in to}


@pytest.mark.parametrize("seed", range(4))
def test_resolve_matches_the_sequential_version(spark, seed):
    """Without repeated names within a source the two agree pointer by pointer."""
    rng, order = random.Random(seed), ["et_market", "in_heat", "vsesezon"]
    rows, seen = [], set()
    while len(rows) < 40:
        key = "nagriv mat 0" + "".join(rng.choice("ab") for _ in range(rng.choice((6, 7, 8))))
        source = rng.choice(order)
        if (key, source) not in seen:
            seen.add((key, source))
            rows.append((len(rows), key, source))
    got = similarity.resolve(spark.createDataFrame(rows, "id long, key string, source string"), order)
    pointers = {r["loser"]: r["canonical"] for r in got.collect()}

    def end(x):
        while x in pointers:
            x = pointers[x]
        return x

    assert {x: end(x) for x in pointers} == plain_resolve(rows, order, similarity.MERGE)


def test_resolve_moves_all_copies(spark):
    rows = [(i, "the same long name of a mat", "vsesezon") for i in range(20)] + [(50, "the same long name of a mat", "et_market"), (51, "the same long name of a mat", "et_market")]
    rows += [(60, None, "et_market"), (61, "short", "in_heat"), (62, "the same long name of a mat", None)]
    got = similarity.resolve(spark.createDataFrame(rows, "id long, key string, source string"), categories.SOURCES)
    assert {r["loser"]: r["canonical"] for r in got.collect()} == {i: 50 for i in range(20)}


def test_link_counts_match_all_pairs(spark):
    rng = random.Random(3)
    rows = [(i, None if i % 11 == 0 else "abcdefghijkl" + "".join(rng.choice("xy") for _ in range(rng.choice((2, 5, 6)))), None if i % 13 == 0 else f"s{i % 3}") for i in range(60)]
    usable = [r for r in rows if r[1] and len(r[1]) >= 15 and r[2]]
    want = {}
    for i, k, s in rows:
        near = [1 - distance(k, k2) / max(len(k), len(k2)) for _, k2, s2 in usable if s2 != s] if (i, k, s) in usable else []
        cls = min(j for j, k2, _ in usable if k2 == k) if (i, k, s) in usable else i
        want[i] = (cls, sum(x >= 0.9 for x in near), sum(0.75 <= x < 0.9 for x in near))
    got = similarity.link_counts(spark.createDataFrame(rows, "id long, key string, source string"))
    assert {r["id"]: tuple(r)[1:] for r in got.collect()} == {i: w if rows[i] in usable else (w[0], 0, 0) for i, w in want.items()}


def test_deepest_wins_takes_the_later_of_equals(spark):
    rows = [("p", "https://h/a/b/", 0, "A"), ("p", "https://h/c/d/?x", 1, "B"), ("p", "https://h/z", 2, "C"), ("q", None, 3, "D")]
    got = consolidate.deepest_wins(spark.createDataFrame(rows, "key string, url string, seq long, name string"), ["key"], "url", ["seq"])
    assert {r["key"]: (r["name"], r["url"], r["position"][0]) for r in got.collect()} == {"p": ("B", "https://h/c/d/", 0), "q": ("D", None, 3)}


def test_enrich(spark):
    empty = "array<struct<url:string,alt:string>>"
    ddl = f"externalId string, descriptionHtml string, shortDescription string, images {empty}, specs array<string>, sku string, priceUah double, priceVisible boolean"
    listing = spark.createDataFrame([("1", "aa", "s", [("u", None)], [], None, 5.0, False), ("2", None, None, [], [], "k", None, True)], ddl)
    detail = spark.createDataFrame([("1", "a", "t", [("v", None)], ["x"], "n", 6.0, True)], ddl)
    got = {r["externalId"]: r for r in consolidate.enrich(listing, detail, ["externalId"]).collect()}
    assert (got["1"]["descriptionHtml"], got["1"]["shortDescription"], got["1"]["images"][0]["url"], got["1"]["specs"], got["1"]["sku"], got["1"]["priceUah"], got["1"]["priceVisible"]) == ("aa", "t", "v", ["x"], "n", 5.0, True)
    assert got["2"]["sku"] == "k" and got["2"]["priceVisible"] is True


def test_upsert_is_idempotent(spark):
    ddl = "id long, name string, price double, note string, seo string"
    current = spark.createDataFrame([(1, "a", 10.0, "u", "s"), (2, "b", 1.0, "v", "s")], ddl)
    incoming = spark.createDataFrame([(1, "A", None, "", "new"), (3, "C", 2.0, "", "new")], ddl)
    policy = {"name": "overwrite", "price": "keep_if_null", "note": "keep_if_blank", "seo": "create_only"}
    once = upsert.merge(current, incoming, ["id"], policy)
    assert sorted(map(tuple, once.collect())) == [(1, "A", 10.0, "u", "s"), (2, "b", 1.0, "v", "s"), (3, "C", 2.0, "", "new")]
    assert sorted(map(tuple, upsert.merge(once, incoming, ["id"], policy).collect())) == sorted(map(tuple, once.collect()))


def random_forest(rng, n):
    return [(str(i), str(rng.randrange(i)) if i and rng.random() < 0.85 else None, rng.random() < 0.2, rng.random() < 0.05) for i in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_prune_matches_the_loop(spark, seed):
    nodes = random_forest(random.Random(seed), 40) + [("c1", "c2", False, False), ("c2", "c1", False, False)]
    left = {i: p for i, p, *_ in nodes}
    safe = {i for i, _, o, k in nodes if o or k}
    while gone := [i for i in left if i not in safe and i not in left.values()]:
        for i in gone:
            del left[i]
    df = spark.createDataFrame(nodes, "id string, parent string, occupied boolean, protected boolean")
    got = trees.prune(df, F.col("occupied"), F.col("protected"))
    assert {r["id"] for r in got.where("kept").collect()} == set(left)


def test_tree_order_and_slugs(spark):
    nodes = [("a", None, 1, "Я"), ("b", None, 1, "Ґ"), ("c", "a", 5, "x"), ("d", "a", 2, "y"), ("e", "lost", 0, "z")]
    got = trees.sorted_tree(spark.createDataFrame(nodes, "id string, parent string, sort_order int, name string")).orderBy("path")
    assert [(r["id"], r["depth"]) for r in got.collect()] == [("e", 0), ("b", 0), ("a", 0), ("d", 1), ("c", 1)]
    new = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (4, "y")], "id long, base string")
    taken = spark.createDataFrame([("x",), ("x-3",), ("y-2",)], "slug string")
    assert {r["id"]: r["slug"] for r in trees.unique_slugs(new, taken).collect()} == {1: "x-2", 2: "x-4", 3: "x-5", 4: "y"}


def test_tree_order_of_a_long_chain_and_of_cycles(spark):
    nodes = [(i, i - 1 if i else None, 0, f"n{i}") for i in range(130)] + [(200, 201, 0, "x"), (201, 200, 0, "y"), (202, 201, 0, "z"), (203, 203, 0, "self")]
    got = trees.sorted_tree(spark.createDataFrame(nodes, "id long, parent long, sort_order int, name string"))
    assert [(r["id"], r["depth"]) for r in got.orderBy("path").collect()] == [(i, i) for i in range(130)]
    assert got.columns == ["id", "name", "depth", "path"]


def test_slugs_differ_even_where_bases_collide(spark):
    rows = [(1, "a"), (2, "a"), (3, "a-2"), (4, "a-2"), (5, "a-02"), (6, "b" * 200), (7, "b" * 199 + "c"), (8, "a-2-2")]
    taken = {"a-3", "a-2-3"}
    got = {r["id"]: r["slug"] for r in trees.unique_slugs(spark.createDataFrame(rows, "id long, base string"), spark.createDataFrame([(t,) for t in taken], "slug string")).collect()}
    assert len(set(got.values())) == len(rows) and not taken & set(got.values()) and all(len(x) <= 200 for x in got.values())
    assert got[1] == "a" and got[3] == "a-2" and got[8] == "a-2-2" and got[2] == "a-4" and got[4] == "a-2-4"


def test_patches_of_one_key_are_one(spark):
    now = spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], "id long, name string, note string")
    sent = [(1, "B", None, ["name"], 1), (1, "C", None, ["name"], 2), (1, "D", None, ["note"], 3), (9, "E", "z", ["name"], 4)]
    patches = spark.createDataFrame(sent, "id long, name string, note string, present_fields array<string>, at int")
    assert sorted(upsert.patch(now, patches, "id", "at").collect()) == [(1, "C", None), (2, "b", "y")]


def test_publishing_never_loses_a_version(spark, tmp_path):
    """A run that dies while it publishes leaves the version before: nothing is replaced."""
    folder = str(tmp_path / "db")
    assert not tables.is_published(spark, folder)
    tables.publish(spark, folder, "one")
    (tmp_path / "db" / "_versions" / "_temporary").mkdir()  # what a dying append leaves
    assert tables.is_published(spark, folder) and tables.current(spark, folder).endswith("/one")
    tables.publish(spark, folder, "two")
    assert tables.current(spark, folder).endswith("/two")


def test_media_status(spark):
    name = lambda u: __import__("hashlib").sha256(u.encode()).hexdigest() + ".png"
    rows = [(1, "https://h/x.png", None), (2, "/api/media/" + name("u"), "u"), (3, "/api/media/" + name("https://v"), " https://v "), (4, "/api/media/" + name("w"), "https://other"), (5, "/api/media/" + name("s"), None), (6, "/api/media/x", None)]
    got = maintenance.media_status(spark.createDataFrame(rows, "id long, url string, source_url string"), spark.createDataFrame([(name("s"),)], "name string"))
    assert {r["id"]: r["status"] for r in got.collect()} == {1: "external", 2: "no_source", 3: "repairable", 4: "bad_hash", 5: "stored", 6: "unsafe"}


def test_health_and_duplicates_of_an_empty_catalogue(spark):
    products = tables.empty(spark, "products")
    assert reports.health(products).first().asDict() == {"total": 0, "published": 0, "with_external": 0, "with_url": 0, "with_category_url": 0, "duplicate_sku_groups": 0}
    assert reports.duplicates(products, categories.SOURCES).count() == 0


def test_category_page(spark):
    cats = spark.createDataFrame([("r", "root", "Root", None, 0), ("k", "kid", "Kid", "r", 1)], "id string, slug string, name_uk string, parent_id string, sort_order int")
    goods = spark.createDataFrame([("p", "k", "b", True, None, 1, "P"), ("q", "k", None, False, None, 2, "Q"), ("s", "k", None, True, "p", 3, "S")], "id string, category_id string, brand_id string, published boolean, merged_into_product_id string, sort_order int, name_uk string")
    images = spark.createDataFrame([("2", "p", "b.png", 1), ("1", "p", "a.png", 0)], "id string, product_id string, url string, sort_order int")
    brands = spark.createDataFrame([("b", "Brand")], "id string, name string")
    children, _ = serving.category_page(cats, goods, images, brands, "root")
    assert [(r["slug"], r["n_products"]) for r in children.collect()] == [("kid", 1)]
    _, listing = serving.category_page(cats, goods, images, brands, "kid")
    assert [(r["id"], r["brand"], r["cover"]) for r in listing.collect()] == [("p", "Brand", "a.png")]


PRODUCT = {"source": "et_market", "externalId": "1", "sourceUrl": "https://et-market.com.ua/a.html", "slug": "a", "nameUk": "Мат", "priceVisible": True, "priceUah": 7, "images": [{"url": "i"}], "specs": [{"label": "Вт", "value": "5"}, {"label": "вт", "value": "6"}]}


def write_manifest(folder, name, products, **extra):
    path = folder / name
    path.write_text(json.dumps({"scrapedAt": name, "listingUrl": "l", "products": products} | extra, ensure_ascii=False, indent=1))
    return str(path)


def test_manifests_merge_and_import(spark, tmp_path):
    one = write_manifest(tmp_path, "one.json", [PRODUCT, PRODUCT | {"externalId": "2", "sku": "9"}], inHeat={"seedUrl": "s"})
    two = write_manifest(tmp_path, "two.json", [PRODUCT | {"externalId": "1", "nameUk": "Новий", "priceUah": None, "images": []}], etMarket={"pagesScraped": 1, "filters": [{"id": "m", "name": "M", "values": [{"filterKey": "m", "label": "A", "count": 1, "filterUrl": "u"}]}]})
    found = manifests.read_manifests(spark, [one, two])
    assert manifests.merged_meta(found).select("scrapedAt", "inHeat.seedUrl", "etMarket.pagesScraped").first() == ("one.json", "s", 1)
    assert [r["label"] for r in manifests.facets_of(found).collect()] == ["A"]
    products = manifests.products_of(found)
    assert sorted(r["ordinal"] for r in manifests.ordinals(products).collect()) == [0, 1, 2]
    merged = consolidate.last_wins(products, ["source", "externalId"], ["file_ord", "pos"])
    assert [(r["externalId"], r["nameUk"], r["position"]["pos"]) for r in merged.orderBy("position").collect()] == [("1", "Новий", 0), ("2", "Мат", 1)]
    first = upsert.import_rows(products.where("file_ord = 0"), True, F.lit("c"))
    second = upsert.import_rows(products.where("file_ord = 1"), True, F.lit("c"))
    stored = tables.conform(upsert.merge(first, second, ["id"], upsert.PRODUCT_POLICY), "products")
    row = stored.where("external_id = '1'").first()
    assert (row["name_uk"], float(row["price_uah"]), row["seo_title"], row["slug"]) == ("Новий", 7.0, "Мат", "et_market-1")
    specs = upsert.spec_rows(products, ["file_ord", "pos"])
    assert {(r["definition"], r["value_text"]) for r in specs.collect()} == {("vt", "6")}
    assert upsert.spec_definitions(products, ["file_ord", "pos"]).first()["label_uk"] == "вт"
    snapshot = tables.write_snapshot({"products": stored}, str(tmp_path / "db"), "v1")
    tables.publish(spark, str(tmp_path / "db"), "v1")
    assert tables.current(spark, str(tmp_path / "db")) == snapshot
    again = tables.read_table(spark, snapshot, "products")
    assert again.count() == 2 and tables.violations({"products": again}).where("n > 0").count() == 0
    manifests.write_manifest(products, str(tmp_path / "out"), "2026-01-01", "l")
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_rebuild(spark, tmp_path):
    url = "https://et-market.com.ua/"
    et = [PRODUCT | {"externalId": str(i), "slug": f"s{i}", "nameUk": f"Нагрівальний мат номер {i}", "sourceCategoryUrl": u} for i, u in enumerate((url + "teplyj-pol/nagrevatelnye-maty/", url + "avtomatika/x/", None, "https://other.com/x/"))]
    vs = [PRODUCT | {"source": "vsesezon", "externalId": "7", "nameUk": "Нагрівальний мат номер 1", "sourceCategoryUrl": "https://vsesezon.com.ua/ua/g12-maty/"}, PRODUCT | {"source": "unknown"}]
    paths = [
        write_manifest(tmp_path, "et.json", et, etMarketCrawl={"perCategory": [{"categoryUrl": url + "avtomatika/x/", "title": "Щось"}]}),
        write_manifest(tmp_path, "vs.json", vs, vsesezon={"perCategory": [{"categoryUrl": "https://vsesezon.com.ua/ua/g12-maty?x", "title": "Мати"}]}),
    ]
    got, rejected = imports.rebuild(spark, str(tmp_path / "db"), paths, "v1")
    assert sorted((r["source"], r["externalId"]) for r in rejected.collect()) == [("et_market", "3"), ("unknown", "1")]
    slug_of = {r["id"]: r["slug"] for r in got["categories"].collect()}
    rows = {(r["external_source"], r["external_id"]): r for r in got["products"].where("external_id IS NOT NULL").collect()}
    assert {k: slug_of[r["category_id"]] for k, r in rows.items()} == {("et_market", "0"): "nagrivalni-maty", ("et_market", "1"): "et-avtomatika", ("et_market", "2"): "tepla-pidloga", ("vsesezon", "7"): "vs-12"}
    assert rows[("vsesezon", "7")]["merged_into_product_id"] == rows[("et_market", "1")]["id"]
    assert {r["slug"]: (r["name_uk"], r["sort_order"]) for r in got["categories"].collect()}["vs-12"] == ("Мати", 412)
    assert tables.violations(got).where("n > 0").count() == 0
    found = manifests.read_manifests(spark, paths)
    again, _ = imports.import_products(imports.seeded(got), manifests.products_of(found), imports.section_titles(found), stage=imports.written_below(str(tmp_path / "again")))
    for name, df in got.items():
        assert sorted(map(str, again[name].select(*df.columns).collect())) == sorted(map(str, df.collect())), name
    left, blocked = imports.pruned(got)
    assert blocked.count() == 1 and left["categories"].count() == got["categories"].count()
    bare = imports.reset(got)
    assert bare["products"].count() == 2 and bare["product_specs"].count() == 6 and bare["categories"].count() == 3
    more, bad = imports.new_sections(bare, spark.createDataFrame([("a", "Тепла pidloga", None), ("b", "X", "none")], "id string, name_uk string, parent_id string"))
    assert more["categories"].where("id = 'a'").first()["slug"] == "tepla-pidloga-2" and bad.count() == 1
    deep, _ = imports.import_products(bare, manifests.products_of(found), imports.section_titles(found), deep=True)
    assert {"etm-teplyj-pol", "etm-teplyj-pol-nagrevatelnye-maty", "etm-avtomatika-x", "vs-12"} <= {r["slug"] for r in deep["categories"].collect()}


def test_saved_pages_and_url_lists(spark, tmp_path):
    (tmp_path / "a.html").write_text("<title>T</title>\n<p>x")
    (tmp_path / "u.txt").write_text(" https://a \n\nhttps://a\nhttps://b\n")
    saved = manifests.read_pages(spark, [str(tmp_path / "a.html")], "https://h/")
    assert saved.select(pages.title(F.col("html"))).first()[0] == "T"
    assert sorted(r["url"] for r in manifests.read_url_list(spark, [str(tmp_path / "u.txt")]).collect()) == ["https://a", "https://b"]


def test_proxies_name_their_tables():
    assert proxies.tables_of(proxies.VIEWS["sections"]) == ["nation", "region", "supplier"]
    assert callable(catalogue.QUERIES["similar_titles"]) and text.SPACE


def test_greedy_follows_chains():
    pairs = pd.DataFrame({"id_a": [1, 2], "id_b": [2, 3], "source_a": ["c", "b"], "source_b": ["b", "a"], "similarity": [1.0, 0.95]})
    assert similarity.greedy(pairs, {"a": 0, "b": 1, "c": 2}) == [(1, 2), (2, 3)]
