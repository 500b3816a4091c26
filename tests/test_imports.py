"""Nothing gets lost on the way into the catalogue."""

import json

import pytest
from merchloom.operators import upsert
from merchloom.plans import imports
from merchloom.sources import manifests, tables
from pyspark.sql import functions as F
from test_operators import PRODUCT, write_manifest

URL = "https://et-market.com.ua/"


def arriving(spark, tmp_path):
    et = [PRODUCT | {"externalId": str(i), "nameUk": f"Нагрівальний мат номер {i}", "sourceCategoryUrl": u} for i, u in enumerate((URL + "teplyj-pol/nagrevatelnye-maty/", URL + "avtomatika/x/", None, "https://other.com/x/"))]
    vs = [PRODUCT | {"source": "vsesezon", "externalId": "7", "sourceCategoryUrl": "https://vsesezon.com.ua/ua/g12-maty/"}, PRODUCT | {"source": "unknown"}, PRODUCT | {"externalId": None}, PRODUCT | {"source": None}, et[1] | {"nameUk": "Новий", "sku": "s"}]
    paths = [
        write_manifest(tmp_path, "et.json", et, etMarketCrawl={"perCategory": [{"categoryUrl": URL + "avtomatika/x/", "title": "Щось"}]}),
        write_manifest(tmp_path, "vs.json", vs, vsesezon={"perCategory": [{"categoryUrl": "https://vsesezon.com.ua/ua/g12-maty?x", "title": "Мати"}]}),
    ]
    return manifests.read_manifests(spark, paths), et + vs


@pytest.mark.parametrize("seeded", [True, False])
def test_all_rows_are_imported_or_rejected(spark, tmp_path, seeded):
    found, rows = arriving(spark, tmp_path)
    start = imports.empty_catalogue(spark)
    start = imports.seeded(start) if seeded else start
    after, rejected = imports.import_products(start, manifests.products_of(found), imports.section_titles(found))
    reasons = {(r["source"], r["externalId"]): r["reason"] for r in rejected.collect()}
    got = {(r["external_source"], r["external_id"]) for r in after["products"].where("external_id IS NOT NULL").collect()}
    assert got | set(reasons) == {(p.get("source"), p.get("externalId", "1")) for p in rows} and not got & set(reasons)
    if seeded:
        assert got == {("et_market", "0"), ("et_market", "1"), ("et_market", "2"), ("vsesezon", "7")}
    else:  # own sections are not there; donors' sections are made by the import
        assert got == {("et_market", "1"), ("vsesezon", "7")} and reasons[("et_market", "0")] == reasons[("et_market", "2")] == imports.NOT_SEEDED
    assert reasons[("unknown", "1")] == reasons[("et_market", "3")] == imports.NO_SECTION and reasons[(None, "1")] == reasons[("et_market", None)] == imports.NO_KEY


def test_manifests_merge_and_read_back(spark, tmp_path):
    found, rows = arriving(spark, tmp_path)
    merged = manifests.merged_products(found)
    path = str(tmp_path / "merged")
    manifests.write_documents(merged, manifests.merged_meta(found), path, size=2)
    again = manifests.read_documents(spark, [path])
    assert again.select(F.max(F.size("products"))).first()[0] <= 2
    products = manifests.products_of(again)
    ordered = [(r["source"], r["externalId"], r["nameUk"]) for r in products.orderBy("file_ord", "pos").collect()]
    want = {}
    for p in rows:
        want[p.get("source"), p.get("externalId")] = p["nameUk"]
    assert ordered == [(*k, n) for k, n in want.items()]
    assert manifests.merged_meta(again).first().asDict(True) == manifests.merged_meta(found).first().asDict(True)
    start = imports.seeded(imports.empty_catalogue(spark))
    one, _ = imports.import_products(start, manifests.products_of(found), imports.section_titles(found))
    two, _ = imports.import_products(start, products, imports.section_titles(again))
    for name in ("categories", "products", "product_images", "product_specs"):
        a, b = ([r.asDict() for r in x[name].drop("seo_title").collect()] for x in (one, two))
        assert sorted(map(repr, a)) == sorted(map(repr, b)), name
    with pytest.raises(Exception, match="(?i)exists"):
        manifests.write_documents(merged, manifests.merged_meta(found), path)


def test_a_published_version_is_never_written_again(spark, tmp_path):
    folder, rows = str(tmp_path / "db"), {"categories": tables.conform(spark.createDataFrame([("a", "a", "A")], "id string, slug string, name_uk string"), "categories")}
    tables.write_snapshot(rows, folder, "v1")
    tables.write_snapshot(rows, folder, "v1")  # not published yet: a repeated run
    tables.publish(spark, folder, "v1")
    published = {"categories": tables.read_table(spark, tables.current(spark, folder), "categories")}
    with pytest.raises(ValueError, match="published"):
        tables.write_snapshot(published, folder, "v1")
    assert tables.read_table(spark, tables.current(spark, folder), "categories").count() == 1
    with pytest.raises(ValueError, match="published"):
        imports.rebuild(spark, folder, [], "v1")


def test_patches_are_applied_or_rejected(spark):
    rows = [(1, "7,5", ["price_uah"]), (2, "x", ["price_uah"]), (3, "x", []), (4, None, ["price_uah"]), (5, " ", ["price_uah"])]
    patches = spark.createDataFrame(rows, "id long, price_uah string, present_fields array<string>")
    good = {r["id"] for r in upsert.product_patches(patches).collect()}
    bad = {r["id"]: r["reason"] for r in upsert.rejected_patches(patches).collect()}
    assert good == {1, 3, 4, 5} and set(bad) == {2}
    assert upsert.rejected_patches(patches.drop("price_uah")).count() == 0


def test_json_is_a_document_in_a_line(spark, tmp_path):
    found, _ = arriving(spark, tmp_path)
    path = tmp_path / "lines"
    manifests.write_documents(manifests.products_of(found), manifests.merged_meta(found), str(path))
    lines = [json.loads(x) for f in path.glob("part-*") for x in f.read_text().splitlines()]
    assert sum(len(x["products"]) for x in lines) == 9 and sum("scrapedAt" in x for x in lines) == 1
