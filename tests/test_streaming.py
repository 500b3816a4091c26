"""Manifests that arrive one after the other leave what one import of all leaves."""

import json

from merchloom.plans import imports
from merchloom.sources import tables
from merchloom.streaming import ingest

PRODUCT = {"source": "et_market", "slug": "a", "nameUk": "Мат", "priceVisible": True, "images": [{"url": "i"}], "specs": [{"label": "Вт", "value": "5"}]}


def test_batches_resume_and_replay(spark, tmp_path):
    inbox, folder = tmp_path / "inbox", str(tmp_path / "db")
    inbox.mkdir()

    def arrive(name, *products):
        (inbox / name).write_text(json.dumps({"scrapedAt": "t", "listingUrl": "l", "products": [PRODUCT | p for p in products]}))
        ingest.import_arriving(spark, str(inbox), folder).awaitTermination()

    def stored():
        rows = tables.read_table(spark, tables.current(spark, folder), "products").where("external_id IS NOT NULL").collect()
        return {r["external_id"]: (r["name_uk"], r["sku"]) for r in rows}

    arrive("1.json", {"externalId": "1", "sku": "k"}, {"externalId": "2", "source": "nowhere"})
    assert stored() == {"1": ("Мат", "k__et_market__1")}
    arrive("2.json", {"externalId": "1", "nameUk": "Новий"}, {"externalId": "3"})
    assert stored() == {"1": ("Новий", "k__et_market__1"), "3": ("Мат", None)}
    assert spark.read.json(f"{folder}/rejected/batch-000000000").count() == 1
    before = tables.current(spark, folder)
    assert before.endswith("batch-000000001")
    ingest.import_arriving(spark, str(inbox), folder).awaitTermination()
    assert tables.current(spark, folder) == before
    catalogue = {n: tables.read_table(spark, before, n) for n in tables.SCHEMAS}
    assert tables.violations(catalogue).where("n > 0").count() == 0
    assert imports.reset(catalogue)["products"].count() == 2


def test_untouched_parts_stay_as_they_are(spark, tmp_path):
    inbox, folder = tmp_path / "inbox", str(tmp_path / "db")
    inbox.mkdir()

    def arrive(name, *products):
        (inbox / name).write_text(json.dumps({"scrapedAt": "t", "listingUrl": "l", "products": [PRODUCT | p for p in products]}))
        ingest.import_arriving(spark, str(inbox), folder).awaitTermination()
        return tables.current(spark, folder)

    names = [f"Нагрівальний мат з кабелем номер {i}" for i in range(12)]
    first = arrive("1.json", *({"externalId": str(i), "nameUk": n} for i, n in enumerate(names)))
    files = {p: p.stat().st_mtime_ns for p in (tmp_path / "db").rglob("products/part=*/*.parquet")}
    second = arrive("2.json", {"externalId": "5", "sku": "new"}, {"source": "in_heat", "externalId": "x", "nameUk": names[7]})
    one, two = tables.listing(spark, first), tables.listing(spark, second)
    moved = {k for k in two if one.get(k) != two[k] and k[0] == "products"}
    assert 0 < len(moved) <= 2 and all(one[k] == two[k] for k in two if k[0] == "products" and k not in moved) and one[("brands", 0)] == two[("brands", 0)]
    assert all(p.stat().st_mtime_ns == t for p, t in files.items())
    rows = {(r["external_source"], r["external_id"]): r for r in tables.read_table(spark, second, "products").where("external_id IS NOT NULL").collect()}
    assert len(rows) == 13 and rows["et_market", "5"]["sku"] == "new__et_market__5"
    assert rows["in_heat", "x"]["merged_into_product_id"] == rows["et_market", "7"]["id"]
    # A later product that its source puts first takes an older one of another part along.
    third = arrive("3.json", {"source": "vsesezon", "externalId": "v", "nameUk": "Терморегулятор з датчиком підлоги"})
    fourth = arrive("4.json", {"externalId": "t", "nameUk": "Терморегулятор з датчиком підлоги"})
    rows = {(r["external_source"], r["external_id"]): r for r in tables.read_table(spark, fourth, "products").collect()}
    assert rows["vsesezon", "v"]["merged_into_product_id"] == rows["et_market", "t"]["id"] and third != fourth
    catalogue = {n: tables.read_table(spark, fourth, n) for n in tables.SCHEMAS}
    assert tables.violations(catalogue).where("n > 0").count() == 0
    assert not (tmp_path / "db" / "work").exists() or not any((tmp_path / "db" / "work").iterdir())
