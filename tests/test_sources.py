"""Folders of media, details written batch by batch, and parsers as functions of SQL."""

import pytest
from merchloom.functions import media as media_names
from merchloom.functions import sql
from merchloom.operators import maintenance, reports
from merchloom.sources import manifests, media
from pyspark.sql import functions as F

NAMES = ["a" * 64 + ".png", "b" * 64 + ".jpg", "C" * 64 + ".webp"]


def test_a_folder_feeds_the_media_status(spark, tmp_path):
    for name in [*NAMES, ".hidden", "." + NAMES[0], "_" + NAMES[0], "photo of a mat.png", "100%.png", "b" * 63 + ".png", "b" * 64 + ".exe"]:
        (tmp_path / name).write_bytes(b"xyz")
    (tmp_path / "more").mkdir()
    (tmp_path / "more" / ("d" * 64 + ".gif")).write_bytes(b"x")
    (tmp_path / ("e" * 64 + ".gif")).write_bytes(b"")
    (tmp_path / NAMES[1]).chmod(0)  # never opened
    found = {r["name"]: (r["size"], r["safe"]) for r in media.list_folder(spark, str(tmp_path)).collect()}
    assert {n for n, (_, safe) in found.items() if safe} == set(NAMES) and found["photo of a mat.png"] == (3, False) and "100%.png" in found
    assert not any(n.startswith((".", "_")) for n in found) and found[NAMES[0]] == (3, True)
    assert media.stored_files(spark, str(tmp_path), nested=True).count() == 4
    images = spark.createDataFrame([(1, media_names.PREFIX + NAMES[0], None), (2, media_names.PREFIX + "d" * 64 + ".gif", None), (3, "https://x/y.png", None)], "id long, url string, source_url string")
    status = {r["id"]: r["status"] for r in maintenance.media_status(images, media.stored_files(spark, str(tmp_path))).collect()}
    assert status == {1: "stored", 2: "no_source", 3: "external"}
    (tmp_path / "none").mkdir()
    assert media.list_folder(spark, str(tmp_path / "none")).count() == 0


def test_details_resume_after_a_death(spark, tmp_path):
    rows = spark.range(95).select(F.lit(0).alias("file_ord"), F.col("id").cast("int").alias("pos"), F.concat(F.lit("p"), "id").alias("name"))
    folder, seen = str(tmp_path / "details"), tmp_path / "seen"
    seen.mkdir()

    def enrich(bad):
        def one(frames):
            for frame in frames:
                for p in frame["pos"]:
                    if p == bad:
                        raise RuntimeError("the crawl dies here")
                yield frame.assign(detail=frame["name"] + "!")

        return lambda df: df.mapInPandas(one, "file_ord int, pos int, name string, detail string")

    wave = {r["batch"]: r["wave"] for r in spark.range(10).select(F.col("id").cast("int").alias("batch"), F.pmod(F.xxhash64(F.lit(0), F.col("id").cast("int")), F.lit(4)).alias("wave")).collect()}
    last = max(wave, key=wave.get)
    with pytest.raises(Exception, match="the crawl dies here"):
        manifests.write_batches(rows, folder, enrich(10 * last + 2), size=10, waves=4)
    first = {p: p.stat().st_mtime_ns for p in (tmp_path / "details").rglob("*.parquet")}
    done = {r["batch"] for r in manifests.written_batches(spark, folder).collect()}
    assert done == {b for b in wave if wave[b] < wave[last]} and done
    manifests.write_batches(rows, folder, enrich(-1), size=10, waves=4)
    now = {p: p.stat().st_mtime_ns for p in (tmp_path / "details").rglob("*.parquet")}
    assert first.items() <= now.items() and len(now) == 10
    out = spark.read.parquet(folder)
    assert out.count() == 95 and out.select("pos").distinct().count() == 95 and out.where("detail = name || '!'").count() == 95
    manifests.write_batches(rows, folder, enrich(0), size=10, waves=1)  # nothing is left to do
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "details").rglob("*.parquet")} == now


def test_parsers_in_sql(spark):
    sql.register(spark)
    card = '<html><head><link rel="canonical" href="https://et-market.com.ua/p-1.html"></head><h1 class="cr-product-title">N</h1><ul class="thumbnails"><li><a class="thumbnail" href="/i.jpg" title="T"></a></li></ul><div itemprop="description"><table class="table"><tbody><tr><td>A</td><td>b</td></tr></tbody></table></div></html>'
    spark.createDataFrame([(1, card), (2, None)], "page long, html string").createOrReplaceTempView("saved")
    found = spark.sql("SELECT s.page, c.nameUk, c.images[0].alt AS alt, c.specs[0].label AS label FROM saved s, LATERAL shop_card(s.html, 'et_market', '{\"sku\": \"k\"}') c").collect()
    assert [tuple(r) for r in found] == [(1, "N", "T", "A")]
    assert spark.sql("SELECT * FROM saved s, LATERAL shop_facets(s.html) f").count() == 0


def test_groups_in_the_order_of_the_report(spark):
    kinds = reports.KINDS
    rows = [(kinds[3], "z", 9), (kinds[0], "b", 2), (kinds[2], "c", 5), (kinds[0], "a", 2), (kinds[0], "d", 7), (kinds[1], "e", 3)]
    found = reports.ordered(spark.createDataFrame(rows, "kind string, key string, count long")).collect()
    assert [r["key"] for r in found] == ["d", "a", "b", "e", "c", "z"]
