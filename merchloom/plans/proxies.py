"""Catalogue-shaped views of the driver's tables, as SQL that Spark and DuckDB both read.

Each is a SELECT over Parquet tables named in braces; ``view`` binds them to a folder and
``text`` to the table names themselves, so that queries and their SQL see the same rows.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    # Regions, nations and suppliers as one tree of sections.
    "sections": """
        SELECT 'r' || CAST(r_regionkey AS STRING) AS id, lower(r_name) AS slug, r_name AS name, CAST(NULL AS STRING) AS parent, r_regionkey AS sort_order FROM {region}
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), lower(n_name), n_name, 'r' || CAST(n_regionkey AS STRING), n_nationkey FROM {nation}
        UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), lower(s_name), s_name, 'n' || CAST(s_nationkey AS STRING), CAST(s_acctbal AS INT) FROM {supplier}""",
    # Parts as products of three shops and of the own one.
    "products": """
        SELECT p_partkey AS id, 'p-' || CAST(p_partkey AS STRING) AS slug, p_name || ' ' || p_brand AS name_uk, p_name AS short_name, p_type AS category_id, p_brand AS brand_id,
          CAST(p_retailprice AS DECIMAL(12,2)) AS price_uah, p_size > 5 AS published, p_size > 10 AS price_visible, p_size AS sort_order,
          CASE WHEN p_size <= 15 THEN 'et_market' WHEN p_size <= 30 THEN 'in_heat' WHEN p_size <= 45 THEN 'vsesezon' END AS external_source,
          CASE WHEN p_size <= 45 THEN 'x-' || CAST(p_partkey AS STRING) END AS external_id,
          CASE WHEN p_size <= 45 THEN upper(p_name) || '-' || CAST(p_size AS STRING) || CASE WHEN p_size <= 15 THEN '__et_market__x' WHEN p_size <= 30 THEN '__in_heat__x' ELSE '' END END AS sku,
          CASE WHEN p_size BETWEEN 5 AND 45 THEN 'https://shop.example.com/ua/' || replace(p_name, ' ', '-') || '.html' END AS external_url,
          CASE WHEN p_size BETWEEN 8 AND 45 THEN 'https://shop.example.com/ua/' || lower(p_type) || '/' END AS source_category_url,
          CASE WHEN p_size = 7 AND p_partkey >= 3 THEN p_partkey - 3 END AS merged_into_product_id
        FROM {part}""",
    # Pages as listing rows: the host is the shop, the title the name.
    "pages_by_host": "SELECT page_id, url, html, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host FROM {pages}",
    # Page addresses moved to the shops' hosts, so that their section rules apply.
    "moved_urls": """
        SELECT page_id, shop AS source, base || lead || CASE WHEN k < 3 THEN seg_a ELSE regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) END || CASE WHEN k < 2 THEN '/nagrevatelnye-maty/x' WHEN k = 2 THEN '/nagrevatelnyj-kabel/y/' ELSE '' END AS url
        FROM (SELECT page_id, url, length(url) % 5 AS k,
            CASE WHEN url LIKE 'https:%' THEN 'et_market' WHEN url LIKE '%.com/%' THEN 'in_heat' ELSE 'vsesezon' END AS shop,
            CASE WHEN url LIKE 'https:%' THEN 'https://et-market.com.ua/' WHEN url LIKE '%.com/%' THEN 'https://in-heat.kiev.ua/' ELSE 'https://vsesezon.com.ua/' END AS base,
            CASE WHEN url LIKE 'https:%' THEN '' ELSE 'ua/' END AS lead,
            CASE WHEN url LIKE 'https:%' THEN 'teplyj-pol' WHEN url LIKE '%.com/%' THEN 'otoplenie' ELSE 'g' || CAST(10 * page_id AS STRING) || '-mat' END AS seg_a
          FROM {pages}) t""",
    # Attributes of parts as label and value rows.
    "attributes": """
        SELECT p_partkey AS product_id, 0 AS pos, 'Потужність, Вт' AS label, CAST(p_size AS STRING) || ',5' AS value FROM {part}
        UNION ALL SELECT p_partkey, 1, 'Тип', p_type FROM {part}
        UNION ALL SELECT p_partkey, 2, 'Площа, м²', CAST(p_size AS STRING) FROM {part} WHERE p_size > 3
        UNION ALL SELECT p_partkey, 3, 'тип', lower(p_type) FROM {part} WHERE p_size > 25""",
    # Customers as stored rows and parts as incoming ones, by the same number.
    "stored": "SELECT c_custkey AS id, c_name AS name, c_acctbal AS price, c_mktsegment AS note, 'seo ' || c_name AS seo FROM {customer}",
    "incoming": "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 25 THEN p_retailprice END AS price, CASE WHEN p_size > 40 THEN NULL WHEN p_size > 20 THEN '' ELSE p_type END AS note, 'seo ' || p_name AS seo FROM {part}",
    # Image rows of pages: a local file, an outside address or an unsafe name.
    "images": """
        SELECT page_id AS id, CASE WHEN length(url) % 3 = 0 THEN url WHEN length(url) % 7 = 1 THEN '/api/media/../x.png' ELSE '/api/media/' || sha2(url, 256) || '.png?v=1' END AS url,
          CASE WHEN length(url) % 4 = 1 THEN NULL WHEN length(url) % 4 = 2 THEN url || '#other' ELSE url END AS source_url FROM {pages}""",
    "stored_files": "SELECT DISTINCT sha2(url, 256) || '.png' AS name FROM {pages} WHERE url LIKE 'https:%'",
}


def tables_of(sql: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", sql)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame over the Parquet tables of a folder. Fractions become whole numbers as in DuckDB, whose casts
    round, halves of doubles to even and halves of decimals away from zero; Spark's cut them off."""
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables_of(VIEWS[name])}
    kinds = {c: kind for df in tables.values() for c, kind in df.dtypes}
    sql = re.sub(r"CAST\((\w+) AS INT\)", lambda m: f"CAST({'round' if kinds[m[1]].startswith('decimal') else 'rint'}({m[1]}) AS INT)", VIEWS[name])
    return spark.sql(sql, **tables)


def text(name: str) -> str:
    """A view as DuckDB SQL over the registered tables."""
    sql = re.sub(r"\{(\w+)\}", r"\1", VIEWS[name])
    return re.sub(r"sha2\((\w+), 256\)", r"sha256(\1)", sql)
