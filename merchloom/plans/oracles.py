"""DuckDB SQL for the catalogue's queries, written from the rules and not from the plans."""

from __future__ import annotations

from ..operators.categories import CABLES, DONORS, MATS, PROTECTED, ROOT
from .proxies import text as v

_ABSOLUTE = r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#\s]+"


def _path(u: str) -> str:
    return f"CASE WHEN regexp_matches({u}, '{_ABSOLUTE}') THEN coalesce(nullif(regexp_extract({u}, '{_ABSOLUTE}([^?#]*)', 1), ''), '/') END"


def _parts(u: str) -> str:
    return f"coalesce(list_filter(string_split({_path(u)}, '/'), lambda x: x <> ''), [])"


def _origin(u: str) -> str:
    return f"lower(nullif(regexp_extract({u}, '({_ABSOLUTE[1:]})', 1), ''))"


def _canonical(u: str) -> str:
    return f"coalesce({_origin(u)} || CASE WHEN len({_parts(u)}) = 0 THEN '/' ELSE '/' || array_to_string({_parts(u)}, '/') || '/' END, {u})"


def _key(name: str) -> str:
    return rf"trim(regexp_replace(strip_accents(lower({name})), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


_TITLE = r"nullif(left(trim(regexp_replace(regexp_extract(html, '(?i)<title[^>]*>([^<]+)</title>', 1), '\s+', ' ', 'g')), 240), '')"
_TITLES = f"titles AS (SELECT page_id AS id, regexp_replace({_key('title')}, '[^a-z0-9 ]', 'x', 'g') AS key, host AS source FROM (SELECT *, {_TITLE} AS title FROM ({v('pages_by_host')})))"
#: Pairs of names with similarity, and the classes and rows behind them.
_NAMES = f"""WITH {_TITLES},
nodes AS (SELECT key, source, count(*) AS n FROM titles WHERE length(key) >= 15 AND source IS NOT NULL GROUP BY ALL),
near AS (SELECT a.key AS key_a, a.source AS source_a, a.n AS n_a, b.key AS key_b, b.source AS source_b, b.n AS n_b, 1 - levenshtein(a.key, b.key) / greatest(length(a.key), length(b.key)) AS sim
  FROM nodes a JOIN nodes b ON left(a.key, 12) = left(b.key, 12) AND a.source <> b.source)
"""
_MD5_KEYS = f"k AS (SELECT md5({_key('text')}) AS key, source FROM documents WHERE text IS NOT NULL)"
_GROUPS = "SELECT key, count(*) AS n, array_to_string(list_sort(list_distinct(list(coalesce(source, 'null')))), ',') AS sources, count(DISTINCT nullif(source, '')) AS named, count(nullif(source, '')) AS with_source FROM k WHERE key <> '' GROUP BY key HAVING count(*) > 1"

_CODE = r"nullif(upper(regexp_replace(coalesce(nullif(regexp_extract(trim(sku), '^(.+?)__(?:et_market|in_heat|vsesezon)__', 1), ''), trim(sku)), '\s+', '', 'g')), '')"
_LEAF = f"lower(regexp_replace({_parts('external_url')}[-1], '(?i)\\.html?$', ''))"


def _dups() -> str:
    def groups(key: str, least: int) -> str:
        return f"(SELECT key, count(*) AS n, array_to_string(list_sort(list_distinct(list(coalesce(external_source, 'null')))), ',') AS sources, count(DISTINCT external_source) AS named, count(external_source) AS ws FROM (SELECT {key} AS key, external_source FROM products) WHERE length(key) >= {least} GROUP BY key HAVING count(*) > 1)"

    parts = [
        f"SELECT '{kind}' AS kind, left(key, 120) AS key, n AS \"count\", sources FROM {groups(key, least)} WHERE named >= 2"
        for kind, key, least in (("base_code_cross_source", _CODE, 2), ("url_leaf_cross_source", _LEAF, 6), ("name_cross_source", _key("name_uk"), 12))
    ]
    parts.append(f"SELECT 'name_same_source', left(key, 120), n, sources FROM {groups(_key('name_uk'), 12)} WHERE named = 1 AND ws = n")
    return f"products AS ({v('products')}), dups AS (" + " UNION ALL ".join(parts) + ")"


_SHOWN = "c_acctbal > 0 AND NOT c_acctbal > 9000"
_DISPLAY = "CASE WHEN pos > 1 THEN '' ELSE value END"
_NUMBER = r"try_cast(replace(regexp_extract(trim(value), '^([0-9]+(?:[.,][0-9]+)?)$', 1), ',', '.') AS DECIMAL(18,6))"
_SPEC_SLUG = "CASE label WHEN 'Потужність, Вт' THEN 'potuzhnist-vt' WHEN 'Площа, м²' THEN 'ploshcha-m2' ELSE 'typ' END"


def _flat_slug() -> str:
    host = f"coalesce(lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1), '')), '')"
    p = _parts("url")
    segment = {
        "et_market": f"coalesce({p}[1], 'misc')",
        "in_heat": f"CASE WHEN {p}[1] = 'ua' AND len({p}) >= 2 THEN {p}[2] ELSE coalesce({p}[1], 'misc') END",
        "vsesezon": f"coalesce(nullif(regexp_extract(coalesce({p}[-1], ''), '(?i)^g([0-9]+)', 1), ''), '0')",
    }
    path = f"lower({_path('url')})"
    et = f"CASE WHEN lower({p}[1]) = 'teplyj-pol' THEN CASE WHEN contains({path}, 'nagrevatelnyj-kabel') OR contains({path}, 'woks-pol') THEN '{CABLES}' WHEN contains({path}, 'nagrevatelnye-maty') THEN '{MATS}' END END"
    ih = f"CASE WHEN contains({path}, 'kabel-pod-plitku') OR contains({path}, 'nagrevatelnyj-kabel') THEN '{CABLES}' WHEN contains({path}, 'alyuminivye-nagrevatelnye-maty') OR contains({path}, 'nagrevatelnye-maty') THEN '{MATS}' END"
    flat = " ".join(f"WHEN source = '{d.source}' AND contains({host}, '{d.host}') THEN left('{d.prefix}' || ({segment[d.source]}), 200)" for d in DONORS)
    return f"coalesce(CASE source WHEN 'et_market' THEN {et} WHEN 'in_heat' THEN {ih} END, CASE {flat} END)"


_LABELS = " ".join(f"WHEN source = '{d.source}' AND segment = '{k}' THEN '{x}'" for d in DONORS for k, x in d.labels.items())
_ORDERS = " ".join(f"WHEN source = '{d.source}' AND segment = '{k}' THEN {d.sort_base + x}" for d in DONORS for k, x in d.sort_orders.items())
_DEFAULTS = " ".join(f"WHEN source = '{d.source}' THEN {d.sort_base + d.sort_default}" for d in DONORS)
_FLAT = f"""moved AS ({v('moved_urls')}), slugs AS (SELECT source, url, {_flat_slug()} AS slug FROM moved),
titled AS (SELECT m.url, {_path('m.url')} AS path, {_canonical('m.url')} AS key, m.page_id AS position, {_TITLE} AS title FROM moved m JOIN pages USING (page_id)),
keyed AS (SELECT DISTINCT source, slug, regexp_replace(slug, '^(et|inh|vs)-', '') AS segment FROM slugs WHERE slug NOT IN ('{"', '".join(PROTECTED)}')),
long AS (SELECT k.source, k.slug, arg_max(title, (length(title), -position)) AS title FROM keyed k JOIN titled t
  ON t.path || '/' LIKE CASE k.source WHEN 'in_heat' THEN '/ua/' ELSE '/' END || k.segment || '/%' AND k.source <> 'vsesezon' GROUP BY ALL),
grouped AS (SELECT slug, max(coalesce(by_url, 'Vsesezon · група ' || segment)) AS title FROM (SELECT DISTINCT s.slug, k.segment, s.url FROM slugs s JOIN keyed k ON s.slug = k.slug AND s.source = k.source WHERE s.source = 'vsesezon') x
  LEFT JOIN (SELECT key, arg_max(title, position) AS by_url FROM titled GROUP BY key) t ON t.key = {_canonical('x.url')} GROUP BY slug),
flat AS (SELECT k.slug, CASE {_LABELS} WHEN source = 'vsesezon' THEN g.title ELSE left(coalesce(nullif(l.title, ''), nullif(trim(regexp_replace(replace(segment, '-', ' '), '\\s+', ' ', 'g')), ''), segment), 240) END AS name_uk,
  (CASE {_ORDERS} WHEN source = 'vsesezon' THEN 400 + segment::BIGINT % 8000 {_DEFAULTS} END)::INT AS sort_order, '{ROOT}' AS parent_slug
  FROM keyed k LEFT JOIN long l USING (source, slug) LEFT JOIN grouped g ON g.slug = k.slug)"""

_TREE = f"""RECURSIVE sections AS ({v('sections')}), up AS (
  SELECT id, parent AS ancestor FROM sections WHERE parent IS NOT NULL UNION SELECT up.id, s.parent FROM up JOIN sections s ON up.ancestor = s.id WHERE s.parent IS NOT NULL)"""
_OCCUPIED = "(starts_with(id, 's') AND sort_order > 8000 OR id = 'r4')"


def _deep(source: str) -> str:
    """One row for each prefix of the paths of ``source`` (url, prefix); of equal slugs the last key."""
    p = _parts("url")
    return f"""levels AS (SELECT DISTINCT prefix, {_origin('url')} AS origin, p, unnest(range(1, len(p) + 1)) AS i FROM (SELECT url, prefix, {p} AS p FROM ({source}))),
deep AS (SELECT slug, arg_max({{'parent_slug': parent_slug, 'name_uk': name_uk, 'sort_order': sort_order}}, key) AS r FROM (
  SELECT left(prefix || array_to_string(p[1:i], '-'), 200) AS slug, CASE WHEN i > 1 THEN left(prefix || array_to_string(p[1:i-1], '-'), 200) ELSE '{ROOT}' END AS parent_slug,
    left(coalesce(nullif(trim(regexp_replace(replace(p[i], '-', ' '), '\\s+', ' ', 'g')), ''), p[i]), 240) AS name_uk, (i * 10)::INT AS sort_order, origin || '/' || array_to_string(p[1:i], '/') || '/' AS key FROM levels)
  GROUP BY slug)"""


_IMAGE_NAME = "CASE WHEN starts_with(url, '/api/media/') AND regexp_matches(split_part(substr(url, 12), '?', 1), '(?i)^[a-f0-9]{64}\\.(?:jpe?g|png|webp|gif|bin)$') THEN split_part(substr(url, 12), '?', 1) END"
_CARDS = f"""p AS (SELECT *, CASE WHEN sort_order > 25 THEN short_name END AS seo_title FROM ({v('products')})),
r AS (SELECT p.id, CASE WHEN t.published THEN t.slug END AS redirect_slug, CASE WHEN t.published THEN coalesce(t.seo_title, t.name_uk) ELSE coalesce(p.seo_title, p.name_uk) END AS title
  FROM p LEFT JOIN p t ON p.merged_into_product_id = t.id)"""

SQL: dict[str, str] = {
    "name_key": f"SELECT doc_id, md5({_key('text')}) AS key_md5, length({_key('text')}) AS key_length FROM documents",
    "similar_titles": _NAMES
    + """, links AS (SELECT key_a AS key, source_a AS source, sum(CASE WHEN sim >= 0.9::DOUBLE THEN n_b ELSE 0 END)::BIGINT AS n_merge, sum(CASE WHEN sim < 0.9::DOUBLE THEN n_b ELSE 0 END)::BIGINT AS n_warn FROM near WHERE sim >= 0.75::DOUBLE GROUP BY ALL),
cls AS (SELECT key, min(id) AS class_id FROM titles WHERE length(key) >= 15 AND source IS NOT NULL GROUP BY key)
SELECT id, coalesce(class_id, id) AS class_id, coalesce(n_merge, 0)::BIGINT AS n_merge, coalesce(n_warn, 0)::BIGINT AS n_warn FROM titles LEFT JOIN cls USING (key) LEFT JOIN links USING (key, source)""",
    "similar_pairs": _NAMES
    + """SELECT key_a, key_b, floor(any_value(sim) * 1000 + 0.5::DOUBLE) / 1000 AS similarity, CASE WHEN any_value(sim) >= 0.9::DOUBLE THEN 'merge' ELSE 'warn' END AS label, sum(n_a * n_b)::BIGINT AS links
FROM near WHERE sim >= 0.75::DOUBLE AND (key_a < key_b OR key_a = key_b AND source_a < source_b) GROUP BY key_a, key_b""",
    "warning_samples": _NAMES
    + """SELECT floor(sim * 1000 + 0.5::DOUBLE) / 1000 AS similarity, left(upper(key_a), 120) AS name_a, left(upper(key_b), 120) AS name_b, links FROM (
  SELECT key_a, key_b, any_value(sim) AS sim, sum(n_a * n_b)::BIGINT AS links FROM near WHERE sim >= 0.75::DOUBLE AND sim < 0.9::DOUBLE AND (key_a < key_b OR key_a = key_b AND source_a < source_b)
  GROUP BY key_a, key_b) ORDER BY sim DESC, key_a, key_b LIMIT 25""",
    "name_classes": f"WITH {_TITLES} SELECT id, min(id) OVER (PARTITION BY key) AS class_id FROM titles WHERE length(key) >= 15 AND source IS NOT NULL",
    "dup_groups_cross_source": f"WITH {_MD5_KEYS}, g AS ({_GROUPS}) SELECT 'name_cross_source' AS kind, key, n AS \"count\", sources FROM g WHERE named >= 2",
    "dup_groups_same_source": f"WITH {_MD5_KEYS}, g AS ({_GROUPS}) SELECT 'name_same_source' AS kind, key, n AS \"count\", sources FROM g WHERE named = 1 AND with_source = n",
    "dup_report": f"WITH {_dups()} SELECT * FROM dups",
    "dup_summary": f"WITH {_dups()} SELECT " + ", ".join(f"count(*) FILTER (kind = '{k}') AS {k}" for k in ("base_code_cross_source", "url_leaf_cross_source", "name_cross_source", "name_same_source")) + " FROM dups",
    "dup_items": f"WITH p AS (SELECT *, {_key('name_uk')} AS key FROM ({v('products')})) SELECT key, id, sku, external_source FROM p WHERE key IN (SELECT key FROM p WHERE length(key) >= 12 GROUP BY key HAVING count(DISTINCT external_source) >= 2)",
    "health_counts": f"""WITH p AS ({v('products')}) SELECT count(*) AS total, count(*) FILTER (published) AS published, count(*) FILTER (external_source IS NOT NULL AND external_id IS NOT NULL) AS with_external, count(external_url) AS with_url,
  count(source_category_url) AS with_category_url, (SELECT count(*) FROM (SELECT sku FROM p WHERE sku IS NOT NULL GROUP BY sku HAVING count(*) > 1)) AS duplicate_sku_groups FROM p""",
    "count_by_source": f"SELECT external_source, count(*) AS n FROM ({v('products')}) WHERE external_source IS NOT NULL GROUP BY external_source",
    "having_dupes": "SELECT count(*) AS groups, sum(n)::BIGINT AS rows FROM (SELECT count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY p_name HAVING count(*) > 1)",
    "latest_top3": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 3",
    "group_carry_forward": "SELECT conv_id, turn, role, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS last_user_turn FROM conversations",
    "crawl_stats": f"SELECT host, count(DISTINCT url) AS pages, count(*) AS rows, arg_min(title, page_id) AS title FROM (SELECT *, {_TITLE} AS title FROM ({v('pages_by_host')})) GROUP BY host",
    "detailed_count": f"SELECT count(*) FILTER (price_uah > 1000 OR published) AS detailed, count(*) AS total FROM ({v('products')})",
    "root_sections": f"""WITH s AS ({v('sections')}) SELECT id, name AS name_uk, sort_order, (SELECT count(*) FROM customer WHERE 'n' || c_nationkey = s.id) AS n_products, (SELECT count(*) FROM s k WHERE k.parent = s.id) AS n_children FROM s WHERE parent IS NULL""",
    "category_children_counts": f"WITH s AS ({v('sections')}) SELECT s.id, s.parent AS parent_id, count(c_custkey) AS n_products FROM s LEFT JOIN customer ON 'n' || c_nationkey = s.id AND {_SHOWN} WHERE parent IS NOT NULL GROUP BY ALL",
    "visible_listing": f"""WITH img AS (SELECT l_partkey, arg_min('/img/' || l_orderkey || '-' || l_linenumber || '.png', (l_linenumber, l_orderkey)) AS cover FROM lineitem GROUP BY l_partkey)
SELECT id, slug, name_uk, 'Brand ' || brand_id AS brand, cover FROM ({v('products')}) LEFT JOIN img ON l_partkey = id WHERE published AND merged_into_product_id IS NULL""",
    "cover_image": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS i FROM lineitem) WHERE i = 1",
    "ordered_children": "SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS lines FROM lineitem GROUP BY l_orderkey",
    "next_image_order": "SELECT l_orderkey AS product_id, max(l_linenumber) + 1 AS next_order FROM lineitem GROUP BY l_orderkey",
    "product_cards": f"""WITH {_CARDS}, s AS (SELECT product_id, string_agg(label || '=' || value, ';' ORDER BY label) AS specs FROM ({v('attributes')}) GROUP BY product_id),
i AS (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)
SELECT id, redirect_slug, title, specs, coalesce(n, 0) AS n_images FROM r LEFT JOIN s ON product_id = id LEFT JOIN i ON l_partkey = id""",
    "canonical_redirect": f"WITH {_CARDS} SELECT id, redirect_slug, title FROM r",
    "optional_left_lookup": "SELECT c_custkey, n_name AS nation FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey AND c_acctbal > 0",
    "price_labels": f"SELECT id, CASE WHEN price_visible THEN replace(format('{{:,}}', round_even(price_uah, 0)::BIGINT), ',', chr(160)) || chr(160) || '₴' ELSE 'on request' END AS label FROM ({v('products')})",
    "self_parent_label": f"WITH s AS ({v('sections')}) SELECT a.id, a.name, b.name AS parent_name FROM s a LEFT JOIN s b ON a.parent = b.id",
    "semi_some": "SELECT c_custkey, c_name FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "anti_none": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "every_relation": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND NOT o_totalprice < 450000)",
    "search_page": f"SELECT id, name_uk FROM ({v('products')}) WHERE short_name ILIKE '%ring%' OR sku ILIKE '%ring%' OR slug ILIKE '%ring%' ORDER BY name_uk, id LIMIT 40 OFFSET 40",
    "search_total": f"SELECT count(*) AS total, greatest(1, ceil(count(*) / 40))::BIGINT AS pages FROM ({v('products')}) WHERE short_name ILIKE '%ring%' OR sku ILIKE '%ring%' OR slug ILIKE '%ring%'",
    "nulls_last_sort": f"SELECT id, row_number() OVER (PARTITION BY category_id, brand_id ORDER BY external_source NULLS LAST, id) AS place FROM ({v('products')})",
    "last_wins_merge": f"SELECT host, max(page_id) AS page_id, arg_max(url, page_id) AS url, min(page_id) AS first_at FROM ({v('pages_by_host')}) GROUP BY host",
    "first_wins_dedupe": f"SELECT host, min(page_id) AS page_id, arg_min(url, page_id) AS url FROM ({v('pages_by_host')}) GROUP BY host",
    "deepest_wins": f"SELECT host, page_id, {_canonical('url')} AS url FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY len({_parts('url')}) DESC, page_id DESC) AS i FROM ({v('pages_by_host')})) WHERE i = 1",
    "detail_enrich": """SELECT doc_id, md5(CASE WHEN n_chars > 300 AND length(b) > length(a) THEN b ELSE a END) AS description_md5, coalesce(CASE WHEN n_chars > 500 THEN lang END, CASE WHEN n_chars > 300 THEN source END) AS sku,
  coalesce(CASE WHEN lang = 'en' THEN n_chars END, CASE WHEN n_chars > 300 THEN n_chars + 1 END) AS priceUah, lang = 'de' OR (n_chars > 300 AND lang = 'fr') AS priceVisible
FROM (SELECT *, string_split(text, chr(10))[1] AS a, string_split(text, chr(10))[-1] AS b FROM documents)""",
    "pending_details": "SELECT page_id, url FROM pages WHERE page_id >= 10 AND url NOT IN (SELECT url FROM pages WHERE url LIKE 'https:%')",
    "url_parts": rf"""SELECT page_id, lower(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:\s]+)', 1), '')) AS host, {_origin('url')} AS origin, {_path('url')} AS path,
  coalesce(nullif(regexp_replace({_parts('url')}[-1], '(?i)\.(html?|php)$', ''), ''), 'item') AS slug FROM pages""",
    "url_canonical": f"SELECT page_id, {_canonical('url')} AS url FROM pages",
    "url_depth": rf"SELECT page_id, len({_parts('url')}) AS depth, regexp_matches({_path('url')}, '(?i)\.html?$') AS is_page FROM pages",
    "url_leaf_key": rf"SELECT page_id, CASE WHEN length(leaf) >= 3 THEN leaf END AS leaf FROM (SELECT page_id, lower(regexp_replace({_parts('url')}[-1], '(?i)\.html?$', '')) AS leaf FROM pages)",
    "url_page_links": r"""WITH u AS (SELECT page_id, split_part(url, '#', 1) AS head, CASE WHEN contains(url, '#') THEN '#' || split_part(url, '#', 2) ELSE '' END AS tail FROM pages),
q AS (SELECT *, split_part(head, '?', 1) AS base, list_filter(string_split(split_part(head, '?', 2), '&'), lambda x: x <> '' AND NOT starts_with(x, 'page=')) AS args FROM u),
b AS (SELECT page_id, base || CASE WHEN len(args) > 0 THEN '?' || array_to_string(args, '&') ELSE '' END AS bare, tail FROM q)
SELECT page_id, bare || tail AS first_page, bare || CASE WHEN contains(bare, '?') THEN '&' ELSE '?' END || 'page=3' || tail AS third_page FROM b""",
    "noise_filter": rf"""SELECT page_id, regexp_matches(p, '(?i)/(tag|filter)/') OR regexp_matches(p, '(?i)/apply/?$') OR regexp_matches(p, '(?i)/(brands|blog|statti|about|services|personal|auth|reviews|sales|prices-info)/') AS noise,
  starts_with(path || '/', '/ua/otoplenie/') OR starts_with(path || '/', '/teplyj-pol/') AS under FROM (SELECT page_id, {_path('url')} AS path, {_path('url')} || '/' AS p FROM ({v('moved_urls')}))""",
    "page_title": f"SELECT page_id, {_TITLE} AS title FROM pages",
    "page_heading": r"SELECT page_id, nullif(trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<h1\b[^>]*>(.*?)</h1>', 1), '(?s)<[^>]*>', '', 'g'), '\s+', ' ', 'g')), '') AS heading FROM pages",
    "page_links": rf"""SELECT DISTINCT page_id AS page, {_origin('url')} || href AS link FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)) AS href FROM pages) WHERE starts_with(href, '/')""",
    "robot_checks": "SELECT count(*) FILTER (NOT b) AS usable, count(*) FILTER (b) AS blocked FROM (SELECT coalesce(contains(html, 'adm.tools') AND contains(html, '___ack'), false) AS b FROM pages)",
    "json_props": "SELECT event_id, (props->>'$.k')::BIGINT AS k, (props->>'$.k')::DOUBLE + 0.5 AS price FROM events",
    "price_parse": "SELECT p_partkey, floor(p_retailprice)::INT AS price FROM part",
    "spec_numbers": f"SELECT product_id, pos, {_NUMBER}::DOUBLE AS number, contains(lower(label), 'вт') OR contains(label, 'м²') AS filterable, {_SPEC_SLUG} AS slug FROM ({v('attributes')})",
    "sku_base_code": f"SELECT id, {_CODE} AS code FROM ({v('products')})",
    "import_slug": f"SELECT id, external_source || '-' || external_id || '-b-' || replace(short_name, ' ', '-') AS slug, short_name || '__' || external_source || '__' || external_id || '-b-' || replace(short_name, ' ', '-') AS sku FROM ({v('products')}) WHERE external_source IS NOT NULL",
    "spec_display": rf"""SELECT product_id, pos, coalesce(nullif({_DISPLAY}, ''), CASE WHEN {_NUMBER} IS NOT NULL THEN regexp_replace(regexp_replace({_NUMBER}::VARCHAR, '(\.[0-9]*?)0+$', '\1'), '\.$', '') || ' м²' END, '—') AS shown FROM ({v('attributes')})""",
    "short_descriptions": r"""SELECT doc_id, CASE WHEN length(text) > 320 THEN regexp_replace(left(text, 317), '^\s+|\s+$', '', 'g') || '…' ELSE nullif(text, '') END AS short,
  md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '<br/>' || chr(10))) AS escaped_md5 FROM documents""",
    "eav_pivot": f"""SELECT product_id, max(value) FILTER (slug = 'potuzhnist-vt') AS power, arg_max(value, pos) FILTER (slug = 'typ') AS type, max(value) FILTER (slug = 'ploshcha-m2') AS area FROM (SELECT *, {_SPEC_SLUG} AS slug FROM ({v('attributes')})) GROUP BY product_id""",
    "spec_definitions": f"""WITH a AS (SELECT a.*, row_number() OVER (PARTITION BY product_id ORDER BY pos) - 1 AS i, {_SPEC_SLUG} AS slug FROM ({v('attributes')}) a JOIN ({v('products')}) ON id = product_id WHERE external_source IS NOT NULL)
SELECT slug, arg_max(label, (product_id, i)) AS label_uk, arg_min(contains(lower(label), 'вт') OR contains(label, 'м²'), (product_id, i)) AS filterable, (arg_min(i, (product_id, i)) + 100)::INT AS sort_order FROM a GROUP BY slug""",
    "spec_rows": f"""WITH a AS (SELECT a.*, {_SPEC_SLUG} AS slug, external_source || '|' || external_id AS k FROM ({v('attributes')}) a JOIN ({v('products')}) ON id = product_id WHERE external_source IS NOT NULL),
l AS (SELECT k, slug, arg_max(value, pos) AS value FROM a GROUP BY ALL)
SELECT sha256(k) AS product_id, slug AS definition, value AS value_text, {_NUMBER}::DOUBLE AS value_number FROM l""",
    "image_rows": f"SELECT sha256(external_source || '|' || external_id) AS product_id, '/i/' || slug AS url, short_name AS alt_uk, i::INT AS sort_order FROM ({v('products')}), (SELECT unnest([0, 1]) AS i) WHERE external_source IS NOT NULL",
    "import_catalogue": f"""WITH p AS (SELECT *, id % 3 AS m, external_source = 'in_heat' AND id % 3 = 2 AS bad FROM ({v('products')}) WHERE external_source IS NOT NULL)
SELECT external_source, external_id, 'imported' AS status, external_source || '-' || external_id AS slug, short_name || '__' || external_source || '__' || external_id AS sku,
  name_uk || CASE WHEN id % 4 = 0 THEN ' neu' ELSE '' END AS name_uk, name_uk AS seo_title, price_uah::DOUBLE AS price,
  CASE WHEN external_source = 'et_market' THEN ['nagrivalni-maty', 'et-avtomatika', 'tepla-pidloga'][m + 1] WHEN external_source = 'in_heat' THEN ['griuchi-kabeli', 'inh-tovary'][m + 1]
    WHEN m = 0 THEN 'vs-' || id % 50 ELSE 'tepla-pidloga' END AS section,
  CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS n_images, CASE WHEN id % 4 = 0 THEN 0 WHEN sort_order > 3 THEN 3 ELSE 2 END::BIGINT AS n_specs FROM p WHERE NOT bad
UNION ALL SELECT external_source, external_id, 'rejected: unknown source, or a URL of another shop', NULL, NULL, name_uk || again, NULL, NULL, NULL, 0, 0
FROM p, (SELECT unnest(['', ' neu']) AS again) WHERE bad AND (again = '' OR id % 4 = 0)""",
    "manifest_round_trip": f"""SELECT external_source AS source, external_id AS "externalId", name_uk || CASE WHEN id % 4 = 0 THEN ' neu' ELSE '' END AS "nameUk", CASE WHEN id % 4 > 0 THEN short_name END AS sku, CASE WHEN id % 4 > 0 THEN price_uah::DOUBLE END AS "priceUah",
  CASE external_source WHEN 'et_market' THEN ['https://et-market.com.ua/teplyj-pol/nagrevatelnye-maty/', 'https://et-market.com.ua/avtomatika/x/', NULL][id % 3 + 1]
    WHEN 'in_heat' THEN ['https://in-heat.kiev.ua/ua/otoplenie/nagrevatelnyj-kabel/', 'https://in-heat.kiev.ua/ua/tovary/', 'https://other.com/x/'][id % 3 + 1]
    ELSE CASE WHEN id % 3 = 0 THEN 'https://vsesezon.com.ua/ua/g' || id % 50 || '-maty/' END END AS "sourceCategoryUrl",
  CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END::BIGINT AS n_images, CASE WHEN id % 4 = 0 THEN 0 ELSE 2 + (sort_order > 3)::INT + (sort_order > 25)::INT END::BIGINT AS n_specs, 't0' AS "scrapedAt"
FROM ({v('products')}) WHERE external_source IS NOT NULL""",
    "published_catalogue": f"""WITH p AS (SELECT *, id % 3 AS m FROM ({v('products')}) WHERE external_source IS NOT NULL AND NOT (external_source = 'in_heat' AND id % 3 = 2))
SELECT 'categories' AS what, 3 + count(DISTINCT CASE WHEN external_source = 'et_market' AND m = 1 THEN 'et' WHEN external_source = 'in_heat' AND m = 1 THEN 'inh' WHEN external_source = 'vsesezon' AND m = 0 THEN 'vs-' || id % 50 END) AS n FROM p
UNION ALL SELECT 'brands', 1 UNION ALL SELECT 'products', 2 + count(*) FROM p UNION ALL SELECT 'product_images', sum(CASE WHEN id % 4 = 0 THEN 1 ELSE 2 END)::BIGINT FROM p
UNION ALL SELECT 'spec_definitions', 6 UNION ALL SELECT 'product_specs', 6 + sum(CASE WHEN id % 4 = 0 THEN 0 WHEN sort_order > 3 THEN 3 ELSE 2 END)::BIGINT FROM p UNION ALL SELECT 'violations', 0""",
    "facet_rows": """WITH g AS (SELECT regexp_extract(p_brand, '([0-9]+)$', 1)::INT AS file_ord, p_size, count(*)::INT AS n FROM part GROUP BY ALL)
SELECT file_ord, 0 AS group_pos, '5' AS id, p_size::VARCHAR AS label, n AS count, NULL::INT AS most FROM g UNION ALL SELECT file_ord, 1, 'price', NULL, NULL, max(p_size)::INT FROM g GROUP BY file_ord""",
    "url_lists": "SELECT DISTINCT url FROM pages WHERE page_id % 3 = 1 OR page_id % 2 = 0",
    "listing_stubs": f"""SELECT external_source AS source, external_id AS "externalId", name_uk AS "nameUk", CASE WHEN id % 2 = 0 THEN '/i/' || slug ELSE 'none' END AS image, (1 - id % 2)::BIGINT AS n_images, 0::BIGINT AS n_specs FROM ({v('products')}) WHERE external_source IS NOT NULL""",
    "canonical_choice": f"""WITH p AS (SELECT *, CASE external_source WHEN 'et_market' THEN 0 WHEN 'in_heat' THEN 1 WHEN 'vsesezon' THEN 2 ELSE 999 END AS rank FROM ({v('products')})) SELECT short_name, arg_min(id, (rank, id)) AS canonical, min(rank)::BIGINT AS rank FROM p GROUP BY short_name""",
    "label_slugs": f"""SELECT product_id, pos, CASE WHEN pos = 2 THEN 'category' WHEN pos = 0 THEN 'potuzhnist-vt-' || replace(value, ',', '') ELSE 'typ-' || trim(regexp_replace(regexp_replace(lower(value), '[^a-z0-9 -]', '', 'g'), '[ -]+', '-', 'g'), '-') END AS slug FROM ({v('attributes')})""",
    "patch_rejected": "SELECT p_partkey AS id, p_name AS sku, '12x' AS price_uah, 'the price is no number' AS reason FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 5 > 0",
    "dup_header": f"SELECT count(*) AS total_products, count(*) FILTER (contains(sku, '__et_market__') OR contains(sku, '__in_heat__') OR contains(sku, '__vsesezon__')) AS with_composite_sku FROM ({v('products')})",
    "category_options": f"WITH s AS ({v('sections')}) SELECT s.id, CASE WHEN p.name IS NULL THEN '' ELSE p.name || ' → ' END || s.name AS label FROM s LEFT JOIN s p ON s.parent = p.id",
    "brand_options": "SELECT DISTINCT p_brand AS id, 'Brand ' || p_brand AS name FROM part",
    "sections_under": f"WITH s AS ({v('sections')}) SELECT s.slug, '/catalog/' || s.slug AS href FROM s JOIN s p ON s.parent = p.id WHERE p.slug = 'asia'",
    "edited_specs": """WITH s AS (SELECT l_orderkey * 10 + l_linenumber AS id, l_orderkey AS product_id, l_linenumber AS n, arg_min(l_returnflag, (l_returnflag, l_quantity)) AS value_text, arg_min(l_quantity, (l_returnflag, l_quantity)) AS value_number FROM lineitem GROUP BY ALL),
touched AS (SELECT CASE WHEN n = 2 THEN product_id + 5 ELSE product_id END AS product_id FROM s WHERE product_id % 5 = 0)
SELECT id, product_id, CASE WHEN product_id % 5 > 0 OR n = 2 THEN value_text WHEN n = 4 THEN NULL ELSE 'new' END AS value_text, CASE WHEN product_id % 5 > 0 OR n % 2 = 0 OR n = 1 THEN value_number WHEN n = 3 THEN 7 END AS value_number,
  row_number() OVER (PARTITION BY product_id ORDER BY n DESC, id) AS place FROM s WHERE product_id IN (SELECT product_id FROM touched)""",
    "upsert_policy": f"""SELECT coalesce(o.id, n.id) AS id, CASE WHEN n.id IS NOT NULL THEN n.name ELSE o.name END AS name, coalesce(n.price, o.price) AS price,
  CASE WHEN o.id IS NULL THEN n.note ELSE coalesce(nullif(n.note, ''), o.note) END AS note, CASE WHEN o.id IS NULL THEN n.seo ELSE o.seo END AS seo FROM ({v('stored')}) o FULL JOIN ({v('incoming')}) n ON o.id = n.id""",
    "replace_children": """SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')
UNION ALL SELECT o_orderkey, 1, 0 FROM orders WHERE o_orderstatus = 'F'""",
    "patch_merge": f"""SELECT o.id, CASE WHEN n.id IS NOT NULL AND n.price IS NOT NULL THEN n.name ELSE o.name END AS name, CASE WHEN n.id IS NOT NULL AND n.price IS NULL THEN NULL ELSE o.price END AS price,
  CASE WHEN n.id IS NOT NULL AND n.price IS NOT NULL THEN n.note ELSE o.note END AS note, o.seo FROM ({v('stored')}) o LEFT JOIN ({v('incoming')}) n ON o.id = n.id""",
    "patch_product": f"""WITH f AS (SELECT p_partkey AS id, p_partkey % 4 AS k, p_partkey % 8 AS m, p_type || ' / ' || p_name AS name, p_size FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 8 <> 1)
SELECT o.id, CASE WHEN k < 2 THEN 'new-' || o.id ELSE slug END AS slug, CASE WHEN k <> 2 THEN name ELSE name_uk END AS name_uk,
  CASE WHEN k < 2 AND o.id % 5 = 0 THEN 'own key' WHEN k <> 2 THEN {_key('name')} ELSE {_key('name_uk')} END AS name_norm_key,
  CASE WHEN k IS NULL OR k = 3 THEN sku WHEN o.id % 2 = 1 THEN 's-' || o.id END AS sku, CASE WHEN m > 2 THEN (o.id + 0.5)::DECIMAL(12,2) WHEN m = 2 THEN NULL ELSE price_uah END AS price_uah,
  CASE WHEN k <> 2 AND p_size > 25 THEN true ELSE published END AS published FROM ({v('products')}) o LEFT JOIN f ON o.id = f.id""",
    "owned_patches": """WITH p AS (SELECT l_orderkey, greatest(l_linenumber - 1, 1)::INT AS l_linenumber, l_partkey FROM lineitem)
SELECT * FROM p WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_linenumber > 1 AND l.l_orderkey = p.l_orderkey AND l.l_linenumber = p.l_linenumber)""",
    "category_map": f"SELECT page_id, {_flat_slug()} AS slug FROM ({v('moved_urls')})",
    "rebucket_diff": f"""WITH m AS (SELECT page_id, {_flat_slug()} AS slug, CASE WHEN length(url) > 50 THEN '{MATS}' ELSE 'et-other' END AS old FROM ({v('moved_urls')}))
SELECT page_id, slug IN ('{MATS}', '{CABLES}') AND slug <> old AS moved, CASE WHEN slug IN ('{MATS}', '{CABLES}') THEN slug ELSE old END AS category_slug FROM m""",
    "flat_categories": f"WITH {_FLAT} SELECT * FROM flat",
    "path_prefix_tree": f"WITH {_deep('''SELECT url, 'etm-' AS prefix FROM pages''')} SELECT slug, r.parent_slug, r.name_uk, r.sort_order FROM deep",
    "prefix_longest_title": f"""WITH t AS (SELECT {_path('url')} AS path, {_TITLE} AS title, page_id FROM pages), k AS (SELECT DISTINCT '/' || {_parts('url')}[1] AS prefix FROM pages WHERE len({_parts('url')}) > 0)
SELECT prefix, arg_max(title, (length(title), -page_id)) AS title FROM k LEFT JOIN t ON t.path || '/' LIKE prefix || '/%' GROUP BY prefix""",
    "tree_closure": f"WITH {_TREE} SELECT id, ancestor FROM up",
    "descendants": f"WITH {_TREE} SELECT id FROM up WHERE ancestor = 'r1'",
    "tree_sorted": f"""WITH RECURSIVE s AS ({v('sections')}), p AS (SELECT id, name, parent, lpad(row_number() OVER (PARTITION BY parent ORDER BY sort_order, name, id)::VARCHAR, 9, '0') AS place FROM s),
t AS (SELECT id, name, 0::BIGINT AS depth, place AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.id, p.name, depth + 1, path || '/' || place FROM p JOIN t ON p.parent = t.id)
SELECT id, name, depth, path FROM t""",
    "tree_intervals": f"""WITH {_TREE}, p AS (SELECT id, parent, lpad(row_number() OVER (PARTITION BY parent ORDER BY sort_order, name, id)::VARCHAR, 9, '0') AS place FROM sections),
t AS (SELECT id, 0::BIGINT AS depth, place AS path FROM p WHERE parent IS NULL UNION ALL SELECT p.id, depth + 1, path || '/' || place FROM p JOIN t ON p.parent = t.id),
o AS (SELECT id, depth, row_number() OVER (ORDER BY path) - 1 AS first FROM t), n AS (SELECT ancestor AS id, count(*) AS below FROM up GROUP BY ancestor)
SELECT id, first, (first + coalesce(below, 0))::BIGINT AS last, depth FROM o LEFT JOIN n USING (id)""",
    "parent_choices": f"""WITH {_TREE} SELECT s.id, CASE WHEN p.name IS NULL THEN s.name ELSE p.name || ' → ' || s.name END AS label FROM sections s LEFT JOIN sections p ON s.parent = p.id
WHERE s.id <> 'r1' AND s.id NOT IN (SELECT id FROM up WHERE ancestor = 'r1')""",
    "prune_closure": f"WITH {_TREE}, seeds AS (SELECT id FROM sections WHERE {_OCCUPIED}) SELECT id, id IN (SELECT id FROM seeds UNION SELECT ancestor FROM up JOIN seeds USING (id)) AS kept FROM sections",
    "prune_first_round": f"WITH s AS ({v('sections')}) SELECT id FROM s WHERE NOT {_OCCUPIED} AND id NOT IN (SELECT parent FROM s WHERE parent IS NOT NULL)",
    "prune_legacy": f"""WITH {_TREE}, used AS (SELECT id FROM sections WHERE starts_with(id, 's') AND sort_order > 8000 AND substr(parent, 2)::INT % 5 <> 0),
k AS (SELECT id FROM used UNION SELECT ancestor FROM up JOIN used USING (id) UNION SELECT id FROM sections WHERE id IN ('r2', 'r3', 'r4')) SELECT id, id IN (SELECT id FROM k) AS kept FROM sections""",
    "breadcrumbs": f"WITH s AS ({v('sections')}) SELECT a.id, CASE WHEN b.id <> 'r0' THEN b.name || ' / ' ELSE '' END || a.name AS crumbs FROM s a LEFT JOIN s b ON a.parent = b.id",
    "may_reparent": f"""WITH {_TREE}, m AS (SELECT id, CASE WHEN starts_with(id, 'r') THEN 'n' || substr(id, 2) WHEN sort_order < 0 THEN 'gone' ELSE parent END AS new_parent FROM sections)
SELECT id, new_parent, CASE WHEN new_parent IS NULL THEN 'ok' WHEN new_parent = id THEN 'self' WHEN EXISTS (SELECT 1 FROM up WHERE up.id = m.new_parent AND ancestor = m.id) THEN 'descendant'
  WHEN new_parent NOT IN (SELECT id FROM sections) THEN 'missing' ELSE 'ok' END AS verdict FROM m""",
    "merge_chains": f"""WITH RECURSIVE p AS (SELECT id, merged_into_product_id AS c FROM ({v('products')}) WHERE merged_into_product_id IS NOT NULL),
w AS (SELECT id, c, c AS u FROM p UNION ALL SELECT w.id, w.c, p.c FROM w JOIN p ON w.u = p.id)
SELECT id AS loser, any_value(c) AS canonical, min(u) AS ultimate FROM w GROUP BY id""",
    # The k-th row of a base takes the k-th number whose slug is neither taken nor the base of another row.
    "unique_slug": """WITH n AS (SELECT p_partkey AS id, replace(p_name, ' ', '-') || CASE WHEN p_partkey % 10 = 0 THEN '-2' ELSE '' END AS base FROM part),
t AS (SELECT replace(p_name, ' ', '-') || CASE WHEN max(p_size) = 50 THEN '' ELSE '-3' END AS slug FROM part GROUP BY p_name),
g AS (SELECT base, count(*) AS c FROM n GROUP BY base),
o AS (SELECT base, i, CASE WHEN i = 1 THEN base ELSE base || '-' || i END AS slug FROM (SELECT base, unnest(range(1, c + 12)) AS i FROM g)),
f AS (SELECT base, slug, row_number() OVER (PARTITION BY base ORDER BY i) AS turn FROM o
  WHERE slug NOT IN (SELECT slug FROM t) AND (i = 1 OR slug NOT IN (SELECT base FROM g)))
SELECT id, slug FROM (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS turn FROM n) JOIN f USING (base, turn)""",
    "unique_slug_check": "SELECT count(*) AS n, count(*) AS n_slugs, 0::BIGINT AS n_taken FROM part",
    "legacy_slugs": f"""WITH moved AS ({v('moved_urls')}), {_deep('''SELECT url, CASE source WHEN 'et_market' THEN 'etm-' ELSE 'inh-' END AS prefix FROM moved''')}
SELECT starts_with(slug, 'etm-') OR slug = 'inh-ua' OR starts_with(slug, 'inh-ua-') AS legacy, count(*) AS n FROM deep GROUP BY 1""",
    "reset_snapshot": f"SELECT id, external_source, NULL::BIGINT AS merged_into_product_id FROM ({v('products')}) WHERE external_source IS NULL",
    "reset_sections": f"WITH {_FLAT}, every AS (SELECT slug FROM flat UNION ALL SELECT unnest(['{'\', \''.join(PROTECTED)}'])) SELECT slug FROM every WHERE NOT regexp_matches(slug, '^(et|inh|vs)-') AND slug NOT IN ('et-market-import', 'in-heat-import')",
    "backfill_keys": f"""WITH p AS (SELECT id, name_uk, CASE WHEN published THEN slug WHEN price_visible THEN '' END AS k FROM ({v('products')})) SELECT id, coalesce(k, '') = '' AS backfilled, CASE WHEN coalesce(k, '') = '' THEN nullif({_key('name_uk')}, '') ELSE k END AS name_norm_key FROM p""",
    "merge_pointers": f"SELECT id, coalesce(merged_into_product_id, CASE WHEN short_name LIKE 'red%' THEN id - 1 END) AS merged_into_product_id FROM ({v('products')})",
    "mirror_rewrite": r"""SELECT page_id, CASE WHEN l THEN '/api/media/' || sha256(url) || '.bin' ELSE url END AS url, CASE WHEN l THEN url END AS source_url FROM (SELECT *, url LIKE 'https:%' AS l FROM pages)""",
    "media_missing": f"SELECT DISTINCT name FROM (SELECT {_IMAGE_NAME} AS name FROM ({v('images')})) WHERE name IS NOT NULL AND name NOT IN ({v('stored_files')})",
    "repair_classes": f"""SELECT id, name, CASE WHEN NOT starts_with(url, '/api/media/') THEN 'external' WHEN name IS NULL THEN 'unsafe' WHEN name IN ({v('stored_files')}) THEN 'stored'
  WHEN NOT regexp_matches(trim(coalesce(source_url, '')), '^https?://') THEN 'no_source' WHEN sha256(trim(source_url)) <> left(name, 64) THEN 'bad_hash' ELSE 'repairable' END AS status FROM (SELECT *, {_IMAGE_NAME} AS name FROM ({v('images')}))""",
    "media_names": r"""SELECT page_id, sha256(url || '.JPEG') || CASE WHEN regexp_matches(url, '[?#]') THEN '.bin' ELSE '.jpg' END AS by_path,
  sha256(url) || '.webp' AS by_type, regexp_matches(url, '^https?://') AS external FROM pages""",
}
