"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORD = r"'[^\x20\x09-\x0D]+'"

#: Words and 3-word windows by position; host rates with the moment-fitted beta prior.
_RULES = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), {_WORD}) AS w FROM documents
), win AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, a, b, c) AS n
  FROM (SELECT r, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d))
), rep AS (
  SELECT r, count(DISTINCT i + k) AS n FROM win, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), lines AS (
  SELECT r, count(*) AS n, count(*) - count(DISTINCT line) AS dup
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, {_WORD}) GROUP BY r
), m AS (
  SELECT r, doc_id, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0) AS n_lines,
    coalesce(lines.dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (r) LEFT JOIN lines USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*)::DOUBLE AS n, sum((base_failed OR n_symbols > 0.1::DOUBLE * n_words OR n_dup_lines > 0.3::DOUBLE * n_lines
    OR NOT (word_chars / greatest(n_words, 1) BETWEEN 2.0 AND 15.0))::INT)::DOUBLE AS f
  FROM b GROUP BY source
), p AS (
  SELECT sum(f) / sum(n) AS m, greatest(sum(n * (f / n) * (f / n)) / sum(n) - (sum(f) / sum(n)) * (sum(f) / sum(n)), 1e-12) AS v FROM h
), v AS (
  SELECT source, (f + k * m) / (n + k) AS rate FROM h, (SELECT m, least(greatest(m * (1 - m) / v - 1, 1.0), 1e6) AS k FROM p)
)
"""

SQL: dict[str, str] = {
    "op2_quality_rules": _RULES
    + """SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND rate <= 0.7 AND n_symbols <= (CASE WHEN rate <= 0.4 THEN 0.5 ELSE 0.1 END)::DOUBLE * n_words AS kept
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source""",
    # Windows as hexadecimal text, so that bytes can be cut anywhere.
    "op4_run_index": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), win AS (
  SELECT r, doc_id, i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT r, doc_id, h, unnest(range(0, n - 49)) AS i FROM d)
), first AS (SELECT w, min(doc_id) AS m FROM win GROUP BY w HAVING count(*) > 1
), hit AS (SELECT r, i FROM win JOIN first USING (w) WHERE m < doc_id
), runs AS (
  SELECT r, min(i) AS a, max(i) + 50 AS b FROM (
    SELECT r, i, sum(new) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit))
  GROUP BY r, k
), pieces AS (
  SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs
), kept AS (
  SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM pieces JOIN d USING (r) GROUP BY r
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)""",
    "op6_systematic_mix": rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, {_WORD})), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS w FROM d GROUP BY source
), rounds AS (
  SELECT -1.0::DOUBLE AS rate, 0 AS i
  UNION ALL
  SELECT new, i + 1 FROM (
    SELECT rate, i, ((SELECT sum(source_size) FROM s) * 150 / 100::DOUBLE - coalesce((SELECT sum(2 * source_size) FROM s WHERE 2 * source_size <= rate * w), 0))
      / (SELECT sum(w) FROM s WHERE 2 * source_size > rate * w) AS new FROM rounds
  ) WHERE new > rate
), t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT max(rate) FROM rounds)) AS target,
    ('0x' || substr(md5('7:' || coalesce('s' || source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
  FROM s
), k AS (
  SELECT d.doc_id, size, source_size, target, u, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
    row_number() OVER (PARTITION BY d.source ORDER BY size, md5(coalesce(d.doc_id::VARCHAR, '')), d.doc_id) AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, ((floor(u + i * e) - floor(u + (i - 1) * e)) * size)::BIGINT AS taken FROM k""",
    "op8_decontamination": r"""
WITH abc AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents, abc
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, abc
), g AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i+n-1], ' ') AS gram
  FROM (SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM b) WHERE n > 0)
), o AS (
  SELECT r, i, n, item_id
  FROM (SELECT r, n, i, array_to_string(w[i:i+n-1], ' ') AS gram
        FROM (SELECT r, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, (SELECT DISTINCT n FROM g) WHERE len(w) >= n)) x
  JOIN g USING (n, gram)
), hit AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM o)) GROUP BY r
), it AS (
  SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS id FROM o) GROUP BY r
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(it.n, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r)""",
    "op12_lattice_hashing": r"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS x, label IS NOT NULL AND embedding IS NOT NULL
    AND list_bool_and(list_transform(embedding, lambda c: c IS NOT NULL AND isfinite(c))) AND list_bool_or(list_transform(embedding, lambda c: c <> 0)) AS sound
  FROM embeddings
), u AS (
  SELECT r, vec_id, label, x, sqrt(list_dot_product(x, x)) AS norm FROM v WHERE sound
), links AS (
  SELECT a.r AS r, b.r AS other, b.vec_id AS id FROM u a JOIN u b ON a.label = b.label AND len(a.x) = len(b.x) AND a.r <> b.r
  WHERE list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98::DOUBLE
), reached AS (
  SELECT r, r AS other, vec_id AS id FROM v
  UNION
  SELECT reached.r, links.other, links.id FROM reached JOIN links ON reached.other = links.r
), c AS (SELECT r, min(id) AS component_id FROM reached GROUP BY r
), n AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN c USING (r) LEFT JOIN n USING (r)""",
    # A run has the same 6 words one period apart, so runs are islands of equal 6-word windows at one distance.
    "op13_periodic_runs": r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w,
    list_transform(string_split(doc_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT) AS digits
  FROM documents
), hashed AS (
  SELECT r, doc_id, w, len(w)::BIGINT AS n, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(digits, lambda c: [c, -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, b: CASE WHEN b >= 0 THEN xor(c, b) WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END)) AS h
  FROM d
), params AS (
  SELECT *, (h // 10) % greatest(n, 1) AS a, 3 + (h // 10) % 8 AS k FROM hashed
), texts AS (
  SELECT r, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(0, n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END + 1]) ELSE w END AS w FROM params
), six AS (
  SELECT r, i, array_to_string(w[i + 1 : i + 6], ' ') AS gram FROM (SELECT r, w, unnest(range(0, n - 5)) AS i FROM texts WHERE n >= 12)
), pairs AS (
  SELECT x.r, x.i, y.i - x.i AS q FROM six x JOIN six y ON x.r = y.r AND x.gram = y.gram AND x.i < y.i
), islands AS (
  SELECT r, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pairs) GROUP BY r, q, part
), runs AS (
  SELECT r, s, e - s AS n, min(q) AS q FROM islands WHERE e - s >= greatest(12, 2 * q) GROUP BY r, s, e
), found AS (
  SELECT r, count(*) AS n_runs, arg_min({'s': s, 'n': n, 'q': q}, {'n': -n, 's': s, 'q': q}) AS best, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS listed FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(s + q, s + n)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS rest
  FROM (SELECT r, unnest(w) AS word, unnest(range(0, n)) AS i FROM texts) ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, best.s::BIGINT AS start, best.n::BIGINT AS length, best.q::BIGINT AS period,
  (1000 * best.n // best.q)::BIGINT AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(rest, '')) AS collapsed_sha256
FROM texts LEFT JOIN found USING (r) LEFT JOIN kept USING (r)""",
}
