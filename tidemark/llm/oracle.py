"""SQL for DuckDB that gives the rows of the queries that SQL can express."""

from __future__ import annotations

from tidemark.llm.quality_rules import METRICS, MIN_GROUP

WORD = "[^\\x20\\x09-\\x0D]+"

#: Shingles of distinct texts, all pairs that share one, exact similarities, and the closure of links.
NEAR_DUPLICATES = f"""
WITH RECURSIVE t AS (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
 w AS (SELECT id, regexp_extract_all(text, '{WORD}') AS w FROM t),
 s AS (SELECT id, CASE WHEN len(w) >= 5 THEN list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i : i + 4], ' ')) ELSE [array_to_string(w, ' ')] END AS s FROM w WHERE len(w) > 0),
 bag AS (SELECT id, shingle, count(*) AS n FROM (SELECT id, unnest(s) AS shingle FROM s) GROUP BY ALL),
 total AS (SELECT id, sum(n) AS n FROM bag GROUP BY id),
 common AS (SELECT a.id AS u, b.id AS v, sum(least(a.n, b.n)) AS n FROM bag a JOIN bag b ON a.shingle = b.shingle AND a.id < b.id GROUP BY ALL),
 link AS (SELECT u, v FROM common c JOIN total a ON a.id = u JOIN total b ON b.id = v WHERE CAST(c.n AS DOUBLE) / (a.n + b.n - c.n) >= 0.8),
 edge AS (SELECT u, v FROM link UNION ALL SELECT v, u FROM link),
 reach(id, other) AS (SELECT id, id FROM t UNION SELECT r.id, e.v FROM reach r JOIN edge e ON e.u = r.other),
 class AS (SELECT id, min(other) AS class_id FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(c.class_id, d.doc_id) AS class_id, coalesce(t.id, d.doc_id) AS copy_id FROM documents d LEFT JOIN t ON t.text = d.text LEFT JOIN class c ON c.id = t.id
"""


def quality_rules() -> str:
    """Counts from words, windows and lines as rows; quartiles from running sums over the sketches' buckets."""
    ratios = {"sym": "1000 * n_symbols // greatest(n_words, 1)", "mwl": "100 * word_chars // greatest(n_words, 1)", "dup": "1000 * n_dup_lines // greatest(n_lines, 1)", "upper": "1000 * n_upper // greatest(word_chars, 1)", "bang": "1000 * n_bang // greatest(n_words, 1)"}
    entries = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {m} AS v FROM r WHERE n_words > 0" for m in METRICS)
    slack = " ".join(f"WHEN '{m}' THEN {x}" for m, x in METRICS.items())
    levels = {0: ("lang", "source"), 1: ("lang", "'' AS source"), 2: ("'' AS lang", "'' AS source")}
    quartiles = " UNION ALL ".join(f"SELECT {i} AS level, {a}, {b}, metric, bucket, sum(n) AS n FROM sketch GROUP BY ALL" for i, (a, b) in levels.items())
    within = " AND ".join([f"r.{m} <= l.most_{m}" for m in METRICS] + ["r.mwl >= l.least_mwl"])
    most = ", ".join(f"max(CASE WHEN metric = '{m}' THEN q3 + 3 * (q3 - q1) + slack END) AS most_{m}" for m in METRICS)
    return f"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
 l AS (SELECT *, array_to_string(w, '') AS j, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
 words AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i FROM d),
 grams AS (SELECT doc_id, i, w, lead(w) OVER o AS w2, lead(w, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
 found AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w, w2, w3) AS n FROM grams WHERE w3 IS NOT NULL),
 repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM found, range(3) AS x(k) WHERE n > 1 GROUP BY doc_id),
 c AS (SELECT l.doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(j) AS BIGINT) AS word_chars, CAST(length(j) - length(regexp_replace(j, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
  length(j) - length(regexp_replace(j, '\\p{{Lu}}', '', 'g')) AS n_upper, length(j) - length(regexp_replace(j, '[!?]', '', 'g')) AS n_bang FROM l LEFT JOIN repeated r USING (doc_id)),
 r AS (SELECT *, {", ".join(f"{x} AS {m}" for m, x in ratios.items())} FROM c),
 sketch AS (SELECT lang, source, metric, (s << 8) + (v >> s) AS bucket, count(*) AS n FROM (SELECT *, CAST(greatest(length(bin(v)) - 8, 0) AS BIGINT) AS s FROM ({entries})) GROUP BY ALL),
 upto AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM ({quartiles})),
 q AS (SELECT level, lang, source, metric, max(total) AS docs, min(CASE WHEN upto * 4 >= total THEN bucket END) AS b1, min(CASE WHEN upto * 4 >= total * 3 THEN bucket END) AS b3 FROM upto GROUP BY ALL),
 v AS (SELECT *, (b1 & 255) << (b1 >> 8) AS q1, (b3 & 255) << (b3 >> 8) AS q3 FROM q),
 k AS (SELECT DISTINCT lang, source FROM sketch),
 usable AS (SELECT k.lang, k.source, v.level, v.metric, v.q1, v.q3 FROM k JOIN v ON v.level = 2 OR v.docs >= {MIN_GROUP} AND v.lang IS NOT DISTINCT FROM k.lang AND (v.level = 1 OR v.source IS NOT DISTINCT FROM k.source)),
 chosen AS (SELECT lang, source, metric, arg_min(q1, level) AS q1, arg_min(q3, level) AS q3, CASE metric {slack} END AS slack FROM usable GROUP BY lang, source, metric),
 limits AS (SELECT lang, source, {most}, max(CASE WHEN metric = 'mwl' THEN q1 - 3 * (q3 - q1) - slack END) AS least_mwl FROM chosen GROUP BY lang, source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND coalesce({within}, false) AS kept
FROM r LEFT JOIN limits l ON l.lang IS NOT DISTINCT FROM r.lang AND l.source IS NOT DISTINCT FROM r.source
"""


def repeated_strings(length: int) -> str:
    """Every string of ``length`` bytes by its digest; those found twice, joined into spans."""
    return f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b, hex(encode(coalesce(text, ''))) AS h FROM documents),
 s AS (SELECT doc_id, i, md5(array_slice(b, i + 1, i + {length})) AS m FROM (SELECT doc_id, b, unnest(range(octet_length(b) - {length - 1})) AS i FROM d WHERE octet_length(b) >= {length})),
 twice AS (SELECT m FROM s GROUP BY m HAVING count(*) > 1),
 hit AS (SELECT doc_id, i, i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {length} AS new FROM s WHERE m IN (SELECT m FROM twice)),
 run AS (SELECT doc_id, i, sum(CAST(coalesce(new, true) AS INT)) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM hit),
 span AS (SELECT doc_id, min(i) AS a, max(i) + {length} AS z FROM run GROUP BY doc_id, run),
 kept AS (SELECT doc_id, z AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS z FROM (SELECT doc_id, a, z FROM span UNION ALL SELECT doc_id, -1, 0 FROM span GROUP BY doc_id)),
 rest AS (SELECT k.doc_id, string_agg(CASE WHEN k.z IS NULL THEN substring(h, 2 * k.a + 1) ELSE substring(h, 2 * k.a + 1, 2 * (k.z - k.a)) END, '' ORDER BY k.a) AS h FROM kept k JOIN d USING (doc_id) GROUP BY k.doc_id),
 n AS (SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM span GROUP BY doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest.h, d.h))) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN rest USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_near_dedup": NEAR_DUPLICATES, "op9_quality_rules": quality_rules(), "op10_repeated_strings": repeated_strings(400)}
