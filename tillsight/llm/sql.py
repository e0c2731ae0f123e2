"""The same results as DuckDB SQL, where SQL can express them."""

from __future__ import annotations

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP2 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex({LOWER.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s
  FROM w
), e AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS e FROM s
), links AS (
  SELECT a.doc_id AS u, b.doc_id AS v FROM e a JOIN e b ON a.e = b.e AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach(doc_id, other) AS (
  SELECT doc_id, doc_id FROM s UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON b.u = r.other
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.other) AS component_id
FROM s JOIN reach r USING (doc_id) GROUP BY s.doc_id, len(s.s)
"""

OP4 = f"""
WITH d AS (SELECT doc_id, sha256({LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""

OP7_ESCAPED = r"""
replace(replace(replace(replace(replace(replace(replace({0}, '\', '\\'), '<|', '<\|'), '</s>', '<\/s>'), '<s>', '<\s>'),
        '[INST]', '[\INST]'), '[/INST]', '[\/INST]'), '|>', '|\>')
"""
OP7 = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), p AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       CAST(sum(length({OP7_ESCAPED.format("text")}) +
                CASE WHEN before = role THEN 8 ELSE 17 + length({OP7_ESCAPED.format("role")}) END) AS BIGINT) AS formatted_chars
FROM p GROUP BY conv_id
"""

OP9 = f"""
WITH u AS (
  SELECT row_number() OVER () AS n, page_id,
         CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT n, page_id, {LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(level, host, path, verdict) AS (
  VALUES (0, 'com', '/', 'allow'), (0, 'example.com', '/en/', 'block'), (0, 'www.example.com', '/en/', 'allow'),
         (0, 'net', '/es/', 'block'), (0, 'net', '/fr/', 'block'),
         (1, 'ads-track.example.net', '/', 'block'), (1, 'ads-track.example.org', '/', 'block')
), m AS (
  SELECT p.n, p.page_id, p.host, p.path, r.level, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY r.level, length(r.host || r.path) DESC, length(r.host) DESC) AS place
  FROM p LEFT JOIN r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
)
SELECT page_id, host, path, CASE WHEN level = 0 THEN rule END AS rule, coalesce(verdict, 'allow') AS verdict
FROM m WHERE place = 1
"""

CRC = """
crc_steps(n, c, k) AS (
  SELECT range, range, 0 FROM range(256)
  UNION ALL SELECT n, CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc_steps WHERE k < 8
), crc_table AS (SELECT list(c ORDER BY n) AS t FROM crc_steps WHERE k = 8)"""

GRAM = " || ' ' || ".join(["word", *(f"lead(word, {k}) OVER o" for k in range(1, 16))])

OP11 = rf"""
WITH RECURSIVE {CRC}, d AS (
  SELECT row_number() OVER () AS r, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         xor(list_reduce([4294967295] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)),
             lambda a, x: xor(a >> 8, t[1 + xor(a, x) % 256])), 4294967295) AS h
  FROM documents, crc_table
), s AS (
  SELECT r, doc_id, w, len(w) AS n, coalesce(h % 10 = 0, false) AND len(w) > 0 AS planted, h // 10 AS g FROM d
), p AS (
  SELECT r, doc_id, n, w, CASE WHEN planted THEN g % n END AS a, CASE WHEN planted THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM s
), v AS MATERIALIZED (
  SELECT r, doc_id, n, CASE WHEN a IS NULL THEN w
    ELSE list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS w FROM p
), x AS MATERIALIZED (
  SELECT r, unnest(range(n)) AS i, unnest(w) AS word FROM v
), grams AS (
  SELECT r, n, i, {GRAM} AS gram FROM x JOIN (SELECT r, n FROM v WHERE n >= 24) USING (r)
  WINDOW o AS (PARTITION BY r ORDER BY i) QUALIFY lead(word, 15) OVER o IS NOT NULL
), periods AS (
  SELECT DISTINCT a.r, b.i - a.i AS q FROM grams a JOIN grams b ON a.r = b.r AND a.gram = b.gram AND a.i < b.i WHERE 3 * (b.i - a.i) <= a.n
), same AS (
  SELECT c.r, c.q, a.i FROM periods c JOIN x a ON a.r = c.r JOIN x b ON b.r = c.r AND b.i = a.i + c.q AND b.word = a.word
), stretches AS (
  SELECT r, q, min(i) AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM same) GROUP BY r, q, island
), runs AS MATERIALIZED (
  SELECT r, start, length, min(q) AS period FROM stretches GROUP BY r, start, length HAVING length >= 24 AND length >= 3 * min(q)
), told AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS runs,
         first({{'s': start, 'l': length, 'q': period}} ORDER BY length / period DESC, start, period) AS best
  FROM runs GROUP BY r
), gone AS (
  SELECT DISTINCT r, unnest(range(start + period, start + length)) AS i FROM runs
), kept AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS text FROM x ANTI JOIN gone USING (r, i) GROUP BY r
)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.s AS BIGINT) AS start, CAST(best.l AS BIGINT) AS length,
       CAST(best.q AS BIGINT) AS period, CAST(1000 * best.l // best.q AS BIGINT) AS exponent_milli,
       sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM v LEFT JOIN told USING (r) LEFT JOIN kept USING (r)
"""

ORACLES = {"op11_periodic_runs": OP11, "op2_ngram_jaccard": OP2, "op4_exact_dedup": OP4, "op7_chat_format": OP7, "op9_url_filter": OP9}
