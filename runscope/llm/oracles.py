"""DuckDB counterparts of the queries that SQL can express."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
LOWER_WORDS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x20\x09-\x0D]+')"
)

OP1 = f"""
WITH w AS (SELECT doc_id, {WORDS} AS ws FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(1, greatest(1, len(ws) - 18)), lambda p: md5(array_to_string(ws[p:p + 19], ' ')))) AS k,
             unnest(range(1, greatest(1, len(ws) - 18))) AS p FROM w),
later AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY k ORDER BY doc_id, p) AS r FROM k) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS q FROM later),
each AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS q FROM w),
kept AS (SELECT e.doc_id, string_agg(e.word, ' ' ORDER BY e.q) AS kept FROM each e ANTI JOIN gone g ON g.doc_id = e.doc_id AND g.q = e.q
         GROUP BY e.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id"""

OP2 = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
k AS (SELECT doc_id, unnest(list_transform(range(0, greatest(0, n - 199)), lambda p: md5(substr(h, 2 * p + 1, 400)))) AS k,
             unnest(range(0, greatest(0, n - 199))) AS p FROM b),
hit AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY k) AS c FROM k) WHERE c > 1),
run AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 200 THEN 0 ELSE 1 END AS starts FROM hit),
span AS (SELECT doc_id, min(p) AS a, max(p) + 200 AS z
         FROM (SELECT doc_id, p, sum(starts) OVER (PARTITION BY doc_id ORDER BY p) AS s FROM run) GROUP BY doc_id, s),
edge AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high FROM span
         UNION ALL SELECT b.doc_id, coalesce(max(z), 0), any_value(n) FROM b LEFT JOIN span s ON s.doc_id = b.doc_id GROUP BY b.doc_id),
kept AS (SELECT e.doc_id, string_agg(substr(h, 2 * low + 1, 2 * (high - low)), '' ORDER BY low) AS h
         FROM edge e JOIN b ON b.doc_id = e.doc_id GROUP BY e.doc_id),
total AS (SELECT doc_id, count(*) AS spans, sum(z - a) AS gone FROM span GROUP BY doc_id)
SELECT b.doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM b JOIN kept ON kept.doc_id = b.doc_id LEFT JOIN total t ON t.doc_id = b.doc_id"""

OP6 = f"""
WITH RECURSIVE w AS (SELECT doc_id, {LOWER_WORDS} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 4 THEN list_transform(range(1, len(ws) - 2), lambda p: md5(array_to_string(ws[p:p + 3], ' ')))
      WHEN len(ws) > 0 THEN [md5(len(ws) || array_to_string(ws, ' '))] ELSE [] END) AS k FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.k = y.k AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON e.a = r.b),
comp AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT comp.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, component_id, comp.doc_id = component_id AS kept
FROM comp LEFT JOIN n ON n.doc_id = comp.doc_id"""

#: Text of the article element, for pages whose references are those decoded here.
OP11 = r"""
WITH a AS (SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '<[^>]*>', ' ', 'g') AS t FROM pages),
d AS (SELECT page_id, url, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', '&', 'g') AS t FROM a),
b AS (SELECT page_id, url, trim(regexp_replace(t, '[\s\xa0]+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM b"""

OP12 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS u,
                  sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
e AS (SELECT doc_id, t, u, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT % (len(u) + 1) AS one, ('0x' || substr(h, 9, 8))::BIGINT % (len(u) + 1) AS two,
             ('0x' || substr(h, 25, 8))::BIGINT % 100 AS draw FROM d),
c AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain'
                             WHEN draw < 50 THEN 'spm' ELSE 'psm' END AS form,
             array_to_string(u[1:least(one, two)], '') AS a, array_to_string(u[least(one, two) + 1:greatest(one, two)], '') AS b,
             array_to_string(u[greatest(one, two) + 1:n], '') AS c FROM e)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || c || '<M>' || b
                        ELSE '<S>' || c || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256
FROM c"""

LOWER_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP13 = f"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source, {LOWER_TERMS} AS ws FROM documents),
w AS (SELECT i, lang, source, unnest(ws) AS term FROM d),
kept AS (SELECT lang, term FROM w GROUP BY 1, 2 HAVING count(DISTINCT i) >= 3),
c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
n AS (SELECT lang, source, sum(c) AS n FROM c GROUP BY 1, 2),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c,
             1 + (1000000000::HUGEINT * (coalesce(c.c, 0) + 1)) // (coalesce(n.n, 0) + v.v)::HUGEINT AS p
      FROM g JOIN kept k ON k.lang = g.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source
      LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
l AS (SELECT c.lang, c.term, 1 + (1000000000::HUGEINT * (sum(c.c) + 1)) // (any_value(m.n) + any_value(v.v))::HUGEINT AS q
      FROM c JOIN v ON v.lang = c.lang JOIN (SELECT lang, sum(n) AS n FROM n GROUP BY 1) m ON m.lang = c.lang GROUP BY 1, 2),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
         FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source
          LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, p.term AS item, (p.p - l.q) * (p.p - l.q) // l.q AS value
          FROM p JOIN l ON l.lang = p.lang AND l.term = p.term WHERE p.c > 0 AND p.p > l.q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM pairs
           UNION ALL
           SELECT * FROM (SELECT lang, source, 'term' AS part, item, value,
                                 row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, encode(item)) AS rank FROM terms) WHERE rank <= 200)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked"""

ORACLES = {"op1_substring_dedup": OP1, "op2_suffix_dedup": OP2, "op6_near_duplicates": OP6, "op11_html_extraction": OP11, "op12_fill_in_middle": OP12, "op13_source_audit": OP13}
