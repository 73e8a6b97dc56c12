"""SQL twins of the queries that SQL can express."""

from __future__ import annotations

WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

SUFFIX_DEDUP = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, substr(h, CAST(2 * p + 1 AS BIGINT), 100) AS s
      FROM (SELECT doc_id, h, unnest(range(greatest(0, len(h) // 2 - 49))) AS p FROM d)),
m AS (SELECT s, min(doc_id) AS lo FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT w.doc_id, w.p FROM w JOIN m USING (s) WHERE w.doc_id > m.lo),
i AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 THEN 0 ELSE 1 END AS fresh FROM g),
r AS (SELECT doc_id, p, sum(fresh) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM i),
sp AS (SELECT doc_id, run, min(p) AS b, max(p) + 50 AS e FROM r GROUP BY 1, 2),
gaps AS (SELECT doc_id, e AS b, coalesce(lead(b) OVER (PARTITION BY doc_id ORDER BY b), 1000000000) AS e FROM (
           SELECT doc_id, b, e FROM sp UNION ALL SELECT doc_id, -1, 0 FROM d)),
kept AS (SELECT doc_id, string_agg(substr(h, CAST(2 * gaps.b + 1 AS BIGINT), CAST(2 * (gaps.e - gaps.b) AS BIGINT)), '' ORDER BY gaps.b) AS k
         FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(e - b) AS n_removed, count(*) AS n_spans FROM sp GROUP BY 1) USING (doc_id)"""

_SHINGLES = """CASE WHEN len(ws) < 5 THEN [array_to_string(ws, chr(1))]
  ELSE list_transform(range(len(ws) - 4), lambda i: array_to_string(ws[i + 1:i + 5], chr(1))) END"""

NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest({_SHINGLES}) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""

LINE_DEDUP = f"""
WITH p AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS p FROM documents),
l AS (SELECT doc_id, unnest(range(len(p)))::INT AS pos, unnest(p) AS line FROM p),
w AS (SELECT doc_id, pos, {WORDS.format("lower(line)")} AS ws FROM l),
s AS (SELECT DISTINCT doc_id, pos, unnest({_SHINGLES}) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, pos, count(*) AS n FROM s GROUP BY 1, 2),
c AS (SELECT b.doc_id, b.pos, a.doc_id AS d, a.pos AS t, count(*) AS c FROM s b JOIN s a USING (s)
      WHERE a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.pos < b.pos) GROUP BY 1, 2, 3, 4),
g AS (SELECT DISTINCT c.doc_id, c.pos FROM c JOIN n x ON x.doc_id = c.doc_id AND x.pos = c.pos JOIN n y ON y.doc_id = d AND y.pos = t
      WHERE 100 * c >= 75 * (x.n + y.n - c)),
gone AS (SELECT doc_id, list_sort(list(pos)) AS gone FROM g GROUP BY 1),
o AS (SELECT doc_id, text, p, coalesce(gone, []::INT[]) AS gone FROM p LEFT JOIN gone USING (doc_id))
SELECT doc_id, len(p) AS n_lines, len(gone) AS n_removed, gone AS removed_lines,
       CASE WHEN text IS NOT NULL THEN sha256(array_to_string(list_filter(p, lambda x, i: NOT list_contains(gone, (i - 1)::INT)), chr(10))) END AS kept_sha256
FROM o"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({WORDS.format("coalesce(text, '')")}) AS size FROM documents),
q AS (SELECT doc_id, 0.5::DOUBLE + max(quality) AS quality FROM labels GROUP BY 1),
k AS (SELECT d.*, -ln((('0x' || substr(md5('17:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)
        / greatest(coalesce(quality, 1::DOUBLE), 1e-6::DOUBLE) AS key FROM d LEFT JOIN q USING (doc_id)),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
n AS (SELECT *, 1::DOUBLE + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 AS w FROM s),
o AS (SELECT *, 3::DOUBLE * source_size AS cap,
        greatest(0::DOUBLE, sum(source_size) OVER () - coalesce(sum(3::DOUBLE * source_size) OVER (ORDER BY source_size / w, source IS NULL, source
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY source_size / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM n),
f AS (SELECT arg_min(rate, (source_size / w, source IS NULL, source)) AS rate FROM o WHERE rate * w <= cap),
t AS (SELECT source, source_size, least(cap, coalesce(f.rate * w, cap)) AS target FROM o LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
r AS (SELECT k.doc_id, k.source, size, source_size, target, whole, target - whole * source_size AS budget,
        sum(size) OVER (PARTITION BY k.source ORDER BY key, k.doc_id) AS upto FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, source,
       (whole + CASE WHEN source_size > 0 AND upto - size / 2 <= budget THEN 1 ELSE 0 END)::BIGINT AS epochs,
       (size * (whole + CASE WHEN source_size > 0 AND upto - size / 2 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r"""

NGRAM_JOIN = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) < 3 THEN [array_to_string(ws, chr(1))]
  ELSE list_transform(range(len(ws) - 2), lambda i: array_to_string(ws[i + 1:i + 3], chr(1))) END) AS s FROM w WHERE len(ws) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b USING (s) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id
FROM (SELECT a AS doc_id, min(b) AS component_id FROM r GROUP BY 1) LEFT JOIN n USING (doc_id)"""

RESAMPLING = """
WITH steps AS (SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) AS c
               FROM (SELECT unnest(range(256)) AS n)),
tab AS (SELECT list(c ORDER BY n) AS t FROM steps),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
u AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
l AS (SELECT doc_id, unnest(ws) AS w FROM d),
c AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM (SELECT w FROM l UNION ALL SELECT w FROM u))),
b AS (SELECT w, xor(list_reduce(list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT),
        lambda s, x: xor(s >> 8, t[(xor(s, x) & 255) + 1]), 4294967295), 4294967295) % 10000 AS b FROM c, tab),
s AS (SELECT b, count(*) AS s FROM l JOIN b USING (w) GROUP BY 1),
t AS (SELECT b, count(*) AS t FROM u JOIN b USING (w) GROUP BY 1),
g AS (SELECT b, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT count(*) FROM l) + 10000)::DOUBLE
        / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT count(*) FROM u) + 10000)::DOUBLE)))::BIGINT AS gain
      FROM (SELECT DISTINCT b FROM b) LEFT JOIN s USING (b) LEFT JOIN t USING (b)),
f AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM l JOIN b USING (w) JOIN g USING (b) GROUP BY 1),
o AS (SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
        coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
      FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM o WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * (SELECT count(*) FROM r) // 100 THEN rank END AS rank
FROM o LEFT JOIN r USING (doc_id)"""

DIVERGENCE = """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
               '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
l AS (SELECT r, lang, source, unnest(ws) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM l GROUP BY 1, 2 HAVING count(DISTINCT r) >= 3),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM l JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v, sum(lang_n) AS lang_total FROM k GROUP BY 1),
t AS (SELECT lang, source, sum(n) AS held FROM c GROUP BY 1, 2),
x AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 1)) // (coalesce(held, 0) + v) AS p,
        1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v) AS q
      FROM g JOIN k USING (lang) JOIN v USING (lang) LEFT JOIN t USING (lang, source) LEFT JOIN c USING (lang, source, term)),
terms AS (SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value FROM x WHERE n > 0 AND p > q),
priced AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
           FROM x a JOIN x b USING (lang, term) WHERE a.source <> b.source GROUP BY 1, 2, 3),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
          FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN priced ON priced.lang = a.lang AND priced.source = a.source AND priced.item = b.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank
           FROM (FROM terms UNION ALL FROM pairs))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
