"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from meshweave.llm import license_scan, quality

ORACLES: dict[str, str] = {}

#: The windows are found again by a walk over the turns, one turn of every conversation a step.
ORACLES["op2_chat"] = r"""
WITH RECURSIVE turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), numbered AS (
  SELECT *, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) + 4 AS tok,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         length(text) + 3 * (length(text) - length(replace(text, '<', ''))) + 4 * (length(text) - length(replace(text, '&', ''))) + length(role) + 15 AS chars
  FROM turns
), summed AS (
  SELECT *, sum(tok) OVER w - tok AS start, max(CASE WHEN pos = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
         max(CASE WHEN pos = 0 AND role = 'system' THEN chars ELSE 0 END) OVER (PARTITION BY conv_id) AS sys_chars, sum(chars) OVER w - chars AS chars_before
  FROM numbered WINDOW w AS (PARTITION BY conv_id ORDER BY pos)
), back AS (
  SELECT a.conv_id, a.pos, any_value(a.start) AS start, any_value(a.tok) AS tok, any_value(a.sys) AS sys, any_value(a.chars) AS chars,
         any_value(a.sys_chars) AS sys_chars, any_value(a.start) - min(b.start) AS hist, any_value(a.chars_before) - min(b.chars_before) AS hist_chars
  FROM summed a JOIN summed b ON a.conv_id IS NOT DISTINCT FROM b.conv_id AND b.pos <= a.pos AND b.start >= a.start - 128 AND (b.start >= b.sys OR a.pos = 0)
  GROUP BY 1, 2
), walk AS (
  SELECT conv_id, pos, CAST(CASE WHEN sys > 0 THEN -1 ELSE 0 END AS BIGINT) AS win, CAST(start AS BIGINT) AS base, CAST(0 AS BIGINT) AS hist, CAST(chars AS BIGINT) AS chars FROM back WHERE pos = 0
  UNION ALL
  SELECT b.conv_id, b.pos, CASE WHEN w.win < 0 THEN 0 WHEN fresh THEN w.win + 1 ELSE w.win END, CASE WHEN w.win < 0 OR fresh THEN b.start ELSE w.base END,
         CASE WHEN w.win < 0 THEN 0 WHEN fresh THEN b.hist ELSE w.hist END, b.chars + CASE WHEN w.win >= 0 AND fresh THEN b.sys_chars + b.hist_chars ELSE 0 END
  FROM walk w JOIN (SELECT * FROM back) b ON b.conv_id = w.conv_id AND b.pos = w.pos + 1, LATERAL (SELECT b.sys + w.hist + b.start + b.tok - w.base > 512 AS fresh)
), formatted AS (SELECT conv_id, CAST(sum(chars) AS BIGINT) AS formatted_chars FROM walk GROUP BY 1)
SELECT s.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
       length(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY pos) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars
FROM summed s JOIN formatted f USING (conv_id) GROUP BY s.conv_id
"""

ORACLES["op1_mix"] = r"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS key, greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+'))) AS tokens FROM documents
), totals AS (SELECT key, CAST(sum(tokens) AS BIGINT) AS total FROM sized GROUP BY key),
shares AS (SELECT key, total, total / CAST(sum(total) OVER () AS DOUBLE) AS p, sum(total) OVER () AS everything FROM totals),
held AS (SELECT list(p ORDER BY p) AS ps, CAST(any_value(everything) AS DOUBLE) AS everything, count(*) AS n FROM shares),
e AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps, n FROM held
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END, ps, n
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2))) AS z, list_sum(list_transform(ps, lambda p: pow(p, (lo + hi) / 2) * ln(p))) AS s FROM e WHERE i < 60),
       LATERAL (SELECT ln(z) - mid * s / z >= 0.95 * ln(n) AS ok)
), r AS (
  SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, ps FROM held
  UNION ALL
  SELECT i + 1, CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, ps
  FROM (SELECT *, (lo + hi) / 2 AS mid, list_transform(ps, lambda p: pow(p, (lo + hi) / 2 - 1)) AS q FROM r WHERE i < 60), LATERAL (SELECT list_max(q) / list_min(q) <= 4 AS ok)
), ends AS (
  SELECT CASE WHEN -list_sum(list_transform(ps, lambda p: p * ln(p))) >= 0.95 * ln(n) THEN 1.0 ELSE (SELECT lo FROM e WHERE i = 60) END AS by_entropy,
         CASE WHEN list_max(ps) / list_min(ps) <= 4 THEN 0.0 ELSE (SELECT hi FROM r WHERE i = 60) END AS by_repeats, ps, everything FROM held
), exponent AS (SELECT greatest(by_entropy, by_repeats) AS a, ps, everything FROM ends),
given AS (SELECT a, list_sum(list_transform(ps, lambda p: pow(p, a))) AS z, everything * list_sum(list_transform(ps, lambda p: pow(p, a))) / list_min(list_transform(ps, lambda p: pow(p, a - 1))) AS g FROM exponent),
budgets AS (SELECT key, total, greatest(total, CAST(floor(pow(p, a) / z * g) AS BIGINT)) AS budget, greatest(1, CAST(ceil(floor(g) / 131072) AS BIGINT)) AS blocks FROM shares, given),
copies AS (
  SELECT *, CAST('0x' || substr(md5('17|' || epoch || '|' || doc_id), 1, 15) AS BIGINT) AS h, CAST('0x' || substr(md5('17|' || epoch || '|' || doc_id || '|block'), 1, 15) AS BIGINT) AS hb
  FROM (SELECT *, unnest(range(0, CAST(floor((budget - 1) / total) AS BIGINT) + 1)) AS epoch FROM sized JOIN budgets USING (key))
), placed AS (SELECT *, epoch * total + sum(tokens) OVER (PARTITION BY key, epoch ORDER BY h, doc_id ROWS UNBOUNDED PRECEDING) - tokens AS start FROM copies),
taken AS (SELECT *, CAST(floor(CAST(start AS DOUBLE) / budget * blocks) AS BIGINT) AS block FROM placed WHERE start < budget)
SELECT doc_id, source, tokens, epoch, block, row_number() OVER (PARTITION BY block ORDER BY hb, key, epoch, start) AS position FROM taken
"""

#: Lines of ten characters or more can be near: an edit leaves their first or last four as they are, of nineteen or more eight.
ORACLES["op6_line_dedup"] = r"""
WITH split AS (SELECT doc_id, text, string_split(text, chr(10)) AS parts FROM documents),
lines AS (SELECT doc_id, unnest(parts) AS line, unnest(range(len(parts))) AS pos FROM split),
firsts AS (SELECT line, min((doc_id, pos)) AS f1 FROM lines WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY line),
able AS (SELECT firsts.*, k FROM firsts, (VALUES (4), (8)) v(k) WHERE CASE WHEN k = 8 THEN length(line) >= 19 ELSE length(line) BETWEEN 10 AND 20 END),
ends AS (SELECT *, k || 'l' || left(line, k) AS e FROM able UNION ALL SELECT *, k || 'r' || right(line, k) AS e FROM able),
near AS (SELECT DISTINCT a.line FROM ends a JOIN ends b USING (e) WHERE b.f1 < a.f1 AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 1),
judged AS (
  SELECT l.doc_id, l.pos, l.line, f.line IS NOT NULL AND n.line IS NULL AND (l.doc_id, l.pos) > f.f1 AS exact, n.line IS NOT NULL AS near
  FROM lines l LEFT JOIN firsts f ON f.line = l.line LEFT JOIN near n ON n.line = l.line
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (exact) AS n_exact, count(*) FILTER (near) AS n_near,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT exact AND NOT near), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

ORACLES["op10_jaccard_join"] = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ \t\n\v\f\r]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) END) AS g FROM words)),
sizes AS (SELECT doc_id, count(g) AS n FROM words LEFT JOIN grams USING (doc_id) GROUP BY doc_id),
met AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b)
SELECT doc_id, n AS n_shingles, component_id FROM sizes JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a) USING (doc_id)
"""

_TEMPLATES = ", ".join(f"('{name}', {i}, {license_scan._class(len(license_scan.words_of(t)))}, '{' '.join(license_scan.words_of(t))}')" for name, ts in license_scan.TEMPLATES.items() for i, t in enumerate(ts))

ORACLES["op8_license_scan"] = rf"""
WITH known(license_id, template, class, words) AS (VALUES {_TEMPLATES}),
want AS (SELECT DISTINCT license_id, template, class, g FROM (SELECT license_id, template, class, string_split(words, ' ') AS w, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM known)),
sizes AS (SELECT license_id, template, count(*) AS n FROM want GROUP BY 1, 2),
words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
grams AS (SELECT doc_id, unnest(range(0, len(w) - 4)) AS pos, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) AS g FROM words WHERE len(w) >= 5),
hits AS (SELECT doc_id, license_id, template, class, g, pos, unnest([pos // class, pos // class - 1]) AS k FROM grams JOIN want USING (g)),
inside AS (SELECT doc_id, license_id, template, k, count(DISTINCT g) AS c, min(pos) AS first_word FROM hits WHERE k >= 0 AND pos - k * class <= 2 * class - 5 GROUP BY ALL)
SELECT doc_id, license_id, round(max(c / n), 6) AS containment, min(first_word) AS first_word FROM inside JOIN sizes USING (license_id, template) WHERE 100 * c >= 80 * n GROUP BY 1, 2
"""

_RATIOS = ", ".join(f"('{f}', {a}::DOUBLE, {b}::DOUBLE, {counted})" for f, (a, b, counted) in quality.FEATURES.items())
_LENT = f"CAST(round(p.n / CAST(p.total AS DOUBLE) * {quality.PRIOR}, 6) AS DECIMAL(24, 6))"
_QUANTILES = ", ".join(f"min(middle) FILTER (100 * upto >= {p} * total) AS q{p}" for p in (5, 10, 50, 90, 95))

ORACLES["op7_quality_rules"] = rf"""
WITH words AS (SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t\n\v\f\r]+') AS w FROM documents),
grams AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM words WHERE len(w) >= 3),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM grams) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) r(k) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, count(*) AS n_lines FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^ \t\n\v\f\r]') GROUP BY doc_id),
feats AS (
  SELECT doc_id, lang, source, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(n_repeat_words, 0) AS n_repeat_words
  FROM words LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)
), judged AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM feats),
ratios AS (SELECT j.doc_id, j.lang, j.source, r.*, a / b AS v FROM judged j, LATERAL (VALUES {_RATIOS}) r(feature, a, b, counted) WHERE NOT base_failed),
fine AS (SELECT lang, source, feature, CASE WHEN v > 0 THEN ceil(round(ln(v) / ln({quality.GAMMA}), 9))::INTEGER ELSE -100000 END AS bucket, CAST(count(*) AS DECIMAL(24, 6)) AS n FROM ratios GROUP BY ALL),
by_lang AS (SELECT lang, feature, bucket, sum(n) AS n FROM fine GROUP BY ALL),
overall AS (SELECT *, sum(n) OVER (PARTITION BY feature) AS total FROM (SELECT feature, bucket, sum(n) AS n FROM by_lang GROUP BY ALL)),
lang_blend AS (
  SELECT lang, feature, bucket, CAST(sum(n) AS DECIMAL(24, 6)) AS n
  FROM (SELECT * FROM by_lang UNION ALL SELECT g.lang, g.feature, p.bucket, {_LENT} FROM (SELECT DISTINCT lang, feature FROM by_lang) g JOIN overall p USING (feature)) GROUP BY ALL
), lang_total AS (SELECT *, sum(n) OVER (PARTITION BY lang, feature) AS total FROM lang_blend),
blend AS (
  SELECT lang, source, feature, bucket, CAST(sum(n) AS DECIMAL(24, 6)) AS n
  FROM (SELECT * FROM fine UNION ALL SELECT g.lang, g.source, g.feature, p.bucket, {_LENT} FROM (SELECT DISTINCT lang, source, feature FROM fine) g JOIN lang_total p ON g.feature = p.feature AND g.lang IS NOT DISTINCT FROM p.lang) GROUP BY ALL
), summed AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, feature ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, feature) AS total, CASE WHEN bucket = -100000 THEN 0 ELSE pow({quality.GAMMA}::DOUBLE, bucket) * (2 / {1 + quality.GAMMA}::DOUBLE) END AS middle FROM blend),
quantiles AS (SELECT lang, source, feature, {_QUANTILES}, round(sum(CAST(n AS DOUBLE) * middle) / CAST(any_value(total) AS DOUBLE), 9) AS mean FROM summed GROUP BY ALL),
cut AS (SELECT lang, source, feature, mean, q10 - {quality.REACH} * greatest(q50 - q10, q10 - q5) AS low, q90 + {quality.REACH} * greatest(q90 - q50, q95 - q90) AS high FROM quantiles),
verdict AS (
  SELECT r.doc_id, bool_and(CASE WHEN counted THEN a <= greatest(high, mean) * b OR (greatest(high, mean) * b > 0 AND a * ln(a / (greatest(high, mean) * b)) - a + greatest(high, mean) * b <= {quality.REACH**2 / 2}::DOUBLE) ELSE v BETWEEN low / {quality.GAMMA}::DOUBLE AND high * {quality.GAMMA}::DOUBLE END) AS fits
  FROM ratios r JOIN cut c ON c.feature = r.feature AND c.lang IS NOT DISTINCT FROM r.lang AND c.source IS NOT DISTINCT FROM r.source GROUP BY r.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce(fits, true) AS kept FROM judged LEFT JOIN verdict USING (doc_id)
"""

#: Every kept term of a language with every group, zeros included, and all pairs of those.
ORACLES["op13_source_divergence"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents
), w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), keep AS (
  SELECT lang, term, count(*) AS n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 10
), langs AS (
  SELECT lang, count(*) AS v, sum(n) AS total FROM keep GROUP BY lang
), q AS (
  SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (total + 2 * v) AS q FROM keep JOIN langs USING (lang)
), g AS (
  SELECT DISTINCT lang, source FROM d
), found AS (
  SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN keep USING (lang, term) GROUP BY ALL
), full_counts AS (
  SELECT g.lang, g.source, keep.term, coalesce(found.n, 0) AS n FROM g JOIN keep USING (lang) LEFT JOIN found USING (lang, source, term)
), p AS (
  SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_counts JOIN langs USING (lang)
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM rows QUALIFY part = 'pair' OR rank <= 10
"""
