"""SQL for DuckDB that gives the rows of queries which SQL can express."""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
                                      ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS shingle
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT x, y FROM common JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * i >= 85 * (p.n + q.n - i)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT reached.doc_id, y FROM reached JOIN both_ways ON x = other)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH texts AS (SELECT doc_id, {_WORDS} AS w FROM documents),
items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest([array_to_string(w[i:i + least(len(w), 10) - 1], ' ') FOR i IN range(1, len(w) - least(len(w), 10) + 2)]) AS words
  FROM items WHERE len(w) > 0),
places AS (SELECT doc_id, len(w) AS total, w, unnest(range(1, len(w) + 1)) AS p FROM texts),
starts AS (SELECT doc_id, p, n, array_to_string(w[p:p + n - 1], ' ') AS words FROM places, (SELECT DISTINCT n FROM windows) AS sizes WHERE p + n - 1 <= total),
found AS (SELECT doc_id, p, windows.n, item_id FROM starts JOIN windows USING (n, words)),
hits AS (SELECT doc_id, count(DISTINCT word) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS word FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item_id FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM texts LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""

LEXICAL_SEARCH = f"""
WITH words AS (SELECT doc_id, unnest({_WORDS}) AS term FROM documents),
asked AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_WORDS}) AS term FROM benchmark) GROUP BY 1, 2),
lengths AS (SELECT doc_id, count(*) AS n FROM words GROUP BY 1),
totals AS (SELECT count(*) AS big_n, CAST(sum(n) AS BIGINT) AS big_l FROM lengths),
counted AS (SELECT doc_id, term, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY 1, 2),
weights AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted, totals GROUP BY term),
impacts AS (SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * big_n) // big_l))) AS impact
            FROM counted JOIN weights USING (term) JOIN lengths USING (doc_id), totals),
scores AS (SELECT item_id, doc_id, CAST(sum(times * impact) AS BIGINT) AS score FROM asked JOIN impacts USING (term) GROUP BY 1, 2),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 20
"""

_BARE = r"""regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:?''"()-', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"""
_PART = "CASE WHEN p > 0 THEN p * log2(p / ((p + q) / 2)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(q / ((p + q) / 2)) ELSE 0 END"

QUALITY_RULES = rf"""
WITH texts AS (SELECT doc_id, lang, coalesce(text, '') AS t FROM documents),
split AS (SELECT doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, {_BARE} AS bare,
                 regexp_replace(t, '[\p{{Ll}}\p{{Lo}}\x20\x09-\x0D]+', '', 'g') AS rest FROM texts),
counted AS (SELECT doc_id, lang, t, w, bare, length(array_to_string(w, '')) AS inside, length(rest) AS most,
                   length(rest) - length(regexp_replace(rest, '\p{{Lu}}+', '', 'g')) AS capitals, length(rest) - length(regexp_replace(rest, '\p{{N}}+', '', 'g')) AS digits,
                   length(rest) - length(regexp_replace(rest, '[.,;:?''"()\-]+', '', 'g')) AS marks FROM split),
classes AS (SELECT doc_id, lang, unnest(range(6)) AS i, unnest([inside - most, capitals, digits, length(t) - inside, marks, most - capitals - digits - marks]) AS n FROM counted),
bad AS (SELECT doc_id FROM labels WHERE quality = 0 OR toxic = 1),
good AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id NOT IN (SELECT doc_id FROM bad) AND md5(CAST(doc_id AS VARCHAR))[1] < '8'),
top AS (SELECT lang FROM documents WHERE lang IS NOT NULL GROUP BY lang ORDER BY count(*) DESC, lang LIMIT 8),
ids AS (SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS n
        FROM documents WHERE lang IN (SELECT lang FROM top) AND doc_id NOT IN (SELECT doc_id FROM bad) AND doc_id NOT IN (SELECT doc_id FROM good)) WHERE n <= 2000),
char_sums AS (SELECT lang, i, sum(n) AS n FROM classes WHERE doc_id IN (SELECT doc_id FROM ids) GROUP BY lang, i),
char_refs AS (SELECT lang, i, CAST(n AS DOUBLE) / greatest(1, sum(n) OVER (PARTITION BY lang)) AS q FROM char_sums),
running AS (SELECT lang, word, count(*) AS n FROM (SELECT lang, unnest(bare) AS word FROM counted WHERE doc_id IN (SELECT doc_id FROM ids)) GROUP BY lang, word),
common AS (SELECT lang, word, q FROM (SELECT lang, word, CAST(n AS DOUBLE) / sum(n) OVER (PARTITION BY lang) AS q, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS place FROM running)
           WHERE place <= 24),
word_counts AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(bare) AS word FROM counted) WHERE word IN (SELECT word FROM common) GROUP BY 1, 2),
sizes AS (SELECT doc_id, len(bare) AS size, len(w) AS n_words, inside, greatest(1, inside + length(t) - inside) AS chars FROM counted),
char_parts AS (SELECT doc_id, char_refs.lang, CAST(n AS DOUBLE) / chars AS p, q FROM classes JOIN sizes USING (doc_id) JOIN char_refs USING (i)),
char_far AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, sqrt(greatest(0, sum({_PART}) / 2)) AS d FROM char_parts GROUP BY 1, 2) GROUP BY 1),
word_each AS (SELECT s.doc_id, c.lang, coalesce(n, 0) AS n, c.q, greatest(1, size) AS size FROM sizes s CROSS JOIN common c LEFT JOIN word_counts k ON k.doc_id = s.doc_id AND k.word = c.word),
word_parts AS (SELECT doc_id, lang, CAST(n AS DOUBLE) / size AS p, q FROM word_each
               UNION ALL SELECT e.doc_id, lang, CAST(any_value(s.size) - sum(n) AS DOUBLE) / any_value(e.size), 1 - sum(q) FROM word_each e JOIN sizes s USING (doc_id) GROUP BY 1, 2),
word_far AS (SELECT doc_id, min(d) AS d FROM (SELECT doc_id, lang, sqrt(greatest(0, sum({_PART}) / 2)) AS d FROM word_parts GROUP BY 1, 2) GROUP BY 1),
distances AS (SELECT doc_id, CASE WHEN inside >= 100 THEN c.d END AS char_distance, CASE WHEN n_words >= 50 THEN v.d END AS word_distance
              FROM sizes LEFT JOIN char_far c USING (doc_id) LEFT JOIN word_far v USING (doc_id)),
held AS (SELECT doc_id FROM good ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id LIMIT 2000),
limits AS (SELECT ceil(quantile_cont(char_distance, 0.99) * 10000) / 10000 AS max_char, ceil(quantile_cont(word_distance, 0.99) * 10000) / 10000 AS max_word
           FROM distances WHERE doc_id IN (SELECT doc_id FROM held)),
places AS (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS p FROM counted WHERE len(w) >= 8),
windows AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, array_to_string(w[p:p + 7], ' ')) AS n FROM places),
repeats AS (SELECT doc_id, count(DISTINCT word) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS word FROM windows WHERE n > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM counted) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id),
based AS (SELECT c.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(inside AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                 coalesce(lines.n, 0) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words
          FROM counted c LEFT JOIN repeats ON repeats.doc_id = c.doc_id LEFT JOIN lines ON lines.doc_id = c.doc_id),
judged AS (SELECT based.*, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, char_distance, word_distance FROM based JOIN distances USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT coalesce(char_distance > max_char, FALSE) AND NOT coalesce(word_distance > max_word, FALSE) AS kept,
       round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance
FROM judged, limits
"""
