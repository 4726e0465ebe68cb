"""DuckDB SQL of the queries that SQL can express."""

WS = r"[\x20\x09-\x0D]"

OP1 = rf"""
WITH d AS (
  SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> ''))::BIGINT AS size,
    (length(translate(coalesce(text, ''), '#*$%&|<>', '')) + 1)::DOUBLE
      / (length(coalesce(text, '')) + 1) AS weight,
    (('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT + 0.5::DOUBLE)
      / 4503599627370496::DOUBLE AS u
  FROM documents),
k AS (SELECT *, -ln(u) / weight AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM k GROUP BY source),
r AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM s),
l AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (
        ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (
        ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM r),
t AS (SELECT source, source_size, least(cap, max(level) OVER () * w) AS target FROM l),
p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target + 0.5)::BIGINT // source_size ELSE 0 END
    AS epochs FROM t),
o AS (
  SELECT k.doc_id, k.size, p.source_size, p.target, p.epochs,
    floor(p.target + 0.5)::BIGINT - p.epochs * p.source_size AS rest,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key)::BIGINT AS upto,
    sum(k.size) OVER (PARTITION BY k.source, k.key)::BIGINT AS here,
    count(*) OVER (PARTITION BY k.source, k.key) AS n
  FROM k JOIN p ON k.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target,
  epochs * size + CASE WHEN rest = 0 OR upto - here >= rest THEN 0
    WHEN upto < rest THEN size
    ELSE least(size, (rest - (upto - here)) // n) END AS taken
FROM o
"""

OP6 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{WS}+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM d)),
h AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM g) WHERE n > 1),
r AS (
  SELECT rid, count(DISTINCT p) AS n
  FROM (SELECT rid, i + unnest([0, 1, 2]) AS p FROM h) GROUP BY rid),
l AS (SELECT rid, unnest(lines) AS line FROM d),
m AS (
  SELECT rid, line,
    list_filter(regexp_split_to_array(line, '{WS}+'), lambda w: w <> '') AS words,
    length(regexp_replace(line, '[^!]+', '', 'g')) AS marks FROM l),
b AS (
  SELECT rid, sum(length(array_to_string(words, ''))) AS lost FROM m
  WHERE 3 * length(regexp_replace(line, '[^#*$%&|<>]+', '', 'g')) > len(words)
    OR (contains(line, '!!') AND marks >= 3 AND 2 * marks > len(words))
    OR (NOT regexp_matches(line, '[a-zß-öø-ÿ]')
      AND length(regexp_replace(line, '[^A-ZÀ-ÖØ-Þ]+', '', 'g')) >= 10)
    OR (length(line) <= 80 AND len(words) < 4
      AND NOT regexp_matches(line, '[.!?…:;,"''”»)\]]\s*$'))
    OR (length(line) <= 60 AND regexp_matches(line, '(?i)^\W*(home|menu|log ?in|sign (in|up)|next|previous|back( to top)?|skip to content|read more|share( this)?|subscribe|contact( us)?|about( us)?)\W*$'))
    OR (length(line) <= 300 AND regexp_matches(line, '(?i)(all rights reserved|terms of (use|service)|privacy policy|accept (all )?cookies|enable javascript|lorem ipsum|click here)'))
  GROUP BY rid),
c AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
    coalesce(length(array_to_string(words, '')), 0)::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM d LEFT JOIN r USING (rid) LEFT JOIN b USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  (NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost <= word_chars) AS kept
FROM c
"""
