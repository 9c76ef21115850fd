"""DuckDB SQL for the operators that SQL can express, written on its own, not derived from the Spark code."""

SPACE = r"\x20\x09-\x0D"

ORACLES: dict[str, str] = {}

_WORDS = rf"regexp_extract_all(coalesce(text, ''), '[^{SPACE}]+')"

ORACLES["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w FROM documents),
pos AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM pos),
rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, a, b, c) > 1),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l FROM d),
lc AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup FROM ln WHERE regexp_matches(l, '[^{SPACE}]') GROUP BY doc_id),
m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[{SPACE}]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(lc.n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(lc.n_lines, 0) AS BIGINT) AS n_lines,
    CAST(length(regexp_replace(text, '\P{{Lu}}', '', 'g')) AS BIGINT) AS n_capitals
  FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN lc USING (doc_id)),
f AS (
  SELECT *, CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 100 * n_symbols > 30 * n_words THEN 4 ELSE 0 END + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 8 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 20 * n_words THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_capitals > 50 * word_chars THEN 32 ELSE 0 END AS failures
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept,
  n_lines, n_capitals, CAST(failures AS BIGINT) AS failures
FROM f
"""

ORACLES["op5_exact_dedup"] = rf"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[{SPACE}]', '', 'g')) AS text_sha256 FROM documents),
k AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS place
  FROM d)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM k
"""

ORACLES["op10_line_dedup"] = r"""
WITH p AS (
  SELECT page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(list_transform(string_split(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
      '(?is)<script(?:\s[^>]*)?>.*?</script\s*>|<style(?:\s[^>]*)?>.*?</style\s*>|<!--.*?-->', '', 'g'),
      '(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|p|pre|section|table|td|th|title|tr|ul)(?:[\s/][^>]*)?>', chr(10), 'g'),
      '<[^>]*>', '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS ls
  FROM pages),
n AS (SELECT row_number() OVER () AS r, * FROM p),
t AS (SELECT host, count(*) AS pages FROM n GROUP BY host),
e AS (SELECT r, page_id, host, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM n),
c AS (SELECT host, l, count(DISTINCT r) AS n FROM e GROUP BY host, l),
b AS (SELECT host, l FROM c JOIN t USING (host) WHERE n >= 3 AND n > pages * CAST(0.3 AS DOUBLE)),
k AS (SELECT e.r, count(*) AS n_kept, string_agg(e.l, chr(10) ORDER BY i) AS text FROM e ANTI JOIN b ON e.host = b.host AND e.l = b.l GROUP BY e.r)
SELECT page_id, host, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n_kept, 0) AS BIGINT) AS n_dropped, sha256(coalesce(text, '')) AS kept_sha256
FROM n LEFT JOIN k USING (r)
"""

ORACLES["op12_hard_negatives"] = """
WITH e AS (
  SELECT row_number() OVER () AS k, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.k, a.vec_id AS anchor_id, b.k AS other, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM e AS a JOIN e AS b ON a.k <> b.k WHERE a.vec_id % 100 = 0),
p AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
  p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON p.k = s.k AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.k, p.other ORDER BY s.score DESC, s.vec_id NULLS LAST)
QUALIFY row_number() OVER w <= 5
"""
