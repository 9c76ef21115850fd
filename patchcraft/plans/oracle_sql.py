"""Independent DuckDB formulations used as the correctness oracle.

The adapters are re-stated in DuckDB SQL (they must give byte-identical
tables); the operators are re-stated with a different method wherever the
Spark form uses arrays or windows (line unnest + joins instead of in-row
arrays and re-ordering keys), so the two do not share logic.
"""

from __future__ import annotations

from ..functions import fixed
from ..operators import comments as CM
from ..sources import tables as TB

WORD = fixed.WORD_RE
KW = ", ".join(f"'{k}'" for k in fixed.JAVA_KEYWORDS)
TOKEN = fixed.TOKEN_RE.replace("'", "''")

# ------------------------------------------------------------------ adapters
# Mirrors tables.patches_from_documents.
_NEW_LINE = f"""
  (CASE WHEN c = 6 OR (coalesce(strpos(l, w1), 0) = 0 AND coalesce(strpos(l, w2), 0) = 0
                       AND coalesce(strpos(l, w3), 0) = 0) THEN l ELSE
   array_to_string(list_transform(regexp_extract_all(l, '{WORD}', 1), lambda t:
      CASE
        WHEN c IN (0, 4, 5, 7) AND t = w1 THEN t || '_1'
        WHEN c = 1 AND (t = w1 OR t = w2) THEN t || '_1'
        WHEN c = 2 AND (t = w1 OR t = w2 OR t = w3) THEN t || '_1'
        WHEN c = 3 AND t = w1 AND (i - 1) % 2 = 0 THEN t || '_1'
        WHEN c = 3 AND t = w1 THEN t || '_2'
        ELSE t END), '') END || CASE WHEN c = 4 THEN ' ' ELSE '' END)"""

PATCHES = f"""
doc_words AS (
  SELECT doc_id, source, text, CAST(doc_id % 8 AS INTEGER) AS c,
         list_filter(regexp_extract_all(text, '{WORD}', 1), lambda t: regexp_matches(t, '^\\p{{L}}')) AS letters,
         list_filter(string_split(text, chr(10)), lambda l: l <> '') AS lines
  FROM documents
),
doc_w AS (
  SELECT *, letters[1] AS w1 FROM doc_words
),
doc_w2 AS (
  SELECT *, list_filter(letters, lambda t: t <> w1)[1] AS w2 FROM doc_w
),
doc_w3 AS (
  SELECT *, list_filter(letters, lambda t: t <> w1 AND t <> w2)[1] AS w3 FROM doc_w2
),
patches AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS patch_id,
    '@@ -1 +1 @@' || chr(10) ||
    CASE
      WHEN c = 7 THEN
        array_to_string(list_transform(lines, lambda l: '-' || l), chr(10)) || chr(10) ||
        array_to_string(list_transform(lines, lambda l, i: '+' || {_NEW_LINE}), chr(10)) ||
        chr(10) || ' x' || chr(10)
      WHEN c = 5 THEN
        array_to_string(list_transform(lines, lambda l, i: '-' || l || chr(10) || '+' || {_NEW_LINE}), chr(10)) ||
        chr(10) || '-package a.b;' || chr(10) || '+package a.c;' || chr(10)
      ELSE
        array_to_string(list_transform(lines, lambda l, i: '-' || l || chr(10) || '+' || {_NEW_LINE}), chr(10)) || chr(10)
    END AS text
  FROM doc_w3
)"""

# Verdicts by line unnest: block runs pair their j-th removal with their j-th
# addition by a join; every other addition pairs with the changed line before
# it in file order when that is a removal.  Words of a pair are compared by a
# full join on the word index.
_RENAME_LINES = f"""
plines AS (
  SELECT p.repo, p.patch_id, t.pos - 1 AS pos, t.line, substr(t.line, 1, 1) AS sign
  FROM patches p, unnest(string_split(p.text, chr(10))) WITH ORDINALITY AS t(line, pos)
),
pstats AS (
  SELECT repo, patch_id,
         count(*) FILTER (WHERE sign = '-') AS n_minus,
         count(*) FILTER (WHERE sign = '+') AS n_plus,
         bool_or(regexp_matches(line, '^[+-][ \\t\\f\\x0B\\r]*package ')) AS has_pkg
  FROM plines GROUP BY repo, patch_id
),
kept AS (
  SELECT repo, patch_id FROM pstats WHERE {{KEPT}}
),
chg AS (
  SELECT l.repo, l.patch_id, l.pos, l.line, l.sign,
         l.pos - row_number() OVER (PARTITION BY l.repo, l.patch_id ORDER BY l.pos) AS island
  FROM plines l JOIN kept USING (repo, patch_id)
  WHERE l.sign IN ('-', '+')
),
islands AS (
  SELECT repo, patch_id, island, min(pos) AS i_start,
         count(*) FILTER (WHERE sign = '-') AS k_minus,
         count(*) FILTER (WHERE sign = '+') AS k_plus,
         max(pos) FILTER (WHERE sign = '-') AS last_minus,
         min(pos) FILTER (WHERE sign = '+') AS first_plus
  FROM chg GROUP BY repo, patch_id, island
),
chg2 AS (
  SELECT c.*, (i.k_minus = i.k_plus AND i.k_minus > 1 AND i.last_minus < i.first_plus) AS in_block, i.i_start,
         row_number() OVER (PARTITION BY c.repo, c.patch_id, c.island, c.sign ORDER BY c.pos) AS j,
         lag(c.sign) OVER (PARTITION BY c.repo, c.patch_id ORDER BY c.pos) AS prev_sign,
         lag(c.line) OVER (PARTITION BY c.repo, c.patch_id ORDER BY c.pos) AS prev_line
  FROM chg c JOIN islands i USING (repo, patch_id, island)
),
pairs AS (
  SELECT a.repo, a.patch_id, a.i_start + 2 * (a.j - 1) + 1 AS ord, substr(m.line, 2) AS old_line, substr(a.line, 2) AS new_line
  FROM chg2 a JOIN chg2 m
    ON a.repo = m.repo AND a.patch_id = m.patch_id AND a.island = m.island AND a.j = m.j
  WHERE a.in_block AND a.sign = '+' AND m.sign = '-'
  UNION ALL
  SELECT repo, patch_id, pos AS ord, substr(prev_line, 2), substr(line, 2)
  FROM chg2 WHERE NOT in_block AND sign = '+' AND prev_sign = '-'
),
old_words AS (
  SELECT p.repo, p.patch_id, p.ord, w.word, w.idx
  FROM pairs p, unnest(regexp_extract_all(p.old_line, '{WORD}', 1)) WITH ORDINALITY AS w(word, idx)
),
new_words AS (
  SELECT p.repo, p.patch_id, p.ord, w.word, w.idx
  FROM pairs p, unnest(regexp_extract_all(p.new_line, '{WORD}', 1)) WITH ORDINALITY AS w(word, idx)
),
word_cmp AS (
  SELECT coalesce(o.repo, n.repo) AS repo, coalesce(o.patch_id, n.patch_id) AS patch_id,
         coalesce(o.ord, n.ord) AS ord, coalesce(o.idx, n.idx) AS idx, o.word AS old, n.word AS new
  FROM old_words o FULL JOIN new_words n
    ON o.repo = n.repo AND o.patch_id = n.patch_id AND o.ord = n.ord AND o.idx = n.idx
),
diffs AS (
  SELECT * FROM word_cmp WHERE old IS DISTINCT FROM new
),
bad AS (
  SELECT DISTINCT repo, patch_id FROM diffs
  WHERE old IS NULL OR new IS NULL
     OR NOT regexp_matches(old, '^[\\p{{L}}_]') OR NOT regexp_matches(new, '^[\\p{{L}}_]')
     OR old IN ({KW}) OR new IN ({KW})
),
renames AS (
  SELECT d.repo, d.patch_id, d.old, d.new, min(d.ord * 1000000 + d.idx) AS first_at
  FROM diffs d ANTI JOIN bad b ON d.repo = b.repo AND d.patch_id = b.patch_id
  GROUP BY d.repo, d.patch_id, d.old, d.new
),
conflicts AS (
  SELECT repo, patch_id FROM renames GROUP BY repo, patch_id HAVING count(DISTINCT old) < count(*)
),
verdicts AS (
  SELECT k.repo, k.patch_id,
         CAST(count(r.old) AS BIGINT) AS n_renames,
         string_agg(r.old || '->' || r.new, ', ' ORDER BY r.first_at) AS message
  FROM kept k
  LEFT JOIN renames r ON k.repo = r.repo AND k.patch_id = r.patch_id
  WHERE NOT EXISTS (SELECT 1 FROM bad b WHERE b.repo = k.repo AND b.patch_id = k.patch_id)
    AND NOT EXISTS (SELECT 1 FROM conflicts c WHERE c.repo = k.repo AND c.patch_id = k.patch_id)
  GROUP BY k.repo, k.patch_id
)"""


RENAME_LINES = _RENAME_LINES.replace("{KEPT}", "n_minus = n_plus AND NOT has_pkg")
ALL_LINES = _RENAME_LINES.replace("{KEPT}", "true")


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.strip() for c in ctes) + "\n" + select


def rename_verdicts() -> str:
    return with_ctes(PATCHES, RENAME_LINES, select="""
SELECT repo, patch_id,
       CASE WHEN n_renames = 0 THEN 'n' WHEN n_renames <= 2 THEN 'y' ELSE 'skip' END AS verdict,
       n_renames, message
FROM verdicts""")


def verdict_counts() -> str:
    return with_ctes(PATCHES, RENAME_LINES, select="""
SELECT repo, CASE WHEN n_renames = 0 THEN 'n' WHEN n_renames <= 2 THEN 'y' ELSE 'skip' END AS verdict,
       count(*) AS n_patches
FROM verdicts GROUP BY ALL""")




def _q(select: str, *ctes: str) -> str:
    return with_ctes(*ctes, select=select)


NUM = fixed.NUMBER_RE
IDENT = fixed.IDENT_WORD_RE

EXAMPLES = """
examples AS (
  SELECT p.repo || '/' || CASE WHEN l.quality = 1 THEN 'yes' ELSE 'no' END || '/' || p.patch_id || '.diff' AS path,
         CAST(l.quality AS INTEGER) AS label, p.text, CAST(strlen(p.text) AS BIGINT) AS n_bytes
  FROM patches p JOIN labels l ON p.patch_id = CAST(l.doc_id AS VARCHAR)
)"""

LOADED = f"""
loaded AS (
  SELECT path, label, n_bytes,
         regexp_extract_all(regexp_replace(text, '{NUM}', '1', 'g'), '{TOKEN}', 1) AS tokens
  FROM examples WHERE starts_with(text, '@@')
)"""

NGRAMS_EXPR = "list_concat(tokens, list_transform(range(1, len(tokens)), lambda i: tokens[i] || ' ' || tokens[i + 1]))"

# ---- splits: validation = first n//10 by md5('977:'||path); rest balanced by
# per-label rank on md5('977:balance:'||path); then 80/20 on md5('977:order:'||path).
SPLITS = """
ranked AS (
  SELECT *, row_number() OVER (ORDER BY md5('977:' || path), path) AS rk, count(*) OVER () AS n_all FROM loaded
),
rest AS (SELECT * FROM ranked WHERE rk > n_all // 10),
cls AS (
  SELECT count(*) FILTER (WHERE label = 1) AS ny, count(*) FILTER (WHERE label = 0) AS nn FROM rest
),
rest_ranked AS (
  SELECT r.*, row_number() OVER (PARTITION BY label ORDER BY md5('977:balance:' || path), path) AS lr FROM rest r
),
balanced AS (
  SELECT r.* FROM rest_ranked r, cls
  WHERE NOT (cls.ny > cls.nn * 1.1 OR cls.nn > cls.ny * 1.1) OR r.lr <= least(cls.ny, cls.nn)
),
ordered AS (
  SELECT *, row_number() OVER (ORDER BY md5('977:order:' || path), path) AS rk2, count(*) OVER () AS m FROM balanced
),
splits AS (
  SELECT path, label, n_tokens, 'validation' AS split
  FROM (SELECT path, label, len(tokens) AS n_tokens FROM ranked WHERE rk <= n_all // 10)
  UNION ALL
  SELECT path, label, len(tokens), CASE WHEN rk2 <= (4 * m) // 5 THEN 'train' ELSE 'test' END FROM ordered
  UNION ALL
  SELECT path, label, len(tokens), 'unused' FROM rest WHERE path NOT IN (SELECT path FROM balanced)
),
rule_pred AS (
  SELECT path, label, CAST(n_tokens > 500 AS INTEGER) AS prediction FROM splits WHERE split = 'validation'
)"""

VOCAB = f"""
idents AS (
  SELECT DISTINCT p.repo, p.patch_id, w AS word
  FROM patches p, unnest(regexp_extract_all(p.text, '{IDENT}', 1)) AS u(w)
  WHERE regexp_matches(w, '^[A-Za-z_]') AND w NOT IN ({KW})
),
vocab AS (
  SELECT DISTINCT word FROM idents
  UNION
  SELECT chr(CAST(c AS INTEGER)) FROM range(97, 123) AS r(c)
)"""

TEMPLATES = f"""
one_rename AS (
  SELECT r.repo, r.patch_id, r.old, r.new FROM renames r
  JOIN verdicts v ON r.repo = v.repo AND r.patch_id = v.patch_id WHERE v.n_renames = 1
),
templates AS (
  SELECT o.* FROM one_rename o
  WHERE NOT EXISTS (SELECT 1 FROM plines l WHERE l.repo = o.repo AND l.patch_id = o.patch_id AND l.sign = '-'
                      AND list_contains(regexp_extract_all(substr(l.line, 2), '{WORD}', 1), o.new))
    AND NOT EXISTS (SELECT 1 FROM plines l WHERE l.repo = o.repo AND l.patch_id = o.patch_id AND l.sign = '+'
                      AND list_contains(regexp_extract_all(substr(l.line, 2), '{WORD}', 1), o.old))
)"""

# ---- commits and changes straight from orders / lineitem
COMMITS = """
order_commits AS (
  SELECT o_orderkey, md5(CAST(o_orderkey AS VARCHAR)) AS commit_id,
         CASE WHEN o_orderstatus = 'P' AND o_orderpriority = '5-LOW' THEN 0
              WHEN o_orderstatus = 'O' AND o_orderpriority = '1-URGENT' THEN 2
              WHEN o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' THEN 3 ELSE 1 END AS n_parents
  FROM orders
),
commits AS (
  SELECT 'repo-' || (o_orderkey % 5) AS repo, commit_id, n_parents FROM order_commits
  UNION ALL SELECT 'repo-fork', commit_id, n_parents FROM order_commits WHERE o_orderkey % 7 = 0
)"""

CHANGES = """
changes AS (
  SELECT repo, md5(CAST(l_orderkey AS VARCHAR)) AS commit_id, CAST(l_linenumber AS BIGINT) AS ord,
         CAST(l_quantity AS INTEGER) AS q, l_linestatus,
         CASE WHEN l_discount <> 0 THEN 'src/P' || l_partkey || CASE l_returnflag WHEN 'N' THEN '.java' WHEN 'A' THEN '.JAVA' ELSE '.md' END END AS a_path,
         l_discount <> 0 AND l_tax <> 0 AND l_returnflag IN ('N', 'A') AS is_java,
         CAST(l_quantity AS INTEGER) < 4 AS is_empty,
         variable || l_partkey || ' = ' || l_suppkey || ';' AS o,
         variable || l_partkey || ' = ' || l_linenumber || ';' AS n
  FROM (SELECT *, 'repo-' || (l_orderkey % 5) AS repo, 'int v' AS variable FROM lineitem
        UNION ALL SELECT *, 'repo-fork', 'int f' FROM lineitem WHERE l_orderkey % 7 = 0)
),
change_lines AS (
  SELECT *,
    CASE WHEN is_empty THEN ''
         WHEN q % 5 <> 0 THEN '@@ -1 +1 @@~-' || o || '~+' || n || '~'
         WHEN q % 3 = 1 THEN '@@ -1 +1 @@~-' || o || '~\\ No newline at end of file~+' || o || '~'
         WHEN q % 3 = 2 THEN '@@ -1 +1 @@~-' || n || '~-' || o || '~\\ No newline at end of file~+int y;~+' || o || '~'
         ELSE '@@ -1 +1 @@~-' || n || '~+' || n || '~@@ -1 +1 @@~-int z;~+' || o || '~\\ No newline at end of file~' END AS given,
    CASE WHEN is_empty THEN ''
         WHEN q % 5 <> 0 THEN '@@ -1 +1 @@~-' || o || '~+' || n || '~'
         WHEN q % 3 = 1 THEN ''
         WHEN q % 3 = 2 THEN '@@ -1 +1 @@~-' || n || '~+int y;~ ' || o || '~'
         ELSE '@@ -1 +1 @@~-' || n || '~+' || n || '~@@ -1 +1 @@~-int z;~+' || o || '~' END AS wanted
  FROM changes
),
change_text AS (
  SELECT *, replace(given, '~', CASE WHEN l_linestatus = 'O' THEN chr(13) || chr(10) ELSE chr(10) END) AS raw_text,
         replace(given, '~', chr(10)) AS lf_text, replace(wanted, '~', chr(10)) AS fixed_text
  FROM change_lines
),
assembled AS (
  SELECT repo, commit_id,
         coalesce(string_agg(fixed_text, '' ORDER BY ord, a_path, fixed_text) FILTER (WHERE is_java AND NOT is_empty), '') AS text,
         count(*) FILTER (WHERE is_java AND NOT is_empty) AS n_java
  FROM change_text GROUP BY repo, commit_id
  HAVING bool_or(NOT (is_java AND is_empty))
)"""

# ---- combined git patches and their Java sections, by line unnest
COMBINED = """
comb_src AS (
  SELECT doc_id, source,
    '@@ -1 +1 @@' || chr(10) ||
      array_to_string(list_transform(list_filter(string_split(text, chr(10)), lambda l: l <> ''), lambda l: '+' || l), chr(10)) ||
      chr(10) AS hunk,
    ['java', 'md', 'JAVA'][doc_id % 3 + 1] AS ext_a, ['java', 'md', 'JAVA'][(doc_id + 1) % 3 + 1] AS ext_b
  FROM documents
),
comb_paths AS (
  SELECT *, source || '/' || doc_id || '.' || ext_a AS pa, source || '/' || doc_id || '_b.' || ext_b AS pb FROM comb_src
),
combined AS (
  SELECT CAST(doc_id AS VARCHAR) AS patch_id,
    CASE WHEN doc_id % 7 = 0 THEN hunk ELSE
      'diff --git a/' || pa || ' b/' || pa || chr(10) || 'index 0000000..1111111 100644' || chr(10) ||
      '--- a/' || pa || chr(10) || '+++ b/' || pa || chr(10) || hunk ||
      'diff --git a/' || pb || ' b/' || pb || chr(10) || 'index 0000000..1111111 100644' || chr(10) ||
      CASE WHEN doc_id % 5 <> 0 THEN '--- a/' || pb || chr(10) || '+++ b/' || pb || chr(10) || hunk
           ELSE 'new file mode 100644' || chr(10) END
    END AS text
  FROM comb_paths
),
clines AS (
  SELECT c.patch_id, t.pos, t.line, len(string_split(c.text, chr(10))) AS n_pieces,
         sum(CASE WHEN starts_with(t.line, 'diff --git ') THEN 1 ELSE 0 END) OVER (PARTITION BY c.patch_id ORDER BY t.pos) AS sec
  FROM combined c, unnest(string_split(c.text, chr(10))) WITH ORDINALITY AS t(line, pos)
),
csec AS (
  SELECT patch_id, sec,
         max(CASE WHEN starts_with(line, 'diff --git ') THEN line END) AS header,
         min(pos) FILTER (WHERE starts_with(line, '@@')) AS first_hunk
  FROM clines GROUP BY patch_id, sec
),
cleaned AS (
  SELECT c.patch_id, c.text,
    CASE WHEN NOT starts_with(c.text, 'diff --git ') THEN c.text ELSE coalesce((
      SELECT string_agg(CASE WHEN l.pos < l.n_pieces THEN l.line || chr(10) ELSE l.line END, '' ORDER BY l.pos)
      FROM clines l JOIN csec s ON l.patch_id = s.patch_id AND l.sec = s.sec
      WHERE l.patch_id = c.patch_id AND s.sec > 0 AND rtrim(s.header) LIKE '%.java'
        AND s.first_hunk IS NOT NULL AND l.pos >= s.first_hunk), '') END AS cleaned
  FROM combined c
),
audit AS (
  SELECT patch_id, cleaned,
    CAST((strlen(text) - strlen(replace(text, chr(10), '')) + CASE WHEN text <> '' AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END)
       - (strlen(cleaned) - strlen(replace(cleaned, chr(10), '')) + CASE WHEN cleaned <> '' AND NOT ends_with(cleaned, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS lines_removed
  FROM cleaned
)"""

VERSIONS = """
versions AS (
  SELECT CAST(doc_id AS VARCHAR) AS pair_id, text AS old,
    array_to_string(list_filter(list_transform(string_split(text, chr(10)),
        lambda l, i: CASE WHEN (i - 1) % 7 = 3 THEN '# ' || l ELSE l END), lambda l, i: (i - 1) % 5 <> 2), chr(10))
      || chr(10) || 'added line ' || doc_id AS new
  FROM documents
)"""

SYNTH = """
variants AS (
  SELECT d.doc_id, v.variant, d.text, string_split(d.text, chr(10)) AS lines,
    ['delete', 'add', 'both'][CAST(('0x' || substr(md5('977:' || d.doc_id || ':' || v.variant || ':choice'), 1, 12)) AS BIGINT) % 3 + 1] AS choice,
    CAST(('0x' || substr(md5('977:' || d.doc_id || ':' || v.variant || ':line'), 1, 12)) AS BIGINT) AS hline,
    substr(md5('977:' || d.doc_id || ':' || v.variant || ':text'), 1, 20) AS new_line
  FROM documents d, range(1, 21) AS v(variant)
),
edits AS (
  SELECT doc_id || ':' || variant || ':' || choice AS pair_id, text AS old,
    array_to_string(CASE choice
      WHEN 'delete' THEN list_concat(lines[1:p - 1], lines[p + 1:])
      WHEN 'add' THEN list_concat(lines[1:p - 1], [new_line], lines[p:])
      ELSE list_concat(lines[1:p - 1], [new_line], lines[p + 1:]) END, chr(10)) AS new
  FROM (SELECT *, CAST(hline % len(lines) + 1 AS BIGINT) AS p FROM variants)
)"""


REVISIONS = """
doc_lines AS (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS lines, len(string_split(coalesce(text, ''), chr(10))) // 3 AS third FROM documents),
edited AS (
  SELECT doc_id, source, array_to_string(lines, chr(10)) AS old, array_to_string(CASE doc_id % 7
      WHEN 0 THEN list_filter(list_transform(lines, lambda l, i: CASE WHEN (i - 1) % 7 = 3 THEN '# ' || l ELSE l END), lambda l, i: (i - 1) % 5 <> 2)
      WHEN 1 THEN list_concat(lines[third + 1:], lines[1:third])
      WHEN 2 THEN flatten(list_transform(lines, lambda l, i: CASE WHEN (i - 1) % 4 = 1 THEN [l, l] ELSE [l] END))
      WHEN 3 THEN lines
      WHEN 4 THEN CAST([] AS VARCHAR[])
      WHEN 5 THEN list_reverse(lines)
      ELSE list_concat(['first line'], list_transform(lines, lambda l, i: CASE WHEN (i - 1) % 3 = 0 THEN '!' || l ELSE l END)) END, chr(10)) AS new
  FROM doc_lines),
revisions AS (
  SELECT doc_id, source, CAST(doc_id AS VARCHAR) AS pair_id,
    old || CASE WHEN doc_id % 2 = 0 AND old <> '' THEN chr(10) ELSE '' END AS old,
    new || CASE WHEN doc_id % 3 = 0 AND new <> '' THEN chr(10) ELSE '' END AS new
  FROM edited)"""

#: ``sides(pair_id, a, b)``: the lines of both versions, as ``LCS`` compares them.
ALL_SIDES = "sides AS (SELECT pair_id, string_split(old, chr(10)) AS a, string_split(new, chr(10)) AS b FROM revisions)"


def _text_lines(c: str) -> str:
    return f"CASE WHEN {c} = '' THEN CAST([] AS VARCHAR[]) WHEN ends_with({c}, chr(10)) THEN string_split({c}[:-2], chr(10)) ELSE string_split({c}, chr(10)) END"


CRLF_SIDES = f"""
crlf AS (SELECT doc_id, pair_id, CASE WHEN doc_id % 5 = 0 THEN replace(old, chr(10), chr(13) || chr(10)) ELSE old END AS old,
  CASE WHEN doc_id % 5 = 0 THEN replace(new, chr(10), chr(13) || chr(10)) ELSE new END AS new FROM revisions),
sides AS (SELECT pair_id, {_text_lines('old')} AS a, {_text_lines('new')} AS b FROM crlf)"""
ENDED_SIDES = f"sides AS (SELECT pair_id, {_text_lines('old')} AS a, {_text_lines('new')} AS b FROM revisions)"

#: Length of the longest common subsequence by its table, a row of the table a step.
LCS = """
steps AS (
  SELECT pair_id, a, b, 0 AS i, list_transform(range(0, len(b) + 1), lambda j: 0) AS row FROM sides
  UNION ALL
  SELECT pair_id, a, b, i + 1, list_transform(range(1, len(b) + 2), lambda j: list_max(best[1:j]))
  FROM (SELECT *, list_transform(range(1, len(b) + 2), lambda j:
          CASE WHEN j = 1 THEN 0 ELSE greatest(row[j], row[j - 1] + CASE WHEN a[i + 1] = b[j - 1] THEN 1 ELSE 0 END) END) AS best
        FROM steps WHERE i < len(a))),
lcs AS (SELECT pair_id, CAST(len(a) AS BIGINT) AS n_old, CAST(len(b) AS BIGINT) AS n_new, CAST(row[len(b) + 1] AS BIGINT) AS n_kept FROM steps WHERE i = len(a))"""


def _ended(c: str) -> str:
    return f"CASE WHEN {c} = '' OR ends_with({c}, chr(10)) THEN {c} ELSE {c} || chr(10) END"


_SCRIPT_LETTERS = "CASE doc_id % 11 " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(TB.LETTERS) if x) + " END"
CHARSETS = rf"""
cdocs AS (
  SELECT doc_id, source,
    CASE WHEN doc_id % 11 <= 3 THEN coalesce(text, '')
         ELSE translate(replace(lower(regexp_replace(coalesce(text, ''), '[^\x00-\x7F]', '', 'g')), chr(0), ''), 'abcdefghijklmnopqrstuvwxyz', {_SCRIPT_LETTERS}) END AS text,
    CASE WHEN doc_id % 11 = 3 AND NOT (regexp_full_match(text, '[\x{{0}}-\x{{7F}}\x{{A0}}-\x{{FF}}]*') AND regexp_matches(text, '[\x{{A0}}-\x{{FF}}]')) THEN 'UTF-8'
         WHEN doc_id % 11 > 3 AND NOT regexp_matches(text, '[A-Za-z]') THEN 'UTF-8'
         ELSE {list(TB.CHARSETS)}[doc_id % 11 + 1] END AS charset
  FROM documents)"""


_LEXEME = CM.LEXEME.replace("*+", "*").replace("'", "''")


def _around(*parts: str) -> str:
    """Every line between the given pieces; ``@`` is a newline."""
    quoted = ["'" + part.replace("'", "''").replace("@", "' || chr(10) || '") + "'" for part in parts]
    return f"list_transform(ls, lambda l: {' || l || '.join(quoted)})"


_COMMENT, _OPENS = "x[1:2] IN ('//', '/*')", "x[1:2] = '/*' AND NOT (ends_with(x, '*/') AND length(x) >= 4)"
COMMENTED = f"""
cdoc AS (SELECT doc_id, source, list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> '') AS ls FROM documents),
cpatches AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS patch_id, '@@ -1 +1 @@' || chr(10) || array_to_string(CASE doc_id % 6
    WHEN 0 THEN {_around("-", " // one@+", " // two")}
    WHEN 1 THEN list_concat([' /**'], {_around("- * ", "@+ * ", " more")}, [' */', ' int a;'])
    WHEN 2 THEN {_around("+/* ", "@+ more */@ ", "")}
    WHEN 3 THEN {_around("-int alpha = 1; /* ", " */@+int beta = 1; /* other ", " */")}
    WHEN 4 THEN {_around('-String s = "// ', '" + x;@+String s = "// ', '" + y;')}
    ELSE list_concat({_around("- ", "@+ ", " edited")}, [' */'], {_around("-int b; // ", "@+int c; //", "")}) END, chr(10)) || chr(10) AS text
  FROM cdoc),
cl AS (SELECT repo, patch_id, u.pos, u.line FROM cpatches, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(line, pos)),
cside AS (
  SELECT cl.*, s.side, row_number() OVER (PARTITION BY repo, patch_id, s.side ORDER BY pos) AS k,
    regexp_extract_all(substr(line, 2), '{_LEXEME}', 1) AS out_lex, contains(substr(line, 2), '*/') AS closed,
    CASE WHEN contains(substr(line, 2), '*/') THEN regexp_extract_all(substr(line, 2 + instr(substr(line, 2), '*/') + 1), '{_LEXEME}', 1) ELSE CAST([] AS VARCHAR[]) END AS in_lex,
    regexp_matches(substr(line, 2), '^\\s*(\\*|$)') AS starred
  FROM cl, (VALUES ('-'), ('+')) AS s(side) WHERE line[1] IN (s.side, ' ')),
cfun AS (
  SELECT *, len(list_filter(out_lex, lambda x: {_OPENS})) > 0 AS after_out, NOT closed OR len(list_filter(in_lex, lambda x: {_OPENS})) > 0 AS after_in,
    contains(array_to_string(list_transform(out_lex, lambda x: CASE WHEN {_COMMENT} OR x[1] IN (chr(34), chr(39)) THEN ' ' ELSE x END), ''), '*/') AS stray,
    len(list_filter(out_lex, lambda x: {_COMMENT})) > 0 AS out_comment
  FROM cside),
cbegan AS (
  SELECT repo, patch_id, side, coalesce(arg_min(stray, pos) FILTER (stray OR out_comment), bool_and(starred) AND bool_or(contains(line, '*'))) AS began
  FROM cfun GROUP BY ALL),
cwalk AS (
  SELECT f.repo, f.patch_id, f.side, f.k, began AS inside, CASE WHEN began THEN after_in ELSE after_out END AS next
  FROM cfun f JOIN cbegan USING (repo, patch_id, side) WHERE k = 1
  UNION ALL
  SELECT f.repo, f.patch_id, f.side, f.k, w.next, CASE WHEN w.next THEN f.after_in ELSE f.after_out END
  FROM cwalk w JOIN cfun f ON f.repo = w.repo AND f.patch_id = w.patch_id AND f.side = w.side AND f.k = w.k + 1),
ccode AS (
  SELECT f.*, w.inside, w.inside OR out_comment AS has_comment,
    CASE WHEN w.inside OR out_comment THEN rtrim(array_to_string(list_transform(CASE WHEN w.inside THEN in_lex ELSE out_lex END,
      lambda x: CASE WHEN {_COMMENT} THEN ' ' ELSE x END), '')) ELSE substr(line, 2) END AS code
  FROM cfun f JOIN cwalk w USING (repo, patch_id, side, k)),
cchanged AS (SELECT * FROM ccode WHERE line[1] = side AND NOT (has_comment AND trim(code) = '')),
cflags AS (
  SELECT c.repo, c.patch_id, bool_or(c.line[1] = c.side) AND bool_or(c.line[1] = c.side AND c.has_comment)
    AND any_value(coalesce(o.code, '')) = any_value(coalesce(n.code, '')) AS only_comments
  FROM ccode c
  LEFT JOIN (SELECT repo, patch_id, string_agg(code || chr(1), '' ORDER BY pos) AS code FROM cchanged WHERE side = '-' GROUP BY ALL) o USING (repo, patch_id)
  LEFT JOIN (SELECT repo, patch_id, string_agg(code || chr(1), '' ORDER BY pos) AS code FROM cchanged WHERE side = '+' GROUP BY ALL) n USING (repo, patch_id)
  GROUP BY ALL),
patches AS (
  SELECT repo, patch_id, string_agg(line, chr(10) ORDER BY pos) AS text FROM (
    SELECT repo, patch_id, pos, line FROM cl WHERE line = '' OR line[1] NOT IN ('-', '+')
    UNION ALL SELECT repo, patch_id, pos, side || code FROM cchanged)
  GROUP BY ALL)"""


def _changed(src: str) -> str:
    return f"""
o_lines AS (SELECT pair_id, line FROM {src}, unnest(string_split(old, chr(10))) AS u(line)),
n_lines AS (SELECT pair_id, line FROM {src}, unnest(string_split(new, chr(10))) AS u(line)),
only_old AS (SELECT * FROM o_lines EXCEPT ALL SELECT * FROM n_lines),
only_new AS (SELECT * FROM n_lines EXCEPT ALL SELECT * FROM o_lines)"""


CHANGED_SELECT = """
SELECT pair_id, '-' AS sign, line, count(*) AS n FROM only_old GROUP BY pair_id, line
UNION ALL
SELECT pair_id, '+' AS sign, line, count(*) AS n FROM only_new GROUP BY pair_id, line"""

P = PATCHES
ORACLES: dict[str, str] = {
    "rename_verdicts": rename_verdicts(),
    "verdict_counts": verdict_counts(),
    "code_patches": _q("SELECT repo, patch_id, text, coalesce(only_comments, false) AS only_comments FROM patches LEFT JOIN cflags USING (repo, patch_id)", COMMENTED),
    "code_verdicts": _q(r"""
SELECT p.repo, p.patch_id, CASE WHEN only_comments THEN 'n' WHEN v.n_renames = 0 THEN 'n' WHEN v.n_renames <= 2 THEN 'y' WHEN v.n_renames > 2 THEN 'skip' END AS verdict,
  CASE WHEN only_comments THEN 0 ELSE v.n_renames END AS n_renames, CASE WHEN NOT coalesce(only_comments, false) THEN v.message END AS message,
  CASE WHEN only_comments THEN 'comment' WHEN v.repo IS NULL THEN coalesce(
    CASE WHEN len(regexp_extract_all(p.text, '(?m)^-')) <> len(regexp_extract_all(p.text, '(?m)^\+')) THEN 'unbalanced' END,
    CASE WHEN b.repo IS NOT NULL THEN 'not a rename' ELSE 'conflicting rename' END) END AS reason
FROM patches p LEFT JOIN cflags USING (repo, patch_id) LEFT JOIN verdicts v USING (repo, patch_id) LEFT JOIN bad b USING (repo, patch_id)""", COMMENTED, RENAME_LINES),
    "rename_map": _q("SELECT repo, patch_id, n_renames, message FROM verdicts", P, RENAME_LINES),
    "change_runs": _q("SELECT DISTINCT repo, patch_id, CAST(i_start AS BIGINT) AS run_start, CAST(k_minus AS BIGINT) AS run_removed, CAST(k_plus AS BIGINT) AS run_added FROM islands", P, ALL_LINES),
    "align_runs": _q("""
SELECT repo, patch_id, CAST(pos AS BIGINT) AS pos,
       CAST(CASE WHEN in_block THEN i_start + 2 * (j - 1) + CASE WHEN sign = '+' THEN 1 ELSE 0 END ELSE pos END AS BIGINT) AS akey
FROM chg2""", P, ALL_LINES),
    "pair_lines": _q("SELECT repo, patch_id, CAST(ord AS BIGINT) AS ord, old_line, new_line FROM pairs", P, ALL_LINES),
    "balanced_filter": _q("SELECT repo, patch_id, n_minus AS n_removed, n_plus AS n_added, n_minus = n_plus AS balanced FROM pstats", P, ALL_LINES),
    "package_filter": _q("SELECT repo, patch_id, has_pkg AS has_package FROM pstats", P, ALL_LINES),
    "commit_filter": _q("SELECT repo, commit_id FROM commits WHERE n_parents = 1", COMMITS),
    "java_change_filter": _q("SELECT repo, commit_id, ord, a_path FROM changes WHERE is_java AND NOT is_empty", CHANGES),
    "decode_lenient": _q("SELECT repo, commit_id, ord, a_path, raw_text AS text FROM change_text", CHANGES),
    "normalise_newlines": _q("SELECT repo, commit_id, ord, a_path, lf_text AS text FROM change_text", CHANGES),
    "normalise_eof_newline": _q("SELECT repo, commit_id, ord, a_path, fixed_text AS text FROM change_text", CHANGES),
    "assemble_commit_patch": _q("SELECT repo, commit_id, text, n_java FROM assembled", CHANGES),
    "collect_patches": _q("""
SELECT c.repo, c.commit_id, a.text, a.n_java, a.text = '' AS is_empty
FROM commits c JOIN assembled a ON c.repo = a.repo AND c.commit_id = a.commit_id WHERE c.n_parents = 1""", COMMITS, CHANGES),
    "java_sections": _q("SELECT patch_id, cleaned AS text FROM cleaned", COMBINED),
    "clean_patches": _q("""
SELECT patch_id, cleaned, lines_removed,
       CASE WHEN cleaned = '' THEN 'deleted' WHEN lines_removed <> 0 THEN 'trimmed' ELSE 'unchanged' END AS status
FROM audit""", COMBINED),
    "convert_encoding": r"""
SELECT doc_id, charset, CASE WHEN charset = 'ISO-8859-1' AND NOT regexp_matches(text, '[^\x00-\x7F]') THEN 'UTF-8' ELSE charset END AS charset_used,
  NOT (charset = 'UTF-8' OR (charset = 'ISO-8859-1' AND NOT regexp_matches(text, '[^\x00-\x7F]'))) AS converted, true AS restored
FROM (SELECT *, CASE WHEN doc_id % 3 = 0 THEN 'UTF-8' WHEN doc_id % 3 = 1 AND regexp_full_match(text, '(?s)[\x{0}-\x{FF}]*') THEN 'ISO-8859-1' ELSE 'UTF-16LE' END AS charset FROM documents)""",
    "detect_charset": _q("SELECT doc_id, charset, charset AS charset_used, true AS restored FROM cdocs", CHARSETS),
    "clean_patch_bytes": _q("""
SELECT patch_id, charset AS charset_used, cleaned, lines_removed,
       CASE WHEN cleaned = '' THEN 'deleted' WHEN lines_removed <> 0 THEN 'trimmed' ELSE 'unchanged' END AS status
FROM audit JOIN (SELECT CAST(doc_id AS VARCHAR) AS patch_id, charset FROM cdocs) USING (patch_id)""", CHARSETS, COMBINED.replace("FROM documents", "FROM cdocs")),
    "drop_empty_patches": _q("SELECT patch_id FROM cleaned WHERE cleaned <> ''", COMBINED),
    "strip_headers": _q("SELECT patch_id, regexp_extract(text, '(?s)(?:^|\\n)(@@.*)', 1) AS text FROM combined", COMBINED),
    "require_hunk_start": _q("SELECT patch_id, starts_with(cleaned, '@@') AS starts_with_hunk FROM cleaned WHERE cleaned <> ''", COMBINED),
    "load_examples": _q("SELECT path, label, CAST(len(tokens) AS BIGINT) AS n_tokens, array_to_string(tokens, ' ') AS tokens FROM loaded", P, EXAMPLES, LOADED),
    "label_from_path": _q("SELECT path, CASE split_part(path, '/', 2) WHEN 'yes' THEN 1 WHEN 'no' THEN 0 END AS label FROM examples", P, EXAMPLES),
    "standardise_numbers": _q(f"SELECT path, regexp_replace(text, '{NUM}', '1', 'g') AS text FROM examples", P, EXAMPLES),
    "tokenise": _q(f"""
SELECT path, CAST(len(t) AS BIGINT) AS n_tokens, array_to_string(t, ' ') AS tokens
FROM (SELECT path, regexp_extract_all(regexp_replace(text, '{NUM}', '1', 'g'), '{TOKEN}', 1) AS t FROM examples)""", P, EXAMPLES),
    "split_tokens": _q("SELECT path, CAST(len(string_split(array_to_string(tokens, ' '), ' ')) AS BIGINT) AS n_pieces FROM loaded", P, EXAMPLES, LOADED),
    "class_counts": _q("SELECT count(*) FILTER (WHERE label = 1) AS n_yes, count(*) FILTER (WHERE label = 0) AS n_no, count(*) AS n_total FROM loaded", P, EXAMPLES, LOADED),
    "cache_dataset": _q("SELECT count(*) FILTER (WHERE label = 1) AS n_yes, count(*) FILTER (WHERE label = 0) AS n_no, count(*) AS n_total FROM loaded", P, EXAMPLES, LOADED),
    "row_count": _q("SELECT count(*) AS n_rows FROM loaded", P, EXAMPLES, LOADED),
    "max_sequence_length": _q("SELECT CAST(max(len(tokens)) AS BIGINT) AS max_sequence_length FROM loaded", P, EXAMPLES, LOADED),
    "class_filter": _q("SELECT path FROM loaded WHERE label = 1", P, EXAMPLES, LOADED),
    "select_column": _q("SELECT array_to_string(tokens, ' ') AS tokens, label FROM loaded", P, EXAMPLES, LOADED),
    "union_examples": _q("SELECT path, label FROM loaded", P, EXAMPLES, LOADED),
    "sort_paths": _q("SELECT path FROM loaded ORDER BY path", P, EXAMPLES, LOADED),
    "ngrams": _q(f"SELECT path, CAST(len(g) AS BIGINT) AS n_ngrams, md5(array_to_string(g, chr(1))) AS ngrams_md5 FROM (SELECT path, {NGRAMS_EXPR} AS g FROM loaded)", P, EXAMPLES, LOADED),
    "token_frequency": _q("SELECT t AS token, count(*) AS n FROM loaded, unnest(tokens) AS u(t) GROUP BY t", P, EXAMPLES, LOADED),
    "top_k_tokens": _q(f"""
SELECT token, n, rank FROM (
  SELECT token, n, row_number() OVER (ORDER BY n DESC, token) AS rank
  FROM (SELECT t AS token, count(*) AS n FROM (SELECT {NGRAMS_EXPR} AS g FROM loaded), unnest(g) AS u(t) GROUP BY t))
WHERE rank <= 19998""", P, EXAMPLES, LOADED),
    "token_ids": _q("""
SELECT ng.path, md5(array_to_string(coalesce(a.ids, []), ',')) AS ids_md5, CAST(coalesce(len(a.ids), 0) AS BIGINT) AS n_ids,
       coalesce(a.n_unknown, 0) AS n_unknown
FROM ng LEFT JOIN (
  SELECT p.path, list(coalesce(v.id, 1) ORDER BY p.k) AS ids, count(*) FILTER (WHERE v.id IS NULL) AS n_unknown
  FROM (SELECT path, t, k FROM ng, unnest(g) WITH ORDINALITY AS u(t, k)) p
  LEFT JOIN vocab_ids v ON p.t = v.token GROUP BY p.path) a ON a.path = ng.path""", P, EXAMPLES, LOADED, f"""
ng AS (SELECT path, {NGRAMS_EXPR} AS g FROM loaded),
vocab_ids AS (
  SELECT token, rank + 1 AS id FROM (
    SELECT token, row_number() OVER (ORDER BY n DESC, token) AS rank
    FROM (SELECT t AS token, count(*) AS n FROM ng, unnest(g) AS u(t) GROUP BY t))
  WHERE rank <= 19998
)"""),
    "vocabulary_report": _q(f"""
SELECT (SELECT count(DISTINCT t) FROM loaded, unnest(tokens) AS u(t)) AS unigram_vocabulary,
       (SELECT count(DISTINCT t) FROM (SELECT {NGRAMS_EXPR} AS g FROM loaded), unnest(g) AS u(t)) AS bigram_vocabulary,
       (SELECT bool_or(t = chr(10)) FROM loaded, unnest(tokens) AS u(t)) AS has_newline_token,
       (SELECT count(DISTINCT t) FROM loaded, unnest(tokens) AS u(t)
         WHERE length(t) > 1 AND (starts_with(t, chr(10)) OR ends_with(t, chr(10)))) AS glued_newline_tokens""", P, EXAMPLES, LOADED),
    "truncate_line": _q("""
SELECT path, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_lines,
       CAST(len(list_filter(string_split(text, chr(10)), lambda l: length(l) >= 80)) AS BIGINT) AS n_cut
FROM examples""", P, EXAMPLES),
    "seeded_rank": _q("SELECT path, rk AS rank FROM ranked", P, EXAMPLES, LOADED, SPLITS),
    "holdout_take_skip": _q("SELECT path, CASE WHEN rk <= n_all // 10 THEN 'validation' ELSE 'rest' END AS split FROM ranked", P, EXAMPLES, LOADED, SPLITS),
    "balance_classes": _q("SELECT path, label FROM balanced", P, EXAMPLES, LOADED, SPLITS),
    "split_dataset": _q("SELECT path, label, split FROM splits", P, EXAMPLES, LOADED, SPLITS),
    "train_test_split": _q("SELECT path, split FROM splits WHERE split IN ('train', 'test')", P, EXAMPLES, LOADED, SPLITS),
    "confusion_matrix": _q("SELECT label, prediction, count(*) AS n FROM rule_pred GROUP BY ALL", P, EXAMPLES, LOADED, SPLITS),
    "error_rates": _q("""
SELECT count(*) AS n, count(*) FILTER (WHERE label <> prediction) AS n_wrong,
       count(*) FILTER (WHERE label = 0 AND prediction = 1) AS false_positives,
       count(*) FILTER (WHERE label = 1 AND prediction = 0) AS false_negatives,
       1.0 - (count(*) FILTER (WHERE label <> prediction))::DOUBLE / nullif(count(*), 0) AS accuracy,
       (count(*) FILTER (WHERE label = 0 AND prediction = 1))::DOUBLE / nullif(count(*), 0) AS false_positive_rate,
       (count(*) FILTER (WHERE label = 1 AND prediction = 0))::DOUBLE / nullif(count(*), 0) AS false_negative_rate
FROM rule_pred""", P, EXAMPLES, LOADED, SPLITS),
    "sort_errors": _q("SELECT path, label, prediction FROM rule_pred WHERE label <> prediction ORDER BY path", P, EXAMPLES, LOADED, SPLITS),
    "extract_identifiers": _q("SELECT repo, patch_id, word FROM idents", P, VOCAB),
    "extract_short_identifiers": _q(f"""
SELECT DISTINCT p.repo, p.patch_id, w AS word
FROM patches p, unnest(regexp_extract_all(p.text, '{IDENT}', 1)) AS u(w)
WHERE regexp_matches(w, '^[A-Za-z]') AND length(w) <= 10 AND w NOT IN ({KW})""", P),
    "keyword_minus": _q(f"""
SELECT repo, patch_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(list_filter(ws, lambda w: w NOT IN ({KW}))) AS BIGINT) AS n_identifiers
FROM (SELECT repo, patch_id, list_distinct(list_filter(regexp_extract_all(text, '{IDENT}', 1), lambda w: regexp_matches(w, '^[A-Za-z_]'))) AS ws FROM patches)""", P),
    "distinct_words": _q("SELECT DISTINCT word FROM idents", P, VOCAB),
    "build_vocabulary": _q("SELECT word FROM vocab", P, VOCAB),
    "seed_letters_union": _q("SELECT word FROM vocab WHERE length(word) = 1", P, VOCAB),
    "sort_vocabulary": _q("SELECT word FROM vocab ORDER BY word", P, VOCAB),
    "vocabulary_minus": _q("""
SELECT word FROM vocab
WHERE word NOT IN (SELECT i.word FROM idents i JOIN templates t ON i.repo = t.repo AND i.patch_id = t.patch_id)""",
        P, RENAME_LINES, VOCAB, TEMPLATES),
    "exact_dedup": "SELECT min(doc_id) AS doc_id, count(*) AS n_copies FROM documents GROUP BY text",
    "dedup_by_batches": """
SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS batch_no, md5(text) AS text_md5
FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id % 2, doc_id) = 1""",
    "changed_lines": _q(CHANGED_SELECT, VERSIONS, _changed("versions")),
    "line_diff": _q("""
SELECT pair_id, n_kept, n_old - n_kept AS n_removed, n_new - n_kept AS n_added, md5(old) AS old_md5, md5(new) AS new_md5
FROM revisions JOIN lcs USING (pair_id)""", REVISIONS, ALL_SIDES, LCS),
    "moved_lines": _q("""
SELECT pair_id, CAST(n_common - n_kept AS BIGINT) AS n_moved FROM lcs JOIN (
  SELECT pair_id, sum(least(n_a, n_b)) AS n_common
  FROM (SELECT pair_id, l, count(*) AS n_a FROM (SELECT pair_id, unnest(a) AS l FROM sides) GROUP BY ALL)
  JOIN (SELECT pair_id, l, count(*) AS n_b FROM (SELECT pair_id, unnest(b) AS l FROM sides) GROUP BY ALL) USING (pair_id, l)
  GROUP BY pair_id) USING (pair_id)
WHERE n_common > n_kept""", REVISIONS, ALL_SIDES, LCS),
    "unified_hunks": _q(f"""
SELECT pair_id, n_old - n_kept AS n_removed, n_new - n_kept AS n_added, md5({_ended("new")}) AS patched_md5, md5({_ended("old")}) AS undone_md5
FROM revisions JOIN lcs USING (pair_id)""", REVISIONS, ENDED_SIDES, LCS),
    "rediff_changes": _q(f"""
SELECT source AS repo, md5(pair_id) AS commit_id, rediffed, false AS has_marker,
  CASE WHEN rediffed THEN n_old - n_kept END AS n_removed, CASE WHEN rediffed THEN n_new - n_kept END AS n_added,
  CASE WHEN rediffed THEN md5({_ended("new")}) END AS patched_md5
FROM (SELECT *, (old <> '' AND NOT ends_with(old, chr(10))) OR (new <> '' AND NOT ends_with(new, chr(10))) AS rediffed FROM revisions WHERE doc_id % 9 <> 0)
JOIN lcs USING (pair_id)""", REVISIONS, CRLF_SIDES, LCS),
    "synthetic_edits": _q(CHANGED_SELECT, SYNTH, _changed("edits")),
    "select_by_verdict": _q("""
SELECT repo, patch_id, CASE WHEN n_renames = 0 THEN 0 ELSE 1 END AS label FROM verdicts WHERE n_renames <= 2""", P, RENAME_LINES),
    "presumed_negatives": _q("""
SELECT p.repo, p.patch_id FROM patches p
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.repo = p.repo AND v.patch_id = p.patch_id AND v.n_renames BETWEEN 1 AND 2)""", P, RENAME_LINES),
    "size_filter": _q("SELECT repo, patch_id, CAST(strlen(text) AS BIGINT) AS n_bytes FROM patches WHERE strlen(text) <= 5120", P),
    "select_examples": _q("""
SELECT repo, patch_id, CASE WHEN n_renames = 0 THEN 0 ELSE 1 END AS label, 'verdict' AS origin FROM verdicts WHERE n_renames <= 2
UNION ALL
SELECT p.repo, p.patch_id, 0, 'presumed' FROM patches p
WHERE NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.repo = p.repo AND v.patch_id = p.patch_id AND v.n_renames <= 2)""", P, RENAME_LINES),
    "verdict_lines": _q("""
SELECT repo, patch_id || '||' || CASE WHEN n_renames = 0 THEN 'n' WHEN n_renames <= 2 THEN 'y' ELSE 'skip' END
       || coalesce('|' || message, '') AS line FROM verdicts""", P, RENAME_LINES),
}
ORACLES["adapter_patches"] = _q("SELECT repo, patch_id, text, CAST(strlen(text) AS BIGINT) AS n_bytes FROM patches", P)
ORACLES["join_tokens"] = _q("SELECT path, array_to_string(tokens, ' ') AS joined FROM loaded", P, EXAMPLES, LOADED)
ORACLES["limit_n"] = _q("""
SELECT repo, patch_id, 0 AS label FROM (
  SELECT p.repo, p.patch_id, row_number() OVER (PARTITION BY p.repo ORDER BY p.patch_id) AS r
  FROM patches p
  WHERE strlen(p.text) <= 5120
    AND NOT EXISTS (SELECT 1 FROM verdicts v WHERE v.repo = p.repo AND v.patch_id = p.patch_id AND v.n_renames BETWEEN 1 AND 2))
WHERE r <= 20""", P, RENAME_LINES)
ORACLES["load_examples_capped"] = _q("""
SELECT count(*) FILTER (WHERE n_bytes <= 10240 AND starts_with(text, '@@')) AS n_loaded,
       count(*) FILTER (WHERE n_bytes > 10240) AS n_too_large,
       count(*) FILTER (WHERE n_bytes <= 10240 AND NOT starts_with(text, '@@')) AS n_bad_start
FROM examples""", P, EXAMPLES)
ORACLES["stability_check"] = _q("""
SELECT count(*) AS n_rows, CAST(sum(CAST('0x' || substr(md5(path || '|' || split), 1, 12) AS BIGINT)) AS VARCHAR) AS fingerprint, true AS stable
FROM splits""", P, EXAMPLES, LOADED, SPLITS)
ORACLES["accuracy"] = _q("""
SELECT count(*) AS n, count(*) FILTER (WHERE label <> prediction) AS n_wrong,
       1.0 - (count(*) FILTER (WHERE label <> prediction))::DOUBLE / nullif(count(*), 0) AS accuracy
FROM rule_pred""", P, EXAMPLES, LOADED, SPLITS)

# ---- exact pair sampling: vocabulary indexed within letter-shape classes by
# md5('977:vocab:'||word); each draw is folded past the template's own words.
_SHAPE = "CASE WHEN regexp_matches({w}, '^\\p{{Lu}}') THEN 'U' WHEN regexp_matches({w}, '^[\\p{{Ll}}_]') THEN 'L' ELSE 'O' END"
_SKIP = "lambda acc, e: CASE WHEN e <= acc THEN acc + 1 ELSE acc END"
PAIRS = f"""
tpl AS (
  SELECT t.repo, t.patch_id, t.repo || '/' || t.patch_id AS template_id, t.old, t.new,
         {_SHAPE.format(w='t.old')} AS s_old, {_SHAPE.format(w='t.new')} AS s_new
  FROM templates t
),
vidx AS (
  SELECT word, shape, row_number() OVER (PARTITION BY shape ORDER BY md5('977:vocab:' || word), word) - 1 AS idx,
         count(*) OVER (PARTITION BY shape) AS class_size
  FROM (SELECT word, {_SHAPE.format(w='word')} AS shape FROM vocab)
),
csize AS (SELECT DISTINCT shape, class_size FROM vidx),
tex AS (
  SELECT t.template_id, v.shape, list_sort(list(v.idx)) AS excl
  FROM tpl t JOIN idents i ON i.repo = t.repo AND i.patch_id = t.patch_id JOIN vidx v ON v.word = i.word
  GROUP BY t.template_id, v.shape
),
draws1 AS (
  SELECT t.*, c.copy,
         coalesce(eo.excl, []::BIGINT[]) AS excl_old, coalesce(en.excl, []::BIGINT[]) AS excl_new,
         so.class_size - len(coalesce(eo.excl, []::BIGINT[])) AS free_old,
         sn.class_size - len(coalesce(en.excl, []::BIGINT[])) - CASE WHEN t.s_old = t.s_new THEN 1 ELSE 0 END AS free_new
  FROM tpl t CROSS JOIN range(1, 11) AS c(copy)
  LEFT JOIN tex eo ON eo.template_id = t.template_id AND eo.shape = t.s_old
  LEFT JOIN tex en ON en.template_id = t.template_id AND en.shape = t.s_new
  JOIN csize so ON so.shape = t.s_old JOIN csize sn ON sn.shape = t.s_new
),
draws2 AS (
  SELECT *, list_reduce(excl_old, {_SKIP},
           ('0x' || substr(md5('977:' || template_id || ':' || copy || ':old'), 1, 15))::BIGINT % free_old) AS idx_old
  FROM draws1 WHERE free_old > 0 AND free_new > 0
),
draws3 AS (
  SELECT *, list_reduce(CASE WHEN s_old = s_new THEN list_sort(list_append(excl_new, idx_old)) ELSE excl_new END, {_SKIP},
           ('0x' || substr(md5('977:' || template_id || ':' || copy || ':new'), 1, 15))::BIGINT % free_new) AS idx_new
  FROM draws2
),
pairs_drawn AS (
  SELECT d.repo, d.patch_id, d.template_id, d.copy, d.old, d.new, vo.word AS pair_old, vn.word AS pair_new
  FROM draws3 d JOIN vidx vo ON vo.shape = d.s_old AND vo.idx = d.idx_old
                JOIN vidx vn ON vn.shape = d.s_new AND vn.idx = d.idx_new
),
spawned AS (
  SELECT d.repo, d.patch_id || '-' || d.copy AS patch_id, d.template_id, d.copy, d.pair_old, d.pair_new,
    array_to_string(list_transform(string_split(p.text, chr(10)), lambda l:
      CASE substr(l, 1, 1)
        WHEN '-' THEN '-' || array_to_string(list_transform(regexp_extract_all(substr(l, 2), '{WORD}', 1),
                                 lambda w: CASE WHEN w = d.old THEN d.pair_old ELSE w END), '')
        WHEN '+' THEN '+' || array_to_string(list_transform(regexp_extract_all(substr(l, 2), '{WORD}', 1),
                                 lambda w: CASE WHEN w = d.new THEN d.pair_new ELSE w END), '')
        ELSE l END), chr(10)) AS text
  FROM pairs_drawn d JOIN patches p ON p.repo = d.repo AND p.patch_id = d.patch_id
)"""

ORACLES["sample_pairs"] = _q("SELECT template_id, copy, pair_old, pair_new FROM pairs_drawn",
                             P, RENAME_LINES, VOCAB, TEMPLATES, PAIRS)
ORACLES["spawn_patches"] = _q("""
SELECT repo, patch_id, template_id, pair_old, pair_new, CAST(strlen(text) AS BIGINT) AS n_bytes FROM spawned""",
                              P, RENAME_LINES, VOCAB, TEMPLATES, PAIRS)

# ---- the whole chain: merges and files that are no Java go before anything is labelled
MINED = PATCHES.replace("FROM doc_w3\n)", "FROM doc_w3 WHERE doc_id % 9 <> 8 AND doc_id % 10 <> 9\n)")
ORACLES["mined_dataset"] = _q("SELECT path, label, CAST(n_tokens AS BIGINT) AS n_tokens, split FROM splits", MINED, RENAME_LINES, """
judged AS (
  SELECT p.*, CASE WHEN v.n_renames BETWEEN 1 AND 2 THEN 1 ELSE 0 END AS label
  FROM patches p LEFT JOIN verdicts v ON p.repo = v.repo AND p.patch_id = v.patch_id
),
examples AS (
  SELECT repo || '/' || CASE WHEN label = 1 THEN 'yes' ELSE 'no' END || '/' || patch_id || '.diff' AS path,
         CAST(label AS INTEGER) AS label, text, CAST(strlen(text) AS BIGINT) AS n_bytes
  FROM judged
)""", LOADED, SPLITS)

# ---- likeness of runs: the greatest sum over alignments, one removal after the other over a list of sums
ORACLES["pair_similar"] = _q("""
SELECT r.repo, r.patch_id, r.run_start, r.k AS n_removed, r.m AS n_added, r.plain,
       CAST(CASE WHEN r.plain THEN 0 ELSE coalesce(d.best[-1], 0) END AS BIGINT) AS likeness, true AS in_order
FROM runs r LEFT JOIN dp d ON d.repo = r.repo AND d.patch_id = r.patch_id AND d.run_start = r.run_start AND d.i = r.k""", f"""
doc_lines AS (
  SELECT source AS repo, CAST(doc_id AS VARCHAR) AS patch_id, t.l, (t.n - 1 + doc_id) % 7 AS c, t.n
  FROM documents, unnest(list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: l <> '')) WITH ORDINALITY AS t(l, n)
),
made AS (
  SELECT repo, patch_id, n, u.line, u.o
  FROM doc_lines, unnest(CASE c
    WHEN 0 THEN ['-' || l, '+' || l || ' edited'] WHEN 1 THEN ['-' || l] WHEN 2 THEN ['+new ' || l]
    WHEN 3 THEN ['+' || l || '!', '-' || l] WHEN 4 THEN ['-' || l, '+other line', '+' || l || ' again']
    WHEN 5 THEN ['-' || l, '-' || l || ' ' || l] ELSE [' ' || l] END) WITH ORDINALITY AS u(line, o)
),
placed AS (
  SELECT repo, patch_id, row_number() OVER (PARTITION BY repo, patch_id ORDER BY n, o) AS pos, substr(line, 1, 1) AS sign, substr(line, 2) AS line FROM made
),
islands AS (
  SELECT *, pos - row_number() OVER (PARTITION BY repo, patch_id ORDER BY pos) AS island FROM placed WHERE sign IN ('-', '+')
),
numbered AS (
  SELECT *, min(pos) OVER (PARTITION BY repo, patch_id, island) AS run_start,
         row_number() OVER (PARTITION BY repo, patch_id, island, sign ORDER BY pos) AS j,
         list_filter(regexp_extract_all(line, '{WORD}', 1), lambda w: NOT regexp_matches(w, '^[ \t\n\x0B\f\r]$')) AS words
  FROM islands
),
by_place AS (
  SELECT a.repo, a.patch_id, a.run_start, count(*) FILTER (WHERE b.pos = a.pos + 1) AS n_next
  FROM numbered a JOIN numbered b ON a.repo = b.repo AND a.patch_id = b.patch_id AND a.run_start = b.run_start AND a.j = b.j
  WHERE a.sign = '-' AND b.sign = '+' GROUP BY ALL
),
runs AS (
  SELECT n.repo, n.patch_id, n.run_start, count(*) FILTER (WHERE sign = '-') AS k, count(*) FILTER (WHERE sign = '+') AS m,
         coalesce(count(*) FILTER (WHERE sign = '-') = count(*) FILTER (WHERE sign = '+')
           AND (max(pos) FILTER (WHERE sign = '-') < min(pos) FILTER (WHERE sign = '+') OR any_value(p.n_next) = count(*) FILTER (WHERE sign = '-')), false) AS plain
  FROM numbered n LEFT JOIN by_place p ON n.repo = p.repo AND n.patch_id = p.patch_id AND n.run_start = p.run_start GROUP BY ALL
),
counted AS (
  SELECT repo, patch_id, run_start, sign, j, w.word, count(*) AS c FROM numbered, unnest(words) AS w(word) GROUP BY ALL
),
shared AS (
  SELECT o.repo, o.patch_id, o.run_start, o.j AS i, n.j, sum(least(o.c, n.c)) AS c
  FROM counted o JOIN counted n ON o.repo = n.repo AND o.patch_id = n.patch_id AND o.run_start = n.run_start AND o.word = n.word
  WHERE o.sign = '-' AND n.sign = '+' GROUP BY ALL
),
cells AS (
  SELECT o.repo, o.patch_id, o.run_start, o.j AS i, n.j,
         CAST(coalesce(2000 * s.c // greatest(len(o.words) + len(n.words), 1), 0) AS BIGINT) AS w
  FROM numbered o JOIN numbered n ON o.repo = n.repo AND o.patch_id = n.patch_id AND o.run_start = n.run_start
  LEFT JOIN shared s ON s.repo = o.repo AND s.patch_id = o.patch_id AND s.run_start = o.run_start AND s.i = o.j AND s.j = n.j
  WHERE o.sign = '-' AND n.sign = '+'
),
gains AS (
  SELECT repo, patch_id, run_start, i, list(CASE WHEN w >= 500 THEN w ELSE 0 END ORDER BY j) AS g FROM cells GROUP BY ALL
),
dp AS (
  SELECT repo, patch_id, run_start, CAST(0 AS BIGINT) AS i, list_transform(range(m + 1), lambda x: CAST(0 AS BIGINT)) AS best FROM runs
  UNION ALL
  SELECT repo, patch_id, run_start, i, list_transform(range(1, len(cand) + 1), lambda x: list_max(cand[1:x])) FROM (
    SELECT d.repo, d.patch_id, d.run_start, g.i,
           list_transform(range(1, len(d.best) + 1), lambda x: CASE WHEN x = 1 THEN d.best[1] ELSE greatest(d.best[x], d.best[x - 1] + g.g[x - 1]) END) AS cand
    FROM dp d JOIN gains g ON g.repo = d.repo AND g.patch_id = d.patch_id AND g.run_start = d.run_start AND g.i = d.i + 1)
)""")

# ---- what the adapter made each class for tells its verdict
ORACLES["interface_verdicts"] = """
WITH named AS (
  SELECT source AS repo, md5(CAST(doc_id AS VARCHAR)) AS commit_id, CAST(doc_id AS VARCHAR) AS d, doc_id % 6 AS k,
         'do_' || regexp_extract(coalesce(text, ''), '[A-Za-z]+') AS m
  FROM documents
)
SELECT repo, commit_id, 'src/I' || d || '.java' AS path, 'y' AS verdict, CAST(1 AS BIGINT) AS n_renames, CAST(0 AS BIGINT) AS n_caused,
       CASE WHEN k = 4 THEN 'LEAST->MOST' ELSE m || '->' || m || '_r' END AS message, CAST(NULL AS VARCHAR) AS reason
FROM named
UNION ALL
SELECT repo, commit_id, 'src/C' || d || '.java', CASE WHEN k IN (0, 1) THEN 'ignored' ELSE 'y' END, CASE WHEN k IN (0, 1) THEN 0 ELSE 1 END,
       CASE WHEN k IN (0, 1, 3) THEN 1 ELSE 0 END,
       CASE WHEN k IN (0, 1) THEN NULL WHEN k = 3 THEN 'old_v->new_v' ELSE m || '->' || m || '_r' END,
       CASE WHEN k IN (0, 1) THEN 'interface method' END
FROM named"""
