"""The registered corpus queries and the SQL that checks them."""

from __future__ import annotations

from .ann import op9_cross_polytope
from .bpe import op8_byte_bpe
from .langid import op6_language_id
from .lm import op2_lm_scoring
from .packing import op3_best_fit_packing
from .quality import RepetitionRules, op1_quality_rules
from .secrets import op5_secret_scans
from .simhash import op7_simhash
from .substring import op4_substring_dedup
from .suffix import op10_suffix_dedup

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_lm_scoring": op2_lm_scoring,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_secret_scans": op5_secret_scans,
    "op6_language_id": op6_language_id,
    "op7_simhash": op7_simhash,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_cross_polytope": op9_cross_polytope,
    "op10_suffix_dedup": op10_suffix_dedup,
}

#: Windows of 20 words, ranked by where they start; a word is removed if a window
#: that is not the first of its kind covers it.
_OP4 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS i FROM d),
s AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM d)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) > 1 AS again FROM s),
c AS (SELECT w.doc_id, w.i, w.word, coalesce(max(CAST(r.again AS INT)) OVER (PARTITION BY w.doc_id ORDER BY w.i ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.i = w.i),
g AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY i) FILTER (NOT gone), '') AS kept FROM c GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""


#: Words with their place; for each length n the windows, which of them occur twice
#: or more in the document, and which words they cover.
_N = (3, 5, 8, 10)
_WINDOWS = ", ".join(f"CASE WHEN i + {n - 1} <= len(ws) THEN array_to_string(ws[i:i + {n - 1}], ' ') END AS w{n}" for n in _N)
_TWICE = ", ".join(f"CAST(w{n} IS NOT NULL AND count(*) OVER (PARTITION BY rid, w{n}) > 1 AS INT) AS r{n}" for n in _N)
_COVER = ", ".join(f"max(r{n}) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW) = 1 AS c{n}" for n in _N)
_RULES = RepetitionRules()
_OP1 = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents), s AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
w AS (SELECT rid, i, length(ws[i]) AS size, {_WINDOWS} FROM (SELECT rid, ws, unnest(range(1, len(ws) + 1)) AS i FROM s)),
c AS (SELECT rid, size, {_COVER} FROM (SELECT rid, i, size, {_TWICE} FROM w)),
m AS (SELECT rid, count(*) AS n_words, sum(size) AS word_chars, count(*) FILTER (c3) AS n_repeat_words, {", ".join(f"coalesce(sum(size) FILTER (c{n}), 0) AS dup_{n}gram_chars" for n in _N[1:])} FROM c GROUP BY rid),
l AS (SELECT rid, line, length(regexp_replace(line, '[\x20\x09-\x0D]', '', 'g')) AS size, row_number() OVER (PARTITION BY rid, line) > 1 AS again FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM d)),
r AS (SELECT rid, count(*) AS n_dup_lines, sum(size) AS dup_line_chars FROM l WHERE again AND size > 0 GROUP BY rid),
a AS (SELECT doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(dup_line_chars, 0) AS BIGINT) AS dup_line_chars, {", ".join(f"CAST(coalesce(dup_{n}gram_chars, 0) AS BIGINT) AS dup_{n}gram_chars" for n in _N[1:])} FROM d LEFT JOIN m USING (rid) LEFT JOIN r USING (rid))
SELECT *, n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.repeat_words_percent} * n_words AS base_failed,
  NOT (n_words < {_RULES.least_words} OR 100 * n_repeat_words > {_RULES.repeat_words_percent} * n_words) AND dup_line_chars <= {_RULES.most_line_share}::DOUBLE * greatest(word_chars, 1) AND {" AND ".join(f"dup_{n}gram_chars <= {most}::DOUBLE * greatest(word_chars, 1)" for n, most in _RULES.most_ngram_share.items())} AS kept FROM a"""

#: Strings of 50 bytes as 100 hex digits; a byte goes if one covers it that a
#: smaller document holds too.
_OP10 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
s AS (SELECT doc_id, i, hash(substr(h, CAST(2 * i - 1 AS INT), 100)) AS win FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS i FROM d)),
r AS (SELECT s.doc_id, i, s.doc_id > first AS again FROM s JOIN (SELECT win, min(doc_id) AS first FROM s GROUP BY win) USING (win)),
b AS (SELECT doc_id, unnest(range(1, length(h) // 2 + 1)) AS i, unnest(regexp_extract_all(h, '..')) AS byte FROM d),
c AS (SELECT b.doc_id, b.i, byte, coalesce(max(CAST(again AS INT)) OVER (PARTITION BY b.doc_id ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), 0) = 1 AS gone FROM b LEFT JOIN r ON r.doc_id = b.doc_id AND r.i = b.i),
e AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY i), false) AS opens FROM c),
g AS (SELECT doc_id, count(*) AS n_bytes, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, coalesce(string_agg(byte, '' ORDER BY i) FILTER (NOT gone), '') AS kept FROM e GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)"""

#: The others hold approximations, iterations, hashes or patterns that SQL has not;
#: tests/llm compares them with plain versions.
ORACLE_SQL: dict[str, str] = {"op1_quality_rules": _OP1, "op4_substring_dedup": _OP4, "op10_suffix_dedup": _OP10}
