"""DuckDB equivalents of the queries of this package, where SQL can express them on whole tables.

Each is the plain definition: inverted joins on words, or on runs of twelve
words, without the operators' filters.
"""

from __future__ import annotations


def _words(c: str) -> str:
    return f"list_filter(regexp_split_to_array({c}, '[ \\n]+'), lambda x: x <> '')"


_SETS = f"""SELECT passage_id, file, w, len(w) AS n FROM
 (SELECT passage_id, file, list_sort(list_distinct({_words("text")})) AS w FROM passages WHERE text IS NOT NULL) WHERE len(w) >= 10"""

P2_FOUND = f"""WITH s AS ({_SETS}), p AS (SELECT passage_id, file, n, unnest(w) AS word FROM s),
 c AS (SELECT a.passage_id AS id_lo, b.passage_id AS id_hi, a.n + b.n AS nn, count(*) AS o FROM p a JOIN p b
  ON a.word = b.word AND a.passage_id < b.passage_id AND a.file <> b.file AND 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) GROUP BY ALL)
 SELECT id_lo, id_hi FROM c WHERE 8 * o >= 3 * nn"""

_P2_LINKED = f"""WITH s AS ({_SETS}), k AS (SELECT w, n, min(passage_id) AS class_id, count(*) AS copies, min(file) AS f0, max(file) AS f1 FROM s GROUP BY w, n),
 p AS (SELECT class_id, n, f0, f1, unnest(w) AS word FROM k),
 c AS (SELECT a.class_id, b.class_id AS other, a.n + b.n AS nn, count(*) AS o FROM p a JOIN p b
  ON a.word = b.word AND a.class_id <> b.class_id AND 5 * least(a.n, b.n) >= 3 * greatest(a.n, b.n) AND (a.f0 <> a.f1 OR b.f0 <> b.f1 OR a.f0 <> b.f0) GROUP BY ALL)"""

P2_CLASSES = f"""{_P2_LINKED}, l AS (SELECT class_id, count(*) AS links FROM c WHERE 8 * o >= 3 * nn GROUP BY class_id)
 SELECT passage_id, class_id, copies, coalesce(links, 0) AS links FROM s JOIN k USING (w, n) LEFT JOIN l USING (class_id)"""

P2_LINKS = f"{_P2_LINKED} SELECT class_id AS class_lo, other AS class_hi FROM c WHERE 8 * o >= 3 * nn AND class_id < other"

P3_FOUND = f"""WITH u AS (SELECT passage_id, file, {_words("text")} AS w FROM passages WHERE text IS NOT NULL),
 g AS (SELECT passage_id, file, k, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT *, unnest(range(1, len(w) - 10)) AS k FROM u WHERE len(w) >= 12)),
 h AS (SELECT passage_id, k FROM g WHERE gram IN (SELECT gram FROM g GROUP BY gram HAVING count(DISTINCT file) > 1)),
 n AS (SELECT *, CASE WHEN k <= lag(k) OVER (PARTITION BY passage_id ORDER BY k) + 12 THEN 0 ELSE 1 END AS new FROM h),
 i AS (SELECT *, sum(new) OVER (PARTITION BY passage_id ORDER BY k) AS stretch FROM n)
 SELECT passage_id, min(k) AS first_word, max(k) + 11 AS last_word FROM i GROUP BY passage_id, stretch"""

P3_SHARES = f"""WITH f AS ({P3_FOUND}), t AS (SELECT passage_id, sum(last_word - first_word + 1) AS shared, count(*) AS stretches FROM f GROUP BY passage_id),
 w AS (SELECT passage_id, len({_words("text")}) AS words FROM passages WHERE text IS NOT NULL)
 SELECT passage_id, words, coalesce(shared, 0) AS shared_words, coalesce(stretches, 0) AS stretches,
  CASE WHEN words > 0 THEN coalesce(shared, 0) / words ELSE 0.0 END AS share FROM w LEFT JOIN t USING (passage_id)"""


def _runs(table: str, id_: str) -> str:
    return f"""SELECT DISTINCT {id_}, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT {id_}, w, unnest(range(1, len(w) - 10)) AS k FROM
 (SELECT {id_}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)"""


# Combining marks that do not part tokens of unicode61.
_JOINING = "\\x{0300}-\\x{0304}\\x{0306}-\\x{030c}\\x{030f}\\x{0311}\\x{031b}\\x{0323}-\\x{0328}\\x{032d}\\x{032e}\\x{0330}\\x{0331}"
_SIZED = f"""SELECT doc_id, greatest(coalesce(n_tokens, len(regexp_extract_all(coalesce(text, ''), '[\\p{{L}}\\p{{N}}\\p{{Co}}][\\p{{L}}\\p{{N}}\\p{{Co}}{_JOINING}]*'))), 0)::BIGINT AS n FROM documents"""
P6_PLACED = f"""SELECT container_kind, capacity, doc_id, k AS piece, (k - 1) * capacity + 1 AS first_token, least(capacity, n - (k - 1) * capacity) AS tokens FROM
 (SELECT *, unnest(range(1, greatest(1, (n + capacity - 1) // capacity) + 1)) AS k FROM ({_SIZED}), containers)"""
P6_FILLED = f"SELECT container_kind, capacity, count(*) AS pieces, sum(tokens) AS tokens, true AS none_too_full, true AS few FROM ({P6_PLACED}) GROUP BY ALL"

P7_FOUND = f"SELECT DISTINCT doc_id, item_id FROM ({_runs('documents', 'doc_id')}) JOIN ({_runs('benchmark', 'item_id')}) USING (gram)"
P7_CLEAN = f"SELECT * FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM ({P7_FOUND}))"

def _places(table: str, id_: str) -> str:
    return f"""SELECT {id_}, k, array_to_string(w[k:k + 11], ' ') AS gram FROM (SELECT {id_}, w, unnest(range(1, len(w) - 10)) AS k FROM
 (SELECT {id_}, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS w FROM {table} WHERE text IS NOT NULL) WHERE len(w) >= 12)"""


# runs of places on one diagonal are one match
P7_LONGEST = f"""WITH m AS (SELECT doc_id, item_id, d.k AS a, i.k AS b FROM ({_places('documents', 'doc_id')}) d JOIN ({_places('benchmark', 'item_id')}) i USING (gram)),
 r AS (SELECT *, a - row_number() OVER (PARTITION BY doc_id, item_id, a - b ORDER BY a) AS run FROM m),
 g AS (SELECT doc_id, item_id, count(*) + 11 AS words, min(a) AS doc_word, min(b) AS item_word FROM r GROUP BY doc_id, item_id, a - b, run)
 SELECT doc_id, item_id, words, doc_word, item_word, matches FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, item_id) AS matches,
  row_number() OVER (PARTITION BY doc_id, item_id ORDER BY words DESC, doc_word, item_word) AS best FROM g) WHERE best = 1"""

SQL: dict[str, str] = {
    "p2_found": P2_FOUND,
    "p2_classes": P2_CLASSES,
    "p2_links": P2_LINKS,
    "p3_found": P3_FOUND,
    "p3_shares": P3_SHARES,
    "p6_placed": P6_PLACED,
    "p6_filled": P6_FILLED,
    "p7_found": P7_FOUND,
    "p7_longest": P7_LONGEST,
    "p7_clean": P7_CLEAN,
}
