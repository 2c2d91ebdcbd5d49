"""SQL texts that several queries share."""

from __future__ import annotations

import unicodedata

# Fixed values, written apart from the operators: how unicode61 folds.  Marks that are dropped, as ranges of code points;
# other letters that fold to one; and letters that keep their accent.
MARKS = "\\x{0300}-\\x{0304}\\x{0306}-\\x{030c}\\x{030f}\\x{0311}\\x{031b}\\x{0323}-\\x{0328}\\x{032d}\\x{032e}\\x{0330}\\x{0331}"
OTHERS = {0x3C2: 0x3C3, 0xB5: 0x3BC, 0x17F: ord("s"), 0x3D0: 0x3B2, 0x3D1: 0x3B8, 0x3D5: 0x3C6, 0x3D6: 0x3C0, 0x3F0: 0x3BA, 0x3F1: 0x3C1, 0x3F5: 0x3B5}
KEPT = "\u01e1"


def fold(c: str) -> str:
    """By DuckDB's own strip_accents, on Latin letters with accents only, run by run; Greek ones keep theirs."""
    latin = f"list_transform(regexp_extract_all({c}, '[\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]|[^\\x{{00c0}}-\\x{{024f}}\\x{{1e00}}-\\x{{1eff}}]+'), lambda x: {_base('x')})"
    low = f"lower(array_to_string({latin}, ''))"
    return f"regexp_replace(translate({low}, '{''.join(map(chr, OTHERS))}', '{''.join(map(chr, OTHERS.values()))}'), '[{MARKS}]', '', 'g')"


def _base(x: str) -> str:
    """The ASCII letter that an accented one is made of, if there is one."""
    return f"CASE WHEN lower({x}) <> '{KEPT}' AND ascii(strip_accents({x})) < 128 AND length(strip_accents({x})) = 1 THEN strip_accents({x}) ELSE {x} END"


def fold_term(term: str) -> str:
    """The same for one term of a query, by the decomposition of its letters."""
    out = []
    for ch in term.lower():
        parts = unicodedata.normalize("NFD", ch)
        if len(parts) > 1 and parts[0].isascii() and ch != KEPT:
            ch = parts[0]
        out.append(chr(OTHERS.get(ord(ch), ord(ch))))
    return "".join(ch for ch in out if not unicodedata.combining(ch))


LATEST = "SELECT * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY edition_id DESC) AS k FROM editions) WHERE k = 1"
WORKS = f"""SELECT file, split_part(file, '/', 1) AS author_id, split_part(file, '/', 2) AS work_id,
  coalesce(title, '') AS title, coalesce(author, '') AS author FROM ({LATEST})"""


def tokens(c: str) -> str:
    return f"regexp_extract_all({fold(f"coalesce({c}, '')")}, '[\\p{{L}}\\p{{N}}\\p{{Co}}]+')"


POSTINGS = " UNION ALL ".join(
    f"SELECT passage_id, '{c}' AS col, unnest(t) AS term, unnest(range(len(t))) AS pos FROM (SELECT passage_id, {tokens(c)} AS t FROM passages)" for c in ("title", "author", "text")
)
DOCSTATS = f"SELECT passage_id, {' + '.join(f'len({tokens(c)})' for c in ('title', 'author', 'text'))} AS dl FROM passages"


def bm25(phrases: list[list[str]], k: int | None = 50, among: str = "") -> str:
    """Rank, passage and score for phrases of folded tokens."""
    phrases = [[fold_term(t) for t in p] for p in phrases]
    words = sorted({t for p in phrases for t in p})
    hits = []
    for i, p in enumerate(phrases):
        joins = "".join(f" JOIN post p{j} ON p{j}.passage_id = p0.passage_id AND p{j}.col = p0.col AND p{j}.pos = p0.pos + {j} AND p{j}.term = '{t}'" for j, t in enumerate(p) if j)
        hits.append(f"SELECT {i} AS slot, p0.passage_id, count(*) AS f FROM post p0{joins} WHERE p0.term = '{p[0]}' GROUP BY p0.passage_id")
    listed = ", ".join(f"'{w}'" for w in words)
    return f"""WITH post AS (SELECT * FROM ({POSTINGS}) WHERE term IN ({listed})), ds AS ({DOCSTATS}),
 tot AS (SELECT count(*)::DOUBLE AS n, sum(dl)::DOUBLE / count(*) AS avgdl FROM ds),
 hit AS ({" UNION ALL ".join(hits)}),
 df AS (SELECT slot, count(*) AS nh FROM hit GROUP BY slot),
 sc AS (SELECT hit.passage_id, count(*) AS k,
   sum(greatest(ln((n - nh + 0.5) / (nh + 0.5)), 1e-6) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS s
   FROM hit JOIN df USING (slot) JOIN ds USING (passage_id), tot GROUP BY hit.passage_id),
 ok AS (SELECT passage_id, round(s, 10) AS score FROM sc WHERE k = {len(phrases)}{among})
 SELECT row_number() OVER (ORDER BY score DESC, passage_id) AS rn, passage_id, score FROM ok
 ORDER BY score DESC, passage_id{f" LIMIT {k}" if k else ""}"""


# Nested elements by their tags: levels by a running sum, parents by the places of tags; what is not well-formed is told by the
# tags too (pairs by level, entities, attributes twice).
NESTED = r"""WITH e AS (SELECT edition_id, regexp_replace(content, '(?s)<!--.*?-->|<\?.*?\?>|<!\[CDATA\[.*?\]\]>', '', 'g') AS c FROM editions WHERE content <> ''),
 l AS (SELECT edition_id, c, regexp_extract_all(c, '<[^<>]*>') AS l FROM e),
 t AS (SELECT edition_id, contains(c, 'xmlns="http://www.tei-c.org/ns/1.0"') AS plain, unnest(l) AS tag, unnest(range(1, len(l) + 1)) AS pos FROM l),
 p AS (SELECT *, regexp_extract(tag, '^</?([^\s/>]+)', 1) AS qname, regexp_extract(tag, '^</?(?:[^\s/>:]+:)?([^\s/>:]+)', 1) AS name, starts_with(tag, '</') AS closing, ends_with(tag, '/>') AS alone,
  starts_with(qname, 'tei:') OR (NOT contains(qname, ':') AND plain AND NOT contains(tag, 'xmlns=""')) AS tei FROM t),
 d AS (SELECT *, sum(CASE WHEN closing THEN -1 WHEN alone THEN 0 ELSE 1 END) OVER (PARTITION BY edition_id ORDER BY pos) + (closing OR alone)::INT AS level FROM p),
 m AS (SELECT *, lag(qname) OVER w AS opened, lag(closing) OVER w AS after FROM d WHERE NOT alone WINDOW w AS (PARTITION BY edition_id, level ORDER BY pos)),
 bad AS (SELECT edition_id FROM (SELECT edition_id, regexp_extract_all(tag, '\s([^\s="'']+)\s*=\s*["'']', 1) AS a, regexp_replace(tag, '"[^"]*"|''[^'']*''', '""', 'g') AS bare FROM p)
   WHERE len(list_distinct(a)) < len(a) OR regexp_matches(bare, '=\s*[^"\s]') UNION
  SELECT edition_id FROM m WHERE (closing AND (coalesce(after, true) OR opened <> qname)) OR (NOT closing AND NOT coalesce(after, true)) OR level < 1 UNION
  SELECT edition_id FROM m GROUP BY edition_id HAVING sum(CASE WHEN closing THEN -1 ELSE 1 END) <> 0 UNION
  SELECT edition_id FROM l WHERE len(l) = 0 OR regexp_matches(regexp_replace(c, '<[^<>]*>|&(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-fA-F]+);', '', 'g'), '[<&]')),
 s AS (SELECT edition_id, min(pos) FILTER (NOT closing) AS lo, max(pos) FILTER (closing) AS hi FROM d WHERE name = 'text' GROUP BY edition_id), k AS (SELECT d.edition_id, pos, name, level, row_number() OVER (PARTITION BY d.edition_id ORDER BY pos) AS no FROM d JOIN s USING (edition_id)
  WHERE NOT closing AND tei AND name IN ('div', 'l', 'note') AND pos > lo AND pos < hi AND d.edition_id NOT IN (SELECT edition_id FROM bad)),
 z AS (SELECT k.*, coalesce(c.pos, k.pos) AS until FROM k LEFT JOIN LATERAL (SELECT min(pos) AS pos FROM d WHERE d.edition_id = k.edition_id AND d.closing AND d.level = k.level AND d.pos > k.pos AND NOT EXISTS (SELECT 1 FROM d a WHERE a.edition_id = k.edition_id AND a.pos = k.pos AND a.alone)) c ON true)
 SELECT c.edition_id, c.no AS elem_no, coalesce(max(p.no), 0) AS parent_no, c.name AS elem FROM z c LEFT JOIN z p ON p.edition_id = c.edition_id AND p.pos < c.pos AND p.until > c.pos GROUP BY ALL"""


def header(tag: str) -> str:
    """The first text right after a tag of that name that is not blank, up to the header's end."""
    leads = f"regexp_extract_all(regexp_extract(content || '</teiHeader>', '(?s)^.*?</(?:\\w+:)?teiHeader>'), '<(?:\\w+:)?{tag}(?:\\s[^<>]*)?>([^<]*)', 1)"
    plain = "x"
    for entity, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "''"), ("&amp;", "&")):
        plain = f"replace({plain}, '{entity}', '{sign}')"
    strip = f"regexp_replace({plain}, '^[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g')"
    return f"coalesce(list_filter(list_transform({leads}, lambda x: {strip}), lambda x: x <> '')[1], '')"
