"""Registers the queries of all core operators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import catalog, editions, fulltext, links
from ..operators.inlining import TEI, SharedInlining, nested_elements
from ..operators.ordered import OrderedGroups
from ..session import new_folder, written
from ..sources import corpus, sinks
from ..sources.tables import table
from . import oracle, rules
from .pages import Corpus, is_set
from .registry import query

# Catalog


def _works(spark: SparkSession, root: str) -> DataFrame:
    return catalog.works(catalog.latest(table(spark, root, "editions").select("file", "edition_id", "title", "author"), "edition_id"))


@query(oracle.WORKS)
def catalog_works(spark: SparkSession, root: str) -> DataFrame:
    """Author and work ids from paths; of a file delivered again the latest row."""
    return _works(spark, root)


@query(f"""WITH w AS ({oracle.WORKS}), g AS (SELECT *, coalesce(nullif(author, ''), author_id) AS a, string_split(file, '/') AS p,
 lower(coalesce(nullif(title, ''), file)) AS t FROM w)
 SELECT a AS author, arg_min(author_id, p) AS id, count(*) AS n_works, string_agg(file, '|' ORDER BY t, p) AS files FROM g GROUP BY a""")
def author_groups(spark: SparkSession, root: str) -> DataFrame:
    g = catalog.group_by_author(_works(spark, root))
    return g.select("author", "id", "n_works", F.array_join("works.file", "|").alias("files"))


@query(f"""WITH w AS ({oracle.WORKS}), g AS (SELECT *, coalesce(nullif(author, ''), author_id) AS a, string_split(file, '/') AS p,
 lower(coalesce(nullif(title, ''), file)) AS t FROM w)
 SELECT a AS author, first_value(author_id) OVER (PARTITION BY a ORDER BY p) AS id, count(*) OVER (PARTITION BY a) AS n_works,
 row_number() OVER (PARTITION BY a ORDER BY t, p) AS place, file, work_id, title FROM g""")
def author_works(spark: SparkSession, root: str) -> DataFrame:
    return catalog.author_works(_works(spark, root))


@query(f"""SELECT file, row_number() OVER (ORDER BY string_split(file, '/')) AS place, coalesce(nullif(title, ''), work_id) AS shown_title,
 coalesce(nullif(author, ''), author_id) AS shown_author FROM ({oracle.WORKS})""")
def path_order(spark: SparkSession, root: str) -> DataFrame:
    """Works in path order, numbered, with their display names."""
    rows = _works(spark, root).withColumns({"p": T.path_key(F.col("file")), "all": F.lit(0)})
    shown = T.first_filled(F.col("title"), F.col("work_id")).alias("shown_title"), T.first_filled(F.col("author"), F.col("author_id")).alias("shown_author")
    return OrderedGroups(rows, ["all"], ["p"]).numbered().select("file", "place", *shown)


_NAMES = ("Fragmenta", " grc ", "%", "anthologia ficta", "")


@query(" UNION ALL ".join(
    f"SELECT '{q}' AS q, file FROM ({oracle.WORKS}) WHERE trim('{q}') = '' OR contains(lower(title), lower(trim('{q}'))) OR contains(lower(author), lower(trim('{q}'))) OR contains(lower(file), lower(trim('{q}')))"
    for q in _NAMES
))
def name_search(spark: SparkSession, root: str) -> DataFrame:
    works = _works(spark, root)
    found = None
    for q in _NAMES:
        one = catalog.name_search(works, q).select(F.lit(q).alias("q"), "file")
        found = one if found is None else found.unionAll(one)
    return found


@query("""SELECT DISTINCT path, ok FROM (SELECT unnest([file, '../' || file, 'x/../' || file, 'x/../../' || file, '/' || file, './' || file, 'a/..']) AS path,
 unnest([true, false, true, false, false, true, false]) AS ok FROM editions WHERE file IS NOT NULL)""")
def path_guard(spark: SparkSession, root: str) -> DataFrame:
    file = F.col("file")
    paths = F.array(file, F.concat(F.lit("../"), file), F.concat(F.lit("x/../"), file), F.concat(F.lit("x/../../"), file), F.concat(F.lit("/"), file), F.concat(F.lit("./"), file), F.lit("a/.."))
    rows = table(spark, root, "editions").filter(file.isNotNull()).select(F.explode(paths).alias("path")).distinct()
    return rows.select("path", catalog.inside(F.col("path")).alias("ok"))


@query(f"""WITH g AS (SELECT coalesce(nullif(author, ''), author_id) AS author, min(string_split(file, '/')) AS first FROM ({oracle.WORKS}) GROUP BY ALL)
 SELECT row_number() OVER (ORDER BY lower(author), first) AS place, author FROM g""")
def authors_in_order(spark: SparkSession, root: str) -> DataFrame:
    return catalog.numbered_authors(catalog.group_by_author(_works(spark, root))).select("place", "author")


@query(f"SELECT count(DISTINCT coalesce(nullif(author, ''), author_id)) AS n_authors, count(*) AS n_works FROM ({oracle.WORKS})")
def catalog_totals(spark: SparkSession, root: str) -> DataFrame:
    return catalog.totals(_works(spark, root))


# Citation and navigation, on the rows of the index


def _units(spark: SparkSession, root: str) -> DataFrame:
    parts = F.split("ref", r"\.")
    return table(spark, root, "passages").select(
        "passage_id", "file", "tree", "ref", F.size(parts).alias("level"),
        F.when(F.size(parts) > 1, F.array_join(F.slice(parts, 1, F.size(parts) - 1), ".")).alias("parent_ref"), F.col("passage_id").alias("ord"),
    )


_UNITS = """SELECT passage_id, file, tree, ref, len(string_split(ref, '.')) AS level,
 CASE WHEN contains(ref, '.') THEN regexp_replace(ref, '\\.[^.]*$', '') END AS parent_ref, passage_id AS ord FROM passages"""


@query(f"SELECT passage_id, file, tree, ref, level, parent_ref, row_number() OVER (PARTITION BY file, tree ORDER BY ord) AS place FROM ({_UNITS})")
def citation_units(spark: SparkSession, root: str) -> DataFrame:
    return OrderedGroups(_units(spark, root), ["file", "tree"], ["ord"]).numbered().drop("ord")


@query(f"SELECT file, tree, level, count(*) AS n FROM ({_UNITS}) GROUP BY ALL")
def citation_counts(spark: SparkSession, root: str) -> DataFrame:
    return _units(spark, root).groupBy("file", "tree", "level").agg(F.count("*").alias("n"))


@query(f"""SELECT file, tree, ref, level, prev_ref, next_ref FROM (
 SELECT *, row_number() OVER (PARTITION BY file, tree, ref ORDER BY ord) AS k FROM (
  SELECT *, lag(ref) OVER w AS prev_ref, lead(ref) OVER w AS next_ref FROM ({_UNITS}) WINDOW w AS (PARTITION BY file, tree, level ORDER BY ord))) WHERE k = 1""")
def neighbors(spark: SparkSession, root: str) -> DataFrame:
    return editions.neighbours(_units(spark, root))


@query(f"""SELECT c.passage_id, p.passage_id AS parent_id FROM ({_UNITS}) c JOIN (SELECT file, tree, ref, min(passage_id) AS passage_id FROM passages GROUP BY ALL) p
 ON p.file = c.file AND p.tree = c.tree AND p.ref = c.parent_ref""")
def unit_parents(spark: SparkSession, root: str) -> DataFrame:
    u = _units(spark, root)
    first = u.groupBy("file", "tree", F.col("ref").alias("parent_ref")).agg(F.min("passage_id").alias("parent_id"))
    return u.join(first, ["file", "tree", "parent_ref"]).select("passage_id", "parent_id")


@query("""SELECT file, tree, ref, title, author, text, passage_id FROM (SELECT *, row_number() OVER (PARTITION BY file, tree, ref ORDER BY loaded_at DESC, passage_id DESC) AS k
 FROM passages) WHERE k = 1""")
def latest_passages(spark: SparkSession, root: str) -> DataFrame:
    """Each unit once: the delivery that was loaded last."""
    last = F.max_by(F.struct("title", "author", "text", "passage_id"), F.struct("loaded_at", "passage_id")).alias("r")
    return table(spark, root, "passages").groupBy("file", "tree", "ref").agg(last).select("file", "tree", "ref", "r.*")


@query("""SELECT e.file, p.passage_id, p.text FROM (SELECT DISTINCT file FROM editions) e JOIN passages p ON p.file = e.file AND p.tree = 'default' AND p.ref = '1.1'""")
def passage_by_ref(spark: SparkSession, root: str) -> DataFrame:
    """The passage 1.1 of every file."""
    files = table(spark, root, "editions").select("file").distinct()
    return table(spark, root, "passages").filter("tree = 'default' and ref = '1.1'").join(files, "file").select("file", "passage_id", "text")


@query("SELECT passage_id, trim(text) AS text FROM (SELECT passage_id, regexp_replace(text, '^[\\s\\pZ\\x{1c}-\\x{1f}\\x{85}]+|[\\s\\pZ\\x{1c}-\\x{1f}\\x{85}]+$', '', 'g') AS text FROM passages) WHERE length(text) > 0")
def nonempty_passages(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").select("passage_id", T.strip(F.col("text")).alias("text")).filter(F.length("text") > 0)


# Scalars


@query("SELECT passage_id, trim(regexp_replace(text, '[ \\t\\r\\n]+', ' ', 'g'), ' ') AS text FROM passages")
def normalize_space(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").select("passage_id", T.normalize_space(F.col("text")).alias("text"))


@query("SELECT passage_id, " + ", ".join(f"regexp_replace({c}, '^[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g') AS {c}" for c in ("title", "author")) + " FROM passages")
def strip_unicode(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").select("passage_id", T.strip(F.col("title")).alias("title"), T.strip(F.col("author")).alias("author"))


@query("""SELECT item_id, array_to_string(t, ' ') AS terms, len(t) AS n, array_to_string(list_transform(t, lambda x: '"' || x || '"'), ' AND ') AS match
 FROM (SELECT item_id, regexp_extract_all(text, '[\\p{L}\\p{N}_]+') AS t FROM benchmark)""")
def query_terms(spark: SparkSession, root: str) -> DataFrame:
    terms = T.query_terms(F.col("text"))
    return table(spark, root, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms"), F.size(terms).alias("n"), T.match_string(F.col("text")).alias("match"))


@query(f"SELECT passage_id, array_to_string({oracle.tokens('text')}, ' ') AS tokens FROM passages")
def token_fold(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").select("passage_id", F.array_join(T.tokens(F.col("text")), " ").alias("tokens"))


@query(f"SELECT doc_id, len({oracle.tokens('text')}) AS n FROM documents")
def document_tokens(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "documents").select("doc_id", T.token_count(F.col("text")).alias("n"))


_FLAGS = ["1", " TRUE ", "Yes", "on", "0", "false", "", "off", "\t1\n", "oN", "11", "y"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {k in (0, 1, 2, 3, 8, 9)})" for k in range(len(_FLAGS))) + ") AS t(k, on_)")
def flags(spark: SparkSession, root: str) -> DataFrame:
    """What counts as on in the environment."""
    return spark.createDataFrame([(k, is_set(v)) for k, v in enumerate(_FLAGS)], "k int, on_ boolean")


# Links

_DIR = "regexp_replace(catalog_dir || '/' || regexp_replace(filepath, '^(\\./)+', ''), '[^/]+/\\.\\./', '')"
_IDENTIFIERS = f"""WITH t AS (SELECT catalog_dir, catalog_name, {_DIR} AS target, max(identifier) AS identifier
  FROM catalog_entries WHERE identifier <> '' AND filepath <> '' GROUP BY ALL),
 f AS (SELECT DISTINCT file FROM editions WHERE file IS NOT NULL),
 b AS (SELECT target, arg_min(identifier, [-len(string_split(catalog_dir, '/')), CASE catalog_name WHEN 'metadata.xml' THEN 0 ELSE 1 END]) AS identifier,
  arg_min(catalog_dir, [-len(string_split(catalog_dir, '/')), CASE catalog_name WHEN 'metadata.xml' THEN 0 ELSE 1 END]) AS catalog_dir
  FROM t WHERE starts_with(target, catalog_dir || '/') GROUP BY target)
 SELECT file, identifier, catalog_dir FROM f LEFT JOIN b ON target = file"""


def _identifiers(spark: SparkSession, root: str) -> DataFrame:
    return links.identifiers(table(spark, root, "editions"), table(spark, root, "catalog_entries"), F.col("identifier"))


@query(_IDENTIFIERS)
def nearest_identifiers(spark: SparkSession, root: str) -> DataFrame:
    """The identifier of every edition; of two in one catalog the greater."""
    return _identifiers(spark, root)


@query(f"""SELECT passage_id, 'http://dts.test/document/?resource=' || replace(replace(url_encode(identifier), '%20', '+'), '*', '%2A')
 || CASE WHEN ref <> '' THEN '&ref=' || replace(url_encode(ref), '%20', '+') ELSE '' END || CASE WHEN tree <> '' THEN '&tree=' || replace(url_encode(tree), '%20', '+') ELSE '' END AS url
 FROM passages JOIN ({_IDENTIFIERS}) USING (file) WHERE identifier IS NOT NULL""")
def dts_url(spark: SparkSession, root: str) -> DataFrame:
    found = _identifiers(spark, root).filter("identifier is not null")
    url = links.document_url(F.lit("http://dts.test/"), F.col("identifier"), F.col("ref"), F.col("tree"))
    return table(spark, root, "passages").join(found, "file").select("passage_id", url.alias("url"))


@query("""SELECT passage_id, '/passage/' || replace(url_encode(file), '%2F', '/') || CASE WHEN coalesce(ref, '') <> '' OR coalesce(tree, '') <> '' THEN '?' ELSE '' END
 || CASE WHEN ref <> '' THEN 'ref=' || replace(url_encode(ref), '%20', '+') ELSE '' END || CASE WHEN ref <> '' AND tree <> '' THEN '&' ELSE '' END
 || CASE WHEN tree <> '' THEN 'tree=' || replace(url_encode(tree), '%20', '+') ELSE '' END AS url FROM passages""")
def reader_url(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").select("passage_id", links.reader_url(F.col("file"), F.col("ref"), F.col("tree")).alias("url"))


# Full text


@query(f"SELECT term, count(DISTINCT passage_id) AS df, count(*) AS cf FROM ({oracle.POSTINGS}) GROUP BY term")
def term_statistics(spark: SparkSession, root: str) -> DataFrame:
    return fulltext.term_stats(fulltext.postings(table(spark, root, "passages")))


@query(f"SELECT term, passage_id, col, pos FROM ({oracle.POSTINGS})")
def postings(spark: SparkSession, root: str) -> DataFrame:
    return fulltext.postings(table(spark, root, "passages"))


@query(oracle.DOCSTATS)
def document_lengths(spark: SparkSession, root: str) -> DataFrame:
    return fulltext.docstats(table(spark, root, "passages"))


def _ranked(name: str, raw: str, phrases: list[list[str]], k: int | None = 50) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fulltext.ranked(fulltext.Index.over(table(spark, root, "passages")), raw, k or 2**31 - 1)

    run.__name__ = name
    query(oracle.bm25(phrases, k))(run)


_ranked("bm25_single", "ἴπρε", [["ἴπρε"]])
_ranked("bm25_and", "τε καὶ τὸν", [["τε"], ["καὶ"], ["τὸν"]])
_ranked("bm25_cross_column", "anthologia γὰρ", [["anthologia"], ["γὰρ"]])
_ranked("bm25_phrase", "ab_ad et", [["ab", "ad"], ["et"]])
_ranked("bm25_repeated_term", "cum ut cum", [["cum"], ["ut"], ["cum"]])
_ranked("bm25_all_hits", "δὲ", [["δὲ"]], None)


@query(oracle.bm25([["ὡς"], ["ἐν"]], 50, " AND passage_id IN (SELECT passage_id FROM passages WHERE contains(file, '-grc1'))"))
def search_filtered(spark: SparkSession, root: str) -> DataFrame:
    """The best hits among the passages of first Greek editions."""
    p = table(spark, root, "passages")
    return fulltext.ranked(fulltext.Index.over(p), "ὡς ἐν", 50, p.filter(F.contains("file", F.lit("-grc1"))))


@query()
def search_top50(spark: SparkSession, root: str) -> DataFrame:
    """The reference's search: the top 50 with snippets."""
    return fulltext.search(fulltext.Index.over(table(spark, root, "passages")), "τε καὶ", 50)


# The same on a written index

_INDEXES: dict[tuple[str, str], str] = {}


def _index(spark: SparkSession, root: str) -> fulltext.Index:
    """The written index over the passages, built once for a session."""
    key = spark.sparkContext.applicationId, root
    if key not in _INDEXES:
        path = new_folder(spark, "index")
        fulltext.Index.over(table(spark, root, "passages")).write(path)
        _INDEXES[key] = path
    return fulltext.Index.open(spark, _INDEXES[key])


def _indexed(name: str, raw: str, phrases: list[list[str]], k: int | None = 50) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return fulltext.ranked(_index(spark, root), raw, k or 2**31 - 1)

    run.__name__ = name
    query(oracle.bm25(phrases, k))(run)


_indexed("index_single", "ἴπρε", [["ἴπρε"]])
_indexed("index_and", "τε καὶ τὸν", [["τε"], ["καὶ"], ["τὸν"]])
_indexed("index_cross_column", "anthologia γὰρ", [["anthologia"], ["γὰρ"]])
_indexed("index_phrase", "ab_ad et", [["ab", "ad"], ["et"]])
_indexed("index_repeated_term", "cum ut cum", [["cum"], ["ut"], ["cum"]])
_indexed("index_all_hits", "δὲ", [["δὲ"]], None)


@query(f"SELECT term, count(DISTINCT passage_id) AS df, count(*) AS cf FROM ({oracle.POSTINGS}) GROUP BY term")
def index_terms(spark: SparkSession, root: str) -> DataFrame:
    return _index(spark, root).terms.select("term", "df", "cf")


@query(f"SELECT 'δὲ' AS q, count(DISTINCT passage_id) AS hits FROM ({oracle.POSTINGS}) WHERE term = 'δὲ' UNION ALL SELECT '', 0")
def index_hits(spark: SparkSession, root: str) -> DataFrame:
    """How many passages a search finds; without input none."""
    i = _index(spark, root)
    count = lambda q: fulltext.scores(i, q).agg(F.lit(q).alias("q"), F.count("*").alias("hits"))
    return count("δὲ").unionAll(count(""))


_TOKEN = r"[\p{L}\p{N}\p{Co}" + oracle.MARKS + "]+"


@query(f"""WITH h AS (SELECT rn, passage_id FROM ({oracle.bm25([["et"]], None)})),
 t AS (SELECT rn, passage_id, file, ref, regexp_extract_all(text, '{_TOKEN}|[^\\p{{L}}\\p{{N}}\\p{{Co}}{oracle.MARKS}]+') AS parts FROM h JOIN passages USING (passage_id) WHERE len({oracle.tokens("text")}) <= 12)
 SELECT rn, passage_id, file, ref, array_to_string(list_transform(parts, lambda x: CASE WHEN {oracle.fold("x")} = 'et' THEN '<mark>' || x || '</mark>' ELSE x END), '') AS snippet FROM t""")
def index_snippets(spark: SparkSession, root: str) -> DataFrame:
    """Hits and their snippets, of texts that are no longer than one."""
    found = fulltext.search(_index(spark, root), "et", 2**31 - 1)
    short = table(spark, root, "passages").filter(T.token_count(F.col("text")) <= 12).select("passage_id")
    return found.join(short, "passage_id", "left_semi").select("rn", "passage_id", "file", "ref", "snippet")


@query()
def index_search(spark: SparkSession, root: str) -> DataFrame:
    """The reader's search, on the written index: the top 50 with snippets."""
    return fulltext.search(_index(spark, root), "τε καὶ", 50)


# Export and reports


@query("""SELECT passage_id, to_json({'file': file, 'tree': tree, 'ref': ref, 'title': coalesce(title, ''), 'author': coalesce(author, ''), 'text': text})::VARCHAR AS value
 FROM passages WHERE text <> ''""")
def jsonl_rows(spark: SparkSession, root: str) -> DataFrame:
    p = table(spark, root, "passages").filter("text <> ''").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "author")})
    return p.select("passage_id", F.to_json(F.struct(*sinks.JSONL)).alias("value"))


@query("""SELECT file, string_agg(reason, '; ' ORDER BY first, reason) AS reasons, count(*) AS n FROM
 (SELECT file, reason, min(seen_at) AS first FROM skip_report GROUP BY file, reason) GROUP BY file""")
def skip_reasons(spark: SparkSession, root: str) -> DataFrame:
    """Each file's reasons in the order in which they were first seen."""
    each = table(spark, root, "skip_report").groupBy("file", "reason").agg(F.min("seen_at").alias("first"))
    sorted_ = F.array_sort(F.collect_list(F.struct("first", "reason")))
    return each.groupBy("file").agg(F.array_join(F.transform(sorted_, lambda x: x["reason"]), "; ").alias("reasons"), F.count("*").alias("n"))


@query("SELECT tree, count(DISTINCT file) AS n_docs, count(*) AS n_passages, count(DISTINCT ref) AS n_refs FROM passages GROUP BY tree")
def index_summary(spark: SparkSession, root: str) -> DataFrame:
    return table(spark, root, "passages").groupBy("tree").agg(F.countDistinct("file").alias("n_docs"), F.count("*").alias("n_passages"), F.countDistinct("ref").alias("n_refs"))


# Files: written by the sinks, read by the sources


def _latest(spark: SparkSession, root: str) -> DataFrame:
    return catalog.latest(table(spark, root, "editions").select("file", "edition_id", "content"), "edition_id").filter("content is not null")


@query(f"""SELECT file, split_part(file, '/', 1) AS author_id, split_part(file, '/', 2) AS work_id, md5(content) AS content FROM ({oracle.LATEST})
 WHERE content <> '' AND regexp_matches(file, '-(grc|lat)[^/]*\\.xml$')""")
def edition_scan(spark: SparkSession, root: str) -> DataFrame:
    """Editions written as files, found and read again."""
    folder = new_folder(spark, "corpus")
    sinks.write_files(_latest(spark, root), folder)
    return corpus.scan_editions(spark, folder).select("file", "author_id", "work_id", F.md5("content").alias("content"))


@query(_IDENTIFIERS)
def catalog_files(spark: SparkSession, root: str) -> DataFrame:
    """Catalogs written as files, found, parsed and joined; of two identifiers for one file the last wins."""
    escaped = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    attribute = lambda c: F.coalesce(F.concat(F.lit(f' {c}="'), escaped(c), F.lit('"')), F.lit(""))
    entry = F.concat(F.lit("<resource"), attribute("identifier"), attribute("filepath"), F.lit("><title>"), F.coalesce(escaped("title"), F.lit("")), F.lit("</title></resource>"))
    entries = table(spark, root, "catalog_entries").select(F.concat_ws("/", "catalog_dir", "catalog_name").alias("file"), F.struct("identifier", "filepath", entry.alias("xml")).alias("e"))
    files = entries.groupBy("file").agg(F.array_sort(F.collect_list("e")).alias("e"))
    content = F.concat(F.lit("<collection>"), F.array_join(F.transform("e", lambda e: e["xml"]), ""), F.lit("</collection>"))
    folder = new_folder(spark, "catalogs")
    sinks.write_files(files.select("file", content.alias("content")), folder)
    return links.identifiers(table(spark, root, "editions"), corpus.scan_catalogs(spark, folder), F.col("ord"))


@query("SELECT to_json({'file': file, 'tree': tree, 'ref': ref, 'title': coalesce(title, ''), 'author': coalesce(author, ''), 'text': text})::VARCHAR AS value FROM passages WHERE text <> ''")
def jsonl_file(spark: SparkSession, root: str) -> DataFrame:
    folder = new_folder(spark, "jsonl")
    sinks.write_jsonl(table(spark, root, "passages").filter("text <> ''").withColumns({c: F.coalesce(F.col(c), F.lit("")) for c in ("title", "author")}), folder)
    return spark.read.text(folder)


@query("SELECT DISTINCT file, reason FROM skip_report")
def skip_report_file(spark: SparkSession, root: str) -> DataFrame:
    folder = new_folder(spark, "skipped")
    sinks.write_skip_report(table(spark, root, "skip_report").select("file", "reason").distinct(), folder)
    return spark.read.option("sep", "\t").option("header", True).csv(folder, schema="file string, reason string")


# Editions: XML to tables.  SQL has no XML; these are tested against independent parsers.


@query(f"SELECT edition_id, file, {oracle.header('title')} AS title, {oracle.header('author')} AS author FROM editions")
def edition_headers(spark: SparkSession, root: str) -> DataFrame:
    return editions.headers(table(spark, root, "editions").select("edition_id", "file", "content")).drop("content")


@query()
def node_table(spark: SparkSession, root: str) -> DataFrame:
    rows = editions.nodes(table(spark, root, "editions").withColumn("key", F.concat_ws("#", "file", "edition_id")), "key")
    return rows.withColumn("attrs", F.to_json("attrs"))


@query()
def cite_rules(spark: SparkSession, root: str) -> DataFrame:
    return editions.cite_rules(table(spark, root, "editions"))


@query()
def edition_units(spark: SparkSession, root: str) -> DataFrame:
    return editions.units(table(spark, root, "editions"))


@query()
def index_rows(spark: SparkSession, root: str) -> DataFrame:
    """Passages and rejects of all editions, as they go into the index."""
    return editions.index_rows(table(spark, root, "editions"))


@query()
def index_counters(spark: SparkSession, root: str) -> DataFrame:
    return editions.counters(editions.index_rows(table(spark, root, "editions")))


@query()
def reject_report(spark: SparkSession, root: str) -> DataFrame:
    return editions.rejects(editions.index_rows(table(spark, root, "editions")))


@query()
def passages_html(spark: SparkSession, root: str) -> DataFrame:
    return editions.passages(editions.index_rows(table(spark, root, "editions"), mode="html"))


@query()
def whole_works(spark: SparkSession, root: str) -> DataFrame:
    e = table(spark, root, "editions")
    return e.select("edition_id", editions.rendered(F.col("content"), "text").alias("text"), editions.rendered(F.col("content")).alias("html"))


@query()
def unit_string_values(spark: SparkSession, root: str) -> DataFrame:
    e = catalog.latest(table(spark, root, "editions").select("file", "edition_id", "content"), "edition_id")
    return editions.unit_texts(editions.nodes(e), editions.units(e))


# Round trips: TEI made of documents, through parser, citation and rendering, back to what SQL knows

_HEADER = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><fileDesc><titleStmt><title>T</title><author>A</author></titleStmt></fileDesc><encodingDesc><refsDecl>\
<citeStructure match="/TEI/text/body/div[@type='d']" use="@n" unit="d"><citeStructure match="l" use="@n" unit="l" delim="."/></citeStructure></refsDecl></encodingDesc></teiHeader><text><body><div type="d" n="1">"""


def _tei(spark: SparkSession, root: str, before: str = "", after: str = "") -> DataFrame:
    """A TEI edition of each document, a line of verse for each of its lines."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(text, "\n"), lambda x, i: F.concat(F.lit('<l n="'), (i + 1).cast("string"), F.lit(f'">{before}'), x, F.lit(f"{after}</l>\n")))
    content = F.concat(F.lit(_HEADER), F.array_join(lines, ""), F.lit("</div></body></text></TEI>"))
    return table(spark, root, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("file"), content.alias("content"))


_LINES = "SELECT doc_id::VARCHAR AS file, unnest(l) AS line, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)"
_NORMAL = "trim(regexp_replace({}, '[ \\t\\r\\n]+', ' ', 'g'), ' ')"
_STRIPPED = "regexp_replace({}, '^[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+|[\\s\\pZ\\x{{1c}}-\\x{{1f}}\\x{{85}}]+$', '', 'g')"


@query(f"""WITH l AS (SELECT file, n, {_NORMAL.format("line")} AS t FROM ({_LINES})),
 u AS (SELECT file, '1.' || n AS ref, t AS text FROM l UNION ALL SELECT file, '1', string_agg(t, chr(10) ORDER BY n) FROM l GROUP BY file)
 SELECT file, 'default' AS tree, ref, 'T' AS title, 'A' AS author, {_STRIPPED.format("text")} AS text FROM u WHERE {_STRIPPED.format("text")} <> ''""")
def tei_roundtrip(spark: SparkSession, root: str) -> DataFrame:
    return editions.passages(editions.index_rows(_tei(spark, root))).select("file", "tree", "ref", "title", "author", "text")


_BEFORE = '<label>A</label><choice><sic>no</sic><corr>B</corr></choice><note>no</note><abbr>no</abbr> '
_AFTER = '<pb n="1"/><del>C</del><gap/>D<figure>no</figure>'


@query(f"""SELECT file, '1.' || n AS ref, {_NORMAL.format("'A' || chr(10) || 'B ' || line || ' C D'")} AS text FROM ({_LINES})""")
def tei_markup_text(spark: SparkSession, root: str) -> DataFrame:
    """Labels, choices, notes, milestones, gaps and figures around every line."""
    rows = editions.passages(editions.index_rows(_tei(spark, root, _BEFORE, _AFTER)))
    return rows.filter("level = 2").select("file", "ref", "text")


@query(f"""SELECT file, '1.' || n AS ref, '<section class="tei-div" data-type="d" data-n="1"><span class="tei-ref-n">1</span><div class="tei-l" data-n="' || n || '"><span class="tei-lineno">' || n
 || '</span><span class="tei-l-text"><strong class="tei-hi">x</strong>'
 || replace(replace(replace(replace(line, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(160), '&nbsp;') || '</span></div></section>' AS html FROM ({_LINES})""")
def tei_html(spark: SparkSession, root: str) -> DataFrame:
    rows = editions.passages(editions.index_rows(_tei(spark, root, '<hi rend="bold">x</hi>'), mode="html"))
    return rows.filter("level = 2").select("file", "ref", F.col("text").alias("html"))


# Each rendering rule, around texts of the benchmark

_QUOTED = lambda t: "'" + t.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
_CASES = ", ".join(f"({_QUOTED(rule)}, {_QUOTED(html)}, {_QUOTED(text)})" for rule, _, html, text in rules.fragments())
_X = "trim(regexp_replace(text, '[\\s\\pZ]+', ' ', 'g'))"


def _rules(spark: SparkSession, root: str) -> DataFrame:
    x = F.trim(F.regexp_replace("text", r"[\s\p{Z}]+", " "))
    escaped = F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    cases = F.explode(F.array(*(F.struct(F.lit(rule).alias("rule"), F.lit(xml).alias("xml")) for rule, xml, _, _ in rules.fragments()))).alias("c")
    items = table(spark, root, "benchmark").filter(F.col("text").isNotNull()).select("item_id", escaped.alias("x"), cases)
    return items.select("item_id", "c.rule", F.replace(F.col("c.xml"), F.lit("{x}"), F.col("x")).alias("xml"))


@query(f"""SELECT item_id, rule, replace(replace(html, '{{x}}', replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')), '{{a}}', replace(replace(x, '&', '&amp;'), '"', '&quot;')) AS html
 FROM (SELECT item_id, {_X} AS x FROM benchmark WHERE text IS NOT NULL), (VALUES {_CASES}) AS c(rule, html, txt)""")
def rules_html(spark: SparkSession, root: str) -> DataFrame:
    return _rules(spark, root).select("item_id", "rule", editions.rendered(F.col("xml")).alias("html"))


@query(f"SELECT item_id, rule, replace(txt, '{{x}}', x) AS text FROM (SELECT item_id, {_X} AS x FROM benchmark WHERE text IS NOT NULL), (VALUES {_CASES}) AS c(rule, html, txt)")
def rules_text(spark: SparkSession, root: str) -> DataFrame:
    return _rules(spark, root).select("item_id", "rule", editions.rendered(F.col("xml"), "text").alias("text"))


# Citation trees, rejects, counters, headers and nodes of generated editions

_TWO = (
    """<refsDecl n="lines"><citeStructure match="/TEI/text/body/div[@type='d']" use="@n" unit="d"><citeStructure match="l" use="@n" unit="l" delim="."/></citeStructure></refsDecl>"""
    """<refsDecl n="flat" default="true"><citeStructure match="/TEI/text/body//l" use="@n" unit="line"/></refsDecl>"""
)


def _two_trees(spark: SparkSession, root: str) -> DataFrame:
    return _tei(spark, root).withColumn("content", F.regexp_replace("content", "<refsDecl>.*?</refsDecl>", _TWO.replace("$", r"\$")))


@query("""SELECT doc_id::VARCHAR AS file, t.* FROM documents, (VALUES ('lines', 0, 0, 1, '/TEI/text/body/div[@type=''d'']', '@n', 'd', NULL), ('lines', 0, 0, 2, 'l', '@n', 'l', '.'),
 ('flat', 1, 1, 1, '/TEI/text/body//l', '@n', 'line', NULL)) AS t(tree, tree_ord, is_default, level, match, use, unit, delim) WHERE text IS NOT NULL""")
def tei_trees(spark: SparkSession, root: str) -> DataFrame:
    """Two trees of rules in each edition, the second one the default."""
    return editions.cite_rules(_two_trees(spark, root))


@query(f"""SELECT file, 'lines' AS tree, 0 AS tree_ord, 1 AS ord, 1 AS level, 'd' AS cite_type, '1' AS ref, NULL AS parent_ref FROM ({_LINES}) WHERE n = 1
 UNION ALL SELECT file, 'lines', 0, n + 1, 2, 'l', '1.' || n, '1' FROM ({_LINES}) UNION ALL SELECT file, 'flat', 1, n, 1, 'line', n::VARCHAR, NULL FROM ({_LINES})""")
def tei_units(spark: SparkSession, root: str) -> DataFrame:
    return editions.units(_two_trees(spark, root)).select("file", "tree", "tree_ord", "ord", "level", "cite_type", "ref", "parent_ref")


def _broken(spark: SparkSession, root: str) -> DataFrame:
    """Of four editions one without its end, one whose tree can't be followed, an empty one, and a good one."""
    k, content = F.col("file").cast("long") % 4, F.col("content")
    bad = F.when(k == 0, F.replace(content, F.lit("</TEI>"), F.lit(""))).when(k == 1, F.replace(content, F.lit(' delim="."'), F.lit(""))).when(k == 2, F.lit(""))
    return _tei(spark, root).withColumn("content", F.coalesce(bad, content))


@query("""SELECT doc_id::VARCHAR AS file, ['open failed: XMLSyntaxError: no element found', 'tree ''default'': CiteError: no delimiter', 'open failed: XMLSyntaxError: document is empty'][doc_id % 4 + 1] AS reason
 FROM documents WHERE text IS NOT NULL AND doc_id % 4 < 3""")
def tei_rejects(spark: SparkSession, root: str) -> DataFrame:
    return editions.rejects(editions.index_rows(_broken(spark, root)))


@query(f"""WITH l AS (SELECT file, n, {_NORMAL.format("line")} AS t FROM ({_LINES}) WHERE file::BIGINT % 4 = 3),
 u AS (SELECT file, t AS text FROM l UNION ALL SELECT file, string_agg(t, chr(10) ORDER BY n) FROM l GROUP BY file), g AS (SELECT file FROM u WHERE {_STRIPPED.format("text")} <> '')
 SELECT (SELECT count(DISTINCT file) FROM g) AS n_docs, (SELECT count(*) FROM g) AS n_passages, (SELECT count(*) FROM documents WHERE text IS NOT NULL AND doc_id % 4 < 3) AS n_skipped""")
def tei_counters(spark: SparkSession, root: str) -> DataFrame:
    return editions.counters(editions.index_rows(_broken(spark, root)))


@query("SELECT edition_id, " + ", ".join(f"coalesce({_STRIPPED.format(c)}, '') AS {c}" for c in ("title", "author")) + " FROM editions")
def tei_headers(spark: SparkSession, root: str) -> DataFrame:
    """Titles and authors put into headers, after others that are blank, and read again."""
    escaped = lambda c: F.coalesce(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(""))
    parts = '<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title> </title><author/><title>', escaped("title"), "</title><author>", escaped("author"), "</author></teiHeader><text><title>no</title></text></TEI>"
    content = F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    return editions.headers(table(spark, root, "editions").select("edition_id", content.alias("content"))).select("edition_id", "title", "author")


@query(f"""WITH l AS (SELECT file, n, line, (line <> '')::INT AS has, 1 + n + coalesce(sum((line <> '')::INT) OVER (PARTITION BY file ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM ({_LINES}))
 SELECT file, 1 AS pre, max(pre + has) AS post, 0 AS level, 0 AS parent, 'elem' AS kind, 'urn:r' AS ns, 'r' AS tag, NULL AS txt FROM l GROUP BY file
 UNION ALL SELECT file, pre, pre + has, 1, 1, 'elem', 'urn:o', 'a', NULL FROM l UNION ALL SELECT file, pre + 1, pre + 1, 2, pre, 'text', NULL, NULL, line FROM l WHERE has = 1""")
def tei_nodes(spark: SparkSession, root: str) -> DataFrame:
    """A record with an element for each line, of another namespace, under a prefix."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    lines = F.transform(F.split(text, "\n"), lambda x: F.concat(F.lit("<o:a>"), x, F.lit("</o:a>")))
    content = F.concat(F.lit('<r xmlns="urn:r" xmlns:o="urn:o">'), F.array_join(lines, ""), F.lit("</r>"))
    records = table(spark, root, "documents").filter(F.col("text").isNotNull()).select(F.col("doc_id").cast("string").alias("file"), content.alias("content"))
    return editions.nodes(records).select("file", "pre", "post", "level", "parent", "kind", "ns", "tag", "txt")


@query(f"""SELECT file, 'default' AS tree, '1.' || n AS ref, line AS text FROM ({_LINES}) WHERE line <> '' UNION ALL SELECT file, 'default', '1', string_agg(line || chr(10), '' ORDER BY n) FROM ({_LINES}) GROUP BY file""")
def tei_strings(spark: SparkSession, root: str) -> DataFrame:
    """String values of units, by the interval join of units and text nodes."""
    e = _tei(spark, root)
    return editions.unit_texts(editions.nodes(e), editions.units(e)).select("file", "tree", "ref", "text")


# The pages of the reader, over a corpus of generated editions

_CORPORA: dict[tuple[str, str], str] = {}
_PAGE = "docs/w{0}/d{0}-lat1.xml"


def _corpus(spark: SparkSession, root: str) -> Corpus:
    key = spark.sparkContext.applicationId, root
    if key not in _CORPORA:
        folder = new_folder(spark, "pages")
        name = F.concat(F.lit("docs/w"), F.col("file"), F.lit("/d"), F.col("file"), F.lit("-lat1.xml"))
        sinks.write_files(_tei(spark, root).withColumn("file", name), folder)
        catalog_file = spark.createDataFrame([("docs/w7/metadata.xml", f'<collection><resource identifier="urn:x:7" filepath="{_PAGE.format(7).rpartition("/")[2]}"/></collection>')], "file string, content string")
        sinks.write_files(catalog_file, folder)
        _CORPORA[key] = folder
    return Corpus(spark, _CORPORA[key], dts_base="http://dts.test/")


_AS_PAGE = "'docs/w' || doc_id || '/d' || doc_id || '-lat1.xml'"


@query(f"SELECT 'A' AS author, 'docs' AS id, count(*) OVER () AS n_works, row_number() OVER (ORDER BY string_split({_AS_PAGE}, '/')) AS place, {_AS_PAGE} AS file, 'w' || doc_id AS work_id, 'T' AS title FROM documents WHERE text IS NOT NULL")
def page_home(spark: SparkSession, root: str) -> DataFrame:
    c = _corpus(spark, root)
    try:
        return written(c.home()[0], "page-home")
    finally:
        c.close()


@query(f"""SELECT '{_PAGE.format(7)}' AS file, 'T' AS title, 'A' AS author, 'default' AS tree, 1 AS is_default, 1 AS ord, 1 AS level, 'd' AS cite_type, '1' AS ref FROM documents WHERE doc_id = 7 AND text IS NOT NULL
 UNION ALL SELECT '{_PAGE.format(7)}', 'T', 'A', 'default', 1, n + 1, 2, 'l', '1.' || n FROM ({_LINES}) WHERE file = '7'""")
def page_document(spark: SparkSession, root: str) -> DataFrame:
    return _corpus(spark, root).document(_PAGE.format(7))


@query(f"""WITH l AS (SELECT *, max(n) OVER (PARTITION BY file) AS last FROM ({_LINES}) WHERE file IN ('7', '8'))
 SELECT 'docs/w' || file || '/d' || file || '-lat1.xml' AS file, 'default' AS tree, '1.1' AS ref, {_NORMAL.format("line")} || chr(10) || chr(10) AS body, CASE file WHEN '7' THEN 'urn:x:7' END AS identifier,
 CASE file WHEN '7' THEN 'http://dts.test/document/?resource=urn%3Ax%3A7&ref=1.1' END AS url, NULL AS prev_ref, CASE WHEN last > 1 THEN '1.2' END AS next_ref FROM l WHERE n = 1""")
def page_passage(spark: SparkSession, root: str) -> DataFrame:
    """A passage of two works, one of which is in a catalog; and none of names that lead out of the corpus, or of no ref."""
    c = _corpus(spark, root)
    asked = [(_PAGE.format(7), "1.1"), (_PAGE.format(8), "1.1"), (_PAGE.format(7), "9"), (f"../pages/{_PAGE.format(7)}", "1.1"), ("docs/w7/metadata.xml", "1.1")]
    return reduce(DataFrame.unionAll, (c.passage(file, ref, mode="text") for file, ref in asked))


# Nested records


@query(oracle.NESTED)
def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return nested_elements(table(spark, root, "editions"))


@query()
def p5_schema(spark: SparkSession, root: str) -> DataFrame:
    return SharedInlining(table(spark, root, "editions")).schema()


@query()
def p5_rows(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all tables, also those between a div, l or note and the next one."""
    rows = SharedInlining(table(spark, root, "editions"), asked=("div", "l", "note")).rows(fields=True)
    return rows.withColumn("fields", F.to_json("fields"))


def _p5_table(name: str) -> None:
    def run(spark: SparkSession, root: str) -> DataFrame:
        return SharedInlining(table(spark, root, "editions"), asked=("div", "l", "note")).table(name)

    run.__name__ = f"p5_{name}"
    query()(run)


for _name in ("div", "l", "note"):
    _p5_table(_name)


@query(oracle.NESTED)
def p5_links(spark: SparkSession, root: str) -> DataFrame:
    """The three tables' rows with their numbers and links, as they are found."""
    s = SharedInlining(table(spark, root, "editions"), asked=("div", "l", "note"))
    rows = (s.table(name).select("edition_id", "elem_no", "parent_no", F.lit(name).alias("elem")) for name in ("div", "l", "note"))
    return reduce(DataFrame.unionAll, rows)


@query(f"""WITH l AS ({_LINES}), n AS (SELECT file::BIGINT AS doc_id, n, line, 1 + n + (n + 2) // 4 AS no FROM l)
 SELECT doc_id, 1 AS elem_no, 0 AS parent_no, 'div' AS elem, 1 AS row_no, 0 AS parent_row_no, NULL AS text FROM n WHERE n = 1
 UNION ALL SELECT doc_id, no, 1, 'l', no + (n + 2) // 4 + (n % 4 = 1)::INT, CASE WHEN n % 4 = 1 THEN no + (n + 2) // 4 ELSE 1 END, line FROM n
 UNION ALL SELECT doc_id, no + 1, no, 'note', no + (n + 2) // 4 + 2, no + (n + 2) // 4 + 1, 'x' FROM n WHERE n % 4 = 1""")
def p5_generated(spark: SparkSession, root: str) -> DataFrame:
    """Nested records made of documents: of every four lines the first is in a group and has a note."""
    text = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    line = lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("<lg><l>"), x, F.lit("<note>x</note></l></lg>"))).otherwise(F.concat(F.lit("<l>"), x, F.lit("</l>")))
    content = F.concat(F.lit(f'<TEI xmlns="{TEI}"><text><body><div>'), F.array_join(F.transform(F.split(text, "\n"), line), ""), F.lit("</div></body></text></TEI>"))
    records = table(spark, root, "documents").filter(F.col("text").isNotNull()).select("doc_id", content.alias("content"))
    rows = SharedInlining(records, "doc_id", asked=("div", "l", "note")).rows(fields=True).filter("elem_no is not null")
    return rows.select("doc_id", "elem_no", "parent_no", "elem", "row_no", "parent_row_no", F.when(F.col("elem") != "div", F.col("text")).alias("text"))
