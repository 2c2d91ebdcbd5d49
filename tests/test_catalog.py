"""Catalog, links, scalars, and order within groups of any size."""

import itertools
from urllib.parse import quote, urlencode

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import catalog, links
from scriptorium.operators.ordered import OrderedGroups

WORKS = [
    ("b2/w1/x-grc1.xml", "Zeta", "Homer"),
    ("a1/w1/y-grc1.xml", "", "Homer"),
    ("a1/w2/z-lat1.xml", "alpha", "Homer"),
    ("a1-x/w/q-lat1.xml", "Beta 100%", ""),
    ("solo-lat1.xml", None, None),
]


@pytest.fixture(scope="module")
def works(spark):
    return catalog.works(spark.createDataFrame(WORKS, "file string, title string, author string"))


def test_ids(works):
    got = {r.file: (r.author_id, r.work_id, r.title) for r in works.collect()}
    assert got["a1/w1/y-grc1.xml"] == ("a1", "w1", "")
    assert got["solo-lat1.xml"] == ("solo-lat1.xml", "", "")


def test_groups(works):
    groups = catalog.ordered_authors(catalog.group_by_author(works)).collect()
    assert [(g.author, g.id, g.n_works) for g in groups] == [("a1-x", "a1-x", 1), ("Homer", "a1", 3), ("solo-lat1.xml", "solo-lat1.xml", 1)]
    assert [w.file for w in groups[1].works] == ["a1/w1/y-grc1.xml", "a1/w2/z-lat1.xml", "b2/w1/x-grc1.xml"]  # an empty title sorts by file
    flat = catalog.author_works(works).filter("author = 'Homer'").orderBy("place").collect()
    assert [r.file for r in flat] == [w.file for w in groups[1].works]


@pytest.mark.parametrize(("q", "n"), [("", 5), (" \xa0", 5), ("HOMER", 3), ("grc", 2), ("%", 1), ("_", 0), ("zeta", 1)])
def test_name_search(works, q, n):
    assert catalog.name_search(works, q).count() == n


@pytest.mark.parametrize(("path", "ok"), [("a/b", True), ("../a", False), ("a/../b", True), ("a/../../b", False), ("/a", False), ("./a", True), ("", False), ("a/..", False), ("a//b", True), ("..", False)])
def test_paths(spark, path, ok):
    assert spark.range(1).select(catalog.inside(F.lit(path))).first()[0] is ok


def test_null_path(spark):
    assert spark.range(1).select(catalog.inside(F.lit(None).cast("string"))).first()[0] is False


ENTRIES = [
    ("urn:far", "", "metadata.xml", "a/b/f.xml", 1),
    ("urn:mid", "a", "__cts__.xml", "./b/f.xml", 2),
    ("urn:mid-old", "a", "metadata.xml", "b/../b/f.xml", 3),
    ("urn:mid-new", "a", "metadata.xml", "b/f.xml", 4),
    ("urn:other", "a/b", "metadata.xml", "g.xml", 5),  # nearer, but does not contain the file
    ("urn:side", "c", "metadata.xml", "../a/b/f.xml", 6),  # contains it, but is not above
    ("", "a/b", "metadata.xml", "f.xml", 7),
    (None, "a/b", "metadata.xml", "f.xml", 8),
]
ENTRY = "identifier string, catalog_dir string, catalog_name string, filepath string, ord int"


def test_nearest_catalog_that_contains(spark):
    files = spark.createDataFrame([("a/b/f.xml",), ("a/b/f.xml",), ("a/b/h.xml",), (None,)], "file string")
    got = {r.file: r.identifier for r in links.identifiers(files, spark.createDataFrame(ENTRIES, ENTRY), F.col("ord")).collect()}
    assert got == {"a/b/f.xml": "urn:mid-new", "a/b/h.xml": None}
    assert links.identifiers(files, spark.createDataFrame([], ENTRY)).filter("identifier is not null").count() == 0


@settings(max_examples=30, deadline=None)
@given(st.lists(st.text(max_size=12).filter(lambda s: s.isprintable()), min_size=3, max_size=3))
def test_urls(spark, parts):
    ident, ref, tree = parts
    params = {"resource": ident} | ({"ref": ref} if ref else {}) | ({"tree": tree} if tree else {})
    row = spark.createDataFrame([(ident, ref, tree)], "i string, r string, t string")
    got = row.select(links.document_url(F.lit("http://d.test/"), F.col("i"), F.col("r"), F.col("t"))).first()[0]
    assert got == f"http://d.test/document/?{urlencode(params)}"


def test_url_of_nulls(spark):
    row = spark.range(1).select(links.document_url(F.lit("b"), F.lit("x"), F.lit(None).cast("string"), F.lit("")), links.document_url(F.lit("b"), F.lit(None).cast("string"), F.lit("1"), F.lit("")))
    assert tuple(row.first()) == ("b/document/?resource=x", None)


def test_scalars(spark):
    s = spark.createDataFrame([("\xa0  a b \x1c\x85",)], "s string")
    assert s.select(T.strip(F.col("s"))).first()[0] == "a b"
    assert s.select(T.normalize_space(F.lit(" \t a\xa0 \r\n b "))).first()[0] == "a\xa0 b"
    assert s.select(T.quote_path(F.lit("a b/c+é~*"))).first()[0] == quote("a b/c+é~*")
    assert s.select(T.match_string(F.lit('a OR "b*"'))).first()[0] == '"a" AND "OR" AND "b"'


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.characters(codec="utf-8", max_codepoint=0x24F) | st.sampled_from("αάὰσςΣἐ̣̓ὶ"), max_size=40))
def test_tokens_in_the_jvm_and_on_the_driver(spark, s):
    got = spark.createDataFrame([(s,)], "s string").select(T.tokens(F.col("s"))).first()[0]
    assert got == [w for w, _, _ in T.token_spans(s)]


def test_order_within_a_large_group(spark):
    """One group of nearly all rows, spread over several partitions."""
    rows = spark.range(20_000).select(F.when(F.col("id") % 50 == 0, F.col("id") % 7).otherwise(99).alias("g"), (F.col("id") * 7919 % 20_011).alias("o")).repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        groups = OrderedGroups(rows, ["g"], ["o"])
        assert groups.rows.filter("g = 99").select("_part").distinct().count() > 3
        numbered = groups.numbered().orderBy("g", "o").collect()
        linked = groups.with_neighbours("o", "p", "n").orderBy("g", "o").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for _, g in itertools.groupby(numbered, lambda r: r.g):
        assert [r.place for r in g] == list(range(1, 1 + sum(r.g == _ for r in numbered)))
    for _, g in itertools.groupby(linked, lambda r: r.g):
        o = list(g)
        assert [r.p for r in o] == [None, *(r.o for r in o[:-1])] and [r.n for r in o] == [*(r.o for r in o[1:]), None]


def test_order_of_nulls_and_nothing(spark):
    rows = spark.createDataFrame([(None, 1), (None, 2), ("a", None)], "g string, o int")
    assert sorted(r.place for r in OrderedGroups(rows, ["g"], ["o"]).numbered().collect()) == [1, 1, 2]
    assert OrderedGroups(rows.limit(0), ["g"], ["o"]).numbered().count() == 0


@pytest.mark.parametrize("path", ["a", "a/b", "", ".", "..", "../a", "a/..", "a/../b", "a/../../b", "/a", "./a", "a//b", "a/./../.."])
def test_guard_on_the_driver_is_the_same(spark, path):
    assert catalog.leads_inside(path) == spark.range(1).select(catalog.inside(F.lit(path))).first()[0]


def test_totals_and_order(spark):
    rows = [("b/w/x", "b", "w", "", "Zeta"), ("a/w/x", "a", "w", "T", ""), ("c/w/x", "c", "w", "", "zeta"), ("c/v/x", "c", "v", "", "Zeta")]
    df = spark.createDataFrame(rows, "file string, author_id string, work_id string, title string, author string")
    assert tuple(catalog.totals(df).first()) == (3, 4) and tuple(catalog.totals(df.limit(0)).first()) == (0, 0)
    assert [r.file for r in catalog.in_order(catalog.author_works(df)).collect()] == ["a/w/x", "b/w/x", "c/v/x", "c/w/x"]
    assert [r.author for r in catalog.numbered_authors(catalog.group_by_author(df)).orderBy("place").collect()] == ["a", "Zeta", "zeta"]
