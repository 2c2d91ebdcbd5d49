"""Full-text search against SQLite's FTS5, the index behind the reference's search."""

import sqlite3

import pytest

from scriptorium.functions.text import input_terms
from scriptorium.operators import fulltext as FT

ROWS = [
    (1, "Titulus", "Auctor", "alpha beta. gamma alpha; delta"),
    (2, "alpha", None, "gamma nihil aliud"),
    (3, None, "Café", "ΒΑΣΣΑΡΙΚΆ βασσαρικά ς σ ß ss ἐ̣π̣ὶ ἐπὶ Ǡ ǡ ſ µ"),
    (4, "", "", ""),
    (5, "x", "y", None),
    (6, "Longum", "Z", " ".join(f"w{k}{'.' if k % 7 == 0 else ''}" for k in range(60)) + " alpha foo bar " + " ".join(f"v{k}" for k in range(40)) + " foo bar alpha"),
    (7, "Longum", "Z", "foo_bar x² 3.5 d’Arc [ab]c a\xadb"),
    (8, "alpha", "alpha", "alpha alpha alpha"),
    (9, "t", "a", "One two: three alpha four five six seven eight nine ten eleven twelve thirteen fourteen. beta fifteen"),
    (9, "t", "a", "repeated id alpha"),
]
QUERIES = ["alpha", "alpha gamma", "alpha alpha", "foo_bar", "foo bar alpha", "_", "", "alpha _", "Café", "cafe AUCTOR", "βασσαρικά", "σ", "ss", "ἐ̣π̣ὶ", "ἐπὶ", "x²", "3.5", "a OR b*", "w7 v3", "beta fifteen", "ab", "ǡ", "s μ"]
SCHEMA = "passage_id long, file string, tree string, ref string, title string, author string, text string"


@pytest.fixture(scope="module")
def both(spark):
    rows = [(i, f"f{i}", "default", str(i), t, a, x) for i, t, a, x in ROWS if x != "repeated id alpha"]
    c = sqlite3.connect(":memory:")
    c.execute("CREATE VIRTUAL TABLE p USING fts5(file UNINDEXED, tree UNINDEXED, ref UNINDEXED, title, author, text, tokenize='unicode61 remove_diacritics 2')")
    c.executemany("INSERT INTO p(rowid, file, tree, ref, title, author, text) VALUES (?, ?, ?, ?, ?, ?, ?)", rows)
    return c, FT.Index.over(spark.createDataFrame(rows, SCHEMA)), {r[0]: r[6] for r in rows}


@pytest.mark.parametrize("raw", QUERIES)
def test_same_as_fts5(both, raw):
    sqlite, index, texts = both
    match = " AND ".join(f'"{t}"' for t in input_terms(raw))
    want = sqlite.execute("SELECT rowid, -rank, snippet(p, 5, '<mark>', '</mark>', ' … ', 12) FROM p WHERE p MATCH ?", (match,)).fetchall() if match else []
    got = {r.passage_id: r.score for r in FT.scores(index, raw).collect()}
    assert set(got) == {r[0] for r in want}
    for rowid, score, snip in want:
        assert got[rowid] == pytest.approx(score, abs=1e-9)
        assert FT.snippet(texts[rowid], FT.phrases_of(raw)) == (snip or "")


def test_top_k_order_and_columns(both):
    _, index, _ = both
    rows = FT.search(index, "alpha", 3).collect()
    assert [r.rn for r in rows] == [1, 2, 3] and rows[0].passage_id == 8
    assert rows[0].score >= rows[1].score >= rows[2].score
    assert FT.search(index, "alpha", 3).columns == ["rn", "passage_id", "file", "tree", "ref", "title", "author", "snippet", "score"]


def test_empty_table(both):
    _, index, _ = both
    empty = FT.Index.over(index.passages.limit(0))
    assert FT.search(empty, "alpha").count() == 0 and FT.term_stats(empty.postings).count() == 0


def test_repeated_rows_are_rows(spark):
    rows = spark.createDataFrame([(1, "f", "d", "1", "t", "a", "alpha")] * 2, SCHEMA)
    assert FT.docstats(rows).count() == 2 and FT.postings(rows).filter("term = 'alpha'").count() == 2


def test_written_index_reads_the_buckets_of_its_terms(spark, both, tmp_path):
    _, index, _ = both
    index.write(str(tmp_path))
    opened = FT.Index.open(spark, str(tmp_path))
    assert (opened.total, opened.length) == (index.total, index.length)
    plan = opened.of_terms(["alpha"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "bucket" in plan.split("PartitionFilters")[1][:120]
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,alpha)]" in plan or "In(term" in plan
    assert dict(map(tuple, FT.scores(opened, "alpha").collect())) == pytest.approx(dict(map(tuple, FT.scores(index, "alpha").collect())))
