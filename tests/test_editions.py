"""Editions as tables, sources, sinks, streaming and the command line, on a small corpus of our own."""

import csv
import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from scriptorium import cli, session
from scriptorium.operators import editions as E
from scriptorium.operators.fulltext import Index, ranked, search
from scriptorium.plans.pages import Corpus
from scriptorium.session import written
from scriptorium.sources import corpus, sinks
from scriptorium.streaming import incremental

NS = 'xmlns="http://www.tei-c.org/ns/1.0"'
RULES = """<encodingDesc><refsDecl><citeStructure match="/TEI/text/body/div[@type='fragment']" use="@n" unit="fragment">\
<citeStructure match="l" use="@n" unit="l" delim="."/></citeStructure></refsDecl></encodingDesc>"""


def edition(title, author, fragments, rules=RULES):
    body = "".join(f'<div type="fragment" n="{n}">' + "".join(f'<l n="{k}">{line}</l>' for k, line in enumerate(lines, 1)) + "</div>" for n, lines in fragments)
    return f"<TEI {NS}><teiHeader><fileDesc><titleStmt><title>{title}</title><author>{author}</author></titleStmt></fileDesc>{rules}</teiHeader><text><body>{body}</body></text></TEI>"


VERSE = edition("Bassarica", "Dion", [("3", ["ἐ̣π̣ὶ γαῖαν ἔβη", "λινοτειχέα Γάζον"]), ("4", ["τεῖχος <note>no</note>ἐέργει", "arma café"]), ("5a", ["ultima linea", " "])])


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus") / "data"
    for path, content in {
        "aut1/w1/aut1.w1.x-grc1.xml": VERSE,
        "aut1/w2/aut1.w2.x-lat1.xml": edition("", "", [("1", ["unus versus"])]),
        "aut2/w1/aut2.w1.x-grc1.xml": VERSE.replace("</text>", ""),
        "aut2/w2/aut2.w2.x-lat2.xml": edition("Bad rules", "Dion", [("1", ["a"])], RULES.replace("div[@type='fragment']", "div[last()]")),
        "aut2/w1/notes.xml": "<x/>",
        "aut1/metadata.xml": '<collection><!-- c --><resource identifier="urn:x:far" filepath="./w1/aut1.w1.x-grc1.xml"><title>B</title></resource><resource identifier="" filepath="w2/aut1.w2.x-lat1.xml"/></collection>',
        "aut1/w1/__cts__.xml": '<collection><resource identifier="urn:x:old" filepath="aut1.w1.x-grc1.xml"/><resource identifier="urn:x:near" filepath="aut1.w1.x-grc1.xml"/></collection>',
        "aut2/metadata.xml": "<collection><resource",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(content, encoding="utf-8")
    return str(root)


def test_scan_and_headers(spark, root):
    works = {r.file: r for r in corpus.with_headers(corpus.scan_editions(spark, root)).collect()}
    assert sorted(works) == ["aut1/w1/aut1.w1.x-grc1.xml", "aut1/w2/aut1.w2.x-lat1.xml", "aut2/w1/aut2.w1.x-grc1.xml", "aut2/w2/aut2.w2.x-lat2.xml"]
    w = works["aut1/w1/aut1.w1.x-grc1.xml"]
    assert (w.author_id, w.work_id, w.title, w.author) == ("aut1", "w1", "Bassarica", "Dion")
    assert works["aut2/w1/aut2.w1.x-grc1.xml"].title == "Bassarica"  # kept though the file is malformed


def test_catalogs(spark, root):
    found = {(r.catalog_dir, r.catalog_name, r.identifier) for r in corpus.scan_catalogs(spark, root).collect()}
    assert found == {("aut1", "metadata.xml", "urn:x:far"), ("aut1", "metadata.xml", ""), ("aut1/w1", "__cts__.xml", "urn:x:old"), ("aut1/w1", "__cts__.xml", "urn:x:near")}


def test_one_file_is_opened_alone(spark, root):
    name = "aut1/w1/aut1.w1.x-grc1.xml"
    one = corpus.open_edition(spark, root, name)
    assert [p.rpartition("/data/")[2] for p in one.inputFiles()] == [name]
    assert [tuple(r) for r in one.drop("content").collect()] == [(name, "aut1", "w1")]
    assert one.collect() == corpus.scan_editions(spark, root).filter(F.col("file") == name).collect()
    for other in ("../data/" + name, "/" + name, "", "aut1", "aut1/metadata.xml", "aut2/w1/notes.xml", "x-grc1.xml", "aut1/w1/*-grc1.xml"):
        assert corpus.open_edition(spark, root, other).count() == 0
    near = corpus.catalogs_above(spark, root, name).collect()
    assert {(r.catalog_dir, r.catalog_name) for r in near} == {("aut1", "metadata.xml"), ("aut1/w1", "__cts__.xml")}
    assert corpus.catalogs_above(spark, root, "../x").count() == 0


def test_written_files_are_read_again(spark, tmp_path):
    rows = [("a/b/[x] {1}-grc1.xml", VERSE), ("a/b/y-lat1.xml", "x"), ("a/b/empty-lat1.xml", ""), ("../z-lat1.xml", "x"), ("a/n-lat1.xml", None), (None, "x")]
    assert sinks.write_files(spark.createDataFrame(rows, "file string, content string"), str(tmp_path / "c")) == 3
    found = corpus.scan_editions(spark, str(tmp_path / "c")).collect()  # a file without a byte is not seen
    assert sorted((r.file, bytes(r.content).decode()) for r in found) == [("a/b/[x] {1}-grc1.xml", VERSE), ("a/b/y-lat1.xml", "x")]
    assert corpus.open_edition(spark, str(tmp_path / "c"), "a/b/[x] {1}-grc1.xml").count() == 1
    assert not (tmp_path / "z-lat1.xml").exists()


def test_shared_folder(spark):
    """Off one machine a folder must be named; tables can be deleted once they are no longer needed."""

    class Cluster:
        class conf:
            get = staticmethod(lambda k, d=None: d)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: type("C", (), {"get": staticmethod(lambda k: None)}))
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        session.shared_folder(Cluster)
    df = written(spark.range(3), "t")
    assert df.count() == 3 and session.clean(spark) > 0 and session.clean(spark) == 0
    assert not any(glob.glob(f.removeprefix("file:")) for f in df.inputFiles())


def test_no_catalogs(spark, tmp_path):
    assert corpus.scan_catalogs(spark, str(tmp_path)).count() == 0


def test_index_rows(spark, root):
    rows = written(E.index_rows(corpus.scan_editions(spark, root)), "t")
    got = [(r.ref, r.text, r.title) for r in E.passages(rows).filter("author_id is null" if "author_id" in rows.columns else "file like 'aut1/w1%'").orderBy("ord").collect()]
    assert got == [
        ("3", "ἐ̣π̣ὶ γαῖαν ἔβη\nλινοτειχέα Γάζον", "Bassarica"), ("3.1", "ἐ̣π̣ὶ γαῖαν ἔβη", "Bassarica"), ("3.2", "λινοτειχέα Γάζον", "Bassarica"),
        ("4", "τεῖχος ἐέργει\narma café", "Bassarica"), ("4.1", "τεῖχος ἐέργει", "Bassarica"), ("4.2", "arma café", "Bassarica"),
        ("5a", "ultima linea", "Bassarica"), ("5a.1", "ultima linea", "Bassarica"),  # 5a.2 has no text
    ]
    reasons = {r.file: r.reason for r in E.rejects(rows).collect()}
    assert reasons["aut2/w1/aut2.w1.x-grc1.xml"].startswith("open failed: XMLSyntaxError: ")
    assert reasons["aut2/w2/aut2.w2.x-lat2.xml"].startswith("tree 'default': CiteError: ")
    assert tuple(E.counters(rows).first()) == (2, 10, 2)


def test_neighbours(spark, root):
    n = {r.ref: (r.prev_ref, r.next_ref) for r in E.neighbours(E.units(corpus.scan_editions(spark, root)).filter("file like 'aut1/w1%' and reason is null")).collect()}
    assert n["4"] == ("3", "5a") and n["3"] == (None, "4") and n["3.2"] == ("3.1", "4.1") and n["5a.2"] == ("5a.1", None)


def test_passages(spark, root):
    found = corpus.scan_editions(spark, root)
    name = "aut1/w1/aut1.w1.x-grc1.xml"
    assert 'data-n="4"' in E.passage(found, name, "4").first().body
    assert E.passage(found, name, "4.2", mode="text").first().body.strip() == "arma café"
    assert E.passage(found, name, "99").count() == 0
    assert E.passage(found, name, "4", "nope").count() == 0
    assert E.passage(found, "../etc/passwd", "1").count() == 0
    assert E.passage(found, name).first().body.count("<section") == 3


def test_nodes_and_string_values(spark, root):
    found = corpus.scan_editions(spark, root)
    nodes = E.nodes(found).filter("file like 'aut1/w1%'")
    assert nodes.filter("tag = 'l'").count() == 6
    values = {r.ref: r.text for r in E.unit_texts(nodes, E.units(found)).collect()}
    assert values["4"] == "τεῖχος noἐέργειarma café"


def test_same_whatever_the_partitions(spark, root):
    """As many documents in one task or each in its own: the same rows."""
    found = corpus.scan_editions(spark, root)
    one, many = (sorted(map(tuple, E.index_rows(found.repartition(n)).collect()), key=repr) for n in (1, 8))
    assert one == many


@pytest.fixture(scope="module")
def index(spark, root, tmp_path_factory):
    out = tmp_path_factory.mktemp("index")
    built = sinks.build_index(corpus.scan_editions(spark, root), f"{out}/db", f"{out}/rows")
    return out, built


def test_build(spark, index):
    out, built = index
    assert (built.n_docs, built.n_passages, built.n_skipped) == (2, 10, 2)
    lines = [json.loads(line) for p in (out / "rows").glob("part*") for line in p.read_text(encoding="utf-8").splitlines()]
    assert len(lines) == 10 and list(lines[0]) == ["file", "tree", "ref", "title", "author", "text"]
    assert any("Γάζον" in p.read_text(encoding="utf-8") for p in (out / "rows").glob("part*"))
    report = next((out / "db.skipped.tsv").glob("part*"))
    with report.open(encoding="utf-8", newline="") as f:
        found = list(csv.reader(f, delimiter="\t"))
    assert found[0] == ["file", "reason"] and len(found) == 3


def test_clean_run_leaves_no_report(spark, tmp_path):
    good = spark.createDataFrame([("a/b-grc1.xml", VERSE)], "file string, content string")
    report = tmp_path / "db.skipped.tsv"
    report.mkdir()
    (report / "old").write_text("x")
    assert sinks.build_index(good, str(tmp_path / "db")).n_skipped == 0
    assert not report.exists()


def test_search_written_index(spark, index):
    out, _ = index
    i = Index.open(spark, f"{out}/db")
    hits = search(i, "Γάζον").collect()
    assert [h.ref for h in hits] == ["3.2", "3"] and "<mark>Γάζον</mark>" in hits[0].snippet
    assert search(i, "cafe").count() == 2  # Latin accents fold
    assert search(i, "γαιαν").count() == 0  # Greek accents don't
    assert search(i, "ἐ̣π̣ὶ").count() == 0 and search(i, "ἐπὶ").count() == 2  # marks part terms, not tokens
    assert search(i, "").count() == search(i, "_").count() == search(i, "aut1").count() == 0
    assert search(i, "Bassarica arma").count() == 2  # terms in different columns


def test_missing_index(spark, tmp_path):
    assert Index.open(spark, str(tmp_path / "none")) is None


def test_stream(spark, root, tmp_path):
    stream = incremental.edition_stream(spark, root, files_per_batch=2)
    for _ in range(2):  # the second run finds nothing new
        incremental.index_stream(stream, str(tmp_path / "db"), str(tmp_path / "check"), once=True).awaitTermination()
    i = incremental.open_stream_index(spark, str(tmp_path / "db"))
    assert i.passages.count() == 10 and i.total == 10
    assert [h.ref for h in search(i, "Γάζον").collect()] == ["3.2", "3"]


def test_a_file_delivered_again_counts_once(spark, tmp_path):
    name = "a/w/a.w.x-grc1.xml"
    for k, lines in enumerate((["vetus versus", "alter"], ["novus versus"])):
        sinks.write_files(spark.createDataFrame([(name, edition("T", "A", [("1", lines)]))], "file string, content string"), str(tmp_path / f"in{k}"))
        stream = incremental.edition_stream(spark, str(tmp_path / f"in{k}"))
        batch = stream.withColumn("file", F.lit(name))
        incremental.index_stream(batch, str(tmp_path / "db"), str(tmp_path / f"check{k}"), once=True).awaitTermination()
        for old in (tmp_path / "db").glob("*/batch=0"):  # each stream counts its batches from 0
            old.rename(old.with_name(f"batch={7 + k}"))
    i = incremental.open_stream_index(spark, str(tmp_path / "db"))
    assert (i.total, search(i, "vetus").count(), search(i, "versus").count()) == (2, 0, 2)
    assert incremental.compact(spark, str(tmp_path / "db"), str(tmp_path / "whole"))
    assert search(Index.open(spark, str(tmp_path / "whole")), "novus").count() == 2


def test_a_query_reads_its_terms_and_its_hits_only(spark, index):
    out, _ = index
    i = Index.open(spark, f"{out}/db")
    plan = ranked(i, "Γάζον")._jdf.queryExecution().executedPlan().toString()
    assert "bucket" in plan.partition("PartitionFilters: [")[2].partition("]")[0] and "docstats" not in plan
    assert "In(passage_id" in i.looked_up([1, 2])._jdf.queryExecution().executedPlan().toString()
    assert i.document_frequencies(["γάζον", "none"]) == {"γάζον": 2, "none": 0}


def test_command_line(spark, root, index, capsys):
    out, _ = index
    run = lambda *a: (cli.main(list(a)), capsys.readouterr().out)[1]
    name = "aut1/w1/aut1.w1.x-grc1.xml"
    assert "Dion (aut1): 2" in run("catalog", "--root", root) or "Dion (aut1): 3" in run("catalog", "--root", root)
    assert run("reffs", "--root", root, "--file", name).splitlines()[:2] == ["3\tfragment", "  3.1\tl"]
    assert run("neighbors", "--root", root, "--file", name, "--ref", "4").strip() == "3\t5a"
    page = run("passage", "--root", root, "--file", name, "--ref", "4")
    assert "tei-l" in page and "resource=urn%3Ax%3Anear&ref=4" in page
    assert run("passage", "--root", root, "--file", name, "--ref", "9").strip() == "not found"
    assert "<mark>Γάζον</mark>" in run("search", "--db", f"{out}/db", "Γάζον")


def test_edge_cases(spark):
    rows = [(None, VERSE), ("f", None), ("g", ""), ("h", VERSE), ("h", VERSE), ("long", edition("t", "a", [("1", ["verbum " * 200_000])]))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "file string, content string, text string")
    got = E.index_rows(df).groupBy("file").count().collect()
    assert {r.file: r["count"] for r in got} == {None: 8, "f": 1, "g": 1, "h": 16, "long": 2}
    assert E.index_rows(df.limit(0)).count() == E.neighbours(E.units(df.limit(0))).count() == E.headers(df.limit(0)).count() == 0


def test_random_documents_cite_each_line_once(spark):
    random.seed(1)
    docs = [(f"d{k}", edition("t", "a", [(str(n), [f"w{random.random()}" for _ in range(random.randint(1, 5))]) for n in range(random.randint(0, 9))])) for k in range(60)]
    found = E.passages(E.index_rows(spark.createDataFrame(docs, "file string, content string")))
    assert found.filter("level = 2").count() == sum(d.count("<l ") for _, d in docs)
    assert found.count() == found.select("file", "ref").distinct().count()


def test_pages(spark, root, index):
    out, _ = index
    c = Corpus(spark, root, f"{out}/db", "http://dts.test/", fulltext=True)
    name = "aut1/w1/aut1.w1.x-grc1.xml"
    authors, hits = c.home("  ")
    assert hits is None and authors.count() == 4
    authors, hits = c.home("Γάζον")
    assert authors.count() == 0 and hits.count() == 2
    assert "InMemoryTableScan" in c.home("dion")[0]._jdf.queryExecution().optimizedPlan().toString() + c.works._jdf.queryExecution().executedPlan().toString()
    assert [r.ref for r in c.document(name).orderBy("ord").collect()][:3] == ["3", "3.1", "3.2"]
    p = c.passage(name, "4").first()
    assert (p.identifier, p.prev_ref, p.next_ref) == ("urn:x:near", "3", "5a")
    assert p.url == "http://dts.test/document/?resource=urn%3Ax%3Anear&ref=4" and "tei-l" in p.body
    whole = c.passage(name).first()
    assert whole.ref is None and whole.prev_ref is None and whole.url.endswith("near")
    assert c.passage("../etc/passwd", "1").count() == c.passage(name, "x").count() == c.passage(name, "4", "no").count() == 0
    c.close()
    assert Corpus(spark, root, str(out / "none"), fulltext=True).home("Γάζον")[1] is None
    assert Corpus(spark, root, f"{out}/db").home("Γάζον")[1] is None
    assert Corpus.from_env(spark, {"SCRIPTORIUM_ROOT": root, "SCRIPTORIUM_DB": f"{out}/db", "SCRIPTORIUM_FULLTEXT": " Yes "}).index is not None
