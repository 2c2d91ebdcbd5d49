"""Shared inlining (problem 5) against another parser."""

import random
import xml.etree.ElementTree as ET
from pathlib import Path

import pytest

import scriptorium.operators.inlining as I
from scriptorium.operators.inlining import TEI, SharedInlining, nested_elements, plan_of

SCHEMA = "edition_id long, content string"
DATA = Path("/root/testdata/sf0.01")


def expected(rows):
    out = set()
    for i, content in rows:
        try:
            root = ET.fromstring(content or "")
        except ET.ParseError:
            continue
        n = 0

        def walk(e, parent, inside):
            nonlocal n
            for c in e:
                me = parent
                if inside and c.tag in {f"{{{TEI}}}{t}" for t in ("div", "l", "note")}:
                    n += 1
                    me = n
                    out.add((i, me, parent, c.tag.rpartition("}")[2]))
                walk(c, me, inside or c.tag == f"{{{TEI}}}text")

        walk(root, 0, root.tag == f"{{{TEI}}}text")
    return out


def random_xml(r, depth=0):
    tag = r.choice(["div", "l", "note", "p", "choice", "x:note", "lg"])
    attrs = "".join(f' {a}="{r.randint(0, 9)}"' for a in ("n", "type") if r.random() < 0.4)
    inner = "".join(random_xml(r, depth + 1) for _ in range(r.randint(0, 3))) if depth < 6 else ""
    return f"<{tag}{attrs}>{r.choice(['', 'a', ' ', '&amp;', '<!-- <div/> -->', '<![CDATA[<l>]]>'])}{inner}</{tag}>"


def document(r):
    body = "".join(random_xml(r) for _ in range(r.randint(0, 5)))
    return f'<TEI xmlns="{TEI}" xmlns:x="urn:other"><teiHeader><note>out</note></teiHeader><text>{body}</text></TEI>'


def test_random_documents(spark):
    r = random.Random(5)
    rows = [(k, document(r)) for k in range(150)] + [(900, None), (901, ""), (902, "<a><b></a>"), (903, "<a/>"), (None, document(r))]
    got = {tuple(x) for x in nested_elements(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == expected([x for x in rows if x[0] is not None])


@pytest.mark.skipif(not DATA.exists(), reason="no test tables here")
def test_whole_table(spark):
    df = spark.read.parquet(f"{DATA}/editions.parquet")
    rows = [(r.edition_id, r.content) for r in df.select("edition_id", "content").collect()]
    assert {tuple(x) for x in nested_elements(df).collect()} == expected(rows)


def test_plan():
    plan = plan_of([("r", "a", 1, ["n"]), ("r", "b", 3, []), ("b", "c", 1, ["x"]), ("a", "s", 1, []), ("b", "s", 1, []), ("b", "d", 1, []), ("d", "b", 1, []), ("c", "e", 1, ["k"])], ["a"])
    assert plan.why == {"b": "recursive", "d": "recursive", "s": "shared", "a": "asked for"}
    assert plan.columns("b") == ["c", "c/@x", "c/e", "c/e/@k"]
    assert plan_of([("r", "b", 3, [])]).why == {"b": "repeated"}


def test_tables(spark):
    xml = f'<TEI xmlns="{TEI}"><text><div n="1"><head type="h">T<hi rend="b">x</hi></head><l n="1">a<note>b</note>c</l><l>d</l></div><div/></text></TEI>'
    s = SharedInlining(spark.createDataFrame([(1, xml), (1, xml)], SCHEMA), asked=("note",))
    assert s.plan.tables == {"div", "l", "note"}
    div = s.table("div").orderBy("row_no").collect()
    assert len(div) == 4  # a repeated record is a record
    assert (div[0].attr_n, div[0].head, div[0].head__attr_type, div[0].head__hi, div[0].head__hi__attr_rend, div[0].parent_row_no) == ("1", "T", "h", "x", "b", 0)
    assert div[2].attr_n is None and div[2].head is None
    line = s.table("l").filter("row_no = 2").first()
    assert (line.text, line.parent_row_no, line.parent_elem, line.elem_no) == ("ac", 1, "div", None)
    note = s.table("note").first()
    assert (note.text, note.parent_row_no, note.parent_elem, note.elem_no, note.parent_no) == ("b", 2, "l", 1, 0)
    assert {(r.child, r.fate) for r in s.schema().collect()} == {("div", "repeated"), ("head", "inlined"), ("hi", "inlined"), ("l", "repeated"), ("note", "asked for")}


def test_no_link_is_lost(spark, monkeypatch):
    """Every row's parent is in some table, and the numbers among the asked elements are those of the rows found."""
    monkeypatch.setattr(I, "PIECE", 50)
    monkeypatch.setattr(I, "CHUNK", 3)
    r = random.Random(6)
    df = spark.createDataFrame([(k, document(r)) for k in range(60)], SCHEMA)
    kinds = ("div", "l", "note")
    s = SharedInlining(df, asked=kinds)
    rows = s.rows().collect()
    assert {t for (t,) in s.rows().select("elem").distinct().collect()} == s.plan.tables
    numbers = {(x.edition_id, x.row_no): x.elem for x in rows}
    assert len(numbers) == len(rows)
    assert all(x.parent_row_no == 0 or numbers[x.edition_id, x.parent_row_no] == x.parent_elem for x in rows)
    tables = {(x.edition_id, x.elem_no, x.parent_no, t) for t in kinds for x in s.table(t).collect()}
    assert tables == {tuple(x) for x in nested_elements(df).collect()}
    assert all(p == 0 or (i, p) in {(i, n) for i, n, _, _ in tables} for i, _, p, _ in tables)


def test_nothing(spark):
    s = SharedInlining(spark.createDataFrame([], SCHEMA))
    assert s.rows().count() == s.schema().count() == 0
    assert nested_elements(spark.createDataFrame([(1, "<a/>")], SCHEMA)).count() == 0


def test_clashing_columns(spark):
    xml = f'<TEI xmlns="{TEI}"><text><div/></text></TEI>'
    df = spark.createDataFrame([(1, xml, 7, "x")], SCHEMA + ", doc int, elem string")
    assert [tuple(r) for r in nested_elements(df).collect()] == [(1, 1, 0, "div")]


def test_deep_and_long(spark):
    deep = f'<TEI xmlns="{TEI}"><text>' + "<div>" * 5000 + "</div>" * 5000 + "</text></TEI>"
    long = f'<TEI xmlns="{TEI}"><text><l>' + "verbum " * 300_000 + "</l></text></TEI>"
    got = nested_elements(spark.createDataFrame([(1, deep), (2, long)], SCHEMA))
    assert got.filter("edition_id = 1").count() == 5000 and got.filter("parent_no = elem_no - 1").count() == 5001
