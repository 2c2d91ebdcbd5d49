"""Nested XML records as flat tables by shared inlining (problem 5).

First the graph of elements is read from all records: which element occurs in
which, how often in one parent at most, and with which attributes.  From it
follows what becomes a table: elements that repeat within a parent, that occur
in several kinds of parents, or that can contain themselves.  All others are
single in their parent and are inlined into the row of the nearest table above
them.  Then every record is shredded by that plan, once for all tables.  A row
knows its record, its number in document order and the number of the row around
it (`row_no`, `parent_row_no`, over all tables), so that no row points to one
that is in no table.  Rows of the elements that were asked for are also
numbered and linked among themselves (`elem_no`, `parent_no`).

The graph is bounded by the number of element names, not of records; it is
merged within tasks, then by an aggregate, and its size is checked before it
reaches the driver.  A record is first parsed for its form alone, since one that
is malformed gives no rows; then it is read piece by piece, and rows leave as
their elements close.
"""

from __future__ import annotations

import re
import xml.parsers.expat as expat
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import cached_property

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

TEI = "http://www.tei-c.org/ns/1.0"
XML = "http://www.w3.org/XML/1998/namespace}"
#: Edges of the element graph that may reach the driver; a schema has hundreds.
MAX_EDGES = 200_000
#: Rows of output held by a task at a time.
CHUNK = 50_000
#: Characters of a record that are parsed at a time.
PIECE = 1 << 18

EDGE = "parent string, child string, most int, attributes array<string>"
ROW = "doc long, elem_no int, parent_no int, row_no int, parent_row_no int, elem string, parent_elem string"
FIELDS = ", fields map<string,string>, text string"


def local(name: str, namespace: str) -> str:
    """The local name in `namespace`; names of other namespaces keep theirs in braces."""
    uri, _, tag = name.rpartition("}")
    return tag if uri == namespace else f"{{{uri}}}{tag}"


@dataclass
class Plan:
    """What becomes a table, what is inlined, and the columns that follow."""

    tables: set[str]
    why: dict[str, str]
    parents: dict[str, set[str]]
    attributes: dict[str, set[str]] = field(default_factory=dict)

    def columns(self, table: str) -> list[str]:
        """Names of the fields of a table: its attributes, and those and the texts of what is inlined into it."""
        out, todo = [], [(table, "")]
        children = defaultdict(list)
        for child, over in self.parents.items():
            for p in over:
                children[p].append(child)
        while todo:
            tag, path = todo.pop()
            out += [f"{path}@{a}" for a in sorted(self.attributes.get(tag, ()))]
            if path:
                out.append(path.rstrip("/"))
            todo += [(c, f"{path}{c}/") for c in children[tag] if c not in self.tables]
        return sorted(out)


def plan_of(edges: Iterable[tuple[str, str, int, list[str]]], forced: Iterable[str] = ()) -> Plan:
    """The plan for a graph of edges (parent, child, most children in one parent, the child's attributes)."""
    parents: dict[str, set[str]] = defaultdict(set)
    attributes: dict[str, set[str]] = defaultdict(set)
    repeated = set()
    for parent, child, most, names in edges:
        parents[child].add(parent)
        attributes[child].update(names)
        if most > 1:
            repeated.add(child)
    children = defaultdict(set)
    for c, over in parents.items():
        for p in over:
            children[p].add(c)

    def below(tag: str) -> set[str]:
        seen, todo = set(), [tag]
        while todo:
            for c in children[todo.pop()] - seen:
                seen.add(c)
                todo.append(c)
        return seen

    why = {}
    for tag in parents:
        if tag in below(tag):
            why[tag] = "recursive"
        elif tag in repeated:
            why[tag] = "repeated"
        elif len(parents[tag]) > 1:
            why[tag] = "shared"
    for tag in forced:
        why.setdefault(tag, "asked for")
    return Plan(set(why), why, dict(parents), dict(attributes))


def _parser(scope: str, namespace: str, start, end, text=None):
    """A parser that calls start(tag, attributes), end() and text(string) for what is inside elements `scope`."""
    p = expat.ParserCreate(namespace_separator="}")
    depth = 0
    names: dict[str, str] = {}

    def on_start(name: str, attributes: dict[str, str]) -> None:
        nonlocal depth
        tag = names.get(name) or names.setdefault(name, local(name, namespace))
        if depth:
            start(tag, {k.replace(XML, "xml:"): v for k, v in attributes.items()} if attributes else attributes)
        if depth or tag == scope:
            depth += 1

    def on_end(name: str) -> None:
        nonlocal depth
        if depth:
            depth -= 1
            if depth:
                end()

    p.StartElementHandler, p.EndElementHandler = on_start, on_end
    if text:
        p.CharacterDataHandler = lambda s: text(s) if depth else None
        p.buffer_text = True
    return p


def _edges(scope: str, namespace: str):
    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most: dict[tuple[str, str], int] = defaultdict(int)
        attributes: dict[tuple[str, str], set[str]] = defaultdict(set)
        for b in batches:
            for content in b.column("content"):
                stack: list[tuple[str, dict[str, int]]] = [(scope, defaultdict(int))]
                seen: dict[tuple[str, str], int] = {}
                named: list[tuple[tuple[str, str], tuple[str, ...]]] = []

                def start(tag: str, attrs: dict[str, str]) -> None:
                    parent, counts = stack[-1]
                    counts[tag] += 1
                    edge = (parent, tag)
                    if counts[tag] > seen.get(edge, 0):
                        seen[edge] = counts[tag]
                    if attrs:
                        named.append((edge, tuple(attrs)))
                    stack.append((tag, defaultdict(int)))

                try:
                    _parser(scope, namespace, start, lambda: stack.pop()).Parse(content.as_py(), True)
                except expat.ExpatError:
                    continue
                for edge, n in seen.items():
                    most[edge] = max(most[edge], n)
                for edge, names in named:
                    attributes[edge].update(names)
        yield pa.RecordBatch.from_pylist(
            [{"parent": p, "child": c, "most": n, "attributes": sorted(attributes[p, c])} for (p, c), n in most.items()],
            pa.schema([("parent", pa.string()), ("child", pa.string()), ("most", pa.int32()), ("attributes", pa.list_(pa.string()))]),
        )

    return edges


@dataclass
class _Open:
    """A row of an element that is still open."""

    row: list
    fields: dict[str, str]
    text: list[str]
    path: list[str]  # inlined elements around it, within the table above


def _shredder(scope: str, namespace: str, tables: frozenset[str], asked: frozenset[str], fields: bool):
    columns = [c.split()[0] for c in ROW.split(", ")] + ["fields", "text"] * fields
    types = [pa.int64(), *[pa.int32()] * 4, pa.string(), pa.string()] + [pa.map_(pa.string(), pa.string()), pa.string()] * fields

    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[list] = []

        def chunk() -> pa.RecordBatch:
            columned = list(zip(*rows)) or [[] for _ in columns]
            arrays = [pa.array(c, t) for c, t in zip(columned, types)]
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, columns)

        for b in batches:
            for doc, content in zip(b.column("doc").to_pylist(), b.column("content").to_pylist()):
                try:
                    expat.ParserCreate(namespace_separator="}").Parse(content, True)
                except expat.ExpatError:
                    continue
                around: list[_Open] = []  # rows of the open tables
                parents: list[int] = [0]  # numbers of those that were asked for
                path: list[str] = []  # inlined elements since the innermost table
                inlined: list[bool] = []  # of each open element
                count = named = 0

                def start(tag: str, attrs: dict[str, str]) -> None:
                    nonlocal path, count, named
                    inlined.append(tag not in tables)
                    if tag in tables:
                        count += 1
                        up = around[-1].row if around else None
                        row = [doc, None, parents[-1], count, up[3] if up else 0, tag, up[5] if up else None]
                        if tag in asked:
                            named += 1
                            row[1] = named
                            parents.append(named)
                        around.append(_Open(row, {f"@{k}": v for k, v in attrs.items()} if fields else {}, [], path))
                        path = []
                    else:
                        path.append(tag)
                        if fields and around:
                            at = "/".join(path)
                            around[-1].fields.update({f"{at}/@{k}": v for k, v in attrs.items()})
                            around[-1].fields.setdefault(at, "")

                def end() -> None:
                    nonlocal path
                    if inlined.pop():
                        path.pop()
                        return
                    done = around.pop()
                    path = done.path
                    if done.row[1] is not None:
                        parents.pop()
                    if fields:
                        done.row += [list(done.fields.items()), "".join(done.text)]
                    rows.append(done.row)

                def text(s: str) -> None:
                    if around:
                        around[-1].text.append(s)
                        if path:
                            at = "/".join(path)
                            around[-1].fields[at] = around[-1].fields.get(at, "") + s

                parser = _parser(scope, namespace, start, end, text if fields else None)
                for k in range(0, len(content), PIECE):
                    parser.Parse(content[k : k + PIECE], k + PIECE >= len(content))
                    if len(rows) >= CHUNK:
                        yield chunk()
        if rows:
            yield chunk()

    return shred


class SharedInlining:
    """Flat tables of the elements inside `scope` of well-formed records.

    Rows with a null id, and null, empty or malformed content, give no rows.
    Ids may repeat: each row is a record of its own, its rows bear the id.
    Names of other namespaces are other elements.  `asked` names elements that
    become tables whatever the data say and are numbered among themselves.
    """

    def __init__(
        self, df: DataFrame, id_col: str = "edition_id", content_col: str = "content", scope: str = "text", namespace: str = TEI, asked: tuple[str, ...] = ()
    ) -> None:
        self.records = (
            df.select(F.col(id_col).cast("long").alias("doc"), F.col(content_col).alias("content"))
            .filter("doc is not null and content is not null and content <> ''")
        )
        self.id_col, self.scope, self.namespace, self.asked = id_col, scope, namespace, frozenset(asked)
        self.edges = (
            self.records.select("content").mapInArrow(_edges(scope, namespace), EDGE)
            .groupBy("parent", "child").agg(F.max("most").alias("most"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("attributes")))).alias("attributes"))
        )
        graph = self.edges.limit(MAX_EDGES + 1).collect()
        if len(graph) > MAX_EDGES:
            raise ValueError(f"more than {MAX_EDGES} kinds of nesting: this is no schema to inline")
        self.plan = plan_of([tuple(r) for r in graph], asked)

    def rows(self, fields: bool = False) -> DataFrame:
        """Rows of all tables of the plan, numbered in document order from 1; 0 is the parent of the outermost."""
        shred = _shredder(self.scope, self.namespace, frozenset(self.plan.tables), self.asked, fields)
        return self.records.mapInArrow(shred, ROW + FIELDS * fields).withColumnRenamed("doc", self.id_col)

    @cached_property
    def shredded(self) -> DataFrame:
        """All rows with their fields, written once, in a folder for each table."""
        return written(self.rows(fields=True), "shredded", by="elem")

    def table(self, name: str) -> DataFrame:
        """One table with a column for each field: `attr_x` for attributes, `a__b` for inlined elements, null where absent."""
        columns = self.plan.columns(name)
        plain = lambda c: re.sub(r"\W+", "_", c.replace("/", "__").replace("@", "attr_"))
        return (
            self.shredded.filter(F.col("elem") == name)
            .select(self.id_col, "elem_no", "parent_no", "row_no", "parent_row_no", "parent_elem", "text", *(F.col("fields")[c].alias(plain(c)) for c in columns))
        )

    def schema(self) -> DataFrame:
        """The graph with the fate of each element: parent, child, most, fate."""
        why = self.plan.why
        fate = F.lit("inlined")
        for reason in sorted(set(why.values())):
            fate = F.when(F.col("child").isin([t for t in why if why[t] == reason]), F.lit(reason)).otherwise(fate)
        return self.edges.select("parent", "child", "most", fate.alias("fate"))


def nested_elements(df: DataFrame, kinds: tuple[str, ...] = ("div", "l", "note"), id_col: str = "edition_id") -> DataFrame:
    """(id, elem_no, parent_no, elem) of the TEI elements `kinds` inside `text`: their part of the tables, with the links among them."""
    return SharedInlining(df, id_col, asked=kinds).rows().filter("elem_no is not null").select(id_col, "elem_no", "parent_no", "elem")
