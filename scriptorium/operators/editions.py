"""Editions as DataFrames: header metadata, node table, citable units, passages, rejects.

All operators take a table with a file name and the XML as a string or binary
column, and work on Arrow batches of documents.  A document that can't be read
gives a reject row; it never fails the job.
"""

from __future__ import annotations

import xml.parsers.expat as expat
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import spread
from . import tei
from .ordered import OrderedGroups

#: Rows of output held by a task at a time.
CHUNK = 20_000
#: Places of a document that an interval join compares at a time.
BIN = 256


def _arrow(types: str) -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "map": pa.map_(pa.string(), pa.string())}
    return pa.schema([(n, kinds[t]) for n, t in (x.split() for x in types.split(", "))])


def _expand(df: DataFrame, types: str, rows_of: Callable[..., Iterator[tuple]]) -> DataFrame:
    """The rows that `rows_of` makes of each row of `df`, in bounded batches."""
    schema = _arrow(types)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def chunk() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(schema)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

        for b in batches:
            for record in zip(*(c.to_pylist() for c in b.columns)):
                for row in rows_of(*record):
                    rows.append(row)
                    if len(rows) >= CHUNK:
                        yield chunk()
        if rows:
            yield chunk()

    return spread(df).mapInArrow(run, types.replace(" map", " map<string,string>"))


def headers(df: DataFrame, content: str = "content") -> DataFrame:
    """`df` with the columns `title` and `author` read from the header of `content`; empty where there is none."""

    @F.arrow_udf("struct<title:string,author:string>")
    def read(contents: pa.Array) -> pa.Array:
        found = [tei.header(c) for c in contents.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([t for t, _ in found], pa.string()), pa.array([a for _, a in found], pa.string())], ["title", "author"])

    return df.withColumn("_header", read(F.col(content))).withColumns({"title": F.col("_header.title"), "author": F.col("_header.author")}).drop("_header")


def failure(e: Exception) -> str:
    return f"open failed: XMLSyntaxError: {expat.ErrorString(e.code)}" if isinstance(e, expat.ExpatError) else f"open failed: {type(e).__name__}: {e}"


def opened(content: str | bytes | None) -> tuple[tei.Node | None, str | None]:
    """The root, or the reason why there is none."""
    if not content:
        return None, "open failed: XMLSyntaxError: document is empty"
    try:
        return tei.parse(content), None
    except (expat.ExpatError, RecursionError, ValueError, LookupError) as e:
        return None, failure(e)


NODE = "file string, pre int, post int, level int, parent int, kind string, ns string, tag string, attrs map, txt string"


def nodes(df: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """The node table of well-formed documents: elements and texts in document order, with the interval of each."""

    def rows(name: str, xml: str | bytes | None) -> Iterator[tuple]:
        root, _ = opened(xml)
        todo = [(root, 0, 0)] if root is not None else []
        while todo:
            n, level, parent = todo.pop()
            if isinstance(n, tei.Node):
                yield name, n.pre, n.post, level, parent, "elem", n.ns, n.tag, list(n.attrs.items()), None
                todo.extend((c, level + 1, n.pre) for c in reversed(n.children))
            else:
                yield name, n.pre, n.pre, level, parent, "text", None, None, None, str(n)

    return _expand(df.select(file, content), NODE, rows)


RULE = "file string, tree string, tree_ord int, is_default int, level int, match string, use string, unit string, delim string"


def cite_rules(df: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """The citation rules that each document declares."""

    def rows(name: str, xml: str | bytes | None) -> Iterator[tuple]:
        root, _ = opened(xml)
        if root is None:
            return
        trees, default = tei.rules_of(root)
        for k, (tree, rules) in enumerate(trees.items()):
            todo = [(1, r) for r in reversed(rules)]
            while todo:
                level, r = todo.pop()
                yield name, tree, k, int(tree == default), level, r.match, r.use, r.unit, r.delim
                todo.extend((level + 1, c) for c in reversed(r.children))

    return _expand(df.select(file, content), RULE, rows)


UNIT = "file string, tree string, tree_ord int, ord int, level int, cite_type string, ref string, parent_ref string, pre int, post int, reason string"


def units(df: DataFrame, file: str = "file", content: str = "content") -> DataFrame:
    """The citable units of all trees in document order; a tree that can't be followed is one row with a reason."""

    def rows(name: str, xml: str | bytes | None) -> Iterator[tuple]:
        root, reason = opened(xml)
        if root is None:
            yield name, None, None, None, None, None, None, None, None, None, reason
            return
        for k, (tree, rules) in enumerate(tei.rules_of(root)[0].items()):
            try:
                for u in tei.units_of(root, rules):
                    yield name, tree, k, u.ord, u.level, u.unit, u.ref, u.parent_ref, u.node.pre, u.node.post, None
            except (tei.CiteError, RecursionError) as e:
                yield name, tree, k, None, None, None, None, None, None, None, f"tree '{tree}': {type(e).__name__}: {e}"

    return _expand(df.select(file, content), UNIT, rows)


ROW = "file string, tree string, tree_ord int, ord int, level int, cite_type string, ref string, parent_ref string, title string, author string, text string, reason string"


def index_rows(df: DataFrame, file: str = "file", content: str = "content", mode: str = "text", strict_blocks: bool = False) -> DataFrame:
    """Every citable unit of every tree, rendered, with the document's title and author; and what failed.

    Rows with a null `reason` are passages: their text is stripped, and units
    without any text are left out.  The others are rejects: a document that
    can't be opened, a tree that can't be followed (its other trees are kept),
    or a single unit that can't be rendered, then with its ref.
    """

    def rows(name: str, xml: str | bytes | None) -> Iterator[tuple]:
        root, reason = opened(xml)
        if root is None:
            yield name, None, None, None, None, None, None, None, None, None, None, reason
            return
        title, author = tei.header(xml)
        for k, (tree, rules) in enumerate(tei.rules_of(root)[0].items()):
            try:
                found = tei.units_of(root, rules)
            except (tei.CiteError, RecursionError) as e:
                yield name, tree, k, None, None, None, None, None, None, None, None, f"tree '{tree}': {type(e).__name__}: {e}"
                continue
            for u in found:
                text = why = None
                try:
                    text = tei.render(tei.excerpt(u.node), mode, strict_blocks).strip()
                except (ValueError, RecursionError) as e:
                    why = f"passage failed: {type(e).__name__}: {e}"
                if text or why:
                    yield name, tree, k, u.ord, u.level, u.unit, u.ref, u.parent_ref, title, author, text, why

    return _expand(df.select(file, content), ROW, rows)


def passages(rows: DataFrame) -> DataFrame:
    """(file, tree, ref, title, author, text) of index rows, with their place."""
    return rows.filter("reason is null").drop("reason")


def rejects(rows: DataFrame) -> DataFrame:
    """(file, reason): for each document its reasons in the order of its trees, joined by "; "."""
    bad = rows.filter("reason is not null").select("file", "tree_ord", "ord", "ref", "reason").distinct().groupBy("file").agg(
        F.array_sort(F.collect_list(F.struct(F.coalesce("tree_ord", F.lit(-1)).alias("k"), F.coalesce("ord", F.lit(0)).alias("o"), "ref", "reason"))).alias("r")
    )
    reason = F.transform("r", lambda x: F.when(x["ref"].isNull(), x["reason"]).otherwise(F.concat(F.lit("ref '"), x["ref"], F.lit("': "), x["reason"])))
    return bad.select("file", F.array_join(reason, "; ").alias("reason"))


def counters(rows: DataFrame) -> DataFrame:
    """One row: documents that gave passages, passages, documents with errors."""
    good = F.col("reason").isNull()
    return rows.agg(
        F.countDistinct(F.when(good, F.col("file"))).alias("n_docs"), F.count(F.when(good, 1)).alias("n_passages"),
        F.countDistinct(F.when(~good, F.col("file"))).alias("n_skipped"),
    )


def passage(df: DataFrame, file_name: str, ref: str | None = None, tree: str | None = None, mode: str = "html", file: str = "file", content: str = "content") -> DataFrame:
    """(file, tree, ref, body) of one passage of one document, or of the whole work for an empty ref; no row where there is none.

    Without a tree the document's default tree is used.  Text is as rendered,
    not stripped.
    """

    def rows(name: str, xml: str | bytes | None) -> Iterator[tuple]:
        root, _ = opened(xml)
        if root is None:
            return
        trees, default = tei.rules_of(root)
        chosen = tree or default
        try:
            if not ref:
                yield name, chosen, None, tei.render(root, mode)
            elif chosen in trees:
                unit = next((u for u in tei.units_of(root, trees[chosen]) if u.ref == ref), None)
                if unit:
                    yield name, chosen, ref, tei.render(tei.excerpt(unit.node), mode)
        except (ValueError, RecursionError):
            return

    return _expand(df.filter(F.col(file) == file_name).select(file, content), "file string, tree string, ref string, body string", rows)


def rendered(fragment: Column, mode: str = "html", strict_blocks: bool = False) -> Column:
    """A column of XML fragments, rendered; null for null and for what is not well-formed."""

    @F.arrow_udf("string")
    def run(fragments: pa.Array) -> pa.Array:
        def one(xml: str | None) -> str | None:
            root, _ = opened(xml)
            try:
                return None if root is None else tei.render(root, mode, strict_blocks)
            except (ValueError, RecursionError):
                return None

        return pa.array(map(one, fragments.to_pylist()), pa.string())

    return run(fragment)


def unit_texts(node_table: DataFrame, unit_table: DataFrame) -> DataFrame:
    """(file, tree, ref, text): the string value of each unit, by an interval join of units and text nodes.

    All in the JVM; for documents whose blocks do not nest and that hold no
    apparatus this is their text but for white space.  Intervals are cut into
    bins, so that a text meets the units around it, not all of its document.
    """
    bins = F.explode(F.sequence((F.col("pre") / BIN).cast("int"), (F.col("post") / BIN).cast("int"))).alias("bin")
    u = unit_table.filter("reason is null").select("file", "tree", "ord", "ref", "pre", "post", bins).alias("u")
    t = node_table.filter("kind = 'text'").select("file", F.col("pre").alias("at"), "txt", (F.col("pre") / BIN).cast("int").alias("bin")).alias("t")
    same = (F.col("u.file") == F.col("t.file")) & (F.col("u.bin") == F.col("t.bin"))
    inside = u.join(t, same & F.col("t.at").between(F.col("u.pre"), F.col("u.post")))
    parts = F.array_sort(F.collect_list(F.struct("at", "txt")))
    return inside.groupBy("u.file", "tree", "ord", "ref").agg(F.array_join(F.transform(parts, lambda x: x["txt"]), "").alias("text"))


def neighbours(unit_rows: DataFrame, order: str = "ord", keys: tuple[str, ...] = ("file", "tree")) -> DataFrame:
    """(keys, ref, level, prev_ref, next_ref): the units before and after, of the same level, across parents.

    A ref that occurs more than once stands for its first occurrence.
    """
    flow = OrderedGroups(unit_rows.select(*keys, "level", "ref", F.col(order).alias("ord")), [*keys, "level"], ["ord"])
    rows = flow.with_neighbours("ref", "prev_ref", "next_ref")
    first = F.min_by(F.struct("level", "prev_ref", "next_ref"), "ord").alias("r")
    return rows.groupBy(*keys, "ref").agg(first).select(*keys, "ref", "r.*")
