"""Command line: spark-submit -m scriptorium.cli COMMAND ..."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from .operators import editions as E
from .operators.catalog import author_works, in_order, name_search
from .operators.fulltext import Index, search
from .operators.links import document_url, identifiers
from .session import get_spark
from .sources.corpus import catalogs_above, open_edition, scan_editions, with_headers
from .sources.sinks import build_index


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="scriptorium", description=__doc__)
    p.add_argument("--master", help="Spark master, if not given by spark-submit")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, help_: str, *arguments: tuple[str, dict]) -> None:
        c = sub.add_parser(name, help=help_)
        for a, kw in arguments:
            c.add_argument(a, **kw)

    root = ("--root", {"required": True, "help": "folder of the corpus"})
    file, ref, tree = ("--file", {"required": True}), ("--ref", {}), ("--tree", {})
    command("index", "build the full-text index", root, ("--db", {"required": True}), ("--jsonl", {}))
    command("search", "search an index", ("--db", {"required": True}), ("query", {}), ("--limit", {"type": int, "default": 50}))
    command("catalog", "works by author", root, ("--query", {"default": ""}))
    command("reffs", "citable units of a document", root, file, tree)
    command("passage", "a passage, or the whole work", root, file, ref, tree, ("--format", {"default": "html"}), ("--dts-base", {"default": "http://localhost:8000"}))
    command("neighbors", "the passages before and after", root, file, ("--ref", {"required": True}), tree)
    a = p.parse_args(argv)
    spark = get_spark(master=a.master)
    if a.command == "index":
        built = build_index(scan_editions(spark, a.root), a.db, a.jsonl)
        print(f"indexed {built.n_passages} passages from {built.n_docs} documents, {built.n_skipped} with errors -> {a.db}")
        return 0
    if a.command == "search":
        index = Index.open(spark, a.db)
        if index is None:
            print("no index")
            return 1
        for r in search(index, a.query, a.limit).toLocalIterator():
            print(f"{r.rn}\t{r.file}\t{r.ref}\t{r.snippet}")
        return 0
    if a.command == "catalog":
        author = None
        for w in in_order(author_works(name_search(with_headers(scan_editions(spark, a.root)), a.query))).toLocalIterator():
            if w.author != author:
                author = w.author
                print(f"{w.author} ({w.id}): {w.n_works}")
            print(f"  {w.title or w.work_id}\t{w.file}")
        return 0
    one = open_edition(spark, a.root, a.file)
    if a.command == "passage":
        urn = identifiers(one, catalogs_above(spark, a.root, a.file), F.col("ord"))
        link = document_url(F.lit(a.dts_base), F.col("identifier"), F.lit(a.ref or ""), F.lit(a.tree or ""))
        rows = E.passage(one, a.file, a.ref, a.tree, a.format).join(urn, "file").withColumn("url", link).collect()
        if not rows:
            print("not found")
            return 1
        print(rows[0].body)
        if rows[0].url and a.format == "html":
            print(rows[0].url)
        return 0
    units = E.units(one).filter("reason is null").filter(F.col("tree") == a.tree if a.tree else F.col("tree_ord") == 0)
    if a.command == "reffs":
        for u in units.orderBy("ord").toLocalIterator():
            print(f"{'  ' * (u.level - 1)}{u.ref}\t{u.cite_type}")
        return 0
    rows = E.neighbours(units).filter(F.col("ref") == a.ref).collect()
    print(f"{rows[0].prev_ref or '-'}\t{rows[0].next_ref or '-'}" if rows else "-\t-")
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
