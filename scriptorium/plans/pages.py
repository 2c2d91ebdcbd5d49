"""The result sets behind the reader's pages: home, document, passage."""

from __future__ import annotations

import os
from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import editions
from ..operators.catalog import author_works, name_search
from ..operators.fulltext import Index, search
from ..operators.links import document_url, identifiers
from ..sources.corpus import catalogs_above, open_edition, scan_editions, with_headers


def is_set(value: str | None) -> bool:
    """Whether a flag of the environment is on: 1, true, yes or on, whatever the case and white space around."""
    return (value or "").strip().lower() in ("1", "true", "yes", "on")


class Corpus:
    """A corpus below `root`, which stays as it is while it is read.

    Headers are read once, when they are first asked for, and the catalog is
    kept; open the corpus again to see changes.  Full-text search is on if it is
    asked for and an index is there when the corpus is opened.
    """

    def __init__(self, spark: SparkSession, root: str, db: str | None = None, dts_base: str = "http://localhost:8000", fulltext: bool = False) -> None:
        self.spark, self.root, self.dts_base = spark, root, dts_base
        self.index = Index.open(spark, db) if fulltext and db else None

    @classmethod
    def from_env(cls, spark: SparkSession, env: Mapping[str, str] = os.environ) -> Corpus:
        """As SCRIPTORIUM_ROOT, _DB, _DTS_BASE and _FULLTEXT say."""
        get = lambda k, d=None: env.get(f"SCRIPTORIUM_{k}", d)
        return cls(spark, get("ROOT", "corpus/data"), get("DB"), get("DTS_BASE", "http://localhost:8000"), is_set(get("FULLTEXT")))

    @cached_property
    def works(self) -> DataFrame:
        return with_headers(scan_editions(self.spark, self.root)).persist()

    @cached_property
    def listing(self) -> DataFrame:
        """All works by author: the catalog page as it is first shown."""
        return author_works(self.works).persist()

    def close(self) -> None:
        for kept in ("listing", "works"):
            if kept in self.__dict__:
                self.__dict__.pop(kept).unpersist()

    def home(self, q: str = "") -> tuple[DataFrame, DataFrame | None]:
        """Works by author whose names contain the input, as flat rows, and the passages found, if full-text search is on and there is input."""
        found = author_works(name_search(self.works, q)) if q.strip() else self.listing
        return found, search(self.index, q) if self.index is not None and q.strip() else None

    def _file(self, file: str) -> DataFrame:
        """The edition of that name, or none; no other file is read."""
        return open_edition(self.spark, self.root, file)

    def document(self, file: str, tree: str | None = None) -> DataFrame:
        """(file, title, author, tree, is_default, ord, level, cite_type, ref): the citable units of the asked or the default tree."""
        one = self._file(file)
        rules = editions.cite_rules(one).select("file", "tree", "is_default").distinct()
        chosen = rules.filter(F.col("tree") == tree if tree else F.col("is_default") == 1)
        units = editions.units(one).filter("reason is null").join(chosen, ["file", "tree"])
        return units.join(with_headers(one).select("file", "title", "author"), "file").select("file", "title", "author", "tree", "is_default", "ord", "level", "cite_type", "ref")

    def passage(self, file: str, ref: str | None = None, tree: str | None = None, mode: str = "html") -> DataFrame:
        """(file, tree, ref, body, identifier, url, prev_ref, next_ref) of a passage or the whole work; no row where there is none.

        The link repeats the tree that was asked for; neighbours are those in
        the tree that is shown.
        """
        one = self._file(file)
        body = editions.passage(one, file, ref, tree, mode)
        named = identifiers(one, catalogs_above(self.spark, self.root, file), F.col("ord")).select("file", "identifier")
        around = editions.neighbours(editions.units(one).filter("reason is null")).select("file", "tree", "ref", "prev_ref", "next_ref")
        url = document_url(F.lit(self.dts_base), F.col("identifier"), F.lit(ref or ""), F.lit(tree or ""))
        return body.join(named, "file", "left").join(around, ["file", "tree", "ref"], "left").select("file", "tree", "ref", "body", "identifier", url.alias("url"), "prev_ref", "next_ref")
