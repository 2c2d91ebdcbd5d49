"""Corpora on a file system: editions and catalogs."""

from __future__ import annotations

import re
import xml.parsers.expat as expat
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import author_id, leads_inside, relative, work_id
from ..operators.editions import headers
from ..operators.links import CATALOG_NAMES

# Fixed value: names of edition files end with a language and a number.
EDITIONS = "*-{grc,lat}*.xml"


def _file_path(path):
    return F.regexp_replace(path, "^file:/*", "/")


def scan_editions(spark: SparkSession, root: str) -> DataFrame:
    """(file, author_id, work_id, content) of the edition files below `root`, at any depth, each once.

    Files are read one by one by the tasks that parse them; names and
    directories that begin with `_` or `.`, and files without a byte, are not
    seen by Spark's readers.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", EDITIONS).load(root)
    file = relative(_file_path(F.col("path")), _plain(root))
    return found.select(file.alias("file"), author_id(file).alias("author_id"), work_id(file).alias("work_id"), "content")


def with_headers(editions: DataFrame) -> DataFrame:
    """Works of a corpus: (file, author_id, work_id, title, author)."""
    return headers(editions).select("file", "author_id", "work_id", "title", "author")


def open_edition(spark: SparkSession, root: str, file: str) -> DataFrame:
    """The edition of that name as `scan_editions` gives it, or no row; nothing else is listed or read.

    Names that lead out of the corpus, and those of no edition, are no editions.
    """
    where = spark._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{file}") if leads_inside(file) and is_edition(file) else None
    if where is None or not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], "file string, author_id string, work_id string, content binary")
    name = F.lit(file)
    found = spark.read.format("binaryFile").load(re.sub(r"([\\\[\]{}*?])", r"\\\1", where.toString()))
    return found.select(name.alias("file"), author_id(name).alias("author_id"), work_id(name).alias("work_id"), "content")


def is_edition(file: str) -> bool:
    """Whether a name is that of an edition: as the pattern EDITIONS says, which Spark's readers use."""
    return re.fullmatch(r".*-(?:grc|lat).*\.xml", file.rpartition("/")[2]) is not None


def _file_system(path: str):
    """The Arrow file system of a path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _listed(paths: DataFrame, deep: bool) -> DataFrame:
    """(path, directory): what the directories hold, listed by the tasks; with `deep`, at any depth below."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for b in batches:
            for p in b.column("path").to_pylist():
                system, inner = _file_system(p)
                around = p.removesuffix(inner)
                found = system.get_file_info(fs.FileSelector(inner, recursive=deep))
                found = [(around + f.path, f.type == fs.FileType.Directory) for f in found if f.type == fs.FileType.Directory or f.base_name in CATALOG_NAMES]
                yield pa.RecordBatch.from_arrays([pa.array([f for f, _ in found], pa.string()), pa.array([d for _, d in found], pa.bool_())], ["path", "directory"])

    return paths.mapInArrow(run, "path string, directory boolean")


def catalog_paths(spark: SparkSession, root: str) -> DataFrame:
    """(path) of the catalog files below `root`.

    The directories of authors and works are listed by tasks, level by level,
    so that neither an author with very many works nor the driver lists all.
    (Spark's file sources hide names that begin with `_`.)
    """
    top = _listed(spark.createDataFrame([(root.rstrip("/"),)], "path string"), False)
    second = _listed(_over_tasks(top.filter("directory").select("path")), False)
    below = _listed(_over_tasks(second.filter("directory").select("path")), True)
    return top.unionAll(second).unionAll(below).filter("not directory").select("path")


def _over_tasks(paths: DataFrame) -> DataFrame:
    return paths.repartition(max(1, paths.sparkSession.sparkContext.defaultParallelism), "path")


ENTRY = "identifier string, catalog_dir string, catalog_name string, filepath string, title string, description string, parent string, ord int"


def parse_catalogs(catalogs: DataFrame) -> DataFrame:
    """Resource entries of (catalog_dir, catalog_name, content) rows; a malformed catalog has none."""
    schema = pa.schema([(c.split()[0], pa.int32() if c.split()[1] == "int" else pa.string()) for c in ENTRY.split(", ")])

    def entries(content: str | bytes) -> list[dict[str, str]]:
        p = expat.ParserCreate(namespace_separator="}")
        p.buffer_text = True
        stack: list[tuple[str, dict | None]] = []
        out: list[dict] = []

        def start(name: str, attrs: dict[str, str]) -> None:
            tag = name.rpartition("}")[2]
            entry = stack[-1][1] if stack else None
            if tag == "resource":
                entry = {"identifier": attrs.get("identifier"), "filepath": attrs.get("filepath")}
                out.append(entry)
            stack.append((tag, entry))

        def text(s: str) -> None:
            tag, entry = stack[-1]
            if entry is not None and tag in ("title", "description", "parent"):
                entry[tag] = entry.get(tag, "") + s

        p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = start, lambda _: stack.pop(), text
        try:
            p.Parse(content, True)
        except expat.ExpatError:
            return []
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                {**e, "catalog_dir": d, "catalog_name": n, "ord": k}
                for d, n, c in zip(*(b.column(x).to_pylist() for x in ("catalog_dir", "catalog_name", "content")))
                if c
                for k, e in enumerate(entries(c))
            ]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return catalogs.mapInArrow(run, ENTRY)


def scan_catalogs(spark: SparkSession, root: str) -> DataFrame:
    """Resource entries of all catalogs below `root`."""
    return _read_catalogs(catalog_paths(spark, root), root)


def catalogs_above(spark: SparkSession, root: str, file: str) -> DataFrame:
    """Resource entries of the catalogs in the directories around one file; no other is opened."""
    parts = file.split("/")[:-1] if leads_inside(file) else []
    around = ["/".join(parts[:k]) for k in range(len(parts) + 1)]
    names = [f"{root.rstrip('/')}/{d}/{n}" if d else f"{root.rstrip('/')}/{n}" for d in around for n in CATALOG_NAMES]
    return _read_catalogs(spark.createDataFrame([(n,) for n in names], "path string").coalesce(1), root)


def _read_catalogs(paths: DataFrame, root: str) -> DataFrame:
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in b.column("path").to_pylist():
                system, inner = _file_system(p)
                try:
                    with system.open_input_stream(inner) as f:
                        content = f.readall()
                except FileNotFoundError:
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([content], pa.binary())], ["path", "content"])

    read_ = paths.mapInArrow(read, "path string, content binary").withColumn("rel", relative(_file_path(F.col("path")), _plain(root)))
    parts = F.split("rel", "/")
    return parse_catalogs(read_.select(F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/").alias("catalog_dir"), F.element_at(parts, -1).alias("catalog_name"), "content"))


def _plain(root: str) -> str:
    return re.sub("^file:/*", "/", root)
