"""Sinks: index, JSON lines, skip report."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.catalog import leads_inside
from ..operators.editions import counters, index_rows, passages, rejects
from ..operators.fulltext import Index
from ..session import written
from .corpus import _file_system

JSONL = ("file", "tree", "ref", "title", "author", "text")


def jsonl(rows: DataFrame) -> DataFrame:
    """One JSON object for each passage, keys in fixed order, non-ASCII characters as they are; nulls are left out."""
    return rows.select(F.to_json(F.struct(*JSONL)).alias("value"))


def write_jsonl(rows: DataFrame, path: str) -> None:
    jsonl(rows).write.mode("overwrite").text(path)


def write_skip_report(skipped: DataFrame, path: str) -> bool:
    """A tab-separated report, each of its files with a header; an earlier one is replaced, and none is written if nothing was skipped."""
    spark = skipped.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if skipped.isEmpty():
        system.delete(where, True)
        return False
    skipped.select("file", "reason").write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)
    return True


def write_files(rows: DataFrame, root: str, file: str = "file", content: str = "content") -> int:
    """Each row's content, text or bytes, as a file of its own below `root`; how many there were.

    Names that lead out of `root` and null contents are passed over; of rows of
    one name any may come last.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = 0
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if body is None or not leads_inside(name):
                    continue
                system, inner = _file_system(f"{root.rstrip('/')}/{name}")
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(body.encode() if isinstance(body, str) else body)
                n += 1
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return rows.select(file, content).filter(F.col(file).isNotNull()).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


@dataclass
class Built:
    n_docs: int
    n_passages: int
    n_skipped: int


def numbered(rows: DataFrame) -> DataFrame:
    """Passages with an id that follows from file, tree and place, so that a rebuild gives the same ids."""
    return rows.withColumn("passage_id", F.xxhash64("file", "tree", "ord"))


def build_index(editions: DataFrame, path: str, jsonl_path: str | None = None) -> Built:
    """Build the full-text index of editions (file, content) below `path`: a full rebuild.

    Documents are rendered once; passages, JSON lines, report and counters are
    made from that table.
    """
    rows = written(index_rows(editions), "index-rows")
    good = numbered(passages(rows))
    Index.over(good.select("passage_id", *JSONL)).write(path)
    if jsonl_path:
        write_jsonl(good, jsonl_path)
    write_skip_report(rejects(rows), f"{path}.skipped.tsv")
    return Built(*counters(rows).first())
