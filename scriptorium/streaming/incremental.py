"""Incremental indexing: new edition files are indexed as they arrive.

A stream of files is rendered batch by batch; each batch adds its passages,
postings, statistics and rejects.  Writes go to a folder per batch and replace
it, so that a batch that is run again after a failure leaves one copy.  A file
that is delivered again counts as it was last delivered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import fulltext
from ..operators.catalog import author_id, relative, work_id
from ..operators.editions import index_rows, passages, rejects
from ..operators.fulltext import Index
from ..sources.corpus import EDITIONS, _file_path, _plain
from ..sources.sinks import JSONL, numbered

FILE = "path string, modificationTime timestamp, length long, content binary"
TABLES = ("passages", "docstats", "rejects")


def edition_stream(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """(file, author_id, work_id, content) of edition files below `root` as they arrive."""
    found = (
        spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").option("pathGlobFilter", EDITIONS)
        .option("maxFilesPerTrigger", str(files_per_batch)).load(root)
    )
    file = relative(_file_path(F.col("path")), _plain(root))
    return found.select(file.alias("file"), author_id(file).alias("author_id"), work_id(file).alias("work_id"), "content")


def index_stream(editions: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Index a stream of editions below `path`; with `once`, what is there now, and stop."""

    def add(batch: DataFrame, number: int) -> None:
        rows = index_rows(batch).persist()
        try:
            good = numbered(passages(rows)).select("passage_id", *JSONL)
            posted = fulltext.posted(good).join(good.select("passage_id", "file").distinct(), "passage_id").withColumn("bucket", fulltext.bucket(F.col("term")))
            posted = posted.repartition("bucket").sortWithinPartitions("bucket", "term", "passage_id")
            posted.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
            lengths = fulltext.docstats(good).join(good.select("passage_id", "file").distinct(), "passage_id")
            for name, table in zip(TABLES, (good, lengths, rejects(rows))):
                table.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
            rows.select("file").distinct().write.mode("overwrite").parquet(f"{path}/delivered/batch={number}")
        finally:
            rows.unpersist()

    writer = editions.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def open_stream_index(spark: SparkSession, path: str) -> Index | None:
    """The index over all batches so far, of each file its last delivery."""
    found = Index.open(spark, path)
    if found is None:
        return None
    last = spark.read.parquet(f"{path}/delivered").groupBy("file").agg(F.max("batch").alias("batch"))
    current = lambda t: t.join(last, ["file", "batch"], "left_semi").drop("batch")
    lengths = current(found.docstats).drop("file")
    known = tuple(lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first())
    return Index(current(found.postings).drop("file"), lengths, current(found.passages), None, known)


def compact(spark: SparkSession, path: str, out: str) -> bool:
    """Write the index over all batches so far as one index below `out`; whether there was any."""
    found = open_stream_index(spark, path)
    if found is not None:
        Index.over(found.passages).write(out)
    return found is not None
