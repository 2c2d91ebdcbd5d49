"""Session defaults and the two ways to cut a lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def get_spark(name: str = "scriptorium", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution; `conf` entries win over the defaults."""
    b = SparkSession.builder.appName(name)
    if master:
        b = b.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    return b.config(map=defaults | conf).getOrCreate()


#: Folders written by this process, by application; see clean().
_WRITTEN: dict[str, list[str]] = defaultdict(list)


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share.

    The cluster names it in spark.checkpoint.dir.  Only where that is unset on
    one machine, as in tests, a temporary folder stands in, which is removed at
    exit; on a cluster it is an error, since each executor would write to its
    own disk.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError(f"spark.checkpoint.dir is not set, and {sc.master} needs a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="scriptorium-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.setCheckpointDir(folder)
    return str(sc.getCheckpointDir()).rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder within the shared one, which clean() deletes."""
    path = f"{shared_folder(spark)}/scriptorium/{name}-{uuid.uuid4().hex}"
    _WRITTEN[spark.sparkContext.applicationId].append(path)
    return path


@contextmanager
def shuffles_freed(spark: SparkSession) -> Iterator[None]:
    """Each query that is run within deletes its shuffle files when it ends.

    For queries that are run once.  Else Spark deletes such files whenever the
    driver happens to collect its garbage.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def written(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write `df` as Parquet in the shared folder, partitioned by a column if one is named, and read it back.

    Cuts the lineage and survives the loss of executors.  Parquet rather than
    checkpoint(): it is compressed, and later reads prune columns.  What was
    shuffled for it is of no more use and is deleted; for what other queries
    have left, the driver is asked to collect its garbage.
    """
    path = new_folder(df.sparkSession, name)
    with shuffles_freed(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(path)
    df.sparkSession._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession) -> int:
    """Delete the tables that this application has written so far, once their results are no longer needed; how many there were."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


def spread(df: DataFrame) -> DataFrame:
    """`df` over all cores, if its input has too few splits to keep a quarter of them busy.

    For work that costs far more than moving its input, such as parsing: a few
    row groups then make a task for each core.  Inputs of many splits stay
    where they are, and so do streams.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or df._jdf.queryExecution().toRdd().getNumPartitions() * 4 > cores:
        return df
    return df.repartition(cores)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def local_spark(cores: int | str = 8, **conf: str) -> SparkSession:
    """For tests and benchmarks on one machine."""
    os.environ.setdefault("SPARK_LOCAL_IP", "127.0.0.1")
    conf = {
        "spark.sql.shuffle.partitions": "8",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        # small files, many cores: a task for each row group
        "spark.sql.files.maxPartitionBytes": "1m",
        "spark.sql.files.openCostInBytes": "64k",
        "spark.driver.host": "127.0.0.1",
    } | conf
    return get_spark(master=f"local[{cores}]", **conf)
