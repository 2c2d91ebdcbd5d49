"""Identifiers of editions from catalogs above them, and links built with them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import quote_path, quote_plus
from .catalog import resolved

# Names of catalog files, the first wins within a directory.
CATALOG_NAMES = ("metadata.xml", "__cts__.xml")


def targets(entries: DataFrame, order: Column | None = None) -> DataFrame:
    """(catalog_dir, catalog_name, target_file, identifier): what each catalog says; of repeated entries the last by `order`.

    Entries without identifier or file path say nothing.  Paths are relative to
    the catalog's directory.
    """
    order = F.monotonically_increasing_id() if order is None else order
    filled = entries.filter("identifier <> '' and filepath <> ''").withColumn("_order", order)
    dir_ = F.coalesce(F.col("catalog_dir"), F.lit(""))
    path = F.when(F.col("filepath").startswith("/"), F.col("filepath")).otherwise(F.concat_ws("/", dir_, "filepath"))
    return (
        filled.select(resolved(dir_).alias("catalog_dir"), "catalog_name", resolved(path).alias("target_file"), "identifier", "_order")
        .groupBy("catalog_dir", "catalog_name", "target_file").agg(F.max_by("identifier", "_order").alias("identifier"))
    )


def identifiers(files: DataFrame, entries: DataFrame, order: Column | None = None, file: str = "file") -> DataFrame:
    """(file, identifier, catalog_dir): of the catalogs above a file that contain it, the nearest one's identifier, else null.

    One row for each distinct file.  The join is on the target, so that a
    catalog of any size is shuffled by file, not broadcast.
    """
    f = files.filter(F.col(file).isNotNull()).select(F.col(file).alias("file")).distinct().withColumn("target_file", resolved(F.col("file")))
    t = targets(entries, order)
    above = (F.col("catalog_dir") == "") | F.startswith("target_file", F.concat("catalog_dir", F.lit("/")))
    depth = F.when(F.col("catalog_dir") == "", 0).otherwise(F.size(F.split("catalog_dir", "/")))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, CATALOG_NAMES)), F.col("catalog_name")), F.lit(0))
    nearest = F.struct((-depth).alias("up"), F.when(rank == 0, 99).otherwise(rank).alias("rank"), "catalog_name")
    best = t.filter(above).groupBy("target_file").agg(F.min_by(F.struct("identifier", "catalog_dir"), nearest).alias("c")).select("target_file", "c.*")
    return f.join(best, "target_file", "left").select("file", "identifier", "catalog_dir")


def document_url(base: Column, identifier: Column, ref: Column, tree: Column) -> Column:
    """The document endpoint's URL; empty and null refs and trees are left out, and no identifier gives no URL."""
    part = lambda name, c: F.when(c != "", F.concat(F.lit(f"&{name}="), quote_plus(c)))
    query = F.concat(F.lit("resource="), quote_plus(identifier), F.coalesce(part("ref", ref), F.lit("")), F.coalesce(part("tree", tree), F.lit("")))
    return F.concat(F.rtrim(base, F.lit("/")), F.lit("/document/?"), query)


def reader_url(file: Column, ref: Column, tree: Column) -> Column:
    """The reader's own link to a passage: the file as a path, ref and tree as a query; those that are empty or null are left out."""
    pairs = F.concat_ws("&", *(F.when(c != "", F.concat(F.lit(f"{n}="), quote_plus(c))) for n, c in (("ref", ref), ("tree", tree))))
    return F.concat(F.lit("/passage/"), quote_path(file), F.when(pairs != "", F.concat(F.lit("?"), pairs)).otherwise(""))
