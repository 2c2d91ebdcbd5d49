"""The queries of this package: name -> function of (spark, directory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{name}.parquet")


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    from .markup import markup_rows

    return markup_rows(_table(spark, root, "passages")).select("passage_id")


def p1_clean(spark: SparkSession, root: str) -> DataFrame:
    from .markup import cleaned

    return cleaned(_table(spark, root, "passages")).select("passage_id", "clean_text", "blocks")


def p1_editions(spark: SparkSession, root: str) -> DataFrame:
    """The reading text of whole editions, also of those that are not well-formed: of each choice the reading, no notes."""
    from .markup import cleaned

    return cleaned(_table(spark, root, "editions").select("edition_id", "content"), "content").select("edition_id", "clean_text", "blocks")


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    from .neardup import near_duplicates

    return near_duplicates(_table(spark, root, "passages"))


def p2_classes(spark: SparkSession, root: str) -> DataFrame:
    from .neardup import GroupedPrefixJoin

    out = GroupedPrefixJoin(_table(spark, root, "passages"), "passage_id", "file", "text", 3, 5, 10).classes()
    return out.withColumnRenamed("id", "passage_id")


def p2_links(spark: SparkSession, root: str) -> DataFrame:
    from .neardup import GroupedPrefixJoin

    return GroupedPrefixJoin(_table(spark, root, "passages"), "passage_id", "file", "text", 3, 5, 10).links().select("class_lo", "class_hi")


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    from .spans import shared_spans

    return shared_spans(_table(spark, root, "passages"))


def p3_shares(spark: SparkSession, root: str) -> DataFrame:
    from .spans import shared_shares

    return shared_shares(_table(spark, root, "passages"))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    from .unify import look_the_same

    return look_the_same(_table(spark, root, "passages"))


def p4_classes(spark: SparkSession, root: str) -> DataFrame:
    from .unify import classes

    return classes(_table(spark, root, "passages"))


def p4_unified(spark: SparkSession, root: str) -> DataFrame:
    from .unify import unify

    return unify(_table(spark, root, "passages").select("passage_id", "text"))


def p6_packed(spark: SparkSession, root: str) -> DataFrame:
    from .packing import pack, sized

    return pack(sized(_table(spark, root, "documents")), _table(spark, root, "containers"))


def p6_usage(spark: SparkSession, root: str) -> DataFrame:
    from .packing import usage

    return usage(p6_packed(spark, root))


def p6_placed(spark: SparkSession, root: str) -> DataFrame:
    """What lies in containers of each kind, without their numbers."""
    return p6_packed(spark, root).drop("container")


def p6_filled(spark: SparkSession, root: str) -> DataFrame:
    """Per kind, whether no container is too full, and whether a hundredth more than the least number of them is enough."""
    used = p6_packed(spark, root).groupBy("container_kind", "capacity", "container").agg(F.count("*").alias("pieces"), F.sum("tokens").alias("tokens"))
    sums = used.groupBy("container_kind", "capacity").agg(
        F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.count("*").alias("containers"), (F.max("tokens") <= F.col("capacity")).alias("none_too_full")
    )
    return sums.select("container_kind", "capacity", "pieces", "tokens", "none_too_full", (F.col("containers") <= F.ceil(F.col("tokens") / F.col("capacity")) * 1.01 + 1).alias("few"))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    from .leakage import leaked

    return leaked(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def p7_longest(spark: SparkSession, root: str) -> DataFrame:
    from .leakage import longest_leaks

    return longest_leaks(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def p7_clean(spark: SparkSession, root: str) -> DataFrame:
    from .leakage import without_leaks

    return without_leaks(_table(spark, root, "documents"), _table(spark, root, "benchmark"))


def p8_found(spark: SparkSession, root: str) -> DataFrame:
    from .residue import residue

    return residue(_table(spark, root, "documents")).select("doc_id")


def p8_messages(spark: SparkSession, root: str) -> DataFrame:
    from .residue import messages

    return messages(_table(spark, root, "documents"))


def p8_clean(spark: SparkSession, root: str) -> DataFrame:
    from .residue import without_residue

    return without_residue(_table(spark, root, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_clean, p1_editions, p2_found, p2_classes, p2_links, p3_found, p3_shares, p4_found, p4_classes, p4_unified, p6_packed, p6_placed, p6_filled, p6_usage, p7_found, p7_longest, p7_clean, p8_found, p8_messages, p8_clean,
    )
}
