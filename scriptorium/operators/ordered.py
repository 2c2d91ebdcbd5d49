"""Numbers and neighbours within groups of any size.

A window over a group brings the whole group into one task.  Here the rows are
range-partitioned by group and order instead, so that a large group spreads
over many tasks; windows run within a partition's part of a group, and what
crosses the border of two parts comes from a table with one row for each part.
The partitioned rows are written once, since both sides must see one
partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import written


class OrderedGroups:
    """Rows of `df` grouped by `keys` and ordered by `order` within; order columns should make rows distinct.

    Rows with equal keys and order are in an arbitrary, but fixed sequence.
    Null keys form groups of their own.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str]) -> None:
        self.keys, self.order = keys, order
        spread = df.repartitionByRange(*keys, *order)
        self.rows = written(spread.withColumn("_part", F.spark_partition_id()).withColumn("_tie", F.monotonically_increasing_id()), "ordered")
        self.part = Window.partitionBy(*keys, "_part").orderBy(*order, "_tie")
        self.parts = Window.partitionBy(*keys).orderBy("_part")

    def _joined(self, rows: DataFrame, borders: DataFrame) -> DataFrame:
        b = borders.withColumnsRenamed({c: f"_b_{c}" for c in (*self.keys, "_part")})
        on: Column = F.col("_part") == F.col("_b__part")
        for k in self.keys:
            on = on & F.col(k).eqNullSafe(F.col(f"_b_{k}"))
        return rows.join(b, on).drop(*(f"_b_{c}" for c in (*self.keys, "_part")))

    def numbered(self, name: str = "place") -> DataFrame:
        """The rows with their number in the group, from 1."""
        counts = self.rows.groupBy(*self.keys, "_part").agg(F.count("*").alias("_n"))
        before = counts.select(*self.keys, "_part", (F.sum("_n").over(self.parts) - F.col("_n")).alias("_before"))
        rows = self.rows.withColumn("_k", F.row_number().over(self.part))
        return self._joined(rows, before).withColumn(name, (F.col("_k") + F.col("_before")).cast("long")).drop("_part", "_tie", "_k", "_n", "_before")

    def with_neighbours(self, column: str, before: str, after: str) -> DataFrame:
        """The rows with `column` of the row before and after in the group, null at its ends."""
        at = F.struct(*self.order, "_tie")
        ends = self.rows.groupBy(*self.keys, "_part").agg(F.min_by(column, at).alias("_first"), F.max_by(column, at).alias("_last"))
        borders = ends.select(*self.keys, "_part", F.lag("_last").over(self.parts).alias("_from"), F.lead("_first").over(self.parts).alias("_to"))
        rows = self.rows.withColumns({
            before: F.lag(column).over(self.part), after: F.lead(column).over(self.part),
            "_k": F.row_number().over(self.part), "_n": F.count("*").over(Window.partitionBy(*self.keys, "_part")),
        })
        joined = self._joined(rows, borders)
        return joined.withColumns({
            before: F.when(F.col("_k") == 1, F.col("_from")).otherwise(F.col(before)), after: F.when(F.col("_k") == F.col("_n"), F.col("_to")).otherwise(F.col(after)),
        }).drop("_part", "_tie", "_k", "_n", "_from", "_to")
