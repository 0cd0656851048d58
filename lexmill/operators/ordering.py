"""Orders over groups of any size: numbering without one task for a group, as-of joins without pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexmill.session import cut


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Adds the place of each row within its group, from 1, in a strict order.

    Rows are sorted over the cluster by group and order; each partition numbers its own rows and starts where the ones
    before it ended, so a group of any size is spread over many tasks. The sorted rows are written out (checkpoint): the
    counts and the numbers must see the same partitions.
    """
    part, within = F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")
    rows = cut(df.orderBy(*group, *order).select("*", part, within))
    counts = rows.groupBy(*group, "_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_part").alias("_p"), (before - F.col("_first") + 1).alias("_add"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    joined = rows.join(starts, same)
    return joined.withColumn(name, (F.col("_row") + F.col("_add")).cast("int")).drop("_part", "_row", "_p", "_add", *[f"_g{i}" for i in range(len(group))])


def as_of(points: DataFrame, marks: DataFrame, key: list[str], at: str, value: str) -> DataFrame:
    """Adds the value of the last mark at or before each point of its key; null before the first.

    points: key, at and more. marks: key, at, value. Union, one sort by key and place, carried forward: no pair of point
    and mark is formed.
    """
    kind = marks.schema[value].dataType
    left = points.select(*points.columns, F.lit(None).cast(kind).alias("_v"), F.lit(1).alias("_side"))
    right = marks.select(*[F.col(c) if c in [*key, at] else F.lit(None).cast(points.schema[c].dataType).alias(c) for c in points.columns], F.col(value).alias("_v"), F.lit(0).alias("_side"))
    w = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return left.unionByName(right).withColumn(value, F.last("_v", ignorenulls=True).over(w)).where(F.col("_side") == 1).drop("_v", "_side")
