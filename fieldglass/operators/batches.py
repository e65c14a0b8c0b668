"""Numbering of rows in a given order without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def positions(df: DataFrame, order: str, slices: int = 256) -> DataFrame:
    """Adds position (from 0) by `order`: rows are cut at quantiles, numbered within a slice and shifted by the slices before."""
    cuts = sorted({*(df.agg(F.percentile_approx(order, [i / slices for i in range(1, slices)], 10_000)).first()[0] or [])})
    at = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = df.withColumn("__slice", at)
    before = cut.groupBy("__slice").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("__slice").alias("__s"), F.coalesce(F.sum("n").over(Window.orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = cut.withColumn("__n", F.row_number().over(Window.partitionBy("__slice").orderBy(order)))
    return own.join(F.broadcast(before), F.col("__slice") == F.col("__s")).withColumn("position", F.col("__n") - 1 + F.col("__before")).drop("__slice", "__s", "__n", "__before")


def numbered(df: DataFrame, order: str, size: int = 500) -> DataFrame:
    """Adds batch: consecutive runs of `size` rows by `order`."""
    return positions(df, order).withColumn("batch", F.floor(F.col("position") / size)).drop("position")
