"""Positions of rows in a total order, without one task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hazardframe.operators.common import materialise

_LOW = (1 << 33) - 1  # a monotonically increasing id is a partition number above 33 bits of position


def without_ties(rows: DataFrame, keys: list[Column]) -> tuple[DataFrame, list[Column]]:
    """Equal rows are told apart by their place (``_at``) in the table they come from, so ranges can split them."""
    return rows.withColumn("_at", F.monotonically_increasing_id()), [*keys, F.col("_at")]


def sorted_ranges(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """Partitions are consecutive ranges of the order, each sorted."""
    rows, keys = without_ties(rows, keys)
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_at")


def ranked(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """``rank`` (from 0) of each row: its place in its range and the sizes of the ranges before."""
    ranged = materialise(sorted_ranges(rows, keys).withColumn("_id", F.monotonically_increasing_id()), "ranked").withColumn("_part", F.shiftright("_id", 33))
    sizes = ranged.groupBy("_part").agg((F.max(F.col("_id").bitwiseAND(_LOW)) + 1).alias("_n"))  # one row per range
    before = sizes.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_off"))
    return ranged.join(F.broadcast(before), "_part").withColumn("rank", F.col("_off") + F.col("_id").bitwiseAND(_LOW)).drop("_part", "_id", "_off")
