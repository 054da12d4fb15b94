"""Ranks over whole tables without a window that gathers them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from graphloom.plans.staging import stage_table


def ranked(rows: DataFrame, *order: str | Column, name: str = "place") -> DataFrame:
    """Rows with their rank from 0 by ``order``, which must tell all rows apart.

    The rows are dealt into sorted ranges by sampled quantiles and written out, so that the ranges hold even if tasks
    are run again; counts of the ranges before, one row a partition, and ranks within one make the rank.
    """
    dealt = stage_table(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranked")
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_part").orderBy(*order)
    with_rank = dealt.withColumn("_rank", F.row_number().over(own) - 1).join(F.broadcast(bases), "_part")  # a row a partition
    return with_rank.withColumn(name, F.col("_base") + F.col("_rank")).drop("_part", "_rank", "_base")


def first_rows(rows: DataFrame, k: int, *order: str | Column) -> DataFrame:
    """The ``k`` first rows by ``order``, for a ``k`` that may grow with the table: no task holds them all."""
    return ranked(rows, *order, name="_place").where(F.col("_place") < k).drop("_place")
