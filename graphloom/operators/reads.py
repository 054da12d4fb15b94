"""Point and neighbourhood reads, each for a whole table of probes at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from graphloom.operators.graph import Graph


def has_vertex(g: Graph, probes: DataFrame) -> DataFrame:
    seen = g.vertices.withColumn("found", F.lit(True))
    return probes.join(seen, "id", "left").select(*probes.columns, F.coalesce("found", F.lit(False)).alias("found"))


def get_edges(g: Graph, probes: DataFrame) -> DataFrame:
    """``probes(src, dst, …)`` with the weight of the edge in either direction; null where there is none."""
    own = g.edges.select(F.col("lo").alias("_lo"), F.col("hi").alias("_hi"), F.col("weight").alias("found_weight"), F.lit(True).alias("found"))
    match = (F.least("src", "dst") == F.col("_lo")) & (F.greatest("src", "dst") == F.col("_hi"))
    return probes.join(own, match, "left").select(*probes.columns, F.coalesce("found", F.lit(False)).alias("found"), "found_weight")


def neighbors(g: Graph, probes: DataFrame) -> DataFrame:
    """``(id, dst, weight)``: a row for each neighbour of each probed id."""
    return probes.select("id").join(g.adjacency().withColumnRenamed("src", "id"), "id")


def sorted_neighbors(g: Graph, probes: DataFrame) -> DataFrame:
    return neighbors(g, probes).groupBy("id").agg(F.array_sort(F.collect_set("dst")).alias("neighbors"))


def until(g: Graph, probes: DataFrame, stop: Column) -> DataFrame:
    """``(id, stopped, first)``: whether a neighbour meets ``stop`` (over dst, weight), and the first by dst that does."""
    hit = neighbors(g, probes).groupBy("id").agg(F.min(F.when(stop, F.col("dst"))).alias("first"))
    return hit.select("id", F.col("first").isNotNull().alias("stopped"), "first")


def intersections(g: Graph, pairs: DataFrame) -> DataFrame:
    """``(a, b, common)``: how many neighbours each pair shares, by two equi-joins."""
    adj = g.adjacency()
    of_a = pairs.select("a", "b").join(adj.select(F.col("src").alias("a"), "dst"), "a")
    both = of_a.join(adj.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).groupBy("a", "b").agg(F.count("*").alias("common"))
    return pairs.select("a", "b").join(both, ["a", "b"], "left").select("a", "b", F.coalesce("common", F.lit(0)).alias("common"))


def aggregate_neighbors(g: Graph, values: DataFrame, message: Column, combine: Column) -> DataFrame:
    """Message passing: ``combine`` over ``message`` (of src, dst, weight and the columns of values) for each dst."""
    sent = g.adjacency().join(values.withColumnRenamed("id", "src"), "src").select("dst", message.alias("message"))
    return sent.groupBy(F.col("dst").alias("id")).agg(combine.alias("value"))


def neighbor_lists(g: Graph, probes: DataFrame) -> DataFrame:
    """``(id, neighbors)``: an array of (dst, weight) by dst for each probed id that has edges."""
    return neighbors(g, probes).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("neighbors"))


def intersection_lists(g: Graph, pairs: DataFrame) -> DataFrame:
    """``(a, b, dst)``: a row for each neighbour that a pair shares."""
    adj = g.adjacency()
    of_a = pairs.select("a", "b").join(adj.select(F.col("src").alias("a"), "dst"), "a")
    return of_a.join(adj.select(F.col("src").alias("b"), "dst"), ["b", "dst"]).select("a", "b", "dst")


def counted(rows: DataFrame, visible: Column) -> tuple[DataFrame, Observation]:
    """The rows, and an observation that holds how many a scan read and how many of them were ``visible``."""
    seen = Observation()
    return rows.observe(seen, F.count(F.lit(1)).alias("records"), F.count(F.when(visible, 1)).alias("visible")), seen
