"""Property graphs as DataFrames: vertices ever seen, canonical undirected edges, and their adjacency."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.ranking import ranked
from graphloom.plans.staging import stage_table


@dataclass
class Graph:
    """``vertices(id)`` and undirected ``edges(lo, hi, weight)`` with lo < hi (or lo = hi, if self-loops are kept)."""

    vertices: DataFrame
    edges: DataFrame

    @staticmethod
    def from_edges(edges: DataFrame, vertices: DataFrame | None = None, keep_self_loops: bool = False) -> Graph:
        """A simple graph from ``(src, dst[, weight][, seq])``: of the edges of a pair the last by seq wins."""
        weight = F.col("weight").cast("double") if "weight" in edges.columns else F.lit(0.0)
        order = F.col("seq") if "seq" in edges.columns else F.lit(0)
        rows = edges.where("src is not null and dst is not null")
        if not keep_self_loops:
            rows = rows.where("src <> dst")
        und = rows.groupBy(F.least("src", "dst").cast("long").alias("lo"), F.greatest("src", "dst").cast("long").alias("hi")).agg(F.max_by(weight, order).alias("weight"))
        if vertices is None:
            vertices = edges.select(F.explode(F.array(F.col("src").cast("long"), F.col("dst").cast("long"))).alias("id")).where("id is not null").distinct()
        return Graph(vertices, und)

    def adjacency(self) -> DataFrame:
        """Both directions of each edge: ``(src, dst, weight)``."""
        there = self.edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight")
        back = self.edges.where("lo <> hi").select(F.col("hi").alias("src"), F.col("lo").alias("dst"), "weight")
        return there.unionByName(back)

    def degrees(self) -> DataFrame:
        """``(id, degree)`` of every vertex, 0 without edges."""
        found = self.adjacency().groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))

    def logical_ids(self) -> DataFrame:
        """``(id, logical_id)``: the rank of each vertex by id, from 0, however far apart ids are."""
        return ranked(self.vertices, "id", name="logical_id")

    def vertex_ids(self, probes: DataFrame) -> DataFrame:
        """``(logical_id, id)`` for probed ranks; null where there is no such rank."""
        return probes.select("logical_id").join(self.logical_ids(), "logical_id", "left").select("logical_id", "id")

    def publish(self) -> Graph:
        """The graph as written tables, which kernels that follow read instead of the plan that made it."""
        return Graph(stage_table(self.vertices, "vertices"), stage_table(self.edges, "edges"))
