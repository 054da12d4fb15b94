"""The graph kernels as loops of DataFrame steps; each step's state is a written table, so lineage stays flat."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.operators.components import components
from graphloom.operators.graph import Graph
from graphloom.plans.staging import drop_table, stage_bucketed, stage_table


def _need_root(g: Graph, root: int) -> None:
    if g.vertices.where(F.col("id") == root).isEmpty():
        raise ValueError(f"unknown root vertex {root}")


def default_root(g: Graph) -> int:
    return g.vertices.agg(F.min("id")).first()[0]


def pagerank(g: Graph, iterations: int = 10, damping: float = 0.85) -> DataFrame:
    """``(id, rank)`` after a fixed number of rounds; what vertices without edges hold is spread over all."""
    n = max(1, g.vertices.count())
    deg = stage_table(g.degrees(), "degrees")
    adj = stage_bucketed(g.adjacency().join(deg.withColumnRenamed("id", "src"), "src").select("src", "dst", (F.lit(1.0) / F.col("degree")).alias("share")), "src", "shares")
    now = stage_table(deg.select("id", "degree", F.lit(1.0 / max(n, 1)).alias("rank")), "ranks")
    for _ in range(iterations):
        lost = F.broadcast(now.agg((F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("rank"))), F.lit(0.0)) / n).alias("lost")))  # one row
        sent = adj.join(now.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") * F.col("share")).alias("got"))
        new = now.drop("rank").join(sent, "id", "left").crossJoin(lost)
        new = new.select("id", "degree", (F.lit((1 - damping) / n) + damping * F.col("lost") + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        after = stage_table(new, "ranks")
        drop_table(now)
        now = after
    return now.select("id", "rank")


def bfs(g: Graph, root: int) -> DataFrame:
    """``(id, level)``: hops from the root, -1 where it is not reached. An unknown root is an error."""
    _need_root(g, root)
    adj = stage_bucketed(g.adjacency().select("src", "dst"), "src", "adjacency")
    seen = front = stage_table(g.vertices.where(F.col("id") == root).select("id", F.lit(0).alias("level")), "front")
    level, fronts = 0, [front]
    while not front.isEmpty():
        level += 1
        reached = front.select(F.col("id").alias("src")).join(adj, "src").select(F.col("dst").alias("id")).distinct()
        front = stage_table(reached.join(seen.select("id"), "id", "left_anti").select("id", F.lit(level).alias("level")), "front")
        seen = seen.union(front)
        fronts.append(front)
        if level % 16 == 0:  # on graphs of many levels the union of fronts would grow without bound
            seen = stage_table(seen, "seen")
            for old in fronts[:-1]:
                drop_table(old)
            fronts = [seen, front]
    return g.vertices.join(seen, "id", "left").select("id", F.coalesce("level", F.lit(-1)).alias("level"))


def sssp(g: Graph, root: int, weighted: bool = True) -> DataFrame:
    """``(id, distance)``: least sum of weights from the root, infinite where it is not reached; only vertices that got
    nearer send on. Weights that are not finite are skipped. An unknown root is an error. There are as many rounds as
    vertices less one at most, which is all that a path can need; with a negative cycle distances are those reached then."""
    _need_root(g, root)
    weight = F.col("weight") if weighted else F.lit(1.0)
    inf = float("inf")
    adj = stage_bucketed(g.adjacency().select("src", "dst", weight.alias("weight")).where(~F.isnan("weight") & (F.abs("weight") < inf)), "src", "weights")
    now = stage_table(g.vertices.select("id", F.when(F.col("id") == root, 0.0).otherwise(inf).alias("distance"), (F.col("id") == root).alias("fresh")), "distances")
    for _ in range(g.vertices.count() - 1):
        if now.where("fresh").isEmpty():
            break
        sent = now.where("fresh").select(F.col("id").alias("src"), "distance").join(adj, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("distance") + F.col("weight")).alias("offer"))
        new = now.join(sent, "id", "left").select("id", F.least("distance", "offer").alias("distance"), F.coalesce(F.col("offer") < F.col("distance"), F.lit(False)).alias("fresh"))
        after = stage_table(new, "distances")
        drop_table(now)
        now = after
    return now.select("id", "distance")


def wcc(g: Graph) -> DataFrame:
    """``(id, component)``: the smallest id of each vertex's component."""
    found = components(g.edges, "lo", "hi")
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def cdlp(g: Graph, rounds: int = 10) -> DataFrame:
    """``(id, label)`` by synchronous label propagation: the most frequent label of the neighbours, ties to the
    smallest; without neighbours a vertex keeps its own. Counts fold before the shuffle, so hubs do no harm."""
    adj = stage_bucketed(g.adjacency().select("src", "dst"), "dst", "adjacency")
    now = stage_table(g.vertices.select("id", F.col("id").alias("label")), "labels")
    for _ in range(rounds):
        counts = adj.join(now.withColumnRenamed("id", "dst"), "dst").groupBy("src", "label").agg(F.count("*").alias("n"))
        best = counts.groupBy(F.col("src").alias("id")).agg(F.min(F.struct((-F.col("n")).alias("n"), "label"))["label"].alias("new"))
        after = stage_table(now.join(best, "id", "left").select("id", F.coalesce("new", "label").alias("label"), (F.coalesce("new", "label") != F.col("label")).alias("changed")), "labels")
        drop_table(now)
        now = after.select("id", "label")
        if after.where("changed").isEmpty():
            break
    return now


def triangles(g: Graph) -> DataFrame:
    """``(id, triangles)`` of vertices in triangles. Edges point from the lower to the higher (degree, id), which bounds
    how many leave a hub; each triangle is found once."""
    deg = g.degrees()
    lo, hi = deg.select(F.col("id").alias("lo"), F.col("degree").alias("d_lo")), deg.select(F.col("id").alias("hi"), F.col("degree").alias("d_hi"))
    first = F.struct("d_lo", "lo") < F.struct("d_hi", "hi")
    e = g.edges.where("lo <> hi").join(lo, "lo").join(hi, "hi")
    e = stage_table(e.select(F.when(first, F.col("lo")).otherwise(F.col("hi")).alias("u"), F.when(first, F.col("hi")).otherwise(F.col("lo")).alias("v")), "oriented")
    wedges = e.join(e.select("u", F.col("v").alias("w")), "u").where("v <> w")
    found = wedges.join(e.select(F.col("u").alias("v"), F.col("v").alias("w")), ["v", "w"])
    return found.select(F.explode(F.array("u", "v", "w")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def triangle_count(g: Graph) -> DataFrame:
    return triangles(g).agg((F.coalesce(F.sum("triangles"), F.lit(0)) / 3).cast("long").alias("triangles"))


def lcc(g: Graph) -> DataFrame:
    """``(id, lcc)``: twice the triangles over degree * (degree - 1); 0 under two neighbours."""
    d = F.col("degree")
    rows = g.degrees().join(triangles(g), "id", "left")
    return rows.select("id", F.when(d > 1, 2.0 * F.coalesce("triangles", F.lit(0)) / (d * (d - 1))).otherwise(0.0).alias("lcc"))


def component_numbers(labels: DataFrame) -> DataFrame:
    """Components numbered 0 up by smallest id, with their sizes; the order is over one row a component."""
    from pyspark.sql import Window

    sizes = labels.groupBy("component").agg(F.count("*").alias("size"))
    return sizes.select((F.row_number().over(Window.orderBy("component")) - 1).alias("number"), "component", "size")


KERNELS = {"pr": pagerank, "bfs": bfs, "sssp": sssp, "wcc": wcc, "lcc": lcc, "cdlp": cdlp, "tc": triangle_count}


def run_all(g: Graph, names: str = "all", root: int | None = None) -> dict[str, DataFrame]:
    """Several kernels over one graph."""
    chosen = list(KERNELS) if names == "all" else names.split(",")
    root = default_root(g) if root is None else root
    return {k: KERNELS[k](g, root) if k in ("bfs", "sssp") else KERNELS[k](g) for k in chosen}
