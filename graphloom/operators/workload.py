"""Workload generators: seeded rounds of writes, hot sets, churn, and insert and query streams."""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, floor, gcd, isqrt

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType

from graphloom.functions.hashing import edge_key, edge_rank, mix, mix64, seeded
from graphloom.operators.graph import Graph
from graphloom.operators.ranking import first_rows, ranked
from graphloom.plans.staging import stage_table


def shuffled(rows: DataFrame, seed: int, *keys: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows with ``place``: their rank from 0, among all or those of equal ``by``, in an order that the seed alone decides.

    Distributed: counts of hash ranges first, then ranks within a range, so that no key gathers in one task. There are
    as many ranges as rows in one.
    """
    n_parts = 1 + isqrt(rows.count())
    h = rows.withColumn("_h", seeded(seed, *keys)).withColumn("_part", F.shiftright(F.shiftright("_h", 30) * n_parts, 30))
    ahead = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = h.groupBy(*by, "_part").count().select(*by, "_part", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("_base"))
    own = Window.partitionBy(*by, "_part").orderBy("_h", *keys)
    return h.withColumn("_r", F.row_number().over(own) - 1).join(bases, [*by, "_part"]).withColumn("place", F.col("_base") + F.col("_r")).drop("_h", "_part", "_r", "_base")


MIXES = {"id": (2, 0), "idm": (4, 2), "m100": (0, 1)}


def mixed_round(edges: DataFrame, kind: str, seed: int, round_: int) -> DataFrame:
    """``(src, dst, weight, action)``: disjoint REINSERT and MODIFY edges of one round; modified weights are drawn."""
    n = edges.count()
    re, mo = (n // x if x else 0 for x in MIXES[kind])
    rows = shuffled(edges, seed * 1000 + round_, "src", "dst").where(F.col("place") < re + mo)
    drawn = seeded(seed, F.lit(round_), "src", "dst") % 9900 / 100 + 1
    again = F.col("place") < re
    return rows.select("src", "dst", F.when(again, F.col("weight")).otherwise(drawn).alias("weight"), F.when(again, "REINSERT").otherwise("MODIFY").alias("action"))


def round_stats(rounds: DataFrame) -> DataFrame:
    re, mo = (F.count(F.when(F.col("action") == a, 1)) for a in ("REINSERT", "MODIFY"))
    return rounds.agg(re.alias("reinserts"), mo.alias("modifies"), (2 * re + mo).alias("transactions"))


def hot_edges(edges: DataFrame, fraction: float, seed: int) -> DataFrame:
    """The max(1, floor(fraction * E)) edges of least rank; ties by ends and weight."""
    k = max(1, floor(fraction * edges.count()))
    return edges.withColumn("rank", edge_rank("src", "dst", F.lit(seed))).transform(first_rows, k, "rank", "src", "dst", "weight")


def hot_rounds(fraction: float) -> int:
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    return ceil(5 / fraction)


def hot_plan(h: int, update_percent: int) -> tuple[int, int]:
    """How many reinserts and updates ``h`` transactions of a hot-set round hold; a reinsert is two transactions."""
    if update_percent not in (0, 20, 40, 60, 80, 100) or h < 0:
        raise ValueError("update_percent must be 0, 20, 40, 60, 80 or 100")
    re = 0 if update_percent == 100 else h // 2 if update_percent == 0 else (h * (100 - update_percent) + 100) // 200
    return re, h - 2 * re


def affine_positions(spark: SparkSession, n: int, available: int, offset: int, stride: int) -> DataFrame:
    """``(rank, position)``: distinct positions, by a stride that shares no factor with ``available``."""
    while gcd(stride, available) != 1:
        stride += 1
    return spark.range(n).select(F.col("id").alias("rank"), ((F.lit(offset) + F.col("id") * stride) % available).alias("position"))


def hot_updates(hot: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` updates of hot edges drawn with replacement by hash, with weights drawn the same way."""
    size = hot.count()
    numbered = shuffled(hot.select("src", "dst"), seed, "src", "dst").withColumnRenamed("place", "position")
    draws = hot.sparkSession.range(n).withColumn("h", mix64(F.col("id") + seed))
    draws = draws.select("id", F.pmod("h", F.lit(size)).alias("position"), (1 + F.pmod("h", F.lit(9900)) / 100).alias("weight"))
    return draws.join(numbered, "position").select(F.col("id").alias("seq"), "src", "dst", "weight")


def weighted_vertices(g: Graph, fraction: float, seed: int) -> DataFrame:
    """max(1, ceil(fraction * V)) vertices without replacement, by degree: least -ln(u) / degree first."""
    k = max(1, ceil(fraction * g.vertices.count()))
    u = (F.shiftright(seeded(seed, "id"), 8) + 1) / float((1 << 52) + 1)
    return first_rows(g.degrees().where("degree > 0").withColumn("key", -F.log(u) / F.col("degree")), k, "key", "id").select("id")


def edges_at(g: Graph, ids: DataFrame) -> DataFrame:
    """Edges with an end among ``ids``."""
    hot = ids.select("id")
    a = g.edges.join(hot.withColumnRenamed("id", "lo"), "lo", "left_semi")
    b = g.edges.join(hot.withColumnRenamed("id", "hi"), "hi", "left_semi")
    return a.unionByName(b).distinct()


def churn(g: Graph, seed: int, tries: int = 4096) -> DataFrame:
    """``(src, dst, new_dst, weight)``: each edge replaced by an absent one from the same source.

    In rounds, edges still without a new end draw some by hash and ask for the first whose edge is neither there nor
    taken; where several ask for the same pair the smallest gets it. Most edges are done after one round. Edges for
    which none of ``tries`` draws will do (their source knows all others) keep a null new_dst.
    """
    ids = stage_table(g.logical_ids(), "ranks").withColumnRenamed("id", "new_dst")
    n = g.vertices.count()
    e = left = stage_table(g.edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"), "edges")
    taken, t, step = None, 0, 4
    while t < tries and not left.isEmpty():
        drawn = left.withColumn("t", F.explode(F.sequence(F.lit(t), F.lit(min(t + step, tries) - 1)))).withColumn("logical_id", F.pmod(F.xxhash64(F.lit(seed), "src", "dst", "t"), F.lit(n)))
        found = drawn.join(ids, "logical_id").where("new_dst <> src and new_dst <> dst").withColumn("lo", F.least("src", "new_dst")).withColumn("hi", F.greatest("src", "new_dst"))
        found = found.join(g.edges.select("lo", "hi"), ["lo", "hi"], "left_anti")
        if taken is not None:
            found = found.join(taken.select("lo", "hi"), ["lo", "hi"], "left_anti")
        asked = found.groupBy("src", "dst").agg(F.min_by(F.struct("lo", "hi", "new_dst"), "t").alias("x"))
        won = asked.groupBy("x.lo", "x.hi").agg(F.min(F.struct("src", "dst", "x.new_dst")).alias("y")).select("lo", "hi", "y.*")
        won = stage_table(won, "taken")
        taken = won if taken is None else taken.union(won)
        left = stage_table(left.join(won.select("src", "dst"), ["src", "dst"], "left_anti"), "left")
        t, step = t + step, min(2 * step, 256)
    if taken is None:
        return e.select("src", "dst", F.lit(None).cast("long").alias("new_dst"), "weight")
    return e.join(taken.select("src", "dst", "new_dst"), ["src", "dst"], "left").select("src", "dst", "new_dst", "weight")


def split_updates(edges: DataFrame) -> DataFrame:
    """Each edge as a delete and then an insert of it: ``(seq, op, src, dst, weight)`` with seq twice that of the edge."""
    ops = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit("D").alias("op")), F.struct(F.lit(1).alias("k"), F.lit("U").alias("op"))))
    return edges.withColumn("x", ops).select((F.col("seq") * 2 + F.col("x.k")).alias("seq"), "x.op", "src", "dst", "weight")


def repeat_writes(edges: DataFrame, times: int) -> DataFrame:
    """The edges ``times`` over, the direction turned in every other pass."""
    rows = edges.withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    odd = F.col("turn") % 2 == 1
    return rows.select("turn", F.when(odd, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(odd, F.col("src")).otherwise(F.col("dst")).alias("dst"), "weight")


def general_split(edges: DataFrame, seed: int, share: float = 0.8) -> DataFrame:
    """``(…, part)``: ``load`` for the first share of the edges in seeded order, ``insert`` for the rest."""
    cut = floor(share * edges.count())
    return shuffled(edges, seed, "src", "dst").withColumn("part", F.when(F.col("place") < cut, "load").otherwise("insert")).drop("place")


def high_vertices(g: Graph, share: float, bound: int) -> DataFrame:
    """``(id, degree)``: of the ``share`` of vertices of highest degree those past ``bound``."""
    k = max(1, ceil(share * g.vertices.count()))
    return first_rows(g.degrees(), k, F.desc("degree"), "id").where(F.col("degree") > bound)


def by_degree(g: Graph, high: bool, share: float, bound: int) -> DataFrame:
    """Edges with both ends among :func:`high_vertices`, or both of a degree under ``bound``."""
    picked = high_vertices(g, share, bound) if high else g.degrees().where(F.col("degree") < bound)
    rows = g.edges
    for end in ("lo", "hi"):
        rows = rows.join(picked.select(F.col("id").alias(end)), end, "left_semi")
    return rows.select("lo", "hi", "weight")


def drawn_stream(g: Graph, n: int, seed: int, weighted: bool) -> DataFrame:
    """``(src, dst, weight, part)``: ``n`` draws of a vertex with replacement, evenly or by degree, each of which moves
    one more edge that starts there from ``load`` to ``insert``, in seeded order, while there are any."""
    pool = g.adjacency().select(F.col("src").alias("id"), "dst") if weighted else g.vertices.select("id")
    size = pool.count()
    numbered = shuffled(pool, seed, *pool.columns).select("id", "place")
    draws = g.edges.sparkSession.range(n).select((seeded(seed + 1, "id") % max(size, 1)).alias("place"))
    wanted = draws.join(numbered, "place").groupBy(F.col("id").alias("src")).agg(F.count("*").alias("draws"))
    e = shuffled(g.edges.select(F.col("lo").alias("src"), F.col("hi").alias("dst"), "weight"), seed, "src", "dst", by=("src",))
    insert = F.col("place") < F.coalesce("draws", F.lit(0))
    return e.join(wanted, "src", "left").select("src", "dst", "weight", F.when(insert, "insert").otherwise("load").alias("part"))


def ordered_split(rows: DataFrame, key: str, share: float = 0.8) -> DataFrame:
    """``(…, part)``: ``load`` up to the ``share`` of the range of ``key`` (a unique number from 0), ``insert`` after."""
    cut = floor(share * rows.count())
    return rows.withColumn("part", F.when(F.col(key) < cut, "load").otherwise("insert"))


def vertex_queries(g: Graph, ratio: float, seed: int) -> DataFrame:
    """floor(ratio * V) distinct vertices to probe, in seeded order: ``(seq, id)``."""
    k = floor(ratio * g.vertices.count())
    return shuffled(g.vertices, seed, "id").where(F.col("place") < k).select(F.col("place").alias("seq"), "id")


def edge_queries(edges: DataFrame, ratio: float, seed: int) -> DataFrame:
    """floor(ratio * E) distinct edges to probe, in seeded order: ``(seq, src, dst)``."""
    k = floor(ratio * edges.count())
    return shuffled(edges, seed, "src", "dst").where(F.col("place") < k).select(F.col("place").alias("seq"), "src", "dst")


def mixed_stream(g: Graph, seed: int, share: float = 0.8, n: int = 32) -> DataFrame:
    """``(batch, op, src, dst)``: the edges after the first ``share`` in ``n`` batches, and one query Q after each."""
    total = g.edges.count()
    start = floor(share * total)
    size = max(1, -(-(total - start) // n))
    e = shuffled(g.edges, seed, "lo", "hi").where(F.col("place") >= start)
    inserts = e.select(F.floor((F.col("place") - start) / size).alias("batch"), F.lit("U").alias("op"), F.col("lo").alias("src"), F.col("hi").alias("dst"))
    ids = shuffled(g.vertices, seed, "id").where(F.col("place") < n)
    return inserts.union(ids.select("place", F.lit("Q"), "id", F.lit(None).cast("long")))


def by_busiest_end(g: Graph, share: float = 0.1, high: bool = True) -> DataFrame:
    """``(lo, hi, busiest)``: the ``share`` of edges whose busier end has the highest (lowest) degree; ties by ends."""
    k = int(g.edges.count() * share)
    lo, hi = (g.degrees().select(F.col("id").alias(x), F.col("degree").alias(f"d_{x}")) for x in ("lo", "hi"))
    rows = g.edges.join(lo, "lo").join(hi, "hi").select("lo", "hi", F.greatest("d_lo", "d_hi").alias("busiest"))
    return first_rows(rows, k, F.desc("busiest") if high else F.col("busiest"), "lo", "hi")


def checksum(rows: DataFrame, *columns: str) -> DataFrame:
    """``(n, digest)`` of rows in whatever order."""
    return rows.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64(*columns)), F.lit(0)).alias("digest"))


@F.pandas_udf(LongType())
def _chained(values: pd.Series, starts: pd.Series) -> pd.Series:
    """For each list of values the chain ``h = mix(h ^ value)`` from its start on: numbers follow one another."""
    out = []
    for own, start in zip(values, starts):
        h = np.uint64(int(start) & (1 << 64) - 1)
        for x in np.asarray(own, np.int64).view(np.uint64):
            h = mix(h ^ x)
        out.append(int(np.asarray(h).view(np.int64)))
    return pd.Series(out)


def chained_checksum(rows: DataFrame, seed: int, *order: str, src: str = "src", dst: str = "dst", chunk: int = 1 << 16) -> DataFrame:
    """``(n, digest)`` of edges in an order: chunks of consecutive edges are chained each by itself, all at once, and
    then their digests one after the other; so it tells orders apart, as a chain over single edges does."""
    keyed = ranked(rows.withColumn("_key", F.col(src).bitwiseXOR(F.shiftleft(dst, 32))), *order).select("place", "_key", F.floor(F.col("place") / chunk).alias("chunk"))
    parts = keyed.groupBy("chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "_key"))), lambda x: x["_key"]).alias("keys"), F.count("*").alias("n"))
    parts = parts.select("chunk", "n", _chained("keys", F.lit(seed) + F.col("chunk")).alias("digest"))
    whole = parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("chunk", "digest"))), lambda x: x["digest"]).alias("digests"))  # a number a chunk
    return whole.select("n", _chained("digests", F.lit(seed)).alias("digest"))


def churn_digests(plan: DataFrame, seed: int) -> DataFrame:
    """``(n, operations, ordered)`` of a round of :func:`churn`: a digest of its new edges whatever their order, and
    one of the order in which a seeded shuffle replays them."""
    done = plan.where("new_dst is not null").withColumn("value", mix64(edge_key("src", "new_dst")))
    placed = shuffled(done, seed, "src", "dst")
    at = mix64(F.col("value").bitwiseXOR(mix64("place")))
    return placed.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor("value"), F.lit(0)).alias("operations"), F.coalesce(F.bit_xor(at), F.lit(0)).alias("ordered"))


def churn_rounds(g: Graph, rounds: int, seed: int) -> Iterator[tuple[DataFrame, Graph]]:
    """Round by round the plan of :func:`churn` and the graph after it; edges that found no replacement stay."""
    for r in range(1, rounds + 1):
        plan = stage_table(churn(g, seed * 1000 + r), "churn")
        to = F.coalesce("new_dst", "dst")
        edges = plan.select(F.least(F.col("src"), to).alias("lo"), F.greatest(F.col("src"), to).alias("hi"), "weight")
        g = Graph(g.vertices, stage_table(edges, "churned"))
        yield plan, g


def batches(rows: DataFrame, key: str, n: int = 32) -> DataFrame:
    """Rows in ``n`` consecutive batches of equal size by key (a unique number from 0)."""
    total = rows.count()
    return rows.withColumn("batch", F.floor(F.col(key) * n / total) + 1)
