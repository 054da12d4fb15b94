"""Connected components by alternating stars; every node ends with the smallest id of its component."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from graphloom.plans.staging import drop_table, stage_table


#: Nodes that are broadcast at most, twice over; each is in more than this part of the links, and in HUB_LINKS.
HUBS, HUB_LINKS = 10_000, 100_000


def _star(edges: DataFrame, large: bool, links: int) -> DataFrame:
    """One star step over so many edges ``(u, v)`` with ``u > v``.

    Large: each node hooks its larger neighbours onto its smallest one. Small: each node hooks its smaller
    neighbours, and itself, onto the smallest one. Links of hubs find the smallest neighbour without a shuffle.
    """
    pairs = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = pairs.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    if links > HUB_LINKS:
        hub = F.col("n") > max(HUB_LINKS, links // HUBS)
        hubs = F.broadcast(least.where(hub).drop("n"))  # links count twice, so 2 * HUBS rows at most
        hooked = pairs.join(hubs, "u").unionByName(pairs.join(hubs, "u", "left_anti").join(least.where(~hub).drop("n"), "u"))
    else:
        hooked = pairs.join(least, "u")
    if large:
        out = hooked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = hooked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``(id, component)`` for every endpoint of ``edges``; component is the smallest id that can be reached.

    Edges are undirected; nulls and self-loops are ignored, repeats are harmless, an empty frame gives no rows.
    Rounds grow with the logarithm of the longest path. Every round is a written table, so that lineage stays flat,
    and the stop test is one aggregate row.
    """
    flat = edges.select(F.col(src).cast("long").alias("a"), F.col(dst).cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    now = stage_table(flat.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    before = mark(now)
    while True:
        after = stage_table(_star(_star(now, True, before[0]), False, before[0]), "stars")
        drop_table(now)
        now, seen = after, mark(after)
        if tuple(seen) == tuple(before):
            break
        before = seen
    roots = now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)
