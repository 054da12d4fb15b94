"""Mixing sources to target weights by a low-discrepancy schedule over equal blocks of words.

DataFrame operations alone. Slots of the mix are points of the golden-ratio sequence; a point falls into the interval
of one source's share; slots rank within their source, and the slot of rank r takes block r, modulo their number, of
the source's shuffled documents.
"""

from __future__ import annotations

from math import isqrt

from pyspark.sql import DataFrame, Window, functions as F

from graphloom.plans.staging import stage_table

#: Words in a block, weights by order of source, how often a source may be taken, and slots that rank as one chunk.
BLOCK_WORDS, WEIGHTS, MAX_TIMES, CHUNK_SLOTS = 64, (5, 2, 1), 3, 1 << 16
#: The golden ratio's fraction, and that of it times 2 ** 20, so that slot numbers of 40 bits keep theirs.
GOLDEN, GOLDEN_20 = 0.6180339887498949, 0.607787409740351
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text"):
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sized: DataFrame) -> DataFrame:
    """``(source, source_size, target, lo, hi)`` from ``(source, size)``: each source's target and its part of [0, 1).

    Sources by code point, null last, weigh 5, 2, 1, repeating. The level at which the capped sources are full
    and all others share by weight is found by prefix sums in the order in which sources fill up. One row a source.
    """
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    weigh = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("at") % len(WEIGHTS) + 1).cast("int"))
    rows = by.withColumn("at", F.row_number().over(order) - 1).withColumn("weight", weigh.cast("long"))
    rows = rows.withColumn("cap", F.col("source_size") * MAX_TIMES).withColumn("fill", F.col("cap") / F.col("weight"))
    filling = Window.orderBy("fill", "at")
    below = filling.rowsBetween(Window.unboundedPreceding, -1)
    from_here = filling.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    rows = rows.withColumn("rest", F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0)))
    rows = rows.withColumn("level", F.col("rest") / F.sum("weight").over(from_here))
    # The first source in filling order that its share does not fill sets the level for all from it on.
    rows = rows.withColumn("level", F.min(F.when(F.col("level") <= F.col("fill"), F.struct("fill", "at", "level"))).over(every)["level"])
    rows = rows.withColumn("target", F.least(F.col("cap").cast("double"), F.col("weight") * F.col("level")))
    total = F.sum("source_size").over(every)
    upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("hi", F.sum("target").over(upto) / total)
    rows = rows.withColumn("lo", F.coalesce(F.lag("hi").over(Window.orderBy("at")), F.lit(0.0)))
    return rows.select("at", "source", "source_size", "target", "lo", F.when(F.col("at") == F.max("at").over(every), 1.0).otherwise(F.col("hi")).alias("hi"))


def schedule(spark, plan: DataFrame, n_slots: int, buckets: int) -> DataFrame:
    """``(at, rank)``: for each slot its source, and how many slots of that source came before it.

    Points meet intervals in equal buckets of [0, 1), an equi-join. Ranks come in two steps, counts of whole chunks
    of slots and then places within a chunk, so that no source's slots gather in one task.
    """
    i = F.col("id")
    high, low = F.floor(i / (1 << 20)), i % (1 << 20)
    point = high * F.lit(GOLDEN_20) + low * F.lit(GOLDEN)
    slots = spark.range(n_slots).withColumn("point", point - F.floor(point)).withColumn("bucket", F.floor(F.col("point") * buckets))
    tiles = plan.where("hi > lo").select("at", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * buckets), F.least(F.floor(F.col("hi") * buckets), F.lit(buckets - 1)))).alias("bucket"))
    found = slots.join(tiles, "bucket").where("point >= lo and point < hi").select("id", "at", F.floor(i / CHUNK_SLOTS).alias("chunk"))
    found = stage_table(found, "slots")
    before = Window.partitionBy("at").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = found.groupBy("at", "chunk").count().withColumn("base", F.coalesce(F.sum("count").over(before), F.lit(0)))
    place = Window.partitionBy("at", "chunk").orderBy("id")
    return found.withColumn("place", F.row_number().over(place) - 1).join(chunks, ["at", "chunk"]).select("at", (F.col("base") + F.col("place")).alias("rank"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken.

    Size counts words of the whole text (null: 0); target is that of the row's source; taken is how many words the
    mix takes from the row, repeats counted, at most MAX_TIMES times its size. A null source is one of its own, the
    last. Empty texts take nothing. Repeated rows are documents of their own, taken alike but for the end of a run.
    Extra columns are not read; an empty table gives no rows. Reruns agree: documents are shuffled by a digest of
    doc_id and size, and rows that agree in these are taken in a row; null ids are spread by size.
    """
    spark = docs.sparkSession
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count().alias("size"))
    sized = stage_table(sized, "sizes")
    plan = stage_table(targets(sized), "targets")
    total = plan.agg(F.sum("source_size")).first()[0] or 0
    n_slots = -(-total // block_words)
    buckets = 1024
    # Each source's documents in shuffled order, laid end to end. Running sums in two steps: over parts of the digest
    # range, and within a part, so that a source of any size is spread over many tasks.
    n_parts = 1 + isqrt(sized.count())  # as many as rows in one, so neither sum is long
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    laid = sized.join(plan.select("at", "source", "source_size"), sized.source.eqNullSafe(plan.source)).select("doc_id", "at", "size", plan.source_size, digest.alias("digest"))
    laid = laid.withColumn("part", F.floor(F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") * n_parts / (1 << 32)))
    parts = laid.groupBy("at", "part").agg(F.sum("size").alias("part_size"))
    ahead = Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("at", "part", F.coalesce(F.sum("part_size").over(ahead), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("at", "part").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = laid.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["at", "part"])
    laid = laid.select("doc_id", "at", "size", (F.col("part_start") + F.col("start")).alias("start")).withColumn("end", F.col("start") + F.col("size"))
    laid = stage_table(laid, "laid")
    n_blocks = F.ceil(F.col("source_size") / block_words)
    takes = (
        schedule(spark, plan, n_slots, buckets).join(plan.select("at", "source_size"), "at")
        .where(F.col("rank") < MAX_TIMES * n_blocks)
        .groupBy("at", (F.col("rank") % n_blocks).alias("block")).agg(F.count("*").alias("times"))
    )
    cut = laid.where("size > 0").select("at", "start", "end", F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))).alias("block"))
    overlap = F.least("end", (F.col("block") + 1) * block_words) - F.greatest("start", F.col("block") * block_words)
    taken = cut.join(takes, ["at", "block"]).groupBy(F.col("at").alias("of"), F.col("start").alias("begin")).agg(F.sum(overlap * F.col("times")).alias("taken"))
    # A row with words is known by its source and start.
    return (
        laid.join(taken, (F.col("at") == F.col("of")) & (F.col("start") == F.col("begin")) & (F.col("size") > 0), "left")
        .join(plan.select("at", "source_size", "target"), "at")
        .select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
    )
