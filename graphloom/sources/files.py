"""Edge lists, hot-set files, operation logs and result files."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from graphloom.functions.hashing import seeded
from graphloom.operators.ranking import ranked


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with ``file`` and ``seq``, the line's number within its file; files are read in splits.

    Rows of a split come in order, so counts of the splits before and ranks within one give the number.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    ahead = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("file", "block").count().select("file", "block", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    own = Window.partitionBy("file", "block").orderBy("row")
    return rows.withColumn("rank", F.row_number().over(own) - 1).join(bases, ["file", "block"]).select("file", (F.col("base") + F.col("rank")).alias("seq"), "value")


def edge_list(spark: SparkSession, path: str, limit: int = 0, strict: bool = True, ordered: bool = False) -> DataFrame:
    """``(src, dst, weight[, seq])`` from lines ``src dst [weight]``; no weight counts as 0, further fields are ignored.

    A line with fewer than two numbers is an error, or skipped unless ``strict``. Files are read in splits unless
    their order matters (``ordered``, or a limit on lines).
    """
    keep = ordered or limit > 0
    rows = _lines(spark, path) if keep else spark.read.text(path)
    fields = F.split(F.trim("value"), r"\s+")
    rows = rows.where(F.trim("value") != "").withColumn("f", fields)
    if limit:
        rows = rows.orderBy("file", "seq").limit(limit)
    number = lambda i, t: F.try_element_at("f", F.lit(i)).try_cast(t)
    src, dst = number(1, "long"), number(2, "long")
    if strict:
        fail = F.raise_error(F.concat(F.lit("invalid edge record: "), "value")).cast("long")
        src, dst = F.coalesce(src, fail), F.coalesce(dst, fail)
    else:
        rows = rows.where(src.isNotNull() & dst.isNotNull())
    return rows.select(src.alias("src"), dst.alias("dst"), F.coalesce(number(3, "double"), F.lit(0.0)).alias("weight"), *(["seq"] if keep else []))


def delimited_edges(spark: SparkSession, path: str, sep: str = ",", seed: int = 7) -> DataFrame:
    """``(seq, src, dst, weight)`` without comments and self-loops, ends in order; a missing weight is drawn by seed."""
    rows = _lines(spark, path).where((F.trim("value") != "") & ~F.trim("value").startswith("#")).withColumn("f", F.split("value", sep))
    a, b = F.trim(F.element_at("f", 1)).cast("long"), F.trim(F.element_at("f", 2)).cast("long")
    drawn = seeded(seed, "seq") % 9900 / 100 + 1
    weight = F.coalesce(F.try_element_at("f", F.lit(3)).try_cast("double"), drawn)
    return rows.select("seq", F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"), weight.alias("weight")).where("src <> dst")


def hot_set(spark: SparkSession, path: str) -> DataFrame:
    """``(src, dst, weight)`` from a hot-set file: header lines with # or =, then three numbers, the last a double's bits."""
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#") & ~F.contains("value", F.lit("=")))
    rows = rows.withColumn("ok", F.col("value").rlike(r"^\s*\d+\s+\d+\s+\d+\s*$")).withColumn("f", F.split(F.trim("value"), r"\s+"))
    checked = F.when(F.col("ok"), F.element_at("f", 1)).otherwise(F.raise_error(F.concat(F.lit("bad hot-set row: "), "value")).cast("string"))

    def bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"src": b.src, "dst": b.dst, "weight": b.raw.astype("uint64").to_numpy().view(np.float64)})

    return rows.select(checked.cast("long").alias("src"), F.element_at("f", 2).cast("long").alias("dst"), F.element_at("f", 3).alias("raw")).mapInPandas(bits, "src long, dst long, weight double")


def write_hot_set(rows: DataFrame, path: str, **header: object) -> None:
    """``src dst bits`` rows as files of a folder, and the header as its ``_header``, which readers of the rows pass over."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            raw = b.weight.to_numpy(np.float64).view(np.uint64)
            yield pd.DataFrame({"value": [f"{s} {d} {w}" for s, d, w in zip(b.src, b.dst, raw)]})

    spark = rows.sparkSession
    rows.select("src", "dst", "weight").mapInPandas(lines, "value string").write.text(path)
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_header")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray("".join(["# hot set\n", *(f"{k} = {v}\n" for k, v in header.items())]).encode()))
    finally:
        out.close()


def graph_log(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, op, src, dst, weight)`` from binary logs: text properties, then raw-deflate blocks of three columns.

    The stream holds for each block all sources, all destinations (unsigned 64-bit) and all weights (doubles); a
    negative weight deletes. A log is one file of 2 GB at most, read by one task block after block; larger ones come as
    several files.
    """
    return decode_graph_log(spark.read.format("binaryFile").load(path).select("content"))


def encode_graph_log(rows: DataFrame, block: int = 1 << 16) -> DataFrame:
    """``(content)``: for each partition of ``(op, src, dst, weight)`` a binary log of its rows, in their order."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        b = pd.concat([pd.DataFrame({"op": [], "src": [], "dst": [], "weight": []}), *batches])
        weight = np.where(b.op == "D", -1.0, b.weight.astype(float))
        columns = b.src.to_numpy(np.int64), b.dst.to_numpy(np.int64), weight
        body = []
        for at in range(0, len(b), block):
            packer = zlib.compressobj(wbits=-15)
            body.append(packer.compress(b"".join(c[at : at + block].tobytes() for c in columns)) + packer.flush())
        head = f"# GRAPHLOG\ninternal.edges.block_size = {block}\ninternal.edges.cardinality = {len(b)}\n__BINARY_SECTION_FOLLOWS"
        yield pd.DataFrame({"content": [head.encode() + b"".join(body)]})

    return rows.select("op", "src", "dst", "weight").mapInPandas(write, "content binary")


def decode_graph_log(contents: DataFrame) -> DataFrame:
    """The operations of binary logs ``(content)``; see :func:`graph_log`."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for raw in b.content:
                head, _, body = bytes(raw).partition(b"__BINARY_SECTION_FOLLOWS")
                if not head.lstrip().startswith(b"# GRAPHLOG"):
                    raise ValueError("not a graph log")
                props = dict(map(str.strip, x.split("=", 1)) for x in head.decode().splitlines() if "=" in x)
                size, total = int(props["internal.edges.block_size"]), int(props["internal.edges.cardinality"])
                raw = body if "internal.edges.begin" not in props else bytes(raw)[int(props["internal.edges.begin"]) :]
                raw, at, place = memoryview(raw), 0, 0
                while at < total:
                    stream, held = zlib.decompressobj(-15), []
                    while not stream.eof:  # piece by piece: what follows a block is not copied whole
                        if place >= len(raw):
                            raise ValueError("the graph log ends within a block")
                        held.append(stream.decompress(raw[place : place + (1 << 20)]))
                        place = min(place + (1 << 20), len(raw))
                    place -= len(stream.unused_data)
                    data = b"".join(held)
                    n = min(size, total - at)
                    src, dst, weight = (np.frombuffer(data, k, n, 8 * n * i) for i, k in enumerate(("<i8", "<i8", "<f8")))
                    yield pd.DataFrame({"seq": np.arange(at, at + n), "op": np.where(weight < 0, "D", "U"), "src": src, "dst": dst, "weight": weight})
                    at += n

    return contents.mapInPandas(read, "seq long, op string, src long, dst long, weight double")


def write_result(values: DataFrame, path: str, value: str) -> None:
    """``id value`` lines by id, doubles with 15 significant digits, infinity as such."""
    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            shown = [f"{x:.15g}" if isinstance(x, float) else str(x) for x in b[value]]
            yield pd.DataFrame({"value": [f"{i} {x}" for i, x in zip(b["id"], shown)]})

    values.select("id", value).orderBy("id").mapInPandas(lines, "value string").write.text(path)


def write_operations(ops: DataFrame, path: str) -> None:
    ops.write.parquet(path)


def operations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("seq long, op string, src long, dst long, weight double").parquet(path)


def dense_remap(edges: DataFrame) -> DataFrame:
    """``(id, dense)``: ids numbered from 0 in order of first appearance, sources before destinations of a row."""
    seen = edges.select((F.col("seq") * 2).alias("at"), F.col("src").alias("id")).union(edges.select(F.col("seq") * 2 + 1, "dst"))
    first = seen.groupBy("id").agg(F.min("at").alias("at"))
    return ranked(first, "at", name="dense").select("id", "dense")


SAMPLES = "time_sec double, rss_kb long, rss_mb double, hwm_kb long, hwm_mb double, vmsize_kb long, vmsize_mb double, last_marker string"
EVENTS = "time_sec double, marker string, line string"


def memory_samples(spark: SparkSession, path: str) -> DataFrame:
    """Memory over time from delimited files with a header."""
    return spark.read.schema(SAMPLES).option("header", True).csv(path)


def memory_events(spark: SparkSession, path: str) -> DataFrame:
    """Markers over time from delimited files with a header."""
    return spark.read.schema(EVENTS).option("header", True).csv(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.option("header", True).csv(path)


def write_memory_summary(samples: DataFrame, events: DataFrame, path: str, label: str = "run") -> None:
    """One JSON object: label, how long the samples span, peaks in kB and MB, how many there are, and the events."""
    peak = [x for c in ("rss_kb", "hwm_kb") for x in (F.coalesce(F.max(c), F.lit(0)).alias(f"peak_{c}"), F.coalesce(F.max(c) / 1024, F.lit(0.0)).alias(f"peak_{c[:-3]}_mb"))]
    one = samples.agg(F.lit(label).alias("label"), F.coalesce(F.max("time_sec"), F.lit(0.0)).alias("duration_sec"), *peak, F.count("*").alias("samples"))
    marked = events.where("marker is not null").agg(F.array_sort(F.collect_list(F.struct("time_sec", "marker", "line"))).alias("events"))  # a few a run
    one.crossJoin(marked).write.json(path)


#: Datasets by short name, each an edge list's path.
PRESETS: dict[str, str] = {}


def preset(spark: SparkSession, name: str, **options: object) -> DataFrame:
    """The edge list that was given a short name in PRESETS."""
    if name not in PRESETS:
        raise ValueError(f"unknown dataset {name}; known: {', '.join(sorted(PRESETS)) or 'none'}")
    return edge_list(spark, PRESETS[name], **options)
