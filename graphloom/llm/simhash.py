"""SimHash near-duplicates: 64-bit fingerprints of 3-word shingles, linked by bit-sliced Hamming comparison."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh64_intdigest

from graphloom.llm.common import carried_schema, id_text, raw_texts
from graphloom.operators.components import components
from graphloom.plans.staging import stage_table

SEED, SHINGLE, RADIUS = 42, 3, 3
#: Distinct fingerprints that one bit-sliced block compares; larger buckets are cut into tiles that meet in pairs.
TILE = 2048
#: Rows gathered, over whole buckets, before a block is compared.
BLOCK_ROWS = 1024
#: Shingle hashes whose bits are unpacked at once.
PIECE = 1 << 17
#: Classes of equal fingerprints that are broadcast at most; each holds over this part of all rows, and HOT_ROWS.
HOT_CLASSES, HOT_ROWS = 10_000, 10_000


def shingle_hashes(raw: bytes) -> list[int]:
    """XXH64 of each 3-word shingle (of the whole sequence where there are fewer words); none without words."""
    words = raw.lower().split()  # for bytes: ASCII letters and the six ASCII spaces alone
    if len(words) <= SHINGLE:
        return [xxh64_intdigest(b" ".join(words), SEED)] if words else []
    joined = b" ".join(words)
    ends = list(accumulate(map((1).__add__, map(len, words))))
    return [xxh64_intdigest(joined[s : e - 1], SEED) for s, e in zip([0, *ends], ends[SHINGLE - 1 :])]


def fingerprints(raws: list[bytes]) -> np.ndarray:
    """The fingerprint of each text; a bit is 1 if more than half of the text's hashes have it."""
    out = np.zeros(len(raws), np.uint64)
    held: list[int] = []
    owners: list[tuple[int, int]] = []

    def flush() -> None:
        if held:
            bits = np.unpackbits(np.array(held, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            starts = np.array([s for _, s in owners])
            sums = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            counts = np.diff(np.append(starts, len(held)))
            packed = np.packbits(2 * sums > counts[:, None], axis=1, bitorder="little")
            out[[i for i, _ in owners]] = packed.reshape(-1).view(np.uint64)
        held.clear()
        owners.clear()

    for i, raw in enumerate(raws):
        hashes = shingle_hashes(raw)
        if len(hashes) > PIECE:  # very long texts: count bits piece by piece
            sums = np.zeros(64, np.int64)
            for at in range(0, len(hashes), PIECE):
                piece = np.array(hashes[at : at + PIECE], np.uint64).view(np.uint8).reshape(-1, 8)
                sums += np.unpackbits(piece, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            out[i] = np.packbits(2 * sums > len(hashes), bitorder="little").view(np.uint64)[0]
        elif hashes:
            if len(held) + len(hashes) > PIECE:
                flush()
            owners.append((i, len(held)))
            held.extend(hashes)
    flush()
    return out


def near_matrix(values: np.ndarray) -> np.ndarray:
    """Bit rows, a row for each distinct value: which other values differ from it in three bits or fewer.

    The values lie as 64 vertical bit planes. For many values at a time, each plane's mismatches go into carry-save
    counters (ones, twos, and a sticky bit from four on); a block stops once every distance is past the radius.
    """
    n = len(values)
    width = -(-n // 64)
    bits = np.unpackbits(values.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    padded = np.zeros((64, width * 64), np.uint8)
    padded[:, :n] = bits.T
    planes = np.packbits(padded, axis=1, bitorder="little").view(np.uint64)
    fill = np.ones(width * 64, np.uint8)
    fill[:n] = 0
    beyond = np.packbits(fill, bitorder="little").view(np.uint64)
    ones_mask = np.where(bits == 1, ~np.uint64(0), np.uint64(0))
    out = np.zeros((n, width), np.uint64)
    step = max(16, 16384 // width)
    for at in range(0, n, step):
        ask = ones_mask[at : at + step]
        ones = np.zeros((len(ask), width), np.uint64)
        twos, over = ones.copy(), np.broadcast_to(beyond, ones.shape).copy()
        for b in range(64):
            miss = planes[b][None, :] ^ ask[:, b : b + 1]
            carry = ones & miss
            ones ^= miss
            over |= twos & carry
            twos ^= carry
            # A value never leaves its own reach, so a block is done when each row has its own bit alone.
            if b % 8 == 7 and 23 <= b < 63 and int(np.bitwise_count(~over).sum()) == len(ask):
                break
        out[at : at + step] = ~over
    index = np.arange(n)
    out[index, index // 64] &= ~(np.uint64(1) << (index % 64).astype(np.uint64))
    return out


def stars(values: np.ndarray, nodes: np.ndarray) -> tuple[list[int], list[int]]:
    """Edges that join each group of linked values to its smallest node; a search over the bit rows, not all pairs."""
    near = near_matrix(values)
    left = np.flatnonzero(near.any(axis=1))
    src: list[int] = []
    dst: list[int] = []
    fresh = np.full(near.shape[1], ~np.uint64(0), np.uint64)
    seen = np.zeros(len(values), bool)
    for root in left:
        if seen[root]:
            continue
        group, at = [int(root)], 0
        seen[root] = True
        fresh[root // 64] &= ~(np.uint64(1) << np.uint64(root % 64))
        while at < len(group):
            found = near[group[at]] & fresh
            at += 1
            if found.any():
                fresh &= ~found
                new = np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))
                seen[new] = True
                group.extend(new.tolist())
        own = nodes[group]
        least = own.min()
        own = own[own != least]
        src.extend(own.tolist())
        dst.extend([int(least)] * len(own))
    return src, dst


def masks(n_values: int) -> list[int]:
    """Keys to share: the 64 bits in m blocks, of which any two values in reach agree on m - 3 together.

    More values take narrower blocks and more of them to agree on, so that buckets stay small at any size; each
    choice finds every pair.
    """
    m = 4 if n_values < 1 << 21 else 5 if n_values < 1 << 29 else 6
    cuts = [64 * i // m for i in range(m + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]
    return [sum(x) for x in combinations(blocks, m - RADIUS)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def document_fingerprints(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fp, *carry)``: the fingerprint as a signed 64-bit integer, in one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array(fingerprints(raw_texts(batch)).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made, *map(batch.column, carry)], ["doc_id", "fp", *carry])

    return id_text(docs, *carry).mapInArrow(run, "doc_id long, fp long" + carried_schema(docs, carry))


def fingerprint_links(classes: DataFrame, n_values: int) -> DataFrame:
    """Spanning edges ``(src, dst)`` among the nodes of distinct fingerprints ``(fp, node)`` within the radius."""
    spark = classes.sparkSession
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for t, m in enumerate(masks(n_values))])
    rows = classes.select("fp", "node", F.explode(tables).alias("k")).select("fp", "node", "k.t", "k.key")
    hot = rows.groupBy("t", "key").count().where(F.col("count") > TILE).select("t", "key", F.ceil(F.col("count") / F.lit(TILE)).cast("int").alias("tiles"))
    tile = F.pmod(F.xxhash64("fp"), F.coalesce("tiles", F.lit(1))).cast("int")
    meets = F.transform(F.sequence(F.lit(0), F.coalesce("tiles", F.lit(1)) - 1), lambda x: F.struct(F.least(x, "own").alias("a"), F.greatest(x, "own").alias("b")))
    dealt = rows.join(hot, ["t", "key"], "left").withColumn("own", tile).select("fp", "node", "t", "key", F.explode(meets).alias("m")).select("fp", "node", "t", "key", "m.a", "m.b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compare(values: np.ndarray, nodes: np.ndarray) -> pa.RecordBatch:
            # Several whole buckets make one block: a pair found across buckets is a true link as well.
            values, first = np.unique(values, return_index=True)
            src, dst = stars(values, nodes[first])
            return pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

        keys = ("t", "key", "a", "b")
        held: list[list[np.ndarray]] = []
        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in (*keys, "fp", "node")]
            held.append(cols)
            if sum(len(x[0]) for x in held) < BLOCK_ROWS:
                continue
            cols = [np.concatenate(x) for x in zip(*held)]
            change = np.flatnonzero(np.any([x[1:] != x[:-1] for x in cols[:4]], axis=0)) + 1
            start = 0
            for end in change[np.append(np.diff(change // BLOCK_ROWS) > 0, True)] if len(change) else []:
                yield compare(cols[4][start:end].view(np.uint64), cols[5][start:end])
                start = int(end)
            held = [[x[start:] for x in cols]]
        if held:
            cols = [np.concatenate(x) for x in zip(*held)]
            yield compare(cols[4].view(np.uint64), cols[5])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return dealt.repartition(n, "t", "key", "a", "b").sortWithinPartitions("t", "key", "a", "b").mapInArrow(run, "src long, dst long")


def simhash_components(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, fingerprint, component_id, *carry)`` for each row of ``docs``.

    Fingerprints that differ in three bits or fewer are linked; component_id is the smallest doc_id that can be
    reached. Equal fingerprints fold into one class before any comparison, so exact copies cost one row each and no
    pair; rows of the largest classes find their component without a shuffle, as there are HOT_CLASSES of these at
    most. Null, empty and blank texts have fingerprint zero and are linked like any other; a null id is never the
    smallest, and a component of such rows alone has none. Repeated rows stay, with equal results; extra columns are
    not read, and those in ``carry`` pass through; an empty table gives no rows. All pairs in reach are found: values
    that differ in three bits agree on whole blocks of bits, and buckets of any size are compared in tiles.
    """
    marked = stage_table(document_fingerprints(docs, carry), "fingerprints")
    classes = stage_table(marked.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")), "classes")
    total = classes.agg(F.sum("n"), F.count("*")).first()
    # Classes are known by their fingerprints, so that one without any id still links those on either side of it.
    linked = components(fingerprint_links(classes.select("fp", F.col("fp").alias("node")), total[1]))
    known = stage_table(classes.join(linked, classes.fp == linked.id, "left").select("fp", "node", "n", F.coalesce("component", "fp").alias("component")), "known")
    least = known.groupBy("component").agg(F.min("node").alias("component_id"))
    named = stage_table(known.join(least, "component").select("fp", "n", "component_id"), "named")
    hot = F.col("n") > max(HOT_ROWS, (total[0] or 0) // HOT_CLASSES)
    large = F.broadcast(named.where(hot).drop("n"))
    rows = marked.join(large, "fp").unionByName(marked.join(large, "fp", "left_anti").join(named.where(~hot).drop("n"), "fp"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", *carry)
