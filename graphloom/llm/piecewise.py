"""Context-triggered piecewise hashing: chunk signatures between rolling-hash boundaries, compared by edit distance."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh32_intdigest

from graphloom.llm.common import id_text

#: Bytes that decide whether a chunk ends; chunks aimed at; the least block size; characters of a signature at most.
WINDOW, CHUNKS, LEAST_BLOCK, MAX_SIGNATURE = 7, 48, 4, 128
#: Signatures alike must share so long a run, or one is too short to tell; it keeps chance likeness out.
COMMON = 4
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
_FACTOR, _MIX = np.uint32(0x01000193), np.uint32(0x9E3779B1)


def block_size(n_bytes: int) -> int:
    """The least power of two that cuts so long a text into CHUNKS chunks or fewer, on the average."""
    size = LEAST_BLOCK
    while size * CHUNKS < n_bytes:
        size *= 2
    return size


def triggers(raw: bytes) -> np.ndarray:
    """For each byte a hash of the WINDOW bytes that end there (shorter at the start), evenly spread over 32 bits."""
    data = np.frombuffer(raw, np.uint8).astype(np.uint32) + np.uint32(1)
    # rolled[i] = sum of data[i - k] * FACTOR ** k
    rolled = data.copy()
    factor = np.uint32(1)
    with np.errstate(over="ignore"):
        for k in range(1, min(WINDOW, len(data))):
            factor = np.uint32(int(factor) * int(_FACTOR) & 0xFFFFFFFF)
            rolled[k:] += data[:-k] * factor
        rolled ^= rolled >> np.uint32(15)
        rolled *= _MIX
        rolled ^= rolled >> np.uint32(13)
        rolled *= _FACTOR
    return rolled


def signature(raw: bytes, ends: list[int]) -> str:
    """A character for each chunk, or COMMON where there are fewer chunks than that, as in texts that repeat one line:
    else two such texts would often be alike by chance."""
    ends = [e for e in ends if e < len(raw)] + [len(raw)]
    width = 1 if len(ends) >= COMMON else COMMON
    hashes = (xxh32_intdigest(raw[a:b]) for a, b in zip([0, *ends], ends))
    return "".join(ALPHABET[h >> 6 * i & 63] for h in hashes for i in range(width))


def fingerprint(text: str) -> str:
    """``size:signature:signature at twice the size``.

    The size follows from the text's length, and doubles while there are more than MAX_SIGNATURE chunks, as texts of
    repeated lines may have: signatures cover the whole text.
    """
    raw = text.encode("utf-8", "surrogatepass")
    if not raw:
        return f"{LEAST_BLOCK}::"
    size = block_size(len(raw))
    hashes = triggers(raw)
    limit = (1 << 32) // size
    ends = np.flatnonzero(hashes < limit)  # a boundary at twice the size is one at the size as well
    while len(ends) - (len(ends) > 0 and ends[-1] == len(raw) - 1) >= MAX_SIGNATURE:
        size *= 2
        limit = (1 << 32) // size
        ends = ends[hashes[ends] < limit]
    fewer = ends[hashes[ends] < limit // 2]
    return f"{size}:{signature(raw, (ends + 1).tolist())}:{signature(raw, (fewer + 1).tolist())}"


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over one of the strings."""
    if not a:
        return len(b)
    match: dict[str, int] = {}
    for i, c in enumerate(a):
        match[c] = match.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, distance = full, 0, len(a)
    for c in b:
        eq = match.get(c, 0)
        cross = eq | minus
        eq |= (eq & plus) + plus ^ plus
        up, down = minus | ~(eq | plus) & full, plus & eq
        if up & last:
            distance += 1
        elif down & last:
            distance -= 1
        up = up << 1 | 1
        plus, minus = (down << 1 | ~(cross | up)) & full, up & cross & full
    return distance


def likeness(a: str, b: str) -> float:
    """0 to 1 by the edit distance of signatures at the same block size; 0 where no size is shared, 1 for equals."""
    if a == b:
        return 1.0
    size_a, *signs_a = a.split(":")
    size_b, *signs_b = b.split(":")
    at_a = {int(size_a): signs_a[0], 2 * int(size_a): signs_a[1]}
    at_b = {int(size_b): signs_b[0], 2 * int(size_b): signs_b[1]}
    best = 0.0
    for size in at_a.keys() & at_b.keys():
        x, y = at_a[size], at_b[size]
        runs = {x[i : i + COMMON] for i in range(len(x) - COMMON + 1)}
        if min(len(x), len(y)) < COMMON or any(y[i : i + COMMON] in runs for i in range(len(y) - COMMON + 1)):
            best = max(best, 1.0 - edit_distance(x, y) / max(len(x), len(y), 1))
    return best


def with_next(docs: DataFrame, run_first, schema: str) -> DataFrame:
    """Rows in descending order of id, dealt by ranges of ids: ``bucket, guest, rank, spread`` and what ``run_first`` makes.

    Each bucket holds a range of ids and ends with a guest: the row that follows its last one, which is the greatest
    of the nearest lower bucket, or for the lowest bucket the greatest of all. Ranges come from approximate quantiles,
    so that buckets are even whatever the ids; a bucket of one id that many rows share, or of rows without an id, is cut
    further by a checksum of the text. A few numbers a bucket are gathered, and there are about as many buckets as
    partitions are set, times three. Texts are shuffled once.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = id_text(docs).withColumn("rank", F.coalesce("doc_id", F.lit(-(1 << 63)))).withColumn("spread", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    probs = [i / (3 * n) for i in range(1, 3 * n)]
    cuts = np.unique(np.array(id_text(docs).approxQuantile("doc_id", probs, 0.1 / n), np.float64))

    def place(ranks: np.ndarray) -> np.ndarray:
        return np.searchsorted(cuts, ranks.astype(np.float64), side="right")  # order holds, though large ids round

    def placed(ranks: np.ndarray, spread: np.ndarray, split: dict[int, int]) -> np.ndarray:
        """Buckets in order; one that is split gives as many as ``split`` says, by ranges of the checksum."""
        bucket = place(ranks)
        times = np.ones(len(cuts) + 1, np.int64)
        for b, k in split.items():
            times[b] = k
        return (np.cumsum(times) - times)[bucket] + (spread * times[bucket] >> 32)

    def tops(split: dict[int, int]) -> list:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ranks, spread = (batch.column(c).to_numpy() for c in ("rank", "spread"))
                own = placed(ranks, spread, split)
                order = np.lexsort((spread, ranks, own))
                first = np.flatnonzero(np.diff(own[order], prepend=-1))
                last = order[np.append(first[1:], len(own)) - 1] if len(own) else order
                cols = [own[last], ranks[last], spread[last], ranks[order[first]], np.diff(np.append(first, len(own)))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["bucket", "rank", "spread", "least", "n"])

        made = rows.select("rank", "spread").mapInArrow(run, "bucket long, rank long, spread long, least long, n long")
        return made.groupBy("bucket").agg(F.max(F.struct("rank", "spread")).alias("top"), F.min("least").alias("least"), F.sum("n").alias("n")).collect()

    found = tops({})
    even = max(1, sum(r["n"] for r in found) // (3 * n))
    split = {r["bucket"]: -(-r["n"] // even) for r in found if r["n"] > 2 * even and r["top"]["rank"] == r["least"]}
    top = {r["bucket"]: tuple(r["top"]) for r in (tops(split) if split else found)}
    filled = sorted(top)
    above = {top[b]: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in f"bucket long, guest boolean, {schema}".split(", ")]
        for batch in batches:
            ranks, spread = (batch.column(c).to_numpy() for c in ("rank", "spread"))
            own = pa.RecordBatch.from_arrays([pa.array(placed(ranks, spread, split), pa.int64()), pa.array(np.zeros(len(ranks), bool)), *run_first(batch)], names)
            yield own
            guests: dict[tuple[int, int], int] = {}
            text = own.column("text")
            for i, key in enumerate(zip(ranks.tolist(), spread.tolist())):
                if key in above and (key not in guests or text[i].as_py() < text[guests[key]].as_py()):
                    guests[key] = i  # of rows alike in both the first by text
            if guests:
                part = own.take(pa.array(list(guests.values())))
                yield pa.RecordBatch.from_arrays([pa.array([above[k] for k in guests], pa.int64()), pa.array([True] * len(guests)), *part.columns[2:]], names)

    dealt = rows.mapInArrow(deal, f"bucket long, guest boolean, {schema}")
    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "guest", F.desc("rank"), F.desc("spread"), "text")


def piecewise(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the first ``n_chars - n_chars // 2`` code points of the text and then the first
    ``n_chars // 2`` (or all) of the next document's, in descending order of doc_id; the first follows the last. Null
    texts are empty. Rows that repeat a doc_id follow one another by a checksum of their texts, from the greatest on,
    and then by text; null ids come last. A single row is its own next. Extra columns are not read; an empty table gives no rows.
    """

    def first(batch: pa.RecordBatch) -> list[pa.Array]:
        texts = ["" if x is None else x for x in batch.column("text").to_pylist()]
        return [batch.column("rank"), batch.column("spread"), batch.column("doc_id"), pa.array(texts, pa.string()), pa.array([fingerprint(x) for x in texts], pa.string())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        before = None
        for batch in batches:
            rows = []
            for now in zip(*(batch.column(c).to_pylist() for c in ("bucket", "guest", "doc_id", "text", "fingerprint"))):
                if before and not before[1] and before[0] == now[0]:
                    _, _, doc_id, text, own = before
                    half = len(text) // 2
                    edited = text[: len(text) - half] + now[3][:half]
                    made = fingerprint(edited)
                    digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
                    rows.append((doc_id, len(text), digest, own, made, likeness(own, made), likeness(own, now[4])))
                before = now
            cols = list(zip(*rows)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names)

    return with_next(docs, first, "rank long, spread long, doc_id long, text string, fingerprint string").mapInArrow(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
