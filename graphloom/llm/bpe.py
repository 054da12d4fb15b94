"""BPE encoding over a table of distinct words, and decoding by an id-to-piece join, or lookup where ids are made.

Documents become blocks: the positions of their words as codes into the block's own distinct words. The distinct words
of all blocks meet by hash in one table, in which each is encoded once; its ids go back to the blocks and replace the
codes. A word crosses the cluster once for each block that has it, however often it stands there.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F
from tokenizers import Tokenizer
from xxhash import xxh32_intdigest

from graphloom.llm.blocks import block_table, pack, unpack
from graphloom.llm.common import give_back
from graphloom.plans.staging import stage_table

#: Bytes of text in a block (or one document, if that is longer), distinct words that one bucket of
#: the table takes, and bytes of text that are split at once.
BLOCK_TEXT, BUCKET_WORDS, PART_TEXT = 16 << 20, 150_000, 4 << 20
_BLOCKS = "doc_ids array<long>, counts binary, codes binary, n_words long, words binary"


def _join(words: pa.Array) -> bytes:
    return zstandard.compress(b"\n".join(words.cast(pa.binary()).to_pylist()), 3)  # no word has a line end


def split_block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words in each text, every word's code, and the hashes and words that codes stand for, in order of hash.

    Words are parted by the six ASCII spaces, across which the tokenizer forms no token.
    """
    texts = texts.cast(pa.string())
    counts, coded = [], []
    step = max(1, int(len(texts) * PART_TEXT // max(1, pc.sum(pc.binary_length(texts)).as_py() or 1)))
    for at in range(0, len(texts), step):
        part = texts[at : at + step]
        lists = pc.ascii_split_whitespace(part)
        flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
        there = pc.greater(pc.binary_length(flat), 0)
        counts.append(np.bincount(parent.filter(there).to_numpy().astype(np.int64), minlength=len(part)))
        coded.append(flat.filter(there).dictionary_encode())
    if not coded:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32), pa.array([], pa.string())
    one = pa.chunked_array(coded).unify_dictionaries()
    words = one.chunk(0).dictionary
    codes = np.concatenate([c.indices.to_numpy() for c in one.chunks])
    hashes = word_hashes(words.cast(pa.binary()).to_pylist())
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.uint32)
    rank[order] = np.arange(len(words))
    return np.concatenate(counts), rank[codes], hashes[order], words.take(pa.array(order))


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxh32_intdigest, words), np.uint32, len(words))


def encode_words(words: list[str], tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """How many ids each word has, and all ids."""
    lengths, flat = np.zeros(len(words), np.int64), []
    for at in range(0, len(words), 4096):
        for i, e in enumerate(tokenizer.encode_batch(words[at : at + 4096], add_special_tokens=False)):
            ids = e.ids
            lengths[at + i] = len(ids)
            flat += ids
    return lengths, np.array(flat, np.uint32)


@lru_cache(2)
def _load(saved: str) -> Tokenizer:
    """Once in a Python worker."""
    tokenizer = Tokenizer.from_str(saved)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def ragged(lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """Indices into values that lie in runs of ``lengths``, so as to take the runs ``picks`` one after the other."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[picks]
    ends = np.cumsum(own)
    return np.repeat(starts[picks] - (ends - own), own) + np.arange(int(ends[-1]) if len(ends) else 0)


def piece_table(tokenizer: Tokenizer) -> pa.Array:
    """Piece by id, each with the space that decoding puts after it; as long as the vocabulary, whatever the data."""
    size = max(tokenizer.get_vocab(with_added_tokens=True).values()) + 1
    return pa.array([((tokenizer.id_to_token(i) or "") + " ").encode() for i in range(size)], pa.binary())


def encode(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids, decoded)`` of each row: ids as little-endian unsigned 32-bit integers, and their text.

    The ids are those of the tokenizers library for the whole text with ``add_special_tokens=False`` and neither
    truncation nor padding, for a vocabulary that drops white space and has no decoder of its own; decoding keeps
    special tokens. Null and empty texts have no ids and decode to an empty string. Repeated rows and null ids stay; extra columns
    are not read; an empty table gives no rows. A text longer than a block is a block of its own.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        saved = f.read()
    if _load(saved).decoder is not None:
        raise ValueError("a vocabulary with a decoder of its own is not supported")

    def split(part: pa.RecordBatch) -> list:
        counts, codes, _, words = split_block(part.column("text"))
        ids = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        return [ids, pack(counts.astype("<u4")), pack(codes.astype("<u4")), len(words), _join(words)]

    # Bucketed by block, so that the codes, the largest part, are never shuffled.
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_table(docs, BLOCK_TEXT, split, _BLOCKS)
    total = blocks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(n, -(-total // BUCKET_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, words in zip(*(batch.column(c).to_pylist() for c in ("block", "words"))):
                held = zstandard.decompress(words).split(b"\n")
                if held == [b""]:
                    continue
                found, held = word_hashes(held), pa.array(held, pa.binary())
                bucket = (found.astype(np.uint64) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=n_buckets))
                made = [_join(held[a:b]) for a, b in zip(cuts, cuts[1:])]
                own = bucket[cuts[:-1]]
                cols = [pa.array(own), pa.array(np.full(len(own), block)), pa.array(made, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "words"])

    shipped = spark.sparkContext.broadcast(saved)  # the vocabulary file: a few MB, whatever the data

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        tokenizer = _load(shipped.value)

        def table(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
            lists = [zstandard.decompress(w).split(b"\n") for _, w in rows]
            coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
            lengths, ids = encode_words(coded.dictionary.cast(pa.string()).to_pylist(), tokenizer)
            codes, at, lens, idss = coded.indices.to_numpy().astype(np.int64), 0, [], []
            for x in lists:
                own = codes[at : at + len(x)]
                at += len(x)
                lens.append(pack(lengths[own].astype("<u4")))
                idss.append(pack(ids[ragged(lengths, own)].astype("<u4")))
            cols = [pa.array([now] * len(rows), pa.int64()), pa.array([b for b, _ in rows], pa.int64()), pa.array(lens, pa.binary()), pa.array(idss, pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "lengths", "ids"])

        now, held = None, []
        for batch in batches:
            for bucket, block, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "block", "words"))):
                if bucket != now and held:
                    yield table(held)
                    held = []
                    give_back()
                now = bucket
                held.append((block, words))
        if held:
            yield table(held)

    looked = (
        blocks.select("block", "words").mapInArrow(deal, "bucket long, block long, words binary")
        .repartition(n, "bucket").sortWithinPartitions("bucket", "block")
        .mapInArrow(look_up, "bucket long, block long, lengths binary, ids binary")
    )
    back = looked.groupBy("block").agg(F.collect_list(F.struct("bucket", "lengths", "ids")).alias("found"))
    joined = blocks.select("block", "doc_ids", "counts", "codes").join(back, "block", "left").select("doc_ids", "counts", "codes", "found")

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        pieces = piece_table(_load(shipped.value))
        for batch in batches:
            for row in range(batch.num_rows):
                doc_ids, counts, codes, found = (batch.column(c)[row].as_py() for c in ("doc_ids", "counts", "codes", "found"))
                found = sorted(found or [], key=lambda x: x["bucket"])
                lengths = np.concatenate([np.zeros(0, np.int64), *(unpack(x["lengths"], "<u4") for x in found)]).astype(np.int64)
                ids = np.concatenate([np.zeros(0, np.uint32), *(unpack(x["ids"], "<u4") for x in found)])
                counts, codes = unpack(counts, "<u4").astype(np.int64), unpack(codes, "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                start = 0
                while start < len(doc_ids):  # a few MB of words at a time
                    stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + 200_000)))
                    lo, hi = int(ends[start - 1]) if start else 0, int(ends[stop - 1])
                    own = codes[lo:hi]
                    got = ids[ragged(lengths, own)].astype("<u4")
                    tokens = np.add.reduceat(np.append(lengths[own], 0), np.minimum(ends[start:stop] - counts[start:stop] - lo, len(own))) if len(own) else np.zeros(stop - start, np.int64)
                    tokens = np.where(counts[start:stop] > 0, tokens, 0)
                    cuts = np.concatenate([[0], np.cumsum(tokens)])
                    text = pieces.take(pa.array(got))
                    offsets = np.frombuffer(text.buffers()[1], np.int32)[: len(got) + 1]
                    all_text, all_ids = (text.buffers()[2].to_pybytes() if len(got) else b""), got.tobytes()
                    pairs = list(zip(cuts.tolist(), cuts[1:].tolist()))
                    cols = [
                        pa.array(doc_ids[start:stop], pa.int64()), pa.array(tokens),
                        pa.array([all_ids[4 * a : 4 * b] for a, b in pairs], pa.binary()),
                        pa.array([all_text[offsets[a] : max(offsets[a], offsets[b] - 1)].decode() for a, b in pairs], pa.string()),
                    ]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "ids", "decoded"])
                    start = stop
                give_back()

    return joined.mapInArrow(put_back, "doc_id long, n_tokens long, ids binary, decoded string")


def decode(encoded: DataFrame, tokenizer_path: str) -> DataFrame:
    """``(doc_id, decoded)`` from ``(doc_id, ids)`` through a join of ids and pieces; null ids give null, empty ones an
    empty text; repeated rows and null doc_ids stay.

    The piece table, as long as the vocabulary, is broadcast; pieces then gather by row, so every token is shuffled.
    """
    spark = encoded.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        table = piece_table(_load(f.read())).to_pylist()
    pieces = spark.createDataFrame([(i, x.decode()) for i, x in enumerate(table)], "id long, piece string")
    rows = encoded.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("binary").alias("ids"), F.monotonically_increasing_id().alias("row"))
    rows = stage_table(rows, "encoded")  # so that rows keep their numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [np.frombuffer(x or b"", "<u4").astype(np.int64) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(held, pa.list_(pa.int64()))], ["row", "ids"])

    tokens = rows.select("row", "ids").mapInArrow(run, "row long, ids array<long>").select("row", F.posexplode("ids").alias("pos", "id"))
    put = tokens.join(F.broadcast(pieces), "id").groupBy("row").agg(F.array_sort(F.collect_list(F.struct("pos", "piece"))).alias("x"))
    text = F.array_join(F.transform("x", lambda t: t["piece"]), "")
    put = put.select("row", text.alias("t"))  # each piece ends with a space, the last one's goes
    made = F.when(F.col("ids").isNotNull(), F.coalesce(F.expr("left(t, length(t) - 1)"), F.lit("")))
    return rows.join(put, "row", "left").select("doc_id", made.alias("decoded"))
