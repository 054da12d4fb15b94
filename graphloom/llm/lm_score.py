"""Masked pseudo-likelihood: a window network predicts each token from both sides; summed log-probabilities score texts.

A token is predicted from the two tokens on either side of it by two networks, one for each ring of the window: the
neighbours at distance 1, left and right, and those at distance 2. Each embeds the classes of its two neighbours, goes
through a hidden layer and a softmax over target classes; the rings' distributions are mixed. Frequent words are target
classes of their own; any other word has its class's probability times its share of it, by counts of the whole corpus,
so the probabilities of all words of the corpus sum to 1 in every window.

The networks are numpy alone and learn from every window of every document in every round. Windows that agree in
neighbours and target fold into one with a count, which loses nothing: a step over the folded windows is a step over
all. Folded windows are dealt by their neighbours, not by where they came from, and gradients are summed as whole
numbers, so the weights, and the scores, do not depend on how the input is split.

Documents become blocks of codes into the block's own distinct words. These meet by hash in a table of all words of the
corpus with their counts, and each word's count goes back to the blocks that have it. Target classes grow with the
corpus, as the square root of its distinct words.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.blocks import block_table, pack, unpack
from graphloom.llm.bpe import _join, word_hashes
from graphloom.llm.common import give_back, id_text, one_thread
from graphloom.plans.staging import stage_table

#: Words that are targets of their own, at least; words that count by themselves as neighbours, and classes by ending
#: for all others: so many at least and at most.
LEAST_OWN, LEAST_NEAR, MOST_NEAR = 256, 64, 256
#: Bytes of text in a block (or one document, if that is longer), and distinct words that one bucket of the table takes.
BLOCK_TEXT, BUCKET_WORDS = 6 << 20, 75_000
#: Distances of the neighbours that a network sees, width of the networks, training rounds, each over every window, and
#: the first and last step size.
RINGS, WIDTH, ROUNDS, RATES = (1, 2), 16, 16, (0.3, 0.05)
#: Contexts whose values for all targets fit the processor's cache, tokens worked on at once, and tokens a shard.
ROWS, PIECE, SHARD_TOKENS = 128, 1 << 17, 1 << 20
#: Gradients that reach the driver at most, after sums in as many tasks; and what one counts as in whole numbers.
SUMS, UNIT = 32, 2.0**44
#: Weights of the first ring that are tried.
MIXES = tuple(i / 8 for i in range(1, 8))
_BLOCKS = "doc_ids array<long>, counts binary, codes binary, n_words long, words binary, n binary"
_CODED = "doc_ids array<long>, counts binary, codes binary, near binary, classes binary, n binary"


def class_counts(kinds: int) -> tuple[int, int, int]:
    """For a corpus of so many distinct words: words that are targets of their own, words that count by themselves as
    neighbours, and classes by ending."""
    near = min(max(LEAST_NEAR, round(kinds ** (1 / 3))), MOST_NEAR)
    return max(LEAST_OWN, round(kinds**0.5)), near, near


@dataclass
class Vocabulary:
    """What classes are made of: the words that have one of their own, and the tokens in every target class. It is as
    long as there are classes; the counts of the words are in the table."""

    top: dict[str, int]
    own: int
    near: int
    ends: int
    total: np.ndarray

    @property
    def targets(self) -> int:
        return self.own + self.ends

    @property
    def sides(self) -> int:
        """Classes of a neighbour, of which the last stands past either end of a text."""
        return self.near + self.ends + 1

    def lookup(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class as a neighbour and as a target of each word."""
        return word_classes(words, self.top, self.near, self.ends), word_classes(words, self.top, self.own, self.ends)


def word_classes(words: list[str], top: dict[str, int], own: int, ends: int) -> np.ndarray:
    """Classes of words: that of one of the ``own`` first of ``top``, or from there on one of ``ends`` by the last two
    letters."""
    known: dict[str, int] = {}
    out = np.zeros(len(words), np.int64)
    for i, w in enumerate(words):
        if (c := top.get(w, own)) >= own and (c := known.get(w[-2:])) is None:
            c = known[w[-2:]] = own + zlib.crc32(w[-2:].encode("utf-8", "surrogatepass")) % ends
        out[i] = c
    return out


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """Words of each text, parted by ASCII space: how many, and all of them, coded; the words coded are lower-cased."""
    lists = pc.ascii_split_whitespace(texts)
    flat, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    there = pc.greater(pc.binary_length(flat), 0)
    counts = np.bincount(parent.filter(there).to_numpy().astype(np.int64), minlength=len(texts))
    coded = flat.filter(there).dictionary_encode()
    return counts, pa.DictionaryArray.from_arrays(coded.indices, pc.utf8_lower(coded.dictionary))


def split_block(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Words in each text, every word's code, how often each code stands, and the words of codes, in order of hash."""
    counts, coded = split_words(texts)
    low = coded.dictionary.dictionary_encode()  # words that differ in case alone are one
    words = low.dictionary.cast(pa.binary())
    hashes = word_hashes(words.to_pylist())
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(words), np.int64)
    rank[order] = np.arange(len(words))
    codes = rank[low.indices.to_numpy()][coded.indices.to_numpy()]
    return counts, codes, np.bincount(codes, minlength=len(words)), words.take(pa.array(order))


def _words(blob: bytes) -> list[bytes]:
    return zstandard.decompress(blob).split(b"\n")


def word_table(blocks: DataFrame) -> DataFrame:
    """``(bucket, block, n, words, kinds)``: for every bucket a row with all its words and their counts over the whole
    corpus, and one for each block that has such words, with the counts of those, in order of hash."""
    n_parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n_buckets = max(n_parts, -(-(blocks.agg(F.sum("n_words")).first()[0] or 0) // BUCKET_WORDS))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i in range(batch.num_rows):
                block, words, n = (batch.column(c)[i].as_py() for c in ("block", "words", "n"))
                held, n = _words(words), unpack(n, "<u4")
                bucket = (word_hashes(held).astype(np.uint64) * np.uint64(n_buckets) >> np.uint64(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=n_buckets))
                held = pa.array(held, pa.binary())
                own, pairs = bucket[cuts[:-1]], list(zip(cuts, cuts[1:]))
                cols = [pa.array(own), pa.array(np.full(len(own), block)), pa.array([_join(held[a:b]) for a, b in pairs], pa.binary()), pa.array([pack(n[a:b]) for a, b in pairs], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["bucket", "block", "words", "n"])
                give_back()

    def table(bucket: int, rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
        lists = [_words(w) for _, w, _ in rows]
        coded = pa.array([w for x in lists for w in x], pa.binary()).dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        total = np.zeros(len(coded.dictionary), np.int64)
        np.add.at(total, codes, np.concatenate([unpack(n, "<u4") for _, _, n in rows]).astype(np.int64))
        ends = np.cumsum([len(x) for x in lists])
        back = [pack(total[codes[e - len(x) : e]].astype("<i8")) for x, e in zip(lists, ends)]
        cols = [
            pa.array([bucket] * (len(rows) + 1), pa.int64()), pa.array([None, *(b for b, _, _ in rows)], pa.int64()), pa.array([pack(total.astype("<i8")), *back], pa.binary()),
            pa.array([_join(coded.dictionary), *[None] * len(rows)], pa.binary()), pa.array([len(total)] + [0] * len(rows), pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(cols, ["bucket", "block", "n", "words", "kinds"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, held = None, []
        for batch in batches:
            for i in range(batch.num_rows):
                bucket, *row = (batch.column(c)[i].as_py() for c in ("bucket", "block", "words", "n"))
                if bucket != now and held:
                    yield table(now, held)
                    held = []
                    give_back()
                now = bucket
                held.append(tuple(row))
        if held:
            yield table(now, held)

    dealt = blocks.where("n_words > 0").select("block", "words", "n").mapInArrow(deal, "bucket long, block long, words binary, n binary")
    counted = dealt.repartition(n_parts, "bucket").sortWithinPartitions("bucket", "block")
    return stage_table(counted.mapInArrow(count, "bucket long, block long, n binary, words binary, kinds long"), "words")


def learn_vocabulary(table: DataFrame) -> Vocabulary:
    """The classes for a table of words. A few numbers a class are gathered."""
    held = table.where("block is null")
    tops, near, ends = class_counts(held.agg(F.sum("kinds")).first()[0] or 0)

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
                n = unpack(n, "<i8")
                words = np.array(_words(words), object)
                least = np.partition(n, -tops)[-tops] if len(n) > tops else 0
                pick = np.flatnonzero(n >= least)
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in words[pick]], pa.string()), pa.array(n[pick])], ["word", "n"])

    best = held.select("words", "n").mapInArrow(most, "word string, n long").orderBy(F.desc("n"), "word").limit(tops).collect()
    top = {r["word"]: i for i, r in enumerate(best)}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(tops + ends, np.int64)
        for batch in batches:
            for words, n in zip(batch.column("words").to_pylist(), batch.column("n").to_pylist()):
                np.add.at(total, word_classes([w.decode() for w in _words(words)], top, tops, ends), unpack(n, "<i8"))
        there = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(total[there])], ["c", "n"])

    total = np.zeros(tops + ends, np.int64)
    for c, n in held.select("words", "n").mapInArrow(sums, "c long, n long").groupBy("c").agg(F.sum("n")).collect():
        total[c] = n
    return Vocabulary(top, tops, near, ends, total)


def code(docs: DataFrame) -> tuple[DataFrame, Vocabulary]:
    """Blocks of documents, with classes and count in the corpus of each of a block's distinct words; and the vocabulary."""

    def split(part: pa.RecordBatch) -> list:
        counts, codes, n, words = split_block(part.column("text"))
        ids = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
        return [ids, pack(counts.astype("<u4")), pack(codes.astype("<u4")), len(words), _join(words), pack(n.astype("<u4"))]

    blocks = block_table(docs, BLOCK_TEXT, split, _BLOCKS)
    table = word_table(blocks)
    vocabulary = learn_vocabulary(table)
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as long as there are classes

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                words, found = (batch.column(c)[row].as_py() for c in ("words", "found"))
                n = np.concatenate([np.zeros(0, np.int64), *(unpack(x["n"], "<i8") for x in sorted(found or [], key=lambda x: x["bucket"]))])
                near, classes = shipped.value.lookup([w.decode() for w in _words(words)] if len(n) else [])
                cols = [pa.array([pack(x)], pa.binary()) for x in (near.astype("<u4"), classes.astype("<u4"), n.astype("<i8"))]
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(row, 1) for c in ("doc_ids", "counts", "codes")), *cols], ["doc_ids", "counts", "codes", "near", "classes", "n"])
                give_back()

    back = table.where("block is not null").groupBy("block").agg(F.collect_list(F.struct("bucket", "n")).alias("found"))
    joined = blocks.select("block", "doc_ids", "counts", "codes", "words").join(back, "block", "left").drop("block")
    return stage_table(joined.mapInArrow(look_up, _CODED), "coded"), vocabulary


def pieces(counts: np.ndarray, near: np.ndarray, sides: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Places of tokens, some at a time, and for each ring their contexts: the left neighbour's class times ``sides``
    and the right one's. Neighbours past an end of the text have the last class. ``near`` has a class for each token."""
    ends = np.cumsum(counts)
    for a in range(0, len(near), PIECE):
        at = np.arange(a, min(a + PIECE, len(near)))
        owner = np.searchsorted(ends, at, side="right")
        first, last = (ends - counts)[owner], ends[owner] - 1
        made = []
        for d in RINGS:
            left = np.where(at - d >= first, near[np.maximum(at - d, 0)], sides - 1)
            right = np.where(at + d <= last, near[np.minimum(at + d, len(near) - 1)], sides - 1)
            made.append(left * sides + right)
        yield at, made


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and their counts."""
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


def folded(counts: np.ndarray, near: np.ndarray, target: np.ndarray, sides: int, targets: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each ring the distinct windows of a block, as context times ``targets`` and target, and how often each stands."""
    held: list[tuple[list, list]] = [([], []) for _ in RINGS]
    for at, made in pieces(counts, near, sides):
        for (keys, many), context in zip(held, made):
            key, n = np.unique(context * targets + target[at], return_counts=True)
            keys.append(key)
            many.append(n)
    return [_summed(*x) for x in held]


def _unpacked(batch: pa.RecordBatch, row: int, *names: str) -> Iterator[np.ndarray]:
    for name in names:
        yield unpack(batch.column(name)[row].as_py(), "<i8" if name == "n" else "<u4").astype(np.int64)


def window_table(coded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``(shard, ring, keys, n)``: the distinct windows of the corpus with their counts, dealt by context."""
    spark, sides, targets = coded.sparkSession, vocabulary.sides, vocabulary.targets
    shards = max(SUMS, -(-int(vocabulary.total.sum()) // SHARD_TOKENS))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    names = ["shard", "ring", "keys", "n"]

    def row(shard: list, ring: list, key: list, n: list) -> pa.RecordBatch:
        held = [pa.array([pack(np.diff(x, prepend=0).astype("<u8")) for x in key], pa.binary()), pa.array([pack(x.astype("<u8")) for x in n], pa.binary())]
        return pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(ring, pa.int64()), *held], names)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for i in range(batch.num_rows):
                counts, codes, near, classes = _unpacked(batch, i, "counts", "codes", "near", "classes")
                for ring, (key, n) in enumerate(folded(counts, near[codes], classes[codes], sides, targets)):
                    own = (key // targets * 0x9E3779B1 >> 7) % shards
                    order = np.argsort(own.astype(np.uint16) if shards < 1 << 16 else own, kind="stable")  # short numbers sort faster
                    cuts = np.flatnonzero(np.diff(own[order], prepend=-1, append=shards))
                    pairs = list(zip(cuts, cuts[1:]))
                    yield row(own[order][cuts[:-1]].tolist(), [ring] * len(pairs), [key[order[a:b]] for a, b in pairs], [n[order[a:b]] for a, b in pairs])
                give_back()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        now, keys, many = None, [], []
        for batch in batches:
            for shard, ring, key, n in zip(*(batch.column(c).to_pylist() for c in names)):
                if (shard, ring) != now and keys:
                    key_, n_ = _summed(keys, many)
                    yield row([now[0]], [now[1]], [key_], [n_])
                    keys, many = [], []
                    give_back()
                now = shard, ring
                keys.append(np.cumsum(unpack(key, "<u8").astype(np.int64)))
                many.append(unpack(n, "<u8").astype(np.int64))
        if keys:
            key_, n_ = _summed(keys, many)
            yield row([now[0]], [now[1]], [key_], [n_])

    schema = "shard long, ring long, keys binary, n binary"
    dealt = coded.select("counts", "codes", "near", "classes").mapInArrow(deal, schema)
    met = dealt.repartition(n_parts, "shard", "ring").sortWithinPartitions("shard", "ring").mapInArrow(meet, schema)
    return stage_table(met, "windows")


class Network:
    """A ring's weights: embeddings of the left and of the right neighbour, and the output layer with its priors."""

    def __init__(self, flat: np.ndarray, sides: int, targets: int) -> None:
        self.shapes = (sides, WIDTH), (sides, WIDTH), (WIDTH, targets), (1, targets)
        at = np.cumsum([0, *(a * b for a, b in self.shapes)])
        self.left, self.right, self.outer, self.prior = (flat[a:b].reshape(s).astype(np.float32) for a, b, s in zip(at, at[1:], self.shapes))
        self.sides = sides

    @staticmethod
    def start(vocabulary: Vocabulary, ring: int) -> np.ndarray:
        """Small random weights, and the targets' shares of all tokens as priors."""
        rng = np.random.default_rng(20 + ring)
        size = 2 * vocabulary.sides * WIDTH + WIDTH * vocabulary.targets
        share = (vocabulary.total + 0.5) / (vocabulary.total.sum() + 0.5 * vocabulary.targets)
        return np.concatenate([rng.standard_normal(size) * 0.3, np.log(share)])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        return np.tanh(self.left[context // self.sides] + self.right[context % self.sides])

    def weights(self, hidden: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of hidden values the targets' probabilities, and the log of what divides their weights."""
        out = hidden @ self.outer
        out += self.prior
        top = out.max(axis=1, keepdims=True)
        out -= top
        np.exp(out, out=out)
        total = out.sum(axis=1, keepdims=True)
        out /= total
        return out, (np.log(total) + top)[:, 0]

    def gradient(self, context: np.ndarray, target: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of the summed negative log-probabilities of windows in order of context, each counted ``n`` times."""
        first = np.flatnonzero(np.diff(context, prepend=-1))
        down = [np.zeros(s) for s in self.shapes]
        for a in range(0, len(first), ROWS):
            lo, hi = int(first[a]), int(first[a + ROWS]) if a + ROWS < len(first) else len(context)
            own = context[first[a : a + ROWS]]
            row = np.searchsorted(own, context[lo:hi])
            hidden = self.hidden(own)
            error = self.weights(hidden)[0]
            error *= np.bincount(row, n[lo:hi]).astype(np.float32)[:, None]
            error[row, target[lo:hi]] -= n[lo:hi].astype(np.float32)
            down[2] += hidden.T @ error
            down[3] += error.sum(axis=0, dtype=np.float64)
            back = error @ self.outer.T
            back *= 1 - hidden**2
            np.add.at(down[0], own // self.sides, back)
            np.add.at(down[1], own % self.sides, back)
        return np.concatenate([x.ravel() for x in down])


def _shard(keys: bytes, n: bytes, targets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Context, target and count of the windows of a shard, in order of context."""
    key = np.cumsum(unpack(keys, "<u8").astype(np.int64))
    return key // targets, key % targets, unpack(n, "<u8").astype(np.int64)


def train(windows: DataFrame, vocabulary: Vocabulary) -> list[np.ndarray]:
    """Each ring's weights after ROUNDS steps of Adam, each by the gradient over every window of all documents."""
    sides, targets, tokens = vocabulary.sides, vocabulary.targets, float(max(1, vocabulary.total.sum()))
    params = [Network.start(vocabulary, ring) for ring in range(len(RINGS))]
    mean, square = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(ROUNDS):
        now = [p.astype(np.float32) for p in params]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            one_thread()
            give_back()
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for ring, keys, n in zip(*(batch.column(c).to_pylist() for c in ("ring", "keys", "n"))):
                    made = Network(now[ring], sides, targets).gradient(*_shard(keys, n, targets))
                    whole = np.rint(made * (UNIT / tokens)).astype(np.int64)  # whole numbers sum alike in any order
                    total[ring] = total[ring] + whole if ring in total else whole
            part = TaskContext.get().partitionId() % SUMS
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(total), pa.int64()), pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["part", "ring", "sums"])

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for ring, x in zip(batch.column("ring").to_pylist(), batch.column("sums").to_pylist()):
                    total[ring] = total.get(ring, 0) + np.frombuffer(x, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["ring", "sums"])

        made = windows.select("ring", "keys", "n").mapInArrow(run, "part long, ring long, sums binary")
        grads = [np.zeros(len(p), np.int64) for p in params]
        for r in made.repartition(SUMS, "part").mapInArrow(add, "ring long, sums binary").collect():
            grads[r["ring"]] += np.frombuffer(r["sums"], np.int64)
        rate = RATES[0] * (RATES[1] / RATES[0]) ** (step / max(1, ROUNDS - 1))
        for p, g, m, s in zip(params, grads, mean, square):
            g = g / UNIT
            m += 0.2 * (g - m)
            s += 0.05 * (g * g - s)
            p -= rate * (m / (1 - 0.8 ** (step + 1))) / (np.sqrt(s / (1 - 0.95 ** (step + 1))) + 1e-9)
    return [p.astype(np.float32) for p in params]


def divisors(windows: DataFrame, params: list[np.ndarray], vocabulary: Vocabulary) -> list[np.ndarray]:
    """For each ring the log of what divides the weights of the targets, by context; contexts that no text has give 0.

    Contexts are pairs of neighbours' classes, (2 * MOST_NEAR + 1) ** 2 at most, whatever the corpus.
    """
    sides, targets = vocabulary.sides, vocabulary.targets

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for batch in batches:
            for ring, keys, n in zip(*(batch.column(c).to_pylist() for c in ("ring", "keys", "n"))):
                net, own = Network(params[ring], sides, targets), np.unique(_shard(keys, n, targets)[0])
                logs = [net.weights(net.hidden(own[a : a + ROWS]))[1] for a in range(0, len(own), ROWS)]
                cols = [pa.array([ring], pa.int64()), pa.array([pack(own)], pa.binary()), pa.array([pack(np.concatenate(logs).astype("<f4"))], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, ["ring", "context", "log"])

    out = [np.zeros(sides * sides, np.float32) for _ in params]
    for r in windows.mapInArrow(run, "ring long, context binary, log binary").collect():
        out[r["ring"]][unpack(r["context"], "<i8")] = unpack(r["log"], "<f4")
    return out


class Model:
    """Trained networks with the divisors of all contexts: probabilities of targets for many windows at once."""

    def __init__(self, params: list[np.ndarray], divisors_: list[np.ndarray], sides: int, targets: int) -> None:
        self.nets = [Network(p, sides, targets) for p in params]
        every = np.arange(sides * sides)
        self.hidden, self.divisors = [net.hidden(every) for net in self.nets], divisors_
        self.outer = [np.ascontiguousarray(net.outer.T) for net in self.nets]

    def rings(self, contexts: list[np.ndarray], target: np.ndarray) -> list[np.ndarray]:
        """Each ring's probabilities of the targets. Every value is made by itself, so it is the same in any batch."""
        out = []
        for net, hidden, outer, divisor, context in zip(self.nets, self.hidden, self.outer, self.divisors, contexts):
            made = np.empty(len(target), np.float64)
            for a in range(0, len(target), 8192):
                c, t = context[a : a + 8192], target[a : a + 8192]
                made[a : a + 8192] = np.einsum("ij,ij->i", hidden[c], outer[t]) + net.prior[0, t] - divisor[c]
            out.append(np.exp(made, out=made))
        return out


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each block's ids, its texts' lengths, words by token, and these words' classes and counts in the corpus."""
    give_back()
    for batch in batches:
        for row in range(batch.num_rows):
            yield batch.column("doc_ids")[row].as_py(), *_unpacked(batch, row, "counts", "codes", "near", "classes", "n")
            give_back()


def own_counts(counts: np.ndarray, codes: np.ndarray, kinds: int) -> np.ndarray:
    """For each token how often its text has its word."""
    if len(counts) == 1:
        return np.bincount(codes, minlength=kinds)[codes]
    key = np.repeat(np.arange(len(counts)), counts) * kinds + codes
    order = np.argsort(key)
    first = np.flatnonzero(np.diff(key[order], prepend=-1))
    out = np.empty(len(key), np.int64)
    many = np.diff(np.append(first, len(key)))
    out[order] = np.repeat(many, many)
    return out


def mix_weight(coded: DataFrame, make: Callable[[], Model], sides: int) -> float:
    """The weight of the first ring, of MIXES, under which all tokens of all documents are likeliest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = make(), np.zeros(len(MIXES), np.int64)
        for _, counts, codes, near, target, _ in _blocks(batches):
            for at, contexts in pieces(counts, near[codes], sides):
                one, two = model.rings(contexts, target[codes[at]])
                total += [int(np.rint(np.log(w * one + (1 - w) * two) * 1024).astype(np.int64).sum()) for w in MIXES]  # whole numbers again
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["logs"])

    logs = F.array(*(F.sum(F.col("logs")[i]) for i in range(len(MIXES))))
    total = coded.mapInArrow(run, "logs array<long>").agg(logs.alias("logs")).first()["logs"]
    return max(zip((x or 0 for x in total), MIXES))[1]


def score(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_tokens, log_likelihood, per_token, held_out, unseen)`` of every whole text by a model of all of ``docs``.

    log_likelihood is the sum over the tokens of the log-probability of each given all others in its window; per_token
    its mean; held_out the mean if a word's count leaves out the row that is scored (a word that no other row has counts
    half); unseen the share of the tokens whose word no other row has, 0 for a row with a copy. Null, empty and blank
    texts have no tokens, sum 0 and null means; null ids stay. Repeated rows have equal scores; extra columns are not
    read; an empty table gives no rows. Reruns agree, however the input is split.
    """
    coded, vocabulary = code(id_text(docs))
    sides, targets = vocabulary.sides, vocabulary.targets
    windows = window_table(coded, vocabulary)
    params = train(windows, vocabulary)
    shipped = docs.sparkSession.sparkContext.broadcast((params, divisors(windows, params, vocabulary)))  # as long as there are classes and contexts
    total = np.log(np.maximum(vocabulary.total, 1))

    def make() -> Model:
        return Model(*shipped.value, sides, targets)

    weight = mix_weight(coded, make, sides)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = make()
        for doc_ids, counts, codes, near, target, n in _blocks(batches):
            logs, share = np.zeros(len(codes)), np.log(np.maximum(n, 1)) - total[target]
            for at, contexts in pieces(counts, near[codes], sides):
                one, two = model.rings(contexts, target[codes[at]])
                logs[at] = np.log(weight * one + (1 - weight) * two)
            rest = n[codes] - own_counts(counts, codes, len(n))
            owner = np.repeat(np.arange(len(counts)), counts)

            def sums(x: np.ndarray) -> np.ndarray:
                return np.bincount(owner, weights=x, minlength=len(counts))

            def mean(x: np.ndarray) -> pa.Array:
                return pa.array(np.divide(x, counts, out=np.zeros(len(counts)), where=counts > 0), mask=counts == 0)

            unseen = sums(rest == 0)
            held = sums(logs + np.log(np.maximum(rest, 0.5)) - total[target][codes])
            whole = sums(logs + share[codes])
            cols = [pa.array(doc_ids, pa.int64()), pa.array(counts), pa.array(whole), mean(whole), mean(held), mean(unseen)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_tokens", "log_likelihood", "per_token", "held_out", "unseen"])

    return coded.mapInArrow(run, "doc_id long, n_tokens long, log_likelihood double, per_token double, held_out double, unseen double")
