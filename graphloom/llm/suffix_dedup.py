"""Removal of 50-byte strings that an earlier document has, by a hash-compared suffix sort.

Each window of WINDOW bytes picks one of its GRAM-byte strings as its anchor, by least hash, so equal windows pick equal
anchors wherever they stand. First the anchors' hashes meet, and all that only one document has are done with. Then,
for the others, the bytes that their windows cover meet: the windows of one anchor are suffixes of these contexts,
which a mergesort puts in order by polynomial prefix hashes and binary search for the common extension; neighbours in
order that agree in WINDOW bytes are compared byte by byte and form a class, of which the smallest doc_id goes first.

Copies fold within a block before anything is sent: a block sends each anchor and each context once, with its
smallest doc_id. An anchor with very many contexts, a common line's edge, sends its windows instead, which fold further.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, functions as F

from graphloom.llm.blocks import block_table, pack, unpack
from graphloom.llm.common import give_back, raw_texts
from graphloom.plans.staging import stage_table

WINDOW, GRAM = 50, 20
PLACES = WINDOW - GRAM + 1
LEFT = PLACES - 1
#: Bytes around an anchor that its windows can cover, the anchor's own starting at LEFT.
SPAN = LEFT + WINDOW
#: Bytes of text in a block; entries that a bucket takes; contexts from which on an anchor sends windows.
BLOCK_TEXT, BUCKET_ENTRIES, HOT = 4 << 20, 1_000_000, 4096
#: No byte of UTF-8: between documents, and where a context has no window.
GAP = 0xFF
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
#: Bits of a key that are kept: enough that strings seldom share a key by chance, and cheaper to send.
_HIGH = np.uint64(0xFFFFFFFFFFFF0000)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * _MIX
    return h ^ h >> np.uint64(32)


def _key(h: np.ndarray) -> np.ndarray:
    """Keys of anchors with these hashes. An anchor's hash is the least of many, so it is spread evenly once more."""
    return h * _BASE & _HIGH


def row_keys(rows: np.ndarray) -> np.ndarray:
    """Keys of contexts, which are those of their anchors, or of single windows, from the bytes alone."""
    held = rows if rows.shape[1] == WINDOW else rows[:, LEFT : LEFT + GRAM]
    h = np.zeros(len(rows), np.uint64)
    for i in range(held.shape[1]):
        h = h * _BASE + (held[:, i] + np.uint64(1))
    return _key(_mixed(h))


@dataclass
class Anchors:
    """Anchors of a block in order of place: key, place, first and last window that picks it, and row of its document."""

    h: np.ndarray
    at: np.ndarray
    first: np.ndarray
    last: np.ndarray
    row: np.ndarray


def _stretch(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every window of ``data``: the place of the leftmost least hash in it; and all hashes."""
    x = data.astype(np.uint64) + np.uint64(1)
    h, size = x, 1
    while size < 16:
        h = h[:-size] * _power(size) + h[size:]
        size *= 2
    four = x
    for s in (1, 2):
        four = four[:-s] * _power(s) + four[s:]
    h = h[: len(x) - GRAM + 1] * _power(4) + four[16 : 16 + len(x) - GRAM + 1]
    h = _mixed(h)
    value, place, size = h, np.arange(len(h), dtype=np.int32), 1
    while size <= PLACES // 2:
        right = value[size:] < value[:-size]
        value, place = np.where(right, value[size:], value[:-size]), np.where(right, place[size:], place[:-size])
        size *= 2
    shift = PLACES - size
    if shift:
        right = value[shift:] < value[:-shift]
        place = np.where(right, place[shift:], place[:-shift])
    return place, h


def anchors(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, piece: int = 1 << 14) -> Anchors:
    """The anchors of documents that lie at ``starts`` to ``ends`` of a block, worked through piece by piece."""
    picked, hashes, windows = [], [], []
    inside = np.zeros(len(data) + 1, np.int32)
    long = ends - starts >= WINDOW
    np.add.at(inside, starts[long], 1)
    np.add.at(inside, ends[long] - WINDOW + 1, -1)
    whole = np.cumsum(inside[:-1]) > 0
    for a in range(0, max(0, len(data) - WINDOW + 1), piece):
        b = min(a + piece, len(data) - WINDOW + 1)
        place, h = _stretch(data[a : b + WINDOW - 1])
        ok = np.flatnonzero(whole[a:b])
        picked.append(place[ok].astype(np.int64) + a)
        hashes.append(h[place[ok]])
        windows.append(ok + a)
    at, h, window = (np.concatenate([np.zeros(0, k), *x]) for x, k in ((picked, np.int64), (hashes, np.uint64), (windows, np.int64)))
    new = np.flatnonzero(np.diff(at, prepend=-1))
    last = window[np.append(new[1:], len(at))[: len(new)] - 1] if len(new) else window
    return Anchors(_key(h[new]), at[new], window[new], last, np.searchsorted(starts, at[new], side="right") - 1)


def contexts(data: np.ndarray, found: Anchors, pick: np.ndarray) -> np.ndarray:
    """The bytes around the anchors ``pick``, GAP wherever no window of theirs reaches."""
    place = found.at[pick][:, None] + np.arange(-LEFT, SPAN - LEFT)
    out = data[np.clip(place, 0, len(data) - 1)]
    out[(place < found.first[pick][:, None]) | (place >= found.last[pick][:, None] + WINDOW)] = GAP
    return out


def row_classes(rows: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A number from 0 up for each row of bytes: equal rows with equal keys have equal numbers.

    Hashes bring equal rows together; should one row differ from the first of its hash, the bytes themselves are sorted.
    """
    width = -(-rows.shape[1] // 8) * 8
    wide = np.zeros((len(rows), width + 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    wide[:, width:] = key.view(np.uint8).reshape(-1, 8)
    words = wide.view(np.uint64)
    h = np.zeros(len(rows), np.uint64)
    for i in range(words.shape[1]):
        h = (h ^ words[:, i]) * _MIX
        h ^= h >> np.uint64(32)
    _, first, number = np.unique(h, return_index=True, return_inverse=True)
    for i in range(words.shape[1]):
        if (words[first, i][number] != words[:, i]).any():
            return np.unique(wide.view(f"V{width + 8}").reshape(-1), return_inverse=True)[1].astype(np.int64)
    return number.astype(np.int64)


class Suffixes:
    """Suffixes of byte rows, cut at WINDOW bytes, compared through polynomial prefix hashes."""

    def __init__(self, rows: np.ndarray) -> None:
        self.rows = rows
        self.prefix = np.zeros((len(rows), rows.shape[1] + 1), np.uint64)
        for i in range(rows.shape[1]):
            self.prefix[:, i + 1] = self.prefix[:, i] * _BASE + rows[:, i] + np.uint64(1)
        self.powers = np.array([_power(i) for i in range(WINDOW + 1)], np.uint64)

    def extension(self, r: np.ndarray, p: np.ndarray, s: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Length of the common extension of suffixes (r, p) and (s, q), by binary search over hashes of prefixes."""
        flat, width = self.prefix.reshape(-1), self.prefix.shape[1]
        one, two = r * width + p, s * width + q
        begin = flat[one] - flat[two]
        out = np.full(len(r), WINDOW)
        # Whole windows first: where they agree, there is nothing to search.
        open_ = np.flatnonzero(flat[one + WINDOW] - flat[two + WINDOW] != begin * self.powers[WINDOW])
        one, two, begin = one[open_], two[open_], begin[open_]
        low, high = np.zeros(len(open_), np.int64), np.full(len(open_), WINDOW - 1)
        while (low < high).any():
            mid = (low + high + 1) // 2
            same = flat[one + mid] - flat[two + mid] == begin * self.powers[mid]
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        out[open_] = low
        return out

    def less(self, r: np.ndarray, p: np.ndarray, s: np.ndarray, q: np.ndarray, equal: np.ndarray) -> np.ndarray:
        """Whether suffix (r, p) comes before (s, q); ``equal`` where they agree in WINDOW bytes."""
        n = self.extension(r, p, s, q)
        end = np.minimum(n, WINDOW - 1)
        return np.where(n >= WINDOW, equal, self.rows[r, p + end] < self.rows[s, q + end])

    def sort(self, r: np.ndarray, p: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order the suffixes within their groups (equal numbers, side by side) by a bottom-up mergesort.

        Every merge finds each suffix's place by binary search in the run beside its own; all merges of all groups
        of one width go together.
        """
        n = len(r)
        begin = np.flatnonzero(np.diff(group, prepend=group[:1] - 1)) if n else np.zeros(0, np.int64)
        number = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
        start, stop = begin[number], np.append(begin[1:], n)[number] if n else begin
        at, width = np.arange(n), 1
        widest = int((stop - start).max()) if n else 0
        while width < widest:
            live = np.flatnonzero(stop - start > width)
            inside = live - start[live]
            left = inside // width % 2 == 0
            own = start[live] + inside // width * width
            low = np.where(left, own + width, own - width)
            low = np.minimum(low, stop[live])
            base = low.copy()
            high = np.minimum(low + width, stop[live])
            while (open_ := np.flatnonzero(low < high)).size:
                mid = (low[open_] + high[open_]) // 2
                me = live[open_]
                # Of equals those of the left run come first.
                after = self.less(r[mid], p[mid], r[me], p[me], ~left[open_])
                low[open_] = np.where(after, mid + 1, low[open_])
                high[open_] = np.where(after, high[open_], mid)
            to = np.minimum(own, np.where(left, own, base)) + (live - own) + (low - base)
            at = np.arange(n)
            at[to] = live
            r, p = r[at], p[at]
            width *= 2
        return r, p


def window_masks(rows: np.ndarray, key: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For each context a bit for each of its windows: whether a smaller doc_id has it under the same key.

    ``rows`` hold SPAN bytes each, or WINDOW for single windows.
    """
    places = rows.shape[1] - WINDOW + 1
    out = np.zeros(len(rows), np.uint32)
    if not len(rows):
        return out
    # Contexts that agree in full fold: all but the smallest doc_id lose every window. Single windows go to the sort.
    cls = row_classes(rows, key) if places > 1 else np.arange(len(rows))
    order = np.lexsort((docs, cls))
    lead = order[np.flatnonzero(np.diff(cls[order], prepend=-1))]
    least = docs[lead][cls]  # classes are numbered from 0 up, in order
    gaps = np.zeros((len(rows), rows.shape[1] + 1), np.int16)
    np.cumsum(rows == GAP, axis=1, out=gaps[:, 1:])
    whole = gaps[:, WINDOW:] == gaps[:, :places]
    bits = np.uint32(1) << np.arange(places, dtype=np.uint32)
    out[docs > least] = (whole * bits).sum(axis=1, dtype=np.uint32)[docs > least]
    # Of each key with several contexts, the leading ones are sorted, place by place.
    by_key = lead[np.argsort(key[lead], kind="stable")]
    k = key[by_key]
    many = np.flatnonzero(np.append(k[1:] == k[:-1], False) | np.insert(k[1:] == k[:-1], 0, False)) if len(k) > 1 else np.zeros(0, np.int64)
    by_key, k = by_key[many], k[many]
    step = max(1, 150_000 // places)  # contexts whose hashes fit the processor's cache
    cuts = np.flatnonzero(np.diff(k, prepend=k[:1] + np.uint64(1))) if len(k) else np.zeros(0, np.int64)
    ends = np.append(cuts[1:], len(k))
    a = 0
    while a < len(cuts):
        b = max(a + 1, int(np.searchsorted(ends, cuts[a] + step, side="right")))
        held = by_key[cuts[a] : ends[b - 1]]
        part = rows[held]
        suffixes = Suffixes(part)
        ok = whole[held]
        number = np.cumsum(np.diff(k[cuts[a] : ends[b - 1]], prepend=k[cuts[a]]) != 0)
        r, p = np.nonzero(ok)
        group = number[r] * places + p
        line = np.argsort(group, kind="stable")
        r, p = suffixes.sort(r[line], p[line], group[line])
        group = group[line]
        if len(r):
            beside = np.flatnonzero(group[1:] == group[:-1])
            same = suffixes.extension(r[beside], p[beside], r[beside + 1], p[beside + 1]) >= WINDOW
            beside = beside[same]
            for x in range(0, len(beside), 1 << 18):  # byte by byte: no collision of hashes removes anything
                y = beside[x : x + (1 << 18)]
                reach = np.arange(WINDOW)
                true = (part[r[y][:, None], p[y][:, None] + reach] == part[r[y + 1][:, None], p[y + 1][:, None] + reach]).all(axis=1)
                beside[x : x + (1 << 18)] = np.where(true, y, -1)
            joined = np.zeros(len(r), bool)
            joined[beside[beside >= 0] + 1] = True
            run = np.flatnonzero(~joined)
            own = docs[held][r]
            small = np.minimum.reduceat(own, run)[np.cumsum(~joined) - 1]
            lost = own > small
            np.bitwise_or.at(out, held[r[lost]], bits[p[lost]])
        a = b
    # Rows that repeat a doc_id may send a context from several blocks: all of its least doc_id lose what the leading one does.
    first = docs == least
    out[first] = out[lead][cls[first]]
    return out


def removed(length: int, starts: np.ndarray) -> np.ndarray:
    """Which bytes windows at ``starts`` cover."""
    edge = np.zeros(length + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + WINDOW, length), -1)
    return np.cumsum(edge[:-1]) > 0


class Block:
    """A block's documents laid out with gaps; documents without an id take no part in comparisons."""

    def __init__(self, ids: list[int | None], lengths: np.ndarray, body: bytes, places: tuple[bytes, bytes] | None = None) -> None:
        ends = np.cumsum(lengths + 1) - 1 if len(lengths) else lengths
        self.ids, self.starts, self.ends = ids, ends - lengths, ends
        self.data = np.frombuffer(body, np.uint8)
        named = np.array([x is not None for x in ids], bool)
        self.docs = np.array([x or 0 for x in ids], np.int64)
        self.found = self._again(places) if places else anchors(self.data, self.starts, np.where(named, self.ends, self.starts))

    def places(self) -> tuple[bytes, bytes]:
        """The anchors in few bytes: steps from place to place, and from first window to first window."""
        return tuple(pack(np.diff(x, prepend=0).astype("<u4")) for x in (self.found.at, self.found.first))

    def _again(self, places: tuple[bytes, bytes]) -> Anchors:
        """The anchors that :meth:`places` wrote. An anchor's windows end where the next one's begin, or with the text."""
        at, first = (np.cumsum(unpack(x, "<u4"), dtype=np.int64) for x in places)
        row = np.searchsorted(self.starts, at, side="right") - 1
        last = self.ends[row] - WINDOW
        inner = np.flatnonzero(row[1:] == row[:-1])
        last[inner] = first[inner + 1] - 1
        h = np.zeros(len(at), np.uint64)
        for i in range(GRAM):
            h = h * _BASE + (self.data[at + i] + np.uint64(1))
        return Anchors(_key(_mixed(h)), at, first, last, row)

    @cached_property
    def sent(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct anchor hashes, which of them several documents have, how often, each anchor's number."""
        h, number = np.unique(self.found.h, return_inverse=True)
        doc = self.docs[self.found.row]
        most, least = np.full(len(h), -(1 << 63), np.int64), np.full(len(h), (1 << 63) - 1, np.int64)
        np.maximum.at(most, number, doc)
        np.minimum.at(least, number, doc)
        return h, most > least, np.bincount(number, minlength=len(h)), number

    def entries(self, flags: np.ndarray, hot: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, Callable]:
        """What shared anchors send: rows, keys and smallest doc_ids, folded and in order of key; and a function that
        turns the masks for these into places of windows to remove, with their documents' rows."""
        number = self.sent[3]
        pick = np.flatnonzero(flags[number] == (2 if hot else 1)) if len(number) else number
        if hot:  # each window by itself, keyed by its own hash
            many = self.found.last[pick] - self.found.first[pick] + 1
            place = np.repeat(self.found.first[pick] - np.cumsum(many) + many, many) + np.arange(many.sum())
            owner = np.repeat(self.found.row[pick], many)
            rows = self.data[place[:, None] + np.arange(WINDOW)] if len(place) else np.zeros((0, WINDOW), np.uint8)
            key = row_keys(rows)
        else:
            rows, key, owner = contexts(self.data, self.found, pick), self.found.h[pick], self.found.row[pick]
            place = self.found.at[pick] - LEFT
        doc = self.docs[owner]
        cls = row_classes(rows, key) if len(rows) else np.zeros(0, np.int64)
        order = np.lexsort((doc, cls))
        lead = order[np.flatnonzero(np.diff(cls[order], prepend=-1))]
        line = np.argsort(key[lead], kind="stable")
        back = np.empty(len(lead), np.int64)
        back[line] = np.arange(len(lead))

        def windows(masks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            own = masks[back[cls]] if len(cls) else np.zeros(0, np.uint32)
            if hot:
                lost = (own > 0) | (doc > doc[lead][cls])
                return place[lost], owner[lost]
            whole = np.zeros(len(own), np.uint32)
            for i in range(PLACES):
                start = place + i
                ok = (start >= self.found.first[pick]) & (start <= self.found.last[pick])
                whole |= np.where(ok, np.uint32(1 << i), np.uint32(0))
            own = np.where(doc > doc[lead][cls], whole, own & whole)
            i, bit = np.nonzero(own[:, None] >> np.arange(PLACES, dtype=np.uint32) & np.uint32(1))
            return place[i] + bit, owner[i]

        return rows[lead][line], key[lead][line], doc[lead][line], windows


def _cut(key: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of keys in order, and where each begins and the last ends."""
    bucket = ((key >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1, append=n))
    return bucket[cuts[:-1]], cuts


_ROW = "doc_ids array<long>, lengths binary, body binary, at binary, first binary, n_bytes long"
_BLOCK = ("doc_ids", "lengths", "body", "at", "first")


def _lay(part: pa.RecordBatch) -> list:
    raws = raw_texts(part)
    body = b"".join(x + b"\xff" for x in raws)
    ids = pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64()))
    lengths = np.array([len(x) for x in raws], np.int64)
    places = Block(part.column("doc_id").to_pylist(), lengths, body).places()
    return [ids, pack(lengths), zstandard.compress(body, 3), *places, len(body)]


def _open(doc_ids: list, lengths: bytes, body: bytes, at: bytes, first: bytes) -> Block:
    return Block(doc_ids, unpack(lengths, "<i8"), zstandard.decompress(body), (at, first))


def _rows(batches: Iterator[pa.RecordBatch], *names: str, large: bool = True) -> Iterator[tuple]:
    """Rows one by one; after each ``large`` one, memory goes back."""
    give_back()
    for batch in batches:
        for i in range(batch.num_rows):
            yield tuple(batch.column(c)[i].as_py() for c in names)
            if large:
                give_back()


def _by_bucket(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[list[tuple]]:
    """Rows of one bucket at a time, from rows in order of bucket; a bucket is its first column."""
    held: list[tuple] = []
    for row in _rows(batches, *names, large=False):
        if held and row[0] != held[0][0]:
            yield held
            held = []
            give_back()
        held.append(row)
    if held:
        yield held


def _flags_in_order(found: list | None) -> np.ndarray:
    parts = sorted(found or [], key=lambda x: x["bucket"])
    return np.concatenate([np.zeros(0, np.uint8), *(unpack(x["flags"], "u1") for x in parts)])


def _batch(names: str, kinds: list, *cols: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names.split())


def suffix_dedup(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept)`` of each row; ``kept`` is what is left, as bytes.

    A byte goes if a 50-byte string that covers it also starts in a document with a smaller doc_id, by the input as it
    came; matches never cross documents. Null and empty texts lose nothing, as do rows without an id, which no other
    row is held against. Rows that repeat a doc_id are not held against each other. Extra columns are not read; an
    empty table gives no rows. Every match is found: equal windows have equal anchors, and buckets have no caps.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = block_table(docs, BLOCK_TEXT, _lay, _ROW)
    total = blocks.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(n, total * 2 // (PLACES + 1) // BUCKET_ENTRIES)

    def send_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, *rest in _rows(batches, "block", *_BLOCK):
            h, several, times, _ = _open(*rest).sent
            own, cuts = _cut(h, n_buckets)
            # Differences of hashes in order: small numbers, of which only the low bytes cost room.
            low = [np.diff(h[a:b], prepend=np.uint64(0)) for a, b in zip(cuts, cuts[1:])]
            counts = [times[a:b].astype("<u4") for a, b in zip(cuts, cuts[1:])]
            several_ = [several[a:b].astype(np.uint8) for a, b in zip(cuts, cuts[1:])]
            yield _batch("bucket block keys counts several", [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()], own.tolist(), [block] * len(own), list(map(pack, low)), list(map(pack, counts)), list(map(pack, several_)))

    def meet_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, "bucket", "block", "keys", "counts", "several"):
            keys = [np.cumsum(unpack(x[2], "<u8")) for x in rows]
            number = np.unique(np.concatenate(keys), return_inverse=True)[1]
            here = np.bincount(number)
            times = np.bincount(number, weights=np.concatenate([unpack(x[3], "<u4") for x in rows]))
            several = np.bincount(number, weights=np.concatenate([unpack(x[4], "u1") for x in rows])) > 0
            flags = np.where(several | (here > 1), np.where(times > HOT, 2, 1), 0).astype(np.uint8)[number]
            ends = np.cumsum([len(k) for k in keys])
            made = [pack(flags[b - len(k) : b]) for k, b in zip(keys, ends)]
            yield _batch("bucket block flags", [pa.int64(), pa.int64(), pa.binary()], [x[0] for x in rows], [x[1] for x in rows], made)

    def send_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
        for block, *rest, found in _rows(batches, "block", *_BLOCK, "found"):
            own_block = _open(*rest)
            flags = _flags_in_order(found)
            for hot in (False, True):
                rows, key, docs_, _ = own_block.entries(flags, hot)
                own, cuts = _cut(key, n_buckets)
                pairs = list(zip(cuts, cuts[1:]))
                yield _batch(
                    "bucket block rows docs", kinds, (2 * own + hot).tolist(), [block] * len(own),
                    [zstandard.compress(rows[a:b].tobytes(), 6) for a, b in pairs], [pack(docs_[a:b]) for a, b in pairs],
                )

    def meet_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, "bucket", "block", "rows", "docs"):
            width = WINDOW if rows[0][0] % 2 else SPAN
            text = np.concatenate([np.frombuffer(zstandard.decompress(x[2]), np.uint8).reshape(-1, width) for x in rows])
            docs_ = [unpack(x[3], "<i8") for x in rows]
            masks = window_masks(text, row_keys(text), np.concatenate(docs_))
            ends = np.cumsum([len(x) for x in docs_])
            made = [pack(masks[b - len(x) : b]) for x, b in zip(docs_, ends)]
            yield _batch("bucket block masks", [pa.int64(), pa.int64(), pa.binary()], [x[0] for x in rows], [x[1] for x in rows], made)

    def take_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = "doc_id n_bytes n_removed n_spans kept_sha256 kept"
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        for doc_ids, *rest, found, masks in _rows(batches, *_BLOCK, "found", "masks"):
            block = _open(doc_ids, *rest)
            flags = _flags_in_order(found)
            lost = np.zeros(0, np.int64)
            for hot in (False, True):
                parts = sorted((x for x in masks or [] if x["bucket"] % 2 == hot), key=lambda x: x["bucket"])
                own = np.concatenate([np.zeros(0, np.uint32), *(unpack(x["masks"], "<u4") for x in parts)])
                lost = np.concatenate([lost, block.entries(flags, hot)[3](own)[0]])
            gone = removed(len(block.data), lost)
            edges = np.diff(gone.astype(np.int8), prepend=0) == 1
            out = []
            for doc_id, a, b in zip(doc_ids, block.starts.tolist(), block.ends.tolist()):
                kept = block.data[a:b][~gone[a:b]].tobytes()
                out.append((doc_id, b - a, b - a - len(kept), int(edges[a:b].sum()), hashlib.sha256(kept).hexdigest(), kept))
            for x in range(0, len(out), 1000):
                yield _batch(names, kinds, *zip(*out[x : x + 1000]))

    def meeting(sent: DataFrame, meet: Callable, schema: str, value: str, name: str) -> DataFrame:
        """Deal what blocks sent by bucket, let it meet, and gather what comes back for each block."""
        dealt = sent.repartition(n, "bucket").sortWithinPartitions("bucket", "block")
        back = dealt.mapInArrow(meet, schema).groupBy("block").agg(F.collect_list(F.struct("bucket", value)).alias(name))
        return stage_table(back, name)

    sent = blocks.select("block", *_BLOCK).mapInArrow(send_anchors, "bucket long, block long, keys binary, counts binary, several binary")
    flags = meeting(sent, meet_anchors, "bucket long, block long, flags binary", "flags", "found")
    flagged = blocks.join(flags, "block", "left")
    sent = flagged.select("block", *_BLOCK, "found").mapInArrow(send_contexts, "bucket long, block long, rows binary, docs binary")
    masks = meeting(sent, meet_contexts, "bucket long, block long, masks binary", "masks", "masks")
    whole = flagged.join(masks, "block", "left").select(*_BLOCK, "found", "masks")
    return whole.mapInArrow(take_out, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
