"""Language identification by rank-order profiles of character n-grams and their out-of-place distance."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from graphloom.llm.common import id_text, slices

#: N-grams of a profile, their lengths, and the texts that profiles are learned from for each language, about.
TOP, LENGTHS, SAMPLE = 300, (1, 2, 3), 2000
#: Bits for a code point in a packed n-gram, for a document in a piece of a batch, and for a count.
POINT_BITS, DOC_BITS, COUNT_BITS = 21, 9, 17
#: What stands before and after a word.
EDGE = ord("_")


@cache
def letter_table() -> np.ndarray:
    """By code point: that of a letter's lower-case form, letter by letter, 0 for what is no letter. Once in a worker."""
    out = np.zeros(0x110000, np.uint32)
    for start in range(0, 0x110000, 0x800):  # most of the range has no letters
        if start == 0xD800:
            continue
        page = "".join(map(chr, range(start, start + 0x800)))
        if any(map(str.isalpha, page)):
            low = page.lower()
            low = low if len(low) == len(page) and "\u03a3" not in page else "".join(c.lower()[:1] for c in page)
            out[start : start + 0x800] = [ord(x) if c.isalpha() else 0 for c, x in zip(page, low)]
    return out


def points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts, each with a space before and after it, 0 for the rest; and each one's text."""
    parts = [np.frombuffer(f" {t} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    return letter_table()[np.concatenate(parts)], np.repeat(np.arange(len(texts)), [len(p) for p in parts])


def grams(x: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and packed codes of 1-, 2- and 3-grams within words; ``x`` has numbers under ``2 ** bits``, letters from 2
    up, other characters 0. A word has an edge, number 1, before and after it, which alone is no 1-gram."""
    x = x.astype(np.int64)
    letter = x > 0
    edge = ~letter & (np.append(letter[1:], False) | np.insert(letter[:-1], 0, False))
    x[edge] = 1
    ok = letter | edge
    one = np.flatnonzero(letter)
    yield one, x[one]
    two = ok[:-1] & ok[1:] & (letter[:-1] | letter[1:])
    pair = x[:-1] << bits | x[1:]
    at = np.flatnonzero(two)
    yield at, pair[at]
    at = np.flatnonzero(two[:-1] & two[1:] & letter[1:-1])
    yield at, pair[at] << bits | x[at + 2]


def shown(code: int) -> str:
    """An n-gram packed by code points, with an underscore for an edge."""
    out = ""
    while code:
        point = code & (1 << POINT_BITS) - 1
        out = ("_" if point == 1 else chr(point)) + out
        code >>= POINT_BITS
    return out


def learn(labelled: DataFrame) -> list[tuple[str, str, int]]:
    """``(lang, gram, rank)`` of the profiles, from rows (doc_id, text, lang); ties go to the smaller n-gram.

    About SAMPLE texts a language, by a hash of doc_id: the documented bound on what is learned from. The profiles
    are TOP rows a language, which is all that reaches the driver.
    """
    rows = labelled.where("lang is not null and text is not null")
    rates = rows.groupBy("lang").count().select("lang", (F.lit(SAMPLE) / F.col("count")).alias("rate"))
    point = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = rows.join(F.broadcast(rates), "lang").where(point < F.col("rate")).select("lang", "text")  # a row a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                texts: dict[str, list[str]] = {}
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
                    texts.setdefault(lang, []).append(text)
                for lang, own in texts.items():
                    code, n = np.unique(np.concatenate([c for _, c in grams(points(own)[0], POINT_BITS)]), return_counts=True)
                    held.setdefault(lang, Counter()).update(dict(zip(code.tolist(), n.tolist())))
        flat = [(k, shown(c), n) for k, own in held.items() for c, n in own.items()]
        cols = list(zip(*flat)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64()))], ["lang", "gram", "n"])

    counts = sample.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < TOP)
    return sorted(tuple(r) for r in ranked.select("lang", "gram", "rank").collect())


class Profiles:
    """Profiles as arrays: the code points of n-grams, and each one's rank in each language (TOP: not in it)."""

    def __init__(self, rows: list[tuple[str, str, int]]) -> None:
        self.langs = sorted({r[0] for r in rows})
        held = sorted({g for _, g, _ in rows})
        self.points = np.array([[0] * (3 - len(g)) + list(map(ord, g)) for g in held], np.int64).reshape(-1, 3)
        at = {g: i for i, g in enumerate(held)}
        self.ranks = np.full((len(held) + 1, len(self.langs)), TOP, np.int64)
        for lang, g, rank in rows:
            self.ranks[at[g], self.langs.index(lang)] = rank
        self.number = np.zeros(0x110000, np.int64)

    def numbered(self, x: np.ndarray) -> tuple[np.ndarray, int, np.ndarray, np.ndarray]:
        """The letters that texts have, by numbers in order of code point from 2 up, and how many bits these take; and
        codes in order of the profiles' n-grams that consist of such letters, with their rows."""
        there = np.zeros(0x110000, bool)
        there[x] = True
        there[0] = False
        letters = np.flatnonzero(there)
        self.number[letters] = np.arange(len(letters)) + 2
        self.number[EDGE] = 1
        bits = int(len(letters) + 1).bit_length()
        made = self.number[self.points]
        rows = np.flatnonzero(((made > 0) | (self.points == 0)).all(axis=1))
        made = made[rows]
        codes = made[:, 0] << 2 * bits | made[:, 1] << bits | made[:, 2]
        order = np.argsort(codes)
        out = self.number[x]
        self.number[letters] = 0
        return out, bits, codes[order], rows[order]

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        """Language and score of each text: 1 less the distance as a share of the largest possible one.

        ``und`` and 0 without a letter, or where no language was learned; ties go to the first language in order.
        """
        n = len(texts)
        langs, scores = ["und"] * n, [0.0] * n
        if not self.langs or not n:
            return langs, scores
        x, owner = points(texts)
        x, bits, codes, rows = self.numbered(x)
        key = np.sort(np.concatenate([owner[at] << 3 * bits | code for at, code in grams(x, bits)]))
        if not len(key):
            return langs, scores
        first = np.flatnonzero(np.diff(key, prepend=-1))
        count = np.diff(np.append(first, len(key)))
        key = key[first]
        doc, code = key >> 3 * bits, key & (1 << 3 * bits) - 1
        if count.max() >= 1 << COUNT_BITS:
            order = np.lexsort((code, -count, doc))
        else:  # one sort of one number is far quicker
            top = (1 << COUNT_BITS) - 1
            order = np.argsort(doc << COUNT_BITS | top - count, kind="stable")
        doc, code = doc[order], code[order]
        begin = np.searchsorted(doc, np.arange(n))
        rank = np.arange(len(doc)) - begin[doc]
        near = rank < TOP
        doc, code, rank = doc[near], code[near], rank[near]
        at = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
        known = self.ranks[np.where(codes[at] == code, rows[at], len(self.points))] if len(codes) else np.full((len(code), len(self.langs)), TOP)
        apart = np.where(known == TOP, TOP, np.abs(known - rank[:, None]))
        have, starts = np.unique(doc, return_index=True)
        sums = np.add.reduceat(apart, starts, axis=0)
        most = np.diff(np.append(starts, len(doc))) * TOP
        best = sums.argmin(axis=1)
        for d, b, s, m in zip(have.tolist(), best.tolist(), sums.min(axis=1).tolist(), most.tolist()):
            langs[d], scores[d] = self.langs[b], 1.0 - s / m
        return langs, scores


def is_held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def identify(docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """``(doc_id, lang_pred, score)`` of every whole text of ``docs`` by profiles learned from ``labelled``.

    ``und`` with score 0 for null texts and for texts without a letter; null ids stay. Only the text decides. Repeated rows give
    equal results; extra columns are not read; an empty table gives no rows; with nothing learned all are ``und``.
    Predicting is one pass without shuffle.
    """
    rows = learn(labelled)
    shipped = docs.sparkSession.sparkContext.broadcast(rows)  # TOP rows a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiles = Profiles(shipped.value)
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                for at in range(0, part.num_rows, 1 << DOC_BITS):
                    piece = part.slice(at, 1 << DOC_BITS)
                    langs, scores = profiles.predict([x or "" for x in piece.column("text").to_pylist()])
                    yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return id_text(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
