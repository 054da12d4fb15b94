"""Personal data replaced by keyed surrogates of the same type and format.

Every type is mapped by a keyed permutation of the strings of its format (a Feistel network with cycle walking). A
permutation gives distinct values distinct surrogates and equal values equal ones, in every document and without any
table, so no collision can arise between two entities of a format; walking on skips what would be no surrogate, and
:func:`collisions` checks a whole table. Without its key no surrogate leads back to what it stands for.
"""

from __future__ import annotations

import hmac
import ipaddress
import re
import secrets as random_bytes
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.llm.common import carried_schema, id_text
from graphloom.plans.staging import shared_dir

# Given names by gender, and family names; surrogates of names come from the same lists.
FEMALE = "Alice Amelia Anna Barbara Carmen Caroline Charlotte Claire Clara Diana Elena Elizabeth Emily Emma Eva Grace Hannah Helen Isabel Jane Jennifer Jessica Julia Karen Katharina Laura Linda Louise Lucia Margaret Maria Marie Martha Mary Nancy Olivia Patricia Paula Rosa Ruth Sandra Sarah Sofia Sophie Susan Teresa Ursula Victoria".split()
MALE = "Adam Albert Alexander Andrew Anthony Antonio Arthur Benjamin Carlos Charles Christopher Daniel David Edward Eric Felix Francisco Frank Frederick George Hans Henry Hugo Jack Jacob James John Joseph Juan Karl Klaus Louis Lucas Luis Mark Martin Max Michael Miguel Oliver Oscar Paul Peter Philippe Pierre Richard Robert Simon Stefan Stephen Thomas Victor Walter William".split()
FAMILY = "Adams Allen Anderson Bailey Baker Becker Bell Bennett Bernard Brown Campbell Carter Clark Collins Cook Cooper Davis Diaz Dubois Edwards Evans Fernandez Fischer Foster Garcia Gomez Gonzalez Gray Green Hall Harris Hernandez Hill Hoffmann Hughes Jackson Johnson Jones Kelly King Koch Lambert Lefevre Lewis Lopez Martinez Meyer Miller Mitchell Moore Moreau Morgan Morris Murphy Nelson Parker Perez Phillips Price Reed Richardson Richter Roberts Robinson Rodriguez Rogers Ross Roux Sanchez Sanders Schmidt Schneider Schulz Scott Simpson Smith Stewart Taylor Thompson Torres Turner Wagner Walker Ward Watson Weber White Williams Wilson Wood Wright Young Zimmermann".split()

#: Letters of scripts that part words by spaces; of others an address takes none, as it would take the text before it.
_LETTER = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u0370-\u0373\u0376-\u037d\u0386-\u03ff\u0400-\u0481\u048a-\u052f\u0531-\u0556\u0561-\u0587\u05d0-\u05ea\u0620-\u064a\u1e00-\u1fff"
_LABEL = f"[{_LETTER}]+(?:-+[{_LETTER}]+)*"
_WORD = r"[^\W\d_]+(?:['\u2019-][^\W\d_]+)*"
_TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora"

# Patterns by kind, in order of precedence.
PATTERNS = {
    "email": rf"[{_LETTER}._%+-]+@{_LABEL}(?:\.{_LABEL})+",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "mac": r"(?<![\w:-])[0-9A-Fa-f]{2}(?:(?::[0-9A-Fa-f]{2}){5}|(?:-[0-9A-Fa-f]{2}){5})(?![\w:-])",
    "ipv6": r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}|(?=::[0-9A-Fa-f]))(?::{1,2}[0-9A-Fa-f]{1,4}){2,7}(?:::)?(?![\w:])",
    "card": r"(?<![0-9A-Za-z.-])(?:[0-9][ -]?){12,18}[0-9](?![0-9A-Za-z]|[.-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": r"(?<![0-9A-Za-z.+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}[ .-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9A-Za-z])",
    "titled": rf"\b(?:{_TITLES})\.?\x20+(?P<words>{_WORD}(?:\x20+{_WORD}){{0,2}})",
    "name": rf"\b(?P<title>Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|[Mm]y name is|[Ii] am|[Cc]ontact|[Ss]incerely,?)\.?\x20+(?P<given>{'|'.join(FEMALE + MALE)})(?:\x20+(?P<family>{'|'.join(sorted(FAMILY, key=len, reverse=True))}))?\b",
    "pair": rf"\b(?P<given>{'|'.join(FEMALE + MALE)})\x20+(?P<family>{'|'.join(sorted(FAMILY, key=len, reverse=True))})\b",
}
_COMPILED = {k: re.compile(v) for k, v in PATTERNS.items()}
#: One quick vectorised test for what any of the patterns must contain.
MAY_HAVE = r"@|[0-9][ .-]?[0-9()]{2}|[0-9][ .-][0-9]|[A-Z]{2}[0-9]{2}|\b(?:Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Señor|Señora|[Mm]y name is|[Ii] am|[Cc]ontact|[Ss]incerely)\b" + rf"|:[0-9A-Fa-f]{{0,4}}:|[0-9A-Fa-f]{{2}}-[0-9A-Fa-f]{{2}}-[0-9A-Fa-f]{{2}}|\b(?:{'|'.join(FEMALE + MALE)})\x20+[A-Z]"
DIGITS, LOWER, UPPER, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
ROUNDS = 8
_GIVEN = frozenset(FEMALE + MALE)
_LISTED = frozenset(FEMALE + MALE + FAMILY)


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of ``range(size)``: a balanced Feistel network on enough bits, walked back into range."""
    bits = max(2, (size - 1).bit_length())
    half = (bits + 1) // 2
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            word = hmac.digest(key, f"{tweak}:{size}:{r}:{right}".encode(), "sha256")
            left, right = right, left ^ int.from_bytes(word[: half // 8 + 1], "big") & mask
        value = left << half | right
        if value < size:
            return value


@lru_cache(1 << 16)
def alphabet(c: str) -> str:
    """What may stand for a character: digits, letters of its case and script (beyond ASCII, those in the same run of
    256 code points), or nothing."""
    if c < "\x80":
        return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else ""
    if not c.isalpha():
        return ""

    def form(x: str) -> tuple:
        one = len(x.lower()) == len(x.upper()) == 1 and x.upper().lower() == x.lower()  # case can be given back
        return unicodedata.name(x, "").split(" ")[0], unicodedata.category(x), one

    page = ord(c) & ~0xFF
    return "".join(x for x in map(chr, range(max(page, 0x80), page + 256)) if x.isalpha() and form(x) == form(c))


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the texts of one format: digits stay digits, and letters letters of their case and script."""
    alphabets = [alphabet(c) for c in text]
    value, size = 0, 1
    for c, own in zip(text, alphabets):
        if own:
            value, size = value * len(own) + own.index(c), size * len(own)
    if size == 1:
        return text
    shape = "".join(a[0] if a else c for c, a in zip(text, alphabets))
    value, out = permute(value, size, key, f"{tweak}:{shape}"), []
    for c, own in zip(reversed(text), reversed(alphabets)):
        if own:
            value, i = divmod(value, len(own))
            c = own[i]
        out.append(c)
    return "".join(reversed(out))


def walk(value: str, step: Callable[[str], str], sort: Callable[[str], object] = lambda x: None) -> str:
    """Follow a permutation from ``value`` to the next value of its sort.

    Each sort is permuted in itself, so distinctness holds for all values, whatever they are; a value that is the only
    one of its sort in its cycle stays.
    """
    want, now = sort(value), step(value)
    while now != value and sort(now) != want:
        now = step(now)
    return now


def luhn(digits: str) -> bool:
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(x - 9 if x > 9 else x for x in doubled) % 10 == 0


def iban_ok(text: str) -> bool:
    body = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in body[4:] + body[:4])) % 97 == 1


def _refill(text: str, digits: str) -> str:
    """Put other digits in the places of the digits of ``text``."""
    rest = iter(digits)
    return "".join(next(rest) if c in DIGITS else c for c in text)


def _only(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def _card(value: str, key: bytes) -> str:
    digits = _only(value)
    made = walk(digits[1:], lambda x: permute_text(x, key, "card" + digits[0]), lambda x: luhn(digits[0] + x))
    return _refill(value, digits[0] + made)


def _ip(value: str, key: bytes) -> str:
    """Other addresses of the range 10.0.0.0/8 for those, of those that hosts have for these, and of the rest."""
    def number(x: str) -> int:
        a, b, c, d = map(int, x.split("."))
        return a << 24 | b << 16 | c << 8 | d

    def sort(x: str) -> tuple[bool, bool]:
        a = int(x.split(".")[0])
        return a == 10, 0 < a < 224 and a != 127

    def step(x: str) -> str:
        if value.startswith("10."):
            y = 10 << 24 | permute(number(x) & 0xFFFFFF, 1 << 24, key, "ip10")
        else:
            y = permute(number(x), 1 << 32, key, "ip")
        return f"{y >> 24}.{y >> 16 & 255}.{y >> 8 & 255}.{y & 255}"

    return walk(value, step, sort)


def _iban(value: str, key: bytes) -> str:
    """Same country and grouping; check digits made anew where they held."""
    body = value.replace(" ", "")
    rest = walk(body[4:], lambda x: permute_text(x, key, "iban" + body[:2]))
    check = body[2:4]
    if iban_ok(body):
        check = f"{98 - int(''.join(str(int(c, 36)) for c in rest + body[:2] + '00')) % 97:02d}"
    made = iter(body[:2] + check + rest)
    return "".join(" " if c == " " else next(made) for c in value)


def _email(value: str, key: bytes) -> str:
    """The local part and the domain's names permuted by format; the last label stays, so the address keeps its look.

    Letter case does not part addresses, so the surrogate follows the lower-case form and takes the case over.
    """
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    local, domain = low.rsplit("@", 1)
    head, _, tail = domain.rpartition(".")
    made = walk(f"{local}@{head}", lambda x: permute_text(x, key, "email" + tail)) + "." + tail
    return "".join(m.upper() if c.isupper() and len(m.upper()) == 1 else m for c, m in zip(value, made))


def _hex(value: str, kept: int, key: bytes, tweak: str) -> str:
    """Hexadecimal digits after the first ``kept`` permuted; small and capital letters write the same value."""
    low, seen, places = value.lower(), 0, []
    for i, c in enumerate(low):
        if c in HEX:
            seen += 1
            if seen > kept:
                places.append(i)
    shape = "".join("0" if i in places else c for i, c in enumerate(low))
    digits = "".join(low[i] for i in places)
    made = walk(digits, lambda x: f"{permute(int(x, 16), 16 ** len(x), key, tweak + shape):0{len(x)}x}") if digits else ""
    out = dict(zip(places, made))
    text = "".join(out.get(i, c) for i, c in enumerate(low))
    return text.upper() if value != low else text


def _pick(name: str, names: list[str], key: bytes, tweak: str) -> str:
    order = sorted(names)
    return walk(name, lambda x: order[permute(order.index(x), len(order), key, tweak)])


@lru_cache(1 << 16)
def surrogate(kind: str, value: str, key: bytes) -> str:
    """The replacement of one entity: same kind, script, format and, for given names, gender; never the same text
    unless its format has no other."""
    if kind == "email":
        return _email(value, key)
    if kind == "card":
        return _card(value, key)
    if kind == "ip":
        return _ip(value, key)
    if kind == "iban":
        return _iban(value, key)
    if kind == "mac":
        return _hex(value, 0, key, kind)
    if kind == "ipv6":  # the first group, which tells the scope, stays
        return _hex(value, len(value.split(":")[0]), key, kind)
    if kind == "phone":  # the country code stays
        head = m[0] if (m := re.match(r"\+[0-9]{1,3}(?=[ .-])", value)) else ""
        return head + _refill(value[len(head) :], walk(_only(value[len(head) :]), lambda x: permute_text(x, key, "phone" + head)))
    if kind == "ssn":
        return _refill(value, walk(_only(value), lambda x: permute_text(x, key, "ssn"), lambda x: x[:3] in ("000", "666") or x[0] == "9"))
    if kind == "other":  # no listed name, so it takes no listed one either
        return walk(value, lambda x: permute_text(x, key, kind), lambda x: x in _LISTED)
    if kind == "female":
        return _pick(value, FEMALE, key, kind)
    if kind == "male":
        return _pick(value, MALE, key, kind)
    return _pick(value, FAMILY, key, kind)


def _valid(kind: str, value: str) -> bool:
    if kind == "card":
        digits = _only(value)
        return luhn(digits) or len(digits) == 16 and digits[0] in "23456" and len(set(digits)) > 2
    if kind == "ipv6":
        try:
            ipaddress.IPv6Address(value)
        except ValueError:
            return False
    return kind != "iban" or iban_ok(value)


def _titled(m: re.Match) -> list[tuple[int, int, str]]:
    new = []
    for w in re.finditer(r"[^\x20]+", m["words"]):
        if w[0][0].islower() or w[0] in ("I", "A"):
            break
        if not new and w[0] in _GIVEN:
            kind = "female" if w[0] in FEMALE else "male"
        else:
            kind = "family" if w[0] in FAMILY else "other"
        new.append((m.start("words") + w.start(), m.start("words") + w.end(), kind))
    return new


def entities(text: str) -> list[tuple[int, int, str]]:
    """Spans that do not overlap, by start; earlier kinds win over later ones. A name gives a span for each part.

    After a title up to three capitalised words, of any script, are a name; words of no list are of kind ``other``.
    """
    found: list[tuple[int, int, str]] = []
    for kind, pattern in _COMPILED.items():
        new = []
        for m in pattern.finditer(text):
            if kind == "titled":
                new += _titled(m)
            elif kind in ("name", "pair"):
                new += [(*m.span(p), p if p == "family" else "female" if m[p] in FEMALE else "male") for p in ("given", "family") if m[p]]
            elif _valid(kind, m[0]):
                new.append((*m.span(), kind))
        if new:  # out of reach of later kinds
            out, at = [], 0
            for a, b, _ in new:
                out += [text[at:a], "\0" * (b - a)]
                at = b
            text = "".join([*out, text[at:]])
        found += new
    return sorted(found)


def redact(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with surrogates, and the spans that they replaced."""
    spans, out, at = entities(text), [], 0
    for a, b, kind in spans:
        out += [text[at:a], surrogate(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), spans


def stored_key(spark: SparkSession) -> bytes:
    """The session's ``spark.graphloom.pii.key`` (hexadecimal), or else a random key kept in the shared folder, made
    when it is first asked for. Whoever may read that folder can invert the surrogates: keep it apart from the data."""
    if given := spark.conf.get("spark.graphloom.pii.key", None):
        return bytes.fromhex(given)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/graphloom/pii.key")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):  # written aside and renamed, so that it is there whole or not at all
        aside = jvm.org.apache.hadoop.fs.Path(f"{path.toString()}.{random_bytes.token_hex(8)}")
        out = fs.create(aside, False)
        out.write(bytearray(random_bytes.token_bytes(32)))
        out.close()
        if not fs.rename(aside, path):
            fs.delete(aside, False)
    held = fs.open(path)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(held))
    finally:
        held.close()


def collisions(docs: DataFrame, key: bytes) -> DataFrame:
    """``(kind, surrogate, n)`` of surrogates that stand for ``n`` > 1 distinct entities of ``docs``: always empty.

    Letter case and grouping do not tell entities apart. Copies fold before the shuffle.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {(k, t[a:b]) for t in batch.column("text").to_pylist() if t for a, b, k in entities(t)}
            flat = [(k, _same(k, x), _same(k, surrogate(k, x, key))) for k, x in rows]
            cols = list(zip(*flat)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "entity", "surrogate"])

    made = id_text(docs).mapInArrow(run, "kind string, entity string, surrogate string").distinct()
    return made.groupBy("kind", "surrogate").agg(F.count("*").alias("n")).where("n > 1")


def _same(kind: str, value: str) -> str:
    """What is equal for spellings of one entity."""
    if kind in ("card", "ssn"):
        return _only(value)
    return value.replace(" ", "") if kind == "iban" else value.lower() if kind in ("email", "mac", "ipv6") else value


def replace_pii(docs: DataFrame, key: bytes, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, n_entities, spans (``kind:start:end`` in the old text, by start), redacted.

    Whole texts; null stays null and empty empty, both without entities; null ids stay. Equal entities get equal
    surrogates in all documents under one key, distinct ones of a format distinct surrogates. Repeated rows give equal
    results; extra columns are not read, and those in ``carry`` pass through; an empty table gives no rows. One pass,
    no shuffle.
    """
    if not key:
        raise ValueError("surrogates need a key")
    names = ["doc_id", "n_entities", "spans", "redacted"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            may = pc.fill_null(pc.match_substring_regex(texts, MAY_HAVE), False).to_pylist()
            counts, spans, out = [], [], texts.to_pylist()
            for i, m in enumerate(may):
                found: list = []
                if m:
                    out[i], found = redact(out[i], key)
                counts.append(len(found))
                spans.append(",".join(f"{k}:{a}:{b}" for a, b, k in found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, pa.string()), pa.array(out, pa.string()), *map(batch.column, carry)], [*names, *carry])

    return id_text(docs, *carry).mapInArrow(run, "doc_id long, n_entities long, spans string, redacted string" + carried_schema(docs, carry))
