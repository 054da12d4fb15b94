"""Secret scans by a worklist of decoded layers, each scanned again, with spans mapped back to the original text."""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from graphloom.llm.common import id_text

# The base patterns, in the order of their kinds.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")
LEAST = {"assign": 12, "access": 18, "hex": 16}

#: ASCII case folding alone: with Unicode rules the long s and the Kelvin sign would count as letters of the names.
_ASSIGN = re.compile(ASSIGN, re.I | re.A)
_ACCESS = re.compile(ACCESS)
#: A run is its own match whatever its length, so the least length can stand in the pattern.
_HEX = re.compile(r"[0-9a-f]{16,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"(?:\\u\{[0-9A-Fa-f]{1,6}\}|\\u[0-9A-Fa-f]{4}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#x[0-9A-Fa-f]{1,6};)+")
_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#x([0-9A-Fa-f]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_HEX_BYTES = re.compile(r"(?:[0-9a-fA-F]{2}){16,}")
#: A run over several lines, each of which holds nothing else but the first, which may follow something.
_WRAPPED = re.compile(r"""(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++(?=={0,2}[\x20\t]*+(?:\r?\n|$)|={0,2}["'<)\]},;]))+={0,2}""")
_SPACE = re.compile(r"[^\s]")
#: What a text must have before any layer can come of it, for one quick vectorised test.
_MAY_DECODE = r"%[0-9A-Fa-f]{2}|\\[ux]|&#|[A-Za-z0-9+/_-]{16}"
#: Decoded bytes count as text if all of them are, or if so long a run of ASCII is: shorter ones hold no secret.
_READABLE = re.compile(r"[\x20-\x7e\t\r\n]{16}")

#: A compressed stream is unpacked whole up to so many bytes; a longer one is scanned in pieces of this size, each with
#: the last OVERLAP characters of the one before, so memory is bounded.
MAX_UNPACKED, OVERLAP = 16 << 20, 1 << 20

Span = tuple[int, int, str]
#: A span with its text where it can't be told from others by its place: all of a compressed run has one place.
Found = tuple[int, int, str, str]
#: Decoded text, and for each of its characters where its encoded form begins and ends in the run; None: the whole run.
Decoded = tuple[str, np.ndarray | None, np.ndarray | None]

def base_spans(text: str) -> list[Span]:
    found = [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]


def _text(raw: bytes) -> tuple[str, np.ndarray | None]:
    """Bytes as UTF-8, or one by one if they are none; and where each character begins, None if each is a byte."""
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return raw.decode("latin-1"), None
    return text, None if len(text) == len(raw) else np.flatnonzero(np.frombuffer(raw, np.uint8) & 0xC0 != 0x80)


def _spread(raw: bytes, places: Callable, always: bool = False) -> Decoded | None:
    """Text of bytes of which the i-th stands at ``places(i)`` of a run; None if it is no text, unless ``always``."""
    text, at = _text(raw)
    if not text or not always and not _READABLE.search(text) and not all(c.isprintable() or c in "\t\n\r" for c in text):
        return None
    begin, end = places(np.arange(len(raw)))
    return (text, begin, end) if at is None else (text, begin[at], end[np.append(at[1:], len(raw)) - 1])


def _inflate(raw: bytes) -> Iterator[bytes]:
    """A gzip or zlib stream and further gzip members behind it, in pieces of MAX_UNPACKED bytes at most.

    What follows the last member and is none is left out, as gzip does; an unfinished stream gives what it has.
    """
    more = True
    while more:
        stream = zlib.decompressobj(47)
        try:
            while raw and not stream.eof:
                out = stream.decompress(raw, MAX_UNPACKED)
                if not out and stream.unconsumed_tail == raw:
                    return
                raw = stream.unconsumed_tail
                yield out
                while not raw and not stream.eof and len(out) == MAX_UNPACKED:  # what the stream still holds
                    out = stream.decompress(b"", MAX_UNPACKED)
                    yield out
        except zlib.error:
            if stream.eof:
                return
            raise
        raw = stream.unused_data
        more = raw[:2] == b"\x1f\x8b"


def _unpacked(raw: bytes) -> str | frozenset[tuple[str, str]] | None:
    """Text of a gzip or zlib stream; of a large one the secrets in it, by kind. Bytes that are no UTF-8 are left out."""
    if raw[:2] != b"\x1f\x8b" and not (len(raw) > 2 and raw[0] & 15 == 8 and (raw[0] << 8 | raw[1]) % 31 == 0):
        return None
    held, size, known, tail = [], 0, None, ""
    decoder = codecs.getincrementaldecoder("utf-8")("replace")
    try:
        for piece in _inflate(raw):
            held.append(piece)
            size += len(piece)
            if size <= MAX_UNPACKED:
                continue
            text = tail + decoder.decode(b"".join(held))
            held, size = [], MAX_UNPACKED  # from here on, piece by piece
            # What ends in the second half of the overlap is seen whole by the next piece.
            known = (known or set()) | _secrets(text, len(text) - OVERLAP // 2)
            tail = text[-OVERLAP:]
    except zlib.error:
        return None
    text = tail + decoder.decode(b"".join(held), True)
    return text or None if known is None else frozenset(known | _secrets(text, len(text)))


def _secrets(text: str, end: int) -> set[tuple[str, str]]:
    """Secrets in a text, by kind, that end at ``end`` at the latest."""
    return {(k, v or text[a:b]) for a, b, k, v in [*((*x, "") for x in base_spans(text)), *layer_spans(text)] if b <= end}


def _url(run: str) -> Decoded:
    raw = binascii.unhexlify(run.replace("%", ""))
    return _spread(raw, lambda i: (3 * i, 3 * i + 3), True)


def _escape(run: str) -> Decoded:
    chars, begin, end = [], [], []
    for m in _ONE.finditer(run):
        a, b, c, d, e = m.groups()
        point = int(d) if d else int(a or b or c or e, 16)
        if 0xDC00 <= point < 0xE000 and chars and 0xD800 <= chars[-1] < 0xDC00:  # the second half of a character
            chars[-1] = 0x10000 + (chars[-1] - 0xD800 << 10) + point - 0xDC00
            end[-1] = m.end()
        else:
            chars.append(point if point < 0x110000 else 0xFFFD)
            begin.append(m.start())
            end.append(m.end())
    text = "".join(chr(0xFFFD if 0xD800 <= x < 0xE000 else x) for x in chars)
    return text, np.array(begin), np.array(end)


def _bytes(raw: bytes, places: Callable) -> Decoded | frozenset | None:
    more = _unpacked(raw)
    return (more, None, None) if isinstance(more, str) else more or _spread(raw, places)


def _base64(run: str) -> Decoded | frozenset | None:
    body = run.rstrip("=")
    # Words, numbers and names are no base64: it mixes letter cases or has digits among letters.
    if len(body) % 4 == 1 or body.isdigit() or not (re.search("[A-Z]", body) and re.search("[a-z]", body)):
        return None
    raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))
    return _bytes(raw, lambda i: (i * 4 // 3, (i * 4 + 6) // 3))


def _hex_bytes(run: str) -> Decoded | frozenset | None:
    raw = binascii.unhexlify(run)
    return _bytes(raw, lambda i: (2 * i, 2 * i + 2))


def _wrapped(run: str) -> Decoded | frozenset | None:
    body = "".join(run.split())
    new = _hex_bytes(body) if _HEX_BYTES.fullmatch(body) else _base64(body)
    if new is None or isinstance(new, frozenset) or new[1] is None:
        return new
    at = np.array([m.start() for m in _SPACE.finditer(run)])
    return new[0], at[new[1]], at[new[2] - 1] + 1


DECODERS = ((_URL, _url), (_ESCAPE, _escape), (_BASE64, _base64), (_HEX_BYTES, _hex_bytes), (_WRAPPED, _wrapped))

#: A part of a layer: where it starts there, its length, and where its characters begin and end in the original text:
#: numbers (the first's place, None: character by character; the whole's ends), or a place for every character.
Piece = tuple[int, int, "int | np.ndarray", "int | None | np.ndarray"]


def _at(starts: list[int], x: int) -> int:
    return bisect_right(starts, x) - 1


def _begin(p: Piece, x: int) -> int:
    return p[2] + x - p[0] if p[3] is None else p[2] if isinstance(p[2], int) else int(p[2][x - p[0]])


def _end(p: Piece, x: int) -> int:
    return p[2] + x - p[0] + 1 if p[3] is None else p[3] if isinstance(p[3], int) else int(p[3][x - p[0]])


def _cut(p: Piece, a: int, b: int, to: int) -> Piece:
    """What of a piece lies in ``[a, b)``, to stand at ``to``."""
    if p[3] is None:
        return to, b - a, p[2] + a - p[0], None
    if isinstance(p[2], int):
        return to, b - a, p[2], p[3]
    return to, b - a, p[2][a - p[0] : b - p[0]], p[3][a - p[0] : b - p[0]]


def _places(parts: list[Piece]) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of the parts begins and ends in the original."""
    begin, end = [], []
    for _, n, a, b in parts:
        own = a + np.arange(n) if b is None else np.full(n, a) if isinstance(a, int) else a
        begin.append(own)
        end.append(own + 1 if b is None else np.full(n, b) if isinstance(b, int) else b)
    return np.concatenate(begin), np.concatenate(end)


def _unwrap(text: str, pieces: list[Piece], pattern: re.Pattern, decoder, found: list[Found]) -> tuple[str, list[Piece]] | None:
    """The layer with every run of one encoding decoded in place; None if there is none.

    A run that is too large to stand in a layer stays as it is, and the secrets in it go to ``found``. Pieces are gone
    through once, side by side with the runs.
    """
    out: list[str] = []
    made: list[Piece] = []
    at = length = cursor = 0

    def parts(a: int, b: int) -> list[Piece]:
        """The pieces of ``[a, b)``; every call begins where the one before ended, or later."""
        nonlocal cursor
        got = []
        while a < b:
            p = pieces[cursor]
            if (stop := p[0] + p[1]) <= a:
                cursor += 1
                continue
            got.append(_cut(p, a, min(b, stop), 0))
            a = min(b, stop)
        return got

    def put(own: list[Piece]) -> None:
        nonlocal length
        for p in own:
            made.append((length, *p[1:]))
            length += p[1]

    for m in pattern.finditer(text):
        a, b = m.span()
        if (new := decoder(m[0])) is None or not isinstance(new, frozenset) and new[0] == m[0]:
            continue
        put(parts(at, a))
        out.append(text[at:a])
        own, at = parts(a, b), b
        if isinstance(new, frozenset):
            found += [(_begin(own[0], 0), _end(own[-1], own[-1][1] - 1), k, v) for k, v in new]
            put(own)
            out.append(m[0])
            continue
        if new[1] is None:
            made.append((length, len(new[0]), _begin(own[0], 0), _end(own[-1], own[-1][1] - 1)))
        else:
            begin, end = _places(own)
            made.append((length, len(new[0]), begin[new[1]], end[new[2] - 1]))
        out.append(new[0])
        length += len(new[0])
    if not at:
        return None
    put(parts(at, len(text)))
    return "".join([*out, text[at:]]), made


def layer_spans(text: str) -> list[Found]:
    """Spans of secrets that show only in decoded layers, in places of the original text.

    A worklist: each layer is scanned and then unwrapped by every decoder; layers seen before, by digest, are not
    taken up again, so cycles end and the work stops at a fixpoint. Characters map back to what encodes them; those of
    a compressed run to all of it, and then each of its secrets is told apart by its text.
    """
    found: list[Found] = []
    work: list[tuple[str, list[Piece]]] = [(text, [(0, len(text), 0, None)])]
    seen = {hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()}
    while work:
        now, pieces = work.pop()
        for pattern, decoder in DECODERS:
            if (new := _unwrap(now, pieces, pattern, decoder, found)) is None:
                continue
            key = hashlib.blake2b(new[0].encode("utf-8", "surrogatepass"), digest_size=16).digest()
            if key in seen:
                continue
            seen.add(key)
            work.append(new)
            starts = [p[0] for p in new[1]]
            for a, b, kind in base_spans(new[0]):
                own = new[1][_at(starts, a) : _at(starts, b - 1) + 1]
                if any(p[3] is not None for p in own):
                    packed = any(isinstance(p[3], int) for p in own)
                    found.append((_begin(own[0], a), _end(own[-1], b - 1), kind, new[0][a:b] if packed else ""))
    return found


def joined(spans: list[Span]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], order[s[2]], s[1])))


def scan(text: str | None, may_decode: bool = True) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans."""
    base = base_spans(text) if text else []
    more = layer_spans(text) if text and may_decode else []
    base_ = [(*x, "") for x in base]
    return base, [x[:3] for x in dict.fromkeys(base_ + more)]


def secret_scan(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_decoded (spans from decoded layers).

    Every whole text is scanned; null and empty texts have no spans; null ids stay. Each secret of an encoded run has a
    span of its own, equal ones where a compressed run holds several. Repeated rows give equal results; extra columns
    are not read; an empty table gives no rows. One pass, no shuffle: quick vectorised tests over a batch pick the
    texts that the patterns can match at all.
    """
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            plain = pc.fill_null(pc.match_substring_regex(texts, f"(?i:{ASSIGN})|AKIA|[0-9a-f]{{16}}"), False)
            coded = pc.fill_null(pc.match_substring_regex(texts, _MAY_DECODE), False)
            rows = []
            for i, (p, c) in enumerate(zip(plain.to_pylist(), coded.to_pylist())):
                base, spans = scan(texts[i].as_py(), c) if p or c else ([], [])
                kinds = [k for _, _, k in base]
                rows.append((*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), len(spans) - len(set(base))))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
            cols = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))], names)

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_decoded long")
