"""Line-first quality rules: judge lines, remove those that fail, then reject documents that lose too much."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from graphloom.llm.common import carried_schema, id_text

# Phrases of boilerplate lines in English, German, French and Spanish, matched in lower case.
BOILERPLATE = (
    "all rights reserved",
    "licensed under",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "use cookies",
    "enable javascript",
    "click here",
    "sign up for our newsletter",
    "subscribe to our newsletter",
    "powered by",
    "lorem ipsum",
    "alle rechte vorbehalten",
    "nutzungsbedingungen",
    "datenschutzerklärung",
    "verwendet cookies",
    "klicken sie hier",
    "newsletter abonnieren",
    "tous droits réservés",
    "conditions d'utilisation",
    "politique de confidentialité",
    "utilise des cookies",
    "cliquez ici",
    "abonnez-vous à notre newsletter",
    "todos los derechos reservados",
    "términos y condiciones",
    "política de privacidad",
    "política de cookies",
    "utiliza cookies",
    "haga clic aquí",
    "suscríbete a nuestro boletín",
)
# Characters that count as symbols, and that part the entries of a menu.
SYMBOLS = "#*$%&|<>"
SEPARATORS = "|»›•·>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line fails where its symbols, or its exclamation marks, exceed this share of its words.
MAX_MARKS_PERCENT = 30
#: A line is navigation with so many separators at least, and one for so many words.
MIN_SEPARATORS, WORDS_A_SEPARATOR = 3, 4
#: How a sentence ends; a line of so few words that ends otherwise, and isn't the text's last, is a label or a heading.
TERMINAL = r"""[.!?…:;。！？؟]["'”’»›)\]]*[\x20\x09-\x0D]*$"""
MAX_OPEN_WORDS = 11
#: A document is rejected when more than this share of its words stood in failed lines.
MAX_LOST_PERCENT = 50

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_failed_lines long, n_lost_words long, clean_text string"
)


_ENDS = re.compile(TERMINAL)


def line_fails(line: str, n_words: int, last: bool = False) -> bool:
    """The rules for one line with ``n_words`` words, at least one; ``last`` is that of the text's lines with words."""
    if not last and n_words <= MAX_OPEN_WORDS and not _ENDS.search(line):
        return True
    if 100 * sum(map(line.count, SYMBOLS)) > MAX_MARKS_PERCENT * n_words or 100 * line.count("!") > MAX_MARKS_PERCENT * n_words and line.count("!") > 1:
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= MIN_SEPARATORS and separators * WORDS_A_SEPARATOR >= n_words:
        return True
    low = line.lower()
    return any(x in low for x in BOILERPLATE)


def repeat_words(words: list) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    if len(words) < 4:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if counts[w] > 1:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def judge(text: str | None) -> tuple:
    """The row of one text, but for its id."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n, seen, dup, failed, lost, left = len(words), set(), 0, 0, 0, []
    lines = [(line, len(line.encode("utf-8", "surrogatepass").split())) for line in text.split("\n")]
    last = max((i for i, (_, m) in enumerate(lines) if m), default=-1)
    for i, (line, m) in enumerate(lines):
        if m:
            if line in seen:
                dup += 1
            seen.add(line)
            if line_fails(line, m, i == last):
                failed, lost = failed + 1, lost + m
                continue
        left.append(line)
    repeats = repeat_words(words)
    base = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
    kept = not base and 100 * lost <= MAX_LOST_PERCENT * n
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeats, base, kept, failed, lost, "\n".join(left)


def quality_rules(docs: DataFrame, with_text: bool = True, carry: tuple[str, ...] = ()) -> DataFrame:
    """Judge every whole text, line by line and then as a document.

    Rows and ids pass one to one. A null or empty text has no words and so fails the base rules; its clean text is
    empty. Repeated rows are judged alike; extra columns of ``docs`` are not read, and those in ``carry`` pass through. An empty table gives no rows.
    No shuffle: one pass over (doc_id, text).
    """
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    if not with_text:
        names.remove("clean_text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = list(zip(*map(judge, batch.column("text").to_pylist()))) or [[]] * 10
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()]
            made = [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays([*made[: len(names)], *map(batch.column, carry)], [*names, *carry])

    schema = ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in names)
    return id_text(docs, *carry).mapInArrow(run, schema + carried_schema(docs, carry))
