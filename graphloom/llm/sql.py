"""SQL (DuckDB) for the operators that SQL can express; each says the contract again, relationally."""

from __future__ import annotations

from graphloom.llm import language, mixing, quality

WORD = r"[^\x20\x09-\x0D]"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _count(column: str, chars: str) -> str:
    """How many characters of ``column`` are among ``chars``."""
    return f"length({column}) - length(translate({column}, {_quoted(chars)}, ''))"


SUFFIX_DEDUP = """
with d as (select doc_id, hex(encode(coalesce(text, ''))) h from documents),
p as (select doc_id, base, substr(h, 2 * base + 1, 2 * 256 + 98) part, length(h) // 2 - base own from (select doc_id, h, unnest(range(0, length(h) // 2, 256)) base from d)),
b as (select doc_id, base, part, own, unnest(range(least(own, 256))) j from p),
w as (select doc_id, base + j i, substr(part, 2 * j + 1, 2) as byte, case when j + 50 <= own then substr(part, 2 * j + 1, 100) end k from b),
f as (select k, min(doc_id) least_id from w where k is not null group by k having min(doc_id) < max(doc_id)),
s as (select w.doc_id, i, byte, case when f.least_id < w.doc_id then i end hit from w left join f on f.k = w.k),
c as (select doc_id, i, byte, coalesce(max(hit) over (partition by doc_id order by i rows unbounded preceding) > i - 50, false) gone from s),
e as (select *, gone and not coalesce(lag(gone) over (partition by doc_id order by i), false) opens from c),
r as (select doc_id, count(*) filter (gone) n_removed, count(*) filter (opens) n_spans, string_agg(byte, '' order by i) filter (not gone) kept from e group by doc_id)
select d.doc_id, length(h) // 2 n_bytes, coalesce(n_removed, 0) n_removed, coalesce(n_spans, 0) n_spans, sha256(unhex(coalesce(kept, ''))) kept_sha256
from d left join r on r.doc_id = d.doc_id
"""

_BOILERPLATE = " or ".join(f"contains(lower(line), {_quoted(x)})" for x in quality.BOILERPLATE)

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
w as (select doc_id, unnest(range(len(x))) i, unnest(x) as word from (select doc_id, regexp_extract_all(text, '{WORD}+') x from d)),
t as (select *, lead(word) over p word2, lead(word, 2) over p word3 from w window p as (partition by doc_id order by i)),
n as (select doc_id, i, word3 is not null and count(*) over (partition by doc_id, word, word2, word3) > 1 twice from t),
c as (select doc_id, coalesce(bool_or(twice) over (partition by doc_id order by i rows between 2 preceding and current row), false) covered from n),
r as (select doc_id, count(*) n_words, count(*) filter (covered) n_repeat_words from c group by doc_id),
l as (select doc_id, i, line, len(regexp_extract_all(line, '{WORD}+')) m from (select doc_id, unnest(x) line, unnest(range(len(x))) i from (select doc_id, string_split(text, chr(10)) x from d))),
j as (select doc_id, line, m, i = max(i) over (partition by doc_id) is_last, {_count("line", quality.SYMBOLS)} marks, {_count("line", "!")} bangs, {_count("line", quality.SEPARATORS)} parts from l where m > 0),
v as (select *, 100 * marks > {quality.MAX_MARKS_PERCENT} * m or (100 * bangs > {quality.MAX_MARKS_PERCENT} * m and bangs > 1)
 or (not is_last and m <= {quality.MAX_OPEN_WORDS} and not regexp_matches(line, {_quoted(quality.TERMINAL)}))
 or (parts >= {quality.MIN_SEPARATORS} and parts * {quality.WORDS_A_SEPARATOR} >= m) or {_BOILERPLATE} fails from j),
g as (select doc_id, count(*) - count(distinct line) n_dup_lines, count(*) filter (fails) n_failed_lines, coalesce(sum(m) filter (fails), 0)::bigint n_lost_words from v group by doc_id),
a as (select d.doc_id, coalesce(n_words, 0) n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')) word_chars, {_count("text", quality.SYMBOLS)} n_symbols,
 coalesce(n_dup_lines, 0) n_dup_lines, coalesce(n_repeat_words, 0) n_repeat_words, coalesce(n_failed_lines, 0) n_failed_lines, coalesce(n_lost_words, 0) n_lost_words
 from d left join r on r.doc_id = d.doc_id left join g on g.doc_id = d.doc_id),
o as (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words base_failed from a)
select *, not base_failed and 100 * n_lost_words <= {quality.MAX_LOST_PERCENT} * n_words kept from o
"""

_W, _B, _T = f"[{', '.join(map(str, mixing.WEIGHTS))}]", mixing.BLOCK_WORDS, mixing.MAX_TIMES

MIXING = f"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}+'))::bigint size from documents),
s as (select source, sum(size)::bigint source_size from d group by source),
p as (select *, row_number() over (order by source is null, encode(source)) - 1 nr, (select sum(source_size) from s)::bigint total from s),
q as (select *, ({_W})[(nr % {len(mixing.WEIGHTS)} + 1)::int] weight, {_T} * source_size cap from p),
u as (select *, cap / weight fill from q),
y as (select *, (total - coalesce(sum(cap) over (order by fill, nr rows between unbounded preceding and 1 preceding), 0))::bigint / sum(weight) over (order by fill, nr rows between current row and unbounded following)::bigint level from u),
z as (select arg_min(level, (fill, nr)) level from y where level <= fill),
g as (select nr, source, source_size, total, least(cap::double, weight * z.level) target from u, z),
h as (select *, sum(target) over (order by nr rows unbounded preceding) / total upto from g),
i as (select *, coalesce(lag(upto) over (order by nr), 0) lo, case when nr = max(nr) over () then 1 else upto end hi, (source_size + {_B - 1}) // {_B} n_blocks from h),
k as (select id, (id // 1048576)::double * {mixing.GOLDEN_20!r}::double + (id % 1048576)::double * {mixing.GOLDEN!r}::double point from (select unnest(range((select (max(total) + {_B - 1}) // {_B} from p))) id)),
m as (select id, nr, n_blocks from (select id, point - floor(point) point from k) join i on point >= lo and point < hi),
r as (select nr, n_blocks, row_number() over (partition by nr order by id) - 1 place from m),
t as (select nr, place % n_blocks as block, count(*) times from r where place < {_T} * n_blocks group by 1, 2),
x as (select row_number() over () row_id, doc_id, size, nr, d.source, source_size, target from d join i on d.source is not distinct from i.source),
l as (select *, (sum(size) over (partition by nr order by md5(coalesce(doc_id::varchar, '') || ':' || size), doc_id, size rows unbounded preceding) - size)::bigint begin_at from x),
c as (select row_id, nr, size, begin_at, unnest(range(begin_at // {_B}, (begin_at + size - 1) // {_B} + 1)) as block from l where size > 0),
o as (select row_id, sum(times * (least(begin_at + size, (c.block + 1) * {_B}) - greatest(begin_at, c.block * {_B})))::bigint taken from c join t on t.nr = c.nr and t.block = c.block group by 1)
select doc_id, size, source_size, target, coalesce(taken, 0) taken from l left join o on o.row_id = l.row_id
"""

# Profiles are learned from all texts not held out, as the operator does up to SAMPLE texts a language.
_CRC = "list_reduce(list_prepend(4294967295::bigint, [ord(x)::bigint for x in string_split(doc_id::varchar, '')]), lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda a, i: xor(a >> 1, 3988292384 * (a & 1))))"
_GRAMS = "len(word) + 2 - n + 1 - 2 * (n = 1)::int"
_N = ", ".join(map(str, language.LENGTHS))

LANGUAGE = f"""
with d as (select doc_id, lang, text, xor({_CRC}, 4294967295) % 4 = 2 held_out from documents),
w as (select doc_id, unnest(regexp_extract_all(lower(text), '\\p{{L}}+')) as word from d),
u as (select doc_id, word, count(*) times from w group by 1, 2),
n as (select unnest([{_N}]) n),
p as (select doc_id, word, times, n, unnest(range({_GRAMS})) + (n = 1)::int + 1 i from u, n),
c as (select lang, substr('_' || word || '_', i, n) gram, sum(times) total from p join d using (doc_id) where not held_out and lang is not null group by 1, 2),
r as (select lang, gram, row_number() over (partition by lang order by total desc, gram) - 1 rank from c qualify rank < {language.TOP}),
g as (select doc_id, substr('_' || word || '_', i, n) gram, sum(times) total from p group by 1, 2),
h as (select doc_id, gram, row_number() over (partition by doc_id order by total desc, len(gram), gram) - 1 rank from g qualify rank < {language.TOP}),
s as (select h.doc_id, l.lang, sum(case when r.rank is null then {language.TOP} else abs(r.rank - h.rank) end)::bigint apart, count(*) * {language.TOP} most
 from h cross join (select distinct lang from r) l left join r on r.lang = l.lang and r.gram = h.gram group by 1, 2),
b as (select doc_id, arg_min(lang, (apart, lang)) lang_pred, 1 - min(apart) / min(most) score from s group by 1)
select d.doc_id, held_out, coalesce(lang_pred, 'und') lang_pred, coalesce(score, 0) score from d left join b on b.doc_id = d.doc_id
"""

ORACLE_SQL: dict[str, str] = {"op1_suffix_dedup": SUFFIX_DEDUP, "op2_quality_rules": QUALITY, "op6_mixing": MIXING, "op7_language": LANGUAGE}
