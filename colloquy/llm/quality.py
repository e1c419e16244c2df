"""Quality rules by repetition coverage: how much of a text lies inside repeated n-grams and repeated lines.

For every length n of ``LIMITS`` the word n-grams of a text are fingerprinted by rolling hashes in numpy; an n-gram
that occurs again is duplicated, and each character of a word counts once however many duplicated n-grams hold it
(all occurrences count, the first included). Lines: the characters of words in lines that equal an earlier line.
A document fails where a share exceeds its limit. The limits fall with n as in the published rules of the Gopher
collection, but lie higher: those count the second occurrence on, here the first counts too, and one line that a short
text repeats once is no reason to lose it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import give_back, mix64, ship, slices
from .minhash import _word_hashes

#: n-gram length -> largest share of word characters inside duplicated n-grams.
LIMITS = {5: 0.40, 6: 0.38, 7: 0.36, 8: 0.34, 9: 0.32, 10: 0.30}
LINE_LIMIT = 0.30
MIN_WORDS = 50
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOLS = re.compile(r"[#*$%&|<>]")


def _repeated(grams: np.ndarray) -> np.ndarray:
    """Which n-grams occur at least twice."""
    _, where, n = np.unique(grams, return_inverse=True, return_counts=True)
    return n[where] > 1


def _covered(hit: np.ndarray, n: int, words: int) -> np.ndarray:
    """Which words lie inside one of the marked windows of n words."""
    step = np.zeros(words + 1, dtype=np.int64)
    at = np.nonzero(hit)[0]
    np.add.at(step, at, 1)
    np.add.at(step, at + n, -1)
    return np.cumsum(step[:-1]) > 0


def measure(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, dup_line_chars, worst n, its share)."""
    text = text or ""
    words = _WORD.findall(text)
    if not words:
        return 0, 0, len(_SYMBOLS.findall(text)), 0, 0, 0, 0, 0.0
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    chars = int(size.sum())
    seen, dup_lines, dup_chars = set(), 0, 0
    if "\n" in text:
        for line in text.split("\n"):
            if line in seen:
                found = _WORD.findall(line)
                if found:
                    dup_lines += 1
                    dup_chars += sum(map(len, found))
            else:
                seen.add(line)
    h = _word_hashes([w.encode("utf-8", "surrogatepass") for w in words])
    repeat, worst, share = 0, 0, 0.0
    s, margin = h, -1.0
    for n in range(2, max(LIMITS) + 1):
        if len(words) < n:
            break
        s = mix64(s[: len(h) - n + 1]) + h[n - 1 :]
        if n != 3 and n not in LIMITS:
            continue
        hit = _repeated(s)
        if not hit.any():
            break  # then no longer n-gram repeats either
        inside = _covered(hit, n, len(words))
        if n == 3:
            repeat = int(inside.sum())
        if n in LIMITS:
            x = int(size[inside].sum()) / chars
            if x - LIMITS[n] > margin:
                worst, share, margin = n, x, x - LIMITS[n]
    return len(words), chars, len(_SYMBOLS.findall(text)), dup_lines, repeat, dup_chars, worst, share


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, dup_line_chars long, worst_ngram int, worst_share double, base_failed boolean, kept boolean"


def verdict(m: tuple) -> tuple[bool, bool]:
    """(base_failed, kept) of a measurement."""
    words, chars, _, _, repeat, dup_chars, worst, share = m
    base = words < MIN_WORDS or 100 * repeat > 50 * words
    return base, not base and not (worst and share > LIMITS[worst]) and not (chars and dup_chars > LINE_LIMIT * chars)


def _rate(batches):
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}
    kinds = [types[x.split()[1]] for x in SCHEMA.split(", ")]
    for batch in batches:
        for part in slices(batch, 1024, 8 << 20):
            found = [measure(t) for t in part.column("text").to_pylist()]
            rows = [m + verdict(m) for m in found]
            cols = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), *cols], names)


def rate(documents: DataFrame) -> DataFrame:
    """Measurements, base_failed and kept for every row of documents (doc_id, text); nothing is shuffled.

    A null or empty text has no words and fails (fewer than 50 words). Lines are compared whole, spaces included, and
    count only if they hold a word. Repeated ids are rated row by row. Other columns are ignored.
    """
    ship(documents.sparkSession)
    return documents.select("doc_id", "text").mapInArrow(_rate, SCHEMA)


def _filter(batches):
    for batch in batches:
        for part in slices(batch, 1024, 8 << 20):
            yield part.filter(pa.array([verdict(measure(t))[1] for t in part.column("text").to_pylist()], pa.bool_()))
        give_back()


def keep_good(documents: DataFrame) -> DataFrame:
    """The rows of documents whose verdict is kept, with all their columns."""
    ship(documents.sparkSession)
    return documents.mapInArrow(_filter, documents.schema)


def oracle() -> str:
    """The contract's columns in DuckDB SQL."""
    lead = lambda k: f"lead(w, {k}) over g"
    lengths = [3, *LIMITS]
    grams = ", ".join(f"case when {lead(n - 1)} is not null then w || {' || '.join(f'chr(32) || {lead(k)}' for k in range(1, n))} end as g{n}" for n in lengths)
    counts = ", ".join(f"(g{n} is not null and count(*) over (partition by doc_id, g{n}) > 1)::int as d{n}" for n in lengths)
    cover = ", ".join(f"max(d{n}) over (partition by doc_id order by i rows between {n - 1} preceding and current row) as c{n}" for n in lengths)
    sums = ", ".join(f"sum(case when c{n} = 1 then length(w) else 0 end) as s{n}" for n in LIMITS)
    fails = " or ".join(f"coalesce(s{n}, 0) / word_chars > {x}" for n, x in LIMITS.items())
    return f"""
with word as (
  select doc_id, unnest(r) as w, generate_subscripts(r, 1) as i
  from (select doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') as r from documents)
), gram as (select doc_id, i, w, {grams} from word window g as (partition by doc_id order by i)
), dup as (select doc_id, i, w, {counts} from gram
), cov as (select doc_id, w, {cover} from dup
), per as (select doc_id, count(*) as n_words, sum(length(w)) as word_chars, sum(c3) as n_repeat_words, {sums} from cov group by doc_id
), line as (
  select doc_id, l, row_number() over (partition by doc_id, l) as k
  from (select doc_id, unnest(string_split(text, chr(10))) as l from documents)
), lines as (
  select doc_id, count(*) as n_dup_lines, sum(list_sum(list_transform(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+'), lambda x: length(x)))) as dup_chars
  from line where k > 1 and regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by doc_id
), base as (
  select d.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
         coalesce(len(regexp_extract_all(text, '[#*$%&|<>]')), 0)::bigint as n_symbols, coalesce(n_dup_lines, 0)::bigint as n_dup_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words, coalesce(dup_chars, 0) as dup_chars, {", ".join(f"s{n}" for n in LIMITS)}
  from documents d left join per using (doc_id) left join lines using (doc_id)
), judged as (select *, n_words < {MIN_WORDS} or 100 * n_repeat_words > 50 * n_words as base_failed from base)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and not ({fails}) and not (dup_chars > {LINE_LIMIT} * word_chars) as kept
from judged
"""
