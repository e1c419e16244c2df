"""Word alignments: edit distance with its path in memory of one row, unheard words, and words in another script."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import WILD, arrow

#: A block of this many cells keeps its steps; larger ones are halved.
CELLS = 1 << 22
#: Cells of all texts that are aligned side by side.
SIDE = 1 << 20
MATCH, DELETE, INSERT = 0, 1, 2


class _Grid:
    """The cost table of a reference (rows) against a hypothesis (columns), one row at a time."""

    def __init__(self, ref: list[str], hyp: list[str], free_ends: bool, wild: str | None):
        ids = {w: k for k, w in enumerate(dict.fromkeys([*ref, *hyp]))}
        self.ref, self.hyp = np.array([ids[w] for w in ref], np.int64), np.array([ids[w] for w in hyp], np.int64)
        self.wild = np.array([w == wild for w in ref], bool)
        self.step = np.arange(len(hyp) + 1, dtype=np.int32)
        self.first = np.zeros(len(hyp) + 1, np.int32) if free_ends else self.step.copy()

    def _options(self, i: int, above: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of ending row i + 1 by a pair (not in the first column) and by a deletion; a wild word costs nothing."""
        free = self.wild[i]
        return above[:-1] + (0 if free else (self.hyp != self.ref[i])), above + (0 if free else 1)

    def below(self, i: int, above: np.ndarray) -> np.ndarray:
        pair, deleted = self._options(i, above)
        row = deleted.copy()
        np.minimum(row[1:], pair, out=row[1:])
        return np.minimum.accumulate(row - self.step) + self.step

    def steps(self, i: int, above: np.ndarray, row: np.ndarray) -> np.ndarray:
        """The step into each cell of row i + 1: a pair before a deletion before an insertion, where they cost the same."""
        pair, deleted = self._options(i, above)
        out = np.full(len(row), INSERT, np.uint8)
        out[deleted == row] = DELETE
        out[1:][pair == row[1:]] = MATCH
        return out

    def trace(self, low: int, high: int, above: np.ndarray, j: int, out: list[tuple[int, int, int]]) -> int:
        """Appends the steps (kind, row, column) of rows low + 1 to high back from column j; the column where row low is met."""
        if high - low == 1 or (high - low) * len(above) <= CELLS:
            kept, row = [], above
            for i in range(low, high):
                new = self.below(i, row)
                kept.append(self.steps(i, row, new))
                row = new
            i = high
            while i > low:
                kind = int(kept[i - low - 1][j])
                out.append((kind, i - 1, j - 1))
                i, j = i - (kind != INSERT), j - (kind != DELETE)
            return j
        middle, row = (low + high) // 2, above
        for i in range(low, middle):
            row = self.below(i, row)
        return self.trace(low, middle, above, self.trace(middle, high, row, j, out), out)


def path(ref: list[str], hyp: list[str], free_ends: bool = False, wild: str | None = None) -> list[tuple[int, int, int]]:
    """The steps (kind, place in ref, place in hyp) of the cheapest alignment, in order.

    With ``free_ends`` words of the hypothesis before and behind it cost nothing and have no step; the first of equally
    good ends counts. A reference word ``wild`` pairs with any word and goes missing for nothing. Memory is a few rows
    a halving of the reference, and time twice that of the costs alone and more, by one half a halving.
    """
    grid = _Grid(ref, hyp, free_ends, wild)
    row = grid.first
    j = len(hyp)
    if free_ends:
        for i in range(len(ref)):
            row = grid.below(i, row)
        j = int(row.argmin())
    out: list[tuple[int, int, int]] = []
    j = grid.trace(0, len(ref), grid.first, j, out) if ref else j
    if not free_ends:
        out += [(INSERT, -1, k) for k in range(j - 1, -1, -1)]
    return out[::-1]


def _paths(refs: list[list[str]], hyps: list[list[str]], free_ends: bool, wild: str | None) -> list[list[tuple[int, int, int]]]:
    """``path`` of each pair, all of them side by side: a row of every cost table at a time. References come longest first."""
    n, m = np.array([len(r) for r in refs]), np.array([len(h) for h in hyps])
    ids: dict[str, int] = {}
    number = lambda words: [ids.setdefault(w, len(ids)) for w in words]
    ref, hyp = np.full((len(refs), n.max()), -1, np.int32), np.full((len(hyps), m.max()), -2, np.int32)
    for k, (r, h) in enumerate(zip(refs, hyps, strict=True)):
        ref[k, : n[k]], hyp[k, : m[k]] = number(r), number(h)
    dear = (ref != ids.get(wild, -3)).astype(np.int32)  # what a word costs that pairs with another one or is deleted
    step = np.arange(hyp.shape[1] + 1, dtype=np.int32)
    row = np.zeros((len(refs), len(step)), np.int32) + (0 if free_ends else step)
    kept = np.full((n.max(), *row.shape), INSERT, np.uint8)
    for i in range(n.max()):
        k = int(np.searchsorted(-n, -i, side="left"))  # how many have such a word
        above, cost = row[:k], dear[:k, i, None]
        pair, deleted = above[:, :-1] + cost * (hyp[:k] != ref[:k, i, None]), above + cost
        low = deleted - step
        np.minimum(low[:, 1:], pair - step[1:], out=low[:, 1:])
        new = np.minimum.accumulate(low, axis=1) + step
        out = kept[i, :k]
        out[deleted == new] = DELETE
        out[:, 1:][pair == new[:, 1:]] = MATCH
        row[:k] = new
    j = np.where(step > m[:, None], np.iinfo(np.int32).max, row).argmin(axis=1) if free_ends else m.copy()
    i, taken = n.copy(), []
    at = np.nonzero(i > 0)[0]
    while len(at):
        kind = kept[i[at] - 1, at, j[at]]
        taken.append((at, kind, i[at] - 1, j[at] - 1))
        i[at] -= kind != INSERT
        j[at] -= kind != DELETE
        at = at[i[at] > 0]
    own, *steps = (np.concatenate(x) for x in zip(*taken, strict=True)) if taken else [np.zeros(0, int)] * 4
    by = np.argsort(own, kind="stable")
    bound = np.searchsorted(own[by], np.arange(len(refs) + 1))
    flat = list(zip(*(x[by].tolist() for x in steps), strict=True))
    found = [flat[a:b] for a, b in zip(bound[:-1], bound[1:], strict=True)]
    if not free_ends:
        found = [f + [(INSERT, -1, c) for c in range(k - 1, -1, -1)] for f, k in zip(found, j.tolist(), strict=True)]
    return [f[::-1] for f in found]


def paths(refs: list[list[str]], hyps: list[list[str]], free_ends: bool = False, wild: str | None = None) -> list[list[tuple[int, int, int]]]:
    """``path`` of each pair of texts. Texts of like length go side by side, up to ``SIDE`` cells at once; longer ones alone."""
    out: list = [None] * len(refs)
    some, wide = [], 0

    def go() -> None:
        for k, steps in zip(some, _paths([refs[k] for k in some], [hyps[k] for k in some], free_ends, wild) if some else [], strict=True):
            out[k] = steps
        some.clear()

    for k in sorted(range(len(refs)), key=lambda k: (-len(refs[k]), -len(hyps[k]))):
        if not refs[k] or len(refs[k]) * (len(hyps[k]) + 1) > SIDE // 4:
            out[k] = path(refs[k], hyps[k], free_ends, wild)
            continue
        wide = max(wide if some else 0, len(hyps[k]) + 1)
        if some and (len(some) + 1) * len(refs[some[0]]) * wide > SIDE:
            go()
            wide = len(hyps[k]) + 1
        some.append(k)
    go()
    return out


def align(ref: list[str], hyp: list[str], free_ends: bool = True, wild: str | None = WILD) -> tuple[int, int, int, list[tuple[str, str | None]]]:
    """(substitutions, deletions, insertions, pairs) of ``path``; a pair's second word is None where the first was said.

    A deletion pairs with an empty word, an insertion is the pair of an empty word. Wild words never count.
    """
    return _counted(ref, hyp, path(ref, hyp, free_ends, wild), wild)


def _counted(ref: list[str], hyp: list[str], steps: list[tuple[int, int, int]], wild: str | None) -> tuple[int, int, int, list[tuple[str, str | None]]]:
    counts, pairs = [0, 0, 0], []
    for kind, i, j in steps:
        if kind == MATCH:
            same = ref[i] == hyp[j] or ref[i] == wild
            counts[0] += not same
            pairs.append((ref[i], None if same else hyp[j]))
        elif kind == DELETE:
            counts[1] += ref[i] != wild
            pairs.append((ref[i], ""))
        else:
            counts[2] += 1
            pairs.append(("", hyp[j]))
    return (*counts, pairs)


def edit_counts(ref: list[str], hyp: list[str], free_end: bool = False, wild: str | None = None) -> tuple[int, int, int]:
    """(substitutions, deletions, insertions) of the cheapest alignment; ``free_end``: as ``free_ends`` of ``path``."""
    return align(ref, hyp, free_end, wild)[:3]


_COUNTS = "substitutions int, deletions int, insertions int, n_ref int"


@arrow(_COUNTS)
def word_errors(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edit counts of two normalized texts, word by word."""
    a, b = [(r or "").split() for r in ref], [(h or "").split() for h in hyp]
    rows = [(*_counted(r, h, steps, None)[:3], len(r)) for r, h, steps in zip(a, b, paths(a, b), strict=True)]
    return pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "n_ref"]).astype("int32")


@arrow(f"struct<{_COUNTS.replace(' int', ':int')},pairs:array<struct<ref:string,hyp:string>>>")
def fragment_alignment(ref: pd.Series, hyp: pd.Series) -> pd.DataFrame:
    """Edit counts and pairs of a fragment inside a longer text; unheard words of it match anything and do not count."""
    said, heard, rows = [(r or "").split() for r in ref], [(h or "").split() for h in hyp], []
    for words, other, steps in zip(said, heard, paths(said, heard, True, WILD), strict=True):
        *counts, pairs = _counted(words, other, steps, WILD)
        rows.append((*counts, sum(w != WILD for w in words), [{"ref": a, "hyp": b} for a, b in pairs]))
    out = pd.DataFrame(rows, columns=["substitutions", "deletions", "insertions", "n_ref", "pairs"])
    return out.astype({c: "int32" for c in out.columns[:4]})


#: How Latin letters are said in Cyrillic, rewritten in this order.
SAID_AS = [
    ("sh", "ш"), ("ch", "ч"), ("th", "т"), ("ph", "ф"), ("oo", "у"), ("ee", "и"), ("ea", "и"), ("ou", "ау"),
    ("ai", "ей"), ("ay", "ей"), ("igh", "ай"), ("x", "кс"), ("j", "дж"), ("c", "к"), ("q", "к"), ("w", "в"),
    ("y", "и"), ("a", "а"), ("b", "б"), ("d", "д"), ("e", "е"), ("f", "ф"), ("g", "г"), ("h", "х"), ("i", "и"),
    ("k", "к"), ("l", "л"), ("m", "м"), ("n", "н"), ("o", "о"), ("p", "п"), ("r", "р"), ("s", "с"), ("t", "т"),
    ("u", "у"), ("v", "в"), ("z", "з"),
]


def said_in_cyrillic(word: Column) -> Column:
    """A lower-case Latin word as it would be written by ear in Cyrillic."""
    return reduce(lambda w, pair: F.replace(w, F.lit(pair[0]), F.lit(pair[1])), SAID_AS, word)


def common_length(a: str, b: str) -> int:
    """The length of the longest common subsequence, by the bits of one integer a letter."""
    places: dict[str, int] = {}
    for k, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    free = full
    for c in b:
        hit = free & places.get(c, 0)
        free = (free + hit | free - hit) & full
    return (free ^ full).bit_count()


@arrow("double")
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the common subsequence over both lengths, in percent; 100 for two empty words."""
    return pd.Series([100.0 * 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 100.0 for x, y in zip(a.fillna(""), b.fillna(""), strict=True)], dtype="float64")


def in_other_letters(ref: Column, hyp: Column) -> Column:
    """Whether a Latin reference word was replaced by one that is not Latin."""
    return F.coalesce(ref.rlike("^[a-z]+$") & (hyp != "") & ~hyp.rlike("^[a-z0-9]+$"), F.lit(False))


def other_script(ref: Column, hyp: Column, least: float = 60) -> Column:
    """Whether a Latin reference word was replaced by something like its Cyrillic spelling: the right word, another script."""
    asked = in_other_letters(ref, hyp)
    return asked & (likeness(F.when(asked, said_in_cyrillic(ref)), F.when(asked, hyp)) >= least)
