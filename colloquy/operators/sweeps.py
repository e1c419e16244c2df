"""Sweeps over spans in groups of one key and one time bucket, for joins whose pairs would be many more than their rows.

A span goes to every bucket that it touches. Rows of a group come sorted to one task, which handles many groups at once
in numpy: work grows with the rows (and their logarithm), also where all spans of an hour overlap each other. What buckets
find is put together by aggregates. A task holds the rows of a few groups, at least those of one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows that a task takes at once, in whole groups.
ROWS = 1 << 16
#: Cells of a table of pieces and labels that a task holds at once.
CELLS = 1 << 20


def grouped(df: DataFrame, keys: list[str], order: list[str], work: Callable[[pa.Table, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """``work`` over all groups of ``keys``: it gets rows in ``order`` and the number of each row's group, from 0."""

    def groups(table: pa.Table) -> np.ndarray:
        fresh = np.zeros(table.num_rows, bool)
        for k in keys:
            col = table.column(k).combine_chunks()
            new = pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, len(col) - 1)), True)
            fresh[1:] |= new.to_numpy(zero_copy_only=False)
        return np.cumsum(fresh)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, rows, enough = [], 0, ROWS
        for batch in batches:
            kept.append(batch)
            rows += batch.num_rows
            if rows < enough:
                continue
            table = pa.Table.from_batches(kept)
            of = groups(table)
            last = int(np.searchsorted(of, of[-1]))  # where the group begins that may go on
            kept, rows = table.slice(last).combine_chunks().to_batches(), table.num_rows - last
            enough = max(ROWS, 2 * rows)
            if last:
                yield from work(table.slice(0, last), of[:last]).to_batches()
        if kept:
            table = pa.Table.from_batches(kept)
            if table.num_rows:
                yield from work(table, groups(table)).to_batches()

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _ranked(of: np.ndarray, *times: np.ndarray) -> list[np.ndarray]:
    """Times as numbers that are ordered by group and then by time."""
    seen, where = np.unique(np.concatenate(times), return_inverse=True)
    parts = np.split(where.ravel().astype(np.int64), np.cumsum([len(t) for t in times])[:-1])
    return [of * (len(seen) + 1) + p for p in parts]


class _FirstLargest:
    """The place of the largest value in ranges of an array, the first of equals, by tables of powers of two."""

    def __init__(self, values: np.ndarray):
        self.values, self.levels = values, [np.arange(len(values))]
        width = 1
        while 2 * width <= len(values):
            a, b = self.levels[-1][:-width], self.levels[-1][width:]
            self.levels.append(np.where(values[a] >= values[b], a, b))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """For each [low, high), which holds one place at least."""
        out, level = np.zeros(len(low), np.int64), np.frexp(np.maximum(high - low, 1))[1] - 1
        for k in np.unique(level):
            at = level == k
            a, b = self.levels[k][low[at]], self.levels[k][high[at] - (1 << int(k))]
            out[at] = np.where(self.values[a] >= self.values[b], a, b)
        return out


def _best(of, right, start, end, near: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each left row of ``of`` (a group's rights before its lefts, rights by start and then by rank) the row of the best
    right of its group, or -1, and its overlap (or gap, if ``near``).

    A right that ends no later than one before it in the order loses to that one always; the others both start and end
    in order, so the best is among a few: the first that ends behind the left, the last that starts before it, and the
    longest of those inside.
    """
    s, e = _ranked(of, start, end)
    rows = np.nonzero(right)[0]
    top = np.maximum.accumulate(e[rows]) if len(rows) else rows
    rows = rows[np.concatenate([[True], top[1:] > top[:-1]])] if len(rows) else rows
    left = np.nonzero(~right)[0]
    none = np.full(len(left), -1, np.int64)
    if not len(rows) or not len(left):
        return none, none
    rs, re, ls, le = s[rows], e[rows], s[left], e[left]
    low, high = np.searchsorted(of[rows], of[left], "left"), np.searchsorted(of[rows], of[left], "right")
    if near:
        i = np.searchsorted(re, ls, "left")
        options = [i - 1, i]
    else:
        inside, until = np.searchsorted(rs, ls, "left"), np.searchsorted(re, le, "right")
        longest = np.where(until > inside, _FirstLargest(end[rows] - start[rows])(np.minimum(inside, np.maximum(until - 1, 0)), np.maximum(until, 1)), -1)
        behind = np.searchsorted(rs, ls, "right")
        options = [behind - 1, np.searchsorted(re, le, "left"), np.searchsorted(re, le, "right"), longest, behind]
    best, value = none.copy(), none.copy()
    a, b = start[left], end[left]
    for at in options:
        there = (at >= low) & (at < high)
        k = np.where(there, at, 0)
        x, y = start[rows[k]], end[rows[k]]
        if near:
            score = np.maximum(np.maximum(a - y, x - b), 0)
            better = there & ((best < 0) | (score < value) | ((score == value) & (k < best)))
        else:
            score = np.minimum(b, y) - np.maximum(a, x)
            better = there & (a < y) & (x < b) & ((best < 0) | (score > value) | ((score == value) & (k < best)))
        best, value = np.where(better, k, best), np.where(better, score, value)
    return np.where(best < 0, -1, rows[np.maximum(best, 0)]), value


def best_right(left: DataFrame, right: DataFrame, keys: list[str], row: list[str], right_order: list[str], most_ms: int | None) -> DataFrame:
    """For each left row (keys, row) that has one, all its columns, those of its best right row and the measure: the
    largest overlap_ms, or with ``most_ms`` the smallest gap_ms up to it. Ties go to the first in ``right_order``, which
    begins with r_start. Both sides carry ``_bucket``, lefts one for every bucket in which their best may lie."""
    measure = "overlap_ms" if most_ms is None else "gap_ms"
    mine, theirs = [c for c in left.columns if c not in (*keys, "_bucket")], [c for c in right.columns if c not in (*keys, "_bucket")]
    types = dict(left.dtypes) | dict(right.dtypes)
    empty = lambda names: [F.lit(None).cast(types[c]).alias(c) for c in names]
    whole = lambda df, a, b: df.where(f"{a} is not null and {b} is not null")
    lefts = whole(left, "start_ms", "end_ms").select(*keys, "_bucket", F.lit(1).alias("_side"), *mine, *empty(theirs))
    rights = whole(right, "r_start", "r_end").select(*keys, "_bucket", F.lit(0).alias("_side"), *empty(mine), *theirs)
    out = [*keys, *mine, *theirs]

    def work(table: pa.Table, of: np.ndarray) -> pa.Table:
        is_right = _numbers(table, "_side") == 0
        time = lambda a, b: pc.coalesce(table.column(a), table.column(b)).to_numpy().astype(np.int64)
        best, value = _best(of, is_right, time("start_ms", "r_start"), time("end_ms", "r_end"), most_ms is not None)
        ok = best >= 0 if most_ms is None else (best >= 0) & (value <= most_ms)
        own, found = table.take(np.nonzero(~is_right)[0][ok]), table.take(best[ok])
        columns = [(found if c in theirs else own).column(c) for c in out]
        return pa.table([*columns, pa.array(value[ok], pa.int64())], names=[*out, measure])

    both = lefts.unionByName(rights)
    found = grouped(both, [*keys, "_bucket"], ["_side", *right_order], work, _schema(both.select(*out)) + f", {measure} long")
    rank = F.struct((-F.col(measure) if most_ms is None else F.col(measure)).alias("_m"), *right_order)
    rest = [c for c in (*mine, *theirs, measure) if c not in row]
    one = found.groupBy(*keys, *row).agg(F.min_by(F.struct(*rest), rank).alias("_b"))
    return one.select(*keys, *[c if c in row else F.col(f"_b.{c}").alias(c) for c in (*mine, *theirs, measure)])


def top_labels(clipped: DataFrame, keys: list[str], index: str) -> DataFrame:
    """keys, start_ms, end_ms, label: where spans cut to their ``_bucket`` show a label, that of the largest ``index``;
    touching pieces of one label are joined inside a bucket."""
    types = dict(clipped.dtypes)

    def work(table: pa.Table, of: np.ndarray) -> pa.Table:
        start, end = _numbers(table, "start_ms"), _numbers(table, "end_ms")
        s, e = _ranked(of, start, end)
        bound, first = np.unique(np.concatenate([s, e]), return_index=True)
        time, group = np.concatenate([start, end])[first], np.concatenate([of, of])[first]
        low, high = np.searchsorted(bound, s), np.searchsorted(bound, e)
        by = np.asarray(pc.sort_indices(table.column(index), null_placement="at_start"))
        place = np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        level = np.frexp(high - low)[1] - 1
        shown = np.full(len(bound), -1, np.int64)
        for k in range(int(level.max()), -1, -1):
            at = np.nonzero(level == k)[0]
            np.maximum.at(shown, low[at], place[at])
            np.maximum.at(shown, high[at] - (1 << k), place[at])
            if k:  # a block of 2^k pieces is two of half the size
                half = 1 << (k - 1)
                below = shown.copy()
                np.maximum(below[half:], shown[:-half], out=below[half:])
                shown = below
        code = pc.fill_null(table.column("label").combine_chunks().dictionary_encode().indices, -1).to_numpy()
        piece = np.nonzero(shown >= 0)[0]
        of_label = code[by[shown[piece]]]
        fresh = np.ones(len(piece), bool)
        fresh[1:] = (piece[1:] != piece[:-1] + 1) | (of_label[1:] != of_label[:-1]) | (group[piece[1:]] != group[piece[:-1]])
        begin = np.nonzero(fresh)[0]
        stop = np.concatenate([begin[1:], [len(piece)]]) - 1
        rows = table.take(by[shown[piece[begin]]])
        columns = [rows.column(k) for k in keys] + [pa.array(time[piece[begin]], pa.int64()), pa.array(time[piece[stop] + 1], pa.int64()), rows.column("label")]
        return pa.table(columns, names=[*keys, "start_ms", "end_ms", "label"])

    schema = _schema(clipped.select(*keys)) + f", start_ms long, end_ms long, label {types['label']}"
    return grouped(clipped.select(*keys, "_bucket", "start_ms", "end_ms", "label", index), [*keys, "_bucket"], ["start_ms"], work, schema)


def _covers(table: pa.Table, of: np.ndarray) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Pieces of the groups in blocks of bounded size: a row of the group, its labels, and for each piece its length and how
    many spans of each label cover it, on side 0 and on side 1."""
    start, end, side = _numbers(table, "start_ms"), _numbers(table, "end_ms"), _numbers(table, "side")
    edges = np.concatenate([[0], np.nonzero(np.diff(of))[0] + 1, [len(of)]])
    code = table.column("label").combine_chunks().dictionary_encode()
    codes = pc.fill_null(code.indices, len(code.dictionary)).to_numpy()
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        seen, label = np.unique(codes[a:b], return_inverse=True)
        bound = np.unique(np.concatenate([start[a:b], end[a:b]]))
        low, high = np.searchsorted(bound, start[a:b]), np.searchsorted(bound, end[a:b])
        column = side[a:b] * len(seen) + label
        now = np.zeros(2 * len(seen), np.int64)
        step = max(1, CELLS // (2 * len(seen)))
        changes = [(at[by], column[by], sign) for at, sign in ((low, 1), (high, -1)) for by in (np.argsort(at, kind="stable"),)]
        for k in range(0, len(bound) - 1, step):
            stop = min(k + step, len(bound) - 1)
            n = np.zeros((stop - k, 2 * len(seen)), np.int64)
            for at, of_column, sign in changes:
                i, j = np.searchsorted(at, [k, stop])
                np.add.at(n, (at[i:j] - k, of_column[i:j]), sign)
            n[0] += now
            np.cumsum(n, axis=0, out=n)
            now = n[-1]
            yield int(a), seen, np.diff(bound[k : stop + 1]), n[:, : len(seen)], n[:, len(seen) :]


def error_sums(clipped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, total, miss, false_alarm, confusion (ms) of each bucket: spans (label, side 0 or 1) cut to their ``_bucket``."""
    names = ["total", "miss", "false_alarm", "confusion"]

    def work(table: pa.Table, of: np.ndarray) -> pa.Table:
        rows, sums = [], []
        for row, _, d, ref, hyp in _covers(table, of):
            r, h = ref > 0, hyp > 0
            nr, nh, nc = r.sum(axis=1), h.sum(axis=1), (r & h).sum(axis=1)
            rows.append(row)
            sums.append([int((d * x).sum()) for x in (nr, np.maximum(0, nr - nh), np.maximum(0, nh - nr), np.minimum(nr, nh) - nc)])
        some = table.take(np.array(rows, np.int64))
        return pa.table([*[some.column(k) for k in keys], *[pa.array(x, pa.int64()) for x in zip(*sums, strict=True)]], names=[*keys, *names])

    schema = _schema(clipped.select(*keys)) + "".join(f", {n} long" for n in names)
    return grouped(clipped.select(*keys, "_bucket", "start_ms", "end_ms", "label", "side"), [*keys, "_bucket"], ["start_ms"], work, schema)


def shared_time(clipped: DataFrame, keys: list[str]) -> DataFrame:
    """keys, label, h_label, w: the summed overlaps of all pairs of a span of side 0 with one of side 1 (h_label), where
    they are more than nothing; of spans cut to their ``_bucket``, a row a bucket at least."""
    types = dict(clipped.dtypes)

    def work(table: pa.Table, of: np.ndarray) -> pa.Table:
        names = table.column("label").combine_chunks().dictionary_encode().dictionary
        rows, a, b, w = [], [], [], []
        for row, seen, d, ref, hyp in _covers(table, of):
            both = (ref * d[:, None]).T @ hyp
            i, j = np.nonzero(both)
            rows += [row] * len(i)
            a += seen[i].tolist()
            b += seen[j].tolist()
            w += both[i, j].tolist()
        some = table.take(np.array(rows, np.int64))
        named = lambda k: pc.take(names, pa.array([None if x == len(names) else x for x in k], pa.int64()))
        return pa.table([*[some.column(k) for k in keys], named(a), named(b), pa.array(w, pa.int64())], names=[*keys, "label", "h_label", "w"])

    schema = _schema(clipped.select(*keys)) + f", label {types['label']}, h_label {types['label']}, w long"
    return grouped(clipped.select(*keys, "_bucket", "start_ms", "end_ms", "label", "side"), [*keys, "_bucket"], ["start_ms"], work, schema)
