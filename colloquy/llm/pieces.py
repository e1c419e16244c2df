"""Cutting texts where no token of a byte-level vocabulary can cross, so that parts are encoded once and remembered.

The splitting patterns never join a character other than white space with white space after it, and never a letter
with a closing punctuation mark after it. So a text may be cut before a run of white space and before such a mark.
Everything works on whole Arrow columns in numpy: no Python object stands for a part unless it is new.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_SPACE = np.zeros(256, dtype=bool)
_SPACE[list(b" \t\n\x0b\x0c\r")] = True
_MARK = np.zeros(256, dtype=bool)
_MARK[list(b".,;:!?")] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
#: Bytes that may begin white space on which libraries differ or which is not ASCII: texts that hold some stay whole.
_RARE = np.zeros(256, dtype=bool)
_RARE[[0x1C, 0x1D, 0x1E, 0x1F]] = True
_RARE_PAIRS = [(0xC2, [0x85, 0xA0])]
_RARE_TRIPLES = [(0xE1, 0x9A, [0x80]), (0xE2, 0x80, [*range(0x80, 0x8B), 0xA8, 0xA9, 0xAF]), (0xE2, 0x81, [0x9F]), (0xE3, 0x80, [0x80])]
#: Parts of more bytes are encoded, but not remembered.
LONGEST = 64


def rare_places(data: np.ndarray) -> np.ndarray:
    """Places of white space other than the ASCII kinds."""
    found = [np.nonzero(_RARE[data])[0]]
    for first, second in _RARE_PAIRS:
        at = np.nonzero(data[:-1] == first)[0]
        found.append(at[np.isin(data[at + 1], second)])
    for first, second, third in _RARE_TRIPLES:
        at = np.nonzero(data[:-2] == first)[0]
        found.append(at[(data[at + 1] == second) & np.isin(data[at + 2], third)])
    return np.concatenate(found)


def column_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the bounds of its rows in them."""
    col = pc.fill_null(col, b"" if pa.types.is_binary(col.type) or pa.types.is_large_binary(col.type) else "")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bounds = np.frombuffer(col.buffers()[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(col.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, bounds - bounds[0]


def begins_with_space(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which parts begin with ASCII white space, go on with something else and hold no other white space."""
    out, full = np.zeros(len(bounds) - 1, bool), bounds[1:] > bounds[:-1]
    out[full] = _SPACE[data[bounds[:-1][full]]] & ~_SPACE[data[bounds[1:][full] - 1]]
    out[np.searchsorted(bounds, rare_places(data), side="right") - 1] = False
    return out


def cut_places(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the parts of the texts begin; no part reaches over the end of its text."""
    n = len(data)
    cut = np.zeros(n + 1, dtype=bool)
    space = _SPACE[data]
    cut[1:n] = space[1:] & ~space[:-1]
    cut[1:n] |= _MARK[data[1:]] & _LETTER[data[:-1]]
    for row in np.unique(np.searchsorted(bounds, rare_places(data), side="right") - 1).tolist():
        cut[bounds[row] : bounds[row + 1]] = False
    cut[bounds] = True
    return np.nonzero(cut[:n])[0]


def ragged(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices flat[start : start + size], one behind the other."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    small = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64
    shift = np.repeat((start - (ends - size)).astype(small), size)
    shift += np.arange(total, dtype=small)
    return flat[shift]


def binary_column(ids: np.ndarray, n: np.ndarray) -> pa.Array:
    """Ids as little-endian unsigned 32-bit integers, so many to a row."""
    ends = np.concatenate([[0], np.cumsum(n)]) * 4
    wide = ends[-1] >= 1 << 31
    found = pa.Array.from_buffers(pa.large_binary() if wide else pa.binary(), len(n), [None, pa.py_buffer(ends.astype(np.int64 if wide else np.int32)), pa.py_buffer(np.ascontiguousarray(ids, dtype="<u4"))])
    return found.cast(pa.binary()) if wide else found


class Memory:
    """Encodings of parts, at most ``most`` of them kept from one call to the next; the longest unused go first."""

    def __init__(self, most: int):
        self.most, self.keys = most, pa.array([], pa.binary())
        self.flat, self.size, self.used, self.turn = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def encode(self, col: pa.Array, encode_new: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts of a column, one text behind the other, and the number of ids of each text.

        ``encode_new`` gives the same of parts that are not remembered.
        """
        data, bounds = column_bytes(col)
        begins = cut_places(data, bounds)
        if not len(begins):
            return np.zeros(0, np.uint32), np.zeros(len(col), np.int64)
        ends = np.append(begins, len(data)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])
        coded = parts.dictionary_encode()
        kinds, kind = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        known = pc.index_in(kinds, value_set=self.keys)
        at, fresh = pc.fill_null(known, -1).to_numpy(zero_copy_only=False).astype(np.int64), known.is_null()
        new, is_new = kinds.filter(fresh), at < 0
        flat, size = encode_new(new) if len(new) else (np.zeros(0, np.uint32), np.zeros(0, np.int64))
        self.turn += 1
        self.used[at[~is_new]] = self.turn
        at[is_new] = len(self.size) + np.arange(len(new))
        flat, size = np.concatenate([self.flat, flat]), np.concatenate([self.size, size])
        start = np.cumsum(size) - size
        own = at[kind]
        own_size = size[own]
        ids, n = ragged(flat, start[own], own_size), np.zeros(len(begins) + 1, np.int64)
        np.cumsum(own_size, out=n[1:])
        self._keep(new, flat, size, start)
        return ids, np.diff(n[np.searchsorted(begins, bounds)])

    def _keep(self, new: pa.Array, flat: np.ndarray, size: np.ndarray, start: np.ndarray) -> None:
        used = np.concatenate([self.used, np.full(len(new), self.turn)])
        keep = np.ones(len(size), bool)
        keep[len(self.size) :] = pc.less_equal(pc.binary_length(new), LONGEST).to_numpy(zero_copy_only=False)
        if keep.sum() > self.most:  # down to half, so that this is rare
            keep &= used > np.sort(used[keep])[::-1][self.most // 2]
        self.keys = pa.concat_arrays([self.keys, new])
        if keep.all():
            self.flat, self.size, self.used = flat, size, used
        else:
            self.keys = self.keys.filter(pa.array(keep))
            self.flat, self.size, self.used = ragged(flat, start[keep], size[keep]), size[keep], used[keep]
