"""Exact removal of repeated byte strings by suffix arrays.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere else goes; matches lie inside documents,
overlaps count, and strings are judged on the input.

1. Anchors. A window of LENGTH bytes picks the leftmost of its ``GRAM``-byte grams of least hash. Equal windows pick the
   same gram at the same place, so a window can only be repeated by windows of the same gram. A run of windows that
   pick the same gram is a segment (its windows' bytes together); an anchor comes about every LENGTH / 2 bytes.
2. Equal segments of a gram are a class; in a class of two or more every window is repeated. Classes are counted inside
   each part of the documents before they are shuffled, whatever the size of a group of copies.
3. Grams with several classes are contested: one exemplar of each class goes, with its bytes, to a shard. A shard is
   a number of grams, or a part of the classes of a gram that has many.
   There, only windows whose bytes on either side of the gram agree with some other segment's go on; the others cannot
   be repeated.
4. In each shard a suffix array is built by Larsson-Sadakane refinement in numpy (ranks double their depth; only
   groups not yet resolved are sorted again), to LENGTH bytes, and Kasai's common prefixes
   mark the windows that share LENGTH bytes with a neighbour in the array.
5. Shards of one gram are merged: each deals the sorted fingerprints of its windows out by ranges, and every range
   looks its runs up in each other by binary search.
6. Marked windows become byte ranges of documents; their union is cut out.

Two lengths at once: a repeated string holds only repeated strings of any smaller length, so it lies whole inside one
maximal run of the smaller one's ranges. The larger length is searched in the bytes of those runs alone.

No step holds more than a shard, a batch of documents or one document's ranges; text moves twice (exemplars, cutting).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, drop_cut, give_back, mix64, ship, slices

LENGTH, GRAM, SHARD = 400, 32, 512
#: Shorter than 51 words of ordinary prose (see the README), so that a repeated passage of over 50 words is found.
PASSAGE = 240
_PIECE, _BLOCK = 1 << 20, 1 << 16
_ODD = 0x9E3779B97F4A7C15
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2^64."""
    if len(_POWERS[0]) < n:
        size = max(n, 1 << 14)
        for k, base in enumerate((_ODD, pow(_ODD, -1, 1 << 64))):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            _POWERS[k] = np.multiply.accumulate(row)
    return _POWERS[0][:n], _POWERS[1][:n]


def gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """Hashes of all substrings of ``gram`` bytes, from sums of bytes times inverse powers."""
    up, down = _powers(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[: len(raw)], out=total[1:])
    return mix64((total[gram:] - total[: len(raw) - gram + 1]) * up[: len(raw) - gram + 1])


def _sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, through running minima of blocks from both sides."""
    n = len(key)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = key
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def anchors_of(raws: list[bytes], length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Row, gram hash, class hash, first window and last window of every segment of the texts, as columns.

    Texts go through numpy in blocks of about ``_BLOCK`` bytes, longer ones in pieces of ``_PIECE`` windows.
    """
    pieces = [(k, at, raw[at : at + _PIECE + length - 1] if at or len(raw) > _PIECE else raw) for k, raw in enumerate(raws) for at in range(0, len(raw) - length + 1, _PIECE)]
    out: list[tuple[np.ndarray, ...]] = [tuple(np.zeros(0, np.int64) for _ in range(5))]
    begin = 0
    while begin < len(pieces):
        end, total = begin, 0
        while end < len(pieces) and (end == begin or total + len(pieces[end][2]) <= _BLOCK):
            total += len(pieces[end][2])
            end += 1
        row, at = (np.array([p[k] for p in pieces[begin:end]], dtype=np.int64) for k in (0, 1))
        flat = b"".join(p[2] for p in pieces[begin:end])
        stop = np.cumsum([len(p[2]) for p in pieces[begin:end]])
        h = gram_hashes(np.frombuffer(flat, np.uint8), gram)
        low = np.uint64((1 << 21) - 1)
        best = _sliding_min((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
        inside = np.ones(len(best), dtype=bool)
        for x in stop[:-1].tolist():  # windows that reach over the end of a piece
            inside[x - length + 1 : x] = False
        window = np.nonzero(inside)[0]
        place = (best[window] & low).astype(np.int64)
        first = np.concatenate([[0], np.nonzero(place[1:] != place[:-1])[0] + 1])
        lo, hi, place = window[first], window[np.append(first[1:], len(place)) - 1], place[first]
        cls = np.array([xxhash.xxh3_64_intdigest(flat[a : b + length], seed=x) for a, b, x in zip(lo.tolist(), hi.tolist(), (place - lo).tolist(), strict=True)], dtype=np.uint64)
        of = np.searchsorted(stop, lo, side="right")
        shift = at[of] - (np.concatenate([[0], stop[:-1]]))[of]
        out.append((row[of], h[place].view(np.int64), (cls ^ np.uint64(1 << 63)).view(np.int64), lo + shift, hi + shift))
        begin = end
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def anchors(raw: bytes, length: int = LENGTH, gram: int = GRAM) -> list[tuple[int, int, int, int]]:
    """(gram hash, class hash, first window, last window) of every segment of a text."""
    return list(zip(*(c.tolist() for c in anchors_of([raw], length, gram)[1:]), strict=True))


def _words(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from each place as one big-endian number, zeros behind the end."""
    padded = raw.tobytes() + bytes(8)
    return np.ndarray(len(raw), dtype=">u8", buffer=padded, strides=(1,)).astype(np.uint64)


def _order(key: np.ndarray) -> np.ndarray:
    """Stable order of keys (not negative) by one sort of keys and places in common numbers, where 63 bits hold both."""
    n = len(key)
    bits = n.bit_length()
    if n and int(key.max()).bit_length() + bits > 63:
        return np.argsort(key, kind="stable")
    both = np.sort((key << np.int64(bits)) | np.arange(n, dtype=np.int64))
    return both & np.int64((1 << bits) - 1)


def suffix_array(raw: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their next ``depth`` bytes (at least), by Larsson-Sadakane refinement.

    Ranks by h bytes give ranks by 2h; places alone in their group are done.
    """
    n = len(raw)
    key = _words(raw)
    sa = np.argsort(key)
    key = key[sa]
    new = np.concatenate([[True], key[1:] != key[:-1]])
    bits = np.int64(n.bit_length())
    # Equal keys by place; behind the last seven places the zeros are no bytes, so these are told from places before zeros.
    both = np.sort((np.cumsum(new) << bits + 4) | (np.minimum(n - sa, 8) << bits) | sa)
    sa, group = both & ((np.int64(1) << bits) - np.int64(1)), both >> bits
    new = np.concatenate([[True], group[1:] != group[:-1]])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa], rank[n] = np.maximum.accumulate(np.where(new, np.arange(n), 0)), -1
    slots, h = np.arange(n), 8
    while h < depth:
        alone = new & np.concatenate([new[1:], [True]])
        slots, own = slots[~alone], rank[sa[slots[~alone]]]
        if not len(slots):
            break
        member = sa[slots]
        pair = own * np.int64(n + 1) + rank[np.minimum(member + h, n)] + 1
        order = _order(pair)
        member, pair = member[order], pair[order]
        sa[slots] = member
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        rank[member] = slots[np.maximum.accumulate(np.where(new, np.arange(len(slots)), 0))]
        h *= 2
    return sa


_BYTES = np.array([1 << 8 * k for k in range(1, 8)], dtype=np.uint64)


def _extend(word: np.ndarray, a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Common prefixes of the strings at two lists of places, up to ``most``, eight bytes at a time."""
    n = len(word) - 1
    room = np.minimum(most, n - np.maximum(a, b))
    common = np.zeros(len(a), dtype=np.int64)
    go = np.nonzero(room > 0)[0]
    while len(go):
        diff = word[a[go] + common[go]] ^ word[b[go] + common[go]]
        odd = diff != 0
        rest, at = diff[odd], go[odd]
        common[at] += 7 - np.searchsorted(_BYTES, rest, side="right")
        go = go[~odd]
        common[go] += 8
        go = go[common[go] < room[go]]
    return np.minimum(common, room)


def common_prefixes(raw: np.ndarray, start: np.ndarray, size: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place, the common prefix with the place before it in the suffix array; from ``most`` on, any such number.

    Kasai: where the neighbour of a place is one behind the neighbour of the place to its left, the prefix is one
    shorter. So prefixes are measured only where that chain breaks (at least at each string's start), and again behind
    the byte that ends a measured prefix; all others follow by subtraction.
    """
    n = len(raw)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    word = np.concatenate([_words(raw), np.zeros(1, np.uint64)])
    head = np.empty(n, dtype=bool)
    head[:1], head[1:] = True, before[1:] != before[:-1] + 1
    head[start[size > 0]] = True
    head |= before < 0
    value, place = np.zeros(n, dtype=np.int64), np.arange(n)
    fresh = np.nonzero(head & (before >= 0))[0]
    while True:
        value[fresh] = _extend(word, fresh, before[fresh], most + int(size.max()))
        last = np.maximum.accumulate(np.where(head, place, 0))
        out = value[last] - (place - last)
        fresh = np.nonzero((out == -1) & (before >= 0))[0]
        if not len(fresh):
            return np.maximum(out, 0)
        head[fresh] = True


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, which of its windows of ``length`` bytes occur more than once among all segments."""
    size = np.array([len(s) for s in segments], dtype=np.int64)
    raw = np.frombuffer(b"".join(segments), dtype=np.uint8)
    start = np.cumsum(size) - size
    sa = suffix_array(raw, length)
    prefix = common_prefixes(raw, start, size, sa, length)
    inside = np.repeat(start + size, size) - np.arange(len(raw)) >= length
    group = np.cumsum(prefix[sa] < length)  # places in a row of the array that share ``length`` bytes
    many = np.bincount(group, weights=inside[sa]) > 1
    hit = np.empty(len(raw), dtype=bool)
    hit[sa] = many[group]
    return [hit[a : a + n - length + 1] for a, n in zip(start, size, strict=True)]


def _neighbours(rows: np.ndarray) -> np.ndarray:
    """For each row of bytes, how many it shares from its start with the row that shares most."""
    n, width = rows.shape
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{width}").ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    out = np.zeros(n, dtype=np.int64)
    out[order[1:]] = common
    out[order[:-1]] = np.maximum(out[order[:-1]], common)
    return out


def possible_windows(segments: list[bytes], grams: list[int], length: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last window of each segment that another segment of its gram may hold (last < first: none).

    Equal windows have their gram at the same place. So a window needs a segment with the same bytes from the gram to
    its end, and one with the same bytes from its start to the gram; sorting what stands behind the grams, and before
    them backwards, tells how far any other segment agrees on either side. All segments of a gram have to be there.
    """
    size = np.array([len(s) for s in segments], dtype=np.int64)
    raw = np.frombuffer(b"".join(segments), dtype=np.uint8)
    start, windows, key = np.cumsum(size) - size, size - length + 1, np.array(grams, dtype=np.int64)
    # A segment's gram is the first of its hash that lies in the last window.
    h = gram_hashes(raw, gram).view(np.int64)
    offset = np.arange(len(h)) - np.repeat(start, size)[: len(h)]
    found = np.nonzero((h == np.repeat(key, size)[: len(h)]) & (offset >= np.repeat(windows - 1, size)[: len(h)]))[0]
    of, at = np.unique(np.searchsorted(start, found, side="right") - 1, return_index=True)
    assert len(of) == len(segments), "a segment without its gram"
    x = found[at]
    behind, before, reach = start + size - x, x - start, length - gram
    padded = np.concatenate([raw, np.zeros(length, np.uint8)])
    right = np.lib.stride_tricks.sliding_window_view(padded, length)[x]
    right[np.arange(length) >= behind[:, None]] = 0
    padded = np.concatenate([raw[::-1], np.zeros(reach + 1, np.uint8)])
    left = np.lib.stride_tricks.sliding_window_view(padded, reach)[len(raw) - x] if reach else np.zeros((len(x), 0), np.uint8)
    left[np.arange(reach) >= before[:, None]] = 0
    left = np.concatenate([key.astype(">i8").view(np.uint8).reshape(-1, 8), left], axis=1)
    agree, ahead = np.minimum(_neighbours(right), behind), np.minimum(np.maximum(_neighbours(left) - 8, 0), before)
    return before - ahead, np.minimum(before + agree - length, windows - 1)


def repeated_possible(segments: list[bytes], grams: list[int], length: int = LENGTH, gram: int = GRAM) -> list[np.ndarray]:
    """``repeated_windows`` of segments with the hashes of their grams; only possible windows go into the suffix array."""
    first, last = possible_windows(segments, grams, length, gram)
    out, some = [np.zeros(len(s) - length + 1, dtype=bool) for s in segments], np.nonzero(first <= last)[0].tolist()
    if some:
        for k, hit in zip(some, repeated_windows([segments[k][first[k] : last[k] + length] for k in some], length), strict=True):
            out[k][first[k] : last[k] + 1] = hit
    return out


def _runs(marks: np.ndarray) -> list[tuple[int, int]]:
    """First and last place of every run of marks."""
    step = np.diff(np.concatenate([[0], marks.astype(np.int8), [0]]))
    return list(zip(np.nonzero(step == 1)[0].tolist(), (np.nonzero(step == -1)[0] - 1).tolist(), strict=True))


def _raw(text: str | bytes | None) -> bytes:
    return text if isinstance(text, bytes) else (text or "").encode("utf-8", "surrogatepass")


_ROWS = "gram long, cls long, spots array<struct<doc_id:long,mark:long,lo:int,hi:int>>"


def _anchor_rows(length: int, gram: int):
    """Classes of a part of the documents with the places of their segments: copies inside a part are one row."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                row, key, cls, lo, hi = anchors_of([_raw(t) for t in part.column("text").to_pylist()], length, gram)
                base = part.column("base").to_numpy(zero_copy_only=False)[row]
                lo, hi = ((x + base).astype(np.int32) for x in (lo, hi))
                order = np.lexsort((cls, key))
                key, cls = key[order], cls[order]
                first = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])]))[0] if len(key) else np.zeros(0, np.int64)
                of = pa.array(row[order])
                spots = pa.StructArray.from_arrays([part.column("doc_id").take(of), part.column("mark").take(of), pa.array(lo[order]), pa.array(hi[order])], ["doc_id", "mark", "lo", "hi"])
                listed = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), spots)
                yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(cls[first]), listed], ["gram", "cls", "spots"])
                give_back()

    return run


_CONTENT = "gram long, parts int, unit_class long, only boolean, known boolean, doc_id long, mark long, lo int, content binary"


def _content(length: int):
    """The bytes of wanted segments with their places; ``only``: no other segment equals it, so its marks are still to be found."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256, 4 << 20):
                rows = []
                for doc, mark, text, base, wanted in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text", "base", "wanted")), strict=True):
                    raw = _raw(text)
                    here = [w for w in wanted if base <= w["lo"] and w["hi"] + length <= base + len(raw)]  # others lie in other parts of the document
                    rows += [(w["gram"], w["parts"], w["cls"], w["n"] == 1, doc is not None, doc or 0, mark, w["lo"], raw[w["lo"] - base : w["hi"] - base + length]) for w in here]
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _CONTENT.split(", ")])

    return run


#: A null id is not known and stands as 0, so that no id passes through a column with gaps, which pandas makes inexact.
_SHARD_OUT = "gram long, range int, known boolean, doc_id long, mark long, lo int, to int, prints binary, places binary"
#: What stands behind each fingerprint: whether its segment is the only one of its class, where it is, and the window's place.
_PLACE = np.dtype([("only", "?"), ("known", "?"), ("doc", "<i8"), ("mark", "<i8"), ("at", "<i4")])


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[x.split()[0] for x in _SHARD_OUT.split(", ")])


def _shard(length: int, gram: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Marked byte ranges of the shard; of a gram in parts also its windows' fingerprints, sorted, by range.

        Each fingerprint goes out once: windows that the shard itself holds several times are marked here already, so
        what other parts hold decides nothing for them.
        """
        grams, parts, only, known, docs, marks, los, content = (pdf[c].tolist() for c in ("gram", "parts", "only", "known", "doc_id", "mark", "lo", "content"))
        out = []
        for g, alone, k, doc, mark, lo, hits in zip(grams, only, known, docs, marks, los, repeated_possible(content, grams, length, gram), strict=True):
            if alone:
                out += [(g, -1, k, doc, mark, lo + a, lo + b + length, None, None) for a, b in _runs(hits)]
        if parts and parts[0] > 1:
            prints = [gram_hashes(np.frombuffer(x, np.uint8), length) for x in content]
            flat, n = np.concatenate(prints), [len(p) for p in prints]
            place = np.zeros(len(flat), dtype=_PLACE)
            for name, values in (("only", only), ("known", known), ("doc", docs), ("mark", marks)):
                place[name] = np.repeat(np.array(values, dtype=_PLACE[name]), n)
            place["at"] = np.concatenate([lo + np.arange(k, dtype=np.int32) for lo, k in zip(los, n, strict=True)])
            by = np.argsort(flat, kind="stable")
            flat, first, times = np.unique(flat[by], return_index=True, return_counts=True)
            place = place[by][first]
            place["only"] &= times == 1
            bounds = np.searchsorted(flat, np.array([((1 << 64) * k) // parts[0] for k in range(1, parts[0])], dtype=np.uint64))
            for k, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(flat)], strict=True)):
                if b > a:
                    out.append((grams[0], k, False, 0, 0, 0, 0, flat[a:b].tobytes(), place[a:b].tobytes()))
        give_back()
        return _frame(out)

    return run


def _merge(length: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Byte ranges of windows whose fingerprints stand in several shards' sorted runs of one range, found by binary search."""
        runs = [(np.frombuffer(p, np.uint64), np.frombuffer(o, _PLACE)) for p, o in zip(pdf["prints"], pdf["places"], strict=True)]
        merged, seen = np.unique(np.concatenate([r[0] for r in runs]), return_counts=True)
        shared = merged[seen > 1]
        if not len(shared):
            return _frame([])
        hits = [place[(shared[np.minimum(np.searchsorted(shared, prints), len(shared) - 1)] == prints) & place["only"]] for prints, place in runs]
        # Neighbouring windows of a document become one row.
        done = np.unique(np.concatenate(hits))
        if not len(done):
            return _frame([])
        same = (done["known"][1:] == done["known"][:-1]) & (done["doc"][1:] == done["doc"][:-1]) & (done["mark"][1:] == done["mark"][:-1])
        first = np.nonzero(np.concatenate([[True], ~same | (done["at"][1:] != done["at"][:-1] + 1)]))[0]
        last = np.append(first[1:], len(done)) - 1
        g = int(pdf["gram"].iloc[0])
        return _frame([(g, -1, bool(x["known"]), int(x["doc"]), int(x["mark"]), int(x["at"]), int(y["at"]) + length, None, None) for x, y in zip(done[first], done[last], strict=True)])

    return run


def _same(a: DataFrame, b: DataFrame):
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["mark"] == b["mark"])


def repeated_ranges(documents: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, spans: array of [from, to) byte ranges) of documents (doc_id, mark, text) with repeated strings.

    ``mark`` tells rows of one doc_id apart. Ranges may overlap and come in no order. Where documents have a column
    ``base``, a row is the part of its document's bytes that starts there, and no two rows of a document overlap.
    """
    documents = documents if "base" in documents.columns else documents.withColumn("base", F.lit(0))
    rows = cut(documents.mapInArrow(_anchor_rows(length, gram), _ROWS))
    classes = rows.groupBy("gram", "cls").agg(F.sum(F.size("spots")).alias("n"), F.min(F.element_at("spots", 1)).alias("at"))
    grams = classes.groupBy("gram").agg(F.sum("n").alias("all"), F.count("*").alias("classes")).where("all > 1")
    grams = cut(grams.select("gram", "classes", F.ceil(F.col("classes") / SHARD).cast("int").alias("parts")))
    classes = cut(classes.join(grams, "gram").select("gram", "cls", "n", "at", "classes", "parts"))
    copies = cut(classes.where("n > 1").select("gram", "cls"))
    whole = rows.join(copies, ["gram", "cls"]).select(F.inline("spots")).select("doc_id", "mark", "lo", (F.col("hi") + length).alias("to"))

    contested = classes.where("classes > 1").select("at.doc_id", "at.mark", F.struct("gram", "cls", "n", "parts", "at.lo", "at.hi").alias("w"))
    wanted = contested.groupBy("doc_id", "mark").agg(F.collect_list("w").alias("wanted"))
    units = max(1, classes.where("classes > 1 and parts = 1").count() // SHARD)
    # What is wanted, and the ranges below, grow with the corpus: joined by shuffles at every size.
    found = documents.join(wanted.hint("merge"), _same(documents, wanted)).select(documents["doc_id"], documents["mark"], "text", "base", "wanted").mapInArrow(_content(length), _CONTENT)
    unit = F.when(F.col("parts") > 1, F.struct(F.col("gram"), F.pmod(F.col("unit_class"), F.col("parts").cast("long")))).otherwise(F.struct(F.pmod(F.xxhash64("gram"), F.lit(units)).alias("gram"), F.lit(-1).cast("long")))
    sharded = cut(found.withColumn("unit", unit).groupBy("unit").applyInPandas(_shard(length, gram), _SHARD_OUT))
    merged = sharded.where("range >= 0").groupBy("gram", "range").applyInPandas(_merge(length), _SHARD_OUT)
    partly = sharded.where("range < 0").unionByName(merged).select(F.when(F.col("known"), F.col("doc_id")).alias("doc_id"), "mark", "lo", "to")
    out = cut(whole.unionByName(partly).groupBy("doc_id", "mark").agg(F.collect_list(F.struct("lo", "to")).alias("spans")))
    for x in (rows, grams, classes, copies, sharded):
        drop_cut(x)
    return out


def _union(spans: list[dict] | None) -> list[tuple[int, int]]:
    """The maximal runs that the ranges cover."""
    out = []
    for lo, to in sorted((s["lo"], s["to"]) for s in spans or []):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], to)
        else:
            out.append((lo, to))
    return out


def _covered(length: int):
    """The bytes of a document's maximal runs, as far as a string of ``length`` bytes fits in."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, 256, 4 << 20):
                rows = []
                for doc, mark, text, spans in zip(*(part.column(c).to_pylist() for c in ("doc_id", "mark", "text", "spans")), strict=True):
                    raw = _raw(text)
                    rows += [(doc, mark, lo, raw[lo:to]) for lo, to in _union(spans) if to - lo >= length]
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], ["doc_id", "mark", "base", "text"])
                give_back()

    return run


def repeated_within(documents: DataFrame, spans: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """``repeated_ranges`` for the length, from those of a smaller one (``spans``)."""
    covered = documents.join(spans.hint("merge"), _same(documents, spans)).select(documents["doc_id"], documents["mark"], "text", "spans")
    parts = cut(covered.mapInArrow(_covered(length), "doc_id long, mark long, base int, text binary"))
    out = repeated_ranges(parts, length, gram)
    drop_cut(parts)
    return out


def _keep(raw: bytes, spans: list[dict] | None) -> tuple[bytes, int]:
    """What remains without the ranges, and the number of maximal removed runs."""
    kept, at, runs = [], 0, _union(spans)
    for lo, to in runs:
        kept.append(raw[at:lo])
        at = to
    kept.append(raw[at:])
    return b"".join(kept), len(runs)


ADDED = ["_n_bytes", "_n_removed", "_n_spans", "_kept"]
#: With a second, smaller length also what it removes, its runs and the text that remains.
PASSAGES = ["_n_passage_bytes", "_n_passages", "_passage_text"]


def _cutter(as_text: bool, passages: bool):
    def run(batches):
        for batch in batches:
            for part in slices(batch, 1024, 4 << 20):
                raws = [_raw(t) for t in part.column("text").to_pylist()]
                size = [len(raw) for raw in raws]
                done = [_keep(raw, s) for raw, s in zip(raws, part.column("spans").to_pylist(), strict=True)]
                cols = [part.column("row"), pa.array(size, pa.int64()), pa.array([n - len(k) for n, (k, _) in zip(size, done, strict=True)], pa.int64()), pa.array([r for _, r in done], pa.int64())]
                cols.append(pa.array([k.decode("utf-8", "ignore") for k, _ in done], pa.string()) if as_text else pa.array([k for k, _ in done], pa.binary()))
                if passages:
                    wide = [_keep(raw, s) for raw, s in zip(raws, part.column("wide").to_pylist(), strict=True)]
                    cols += [pa.array([n - len(k) for n, (k, _) in zip(size, wide, strict=True)], pa.int64()), pa.array([r for _, r in wide], pa.int64())]
                    cols.append(pa.array([k.decode("utf-8", "ignore") for k, _ in wide], pa.string()))
                yield pa.RecordBatch.from_arrays(cols, ["row", *ADDED, *(PASSAGES if passages else [])])
                give_back()

    return run


def remove_repeats(documents: DataFrame, length: int = LENGTH, gram: int = GRAM, as_text: bool = False, passage: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """All columns of documents (or ``columns`` of them) with _n_bytes, _n_removed, _n_spans (maximal removed runs) and _kept (bytes that remain).

    A null text counts as empty. Rows that repeat a doc_id, or have none, are documents of their own. Texts shorter
    than ``length`` lose nothing. With ``as_text`` _kept is a string, without the bytes of characters that a cut splits.
    A column of documents that bears one of the four names is replaced; all others pass through, whatever their names.
    An empty table gives no rows.

    With ``passage``, a length from ``gram`` up to ``length``, also what repeats at that length: _n_passage_bytes,
    _n_passages (maximal runs) and _passage_text, the text that remains without them, again as valid characters.
    """
    if passage is not None and not gram <= passage <= length:
        raise ValueError(f"passage must be from {gram} to {length} bytes, not {passage}")
    ship(documents.sparkSession)
    added = ADDED + (PASSAGES if passage else [])
    kept = [c for c in (documents.columns if columns is None else columns) if c.lower() not in added]
    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")
    texts = rows.select("doc_id", "mark", "text")
    if passage is not None:
        wide = repeated_ranges(texts, passage, gram)
        spans = repeated_within(texts, wide, length, gram)
        spans = wide.join(spans.hint("merge"), _same(wide, spans), "left").select(wide["doc_id"].alias("d"), wide["mark"].alias("m"), spans["spans"], wide["spans"].alias("wide"))
    else:
        spans = repeated_ranges(texts, length, gram).select(F.col("doc_id").alias("d"), F.col("mark").alias("m"), "spans")
    joined = rows.join(spans.hint("merge"), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("m")), "left").select("row", "text", "spans", *(["wide"] if passage else []))
    kinds = [T.LongType()] * 3 + [T.StringType() if as_text else T.BinaryType()] + [T.LongType()] * 2 + [T.StringType()]
    schema = T.StructType([joined.schema["row"], *(T.StructField(n, t) for n, t in zip(added, kinds, strict=False))])
    return joined.mapInArrow(_cutter(as_text, bool(passage)), schema).select("row.*", *added)


def brute_force(texts: list[str | None], length: int = LENGTH) -> list[tuple[int, int, int, bytes]]:
    """(bytes, removed, runs, kept) of each text by counting all windows: for tests."""
    raws, seen = [(t or "").encode("utf-8", "surrogatepass") for t in texts], {}
    for raw in raws:
        for p in range(len(raw) - length + 1):
            seen[raw[p : p + length]] = seen.get(raw[p : p + length], 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, dtype=np.int64)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p] += 1
                gone[p + length] -= 1
        cover = np.cumsum(gone)[: len(raw)] > 0
        out.append((len(raw), int(cover.sum()), len(_runs(cover)), bytes(np.frombuffer(raw, np.uint8)[~cover])))
    return out
