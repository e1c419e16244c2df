"""Near-duplicate documents by SuperMinHash signatures, banding, exact verification and union-find.

A document's words are its maximal runs of bytes other than space and 0x09-0x0D after A-Z are lower-cased; its set
holds its distinct shingles of five words (fewer words: the whole sequence as one shingle; none: the empty set).
Shingles are compared by 64-bit fingerprints. Documents are linked if 100 * |A and B| >= percent * |A or B|.

SuperMinHash (Ertl 2017): every element draws one random permutation of the signature's slots and puts rank + fraction
into the slots in that order; a slot keeps its minimum. Ranks are correlated within an element, which lowers the
variance, and a set stops as soon as every slot holds a rank that later draws cannot beat.

How links stay whole without comparing all pairs of a group:

1. Documents with equal sets are one class, represented by its smallest id; only representatives are compared.
2. Bands (5 slots of 120, 24 bands: a pair at similarity 0.85 shares none with probability 8e-7) give candidates.
3. A candidate of whose shingles more than 100 - percent in a hundred occur in no other candidate cannot link with
   anything; it drops out exactly, by counts. That removes heavily edited copies.
4. In each bucket everything is verified against the bucket's smallest id (a star, linear in the bucket).
5. Where a family of buckets still falls into several components, the documents outside its largest component are
   verified against the whole family in blocks of bounded size, so a link that the stars missed is still found.

Step 5 is the only step whose work can exceed the input: it grows with (documents outside the largest component) x
(family size), and no task holds more than two blocks.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, give_back, mix64, ship, shuffled, slices
from .components import connected_components

WORDS, SLOTS, ROWS = 5, 120, 5
BANDS = SLOTS // ROWS
PERCENT = 85
BLOCK = 32
_STEP = 0x9E3779B97F4A7C15
_FRACTION = np.uint64(48)
_KNOWN: dict[bytes, int] = {}
_KNOWN_MOST = 100_000


def _word_hashes(words: list[bytes]) -> np.ndarray:
    known, digest = _KNOWN, xxhash.xxh3_64_intdigest
    if len(known) > _KNOWN_MOST:
        known.clear()
    out = []
    for w in words:
        h = known.get(w)
        if h is None:
            h = digest(w)
            if len(w) < 64:
                known[w] = h
        out.append(h)
    return np.array(out, dtype=np.uint64)


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit fingerprints of a text's shingles; empty for null and for texts without words."""
    found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not found:
        return np.zeros(0, dtype=np.uint64)
    h = _word_hashes(found)
    if len(h) < words:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], dtype=np.uint64)
    s = h[: len(h) - words + 1]
    for k in range(1, words):
        s = mix64(s) + h[k : len(h) - words + 1 + k]
    return np.unique(mix64(s))


def signatures(elements: np.ndarray, owner: np.ndarray, sets: int, slots: int = SLOTS) -> np.ndarray:
    """SuperMinHash signatures (sets x slots, unsigned: rank in the top bits, fraction below) of flat, owned elements."""
    best = np.full((sets, slots), np.iinfo(np.uint64).max, dtype=np.uint64)
    live, of, order = elements, owner, None
    for j in range(slots):
        if not len(live):
            break
        draw = mix64(live + np.uint64(_STEP * (j + 1) % 2**64))
        pick = j + (draw >> np.uint64(32)) % np.uint64(slots - j) if j else (draw >> np.uint64(32)) % np.uint64(slots)
        pick = pick.astype(np.int64)
        if j == 0:
            slot = pick
        else:
            at = np.arange(len(live))
            slot = order[at, pick].astype(np.int64)
            order[at, pick] = order[at, j]
        value = (np.uint64(j) << _FRACTION) | (mix64(draw) >> np.uint64(64 - 48))
        np.minimum.at(best, (of, slot), value)
        open_sets = (best >> _FRACTION).max(axis=1) > j
        keep = open_sets[of]
        if j == 0:
            first = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.int32), (int(keep.sum()), 1))
            first[np.arange(len(first)), slot[keep]] = 0
            order = first
        else:
            order = order[keep]
        live, of = live[keep], of[keep]
    return best


def _band_keys(best: np.ndarray) -> np.ndarray:
    """One signed 64-bit key for each set and band."""
    keys = np.zeros((len(best), BANDS), dtype=np.uint64)
    for r in range(ROWS):
        keys = mix64(keys + best[:, r::ROWS][:, :BANDS] + np.uint64(r + 1))
    return mix64(keys + np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(_STEP)).view(np.int64)


def _sign(batches):
    for batch in batches:
        for part in slices(batch, 512, 2 << 20):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            size = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
            keys = _band_keys(signatures(flat, np.repeat(np.arange(len(sets)), size), len(sets)))
            prints = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").cast(pa.int64()), pa.array(size), pa.array(prints, pa.binary()), pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), pa.array(keys.ravel()))],
                ["doc_id", "n_shingles", "fingerprint", "bands"],
            )
        give_back()


def _sets(batches):
    for batch in batches:
        for part in slices(batch, 512, 4 << 20):
            sets = [shingle_set(t) for t in part.column("text").to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            flat = (np.concatenate(sets) if sets else np.zeros(0, np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.ListArray.from_arrays(offsets, pa.array(flat))], ["doc_id", "shingles"])
        give_back()


def _links_between(percent: int):
    def find(pdf: pd.DataFrame) -> pd.DataFrame:
        """Exact links of one block of strays with one block of their family, through the counts of shared shingles."""
        left, right = pdf[pdf["stray"]], pdf[~pdf["stray"]]
        out = []
        if len(left) and len(right):
            ls, rs = list(left["shingles"]), list(right["shingles"])
            ln, rn = np.array([len(x) for x in ls]), np.array([len(x) for x in rs])
            seen, where = np.unique(np.concatenate(ls), return_inverse=True)
            flat, owner = np.concatenate(rs), np.repeat(np.arange(len(rs)), rn)
            at = np.minimum(np.searchsorted(seen, flat), len(seen) - 1)
            hit = seen[at] == flat
            at, owner = at[hit], owner[hit]
            row_of = np.repeat(np.arange(len(ls)), ln)
            by = np.argsort(where, kind="stable")
            start = np.searchsorted(where[by], np.arange(len(seen) + 1))
            n = start[at + 1] - start[at]
            rows = row_of[by][np.repeat(start[at], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
            both = np.bincount(rows * len(rs) + np.repeat(owner, n), minlength=len(ls) * len(rs)).reshape(len(ls), len(rs))
            ok = (100 * both >= percent * (ln[:, None] + rn[None, :] - both)) & (left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :])
            i, k = np.nonzero(ok)
            out = list(zip(left["id"].to_numpy()[i].tolist(), right["id"].to_numpy()[k].tolist(), strict=True))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return find


def _stars(members: DataFrame) -> DataFrame:
    """(a, b): every member of a bucket with the bucket's smallest id."""
    keyed = members.select("id", F.explode("bands").alias("band"))
    hubs = keyed.groupBy("band").agg(F.min("id").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    hubs = cut(hubs)
    return keyed.join(shuffled(hubs), "band").select(F.col("id").alias("a"), F.col("hub").alias("b"))


def near_duplicates(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links), kept (doc_id = component_id), for every row.

    Null, empty and wordless texts have no shingles and link with nothing. Rows that repeat an id with its text share
    its result. A row with a null id takes no part: its component is null and it is kept. Columns other than doc_id
    and text are ignored. An empty table gives no rows. ``percent`` must be at least 80 for the bands to be safe.
    """
    if percent < 80:
        raise ValueError("the bands are made for similarities of 0.8 or more")
    ship(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    signed = cut(texts.mapInArrow(_sign, "doc_id long, n_shingles long, fingerprint binary, bands array<long>"))
    some = signed.where("n_shingles > 0 and doc_id is not null")
    classes = cut(some.groupBy("fingerprint").agg(F.min("doc_id").alias("id"), F.max("doc_id").alias("last")).where("id <> last").select("fingerprint", "id"))
    class_of = some.select("doc_id", "fingerprint").join(shuffled(classes), "fingerprint", "left").select("doc_id", F.coalesce("id", "doc_id").alias("id"))
    class_of = cut(class_of)
    reps = some.join(shuffled(class_of.where("doc_id = id").select("doc_id").distinct()), "doc_id", "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "bands")
    reps = cut(reps)

    edges = _stars(reps)
    candidates = cut(edges.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    chosen = texts.join(shuffled(candidates.select(F.col("id").alias("doc_id"))), "doc_id", "left_semi")
    sets = cut(chosen.mapInArrow(_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"]).withColumnRenamed("doc_id", "id"))
    own = sets.select("id", F.explode("shingles").alias("s")).groupBy("s").agg(F.count("*").alias("n"), F.min("id").alias("id")).where("n = 1").groupBy("id").agg(F.count("*").alias("own"))
    sets = cut(sets.join(shuffled(own), "id", "left").where(F.expr(f"100 * (size(shingles) - coalesce(own, 0)) >= {percent} * size(shingles)")).select("id", "shingles"))

    star = cut(_stars(reps.join(shuffled(sets.select("id")), "id", "left_semi")).where("a <> b").distinct())
    shared = F.size(F.array_intersect("sa", "sb"))
    paired = star.join(shuffled(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa"))), "a").join(shuffled(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb"))), "b")
    found = cut(paired.where(100 * shared >= percent * (F.size("sa") + F.size("sb") - shared)).select("a", "b"))
    first = connected_components(found)

    family = connected_components(star).select("id", F.col("component").alias("family"))
    member = cut(family.join(shuffled(first), "id", "left").select("id", "family", F.coalesce("component", "id").alias("component")))
    sizes = member.groupBy("family", "component").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("family").agg(F.sum("n").alias("all"), F.max(F.struct("n", F.col("component").alias("main"))).alias("top")).where("top.n < all")
    split = cut(largest.select("family", F.col("top.main").alias("main"), F.ceil(F.col("all") / BLOCK).alias("blocks"), F.ceil((F.col("all") - F.col("top.n")) / BLOCK).alias("stray_blocks")))
    loose = cut(member.join(shuffled(split), "family"))
    one = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    left = loose.where("component <> main").select("family", "id", "component", one("stray_blocks", 1).alias("i"), F.lit(True).alias("stray"), every("blocks").alias("k"))
    right = loose.select("family", "id", "component", one("blocks", 2).alias("k"), F.lit(False).alias("stray"), every("stray_blocks").alias("i"))
    blocks = left.unionByName(right).join(shuffled(sets), "id").select("family", "i", "k", "stray", "id", "component", "shingles")
    more = cut(blocks.groupBy("family", "i", "k").applyInPandas(_links_between(percent), "a long, b long"))

    component = connected_components(found.unionByName(more))
    component = cut(class_of.distinct().join(shuffled(component.withColumnRenamed("id", "rep").withColumnRenamed("component", "c")), F.col("id") == F.col("rep"), "left").select("doc_id", F.coalesce("c", "id").alias("c")).where("doc_id <> c"))
    out = signed.select("doc_id", "n_shingles").join(shuffled(component), "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("c", "doc_id").alias("component_id"))
    for x in (classes, reps, candidates, star, found, member, split, loose, more):
        drop_cut(x)
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(documents: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents that ``near_duplicates`` keeps, with all their columns; repeated ids keep one row."""
    kept = cut(near_duplicates(documents, percent).where("kept").select("doc_id").distinct())
    plain = documents.where("doc_id is not null").join(shuffled(kept.where("doc_id is not null")), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return plain.select(*documents.columns).unionByName(documents.where("doc_id is null"))


def brute_force(rows: list[tuple[int, str | None]], percent: int = PERCENT) -> dict[int, int]:
    """component_id by id, by comparing all pairs: for tests."""
    sets = {i: set(zip(*[w[k:] for k in range(min(WORDS, len(w)))])) if (w := (t or "").encode().lower().split()) else set() for i, t in rows}
    sets = {i: s if s else set() for i, s in sets.items()}
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    from .components import union_find

    top = union_find(links)
    return reduce(lambda d, i: d | {i: top.get(i, i)}, sets, {})
