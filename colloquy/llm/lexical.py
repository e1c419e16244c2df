"""Ranked lexical search: every document is scanned for the terms of all items at once, without an index of documents.

Terms are runs of ASCII letters and digits and of anything beyond ASCII; a text's other bytes become spaces and every
term stands between two spaces (a document begins and ends with one, neighbours share one). So an Aho-Corasick automaton
of all item terms, each guarded by a space on both sides, finds whole terms only, and each of its outputs is one occurrence of one term. The
automaton is broadcast as its terms and built once a worker.

Two scans: the first counts documents, terms and document frequencies, summed inside each task; the second counts the
occurrences again, scores every document for the items that its terms map to, and keeps the best of each item inside
the task. Tasks' best rows are reduced to the best of all in two steps. Nothing of a document is shuffled but its id.

The items are the stated query set. They come in blocks of at most about ``ITEMS`` items and ``ITEM_BYTES`` bytes of
text, which bounds automaton and broadcast; each block has scans of its own.
"""

from __future__ import annotations

import math
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, ship, slices
from .pieces import ragged

BEST, ITEMS, ITEM_BYTES = 10, 4096, 8 << 20
TEXT_BYTES, MATCHES, CELLS = 2 << 20, 1 << 19, 1 << 21

#: Lower case for A-Z; 0-9, a-z and bytes beyond ASCII stay; the rest are spaces.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> bytes:
    """The terms of a text in lower case (A-Z), with spaces for all else."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD)


def terms(text: str | None) -> list[bytes]:
    """The terms of a text, in order, with repeats."""
    return fold(text).split()


_BUILT: dict = {}


def _automaton(shared):
    """The automaton of a broadcast list of terms, whose outputs are the places of the terms; one is kept a worker."""
    if shared.id not in _BUILT:
        _BUILT.clear()
        machine = ahocorasick.Automaton()
        for k, term in enumerate(shared.value):
            machine.add_word(f" {term.decode('latin-1')} ", k)
        machine.make_automaton()
        _BUILT[shared.id] = machine
    return _BUILT[shared.id]


# The broadcast object itself loses its identity on the way to a task, so the terms travel with a number.
class _Shared:
    def __init__(self, spark, number: int, values: list[bytes]):
        self.id, self.held = number, spark.sparkContext.broadcast(values)

    @property
    def value(self) -> list[bytes]:
        return self.held.value

    def __getstate__(self):
        return {"id": self.id, "held": self.held}


def count(machine: ahocorasick.Automaton, n_terms: int, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms of each text, and (text, term, occurrences) of the automaton's terms, sorted by text and term."""
    folded = [fold(t) for t in texts]
    n = np.array([len(f.split()) for f in folded], np.int64)
    begin = np.cumsum([1] + [len(f) + 1 for f in folded])[:-1]
    key, times = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n_terms:
        hits = machine.iter(" " + b" ".join(folded).decode("latin-1") + " ")
        while True:
            some = np.fromiter(islice(hits, MATCHES), np.dtype([("end", np.int64), ("term", np.int64)]))
            if not len(some):
                break
            # A match ends with the space behind its term, so its last letter lies inside the text.
            row = np.searchsorted(begin, some["end"] - 1, side="right") - 1
            new, k = np.unique(row * n_terms + some["term"], return_counts=True)
            key, at = np.unique(np.concatenate([key, new]), return_inverse=True)
            times = np.bincount(at, np.concatenate([times, k])).astype(np.int64)
    return n, key // max(1, n_terms), key % max(1, n_terms), times


def _counter(shared: _Shared):
    """(term, n): documents that hold each term; -1: documents with terms, -2: their terms."""

    def run(batches):
        machine, size = _automaton(shared), len(shared.value)
        df, documents, every = np.zeros(size, np.int64), 0, 0
        for batch in batches:
            for part in slices(batch, 1024, TEXT_BYTES):
                n, _, term, _ = count(machine, size, part.column("text").to_pylist())
                df += np.bincount(term, minlength=size)
                documents, every = documents + int((n > 0).sum()), every + int(n.sum())
        held = np.nonzero(df)[0]
        yield pa.RecordBatch.from_arrays([pa.array(np.append(held, [-1, -2]), pa.int64()), pa.array(np.append(df[held], [documents, every]), pa.int64())], ["term", "n"])
        give_back()

    return run


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


def saturated(tf: np.ndarray, n: np.ndarray, documents: int, every: int) -> np.ndarray:
    """What a term's occurrences count for in a document of ``n`` terms, times 10^6."""
    m = 10 + (90 * n * documents) // max(1, every)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class _Top:
    """The best documents of each item so far: by score, then by id (null ids last)."""

    def __init__(self, items: int, best: int):
        self.best = best
        self.item, self.score, self.id, self.none = (np.zeros(0, t) for t in (np.int64, np.int64, np.int64, bool))
        self.least = np.ones(items)  # what a score has to reach

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        item, score, ids, none = (np.concatenate(x) for x in ((self.item, item), (self.score, score), (self.id, ids), (self.none, none)))
        by = np.lexsort((ids, none, -score, item))
        item = item[by]
        top = np.arange(len(item)) - np.searchsorted(item, item) < self.best
        self.item, self.score, self.id, self.none = item[top], score[by][top], ids[by][top], none[by][top]
        full = np.nonzero(np.bincount(self.item, minlength=len(self.least)) == self.best)[0]
        self.least[full] = self.score[np.searchsorted(self.item, full, side="right") - 1]


def _scorer(shared: _Shared, held, best: int):
    """The best documents of each item (its place in the block) that a task sees."""

    def run(batches):
        machine, size = _automaton(shared), len(shared.value)
        weights, ends, items_of, items, documents, every = held.value
        begins, top = ends - np.diff(ends, prepend=0), _Top(items, best)
        for batch in batches:
            for part in slices(batch, max(1, min(1024, CELLS // max(1, items))), TEXT_BYTES):
                n, row, term, tf = count(machine, size, part.column("text").to_pylist())
                worth = weights[term] * saturated(tf, n[row], documents, every)
                many = (ends - begins)[term]
                at = np.repeat(row, many) * items + ragged(items_of, begins[term], many)
                score = np.zeros(part.num_rows * items, np.int64)
                worth = np.repeat(worth, many)
                if size * float(worth.max(initial=0)) < 2**53:  # doubles hold these sums exactly
                    score[:] = np.bincount(at, worth, len(score))
                else:
                    np.add.at(score, at, worth)
                score = score.reshape(part.num_rows, items)
                doc, item = np.nonzero(score >= top.least[None, :])
                if len(doc):
                    ids = part.column("doc_id")
                    none = np.asarray(ids.is_null())
                    top.add(item, score[doc, item], ids.fill_null(0).to_numpy(zero_copy_only=False)[doc], none[doc])
        if len(top.item):
            yield pa.RecordBatch.from_arrays([pa.array(top.item.astype(np.int32)), pa.array(top.id, pa.int64(), mask=top.none), pa.array(top.score)], ["item", "doc_id", "score"])
        give_back()

    return run


def _first(rows: DataFrame, best: int, *keys) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= best)


def _search_block(documents: DataFrame, items: DataFrame, best: int) -> DataFrame | None:
    """``search`` for the items of one block; None where they have no terms."""
    spark = documents.sparkSession
    of: dict = {}
    for r in items.toLocalIterator():
        of.setdefault(r.item_id, set()).update(terms(r.text))
    ids = [i for i, some in of.items() if some]
    if not ids:
        return None
    holders: dict[bytes, list[int]] = {}
    for k, i in enumerate(ids):
        for term in of[i]:
            holders.setdefault(term, []).append(k)
    known = sorted(holders)
    shared = _Shared(spark, id(known), known)
    sums = dict(documents.select("text").mapInArrow(_counter(shared), "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # a row a term of the block
    n, every = sums.get(-1, 0), sums.get(-2, 0)
    weights = np.array([weight(n, sums.get(k, 0)) for k in range(len(known))], np.int64)
    ends = np.cumsum([len(holders[t]) for t in known])
    held = spark.sparkContext.broadcast((weights, ends, np.array([k for t in known for k in holders[t]], np.int64), len(ids), n, every))
    found = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scorer(shared, held, best), "item int, doc_id long, score long")
    tasks = max(1, math.isqrt(documents.rdd.getNumPartitions()))
    part = found.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(tasks)))
    ranked = _first(_first(part, best, "item", "part").drop("part", "rank"), best, "item")
    names = F.array(*[F.lit(i).cast(dict(items.dtypes)["item_id"]) for i in ids])
    return ranked.select(F.get(names, F.col("item")).alias("item_id"), F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def search(documents: DataFrame, items: DataFrame, best: int = BEST) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``best`` documents of score above 0 for each item.

    Highest score first, equal scores by doc_id (nulls last). Rows that repeat an item_id are one item with the terms of
    all of them; null is an id like any other. A null or empty text has no terms: such a document is not counted or
    found, such an item has no rows. Each row of ``documents`` is a document, also where doc_ids repeat. Other columns
    are ignored; empty tables give no rows.
    """
    spark = documents.sparkSession
    ship(spark)
    items = items.select("item_id", "text").where("text is not null")
    schema = f"item_id {dict(items.dtypes)['item_id']}, rank int, doc_id long, score long"
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size.n // ITEMS), -(-(size.bytes or 0) // ITEM_BYTES))
    done = None
    for k in range(blocks):
        some = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        found = _search_block(documents, some, best)
        done = found if done is None else done if found is None else done.unionByName(found)
    return done if done is not None else spark.createDataFrame([], schema)


#: The same in DuckDB SQL, with an inverted table of the terms.
ORACLE = r"""
with doc as (
  select row_number() over () as d, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as t from documents
), asked as (
  select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark where text is not null
), total as (select count(*) filter (len(t) > 0) as n, sum(len(t))::bigint as l from doc
), held as (select d, doc_id, term, any_value(size) as size, count(*) as tf from (select d, doc_id, len(t) as size, unnest(t) as term from doc) where term in (select term from asked) group by d, doc_id, term
), known as (select term, floor(1000 * ln((2 * any_value(n) + 2)::double / (2 * count(*) + 1)))::bigint as w from held, total group by term
), scored as (
  select item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * size * n) // l))))::bigint as score
  from asked join held using (term) join known using (term), total group by item_id, d, doc_id
), ranked as (select item_id, row_number() over (partition by item_id order by score desc, doc_id nulls last)::int as rank, doc_id, score from scored where score > 0)
select item_id, rank, doc_id, score from ranked where rank <= 10
"""
