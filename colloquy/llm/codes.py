"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry, in exact integers.

Components are floor(256 * x). Squared distances come from dot products, |x|^2 - 2 x.c + |c|^2, and these from float64
matrix products of limbs: an integer is split into limbs of so few bits that no sum of a product's terms reaches 2^53,
each pair of limbs is multiplied by BLAS exactly, and the products are shifted and summed in int64. Nearest entries are
the first minimum.

Spark deals the rows: a task assigns its rows and sums them by (part, entry), so a round sends at most parts x entries
rows a task; these are added up by Spark, and the driver sees the codebooks alone.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, ship

PARTS, ENTRIES, ROUNDS, SCALE, AT_ONCE = 16, 64, 2, 256.0, 1024


def limbs(x: np.ndarray, bits: int, most: int) -> list[np.ndarray]:
    """float64 arrays with sum(limb << bits * k) = x; the last is signed, the others lie in [0, 2^bits)."""
    out = []
    while most >> bits:
        out.append((x & ((1 << bits) - 1)).astype(np.float64))
        x, most = x >> bits, most >> bits
    return [*out, x.astype(np.float64)]


def dot(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact int64 products of the rows of ``x`` (..., n, w) with those of ``c`` (..., k, w), where they fit."""
    width = max(1, x.shape[-1])
    bits = (52 - int(np.ceil(np.log2(width)))) // 2
    a, b = (limbs(v, bits, int(np.abs(v).max(initial=0))) for v in (x, np.swapaxes(c, -1, -2)))
    total = np.zeros((*x.shape[:-1], c.shape[-2]), np.int64)
    for i, left in enumerate(a):
        for j, right in enumerate(b):
            if bits * (i + j) < 64:  # beyond, a product is a multiple of 2^64: the sum is taken modulo that
                total += (left @ right).astype(np.int64) << np.int64(bits * (i + j))
    return total


def assign(x: np.ndarray, codebooks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and squared distances (part, row) of the nearest entries of ``codebooks`` (part, entry, position) for the
    rows of ``x`` (part, row, position); the first of equally near ones."""
    square = (x * x).sum(-1)
    far = square[:, :, None] + (codebooks * codebooks).sum(-1)[:, None, :] - 2 * dot(x, codebooks)
    near = far.argmin(axis=-1)
    return near, np.take_along_axis(far, near[:, :, None], axis=-1)[:, :, 0]


def _bounds(d: int) -> list[int]:
    """Where the parts begin: equal ones where ``d`` is a multiple of their number, else longer ones come first."""
    return [p * (d // PARTS) + min(p, d % PARTS) for p in range(PARTS + 1)]


def _parts(flat: np.ndarray, d: int) -> np.ndarray:
    """(part, row, position) of rows of ``d`` components; shorter parts are filled with zeros, which add no distance."""
    rows, at = flat.reshape(len(flat) // d if d else 0, d), _bounds(d)
    out = np.zeros((PARTS, len(rows), -(-d // PARTS)), np.int64)
    for p in range(PARTS):
        out[p, :, : at[p + 1] - at[p]] = rows[:, at[p] : at[p + 1]]
    return out


def _chunks(batch: pa.RecordBatch, d: int):
    """Slices of a batch with their rows as parts."""
    step = max(1, min(AT_ONCE, (1 << 22) // max(1, d)))
    for at in range(0, batch.num_rows, step):
        some = batch.slice(at, step)
        x = _parts(some.column("x").flatten().to_numpy(zero_copy_only=False).astype(np.int64), d)
        yield some, x if d else np.zeros((PARTS, some.num_rows, 0), np.int64)


_SUMS = "part int, entry int, n long, sums array<long>"


def _summed(codebooks: np.ndarray, d: int):
    """Count and sums of what a task assigns to each entry."""

    def run(batches):
        n, sums = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for batch in batches:
            for _, x in _chunks(batch, d):
                near, _ = assign(x, codebooks)
                for p in range(PARTS):
                    n[p] += np.bincount(near[p], minlength=n.shape[1])
                    np.add.at(sums[p], near[p], x[p])
        part, entry = np.nonzero(n)
        if len(part):
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(n[part, entry]), pa.array(list(sums[part, entry]), pa.list_(pa.int64()))], ["part", "entry", "n", "sums"])

    return run


def _coded(codebooks: np.ndarray, d: int):
    def run(batches):
        for batch in batches:
            for some, x in _chunks(batch, d):
                near, far = assign(x, codebooks)
                raw = near.T.astype(np.uint8).tobytes().hex()
                code = [raw[k : k + 2 * PARTS] for k in range(0, len(raw), 2 * PARTS)]
                yield pa.RecordBatch.from_arrays([some.column("vec_id"), some.column("label"), pa.array(code, pa.string()), pa.array(far.sum(axis=0))], ["vec_id", "label", "code", "error"])

    return run


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and x (integer components) of the rows whose vector is neither null nor holds null or non-finite components."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    rows = embeddings.select("vec_id", "label", v.alias("v")).where(F.col("v").isNotNull()).where(~F.exists("v", bad))
    return rows.select("vec_id", "label", F.transform("v", lambda c: F.floor(c * SCALE)).alias("x"))


def _smallest(rows: DataFrame) -> list[list[int]]:
    """The vectors of the ``ENTRIES`` smallest ids; of an id that repeats, its least one. One look unless ids repeat."""
    found: dict = {}
    left = rows.where("vec_id is not null")
    while True:
        some = left.orderBy("vec_id", "x").limit(ENTRIES).select("vec_id", "x").collect()
        for r in some:
            if len(found) < ENTRIES:
                found.setdefault(r.vec_id, r.x)
        if len(some) < ENTRIES or len(found) == ENTRIES:
            return list(found.values())
        left = rows.where(F.col("vec_id") > some[-1].vec_id)


def compress(embeddings: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error (squared distances summed over parts), label_error (error summed over
    equal labels, nulls together) and codebooks_sha256 of every row that ``valid`` keeps.

    The codebooks begin with the vectors of the smallest vec_ids (null ids are none; of an id that repeats, its least
    vector) and are replaced ``ROUNDS`` times by floored means of what is nearest to them. Repeated rows count and are
    coded each. Vectors of another length than the most frequent one (ties: the longest) take no part; lengths that the
    number of parts does not divide give longer parts first. With no id at all the codebooks hold one entry of zeros.
    An empty table gives no rows. Components whose distances could leave 64 bits are an error.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = valid(embeddings)
    kinds = dict(rows.dtypes)
    schema = f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long"
    lengths = rows.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("x", lambda c: F.abs(c.cast("decimal(38,0)"))))).alias("most")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], f"vec_id {kinds['vec_id']}, code string, error long, label_error long, codebooks_sha256 string")
    d = lengths[0].d
    if d * 4 * int(lengths[0].most or 0) ** 2 >= 1 << 63:
        raise ValueError("squared distances of these vectors do not fit into 64 bits")
    rows = rows.where(F.size("x") == d)
    first = _smallest(rows)
    books = _parts(np.array([c for x in first for c in x] if first else np.zeros(d), np.int64), d)
    if not d:
        books = np.zeros((PARTS, max(1, len(first)), 0), np.int64)
    for _ in range(ROUNDS):
        sums = rows.select("x").mapInArrow(_summed(books, d), _SUMS)
        whole = [F.sum(F.get("sums", F.lit(k)).cast("decimal(38,0)")).alias(f"s{k}") for k in range(books.shape[2])]
        new = books.copy()
        for r in sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), *whole).collect():  # at most PARTS * ENTRIES rows
            new[r.part, r.entry] = [int(r[f"s{k}"]) // r.n for k in range(books.shape[2])]
        books = new
    at = _bounds(d)
    flat = [str(c) for p in range(PARTS) for entry in books[p] for c in entry[: at[p + 1] - at[p]].tolist()]
    digest = hashlib.sha256(",".join(flat).encode()).hexdigest()
    coded = cut(rows.mapInArrow(_coded(books, d), schema))
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    done = coded.join(sums, coded["label"].eqNullSafe(sums["_label"]))
    return done.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: The same in DuckDB SQL, over all pairs of parts and entries.
ORACLE = f"""
with kept as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as x from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), part as (
  select r, p, x[p * (len(x) // {PARTS}) + 1 : (p + 1) * (len(x) // {PARTS})] as x from kept, range({PARTS}) t(p)
), b0 as (
  select p, k - 1 as e, x from part join (select r, row_number() over (order by vec_id) as k from kept where vec_id is not null order by vec_id limit {ENTRIES}) using (r)
), {"".join(f'''
n{i} as materialized (
  select r, part.p, any_value(part.x) as x, min(list_sum(list_transform(range(1, len(part.x) + 1), lambda i: (part.x[i] - b.x[i]) * (part.x[i] - b.x[i])))::hugeint * {ENTRIES} + e) as best
  from part join b{i} b using (p) group by r, part.p
), u{i} as (
  select p, e, list(floor(s::double / n)::bigint order by i) as x from (
    select p, (best % {ENTRIES})::bigint as e, i, sum(x[i]) as s, count(*) as n from n{i}, range(1, (select max(len(x)) from part) + 1) t(i) where i <= len(x) group by all) group by all
), b{i + 1} as materialized (
  select p, e, coalesce(u.x, b.x) as x from b{i} b left join u{i} u using (p, e)
),''' for i in range(ROUNDS))}
last as (
  select r, part.p, min(list_sum(list_transform(range(1, len(part.x) + 1), lambda i: (part.x[i] - b.x[i]) * (part.x[i] - b.x[i])))::hugeint * {ENTRIES} + e) as best
  from part join b{ROUNDS} b using (p) group by r, part.p
), row_code as (
  select r, string_agg(printf('%02x', (best % {ENTRIES})::bigint), '' order by p) as code, sum(best // {ENTRIES})::bigint as error from last group by r
), digest as (select sha256(string_agg(array_to_string(x, ','), ',' order by p, e)) as codebooks_sha256 from b{ROUNDS})
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error, codebooks_sha256 from kept join row_code using (r), digest
"""
