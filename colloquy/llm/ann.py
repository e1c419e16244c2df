"""Approximate nearest neighbours by an adaptive dimension scan over inverted lists.

Inner products become distances: with M the largest norm, x gets the extra component sqrt(M^2 - |x|^2) and a query 0,
so the order of distances is that of inner products, whatever the norms. All vectors are turned by one random rotation.
Lists are cells of k-means centroids, fitted on a bounded sample (``SAMPLE`` rows, lowest hash of vec_id first); every
row is assigned to its list.

A query's limit is the distance of its k-th nearest sampled row: its k-th nearest row of all is at most as far. A list is
probed unless all its rows must lie beyond the limit (distance to the centroid less the list's radius). The sample serves
centroids and limits only: every candidate comes out of a probed list, whatever the size of the table. Inside a list the
columns come in blocks. After each block a candidate's partial distance d' of k out of D dimensions is tested: if d'
exceeds k / D * (1 + EPSILON / sqrt(k))^2 times the limit, the hypothesis that the candidate is nearer is rejected and its
other columns are never read. What survives gets its exact inner product on the original vectors in double precision, and
the limit shrinks to the k-th best found so far. A query whose tests reject too much to leave k rows is scanned again
without tests.

Spark deals units of at most about ``BLOCK`` rows (several lists, or a part of a large one) against blocks of at most
about ``QUERIES`` queries. A query goes to a unit once, with the lists that it probes there.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import below, cut, ship

NEAREST, SAMPLE, BLOCK, QUERIES, CHUNK = 20, 20_000, 16_384, 4096, 1024
FIRST, COLUMNS, EPSILON, SEED = 16, 8, 1.5, 7


def k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    """Centroids of a bounded sample."""
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)
        n = np.bincount(near, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _rotation(d: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def _lift(x: np.ndarray, largest: float, query: bool) -> np.ndarray:
    extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, largest**2 - (x * x).sum(1)))
    return np.concatenate([x, extra[:, None]], axis=1) @ _rotation(x.shape[1] + 1)


def _vectors(batch, d: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)


def _placer(centroids: np.ndarray, d: int, largest: float):
    """vec_id, list, distance to its centroid and the original vector as double bytes."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                x = _vectors(batch, d)
                lifted = _lift(x, largest, False)
                far = (lifted * lifted).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (lifted @ centroids.T)
                near = np.argmin(far, axis=1)
                out = np.sqrt(np.maximum(0, far[np.arange(len(x)), near]))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near.astype(np.int32)), pa.array(out), pa.array([r.tobytes() for r in x], pa.binary())], ["vec_id", "list", "out", "v"])

    return run


def _asker(centroids: np.ndarray, radius: np.ndarray, units: list[list[int]], sample_ids: np.ndarray, sample: np.ndarray, d: int, largest: float, k: int):
    """Each query with its limit, once for every unit that holds a list it has to probe, with these lists.

    ``radius``: of each list (negative: no rows); ``units``: those that hold each list.
    """
    held = np.zeros((len(centroids), 1 + max((u for some in units for u in some), default=0)), dtype=bool)
    for k_, some in enumerate(units):
        held[k_, some] = True

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                x = _vectors(batch, d)
                square, ids = (x * x).sum(1), batch.column("vec_id").to_numpy()
                inner = x @ sample.T
                inner[ids[:, None] == sample_ids[None, :]] = -np.inf
                enough = (inner > -np.inf).sum(axis=1) >= k
                kth = np.partition(inner, -k, axis=1)[:, -k] if inner.shape[1] >= k else np.full(len(x), -np.inf)
                limit = np.where(enough, square + largest**2 - 2 * np.where(enough, kth, 0), np.inf)
                far = square[:, None] + (centroids * centroids).sum(1)[None, :] - 2 * (_lift(x, largest, True) @ centroids.T)
                probed = (np.sqrt(np.maximum(0, far)) - radius[None, :] <= np.sqrt(limit)[:, None] + 1e-6) & (radius >= 0)[None, :]
                for u in range(held.shape[1]):
                    some = probed & held[:, u][None, :]
                    asks = np.nonzero(some.any(axis=1))[0]
                    if len(asks):
                        lists = pa.array([np.nonzero(some[i])[0].astype(np.int32) for i in asks], pa.list_(pa.int32()))
                        yield pa.RecordBatch.from_arrays([pa.array(ids[asks]), pa.array([x[i].tobytes() for i in asks], pa.binary()), pa.array(limit[asks]), pa.array(np.full(len(asks), u, np.int32)), lists], ["vec_id", "v", "limit", "unit", "lists"])

    return run


def scan(q: np.ndarray, own: np.ndarray, limit: np.ndarray, ids: np.ndarray, x: np.ndarray, largest: float, epsilon: float | None = EPSILON) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query places, candidate places, exact inner products) of the pairs that pass every test."""
    turned, lifted = _lift(q, largest, True), _lift(x, largest, False)
    dims = lifted.shape[1]
    if epsilon is None:
        i, j = np.nonzero(own[:, None] != ids[None, :])
        return i, j, (x[j] * q[i]).sum(axis=1)
    slack = lambda b: (1 + epsilon / np.sqrt(b)) ** 2 * b / dims if b < dims else 1 + 1e-9
    b = min(FIRST, dims)
    part = (turned[:, :b] ** 2).sum(1)[:, None] + (lifted[:, :b] ** 2).sum(1)[None, :] - 2 * (turned[:, :b] @ lifted[:, :b].T)
    i, j = np.nonzero((part <= (slack(b) * limit)[:, None] + 1e-9) & (own[:, None] != ids[None, :]))
    part = part[i, j]
    while b < dims:
        a, b = b, min(b + COLUMNS, dims)
        part = part + ((lifted[j, a:b] - turned[i, a:b]) ** 2).sum(1)
        keep = part <= slack(b) * limit[i] + 1e-9
        i, j, part = i[keep], j[keep], part[keep]
    return i, j, (x[j] * q[i]).sum(axis=1)


def _best(i: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best pairs of each query place, ties to the smaller id, in order of places."""
    by = np.lexsort((ids, -score, i))
    i, ids, score = i[by], ids[by], score[by]
    top = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[top], ids[top], score[top]


def _scanner(d: int, largest: float, k: int, epsilon: float | None):
    def run(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"query_id": np.zeros(0, np.int64), "vec_id": np.zeros(0, np.int64), "score": np.zeros(0)})
        if not len(queries) or not len(rows):
            return none
        rows = rows.drop_duplicates(["vec_id", "v"]).sort_values("list", kind="stable")
        ids, lists = rows["vec_id"].to_numpy(), rows["list"].to_numpy()
        x = np.frombuffer(b"".join(rows["v"]), dtype=np.float64).reshape(-1, d)
        own, limit = queries["vec_id"].to_numpy(), queries["limit"].to_numpy().copy()
        q = np.frombuffer(b"".join(queries["v"]), dtype=np.float64).reshape(-1, d)
        square = (q * q).sum(1)
        wanted = np.repeat(np.arange(len(q)), [len(y) for y in queries["lists"]])
        asked = np.concatenate([np.asarray(y, dtype=np.int32) for y in queries["lists"]])
        found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        for one in np.unique(lists):
            who = wanted[asked == one]
            a, b = np.searchsorted(lists, [one, one + 1])
            for at in range(a, b, CHUNK) if len(who) else ():
                part = slice(at, min(b, at + CHUNK))
                for w in range(0, len(who), CHUNK):
                    some = who[w : w + CHUNK]
                    i, j, score = scan(q[some], own[some], limit[some], ids[part], x[part], largest, epsilon)
                    found = tuple(np.concatenate([old, new]) for old, new in zip(found, (some[i], ids[part][j], score), strict=True))
                found = _best(*found, k)
                full = np.bincount(found[0], minlength=len(q)) >= k
                last = np.searchsorted(found[0], np.nonzero(full)[0], side="right") - 1
                limit[full] = np.minimum(limit[full], square[full] + largest**2 - 2 * found[2][last])
        return pd.DataFrame({"query_id": own[found[0]], "vec_id": found[1], "score": found[2]})

    return run


def _units(sizes: dict[int, int]) -> dict[int, list[int]]:
    """The units of each list: small lists share one of at most BLOCK rows, a larger list is dealt over its own."""
    out, unit, room = {}, -1, 0
    for one, n in sorted(sizes.items()):
        if n > BLOCK:
            parts = -(-n // BLOCK)
            out[one], unit, room = list(range(unit + 1, unit + 1 + parts)), unit + parts, 0
        else:
            if n > room:
                unit, room = unit + 1, BLOCK
            out[one], room = [unit], room - n
    return out


def valid(embeddings: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the rows that take part, whatever their length."""
    v = F.col("embedding").cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    return rows.where(~F.exists("v", bad) & F.exists("v", lambda x: x != 0))


def nearest(embeddings: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, epsilon: float | None = EPSILON) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k rows of largest inner product found for each query, ties to smaller id.

    ``queries`` has the same columns (None: the rows whose vec_id is divisible by 20). A query's own vec_id is no
    candidate; fewer candidates give fewer rows. Null vectors, zero vectors, vectors with null or non-finite components,
    null ids and vectors of another length than the most frequent one (ties: the longest) take no part. Rows that
    repeat a vec_id with its vector count once. Empty tables give no rows. With ``epsilon`` None every candidate of a
    probed list is compared in full.
    """
    spark = embeddings.sparkSession
    ship(spark)
    rows = valid(embeddings)
    asked = valid(queries) if queries is not None else rows.where("vec_id % 20 = 0")
    lengths = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)).alias("m")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    schema = "query_id long, rank int, vec_id long, score double"
    if not lengths:
        return spark.createDataFrame([], schema)
    d, n, largest = lengths[0].d, lengths[0].n, float(np.sqrt(lengths[0].m)) * (1 + 1e-12)
    rows, asked = rows.where(F.size("v") == d), asked.where(F.size("v") == d).dropDuplicates(["vec_id"])
    low = F.xxhash64("vec_id")
    sample = rows.where(below(low, SAMPLE, n)).orderBy(low, "vec_id").limit(SAMPLE).select("vec_id", "v").toArrow()
    sample_ids, first = np.unique(sample.column("vec_id").to_numpy(), return_index=True)
    x = np.asarray(sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)[first]
    lists = int(min(max(1, np.sqrt(n) / 4), max(1, len(x) // 20), 1024))
    centroids = k_means(_lift(x, largest, False), lists, np.random.default_rng(SEED))
    placed = cut(rows.mapInArrow(_placer(centroids, d, largest), "vec_id long, list int, out double, v binary"))
    cells = placed.groupBy("list").agg(F.count("*").alias("n"), F.max("out").alias("radius")).collect()  # at most 1024 rows
    radius, units = np.full(lists, -1.0), _units({c.list: c.n for c in cells})
    for c in cells:
        radius[c.list] = c.radius
    ask = _asker(centroids, radius, [units.get(c, []) for c in range(lists)], sample_ids, x, d, largest, k)
    probes = cut(asked.mapInArrow(ask, "vec_id long, v binary, limit double, unit int, lists array<int>"))
    home = cut(spark.createDataFrame([(c, u) for c, u in units.items()], "list int, units array<int>").coalesce(1))
    unit = F.element_at("units", (F.pmod(F.xxhash64("vec_id"), F.size("units")) + 1).cast("int"))
    dealt = placed.join(F.broadcast(home), "list").select("vec_id", "list", "v", unit.alias("unit"))  # a row a list: at most 1024

    def scanned(probes: DataFrame, epsilon: float | None) -> DataFrame:
        # A row is copied as often as the queries of its own unit ask; units without queries take no part.
        asks = cut(probes.groupBy("unit").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("asks")).coalesce(1))
        left = probes.join(asks, "unit").select(*probes.columns, F.pmod(F.xxhash64("vec_id"), F.col("asks")).cast("int").alias("ask"))
        copies = asks.select("unit", F.sequence(F.lit(0), F.col("asks") - 1).alias("copies"))
        right = dealt.join(copies, "unit").select("vec_id", "list", "v", "unit", F.explode("copies").alias("ask"))
        return left.groupBy("unit", "ask").cogroup(right.groupBy("unit", "ask")).applyInPandas(_scanner(d, largest, k, epsilon), "query_id long, vec_id long, score double")

    if probes.isEmpty():
        return spark.createDataFrame([], schema)
    found = cut(scanned(probes, epsilon).distinct())
    # What the tests left short of k rows is scanned again in full.
    least = min(k, n - 1)
    got = found.groupBy("query_id").agg(F.count("*").alias("got"))
    short = cut(asked.select(F.col("vec_id").alias("query_id")).join(got, "query_id", "left").where(F.coalesce("got", F.lit(0)) < least).select("query_id")) if epsilon is not None else None
    if short is not None and not short.isEmpty():
        again = asked.join(short, asked["vec_id"] == short["query_id"], "left_semi")
        pairs = again.select("vec_id", "v").mapInArrow(_asker(centroids, np.full(lists, np.inf), [units.get(c, []) for c in range(lists)], sample_ids[:0], x[:0], d, largest, k), "vec_id long, v binary, limit double, unit int, lists array<int>")
        found = found.unionByName(scanned(cut(pairs), None)).distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
