"""Language-model scoring by cross-entropy difference.

Two bigram models, one of target documents and one of all documents, share one vocabulary (every lower-cased word of the
corpus), one order and one smoothing:

    p(w | v) = (c(v, w) + PRIOR * p(w)) / (c(v) + PRIOR),   p(w) = (1 - u) * c(w) / n + u / (words in the vocabulary)

where u is the mass of unseen words, estimated by the share of words that occur once (Good and Turing).

The models are matched, so that a document's score says what it is like and not what was counted. No document is known
to a model that scores it: its own counts are taken off first, those of a target document off both models. And the
background is as large as the target: a larger sample alone would know more of any text. Instead of one random sample
of the background's words, losses are means over all samples that keep each of them with the probability s = target
words / all words: log(c + a) becomes the mean of log(k + a) for k of the binomial distribution of c and s. So every
count of the corpus takes part.

A document's score is its mean loss under the background model minus that under the target model: positive means more
like the target than an equally large part of the corpus is.

Every word and every pair of words is counted by itself. A document's score is its mean loss under the background model
minus that under the target model: positive means more like the target.

Documents are held in blocks of bounded size, whatever the corpus. A block numbers its own words; words and then word
pairs are dealt by hash into as many buckets as the corpus needs, packed as one row a (block, bucket), counted there
over all blocks, and the counts go back to each block. A block names a pair once, however often it holds it, so no
pair is hot.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, mix64, ship, slices

PRIOR = 2000.0
#: Counts of words are kept one by one up to EXACT, beyond in bins of a twelfth of a doubling.
EXACT, FINE, BINS = 64, 12, 64 + 12 * 48
SCHEMA = "doc_id long, n_words long, background_loss double, target_loss double, score double"


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words, as bytes."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


BLOCK_BYTES, BLOCK_ROWS, BUCKET, AT_ONCE = 16 << 20, 1 << 16, 2_000_000, 250_000
#: Word ids begin at 1; 0 stands for the start of a text, _NONE for what is no word.
_START, _NONE, _HALF = np.uint64(0), np.uint64(2**32 - 1), np.uint64(32)


def _pack(a: np.ndarray) -> bytes:
    """64-bit integers, compressed byte plane by byte plane."""
    a = np.ascontiguousarray(a).astype("<u8")
    return len(a).to_bytes(8, "little") + (pa.compress(a.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(a) else b"")


def _unpack(b: bytes) -> np.ndarray:
    n = int.from_bytes(b[:8], "little")
    if not n:
        return np.zeros(0, np.uint64)
    return np.ascontiguousarray(np.frombuffer(pa.decompress(b[8:], 8 * n, "zstd", asbytes=True), np.uint8).reshape(8, n).T).view("<u8").ravel()


_BLOCKS = "block long, n_words long, n_tokens long, ids array<long>, lengths binary, tokens binary, n_bytes long, words binary"


def _block_row(number: int, parts: list) -> pa.RecordBatch:
    text = pc.fill_null(pa.concat_arrays([p.column("text") for p in parts]), "")
    split = pc.ascii_split_whitespace(pc.ascii_lower(text))
    values, row = split.flatten(), pc.list_parent_indices(split)
    real = pc.not_equal(pc.binary_length(values), 0)
    coded, row = values.filter(real).dictionary_encode(), row.filter(real).to_numpy(zero_copy_only=False)
    words = b"\n".join(coded.dictionary.cast(pa.binary()).to_pylist())
    ids = pa.concat_arrays([p.column("doc_id") for p in parts])
    lengths = np.bincount(row, minlength=len(ids))
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.binary()]
    values = [number, len(coded.dictionary), len(coded), ids.to_pylist(), _pack(lengths), _pack(coded.indices.to_numpy(zero_copy_only=False)), len(words), pa.compress(words, "zstd", asbytes=True) if words else b""]
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], [c.split()[0] for c in _BLOCKS.split(", ")])


def _in_blocks(batches):
    number, held, size, rows = TaskContext.get().partitionId() << 32, [], 0, 0
    for batch in batches:
        for part in slices(batch, BLOCK_ROWS, BLOCK_BYTES):
            n = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and (size + n > BLOCK_BYTES or rows + part.num_rows > BLOCK_ROWS):
                yield _block_row(number, held)
                number, held, size, rows = number + 1, [], 0, 0
            held, size, rows = [*held, part], size + n, rows + part.num_rows
    if held:
        yield _block_row(number, held)


def _dealt(bucket: np.ndarray, buckets: int):
    """(bucket, places of its rows in order) of the buckets that have rows."""
    order = np.argsort(bucket, kind="stable")
    ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
    return [(b, order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]


def _deal_words(buckets: int):
    def run(batches):
        for batch in batches:
            for block, size, packed in zip(*(batch.column(c).to_pylist() for c in ("block", "n_bytes", "words")), strict=True):
                words = pa.decompress(packed, size, "zstd", asbytes=True).split(b"\n") if size else []
                of = np.array([xxhash.xxh3_64_intdigest(w) % buckets for w in words], np.int64)
                dealt = [(b, block, _pack(np.diff(at, prepend=0)), b"\n".join(words[k] for k in at)) for b, at in _dealt(of, buckets)]
                for a in range(0, len(dealt), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*dealt[a : a + 256]), (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "block", "a", "b"])

    return run


_ANSWER = "block long, bucket int, a binary, b binary, n long"


def _answers(rows: list) -> pa.Table:
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64())
    return pa.table([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], [c.split()[0] for c in _ANSWER.split(", ")])


def _number_words(buckets: int):
    """The id of every word of a bucket, back to the blocks that hold it; n: words of the bucket, in one row."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["block"])
        sent = [r["b"].split(b"\n") for r in rows]
        coded = pa.array([w for s in sent for w in s], pa.binary()).dictionary_encode()
        ids = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) * buckets + rows[0]["bucket"] + 1
        if ids.max() >= int(_NONE):
            raise ValueError("more words than ids")
        at = np.cumsum([0] + [len(s) for s in sent])
        return _answers([(r["block"], r["bucket"], r["a"], _pack(ids[at[k] : at[k + 1]]), len(coded.dictionary) if k == 0 else 0) for k, r in enumerate(rows)])

    return run


class _Block:
    """A block read back: its word pairs and words as sorted 64-bit keys."""

    def __init__(self, table: pa.Table):
        rows = table.to_pylist()
        main = next(r for r in rows if r["kind"] == 0)
        self.number, self.ids, self.lengths = main["block"], main["ids"], _unpack(main["a"]).astype(np.int64)
        marked = {i for r in rows if r["kind"] == 2 for i in r["ids"]}
        tokens, named = _unpack(main["b"]).astype(np.int64), [(np.cumsum(_unpack(r["a"])).astype(np.int64), _unpack(r["b"])) for r in rows if r["kind"] == 1]
        id_of = np.zeros(sum(len(p) for p, _ in named), np.uint64)
        for places, ids in named:
            id_of[places] = ids
        self.row = np.repeat(np.arange(len(self.ids)), self.lengths)
        self.target = np.array([i in marked for i in self.ids], bool)[self.row]
        word, before = id_of[tokens], np.zeros(len(tokens), np.uint64)
        before[1:] = word[:-1]
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = _START
        self.keys = before << _HALF | word
        self.pairs, self.at = np.unique(self.keys, return_inverse=True)
        self.words = np.unique(id_of)
        self.answered = [r for r in rows if r["kind"] == 3]

    def items(self) -> np.ndarray:
        """Pairs; (none, word): the word; (word or start, none): it as context; (none, none): all words."""
        if not len(self.keys):
            return np.zeros(0, np.uint64)
        contexts = np.concatenate([[_START], self.words])
        return np.concatenate([self.pairs, _NONE << _HALF | self.words, contexts << _HALF | _NONE, [_NONE << _HALF | _NONE]])

    def counts(self, chosen: np.ndarray) -> np.ndarray:
        """How often the chosen tokens hold each item."""
        n = np.bincount(self.at[chosen], minlength=len(self.pairs))
        contexts = np.concatenate([[_START], self.words])
        word = np.bincount(np.searchsorted(self.words, self.pairs & _NONE), n, len(self.words))
        context = np.bincount(np.searchsorted(contexts, self.pairs >> _HALF), n, len(contexts))
        return np.concatenate([n, word, context, [n.sum()]]).astype(np.int64)


def _deal_items(buckets: int):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        keys, out = block.items(), []
        if len(keys):
            n, target = block.counts(np.ones(len(block.keys), bool)), block.counts(block.target)
            for b, at in _dealt((mix64(keys) % np.uint64(buckets)).astype(np.int64), buckets):
                at = at[np.argsort(keys[at])]
                out.append((b, block.number, _pack(np.diff(keys[at], prepend=np.uint64(0))), _pack(n[at]), _pack(target[at])))
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["bucket", "block", "keys", "n", "target"])

    return run


def _bin(c: np.ndarray) -> np.ndarray:
    """The bin of a count from 1 on."""
    far = EXACT - 1 + np.ceil(FINE * np.log2(np.maximum(c, EXACT) / EXACT)).astype(np.int64)
    return np.where(c <= EXACT, c - 1, np.minimum(far, BINS - 1))


def _count_items(table: pa.Table) -> pa.Table:
    """Counts of a bucket's items over all blocks, back to each block; stats, in one row: words of all and of the target,
    target words that occur once, and for each bin the number of words and the sum of their counts."""
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [np.cumsum(_unpack(r["keys"]), dtype=np.uint64) for r in rows]
    at = np.cumsum([0] + [len(k) for k in keys])
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    n, target = (np.bincount(place, np.concatenate([_unpack(r[c]) for r in rows]).astype(np.float64), len(every)).astype(np.int64) for c in ("n", "target"))
    all_words, words = every == (_NONE << _HALF | _NONE), (every >> _HALF == _NONE) & (every & _NONE != _NONE)
    bins = _bin(n[words])
    stats = [n[all_words].sum(), target[all_words].sum(), (target[words] == 1).sum(), *np.bincount(bins, minlength=BINS), *np.bincount(bins, n[words], BINS).astype(np.int64)]
    out = [(r["block"], r["bucket"], _pack(n[place[at[k] : at[k + 1]]]), _pack(target[place[at[k] : at[k + 1]]]), list(map(int, stats)) if k == 0 else None) for k, r in enumerate(rows)]
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()))
    return pa.table([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["block", "bucket", "a", "b", "stats"])


def mean_log(c: np.ndarray, s: float, a: np.ndarray | float) -> np.ndarray:
    """The mean of log(k + a), k of the binomial distribution of c draws of probability s.

    Summed where c * s is at most 30, and beyond by the moments about the mean (error below 1e-4).
    """
    c = c.astype(np.float64)
    a = np.broadcast_to(np.asarray(a, np.float64), c.shape)
    if s > 1 - 1e-9:
        return np.log(c + a)
    m = c * s
    out = np.empty(len(c))
    big = m > 30
    mu, var = m[big] + a[big], m[big] * (1 - s)
    third, fourth = var * (1 - 2 * s), var * (1 - 6 * s * (1 - s)) + 3 * var**2
    out[big] = np.log(mu) - var / (2 * mu**2) + third / (3 * mu**3) - fourth / (4 * mu**4)
    most = np.minimum(c, np.ceil(m + 10 * np.sqrt(m) + 12)).astype(np.int64)
    rows = np.nonzero(~big)[0]
    rows = rows[np.argsort(-most[rows], kind="stable")]
    left, c, a, most = np.zeros(len(rows)), c[rows], a[rows], most[rows]
    chance = (1 - s) ** c
    for k in range(int(most[0]) + 1 if len(most) else 0):
        go = np.searchsorted(-most, -k, side="right")  # rows that have a term for k
        if k:
            chance[:go] *= (c[:go] - k + 1) / k * (s / (1 - s))
        left[:go] += chance[:go] * np.log(k + a[:go])
    out[rows] = left
    return out


class Matched:
    """What the two models share: their sizes, the rate s and the mass of unseen words of each."""

    def __init__(self, vocabulary: int, words: int, target: int, once: int, bins: np.ndarray, sums: np.ndarray):
        self.words, self.target, self.vocabulary = words, target, max(1, vocabulary)
        self.rate = target / words if words else 0.0
        c = sums / np.maximum(bins, 1)
        left = np.exp(np.maximum(c - 1, 0) * np.log1p(-self.rate)) if self.rate < 1 else (c == 1).astype(float)
        self.unseen = [(float((bins * c * self.rate * left).sum()) + 0.5) / (words * self.rate + 1), (once + 0.5) / (target + 1)]

    def losses(self, side: int, pair: np.ndarray, word: np.ndarray, context: np.ndarray, n: np.ndarray) -> np.ndarray:
        """-log p(w | v) from the counts of a pair, its word and its context among n words; side 0: background, 1: target."""
        u, rate = self.unseen[side], 1.0 if side else self.rate
        if not self.target:
            return np.full(len(pair), np.log(self.vocabulary))
        size = self.target if side else self.words * rate
        known = np.log1p(-u) - np.log(np.maximum(n * rate, 1.0))
        p = np.exp(known + mean_log(word, rate, u * size / ((1 - u) * self.vocabulary)))
        return mean_log(context, rate, PRIOR) - mean_log(pair, rate, PRIOR * p)


def _score_block(buckets: int, model: Matched):
    def run(table: pa.Table) -> pa.Table:
        block = _Block(table)
        keys, rows = block.items(), len(block.ids)
        means = [np.zeros(rows), np.zeros(rows)]
        if len(keys):
            answered = {r["bucket"]: r for r in block.answered}
            dealt = _dealt((mix64(keys) % np.uint64(buckets)).astype(np.int64), buckets)
            a, b = len(block.pairs), len(block.pairs) + len(block.words)
            word = np.searchsorted(block.words, block.pairs & _NONE)
            context = np.searchsorted(np.concatenate([[_START], block.words]), block.pairs >> _HALF)
            counts = []
            for side in ("a", "b"):
                c = np.zeros(len(keys), np.int64)
                for bucket, at in dealt:
                    c[at[np.argsort(keys[at])]] = _unpack(answered[bucket][side]).astype(np.int64)
                counts.append(c)
            ends = np.cumsum(block.lengths)
            first = 0
            while first < rows:  # documents of at most about AT_ONCE words, or one
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + AT_ONCE, side="right")))
                some = slice(int(ends[first - 1]) if first else 0, int(ends[last - 1]))
                row, at = block.row[some] - first, block.at[some]
                # Each document's own pairs, words and contexts, and how often it holds them.
                own = lambda x, n: np.unique(row * n + x, return_inverse=True, return_counts=True)  # noqa: B023, E731
                kind, _, times = own(at, a)
                row_of, pair = kind // a, kind % a
                _, w, w_times = own(word[at], b - a)
                _, v, v_times = own(context[at], len(keys))
                of_kind = np.empty(len(kind), np.int64)
                of_kind[np.searchsorted(kind, row * a + at)] = np.arange(len(at))  # a token of each
                target = np.zeros(last - first, bool)
                target[row] = block.target[some]
                for side, c in enumerate(counts):
                    off = target[row_of] if side else np.ones(len(kind), bool)
                    less = lambda n, own: np.maximum(n - own * off, 0)  # noqa: B023, E731
                    n = less(np.full(len(kind), model.target if side else model.words), block.lengths[first:last][row_of])
                    loss = model.losses(side, less(c[pair], times), less(c[a + word[pair]], w_times[w[of_kind]]), less(c[b + context[pair]], v_times[v[of_kind]]), n)
                    means[side][first:last] = np.bincount(row_of, loss * times, last - first)
                first = last
            means = [m / np.maximum(block.lengths, 1) for m in means]
        none = block.lengths == 0
        return pa.table([pa.array(block.ids, pa.int64()), pa.array(block.lengths), *(pa.array(m, pa.float64(), mask=none) for m in (*means, means[0] - means[1]))], ["doc_id", "n_words", "background_loss", "target_loss", "score"])

    return run


def score_exact(documents: DataFrame, target_ids: DataFrame) -> DataFrame:
    """doc_id, n_words, background_loss, target_loss (nats a word) and score of every row of documents.

    ``target_ids`` (doc_id) names the target documents; its nulls and repeats do not count. With no target word both
    models are the vocabulary alone and scores are 0. A text without words (null, empty) has null losses and score. Rows that repeat
    an id count and are scored each, without their own counts. Other columns are ignored; an empty table gives no rows.

    No size is fixed: blocks hold at most about ``BLOCK_BYTES`` of text, buckets about ``BUCKET`` words or pairs, and
    their numbers grow with the corpus.
    """
    spark = documents.sparkSession
    ship(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = cut(texts.mapInArrow(_in_blocks, _BLOCKS))
    sums = blocks.agg(F.sum("n_words").alias("words"), F.sum(F.col("n_tokens") + 2 * F.col("n_words") + 2).alias("items")).collect()[0]
    word_buckets, buckets = (max(12, (n or 0) // BUCKET + 1) for n in (sums.words, sums.items))
    dealt = blocks.select("block", "n_bytes", "words").mapInArrow(_deal_words(word_buckets), "bucket int, block long, a binary, b binary")
    named = cut(dealt.groupBy("bucket").applyInArrow(_number_words(word_buckets), _ANSWER))
    vocabulary = named.agg(F.sum("n")).collect()[0][0] or 0
    # The marks grow with the corpus, so they are joined by shuffles at every size.
    marks = target_ids.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    places = blocks.select("block", F.explode("ids").alias("doc_id")).where("doc_id is not null").distinct()
    marked = cut(places.join(marks.hint("merge"), "doc_id", "left_semi").groupBy("block").agg(F.collect_list("doc_id").alias("ids")))
    nothing = F.lit(None).cast("binary")
    row = lambda kind, bucket, a, b, ids=F.lit(None).cast("array<long>"): ["block", F.lit(kind).alias("kind"), bucket.cast("int").alias("bucket"), a.alias("a"), b.alias("b"), ids.alias("ids")]
    held = blocks.select(*row(0, F.lit(0), F.col("lengths"), F.col("tokens"), F.col("ids")))
    held = held.unionByName(named.select(*row(1, F.col("bucket"), F.col("a"), F.col("b")))).unionByName(marked.select(*row(2, F.lit(0), nothing, nothing, F.col("ids"))))
    items = held.groupBy("block").applyInArrow(_deal_items(buckets), "bucket int, block long, keys binary, n binary, target binary")
    counted = cut(items.groupBy("bucket").applyInArrow(_count_items, "block long, bucket int, a binary, b binary, stats array<long>"))
    sums = np.zeros(3 + 2 * BINS, np.int64)
    for r in counted.where("stats is not null").select(F.posexplode("stats")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        sums[r.pos] = r.n
    model = Matched(vocabulary, *map(int, sums[:3]), sums[3 : 3 + BINS], sums[3 + BINS :])
    held = held.unionByName(counted.select(*row(3, F.col("bucket"), F.col("a"), F.col("b"))))
    return held.groupBy("block").applyInArrow(_score_block(buckets, model), SCHEMA)
