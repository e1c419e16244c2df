"""The language-model query against an unhashed brute force over the full vocabulary."""

from __future__ import annotations

import functools
import math
import random
import os
import zlib
from collections import Counter

import numpy as np
import pytest

from colloquy.llm import lm, queries


def mean_log(c, s, a):
    """The mean of log(k + a) for k binomial, term by term."""
    if s >= 1:
        return math.log(c + a)
    at = lambda k: math.exp(math.lgamma(c + 1) - math.lgamma(k + 1) - math.lgamma(c - k + 1) + k * math.log(s) + (c - k) * math.log1p(-s))
    return sum(at(k) * math.log(k + a) for k in range(c + 1) if abs(k - c * s) < 12 * math.sqrt(c * s) + 20)


def counted(rows):
    pairs, words, contexts = Counter(), Counter(), Counter()
    for _, t in rows:
        w = lm.words_of(t)
        pairs.update(zip([None, *w], w))
        words.update(w)
        contexts.update([None, *w][: len(w)])
    return pairs, words, contexts


def brute_force(rows, targets):
    every, target = counted(rows), counted([r for r in rows if r[0] in targets])
    n, known = [sum(every[1].values()), sum(target[1].values())], len(every[1])
    s = n[1] / n[0]
    once = [sum(c * s * (1 - s) ** (c - 1) for c in every[1].values()), sum(c == 1 for c in target[1].values())]
    unseen = [(once[0] + 0.5) / (n[0] * s + 1), (once[1] + 0.5) / (n[1] + 1)]
    logs = functools.cache(mean_log)
    for i, t in rows:
        w, means, own = lm.words_of(t), [], counted([(i, t)])
        for side, (pairs, words, contexts) in enumerate((every, target)):
            out, rate, u = side == 0 or i in targets, (s, 1)[side], unseen[side]
            size = (n[0] * s, n[1])[side]
            loss = 0.0
            for v, x in zip([None, *w], w):
                c, d, e = pairs[v, x] - out * own[0][v, x], words[x] - out * own[1][x], contexts[v] - out * own[2][v]
                p = (1 - u) / max(1, (n[side] - out * len(w)) * rate) * math.exp(logs(d, rate, u * size / ((1 - u) * known)))
                loss += logs(e, rate, lm.PRIOR) - logs(c, rate, lm.PRIOR * p)
            means.append(loss / len(w) if w else None)
        yield i, len(w), *means


def test_every_word_and_pair_counts_by_itself(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    # More words than the old vocabulary held, and enough pairs for strangers to have met in its buckets.
    texts = [" ".join(f"w{rng.randrange(60_000)}" for _ in range(2500)) for _ in range(50)]
    texts += [None, "", " \t\n ", "Only", "only ONLY", "a\tb  c\n\n d\x1c e　f\x0bg", texts[0], "é" * 300 + " 日本語 🙂" * 20, "the cat " * 4000]
    rows = [*enumerate(texts), (None, "no id at all"), (3, texts[3])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, 1, 0) for i in range(0, 56, 3)] + [(1, 1, 1), (2, 0, 0), (None, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(lm, "BLOCK_BYTES", 100_000)
    monkeypatch.setattr(lm, "AT_ONCE", 10_000)
    monkeypatch.setattr(lm, "BUCKET", 10_000)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in queries.op7_lm_scoring(spark, str(tmp_path)).collect()), key=key)
    want = sorted(brute_force(rows, set(range(0, 56, 3))), key=key)
    assert len(got) == len(want)
    for (i, n, b, t, s), (j, m, c, u) in zip(got, want, strict=True):
        assert (i, n) == (j, m)
        if m:
            assert abs(b - c) < 1e-4 and abs(t - u) < 1e-9 and abs(s - (c - u)) < 1e-4
        else:
            assert b is t is s is None


def test_no_documents(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert lm.score_exact(none, none.select("doc_id")).count() == 0
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [tuple(r) for r in lm.score_exact(one, none.select("doc_id")).collect()] == [(1, 0, None, None, None)]


def test_mean_logs():
    rng = random.Random(3)
    for s in (1e-4, 0.02, 0.3, 0.9, 0.9999, 1.0):
        c = np.array([rng.choice([0, 1, 2, 3, 40, 300, 2000, 40_000]) for _ in range(60)])
        a = np.array([rng.choice([1e-7, 0.01, 1.0, 20.0, 2000.0]) for _ in c])
        for got, n, x in zip(lm.mean_log(c, s, a), c.tolist(), a.tolist(), strict=True):
            assert abs(got - mean_log(n, s, x)) < 1e-4
    assert lm._bin(np.array([1, 2, 64, 65, 10**12])).tolist()[:3] == [0, 1, 63] and (np.diff(lm._bin(np.arange(1, 100_000))) >= 0).all()


def test_scores_say_what_a_document_is_like(spark):
    """Held-out documents of the target's kind lie above 0, others below; a target document gains nothing by being one."""
    rng = random.Random(12)
    plain, odd = [f"w{k}" for k in range(400)], [f"x{k}" for k in range(400)]

    def text(kind):
        common, own = ("the", "of", "and"), (plain, odd)[kind]
        return " ".join(rng.choice(common) if rng.random() < 0.3 else rng.choice(own if rng.random() < 0.8 else plain + odd) for _ in range(120))

    rows = [(i, text(i % 3 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    score = {r.doc_id: r.score for r in lm.score_exact(df, df.where("doc_id % 3 = 1").select("doc_id")).collect()}
    target, like, other = ([score[i] for i in range(300) if i % 3 == k] for k in (1, 2, 0))
    share = lambda x: sum(s > 0 for s in x) / len(x)
    assert share(like) > 0.9 and share(other) < 0.1 and abs(sum(target) / 100 - sum(like) / 100) < 0.1


def test_scores_of_labelled_documents_held_out(spark):
    """Half of the good documents are the target; of the other labelled ones the good lie higher."""
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = {r.doc_id: r.quality == 1 and r.toxic == 0 for r in labels.collect()}
    target = {i for i, good in known.items() if good and zlib.crc32(str(i).encode()) % 2 == 0}
    ids = spark.createDataFrame([(i,) for i in target], "doc_id long")
    score = {r.doc_id: r.score for r in lm.score_exact(docs, ids).collect() if r.score is not None}
    held = [i for i in known if zlib.crc32(str(i).encode()) % 2 == 1 and i in score]
    good, other = ([score[i] for i in held if known[i] == kind] for kind in (True, False))
    auc = sum((x > y) + 0.5 * (x == y) for x in good for y in other) / (len(good) * len(other))
    assert auc > 0.75 and sum(x > 0 for x in good) / len(good) > 1.5 * sum(x > 0 for x in other) / len(other)
