"""Vector codes, URL filters and ranked search against brute force written without numpy, automata or Spark."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import ahocorasick
import numpy as np
import pytest
from pyspark.ml.feature import HashingTF
from pyspark.sql import functions as F

from colloquy.llm import codes, lexical, urls

VECTORS = "vec_id long, embedding array<float>, label int"


# -- vector codes ------------------------------------------------------------------------------------------------------


def bounds(d):
    return [p * (d // 16) + min(p, d % 16) for p in range(17)]


def coded(rows, entries=64):
    """(vec_id, code, error, label_error, digest) of rows (vec_id, list of float or None, label), in plain integers."""
    kept = [(i, [math.floor(Fraction(x) * 256) for x in v], y) for i, v, y in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    length = max(Counter(len(v) for _, v, _ in kept).items(), key=lambda x: (x[1], x[0]))[0]
    kept = [r for r in kept if len(r[1]) == length]
    first = {}
    for i, v, _ in sorted((r for r in kept if r[0] is not None), key=lambda r: r[:2]):
        first.setdefault(i, v)
    at = bounds(length)
    books = [[v[at[p] : at[p + 1]] for v in list(first.values())[:entries]] for p in range(16)]

    def near(v):
        out = []
        for p in range(16):
            x = v[at[p] : at[p + 1]]
            out.append(min((sum((a - b) ** 2 for a, b in zip(x, c)), e) for e, c in enumerate(books[p])))
        return out

    for _ in range(2):
        held = defaultdict(list)
        for _, v, _ in kept:
            for p, (_, e) in enumerate(near(v)):
                held[p, e].append(v[at[p] : at[p + 1]])
        for (p, e), some in held.items():
            books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    digest = hashlib.sha256(",".join(str(c) for p in books for e in p for c in e).encode()).hexdigest()
    found = [(i, "".join(f"{e:02x}" for _, e in near(v)), sum(f for f, _ in near(v)), y) for i, v, y in kept]
    labels = defaultdict(int)
    for _, _, far, y in found:
        labels[y] += far
    return [(i, c, far, labels[y], digest) for i, c, far, y in found]


def by_code(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("d", [32, 35, 5])
def test_codes_equal_plain_integers(spark, d):
    rng = random.Random(d)
    grain = lambda: np.float32(rng.choice([rng.gauss(0, 1), rng.randrange(-3, 4) / 256, -0.0])).item()
    rows = [(i, [grain() for _ in range(d)], rng.choice([None, 1, 1, 2])) for i in range(150)]
    rows += [(3, rows[3][1], 1), rows[70], (5, [0.0] * d, None), (None, rows[9][1], 2), (151, None, 1), (152, [None] * d, 1), (153, [float("nan")] * d, 1), (154, [float("-inf")] * d, 2), (-4, rows[1][1], 1), (200, [1.0] * (d + 1), 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, VECTORS).withColumn("x", F.lit("clash")).withColumn("code", F.lit(1)).repartition(5)
    assert by_code(codes.compress(df).collect()) == by_code(coded(rows))


def test_codes_of_few_repeated_and_no_vectors(spark):
    rows = [(7, [0.5] * 16, None)] * 90 + [(9, [0.25] * 16, 1), (8, [-0.25] * 16, 1)]
    assert by_code(codes.compress(spark.createDataFrame(rows, VECTORS)).collect()) == by_code(coded(rows))
    none = codes.compress(spark.createDataFrame([(1, None, 2)], VECTORS))
    assert none.count() == 0 and none.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    empty = codes.compress(spark.createDataFrame([(1, [], 2), (None, [], 2)], VECTORS)).collect()
    assert {(r.code, r.error, r.label_error) for r in empty} == {("00" * 16, 0, 0)} and len(empty) == 2
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([(1, [1e30] * 16, 2)], VECTORS))


def test_products_of_limbs_are_exact():
    rng = np.random.default_rng(2)
    for most in (3, 2**20, 2**27, 2**29):
        x, c = rng.integers(-most, most + 1, (2, 50, 7)), rng.integers(-most, most + 1, (2, 9, 7))
        want = [[[sum(int(a) * int(b) for a, b in zip(r, s)) for s in c[p]] for r in x[p]] for p in range(2)]
        assert codes.dot(x, c).tolist() == want
    assert (codes.dot(np.full((1, 1, 4), -(2**28)), np.full((1, 1, 4), 2**28)) == -(2**58)).all()
    near, far = codes.assign(np.array([[[1, 1], [5, 5]]]), np.array([[[0, 0], [2, 2], [0, 0]]]))
    assert near.tolist() == [[0, 1]] and far.tolist() == [[2, 18]]


# -- URL filters -------------------------------------------------------------------------------------------------------

ODD = [None, "", "no scheme", "https://", "://x", "HTTP://EXAMPLE.Org", "http://a.b.EXAMPLE.org/es/1?q#f", "http://example.org/es", "http://notexample.org/es/", "x://example.org:80/en/1", "http://org/", "http://org?x/", "http://ÀB.com/fr/é//://y", "http://com/de/#a", "a://b://c.com/de/", "http://x.com#/de/", "http://u@h.com/de/?", "http://\n.com/de/\n?", "http://🙂.net/🙂" * 3]


def split(url):
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def ruled(host, path, rules=urls.RULES):
    fit = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit, default=(0, None, None))[1:]


def grams(host, path):
    out = set()
    for mark, text in (("h", host), ("p", path)):
        text = f"^{text}$"
        out |= {mark + text[i : i + n] for n in (3, 4, 5) for i in range(len(text) - n + 1)}
    return out


def test_urls_equal_a_plain_reading(spark):
    rng = random.Random(6)
    some = ODD + ["http://" + "".join(rng.choice("ab./?#:") for _ in range(12)) + ".example.org/es/" for _ in range(40)]
    some += [rng.choice(["http://{}.example.org{}", "https://{}.com{}", "ftp://{}.net{}"]).format(rng.choice(["www.casino", "garden"]), rng.choice(["/es/", "/en/1", "/en/12/", "/fr/", "/de", "/de/x?y", ""])) for _ in range(60)]
    rows = [*enumerate(some), (None, some[7]), (3, some[3])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("_grams", F.lit(1))
    got = sorted((tuple(r) for r in urls.judge(df).collect()), key=repr)
    model = urls.fit(urls.labelled_urls(spark))
    features, regression = model.stages
    weights, place = regression.coefficients.toArray(), HashingTF(numFeatures=urls.FEATURES).indexOf
    assert features.getNumFeatures() == urls.FEATURES
    want = []
    for i, url in rows:
        host, path = split(url)
        verdict, rule = ruled(host, path)
        score = regression.intercept + sum(weights[k] for k in {place(g) for g in grams(host, path)})
        assert abs(score) > 1e-9
        want.append((i, host, path, rule, verdict or ("block" if score > 0 else "allow")))
    assert got == sorted(want, key=repr)


def test_the_longest_rule_wins(spark):
    rules = [("allow", "a.B", "/x"), ("block", "b", "/x/y"), ("block", "a.b", "/x"), ("allow", "c", ""), ("block", "c", "/longer")]
    df = spark.createDataFrame([(0, "h://z.a.b/x/y"), (1, "h://a.b/xx"), (2, "h://c"), (3, "h://d.c/longer"), (4, "h://cc/")], "page_id long, url string")
    got = {r.page_id: (r.rule, r.verdict) for r in urls.judge(df, rules=rules).collect()}
    assert got[0] == ("a.b/x", "block")  # as long as b/x/y, with the longer host
    assert got[1] == ("a.b/x", "block") and got[2] == ("c", "allow") and got[3] == ("c/longer", "block") and got[4][0] is None


def test_url_model_on_hosts_it_has_not_seen(spark):
    bad = ["big-casino-online", "pills-direct", "adult-friends", "bets4you", "spam-network", "trackers-and-ads"]
    good = ["mountain-rescue", "bookshop", "schooling", "thatched", "orchard", "motherland"]
    rows = [(k * 100 + j, f"https://{h}.example.net/en/{7 * j}") for k, h in enumerate(bad + good) for j in range(20)]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    hit = [(r.verdict == "block") == (r.page_id < 600) for r in got]
    assert sum(hit) / len(hit) > 0.9


def test_urls_that_are_very_long_or_none(spark):
    long = [(1, "http://" + "a." * 300_000 + "com/de/" + "é" * 300_000), (2, "x" * 1_000_000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(long, "page_id long, url string")).collect()}
    assert got[1].rule == "com/de/" and len(got[1].path) == 300_004 and got[2].host == ""
    empty = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(empty).count() == 0
    one = spark.createDataFrame([("http://a/", 1), (None, None)], "url string, label int")
    df = spark.createDataFrame([(1, "http://b.net/"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(df, one).collect()} == {"block"}
    assert {r.verdict for r in urls.judge(df, one.where("false"), rules=[]).collect()} == {"allow"}
    from pyspark.errors import PySparkException

    with pytest.raises((ValueError, PySparkException)):
        urls.fit(spark.range(urls.MOST_LABELLED + 1).select(F.lit("u").alias("url"), F.lit(1).alias("label")))


# -- ranked search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def ranked(docs, items):
    read = [(i, terms(t)) for i, t in docs]
    n, every = sum(bool(t) for _, t in read), sum(len(t) for _, t in read)
    df = Counter(w for _, t in read for w in set(t))
    asked = defaultdict(set)
    for i, t in items:
        asked[i] |= set(terms(t))
    out = []
    for item, some in asked.items():
        scores = []
        for i, t in read:
            tf, score = Counter(t), 0
            for w in some & set(t):
                m = 100 - 90 + (90 * len(t) * n) // every
                score += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 8 * m))
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:10], 1)]
    return sorted(out, key=repr)


def corpus(rng, n):
    word = lambda: rng.choice(["the", "The", "on", "in", "it's", "é", "Éa", "x1", "1", "ab-cd", "日本語", "a_b", "İ"] + [f"w{rng.randrange(60)}" for _ in range(8)])
    docs = [(i, rng.choice([" ", "\n", ", ", "  "]).join(word() for _ in range(rng.randrange(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " .,\x00\x7f"), (None, "the null id"), docs[4], docs[4], (5, "the same id, another text"), (n + 3, "the on w3 " * 60_000), (n + 4, "the" * 100_000)]
    items = [(k, " ".join(word() for _ in range(rng.randrange(1, 30)))) for k in range(12)] + [(50, None), (51, ""), (52, "nowhere"), (None, "null w1"), (3, "w5 w6"), (3, "w7 w5")]
    return docs, items


@pytest.mark.parametrize("most", [4096, 4])
def test_search_equals_brute_force(spark, monkeypatch, most):
    docs, items = corpus(random.Random(most), 120)
    monkeypatch.setattr(lexical, "ITEMS", most)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("item_id", F.lit(1)).repartition(6)
    q = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit(0))
    assert sorted((tuple(r) for r in lexical.search(d, q).collect()), key=repr) == ranked(docs, items)


def test_search_of_nothing(spark):
    docs, items = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert [tuple(r)[:3] for r in lexical.search(docs, items).collect()] == [(1, 1, 1)]
    assert lexical.search(docs.where("false"), items).count() == lexical.search(docs, items.where("false")).count() == 0


def test_occurrences_in_windows(monkeypatch):
    monkeypatch.setattr(lexical, "MATCHES", 7)
    rng = random.Random(1)
    docs, items = corpus(rng, 40)
    texts = [t for _, t in docs]
    known = sorted({w.encode() for _, t in items for w in terms(t)})
    machine = ahocorasick.Automaton()
    for k, w in enumerate(known):
        machine.add_word(f" {w.decode('latin-1')} ", k)
    machine.make_automaton()
    n, row, term, tf = lexical.count(machine, len(known), texts[:40])
    assert n.tolist() == [len(terms(t)) for t in texts[:40]]
    want = {(i, known.index(w.encode())): c for i, t in enumerate(texts[:40]) for w, c in Counter(terms(t)).items() if w.encode() in known}
    assert dict(zip(zip(row.tolist(), term.tolist()), tf.tolist())) == want
