"""The training-data operators against brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from colloquy.llm import ann, bpe, chat, lm, minhash, mixing, quality, rules, suffix, tokenfile
from colloquy.llm.components import connected_components, union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("aeioustrnl") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def odd_texts():
    """Null, empty, blank, very long, repeated, near and exact copies."""
    rng = random.Random(4)
    base = prose(rng, 120)
    near = base.split()
    near[7] = "changed"
    twice = prose(rng, 60)
    return [None, "", "  \n\t ", base, base, " ".join(near), base.upper(), "one two three", "One two three", twice + "\n" + twice, prose(rng, 9000), "x" * 900, "é" * 500 + " 日本語 🙂" * 30, base[:500] + prose(rng, 80), "a\tb  c\n\n d\x1c e　f"]


@pytest.fixture(scope="module")
def docs(spark, odd_texts):
    """With a null id, a repeated row, null sources and a column that clashes with inner names."""
    rows = [(i, t, None, [None, "b", "a"][i % 3], 0) for i, t in enumerate(odd_texts)]
    rows += [rows[3], (None, odd_texts[3], "de", "a", 1)]
    return spark.createDataFrame(rows, DOCS).withColumn("id", F.lit("clash")).withColumn("ids", F.lit(1)).withColumn("size", F.lit(2)).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


# -- near-duplicates ---------------------------------------------------------------------------------------------------


def test_near_duplicates_equal_brute_force(docs, odd_texts):
    got = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    want = minhash.brute_force(list(enumerate(odd_texts)))
    assert {i: got[i].component_id for i in want} == want
    assert got[0].n_shingles == got[1].n_shingles == 0 and got[2].kept and got[None].component_id is None and got[None].kept
    assert want[4] == 3 and want[6] == 3


def test_near_duplicates_of_a_large_family(spark):
    rng = random.Random(1)
    base = prose(rng, 100).split()
    rows = []
    for i in range(260):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 3, 5])):
            words[rng.randrange(100)] = prose(rng, 1)
        rows.append((i, " ".join(words)))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == minhash.brute_force(rows)


def test_strays_are_linked_block_by_block(spark, monkeypatch):
    import pandas as pd

    a, b = np.arange(100), np.arange(4, 104)
    pdf = pd.DataFrame({"stray": [True, False, False], "id": [1, 2, 3], "component": [1, 2, 2], "shingles": [a, b, np.arange(50, 150)]})
    assert minhash._links_between(85)(pdf)[["a", "b"]].to_numpy().tolist() == [[1, 2]]


def test_near_dedup_keeps_one_of_each_group(docs, empty):
    kept = minhash.near_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 3 in ids and not {4, 5, 6} & set(ids) and ids.count(3) == 1 and None in ids
    assert minhash.near_duplicates(empty).count() == 0
    with pytest.raises(ValueError):
        minhash.near_duplicates(docs, 50)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, x, y = (rng.integers(0, 1 << 63, 400, dtype=np.uint64) for _ in range(3))
    a, b = np.concatenate([shared, x[:100]]), np.concatenate([shared, y[:100]])
    s = minhash.signatures(np.concatenate([a, b]), np.repeat([0, 1], 500), 2)
    assert abs((s[0] == s[1]).mean() - 400 / 600) < 0.15 and (s >> np.uint64(48)).max() < minhash.SLOTS


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(25)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long").repartition(5)).collect()}
    want = {k: v for k, v in union_find([x for x in links if x[0] != x[1]]).items()}
    assert got == want


# -- byte-level BPE ----------------------------------------------------------------------------------------------------


def test_bpe_equals_the_library_and_decodes(docs, odd_texts):
    import tiktoken

    v = bpe.vocabulary(BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rows = {r.doc_id: r for r in bpe.round_trip(docs, BPE, public_tokenizers.PATTERN).collect()}
    for i, t in enumerate(odd_texts):
        assert np.frombuffer(rows[i].ids, "<u4").tolist() == library.encode_ordinary(t or ""), i
        assert bytes(rows[i].decoded).decode() == (t or "") and rows[i].n_tokens == len(rows[i].ids) // 4


def test_bpe_of_long_words():
    import tiktoken

    v = bpe.vocabulary(BPE, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["ab" * 700, "a" * 3001, "".join(rng.choice("etaoinsrh") for _ in range(2500)), "".join(chr(rng.choice([32, 10, 9, 97, 0x85, 0xA0, 0x1C, 49, 33, 0x4E00])) for _ in range(1500))]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in v.encode(texts)] == [library.encode_ordinary(t) for t in texts]


def test_bpe_parts_apply_alone(docs, empty):
    e = bpe.encode(docs, BPE, public_tokenizers.PATTERN, ("doc_id", "size"))
    d = bpe.decode(e, BPE, public_tokenizers.PATTERN)
    assert e.columns == ["doc_id", "size", "n_tokens", "ids"] and bytes(d.where("doc_id = 7").first().decoded) == b"one two three"
    assert bpe.encode(empty, BPE, public_tokenizers.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.vocabulary(BPE, public_tokenizers.PATTERN).decode([(99_999).to_bytes(4, "little")])


# -- repeated strings --------------------------------------------------------------------------------------------------


def test_repeated_windows_equal_brute_force():
    rng = random.Random(7)
    for _ in range(25):
        length = rng.choice([16, 20, 33])
        base = ["".join(rng.choice(rng.choice(["ab", "abcdefg ", "a"])) for _ in range(rng.randint(20, 120))) for _ in range(4)]
        segments = [s for s in ("".join(rng.choice(base)[rng.randint(0, 30) :] for _ in range(3)).encode() for _ in range(rng.randint(2, 12))) if len(s) >= length]
        if segments:
            n: dict[bytes, int] = {}
            for s in segments:
                for p in range(len(s) - length + 1):
                    n[s[p : p + length]] = n.get(s[p : p + length], 0) + 1
            want = [[n[s[p : p + length]] > 1 for p in range(len(s) - length + 1)] for s in segments]
            assert [x.tolist() for x in suffix.repeated_windows(segments, length)] == want


@pytest.mark.parametrize("shard", [512, 2])
def test_removal_equals_brute_force(spark, odd_texts, monkeypatch, shard):
    """With two segments a shard, grams of many classes are merged across shards."""
    monkeypatch.setattr(suffix, "SHARD", shard)
    rng = random.Random(8)
    common = prose(rng, 30)
    texts = odd_texts + [prose(rng, rng.randint(1, 40)) + common[rng.randint(0, 20) :] + prose(rng, 30) for _ in range(25)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[3])]
    done = suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("lo", F.lit(5)), 100, 24).collect()
    want = suffix.brute_force([t for _, t in rows], 100)
    key = lambda i: -1 if i is None else i
    got = sorted((key(r.doc_id), r._n_bytes, r._n_removed, r._n_spans, bytes(r._kept)) for r in done)
    assert got == sorted((key(i), *w) for (i, _), w in zip(rows, want, strict=True))


def test_removal_of_nothing(spark, empty):
    assert suffix.remove_repeats(empty).count() == 0
    assert suffix.remove_repeats(spark.createDataFrame([(1, "short"), (2, "short")], "doc_id long, text string")).agg(F.sum("_n_removed")).first()[0] == 0


def test_removal_under_clashing_names(spark):
    rng = random.Random(14)
    passage = prose(rng, 60)
    plain = [(i, prose(rng, 30) + passage * (i % 2) + prose(rng, 30)) for i in range(8)] + [(None, passage), (3, None)]
    odd = spark.createDataFrame(plain, "doc_id long, text string")
    for n in ("_d", "_m", "_mark", "_spans", "mark", "spans", "row", "d", "m", "gram", "cls", "spots", "a.b", "_n_bytes"):
        odd = odd.withColumn(n, F.lit("own"))
    got = suffix.remove_repeats(odd, 100, 24).collect()
    want = suffix.brute_force([t for _, t in plain], 100)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.doc_id, r._n_bytes, r._n_removed, bytes(r._kept), r["a.b"]) for r in got), key=key) == sorted(((i, n, removed, kept, "own") for (i, _), (n, removed, _, kept) in zip(plain, want, strict=True)), key=key)
    assert sum(r._n_removed for r in got) > 4 * len(passage)


# -- mixing ------------------------------------------------------------------------------------------------------------


def test_targets_reshare_what_is_above_the_cap():
    t = mixing.targets([100, 10, 1, 0])
    assert t[2] == 3 and t[3] == 0 and abs(sum(t) - 111) < 1e-9 and t[1] == 30 and t[0] == 78
    assert mixing.targets([]) == [] and mixing.targets([0, 0]) == [0, 0]


def test_splitting_tree_is_exact():
    table = mixing.split(np.array([100, 3, 0, 57]), 7, np.random.default_rng(1))
    assert table.sum(1).tolist() == [100, 3, 0, 57] and table.shape == (4, 7) and table.min() >= 0 and np.ptp(table.sum(0)) <= 2


def test_mix_meets_targets(spark, empty):
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 40)) if i % 50 else None, ["a", "b", None][0 if i % 10 else 1 + i % 20 // 10]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for clash in ("block", "blocks", "rest", "last", "row", "id", "size", "_s", "_mix", "shards", "place", "a.b"):
        df = df.withColumn(clash, F.lit(1))
    a = mixing.draw(df).select("doc_id", "source", "_size", "_source_size", "_target", "_shards").toPandas()
    b = mixing.draw(df.repartition(7)).select("doc_id", "_shards").toPandas()
    assert sorted(zip(a.doc_id, map(tuple, a._shards))) == sorted(zip(b.doc_id, map(tuple, b._shards)))
    a["taken"] = a._size * a._shards.map(len)
    g = a.fillna({"source": "~"}).groupby("source").agg(size=("_size", "sum"), total=("_source_size", "first"), target=("_target", "first"), taken=("taken", "sum"))
    assert (g["size"] == g.total).all() and ((g.taken - g.target).abs() <= 20).all() and (a.taken <= 3 * a._size).all()
    assert list(g.target) == mixing.targets(list(g["size"]))
    assert mixing.mix(df).count() == a._shards.map(len).sum() and mixing.draw(empty).count() == 0


# -- quality rules -----------------------------------------------------------------------------------------------------


def test_quality_measures():
    assert quality.measure(None) == quality.measure("") == (0, 0, 0, 0, 0, 0, 0, 0.0)
    m = quality.measure("a b c x\na b c x\n\n \n# $")
    assert m[:5] == (10, 10, 2, 1, 8) and m[5] == 4
    assert quality.verdict(quality.measure(" ".join(["word"] * 80))) == (True, False)


def test_quality_against_plain_counting(odd_texts):
    for t in odd_texts:
        words = quality._WORD.findall(t or "")
        for n in (3, *quality.LIMITS):
            grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
            inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)} if len(words) < 2000 else None
            if n == 3 and inside is not None:
                assert quality.measure(t)[4] == len(inside)


def test_quality_rows(docs, empty):
    rated = {r.doc_id: r for r in quality.rate(docs).collect()}
    assert rated[3].kept and rated[0].base_failed and not rated[1].kept and rated[9].base_failed
    assert quality.keep_good(docs).columns == docs.columns and quality.rate(empty).count() == 0


# -- chat formatting ---------------------------------------------------------------------------------------------------


def test_chat_round_trip_and_parts():
    for text in ["", "<|end|>\n", "\\<|turn|>\\", "</s>[INST] ok [/INST]<s>", "a\\n\nb", "<|image|>"]:
        for role in ["user", "assistant", None, "a\nb\\"]:
            s, spans, _, _ = chat.format_one(role, [{"type": "text", "text": text}])
            assert chat.parse_one(s) == (role or "", text)
            assert "".join(chat.unescape(s[a : a + n]) for a, n in spans) == (text if role == "assistant" else "")
    parts = [{"type": "text", "text": "see"}, {"type": "image", "ref": "i1", "width": 56, "height": 57}, {"type": "audio", "ref": "a", "seconds": 1.5}, {"type": "document", "ref": "d", "pages": 2}, None]
    s, _, refs, tokens = chat.format_one("user", parts)
    assert "see<|image|><|audio|><|document|>" in s and refs == ["i1", "a", "d"] and tokens == 6 + 38 + 1024
    with pytest.raises(ValueError):
        chat.format_one("user", [{"type": "video"}])


def test_chat_reads_back(spark):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", "a"), (2, 1, None, None), (1, None, "system", "</s>"), (None, 1, "assistant", "x"), (1, 3, "assistant", "c")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("content", F.lit(1))
    back = {r.conv_id: r for r in chat.read_back(chat.format_turns(chat.text_turns(df))).collect()}
    assert back[1].n_turns == 4 and back[1].turns_sha256 == hashlib.sha256(b"system\n</s>\nuser\na\nassistant\nb\nassistant\nc\n").hexdigest()
    assert back[1].loss_chars == 2 and back[1].loss_sha256 == hashlib.sha256(b"bc").hexdigest() and back[2].loss_chars == 0 and back[None].n_turns == 1
    assert chat.read_back(chat.format_turns(chat.text_turns(df.where("false")))).count() == 0


# -- language-model scoring --------------------------------------------------------------------------------------------


def test_lm_scores_favour_the_target(spark, empty):
    rows = [(i, ("the cat sat on the mat " if i < 20 else "buy cheap pills online now ") * 3) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit("own"))
    got = {r.doc_id: r.score for r in lm.score_exact(df, df.where("doc_id < 10").select("doc_id")).collect()}
    assert min(got[i] for i in range(20)) > 0 > max(got[i] for i in range(20, 40))
    assert lm.score_exact(empty, df.select("doc_id")).count() == 0


# -- token files -------------------------------------------------------------------------------------------------------


def test_segments_give_any_token():
    ids = np.random.default_rng(3).choice([0, 255, 256, 50_256, 65_536, 2**31], 3000)
    s = tokenfile.Segment(tokenfile.pack(np.array([5, 9]), np.array([1000, 3000]), ids))
    assert s.all().tolist() == ids.tolist() and [s.token(i) for i in range(0, 3000, 11)] == ids[::11].tolist()
    with pytest.raises(IndexError):
        s.token(3000)
    assert tokenfile.Segment(tokenfile.pack(np.zeros(0), np.zeros(0), np.zeros(0, np.uint32))).all().tolist() == []


def test_token_files_read_back(spark, docs, odd_texts, empty, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenfile.write(docs.where("doc_id is not null"), str(tmp_path / "files"), path)
    got = sorted((r.start, r.doc_id, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in tokenfile.read(spark, str(tmp_path / "files")).collect())
    want, at = [], 0
    for i, t in sorted([*enumerate(odd_texts), (3, odd_texts[3])], key=lambda x: x[0]):
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        want.append((at, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want
    tokenfile.write(empty, str(tmp_path / "none"), path)
    assert tokenfile.read(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="without doc_id"):
        tokenfile.write(docs, str(tmp_path / "bad"), path)


# -- quality classifier ------------------------------------------------------------------------------------------------


def test_classifier_on_held_out_rows(spark):
    rng = random.Random(11)
    rows = [(i, prose(rng, 80) if i % 3 else " ".join(w + "!!" for w in prose(rng, 80).upper().split())) for i in range(600)] + [(900, None), (901, ""), (None, "text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("words", F.lit(1))
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(500)] + [(None, 1), (5, None), (900, 0)], "doc_id long, quality int")
    got = rules.classify(docs, labels).toPandas()
    held = got[got.held_out & (got.doc_id < 500)]
    assert len(held) > 100 and (held.predicted == (held.doc_id % 3 > 0)).mean() > 0.98 and got.score.between(0, 1).all() and len(got) == 603
    assert all(h == (zlib.crc32(str(int(d)).encode()) % 3 == 1) for d, h in zip(got.doc_id.dropna(), got.held_out[got.doc_id.notna()], strict=True))
    plain = rules.classify(docs, labels.where("false")).select("score").distinct().collect()
    assert [r.score for r in plain] == [0.5] and rules.classify(docs.where("false"), labels).count() == 0


# -- nearest neighbours ------------------------------------------------------------------------------------------------


def test_neighbours_and_recall(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((3000, 24)) * rng.uniform(0.5, 2, (3000, 1))
    x[100:140] = x[100]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 24), (3002, [float("nan")] * 24), (3003, [None] * 24), (3004, [1.0]), (None, x[0].tolist())]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1))).toPandas()
    x = x.astype(np.float32).astype(float)
    hits = 0
    for q, part in got.groupby("query_id"):
        part = part.sort_values("rank")
        score = x @ x[q]
        score[q] = -np.inf
        best = np.lexsort((np.arange(3000), -score))[:20]
        hits += len(set(best) & set(part.vec_id))
        assert part["rank"].tolist() == list(range(1, 21)) and np.allclose(part.score, score[part.vec_id]) and (np.diff(part.score) <= 0).all()
    assert got.query_id.nunique() == 150 and hits / 3000 > 0.9
    tied = got[got.query_id == 120].sort_values("rank")
    assert tied.vec_id.tolist() == [i for i in range(100, 140) if i != 120][:20] or len(set(tied.vec_id) - set(range(100, 140))) > 0


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, r.score) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 0.5), (0, 2, 2, 0.5), (0, 3, 20, 0.0), (20, 1, 1, 0.5), (20, 2, 2, 0.5), (20, 3, 0, 0.0)]
    assert ann.nearest(df.where("false")).count() == 0
