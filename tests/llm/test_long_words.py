"""Words of any length in the byte-level BPE operator, against the library and against plain merging."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from colloquy.llm import bpe, queries

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(BPE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


def letters(rng, n, alphabet="abcdefghijklmnopqrstuvwxyz"):
    return "".join(rng.choices(alphabet, k=n))


def ids(raw: bytes) -> list[int]:
    return np.frombuffer(raw, "<u4").tolist()


def test_long_words_equal_the_library(vocabulary, library):
    rng = random.Random(5)
    texts = ["a" * 1_000_000, "x" + "a" * 300_001 + "y", letters(rng, 100_000), letters(rng, 20_000, "ab"), "abc" * 50_000, "-" * 90_001 + "=", " " * 50_000 + "x", "日本語" * 20_000, letters(rng, 33) * 2000]
    texts += [letters(rng, rng.randrange(60, 400), rng.choice(["ab", "aeinrst", "théü", "日本語", "abcdefghijklmnopqrstuvwxyz"])) for _ in range(400)]
    texts.append(" ".join(letters(rng, rng.choice([3, 64, 65, 200])) for _ in range(500)))
    began = time.time()
    got = vocabulary.encode(texts)
    assert time.time() - began < 120
    assert [ids(g) for g in got] == [library.encode_ordinary(t) for t in texts]


def test_words_beyond_the_packed_positions(vocabulary, library):
    rng = random.Random(6)
    for word in (letters(rng, bpe.WIDE + 300), "xab" * 700, "a" * 2500):
        assert vocabulary._merge_wide(word.encode()).tolist() == library.encode_ordinary(word)


def plain(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
        if best is None:
            return [ranks[p] for p in parts]
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


@pytest.mark.parametrize("seed", range(6))
def test_windows_whatever_the_ranks(tmp_path, seed):
    """Vocabularies whose ranks no training would give: a token may rank before its parts, and borders move far."""
    rng = random.Random(seed)
    tokens = {bytes([b]) for b in range(256)}
    pieces = [b"a", b"b", b"c"]
    for _ in range(40):
        pieces.append(rng.choice(pieces) + rng.choice(pieces))
    tokens = [*sorted(tokens), *sorted({p for p in pieces if len(p) > 1})]
    order = list(range(len(tokens)))
    rng.shuffle(order)
    ranks = dict(zip(tokens, order, strict=True))
    path = tmp_path / "ranks"
    path.write_text("".join(f"{base64.b64encode(t).decode()} {r}\n" for t, r in ranks.items()))
    v = bpe.Vocabulary(str(path), public_tokenizers.PATTERN)
    words = [letters(rng, rng.randrange(65, 300), rng.choice(["a", "ab", "abc"])).encode() for _ in range(60)]
    words += [letters(rng, k).encode() * 40 for k in range(1, 12)] + [b"c" + letters(rng, k, "ab").encode() * 60 for k in range(1, 6)]
    words = list(dict.fromkeys(w for w in words if len(w) > bpe.LONG))
    assert [x.tolist() for x in v._encode_long(words)] == [plain(w, ranks) for w in words]


def test_the_query_over_long_words(spark, tmp_path, library):
    rng = random.Random(7)
    rows = [(0, "a" * 1_000_000), (1, letters(rng, 50_000)), (2, "short words " + letters(rng, 500)), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in queries.op2_bpe_encode_decode(spark, str(tmp_path)).collect()}
    import hashlib

    for i, t in rows:
        want = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(want) and got[i].ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
