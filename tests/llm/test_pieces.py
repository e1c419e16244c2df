"""Encoding by remembered parts equals the libraries on whole texts, whatever white space, marks and batches hold."""

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from colloquy.llm import bpe, pieces, tokenfile

BPE, FILES = (public_tokenizers.path(f) for f in ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.json"))
BITS = [" ", "  ", "\n", "\t", "\r", " \n ", "\xa0", "\x85", "\x1c", " ", "　", "​", "\0", ".", ",", "!?", "'s", "don't", "'", "word", "Foo", "bar.", "a.b", "12", "é", "été", "中文", "ﬁ", "<|endoftext|>", "|>", "😀", "ʼn", "x" * 70, "supercalifragilistic"]


def _texts(seed: int, n: int) -> list:
    rng = random.Random(seed)
    return [rng.choice([None, "", None, " "]) if rng.random() < 0.05 else "".join(rng.choice(BITS) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.fixture(scope="module")
def libraries():
    import tiktoken
    from tokenizers import Tokenizer

    ranks = bpe.vocabulary(BPE, public_tokenizers.PATTERN).ranks
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(FILES)


@pytest.mark.parametrize("seed", range(3))
def test_random_texts(libraries, seed):
    ranks, files = libraries
    v = bpe.vocabulary(BPE, public_tokenizers.PATTERN)
    for size, n in ((1, 12), (7, 70), (300, 300)):
        texts = _texts(seed * 10 + size, n)
        for a in range(0, len(texts), size):
            some = texts[a : a + size]
            ids = v.encode(some)
            assert [np.frombuffer(x, "<u4").tolist() for x in ids] == [ranks.encode_ordinary(t or "") for t in some]
            assert [x.decode() for x in v.decode(ids)] == [t or "" for t in some]
            assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.encode_texts(some, FILES)] == [files.encode(t or "", add_special_tokens=False).ids for t in some]


def test_part_that_ends_in_white_space_before_one_that_begins_with_it(libraries):
    texts = ["\n x\ty \n", "word\n\nfoo bar"]
    for order in (texts, texts[::-1]):
        assert [np.frombuffer(x, "<u4").tolist() for x in tokenfile.encode_texts(order, FILES)] == [libraries[1].encode(t, add_special_tokens=False).ids for t in order]


def test_a_full_memory_forgets_and_still_answers():
    memory, asked = pieces.Memory(40), []

    def lengths(new: pa.Array):
        asked.append(len(new))
        n = np.array([len(x) for x in new.to_pylist()], np.int64)
        return np.concatenate([np.full(k, k, np.uint32) for k in n]), n

    rng = random.Random(1)
    for _ in range(60):
        texts = ["".join(rng.choice(["a", "bb", " ccc", " dddd", ". ", "\n" + "e" * 80]) for _ in range(6)) for _ in range(5)]
        ids, n = memory.encode(pa.array([*texts, None]), lengths)
        assert n.tolist() == [len(t) for t in texts] + [0] and len(ids) == n.sum() and len(memory.keys) == len(memory.size) == len(memory.used) <= 40
    assert min(asked) < max(asked)


def test_decoding_in_small_windows(monkeypatch):
    monkeypatch.setattr(bpe, "TOKENS_AT_ONCE", 3)
    v = bpe.vocabulary(BPE, public_tokenizers.PATTERN)
    texts = ["one two three four five", None, "", "été 中文 😀"]
    assert [x.decode() for x in v.decode(v.encode(texts))] == [t or "" for t in texts]
