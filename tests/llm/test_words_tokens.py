import random
import re

import llm_samples as S
import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from cellgrid.llm import tokens, words

PATH = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
ALPHABET = [" ", "  ", "\n", "\t", "a", "the", "é", "1", "23", "'s", "'", " ", "　", "!", "<|endoftext|>", "\x1c", "​", "日本", "\r\n", "😀", " ", "X"]


@pytest.mark.parametrize("separators,lower,pattern", [("space", False, rb"[^\x20\x09-\x0D]+"), ("alnum", True, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")])
def test_words_equal_regular_expression(separators, lower, pattern, monkeypatch):
    monkeypatch.setattr(words, "BLOCK", 64)  # many blocks
    texts = [t for _, t in S.nasty_texts() if t is None or len(t) < 5000]
    found = words.find_words(pa.array(texts), words.Lexer(separators, lower))
    expected = []
    for d, t in enumerate(texts):
        raw = (t or "").encode()
        folded = bytes(c + 32 if lower and 65 <= c <= 90 else c for c in raw)
        expected += [(d, m.start(), m.end(), m[0]) for m in re.finditer(pattern, folded)]
    base = np.concatenate([[0], np.cumsum([len((t or "").encode()) for t in texts])])
    assert [(d, s - base[d], e - base[d]) for d, s, e in zip(found.doc, found.start, found.end)] == [x[:3] for x in expected]
    kinds = {}
    for h, x in zip(found.hash.tolist(), expected):
        assert kinds.setdefault(x[3], h) == h
    assert len(set(kinds.values())) == len(kinds)


def test_gram_hashes_follow_content():
    h = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    g = words.gram_hashes(h, 3)
    assert g[0] == g[3] and len(set(g.tolist())) == 4
    assert len(words.gram_hashes(h, 8)) == 0


@pytest.fixture(scope="module")
def encoder():
    return tokens.Encoder(PATH)


def _same(encoder, texts):
    ids, bounds = encoder.encode(pa.array(texts, pa.string()))
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == encoder.tokenizer.encode(t or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.one_of(st.none(), st.lists(st.sampled_from(ALPHABET), max_size=12).map("".join), st.text(max_size=12)), max_size=6))
def test_ids_equal_the_tokenizer(texts):
    _same(_shared(), texts)


def _shared(cache=[]):  # noqa: B006
    if not cache:
        cache.append(tokens.Encoder(PATH))
    return cache[0]


def test_ids_do_not_depend_on_memory_or_cuts(encoder, monkeypatch):
    rng = random.Random(3)
    texts = ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(900))) for _ in range(12)]
    monkeypatch.setattr(tokens, "_CUT", 64)
    monkeypatch.setattr(encoder, "remember", 40)
    _same(encoder, texts)
    _same(encoder, [t for _, t in S.nasty_texts() if t is None or len(t) < 5000])


def test_added_tokens_have_their_own_ids(encoder, monkeypatch):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(PATH)
    texts = ["one <|endoftext|> two", "<|endoftext|>", "a<|endoftext|><|endoftext|>b", "<|endof", "text|> <|endoftext", "|>", None, "no token", "x y <|endoftext|> z " * 40]
    for cut in (tokens._CUT, 64):
        monkeypatch.setattr(tokens, "_CUT", cut)
        ids, bounds = encoder.encode(pa.array(texts, pa.string()))
        for i, t in enumerate(texts):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == plain.encode(t or "", add_special_tokens=False).ids
    assert plain.encode(texts[0], add_special_tokens=False).ids == [505, 220, 50256, 734]
