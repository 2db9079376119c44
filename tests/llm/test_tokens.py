"""Token counts, byte BPE and packing against the libraries and brute force."""

import collections
import hashlib
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tissuegrid.llm import byte_bpe, packing, token_counts, wordcache
from tissuegrid.llm.queries import BYTE_BPE, WORD_BPE
from tissuegrid.llm.wordcache import WordCache, load

ODD = [
    "", "   ", "\x1c\x1d a\u0085b​", "a" * 3000, " " * 2000, "日本語　漢字", "İstanbul ΑΣ x",
    "<|endoftext|> x<|startoftext|>", "é ́x ﬁ ½²", "tab\tand\r\nnl\n\n\n  x", "\U0001f642\U0001f469‍\U0001f469 emoji",
    "▁x ▁▁", "Don't we'Re it'S''s ª ß ẞ ×"]


@pytest.fixture(scope="module")
def library():
    return load(WORD_BPE)


@pytest.fixture(scope="module")
def words():
    return WordCache(WORD_BPE)


@settings(max_examples=150, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"], max_codepoint=0x3000), max_size=60))
def test_word_cache_equals_library(text):
    cache = _cache()
    ids = np.frombuffer(b"".join(cache.encode([text])[0]), dtype="<u4").tolist()
    assert ids == cache.tokenizer.encode(text, add_special_tokens=False).ids


def _cache(made=[]):
    if not made:
        made.append(WordCache(WORD_BPE))
    return made[0]


def test_word_cache_on_odd_texts(words, library):
    for text, got in zip(ODD, words.encode(ODD)):
        assert np.frombuffer(b"".join(got), dtype="<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_words_of_a_column_are_looked_up_once(library):
    cache, asked = WordCache(WORD_BPE), []
    values = cache.words.values
    cache.words.values = lambda keys, compute: asked.append(keys) or values(keys, compute)
    texts = ["skipped", *["the same words the same\nwords, again"] * 50, *ODD, None, "again Ⱥx Ʌ's ÀÉ' ǅ_²¼"]
    column = pa.array(texts)[1:]
    for _ in range(2):
        ids, bounds = cache.encode_column(column)
        for text, a, b in zip(texts[1:], bounds[:-1], bounds[1:]):
            assert ids[a:b].tolist() == library.encode(text or "", add_special_tokens=False).ids
    assert len(asked) == 2 and all(len(keys) == len(set(keys)) for keys in asked)


def test_forgotten_words_are_encoded_again(monkeypatch, library):
    monkeypatch.setattr(wordcache, "REMEMBERED", 3)
    cache = WordCache(WORD_BPE)
    for text in ["a b c d e", "e f g h", "a e i", "x" * 60, "a b", "x" * 60 + " e"]:
        assert np.frombuffer(b"".join(cache.encode([text])[0]), dtype="<u4").tolist() == library.encode(
            text, add_special_tokens=False).ids


def test_counts_of_whole_and_spliced_texts(documents, library):
    rng = random.Random(5)
    long = " ".join("".join(rng.choices("abcde,.<|>", k=rng.randint(1, 30))) for _ in range(400))
    texts = [*ODD, None, long, "x" * 700 + " " + "y" * 900 + " tail", "z" * 5000, long]
    docs = documents(*((i if i != 3 else None, t) for i, t in enumerate(texts)))
    got = token_counts.count_tokens(docs, WORD_BPE, window=300, overlap=20).collect()
    want = sorted((len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for t in texts)
    assert sorted((r.n_bytes, r.n_tokens) for r in got) == want
    assert sum(r.doc_id is None for r in got) == 1


def test_vocabularies_that_join_across_spaces_get_whole_texts(documents):
    path = os.path.join(os.path.dirname(WORD_BPE), "byte_bpe_50k.json")
    exact = load(path)
    texts = ["some words,  with   wide gaps\n\nand lines", " lead", "plain words here " * 40, "", None]
    want = [len(exact.encode(t or "", add_special_tokens=False).ids) for t in texts]
    got = token_counts.count_tokens(documents(*enumerate(texts)), path, window=50, overlap=10).collect()
    assert [r.n_tokens for r in sorted(got)] == want
    assert [sum(map(len, ids)) // 4 for ids in WordCache(path).encode(texts)] == want


def test_counts_of_an_empty_table(documents):
    assert token_counts.count_tokens(documents(), WORD_BPE).count() == 0


def test_byte_bpe_equals_tiktoken(documents):
    import tiktoken

    pattern = public_tokenizers.PATTERN
    encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(BYTE_BPE), special_tokens={})
    docs = documents(*enumerate([*ODD, None, ODD[0]]))
    for row in byte_bpe.encode_decode(docs, BYTE_BPE, pattern).collect():
        text = [*ODD, None, ODD[0]][row.doc_id] or ""
        ids = encoding.encode_ordinary(text)
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.asarray(ids, dtype="<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_every_token_is_reached_by_its_merges():
    bpe = byte_bpe.ByteBpe.get(BYTE_BPE, public_tokenizers.PATTERN)
    some = random.Random(2).sample(sorted(bpe.ranks), 2000)
    assert all(bpe.model.encode(t.decode("latin-1").translate(bpe.table)) == [bpe.ranks[t]] for t in some)


def _best_fit(lengths, capacity):
    bins = []
    for length in sorted(lengths, reverse=True):
        open_ = [(r, i) for i, r in enumerate(bins) if r >= length]
        if open_:
            bins[min(open_)[1]] -= length
        else:
            bins.append(capacity - length)
    return sorted(bins)


@settings(max_examples=200, deadline=None)
@given(st.sampled_from([1, 7, 16, 50]).flatmap(lambda c: st.tuples(st.just(c), st.lists(st.integers(1, c), max_size=80))))
def test_plan_is_best_fit_decreasing(case):
    capacity, lengths = case
    fill = collections.defaultdict(list)
    for length, _, count, first, offset in packing.plan(dict(collections.Counter(lengths)), capacity).tolist():
        for i in range(count):
            fill[first + i].append((offset, length))
    left = []
    for placed in fill.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        left.append(capacity - at)
    assert sorted(left) == _best_fit(lengths, capacity)


def test_packing_of_documents(documents, library):
    rng = random.Random(3)
    texts = [*ODD, None, *(" ".join(rng.choices(["alpha", "beta", "g"], k=rng.randint(0, 90))) for _ in range(60))]
    texts += [texts[20]] * 30
    rows = packing.pack(documents(*((i if i else None, t) for i, t in enumerate(texts))), WORD_BPE, capacity=64).collect()
    sequences = collections.defaultdict(list)
    for r in rows:
        ids = np.asarray([*library.encode(texts[r.doc_id or 0] or "", add_special_tokens=False).ids, 0], dtype="<u4")
        assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes()) and r.start == 64 * r.piece
        sequences[r.sequence_id].append((r.offset, r.length))
    for placed in sequences.values():
        placed.sort()
        assert placed[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(placed, placed[1:]))
        assert sum(n for _, n in placed) <= 64
    lengths = [n for placed in sequences.values() for _, n in placed]
    assert len(sequences) == len(_best_fit(lengths, 64))
    assert len(rows) == sum(-(-(len(library.encode(t or "", add_special_tokens=False).ids) + 1) // 64) for t in texts)


def test_packing_of_an_empty_table(documents):
    assert packing.pack(documents(), WORD_BPE).count() == 0
