"""Token files: round trips of the packing, and ids against the library on whole texts."""

import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import tokens
from plumbline.llm.common import tokenizer_file
from plumbline.plans.storage import scratch_path
from tests.llm.cases import clashing, rows, sentence, table


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1) | st.integers(0, 70_000) | st.just(0), max_size=400))
def test_packing_round_trip(ids):
    given_ids = np.array(ids, dtype=np.uint64)
    words, _ = tokens.encode(given_ids)
    assert np.array_equal(tokens.decode(words), given_ids)


def test_blocks_can_be_read_alone():
    generator = np.random.default_rng(1)
    ids = generator.integers(0, 50_000, 30_000).astype(np.uint64)
    ids[generator.integers(0, 30_000, 900)] = 2**63 + 5  # escapes, also across ends of blocks
    words, starts = tokens.encode(ids)
    raw, places = words.astype("<u8").tobytes(), starts.astype("<i8").tobytes()
    assert len(starts) == -(-len(words) // tokens.BLOCK)
    for first, end in ((0, 1), (0, 30_000), (12_345, 12_400), (29_999, 30_000), (5, 5000), (7, 7)):
        assert np.array_equal(tokens.read_ids(raw, places, first, end), ids[first:end])


def test_packing_is_dense():
    assert len(tokens.encode(np.ones(600, dtype=np.uint64))[0]) == 10
    assert len(tokens.encode(np.full(400, 40_000, dtype=np.uint64))[0]) == -(-400 // 3)


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_file())


def test_words_encode_as_whole_texts_do(library):
    """Also where lower-casing, composing, contractions or special tokens reach across signs."""
    generator = random.Random(2)
    signs = "aZé ÉH̱̀'sdlvt,.!?<|endoftext|> …İΣςß9½\n\t\x0b\x1c中-_'  Ḱ"
    texts = ["".join(generator.choice(signs) for _ in range(generator.randrange(80))) for _ in range(2000)]
    texts += ["don't I'LL we'Re <|endoftext|> <|ENDOFTEXT|> H̱ ẖ a., b.. c,. é, 1, 'S", sentence(1, 500)]
    found = tokens.WordTokenizer(tokenizer_file()).encode_batch([t.encode() for t in texts])
    for text, ids in zip(texts, found, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(tokens, "REMEMBERED", 50)
    tokenizer = tokens.WordTokenizer(tokenizer_file())
    tokenizer.known.clear()
    for seed in range(20):
        text = sentence(seed, 60)
        (ids,) = tokenizer.encode_batch([text.encode()])
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(tokenizer.known) <= 50


def expected(data, library):
    ids = {}
    for _, text, *_ in data:
        ids[text or ""] = [*library.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]
    return ids


def test_files(spark, library):
    data = rows() + [(100 + i, sentence(i, 40 + i), "en", "s", 1) for i in range(60)]
    docs = clashing(table(spark, data), "part", "segment", "tie", "words")
    path = scratch_path(spark, "tokens")
    tokens.write_tokens(docs, tokenizer_file(), path, segment_ids=500, parts=5)
    files = tokens.open_tokens(spark, path)
    found = tokens.documents_of(files, ids=True).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == sorted(
        (d for d, *_ in data), key=lambda d: -1 if d is None else d
    )
    ids = expected(data, library)
    texts = {}
    for d, t, *_ in data:
        texts.setdefault(d, []).append(t or "")
    start = 0
    for r in found:
        assert r["start"] == start
        assert r["ids"] in [ids[t] for t in texts[r["doc_id"]]]
        assert r["n_tokens"] == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        start += r["n_tokens"]
    assert files.count() > 5
    assert tokens.documents_of(files).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_nothing(spark):
    assert tokens.encode_documents(table(spark, []), tokenizer_file()).collect() == []
