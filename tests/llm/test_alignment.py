"""Alignment against a plain merge of each document."""

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import alignment
from plumbline.llm.common import tokenizer_file
from plumbline.llm.queries import queries
from tests.llm.cases import clashing, collected, rows, sentence, table

PATHS = (tokenizer_file("byte_bpe_50k.json"), tokenizer_file("piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum")


@pytest.fixture(scope="module")
def plain():
    """Ids of A and B for one text, by the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PATHS[1])
    alphabet = alignment.byte_alphabet()

    def ids(text):
        if not text:
            return [], []
        whole = (" " + text).encode()
        of_a = a.encode(" " + text, add_special_tokens=False)
        left = [bytes(alphabet[c] for c in t) for t in of_a.tokens]
        numbers = b.encode(text)
        pieces = [b.id_to_piece(i) for i in numbers]
        right = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i, p in zip(numbers, pieces)]
        if b"".join(left) != whole or b"".join(right) != whole:
            return [], []
        return list(zip(of_a.ids, map(len, left))), list(zip(numbers, map(len, right)))

    return ids


def brute(docs, ids):
    """docs: (doc_id, text). Links by comparing byte ranges, groups by common ends."""
    linked, out = [], []
    for _, text in docs:
        spans = []
        for tokens in ids(text):
            at, side = 0, []
            for number, size in tokens:
                side.append((number, at, at + size))
                at += size
            spans.append(side)
        links, j = [], 0
        for x, first, end in spans[0]:
            while j and spans[1][j - 1][2] > first:
                j -= 1
            while j < len(spans[1]) and spans[1][j][1] < end:
                if spans[1][j][2] > first:
                    links.append((x, spans[1][j][0]))
                j += 1
        cuts = sorted({e for *_, e in spans[0]} & {e for *_, e in spans[1]})
        groups, before = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(n) for n, s, e in side if before <= s and e <= cut) for side in spans))
            before = cut
        digest = sha256(";".join(groups).encode()).hexdigest() if groups else ""
        linked.append(links)
        out.append([len(spans[0]), len(spans[1]), len(cuts), len(links), digest])
    counts = Counter(pair for links in linked for pair in links)
    most = Counter()
    for (_, y), n in counts.items():
        most[y] = max(most[y], n)
    return sorted(
        ((name, *own, sum(counts[p] == most[p[1]] for p in links), sum(counts[p] for p in links))
         for (name, _), own, links in zip(docs, out, linked)), key=repr,
    )


EXTRA = [
    "<|endoftext|> and </s> <s> <unk>", "a▁b", "ﬁ ligature", " nbsp", "tab\tnew\n\nline  two   three", "é" * 50,
    "é combining", "🎈🎉 emoji", "\x00\x01", " leading", "trailing ", "日本語", "x" * 3000, "​", "ＦＵＬＬ", "'s 're 123456",
]


@pytest.mark.parametrize("limits", [{}, {"merged_bytes": 500, "unit_bytes": 1500}])
def test_equals_brute_force(spark, plain, limits):
    data = rows() + [(100 + i, t, "en", "s", 0) for i, t in enumerate(EXTRA)] + [(7, sentence(9, 300), None, None, 0)]
    found = alignment.align(clashing(table(spark, data).repartition(3), "unit", "pair", "n", "place"), *PATHS, **limits)
    expected = brute([(r[0], r[1]) for r in data], plain)
    assert collected(found, *COLUMNS) == expected
    assert sum(1 for r in expected if r[1]) > 25 and any(r[1] == 0 and r[0] for r in expected)


def test_empty_tables(spark):
    assert collected(alignment.align(table(spark, []), *PATHS)) == []
    found = alignment.align(table(spark, [(1, None, None, None, 0), (2, "", None, None, 0)]), *PATHS)
    assert collected(found, *COLUMNS) == [(1, 0, 0, 0, 0, "", 0, 0), (2, 0, 0, 0, 0, "", 0, 0)]


def test_query_on_given_table(spark, plain):
    folder = "/root/testdata/sf0.001"
    found = queries()["op11_tokenizer_alignment"](spark, folder)
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    assert collected(found, *COLUMNS) == brute(docs, plain)


def test_ids_are_the_librarys():
    """All kinds of characters in all kinds of places, and random strings, by the vocabulary's own library."""
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(PATHS[0])
    a.encode_special_tokens = True
    mine = alignment.Vocabularies.load(*PATHS).a
    chars = [chr(c) for c in [*range(0x3100), *range(0x3100, 0x110000, 61)] if not 0xD800 <= c < 0xE000]
    texts = [f"a{c}a1{c}1 {c} !{c}!{c}{c} a" for c in chars]
    generator = random.Random(1)
    for alphabet in ("abcd", "aAxz=-_*. \n\t'", "etaoinshrdluéüöß"):
        texts += ["".join(generator.choices(alphabet, k=generator.randrange(1, 50))) for _ in range(3000)]
    texts += ["x" * 200_000, "<|endoftext|>", "ab" * 50_000, " " * 10_000]
    for text, code in zip(texts, a.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert mine.encode_ordinary(text) == code.ids


sizes = st.lists(st.integers(1, 5), min_size=1, max_size=12)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(sizes, sizes), max_size=6))
def test_lockstep_links_what_overlaps(docs):
    pairs = []
    for a, b in docs:
        total = max(sum(a), sum(b))
        pairs.append((a + [total - sum(a)] * (total > sum(a)), b + [total - sum(b)] * (total > sum(b))))
    ends = [np.array([int(e) for d in pairs for e in np.cumsum(d[i])], dtype=np.int64) for i in (0, 1)]
    counts = [np.array([len(d[i]) for d in pairs], dtype=np.int64) for i in (0, 1)]
    merged = alignment.lockstep(ends[0], counts[0], ends[1], counts[1])
    found = set(zip(merged.link_a.tolist(), merged.link_b.tolist()))
    assert len(found) == len(merged.link_a)
    expected, at_a, at_b, cuts = set(), 0, 0, 0
    for a, b in pairs:
        ea, eb = np.cumsum(a), np.cumsum(b)
        expected |= {(at_a + i, at_b + j) for i in range(len(a)) for j in range(len(b))
                     if ea[i] - a[i] < eb[j] and eb[j] - b[j] < ea[i]}
        cuts += len(set(ea.tolist()) & set(eb.tolist()))
        at_a, at_b = at_a + len(a), at_b + len(b)
    assert found == expected and merged.cut_a.sum() == merged.cut_b.sum() == cuts


@settings(max_examples=100, deadline=None)
@given(st.lists(st.dictionaries(st.integers(0, 70000), st.integers(1, 70000), max_size=5), max_size=6))
def test_packing_round_trip(docs):
    lengths = np.array([len(d) for d in docs], dtype=np.int64)
    flat = [sorted(d.items()) for d in docs]
    places, times = (np.array([x[i] for d in flat for x in d], dtype=np.int64) for i in (0, 1))
    back = alignment.unpack(alignment.pack(places, times, lengths), lengths)
    assert back[0].tolist() == places.tolist() and back[1].tolist() == times.tolist()
