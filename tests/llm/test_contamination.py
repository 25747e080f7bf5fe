"""Benchmark contamination against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from plumbline.llm import decontaminate
from tests.llm.cases import clashing, rows, sentence, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(text, items, window=13):
    doc, hit, names = words(text), set(), set()
    for name, item in items:
        item = words(item)
        size = min(window, len(item))
        if not size:
            continue
        grams = {tuple(item[i : i + size]) for i in range(len(item) - size + 1)}
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in grams:
                hit.update(range(i, i + size))
                names.add("null" if name is None else str(name))
    return len(doc), len(hit), sorted(names)


ITEMS = [
    (1, sentence(2, 120)[60:400]), (2, "one"), (3, "a b C"), (4, None), (5, "..."), (6, sentence(1, 30)),
    (7, sentence(1, 30)), (None, "b c d"), (10, "東京 日本語"), (11, "line one is"), (12, "é à ü"),
]


@pytest.mark.parametrize("block_words", [decontaminate.BLOCK_WORDS, 40])
def test_hits_equal_brute_force(spark, block_words):
    docs = clashing(table(spark), "doc", "n_words", "hit_spans", "item_id")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    found = decontaminate.judged(decontaminate.find_hits(docs, items, block_words=block_words)).collect()
    assert len(found) == len(rows())
    for r in found:
        n_words, n_hit, names = by_hand(r["doc"]["text"], ITEMS)
        assert (r["n_words"], r["n_hit"], r["hit_items"]) == (n_words, n_hit, names)
        assert r["contaminated"] == (n_hit > 0 and 20 * n_hit >= n_words)
        assert r["doc"]["n_words"] == "other"


def test_automaton_on_few_words():
    """Many overlaps: runs of two words, windows of 4, items shorter than that."""
    generator = random.Random(5)
    for _ in range(300):
        draw = lambda n: " ".join(generator.choice("ab") for _ in range(n))
        items = [(str(i), draw(generator.randrange(0, 9))) for i in range(3)]
        automaton = decontaminate.SuffixAutomaton([(n, decontaminate.words_of(t)) for n, t in items], 4)
        text = draw(generator.randrange(0, 25)) + " c " + draw(6)
        spans, names = automaton.spans(decontaminate.words_of(text))
        n_words, n_hit, expected = by_hand(text, items, 4)
        assert (sum(b - a for a, b in spans), sorted(names)) == (n_hit, expected), (items, text)
        assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


def test_spans_are_cut_and_documents_dropped(spark):
    item = sentence(20, 20)
    data = [
        (1, f"Before, {item.upper()}. After!", "en", "s", 1),
        (2, sentence(21, 2000) + " " + item, "en", "s", 2),
        (3, None, None, None, None),
        (4, "clean text", "en", "s", 4),
    ]
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    docs = clashing(table(spark, data), "contaminated")
    cut = decontaminate.without_spans(decontaminate.find_hits(docs, items))
    texts = {r["i"]: r["cleaned"] for r in cut.select(F.col("doc.doc_id").alias("i"), "cleaned").collect()}
    assert texts == {1: "Before, . After!", 2: sentence(21, 2000) + " ", 3: None, 4: "clean text"}
    left = decontaminate.drop_contaminated(docs, items)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [2, 3, 4]


def test_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    found = decontaminate.judged(decontaminate.find_hits(table(spark), none)).collect()
    assert len(found) == len(rows()) and not any(r["contaminated"] for r in found)
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.find_hits(table(spark, []), items).collect() == []
    assert hashlib.sha256(b"").hexdigest() == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]
