"""Targets, quotas and draws of the mix."""

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from plumbline.llm import mixing
from tests.llm.cases import clashing, collected, rows, sentence, table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def size(text):
    return len(SPACE.findall(text or ""))


def test_targets_fill_to_the_limit():
    assert mixing.targets([]) == []
    assert mixing.targets([0, 0]) == [0.0, 0.0]
    assert mixing.targets([100]) == [150.0]
    assert mixing.targets([10, 1000, 10]) == [20.0, 1490.0, 20.0]
    found = mixing.targets([500, 400, 300, 50, 0, 700])
    assert sum(found) == pytest.approx(1.5 * 1950)
    weights = [3, 1, 2, 3, 1, 2]
    for t, n, w in zip(found, [500, 400, 300, 50, 0, 700], weights, strict=True):
        assert t <= 2 * n
        if t < 2 * n:  # all that aren't at the limit share alike
            assert t / w == pytest.approx(max(x / v for x, v in zip(found, weights, strict=True)))


def test_quotas_are_exact_and_spread():
    quotas = [1000, 3, 0, 250]
    found = mixing.split_quotas(quotas, 7, 1)
    assert found.sum(axis=0).tolist() == quotas and (found >= 0).all()
    assert np.ptp(found.sum(axis=1)) <= 1
    assert np.array_equal(found, mixing.split_quotas(quotas, 7, 1))
    assert found[:, 0].std() < 30
    assert mixing.split_quotas([0, 0], 3, 1).tolist() == [[0, 0]] * 3


def documents(n=300):
    return [(i, sentence(i, 1 + i * 7 % 90), "en", ("a", "b", None, "ä", "B")[i % 5 if i % 7 else 0], i) for i in range(n)]


@pytest.mark.parametrize("block_words", [8, 1024])
def test_draws(spark, block_words):
    data = documents() + rows()
    docs = clashing(table(spark, data), "size", "row", "shard", "pass", "target")
    sizes = mixing.measure(docs)
    plan = mixing.plan_sources(sizes, block_words)
    names = sorted({s for *_, s, _ in data}, key=lambda s: (s is None, s or ""))
    assert [entry["source"] for entry in plan] == names
    draws = mixing.draw(sizes, plan, block_words, shard_blocks=50)
    found = draws.collect()
    # Disjoint: nothing comes twice in a pass; each shard is numbered through; shards are of a size.
    assert max(Counter((r["row"], r["pass"], r["block"]) for r in found).values()) == 1
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r["shard"]].append(r["position"])
    assert all(sorted(p) == list(range(len(p))) for p in by_shard.values())
    lengths = [len(p) for p in by_shard.values()]
    assert len(lengths) == -(-len(found) // 50) and max(lengths) - min(lengths) <= 1
    taken = Counter()
    for r in found:
        taken[r["source"]] += r["taken"]
    for entry in plan:
        assert abs(taken[entry["source"]] - entry["target"]) <= 0.5
    for r in mixing.taken_by_document(sizes, plan, draws).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]
    again = mixing.draw(sizes, plan, block_words, shard_blocks=50)
    assert collected(again) == collected(draws)


def test_taken_covers_every_row(spark):
    docs = table(spark)
    sizes = mixing.measure(docs)
    plan = mixing.plan_sources(sizes)
    found = collected(mixing.taken_by_document(sizes, plan, mixing.draw(sizes, plan)), "doc_id", "size")
    assert found == sorted(((d, size(t)) for d, t, *_ in rows()), key=repr)


def test_mixed_documents(spark):
    data = documents(120) + [(1000 + i if d is None else d + 500, *rest) for i, (d, *rest) in enumerate(rows())]
    docs = clashing(table(spark, data), "row_", "draw_row", "row", "doc")
    found = mixing.mix_documents(docs, block_words=16)
    assert found.columns == docs.columns
    words = Counter()
    whole = {(d, s): t for d, t, _, s, _ in data}
    for r in found.collect():
        words[r["source"]] += size(r["text"])
        assert set(SPACE.findall(r["text"])) <= set(SPACE.findall(whole[r["doc_id"], r["source"]]))
    for entry in mixing.plan_sources(mixing.measure(docs), 16):
        assert abs(words[entry["source"]] - entry["target"]) <= 0.5


def test_nothing(spark):
    sizes = mixing.measure(table(spark, []))
    plan = mixing.plan_sources(sizes)
    assert plan == [] and mixing.draw(sizes, plan).collect() == []
    assert mixing.taken_by_document(sizes, plan, mixing.draw(sizes, plan)).collect() == []
    assert mixing.mix_documents(table(spark, [])).collect() == []
    empty = table(spark, [(1, None, None, None, None), (2, " ", None, "s", None)])
    assert mixing.mix_documents(empty).collect() == []


def test_mix_comes_in_the_order_of_the_deal(spark):
    """Each drawn block is a row, at its place in its shard; shards follow one another."""
    docs = table(spark, [(i, sentence(i, 1 + i * 7 % 90), "en", "ab"[i % 2], i) for i in range(200)])
    sizes = mixing.measure(docs)
    draws = mixing.draw(sizes, mixing.plan_sources(sizes, 16), 16, 50)
    texts = {r["doc_id"]: SPACE.findall(r["text"]) for r in docs.collect()}
    expected = [
        (r["doc_id"], " ".join(texts[r["doc_id"]][16 * r["block"] : 16 * r["block"] + r["taken"]]))
        for r in sorted(draws.collect(), key=lambda r: (r["shard"], r["position"]))
    ]
    found = mixing.mix_documents(docs, block_words=16, shard_blocks=50).collect()
    assert len({r["shard"] for r in draws.select("shard").collect()}) > 1
    # Rows of the tables have numbers of their own, which break no ties here: every id comes once.
    assert [(r["doc_id"], r["text"]) for r in found] == expected
