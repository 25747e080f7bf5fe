"""Exact, line, substring and near deduplication against brute force."""

import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import exact_dedup, line_dedup, near_dedup, substring_dedup
from plumbline.llm.common import run_hashes
from tests.llm.cases import SCHEMA, clashing, collected, rows, sentence, table

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def test_exact_dedup_keeps_one_row_of_each_text(spark):
    docs = clashing(table(spark), "digest", "row", "kept", "keep_id", "group_size")
    found = exact_dedup.append_new(exact_dedup.open_index(spark, buckets=3), docs).collect()
    groups = defaultdict(list)
    for doc_id, text, *_ in rows():
        groups[hashlib.sha256((text or "").encode()).digest()].append(doc_id)
    assert len(found) == len(rows())
    for digest, ids in groups.items():
        mine = [r for r in found if bytes(r["digest"]) == digest]
        largest = max((i for i in ids if i is not None), default=None)
        assert sorted(r["doc_id"] or -1 for r in mine) == sorted(i or -1 for i in ids)
        assert {(r["keep_id"], r["group_size"]) for r in mine} == {(largest, len(ids))}
        assert [r["doc_id"] for r in mine if r["kept"]] == [largest]


def test_batches_keep_the_same_rows_by_way_of_the_index(spark):
    docs = table(spark)
    columns = ("doc_id", "keep_id", "group_size", "kept", "digest")
    whole = exact_dedup.append_new(exact_dedup.open_index(spark, buckets=3), docs)
    index = exact_dedup.open_index(spark, buckets=3)
    parts = exact_dedup.append_new(index, docs, batches=4)
    assert collected(parts, *columns) == collected(whole, *columns)
    assert index.read().count() == len({text or "" for _, text, *_ in rows()})


def test_what_the_index_holds_decides(spark):
    data = [(i, f"text {i % 5}") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string")
    index = exact_dedup.open_index(spark, buckets=2)
    planted = spark.createDataFrame([("text 3", 1000)], "text string, keep_id bigint")
    planted.select(F.unhex(F.sha2("text", 256)).alias("digest"), "keep_id").write.insertInto(index.table)
    found = collected(exact_dedup.append_new(index, docs, batches=4), "doc_id", "keep_id", "group_size", "kept")
    last = {0: 35, 1: 36, 2: 37, 3: 1000, 4: 39}
    assert found == sorted(((i, last[i % 5], 8, i == last[i % 5]) for i, _ in data), key=repr)


def test_buckets_of_an_index_are_kept(spark):
    index = exact_dedup.open_index(spark, buckets=2)
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id bigint, text string")
    exact_dedup.append_new(index, docs).collect()
    with pytest.raises(ValueError):
        exact_dedup.open_index(spark, index.path, 3)
    index.forget()
    again = exact_dedup.open_index(spark, index.path)
    assert again.buckets == 2
    found = collected(exact_dedup.append_new(again, docs), "doc_id", "kept")
    assert found == [(1, False), (2, False)]


def test_index_persists_and_grows(spark):
    first = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a")], "doc_id bigint, text string")
    second = spark.createDataFrame([(9, "a"), (8, "c"), (7, "c")], "doc_id bigint, text string")
    index = exact_dedup.open_index(spark, buckets=2)
    exact_dedup.append_new(index, first).collect()
    again = exact_dedup.open_index(spark, index.path, 2)
    found = collected(exact_dedup.append_new(again, second), "doc_id", "keep_id", "group_size", "kept")
    assert found == [(7, 8, 2, False), (8, 8, 2, True), (9, 3, 1, False)]
    assert sorted(r["keep_id"] for r in index.read().collect()) == [2, 3, 8]
    plan = index.read().join(index.read().hint("merge"), "digest", "left_anti")
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_index_of_nothing(spark):
    index = exact_dedup.open_index(spark, buckets=2)
    assert exact_dedup.append_new(index, table(spark, [])).collect() == []
    assert index.read().count() == 0


def lines_by_hand(data, min_chars=10):
    holders = defaultdict(list)

    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in k)

    order = [float("inf") if d is None else d for d, *_ in data]
    for at, (_, text, *_) in zip(order, data, strict=True):
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(at)
    out = []
    for at, (doc_id, text, *_) in zip(order, data, strict=True):
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders[key(x)]) < 2 or min(holders[key(x)]) == at]
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup_equals_brute_force(spark):
    extra = [(100 + i, f"a common header line\n{sentence(i, 8)}\n A Common Header Line", "en", "s", 1) for i in range(40)]
    data = rows() + extra
    docs = clashing(table(spark, data), "at", "lost", "high", "shard")
    found = line_dedup.without_repeats(docs, shards=5)
    assert collected(found, "doc_id", "n_lines", "n_dropped", "kept") == lines_by_hand(data)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.without_repeats(table(spark, [])).collect() == []


def test_probing_equals_the_common_way(spark, monkeypatch):
    data = rows() + [(200 + i, "shared by many documents", "en", "s", 1) for i in range(30)]
    monkeypatch.setattr(line_dedup, "HOT_SHARE", 2.0)  # nothing is common: all keys go to the shards
    found = line_dedup.without_repeats(table(spark, data), shards=3)
    assert collected(found, "doc_id", "n_lines", "n_dropped", "kept") == lines_by_hand(data)


@pytest.mark.parametrize("n", [0, 1, 7, 20_000])
def test_perfect_hash_is_minimal(n):
    generator = np.random.default_rng(n)
    high, low = (generator.integers(0, 2**63, n, dtype=np.uint64) for _ in range(2))
    found = line_dedup.PerfectHash.build(high, low)
    assert sorted(found.index(high, low).tolist()) == list(range(n))
    assert found.bits.size * 8 <= 2.2 * 3.2 * n + 64


def test_perfect_hash_refuses_repeated_keys():
    same = np.ones(2, dtype=np.uint64)
    with pytest.raises(ValueError, match="distinct"):
        line_dedup.PerfectHash.build(same, same)


def passages_by_hand(data, window):
    """Rows that repeat id and text are one document; null ids come last."""
    order = {}
    for doc_id, text, *_ in data:
        order[(float("inf") if doc_id is None else doc_id, text or "")] = SPACE.findall(text or "")
    first = {}
    for (at, text), words in order.items():
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (float("inf"), float("inf"))), (at, i))
    out = []
    for doc_id, text, *_ in data:
        at = float("inf") if doc_id is None else doc_id
        words = SPACE.findall(text or "")
        gone = set()
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (at, i):
                gone.update(range(i, i + window))
        out.append((doc_id, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("bits", [substring_dedup.SKETCH_BITS - 6, 8])
def test_substring_dedup_equals_brute_force(spark, monkeypatch, bits):
    """Also with a sketch that is full, and with portions of few words."""
    monkeypatch.setattr(substring_dedup, "WORDS", 3000)
    passage = sentence(9, 60)
    data = rows() + [
        (300, passage + " " + sentence(10, 30) + " " + passage, "en", "s", 1),
        (299, sentence(11, 25) + " " + passage, "en", "s", 1),
        (301, "again " * 70, "en", "s", 1),
        (302, sentence(12, 5) + " again" * 25, "en", "s", 1),
        (303, passage[: len(passage) // 2], "en", "s", 1),
    ]
    docs = clashing(table(spark, data), "at", "tag", "starts", "first")
    found = substring_dedup.without_repeats(docs, bits=bits)
    assert collected(found, "doc_id", "n_words", "n_removed", "kept") == passages_by_hand(data, 20)


def test_substring_dedup_of_nothing(spark):
    assert substring_dedup.without_repeats(table(spark, []), bits=10).collect() == []


def test_run_hashes_tell_runs_apart():
    words = np.random.default_rng(0).integers(0, 4, 3000, dtype=np.uint64)
    for width in (1, 2, 5, 10, 13, 20):
        found = run_hashes(words, width)
        by_run = {tuple(words[i : i + width].tolist()): found[i] for i in range(len(found))}
        assert len(found) == len(words) - width + 1
        assert len(set(by_run.values())) == len(by_run)
        assert all(by_run[tuple(words[i : i + width].tolist())] == found[i] for i in range(len(found)))
    assert len(run_hashes(words[:4], 5)) == 0


def classes_by_hand(data, similarity=0.8):
    def shingles(text):
        text = text or ""
        words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        if len(words) < 5:
            return frozenset([("few", *words)] if words else [("none", text)])
        return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))

    sets = [shingles(text) for _, text, *_ in data]
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(data)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both >= similarity * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    members = defaultdict(list)
    for i, (doc_id, *_) in enumerate(data):
        members[find(i)].append(doc_id)
    out = []
    for ids in members.values():
        least = min((i for i in ids if i is not None), default=None)
        out += [(i, least, len(ids)) for i in ids]
    return sorted(out, key=repr)


def near_data():
    """Chains of copies with a few words changed, and one large group."""
    out = rows()
    for group in range(6):
        words = sentence(50 + group, 90).split()
        for i in range(4 if group else 60):
            changed = list(words)
            changed[(7 * i + 3) % 90] = f"new{i}"
            if group % 2:  # each a little further from the first
                words = changed
            out.append((1000 + 100 * group + i, " ".join(changed), "en", "s", 1))
    return out


@pytest.mark.parametrize("small", [near_dedup.SMALL, 1])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, small):
    """Also with every bucket made narrower, so that only pivots are compared."""
    monkeypatch.setattr(near_dedup, "SMALL", small)
    data = near_data()
    docs = clashing(table(spark, data), "node", "row", "bands", "label")
    found = near_dedup.near_duplicates(docs)
    assert collected(found, "doc_id", "class_id", "class_size") == classes_by_hand(data)
    kept = found.filter("kept").select("class_id").collect()
    assert len(kept) == len({c for c in kept}) or found.filter("kept AND class_id IS NULL").count() <= 1


def test_first_of_classes_keeps_rows_as_they_are(spark):
    data = near_data()
    docs = clashing(table(spark, data), "row_", "node")
    found = near_dedup.first_of_classes(docs)
    assert found.columns == docs.columns
    expected = {c for _, c, _ in classes_by_hand(data)}
    assert sorted(r["doc_id"] for r in found.collect()) == sorted(expected)
    texts = {d: t for d, t, *_ in data}
    assert all(r["text"] == texts[r["doc_id"]] and r["row_"] == "other" for r in found.collect())


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_signatures_estimate_probability_jaccard():
    """Agreement of registers against the sum over runs of 1 / sum of max(x_j / x_i, y_j / y_i)."""
    generator = np.random.default_rng(4)
    run = generator.integers(0, 2**63, 60, dtype=np.uint64)
    x, y = generator.integers(0, 6, 60).astype(float), generator.integers(0, 6, 60).astype(float)
    exact = 0.0
    for i in range(60):
        if x[i] and y[i]:
            exact += 1 / np.maximum(x / x[i], y / y[i]).sum()
    registers = 4096
    runs = np.concatenate([run[x > 0], run[y > 0]])
    weights = np.concatenate([x[x > 0], y[y > 0]])
    doc = np.concatenate([np.zeros((x > 0).sum(), int), np.ones((y > 0).sum(), int)])
    a, b = near_dedup.signatures(runs, weights, doc, 2, registers)
    assert abs((a == b).mean() - exact) < 0.03
    c, d = near_dedup.signatures(runs, 3 * weights, doc, 2, registers)
    assert (a == c).mean() > 0.99 or abs((c == d).mean() - exact) < 0.03


def test_components_of_a_long_chain(spark):
    links = spark.range(40).select(
        F.lpad(F.col("id").cast("string"), 3, "0").cast("binary").alias("a"),
        F.lpad((F.col("id") + 1 + F.when(F.col("id") == 19, 50).otherwise(0)).cast("string"), 3, "0")
        .cast("binary").alias("b"),
    )
    found = near_dedup.components(links).collect()
    labels = {bytes(r["node"]).decode(): bytes(r["label"]).decode() for r in found}
    assert labels["019"] == labels["070"] == "000"
    assert {labels[f"{i:03d}"] for i in range(20, 41)} == {"020"}


def test_repeated_lines_do_not_hide_a_link(spark):
    """A line once and 40 times, or not at all: the sets are alike, the counts are not."""
    data = []
    for i in range(12):
        body, line = sentence(500 + 2 * i, 304), sentence(501 + 2 * i, 9)
        texts = [body + " " + line, " ".join([body, *[line] * 40]), body]
        data += [(3 * i + j, text, "en", "s", 0) for j, text in enumerate(texts)]
    found = near_dedup.near_duplicates(table(spark, data))
    expected = [(3 * i + j, 3 * i, 3) for i in range(12) for j in range(3)]
    assert collected(found, "doc_id", "class_id", "class_size") == sorted(expected, key=repr)


def hot_family(members=2000, outsiders=60):
    """Variants of one text that are alike, and others that are alike to one of them only each."""
    generator = np.random.default_rng(11)
    template = sentence(900, 300).split()

    def variant(words, places, mark):
        words = list(words)
        for place in places:
            words[place] = f"{mark}x{place}"
        return words

    data, own = [], []
    for i in range(members):
        # Two changes in the first half: 10 runs of 296 differ, any two are 0.87 alike or more.
        own.append(variant(template, generator.choice(140, 2, replace=False), f"m{i}"))
        data.append((i, " ".join(own[-1]), "en", "s", 0))
    for k in range(outsiders):
        # A member rewritten in five changes that no other has; it is 0.81 to 0.88 alike to that one only.
        m = int(generator.integers(0, members))
        data.append((members + k, " ".join(variant(own[m], range(155 + k % 5, 290, 25), f"o{k}")), "en", "s", 0))
    return data


def classes_by_matrix(data, similarity=0.8):
    """As by hand, for many documents of few runs."""
    numbers = {}
    rows_, cols = [], []
    for i, (_, text, *_) in enumerate(data):
        words = text.split()
        for run in {tuple(words[j : j + 5]) for j in range(len(words) - 4)}:
            rows_.append(i)
            cols.append(numbers.setdefault(run, len(numbers)))
    size = np.bincount(rows_)
    times = np.bincount(cols)
    keep = times[cols] > 1
    used = np.unique(np.array(cols)[keep], return_inverse=True)[1]
    holds = np.zeros((len(data), used.max() + 1), dtype=np.float32)
    holds[np.array(rows_)[keep], used] = 1
    both = holds @ holds.T
    linked = both >= similarity * (size[:, None] + size[None] - both) - 1e-6
    label = np.arange(len(data))
    while True:
        nearer = np.array([label[row].min() for row in linked])
        if (nearer == label).all():
            break
        label = nearer
    return linked, sorted(
        ((data[i][0], data[label[i]][0], int((label == label[i]).sum())) for i in range(len(data))), key=repr
    )


def test_a_link_to_one_node_of_a_hot_bucket(spark):
    """Each outsider is linked to one member only, of thousands that share its buckets."""
    data = hot_family()
    linked, expected = classes_by_matrix(data)
    assert (linked[2000:].sum(axis=1) == 2).all()
    found = near_dedup.near_duplicates(table(spark, data))
    assert collected(found, "doc_id", "class_id", "class_size") == expected


def test_small_buckets_give_all_pairs(spark):
    """Three nodes that meet in one bucket of four registers and in none of eight: all pairs come."""
    names = [bytes([i]) * 16 for i in range(3)]
    nodes = spark.createDataFrame(
        [(name, 10, 10, [7, *[100 * i + j for j in range(1, 32)]], bytes(128)) for i, name in enumerate(names)],
        "node binary, n bigint, common bigint, bands array<bigint>, registers binary",
    )
    labels = spark.createDataFrame([], "node binary, label binary")
    runs = spark.createDataFrame([(name, list(range(10))) for name in names], "node binary, runs array<bigint>")
    links, pairs = near_dedup._rest_pairs(nodes, labels, runs, 0.8)
    found = links.collect() + pairs.collect()
    assert sorted((bytes(r["a"]), bytes(r["b"])) for r in found) == [
        (names[0], names[1]), (names[0], names[2]), (names[1], names[2]),
    ]
