"""Hard negatives against plain loops."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import hard_negatives as hn
from tests.llm.cases import clashing, collected

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def whole(vector):
    return [math.floor(256 * x) for x in vector]


def brute(rows, positives=5, negatives=10, low=30, high=90):
    """Each row on its own; an anchor leaves out itself by its place in the list."""
    rows = [r for r in rows if r[1] is not None and r[2] is not None
            and all(x is not None and math.isfinite(x) for x in r[1])]
    out = []
    for at, (anchor, vector, label) in enumerate(rows):
        if anchor is None or anchor % 100:
            continue
        scored = [
            (-sum(x * y for x, y in zip(whole(vector), whole(v))), i is None, i or 0, i, other)
            for place, (i, v, other) in enumerate(rows) if place != at
        ]
        scored.sort(key=lambda r: r[:3])
        for score, _, _, name, _ in [r for r in scored if r[4] == label][:positives]:
            fits = [r for r in scored if r[4] != label and 30 * -score <= 100 * -r[0] <= 90 * -score]
            for rank, (s, _, _, i, _) in enumerate(fits[:negatives], 1):
                out.append((anchor, name, rank, i, -score, -s))
    return sorted(out, key=repr)


def vectors(seed, n, width=6, labels=3):
    g = random.Random(seed)
    return [(i * 10, [float(np.float32(g.gauss(0.3, 1))) for _ in range(width)], g.randrange(labels)) for i in range(n)]


def mined(spark, rows, **options):
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    return collected(hn.mine(df, F.col("vec_id") % 100 == 0, **options))


def test_equals_loops(spark):
    rows = vectors(1, 120)
    found = mined(spark, rows)
    assert found == brute(rows) and len(found) > 100


def test_blocks_and_tasks_change_nothing(spark):
    rows = vectors(2, 150)
    expected = brute(rows)
    assert mined(spark, rows, block_values=12, task_rows=10) == expected
    assert mined(spark, rows, task_rows=1000) == expected


def test_odd_rows(spark):
    rows = vectors(3, 60)
    rows += [
        (100, None, 1), (200, [1.0, None], 1), (300, [1.0, float("nan")], 0), (400, [float("inf")], 0),
        (500, [1.0] * 6, None), (None, [0.7] * 6, 0), (None, [0.7] * 6, 1), (7, [], 0), (700, [], 1),
        (11, [2.0], 1), (13, [1.0] * 9, 2), rows[10], rows[10], rows[0], (0, [0.5] * 6, 1),
    ]
    assert mined(spark, rows) == brute(rows)
    other = clashing(spark.createDataFrame(rows, SCHEMA), "row", "anchor", "key", "score", "block")
    assert collected(hn.mine(other, F.col("vec_id") % 100 == 0)) == brute(rows)


def test_a_third_of_equal_vectors(spark):
    """Ties by id across tasks, and a positive score of 0 that a smaller id ties with."""
    rows = vectors(4, 200)
    rows = [(i, [0.5, 0.5] + [0.0] * 4 if i % 30 == 0 else v, label) for i, v, label in rows]
    rows += [(-5, [0.0] * 6, 1), (100_000, [0.0] * 6, 1), (100_001, [0.0] * 6, 1), (3, [0.0] * 6, 2)]
    assert mined(spark, rows, block_values=60, task_rows=20) == brute(rows)


def test_huge_components(spark):
    rows = [(0, [3e6, 1.0], 0), (1, [2e6, 5.0], 0), (2, [1.5e6, 2.0], 1), (3, [1.5e6, 2.0], 1), (4, [1.0, 1.0], 1)]
    assert mined(spark, rows) == brute(rows)
    beyond = [(0, [3e38, 3e38], 0), (1, [3e38, 3e38], 0), (2, [1e6, 1e6], 1)]
    assert mined(spark, beyond) == []


def test_empty_tables(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []
    assert mined(spark, [(100, [1.0], 0), (2, [0.5], 1)]) == []
    with pytest.raises(ValueError):
        hn.mine(spark.createDataFrame([], SCHEMA), F.lit(True), high=101)


def test_keys_sort_as_bytes():
    g = random.Random(5)
    keys = [(g.randrange(3), g.choice([-(2**63), -5, 0, 7, 2**63 - 1]), g.choice([-9, 0, 2**62]), g.random() < 0.2)
            for _ in range(300)]
    anchor, score, ids, null = (np.array(x) for x in zip(*keys))
    packed = hn.pack_keys(anchor, score, hn.NEGATIVE, ids, null)
    back = list(hn.unpack_keys(pa.array(sorted(packed.to_pylist()))))
    expected = sorted(
        (a, -s, n, 0 if n else i) for a, s, i, n in zip(anchor.tolist(), score.tolist(), ids.tolist(), null.tolist())
    )
    assert [(a, -s, i is None, i or 0) for a, s, _, i in back] == expected
