"""As-of joins against plain loops, whatever the number of parts."""

import random

import pytest

from plumbline.operators.asof import asof_join
from tests.conftest import rows

LEFT, RIGHT = "id int, key string, at int, v int", "at int, key string, v int"


def brute(left, right, by_key=True, how="left"):
    out = []
    for row in left:
        _, key, at, _ = row
        fits = [
            r for r in right
            if r[0] is not None and at is not None and r[0] <= at
            and (not by_key or (key is not None and r[1] == key))
        ]
        best = max(fits, key=lambda r: tuple((x is not None, x) for x in r), default=None)
        if best or how == "left":
            out.append((*row, *(best or (None, None, None))))
    return sorted(out, key=repr)


def tables(seed, n, keys):
    g = random.Random(seed)
    pick = lambda: g.choice(keys)
    left = [(i, pick(), g.choice([None, *range(40)]), i % 5) for i in range(n)]
    right = [(g.choice([None, *range(40)]), pick(), g.choice([None, 1, 2, 3])) for _ in range(n // 2)]
    return left, right


@pytest.mark.parametrize("keys", [["a"], ["a", "a", "a", "b", "c", None], list("abcdefgh")])
@pytest.mark.parametrize("partitions", [1, 7])
def test_equals_loops(spark, keys, partitions):
    left, right = tables(len(keys), 120, keys)
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    for how in ("left", "inner"):
        found = asof_join(a, b, "at", "at", [("key", "key")], how, partitions=partitions)
        assert found.columns == ["id", "key", "at", "v", "at_right", "key_right", "v_right"]
        assert rows(found) == brute(left, right, how=how)


def test_without_keys_and_gaps(spark):
    """One right row long before, so that whole parts have no right row."""
    left = [(i, "k", i, 0) for i in range(100)]
    right = [(5, "k", 1), (90, "k", 2)]
    a, b = spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)
    assert rows(asof_join(a, b, "at", "at", partitions=9)) == brute(left, right, by_key=False)
    assert rows(asof_join(a, b, "at", "at", [("key", "key")], partitions=9)) == brute(left, right)


def test_empty_sides_and_guards(spark):
    a, b = spark.createDataFrame([(1, "k", 1, 1)], LEFT), spark.createDataFrame([], RIGHT)
    assert rows(asof_join(a, b, "at", "at", [("key", "key")])) == [(1, "k", 1, 1, None, None, None)]
    assert asof_join(a.limit(0), b, "at", "at").count() == 0
    for options in ({"how": "outer"}, {"by": [("no", "key")]}, {"suffix": ""}):
        with pytest.raises(ValueError):
            asof_join(a, b, "at", "at", **options)
