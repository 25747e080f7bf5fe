import random
from collections import Counter

import pytest
from conftest import one, plan_of, rows

from plumbline import check_duplicates, duplicate_rows, largest_duplicate_groups


def test_no_duplicates(spark):
    df = spark.createDataFrame([("oak", 3.5), ("oak", 4.0), ("elm", 3.5)], "tree string, height double")
    found = one(check_duplicates(df))
    assert (found.status, found.scope, found.duplicate_row_count, found.severity) == ("passed", "full_row", 0, "ok")
    assert found.key_columns == ["tree", "height"]


def test_full_rows_and_keys(spark):
    trees = [("ash", 7, "n"), ("ash", 9, "n"), ("ash", 7, "n"), ("yew", 2, "s"), ("fir", 5, "e"), ("yew", 2, "w"), ("ash", 7, "n"), ("box", 1, "s")]
    df = spark.createDataFrame(trees, "tree string, height int, side string")
    full = one(check_duplicates(df))
    assert (full.duplicate_row_count, full.duplicate_group_count, full.duplicate_percentage) == (3, 1, 37.5)
    assert (full.status, full.severity) == ("failed", "high")
    keyed = one(check_duplicates(df, ["tree"]))
    assert (keyed.scope, keyed.duplicate_row_count, keyed.duplicate_group_count) == ("key_columns", 6, 2)
    assert rows(largest_duplicate_groups(df, ["tree"]), "group_rank", "duplicate_key", "duplicate_count") == [
        (1, {"tree": "ash"}, 4), (2, {"tree": "yew"}, 2),
    ]
    assert rows(duplicate_rows(df), "tree", "duplicate_count") == [("ash", 3)] * 3


def test_building_a_check_starts_no_job(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a")], "x int, y string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("building", "nothing should run")
    try:
        plan = plan_of(check_duplicates(df))
        largest_duplicate_groups(df)
        duplicate_rows(df)
        assert list(tracker.getJobIdsForGroup("building")) == []
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert "LeftSemi" in plan and "row_hash" in plan


def test_empty_key_list_means_whole_rows(spark):
    df = spark.createDataFrame([(1,), (1,)], "id int")
    assert one(check_duplicates(df, [])).scope == "full_row"


def test_composite_key(spark):
    df = spark.createDataFrame([("x", 1, 0), ("y", 1, 0), ("x", 2, 8), ("y", 1, 9), ("y", 1, 7), ("x", 2, 8)], "shelf string, slot int, n int")
    found = one(check_duplicates(df, ["shelf", "slot"]))
    assert (found.duplicate_row_count, found.duplicate_group_count) == (5, 2)


@pytest.mark.parametrize("columns", [["x"], ["x", "y"]])
def test_nulls_nan_and_zeros_are_equal_to_themselves(spark, columns):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1), (nan, 1), (0.0, 2), (-0.0, 2), (3.0, 3)], "x double, y int")
    assert one(check_duplicates(df, columns)).duplicate_row_count == 4
    assert one(check_duplicates(df)).duplicate_row_count == 4
    assert duplicate_rows(df, columns).count() == 4


def test_null_positions_matter(spark):
    df = spark.createDataFrame([(None, 1), (1, None), (None, 1)], "a int, b int")
    found = one(check_duplicates(df))
    assert (found.duplicate_row_count, found.duplicate_group_count) == (2, 1)


def test_group_limit_and_order(spark):
    df = spark.createDataFrame([(i // (i % 4 + 1),) for i in range(200)], "k int")
    top = largest_duplicate_groups(df, ["k"], max_groups=3).collect()
    counts = Counter(i // (i % 4 + 1) for i in range(200))
    expected = sorted(((-n, k) for k, n in counts.items() if n > 1))[:3]
    assert [(-r.duplicate_count, int(r.duplicate_key["k"])) for r in top] == expected
    assert [r.group_rank for r in top] == [1, 2, 3]
    assert largest_duplicate_groups(df, ["k"], max_groups=0).count() == 0
    with pytest.raises(ValueError):
        largest_duplicate_groups(df, ["k"], max_groups=-1)


def test_missing_key_values_are_marked(spark):
    df = spark.createDataFrame([(None, 1), (None, 2)], "k string, v int")
    assert one(largest_duplicate_groups(df, ["k"])).duplicate_key == {"k": "<missing>"}


def test_key_names_are_matched_exactly(spark):
    df = spark.createDataFrame([(1,)], "id int")
    for key in (["ID"], ["nope"]):
        with pytest.raises(ValueError):
            check_duplicates(df, key)
    with pytest.raises(ValueError):
        check_duplicates(df, ["id"], warning_threshold=6, high_threshold=5)


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string")
    for key in (None, ["a"]):
        found = one(check_duplicates(df, key))
        assert (found.status, found.row_count, found.duplicate_percentage) == ("passed", 0, 0.0)
    bare = spark.createDataFrame([(1,), (1,)], "a int").select()
    assert one(check_duplicates(bare)).status == "passed"
    assert largest_duplicate_groups(bare).count() == 0


def test_against_counting_with_a_hot_row(spark):
    """Whole rows, a third of them one and the same."""
    random.seed(3)
    data = [(1, "hot", None)] * 700
    data += [(random.randrange(900), random.choice("abc"), random.choice([None, 1.5, 2.5])) for _ in range(1400)]
    df = spark.createDataFrame(data, "a int, b string, c double").repartition(5)
    counts = Counter(data)
    repeated = {k: n for k, n in counts.items() if n > 1}
    found = one(check_duplicates(df))
    assert found.row_count == len(data)
    assert found.duplicate_row_count == sum(repeated.values())
    assert found.duplicate_group_count == len(repeated)
    assert one(largest_duplicate_groups(df, max_groups=1)).duplicate_count == max(counts.values())
    members = Counter(tuple(r)[:3] for r in duplicate_rows(df).collect())
    assert members == Counter(repeated)


def test_maps_and_arrays(spark):
    df = spark.sql("SELECT map('a', 1, 'b', 2) AS m, array(1) AS a, 1 AS i UNION ALL SELECT map('b', 2, 'a', 1), array(1), 1")
    assert one(check_duplicates(df)).duplicate_row_count == 2


def test_only_keys_are_read_and_counts_are_combined_before_the_shuffle(spark, tmp_path):
    spark.range(10).selectExpr("id AS k", "id AS v", "id AS w").write.parquet(str(tmp_path / "t"))
    plan = plan_of(check_duplicates(spark.read.parquet(str(tmp_path / "t")), ["k"]))
    assert "ReadSchema: struct<k:bigint>" in plan
    assert plan.count("hashpartitioning") == 1
    assert plan.rindex("partial_count(1)") > plan.index("hashpartitioning")
