"""JSON by path against a walk in Python."""

import json
from collections import Counter, defaultdict

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from plumbline import json_paths

TEXTS = [
    '{"a": 1, "b": [1, "x", null, {"c": true}], "d": {}}',
    '{"a": "one", "b": [], "odd name": {"x.y": 2.5}}',
    '{"a": null}',
    "[[1, [2, 3]], [], {}]",
    '"[text] with {brackets}"',
    "17",
    "null",
    "{broken",
    '{"a": 1}}',
    '{"a": 1} x',
    "1, 2",
    "1],[2",
    "[1,]",
    ' {"a": [0] } ',
    '{"twice": 1, "twice": 2}',
    "",
    None,
    '{"s": "a \\" quote [ and { more", "deep": {"e": {"f": {"g": [0]}}}}',
]


def walked(texts):
    found = defaultdict(Counter)

    def walk(path, value):
        kind = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null"}
        found[path]["node"] += 1
        found[path][kind.get(type(value), "number")] += 1
        if isinstance(value, dict):
            for name, inner in value.items():
                plain = all(c.isalnum() or c in "_-" for c in name) and name
                walk(f"{path}.{name}" if plain else f'{path}."{name}"', inner)
        if isinstance(value, list):
            for inner in value:
                walk(path + "[]", inner)

    def once(pairs):
        if len(dict(pairs)) < len(pairs):
            raise ValueError
        return dict(pairs)

    for text in texts:
        if text is None:
            found["$"]["missing"] += 1
            continue
        try:
            walk("$", json.loads(text, object_pairs_hook=once))
        except ValueError:
            found["$"]["invalid"] += 1
    return {path: +counts for path, counts in found.items()}


def profiled(df):
    rows = [row.asDict() for row in df.collect()]
    return {
        row.pop("path"): Counter({k.removesuffix("_count"): n for k, n in row.items() if n}) for row in rows
    }


def test_paths_equal_a_walk(spark):
    df = spark.createDataFrame([(t, 1) for t in TEXTS * 3], "`a.b` string, x int").repartition(3)
    assert profiled(json_paths(df, "a.b")) == walked(TEXTS * 3)


def test_variants_and_nested_columns(spark):
    # Texts with something behind the value are left out: the parser that makes the variants takes them.
    texts = [t for t in TEXTS if t is None or "invalid" not in walked([t])["$"]]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    as_variant = json_paths(df.select(F.parse_json("t").alias("v")), "v")
    assert profiled(as_variant) == walked(texts)
    nested = spark.createDataFrame(
        [([1, None, 3], {"k": "x"}), (None, {})], "l array<int>, m map<string,string>"
    )
    assert profiled(json_paths(nested, "l")) == {
        "$": Counter(node=1, array=1, missing=1), "$[]": Counter(node=3, number=2, null=1)
    }
    assert profiled(json_paths(nested, "m")) == {
        "$": Counter(node=2, object=2), "$.k": Counter(node=1, string=1)
    }


def test_no_rows_no_values_and_wrong_columns(spark):
    empty = spark.createDataFrame([], "t string, n int")
    assert json_paths(empty, "t").collect() == []
    nothing = spark.createDataFrame([(None, 1)], "t string, n int")
    assert profiled(json_paths(nothing, "t")) == {"$": Counter(missing=1)}
    for wrong in ("n", "absent"):
        with pytest.raises(ValueError):
            json_paths(empty, wrong)


def test_long_values_and_deep_ones(spark):
    deep = "[" * 30 + "1" + "]" * 30
    long = json.dumps({"items": [{"id": i, "tag": None} for i in range(20_000)]})
    df = spark.createDataFrame([(deep,), (long,)], "t string")
    assert profiled(json_paths(df, "t")) == walked([deep, long])


def test_one_scan_and_one_exchange(spark, tmp_path):
    spark.createDataFrame([(t, "other") for t in TEXTS], "t string, other string").write.parquet(str(tmp_path / "t"))
    plan = plan_of(json_paths(spark.read.parquet(str(tmp_path / "t")), "t"))
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "Join" not in plan and "ReadSchema: struct<t:string>" in plan
