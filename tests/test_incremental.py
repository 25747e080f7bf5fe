"""States of files add up to a run over all of them, and old files stay closed."""

import os
from datetime import date
from pathlib import Path

import pytest

import plumbline as pl
from plumbline.plans.incremental import CheckStore, incremental_run
from tests.conftest import rows

SCHEMA = "id int, age string, value double, city string"
CONFIG = pl.RunConfig(
    "t", ("id",), {"age": "integer", "value": "numeric"},
    (pl.Rule("positive", "value", "positive"), pl.Rule("cities", "city", "allowed_values", allowed_values=("a", "b"))),
)
DAY = date(2026, 1, 1)


def data(start, n):
    return [
        (i % 40, None if i % 6 == 0 else ("x" if i % 11 == 0 else str(i)), float("nan") if i % 9 == 0 else i - 20.0, "abc"[i % 3])
        for i in range(start, start + n)
    ]


def add(spark, folder, start, n):
    before = set(Path(folder).glob("*.parquet"))
    spark.createDataFrame(data(start, n), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return (set(Path(folder).glob("*.parquet")) - before).pop()


def agrees(spark, found, folder, config=CONFIG):
    df = spark.read.schema(SCHEMA).parquet(str(folder))
    single = pl.run_checks(df, config, reference_date=DAY)
    for name in ("counts", "missing", "missing_summary", "types", "type_summary", "rules", "rule_summary",
                 "facts", "score_components", "score", "score_recommendations"):
        if getattr(single, name) is not None:
            assert rows(found.tables[name]) == rows(getattr(single, name)), name
    columns = [c for c in found.tables["duplicates"].columns if c != "key_columns"]
    assert rows(found.tables["duplicates"], *columns) == rows(single.duplicates, *columns)


@pytest.fixture
def places(tmp_path):
    return tmp_path / "in", str(tmp_path / "store")


def run(spark, places, config=CONFIG, **options):
    folder, store = places
    return incremental_run(spark, str(folder), store, config, reference_date=DAY, **options)


def test_old_files_stay_closed(spark, places):
    folder, _ = places
    old = add(spark, folder, 0, 30)
    schema = spark.read.parquet(str(folder)).schema
    first = run(spark, places)
    assert (first.files_read, first.files_known) == (1, 0)
    agrees(spark, first, folder)
    whole, when = old.read_bytes(), os.stat(old)
    add(spark, folder, 30, 50)
    add(spark, folder, 80, 5)
    old.write_bytes(b"?" * len(whole))  # would fail if it were opened
    os.utime(old, ns=(when.st_atime_ns, when.st_mtime_ns))
    second = run(spark, places, schema=schema, files_at_a_time=1)
    assert (second.files_read, second.files_known) == (2, 1)
    old.write_bytes(whole)
    agrees(spark, second, folder)


def test_changed_and_removed_files(spark, places):
    folder, store = places
    for start in (0, 20, 40):
        last = add(spark, folder, start, 20)
    run(spark, places)
    bytes_of_another = add(spark, folder, 500, 37)
    os.replace(bytes_of_another, last)
    for file in (bytes_of_another, last):
        (folder / f".{file.name}.crc").unlink()
    changed = run(spark, places)
    assert (changed.files_read, changed.files_known) == (1, 2)
    agrees(spark, changed, folder)
    last.unlink()
    removed = run(spark, places)
    assert (removed.files_read, removed.files_known) == (0, 2)
    agrees(spark, removed, folder)
    checks = CheckStore(spark, str(folder), store, CONFIG, reference_date=DAY)
    assert checks.forget_unused() == 1 and checks.forget_unused() == 0
    agrees(spark, run(spark, places), folder)


def test_batches_done_twice_or_by_half(spark, places):
    folder, store = places
    add(spark, folder, 0, 30)
    checks = CheckStore(spark, str(folder), store, CONFIG, reference_date=DAY)
    there = checks.files()
    paths = [r["path"] for r in there.collect()]
    checks._read(there, paths)
    checks._read(there, paths)
    keys = spark.read.schema("file string, hash bigint, other_hash bigint, copies bigint").parquet(f"{checks.store}/keys")
    keys.drop("batch").limit(5).write.parquet(f"{checks.store}/keys/batch=half")  # without states
    found = run(spark, places)
    assert (found.files_read, found.files_known) == (0, 1)
    agrees(spark, found, folder)


def test_another_configuration_starts_anew(spark, places):
    folder, _ = places
    add(spark, folder, 0, 30)
    run(spark, places)
    other = pl.RunConfig("t", None, {"age": "string"})
    found = run(spark, places, other)
    assert found.files_read == 1
    agrees(spark, found, folder, other)
    assert run(spark, places).files_read == 0
    with pytest.raises(ValueError):
        run(spark, places, pl.RunConfig("t", ("no",)))


def test_files_without_rows_and_partitions(spark, tmp_path):
    folder = tmp_path / "in"
    spark.createDataFrame(data(0, 30), SCHEMA).repartition(2).write.partitionBy("city").parquet(str(folder))
    spark.createDataFrame([], "id int, age string, value double").write.parquet(str(folder / "city=a" / "none"))
    schema = spark.createDataFrame([], "id int, age string, value double, city string").schema
    first = incremental_run(spark, str(folder), str(tmp_path / "s"), CONFIG, reference_date=DAY, schema=schema)
    assert first.tables["counts"].first()["row_count"] == 30
    assert rows(first.tables["rules"]) == rows(
        pl.check_rules(spark.createDataFrame(data(0, 30), SCHEMA), CONFIG.business_rules, "t")
    )
    again = incremental_run(spark, str(folder), str(tmp_path / "s"), CONFIG, reference_date=DAY, schema=schema)
    assert again.files_read == 0
