"""A stream checked in batches equals the table checked at once."""

import pytest
from pyspark.sql import functions as F

import plumbline as pl
from plumbline.streaming.checks import StreamChecks, check_stream
from tests.conftest import rows

SCHEMA = "id int, age string, `the day` string, status string"
RULES = (
    pl.Rule("age_fits", "age", "range", 0, 120, allow_null=False),
    pl.Rule("status_known", "status", "allowed_values", allowed_values=("on", "off")),
)
CONFIG = pl.RunConfig("s", expected_schema={"the day": "date", "age": "integer"}, business_rules=RULES)


def data(start, n):
    return [
        (i, None if i % 7 == 0 else str(i * 3), "soon" if i % 5 == 0 else "2024-01-02", ("on", "off", "?")[i % 3])
        for i in range(start, start + n)
    ]


@pytest.fixture
def source(spark, tmp_path):
    folder = tmp_path / "in"
    for k in range(4):
        spark.createDataFrame(data(k * 25, 25), SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return str(folder)


def stream(spark, source, files=1):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(source)


def agrees(spark, checks, source):
    table = spark.read.parquet(source)
    found = checks.results()
    assert rows(found["rules"]) == rows(pl.check_rules(table, RULES, "s"))
    assert rows(found["types"]) == rows(pl.check_types(table, CONFIG.expected_schema, "s"))
    assert rows(found["missing"]) == rows(pl.check_missing(table, "s"))
    assert rows(found["rule_summary"]) == rows(pl.rule_summary(table, RULES, "s"))
    bad, good = checks.quarantined_rows(), checks.valid_rows()
    assert good.columns == table.columns
    assert rows(good.unionByName(bad.select(*[f"`{c}`" for c in good.columns]))) == rows(table)
    problems = {r["id"]: r["_problems"] for r in bad.collect()}
    assert all(problems.values())
    counted = {name: sum(name in p for p in problems.values()) for name in ("age_fits", "status_known")}
    assert counted == {r["rule_name"]: r["violation_count"] for r in found["rules"].collect()}


def test_a_stream_equals_the_table(spark, source, tmp_path):
    checks = check_stream(stream(spark, source), str(tmp_path / "out"), CONFIG)
    agrees(spark, checks, source)
    by_batch = checks.by_batch("rules")
    assert by_batch.select("batch_id").distinct().count() == 4
    assert by_batch.filter("rule_name = 'age_fits'").agg(F.sum("row_count")).first()[0] == 100


def test_more_files_are_counted_when_they_come(spark, source, tmp_path):
    out = str(tmp_path / "out")
    check_stream(stream(spark, source), out, CONFIG)
    spark.createDataFrame(data(100, 30), SCHEMA).coalesce(1).write.mode("append").parquet(source)
    agrees(spark, check_stream(stream(spark, source), out, CONFIG), source)
    agrees(spark, check_stream(stream(spark, source), out, CONFIG), source)  # nothing new


def test_a_repeated_batch_changes_nothing(spark, source, tmp_path):
    out = str(tmp_path / "out")
    checks = check_stream(stream(spark, source, 4), out, CONFIG)
    before = rows(checks.results()["rules"])
    checks.process(spark.read.schema(SCHEMA).parquet(source), 0)
    assert rows(checks.results()["rules"]) == before
    agrees(spark, checks, source)


def test_a_batch_that_failed_halfway_is_done_again(spark, source, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    checks = StreamChecks(spark, spark.read.parquet(source).schema, out, CONFIG)
    process, seen = checks.process, []

    def fails_in_second(batch, number):
        seen.append(number)
        process(batch, number)
        if number == 1:
            raise RuntimeError("lost after writing, before the batch was committed")

    monkeypatch.setattr(checks, "process", fails_in_second)
    query = checks.start(stream(spark, source))
    with pytest.raises(Exception, match="lost after writing"):
        query.awaitTermination()
    assert seen == [0, 1] and checks.results()["counts"].first()["row_count"] == 50
    monkeypatch.setattr(checks, "process", process)
    checks.start(stream(spark, source)).awaitTermination()
    agrees(spark, checks, source)


def test_rows_of_uncounted_batches_are_not_shown(spark, source, tmp_path):
    out = str(tmp_path / "out")
    checks = check_stream(stream(spark, source, 4), out, CONFIG)
    checks.valid_rows().withColumn("_problems", F.array().cast("array<string>")).write.parquet(
        f"{out}/rows/_batch_id=9/_outcome=valid"
    )
    agrees(spark, checks, source)


def test_guards_and_no_batches(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    with pytest.raises(ValueError):
        StreamChecks(spark, schema, str(tmp_path), pl.RunConfig("s"))
    with pytest.raises(ValueError):
        StreamChecks(spark, spark.createDataFrame([], "_problems int").schema, str(tmp_path), CONFIG)
    checks = StreamChecks(spark, schema, str(tmp_path / "none"), CONFIG)
    assert checks.results()["counts"].first()["row_count"] == 0
    assert checks.valid_rows().count() == checks.quarantined_rows().count() == 0
