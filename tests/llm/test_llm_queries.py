"""Every registered query of the package against its SQL in DuckDB; the pipeline stage by stage."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from plumbline.llm import decontaminate, near_dedup
from plumbline.llm.oracle import oracle_sql
from plumbline.llm.queries import queries
from tests.llm.cases import clashing, table

FOLDER = "/root/testdata/sf0.001"

if not Path(FOLDER).exists():
    pytest.skip("the given tables are not here", allow_module_level=True)


@pytest.fixture(scope="module")
def connection():
    connection = duckdb.connect()
    for file in Path(FOLDER).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return connection


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, connection, name):
    df = queries()[name](spark, FOLDER)
    cursor = connection.execute(oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(cursor.fetchall())


def test_there_is_one_query_for_each_operator():
    numbers = Counter(int(name[2:].split("_")[0]) for name in queries() if name != "pipeline")
    assert numbers == Counter(range(1, 14)) and "pipeline" in queries()


def test_stages(spark):
    """Each stage on what the one before left, and its decisions."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "near_duplicates", "benchmark_decontamination", "source_mix", "token_files",
    ]
    steps = [docs]
    for _, stage in corpus_pipeline.STAGES:
        steps.append(_written(spark, stage(spark, steps[-1], FOLDER)))
    good, first, clean, mix, files = steps[1:]
    assert all(step.columns == docs.columns for step in steps[:-1])
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet")
    wrong = docs.join(labels, "doc_id").join(good.select("doc_id", F.lit(1).alias("in")), "doc_id", "left")
    rejected = wrong.filter("in IS NULL")
    assert rejected.filter("quality = 1").count() <= 0.03 * wrong.filter("quality = 1").count()
    assert wrong.filter("quality = 0 AND in IS NOT NULL").count() <= 2
    classes = near_dedup.near_duplicates(first)
    assert classes.filter("class_size > 1").count() == 0
    assert good.join(first, "doc_id", "left_semi").exceptAll(first).count() == 0
    judged = decontaminate.judged(
        decontaminate.find_hits(first, spark.read.parquet(f"{FOLDER}/benchmark.parquet"))
    )
    bad = {r[0] for r in judged.filter("contaminated").select("doc.doc_id").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in first.collect()} - bad
    assert mix.join(clean, "doc_id", "left_anti").count() == 0
    assert mix.filter(F.col("n_chars") != F.length("text")).count() == 0
    assert files.count() == mix.count()


def _written(spark, df):
    from plumbline.llm.common import saved

    return saved(df, "stage")


def test_stages_on_odd_tables(spark, tmp_path):
    """Nulls, odd texts, repeated rows and clashing columns; then no rows at all."""
    folder = str(tmp_path / "odd")
    spark.createDataFrame([(7, 1, 0), (9, 0, 0), (None, 1, 0), (13, None, 0), (8, 1, 0)],
                          "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, "one"), (None, None)], "item_id bigint, text string").write.parquet(
        f"{folder}/benchmark.parquet"
    )
    for docs in (clashing(table(spark), "score", "row", "node", "taken"), table(spark, [])):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = _written(spark, stage(spark, docs, folder))
            assert docs.columns == columns or name == "token_files"
            docs.count()
