"""Input tables for the registered queries."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline import Rule

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

REFERENCE_DATE = date(2026, 1, 1)

# The events table with nulls, NaN, text among numbers, bad dates and repeated keys. {S} is the
# name of the text type, the only word on which the two SQL dialects differ here.
DIRTY = """
SELECT CASE WHEN event_id % 50 = 1 THEN event_id - 1 ELSE event_id END AS record_id,
  event_id,
  CASE WHEN event_id % 13 = 0 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN event_id % 17 = 0 THEN 'unknown' WHEN event_id % 19 = 0 THEN NULL
       WHEN event_id % 21 = 0 THEN '29.5' ELSE CAST(event_id % 130 AS {S}) END AS age,
  CASE WHEN event_id % 23 = 0 THEN 'not-a-date' WHEN event_id % 29 = 0 THEN '2030-01-01'
       ELSE CAST(CAST(ts AS DATE) AS {S}) END AS signup_date,
  CASE WHEN event_id % 43 = 0 THEN upper(event_type)
       WHEN event_id % 47 = 0 THEN concat(' ', event_type, ' ')
       ELSE event_type END AS status,
  CASE WHEN event_id % 31 = 0 THEN -value ELSE value END AS amount,
  CASE WHEN event_id % 41 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS reading,
  CASE WHEN event_id % 37 = 0 THEN 'maybe' WHEN event_id % 2 = 0 THEN ' Yes'
       ELSE 'false' END AS is_active
FROM {T}
"""

# JSON of several depths, with nulls, broken text and lists within lists, in both dialects.
JSON_VALUES = """
SELECT CASE WHEN event_id % 11 = 0 THEN concat(props, '}}')
  WHEN event_id % 13 = 0 THEN NULL
  WHEN event_id % 7 = 0 THEN concat('{{"id":', event_id, ',"inner":', props, ',"tags":["', event_type, '",null,[', user_id, ']]}}')
  WHEN event_id % 5 = 0 THEN concat('[', props, ',', value, ',true,{{"deep":{{"er":[', props, ',[]]}}}}]')
  WHEN event_id % 17 = 0 THEN 'null'
  ELSE props END AS v
FROM {T}
"""

DIRTY_COLUMNS = {
    "record_id": "bigint",
    "event_id": "bigint",
    "user_id": "bigint",
    "age": "string",
    "signup_date": "string",
    "status": "string",
    "amount": "double",
    "reading": "double",
    "is_active": "string",
}

DIRTY_SCHEMA = {"age": "integer", "signup_date": "date", "is_active": "boolean",
                "amount": "float", "reading": "numeric", "status": "string"}

STATUSES = ("click", "view", "purchase", "signup")

DIRTY_RULES = (
    Rule("user_id_required", "user_id", "not_null"),
    Rule("age_in_range", "age", "range", min_value=0, max_value=120),
    Rule("age_known_in_range", "age", "range", min_value=0, max_value=120, allow_null=False),
    Rule("age_at_most", "age", "range", max_value=100),
    Rule("amount_positive", "amount", "positive"),
    Rule("amount_non_negative", "amount", "non_negative"),
    Rule("status_known", "status", "allowed_values", allowed_values=STATUSES),
    Rule("signup_not_future", "signup_date", "not_future_date"),
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dirty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(DIRTY.format(S="STRING", T="{events}"), events=load(spark, sf_dir, "events"))


def dirty_stream(spark: SparkSession, sf_dir: str, files: int = 4) -> DataFrame:
    """The dirty table as a stream of files."""
    schema = load(spark, sf_dir, "events").schema
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/events.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        events = source.parquet(f"{sf_dir}/events.parquet")
    else:  # a stream watches a folder
        events = source.option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return spark.sql(DIRTY.format(S="STRING", T="{events}"), events=events)


def documents_without_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").drop("doc_id")


def with_text(df: DataFrame, column: str) -> DataFrame:
    """Arrays and maps compare as text."""
    return df.withColumn(column, F.to_json(column))
