"""Read-only SQL over the table under check."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field
from functools import partial

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.grading import check_limit
from plumbline.functions.parsing import NESTED_TYPES
from plumbline.functions.text import strip
from plumbline.operators.distributions import distributions
from plumbline.plans.config import SqlQuery
from plumbline.plans.storage import cancelled_after, side_by_side
from plumbline.plans.table import Scan, Table, rows_of

# Words no read-only query may contain.
FORBIDDEN_WORDS = (
    "alter", "attach", "call", "copy", "create", "delete", "detach", "drop",
    "export", "import", "insert", "install", "load", "pragma", "set", "update",
)
# In Spark SQL these run programs or Java methods from within a SELECT.
FORBIDDEN_IN_SPARK = ("transform", "reflect", "java_method", "try_reflect")

READ_ONLY_START = r"^(select|with)\b"

SQL_RESULT_SCHEMA = (
    "dataset string, position int, query_name string, sql string, status string, "
    "row_count bigint, columns array<string>, error_message string"
)
SQL_ROW_SCHEMA = "dataset string, query_name string, row_number int, row map<string,string>"

def check_read_only(sql: str) -> None:
    """Raise unless the text looks like one SELECT or WITH query without forbidden words."""
    text = sql.strip().rstrip(";").lower()
    if not text:
        raise ValueError("the query is empty")
    if not re.match(READ_ONLY_START, text):
        raise ValueError("only SELECT and WITH queries are allowed")
    forbidden = sorted(set(re.findall(r"\w+", text)) & {*FORBIDDEN_WORDS, *FORBIDDEN_IN_SPARK})
    if forbidden:
        raise ValueError(f"forbidden words in the query: {', '.join(forbidden)}")


def is_read_only(sql: Column) -> Column:
    """The same test as a column expression, for stored results."""
    text = F.lower(strip(sql))
    words = F.split(text, r"[^\p{L}\p{N}_]+")
    forbidden = F.array(*[F.lit(w) for w in (*FORBIDDEN_WORDS, *FORBIDDEN_IN_SPARK)])
    return text.rlike(READ_ONLY_START) & ~F.arrays_overlap(words, forbidden)


@contextmanager
def sql_session(df: DataFrame, table_name: str = "dataset") -> Iterator[SparkSession]:
    """A separate session in which the table is visible under ``table_name``.

    Temporary views of the caller are not visible there, and paths cannot be used as tables.
    NaN is null, as in all other checks.
    """
    spark = df.sparkSession
    table = Table.of(df)
    handover = f"plumbline_{uuid.uuid4().hex}"
    table.frame.toDF(*table.names).createGlobalTempView(handover)
    try:
        session = spark.newSession()
        for setting, value in spark.conf.getAll.items():
            if setting.startswith("spark.sql.") and spark.conf.isModifiable(setting):
                session.conf.set(setting, value)
        session.conf.set("spark.sql.runSQLOnFiles", "false")
        session.table(f"global_temp.{handover}").createOrReplaceTempView(table_name)
        yield session
    finally:
        spark.catalog.dropGlobalTempView(handover)


def _tables_read(session: SparkSession, sql: str) -> set[str]:
    """Names of catalog tables a query reads, as EXPLAIN shows them; nothing is executed."""
    plan = session.sql(f"EXPLAIN EXTENDED {sql}").first()[0]
    return {name for name in re.findall(r"SubqueryAlias (.*)", plan) if "." in name}


def query_dataset(session: SparkSession, sql: str, table_name: str = "dataset") -> DataFrame:
    """The result of a guarded query, lazily. It may read the table under check and nothing else."""
    check_read_only(sql)
    foreign = _tables_read(session, sql) - _tables_read(session, f"SELECT * FROM `{table_name}`")
    if foreign:
        raise ValueError(f"only {table_name!r} can be queried, not {', '.join(sorted(foreign))}")
    return session.sql(sql)


def as_text(df: DataFrame) -> DataFrame:
    """Every column as text, null as the empty text."""
    table = [(f"c{i}", field.name, field.dataType) for i, field in enumerate(df.schema.fields)]
    renamed = df.toDF(*[alias for alias, _, _ in table])
    return renamed.select(
        *[
            F.coalesce(
                F.to_json(alias) if isinstance(kind, NESTED_TYPES) else F.col(alias).cast("string"),
                F.lit(""),
            ).alias(name)
            for alias, name, kind in table
        ]
    )


@dataclass(frozen=True)
class SqlResult:
    query_name: str
    sql: str
    status: str
    row_count: int = 0
    columns: Sequence[str] = ()
    rows: Sequence[dict[str, str]] = field(default_factory=tuple)
    error_message: str | None = None


def _run(
    session: SparkSession, query: SqlQuery, table_name: str, max_rows: int, seconds: float | None
) -> SqlResult:
    try:
        with cancelled_after(session, seconds):
            result = query_dataset(session, query.sql, table_name)
            # What is computed for the rows shown is held, so that counting does not run it again.
            result = result.persist(StorageLevel.DISK_ONLY)
            try:
                shown = as_text(result).limit(max_rows + 1).collect()
                row_count = len(shown) if len(shown) <= max_rows else result.count()
            finally:
                result.unpersist()
    except Exception as error:
        return SqlResult(query.query_name, query.sql, "failed", error_message=str(error))
    return SqlResult(
        query.query_name,
        query.sql,
        "passed",
        row_count,
        result.columns,
        [dict(zip(result.columns, row, strict=True)) for row in shown[:max_rows]],
    )


def run_queries(
    df: DataFrame,
    queries: Sequence[SqlQuery],
    table_name: str = "dataset",
    max_rows: int = 50,
    max_seconds: float | None = None,
) -> list[SqlResult]:
    """Run every query; one that is refused or fails is reported and does not stop the others.

    A query whose tasks run for more than ``max_seconds`` is cancelled, and is failed; the others go on.
    Waiting for executors that others use does not count.
    """
    check_limit("max_rows", max_rows)
    if not queries:
        return []
    with sql_session(df, table_name) as session:
        return side_by_side(
            session,
            [partial(_run, session, query, table_name, max_rows, max_seconds) for query in queries],
        )


def batch_status(results: Sequence[SqlResult]) -> str:
    failed = sum(result.status == "failed" for result in results)
    if failed == 0:
        return "passed"
    return "failed" if failed == len(results) else "warning"


def sql_results(
    spark: SparkSession, results: Sequence[SqlResult], dataset: str = "dataset"
) -> DataFrame:
    """One row per query."""
    return spark.createDataFrame(
        [
            (dataset, i, r.query_name, r.sql, r.status, r.row_count, list(r.columns), r.error_message)
            for i, r in enumerate(results)
        ],
        SQL_RESULT_SCHEMA,
    )


def sql_result_rows(
    spark: SparkSession, results: Sequence[SqlResult], dataset: str = "dataset"
) -> DataFrame:
    """The shown rows of every query as text."""
    return spark.createDataFrame(
        [
            (dataset, r.query_name, number, row)
            for r in results
            for number, row in enumerate(r.rows, start=1)
        ],
        SQL_ROW_SCHEMA,
    )


def summarize_sql(results: DataFrame) -> DataFrame:
    """One row per dataset: status of the batch, queries run and failed."""
    failed = F.count_if(F.col("status") == "failed")
    executed = F.count(F.lit(1))
    return results.groupBy("dataset").agg(
        F.when(failed == 0, "passed")
        .when(failed == executed, "failed")
        .otherwise("warning")
        .alias("status"),
        executed.alias("queries_executed"),
        failed.alias("queries_failed"),
    )


# --- the generated queries as DataFrame operators ---


def total_rows(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"))


def value_distribution(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs, most frequent first."""
    return _value_counts(df, column).orderBy(F.desc("row_count"), "value")


def _value_counts(df: DataFrame, column: str) -> DataFrame:
    table = Table.of(df)
    table.require([column], "distribution")
    return table.frame.groupBy(table.column(column).alias("value")).agg(
        F.count(F.lit(1)).alias("row_count")
    )


def answer_distribution(
    df: DataFrame, query: SqlQuery, max_rows: int, max_seconds: float | None = None
) -> SqlResult:
    """The result of a suggested distribution: groups are counted once, and the first of them found
    without sorting the others.
    """
    try:
        with cancelled_after(df.sparkSession, max_seconds):
            groups = _value_counts(df, query.column_name).persist(StorageLevel.DISK_ONLY)
            try:
                first = groups.orderBy(F.desc("row_count"), "value").limit(max_rows)
                shown, row_count = as_text(first).collect(), groups.count()
            finally:
                groups.unpersist()
    except Exception as error:
        return SqlResult(query.query_name, query.sql, "failed", error_message=str(error))
    rows = [row.asDict() for row in shown]
    return SqlResult(query.query_name, query.sql, "passed", row_count, ["value", "row_count"], rows)


def answer_distributions(
    df: DataFrame, queries: Sequence[SqlQuery], max_rows: int
) -> list[SqlResult]:
    """The results of several suggested distributions, from one pass. If that fails, each is tried alone, so
    that the error is told where it belongs.
    """
    try:
        found = distributions(df, [query.column_name for query in queries], max_rows)
    except Exception:
        return [answer_distribution(df, query, max_rows) for query in queries]
    return [
        SqlResult(
            query.query_name, query.sql, "passed", value_count, ["value", "row_count"],
            [{"value": "" if value is None else value, "row_count": str(n)} for value, n in rows],
        )
        for query, (value_count, rows) in zip(queries, found, strict=True)
    ]


NUMERIC_ROW = "column_name string, min_value double, max_value double, avg_value double"
DATE_ROW = "column_name string, min_date date, max_date date"


def plan_numeric_summary(scan: Scan, columns: Sequence[str]) -> Column:
    scan.table.require(columns, "numeric summary")
    rows = []
    for name in columns:
        i, number = scan.table.position(name), scan.number(name)
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                scan.total(f"min_number_{i}", F.min(number)).alias("min_value"),
                scan.total(f"max_number_{i}", F.max(number)).alias("max_value"),
                scan.total(f"avg_number_{i}", F.avg(number)).alias("avg_value"),
            )
        )
    return rows_of(rows, NUMERIC_ROW)


def plan_date_range(
    scan: Scan, columns: Sequence[str], date_formats: tuple[str, ...] = ()
) -> Column:
    scan.table.require(columns, "date range")
    rows = []
    for name in columns:
        i, day = scan.table.position(name), F.to_date(scan.timestamp(name, date_formats))
        rows.append(
            F.struct(
                F.lit(name).alias("column_name"),
                scan.total(f"min_date_{i}", F.min(day)).alias("min_date"),
                scan.total(f"max_date_{i}", F.max(day)).alias("max_date"),
            )
        )
    return rows_of(rows, DATE_ROW)


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Smallest, largest and average number of every column, all in one pass."""
    scan = Scan(Table.of(df))
    return scan.row(numbers=plan_numeric_summary(scan, columns)).select(F.inline("numbers"))


def date_range(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """First and last day of every column, all in one pass."""
    scan = Scan(Table.of(df))
    return scan.row(dates=plan_date_range(scan, columns)).select(F.inline("dates"))
