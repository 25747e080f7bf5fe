"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import date
from functools import lru_cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import plumbline as pl
from fixtures.tables import (
    DIRTY_RULES,
    DIRTY_SCHEMA,
    JSON_VALUES,
    REFERENCE_DATE,
    TABLES,
    dirty,
    dirty_stream,
    documents_without_id,
    load,
    with_text,
)
from plumbline.operators.sqlcheck import (
    as_text,
    date_range,
    numeric_summary,
    query_dataset,
    run_queries,
    sql_result_rows,
    sql_results,
    summarize_sql,
    total_rows,
    value_distribution,
)
from plumbline.operators.suggest import suggest_configs
from plumbline.operators.asof import asof_join
from plumbline.operators.distinct import distinct_counts
from plumbline.operators.distributions import value_distributions
from plumbline.operators.quantiles import numeric_quantiles
from plumbline.operators.slices import check_slices, missing_by_slice, rules_by_slice
from plumbline.plans.incremental import incremental_run
from plumbline.plans.storage import scratch_path, settle
from plumbline.streaming.checks import StreamChecks, check_stream

LINE_KEY = ("l_orderkey", "l_linenumber")
RUN_DAY = date(2026, 1, 2)

# Read-only SQL over one table, each as a user would write it.
SQL = {
    "sql_grouped_sum": (
        "orders",
        "SELECT o_orderstatus, COUNT(*) AS n, CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DECIMAL(38,2)) AS total "
        "FROM dataset GROUP BY o_orderstatus ORDER BY total DESC",
    ),
    "sql_count_distinct": (
        "events",
        "SELECT COUNT(*) AS n, COUNT(DISTINCT user_id) AS users, "
        "COUNT(DISTINCT event_type) AS kinds FROM dataset",
    ),
    "sql_with_cte": (
        "events",
        "WITH busy AS (SELECT user_id, COUNT(*) AS n FROM dataset GROUP BY user_id) "
        "SELECT n, COUNT(*) AS users FROM busy GROUP BY n",
    ),
    "sql_filter_projection": (
        "orders",
        "SELECT o_orderkey, o_custkey, o_orderpriority FROM dataset "
        "WHERE o_orderstatus = 'F' AND o_totalprice > 200000",
    ),
    "sql_window_rank": (
        "events",
        "SELECT event_type, n, CAST(RANK() OVER (ORDER BY n DESC) AS BIGINT) AS place FROM "
        "(SELECT event_type, COUNT(*) AS n FROM dataset GROUP BY event_type) AS t",
    ),
    "sql_set_ops": (
        "events",
        "SELECT user_id FROM ((SELECT user_id FROM dataset WHERE event_type = 'purchase' "
        "EXCEPT SELECT user_id FROM dataset WHERE event_type = 'error') "
        "UNION SELECT user_id FROM dataset WHERE value > 400) AS t",
    ),
    "sql_cube": (
        "orders",
        "SELECT o_orderstatus, o_orderpriority, COUNT(*) AS n FROM dataset "
        "GROUP BY CUBE (o_orderstatus, o_orderpriority)",
    ),
    "sql_semi_join": (
        "orders",
        "SELECT o_orderstatus, COUNT(*) AS n FROM dataset WHERE o_custkey IN "
        "(SELECT o_custkey FROM dataset WHERE o_orderpriority = '1-URGENT') "
        "GROUP BY o_orderstatus",
    ),
    "sql_self_join": (
        "orders",
        "WITH first_order AS (SELECT o_custkey, MIN(o_orderdate) AS first_day FROM dataset "
        "GROUP BY o_custkey) SELECT o.o_orderstatus, COUNT(*) AS n FROM dataset AS o "
        "JOIN first_order AS f ON o.o_custkey = f.o_custkey AND o.o_orderdate = f.first_day "
        "GROUP BY o.o_orderstatus",
    ),
    "sql_median_filter": (
        "events",
        "SELECT event_type, MEDIAN(value) AS middle, "
        "COUNT(*) FILTER (WHERE value > 100) AS large FROM dataset GROUP BY event_type",
    ),
}

BATCH = (
    pl.SqlQuery("statuses", "SELECT status, COUNT(*) AS n FROM dataset GROUP BY status ORDER BY n DESC, status"),
    pl.SqlQuery("users", "SELECT COUNT(DISTINCT user_id) AS users FROM dataset;"),
    pl.SqlQuery("keys", "SELECT DISTINCT record_id FROM dataset"),
    pl.SqlQuery("no_such_column", "SELECT nothing FROM dataset"),
    pl.SqlQuery("not_read_only", "DROP TABLE dataset"),
)


def _sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    table, text = SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        with pl.sql_session(load(spark, sf_dir, table)) as session:
            return query_dataset(session, text)

    return run


def _rule(name: str) -> Callable[[SparkSession, str], DataFrame]:
    chosen = [rule for rule in DIRTY_RULES if rule.rule_name == name]
    return lambda spark, sf_dir: pl.check_rules(
        dirty(spark, sf_dir), chosen, reference_date=REFERENCE_DATE
    ).drop("position", "dataset")


# Several queries look at parts of the same run; it is made once per session and folder.
@lru_cache(maxsize=4)
def _described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(pl.describe_tables({name: load(spark, sf_dir, name) for name in TABLES}))


@lru_cache(maxsize=4)
def _run(spark: SparkSession, sf_dir: str) -> pl.AutoRun:
    return pl.auto_run(
        dirty(spark, sf_dir), "dirty", row_id=["event_id"], reference_date=REFERENCE_DATE
    )


@lru_cache(maxsize=4)
def _bare_run(spark: SparkSession, sf_dir: str) -> pl.RunResult:
    config = pl.RunConfig("orders", ["o_orderkey"])
    return pl.run_checks(load(spark, sf_dir, "orders"), config)


def _tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = _run(spark, sf_dir).result
    one_more = lambda table, column: table.withColumn(column, F.col(column) + 1)
    return pl.verify(
        dirty(spark, sf_dir),
        replace(
            result,
            counts=one_more(result.counts, "row_count"),
            missing_summary=one_more(result.missing_summary, "total_missing_values"),
            duplicates=one_more(result.duplicates, "duplicate_row_count"),
            type_summary=one_more(result.type_summary, "total_invalid_values"),
            rule_summary=one_more(result.rule_summary, "rules_with_violations"),
            sql_results=result.sql_results.withColumn(
                "sql", F.when(F.col("position") == 0, "DELETE FROM dataset").otherwise(F.col("sql"))
            ),
            score=one_more(result.score, "overall_score"),
        ),
    )


def _csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    (
        dirty(spark, sf_dir)
        .write.option("header", True)
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )
    return pl.read_csv(spark, path)


def _csv_line_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with line breaks and quotes, in files that hold some and files that hold none."""
    path = scratch_path(spark, "csv")
    breaks = F.coalesce(F.col("text").contains("\n"), F.lit(False))
    for chosen in (breaks, ~breaks):
        (
            load(spark, sf_dir, "documents").filter(chosen)
            .write.mode("append")
            .options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
            .csv(path)
        )
    types = {"doc_id": "bigint", "n_chars": "bigint"}
    return pl.read_csv(spark, path, types=types)


def _large_ints(spark: SparkSession, sf_dir: str) -> DataFrame:
    edge = F.lit(2**62)
    events = load(spark, sf_dir, "events")
    return pl.sample_values(
        events.select((F.col("event_id") - edge).alias("low"), (F.col("event_id") + edge).alias("high"))
    )


def _numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run shows for a summary from its shared pass, and what the SQL itself returns."""
    number = F.concat(F.lit("\t"), (F.col("event_id") + 20_000_000).cast("string"), F.lit(" "))
    df = load(spark, sf_dir, "events").select(number.alias("price"))
    generated = [q for q in pl.suggest_config(pl.describe_table(df)).sql_queries if q.kind == "numeric_summary"]
    both = [*generated, *[replace(q, kind=None, query_name="by_sql") for q in generated]]
    shown = pl.run_checks(df, pl.RunConfig(sql_queries=both)).sql_rows
    values = [F.col("row")[c].cast("double").alias(c) for c in ("min_value", "max_value", "avg_value")]
    return (
        shown.select(*values)
        .withColumn("avg_value", F.round("avg_value", 3))
        .groupBy("min_value", "max_value", "avg_value")
        .agg((F.count(F.lit(1)) / 2).cast("int").alias("n"))
    )


def _multiline(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = load(spark, sf_dir, "events")
    query = pl.SqlQuery("kinds", "\n  SELECT event_type, COUNT(*) AS n\n  FROM dataset\n  GROUP BY event_type\n")
    run = pl.verify_run(df, pl.run_checks(df, pl.RunConfig(duplicate_key_columns=["event_id"], sql_queries=[query])))
    return run.verification.filter("check_name LIKE 'sql%'").select("check_name", "status")


def _date_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("l_shipdate")
    text = F.when(F.col("l_linenumber") == 7, "soon").when(
        F.col("l_linenumber") % 2 == 0, F.date_format(day, "MM/dd/yyyy")
    ).otherwise(F.date_format(day, "yyyy-MM-dd"))
    df = load(spark, sf_dir, "lineitem").select("l_orderkey", text.alias("shipped"))
    config = pl.RunConfig(duplicate_key_columns=["l_orderkey"], expected_schema={"shipped": "date"})
    run = pl.run_checks(df, config, date_formats=("MM/dd/yyyy",))
    return run.types.select("column_name", "non_null_count", "invalid_count")


def _streamed(spark: SparkSession, sf_dir: str) -> StreamChecks:
    config = pl.RunConfig("dataset", None, DIRTY_SCHEMA, DIRTY_RULES)
    path = scratch_path(spark, "stream")
    return check_stream(dirty_stream(spark, sf_dir), path, config, reference_date=REFERENCE_DATE)


def _quarantined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _streamed(spark, sf_dir).quarantined_rows()
    return rows.select("event_id", F.array_join("_problems", "|").alias("problems"))


LINE_RULES = (
    pl.Rule("small_discount", "l_discount", "range", max_value=0.08),
    pl.Rule("few", "l_quantity", "range", 1, 45),
    pl.Rule("status_known", "l_linestatus", "allowed_values", allowed_values=("O",)),
)


def _sliced_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pl.RunConfig("dirty", ("record_id",), DIRTY_SCHEMA, DIRTY_RULES)
    found = check_slices(dirty(spark, sf_dir), ["status"], config, REFERENCE_DATE)
    return found.score.select("slice", "overall_score", "max_score", "rating")


def _asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the last view of the same user up to then."""
    events = load(spark, sf_dir, "events")
    bought = events.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = events.filter("event_type = 'view'").groupBy("user_id", "ts").agg(F.max("event_id").alias("view_id"))
    found = asof_join(bought, views, "ts", "ts", [("user_id", "user_id")])
    return found.select("event_id", "user_id", "ts", "view_id", F.col("ts_right").alias("viewed"))


QUANTILES = (0.0, 0.1, 0.5, 0.75, 1.0)
ORDER_RULES = (
    pl.Rule("price_fits", "o_totalprice", "range", 1000, 400000),
    pl.Rule("done", "o_orderstatus", "allowed_values", allowed_values=("F", "O")),
)


def _grown(spark: SparkSession, sf_dir: str, table: str, half: Column, config: pl.RunConfig):
    """A folder with half of a table is checked, then again with the other half added."""
    df, folder = load(spark, sf_dir, table), scratch_path(spark, table)
    store = scratch_path(spark, "states")
    for chosen in (half, ~half):
        df.filter(chosen).write.mode("append").parquet(folder)
        found = incremental_run(spark, folder, store, config, reference_date=REFERENCE_DATE)
    return found


def _grown_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pl.RunConfig("orders", ("o_orderkey",), None, ORDER_RULES)
    return _grown(spark, sf_dir, "orders", F.col("o_orderkey") % 2 == 0, config).tables["rules"]


def _grown_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pl.RunConfig("dataset", LINE_KEY)
    found = _grown(spark, sf_dir, "lineitem", F.col("l_partkey") % 3 == 0, config)
    return with_text(found.tables["duplicates"], "key_columns")


def _two_datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables stored under one run, one of them again on the next day."""
    path = scratch_path(spark, "results")
    for name, day in (("orders", 2), ("events", 2), ("orders", 3)):
        run = pl.run_checks(load(spark, sf_dir, name), pl.RunConfig(name))
        pl.write_result(run, path, run_id="run-1", run_date=date(2026, 1, day))
    return pl.read_result(spark, path, "counts").select("run_id", "dataset", "row_count")


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "results")
    result = _run(spark, sf_dir).result
    for _ in range(2):  # writing a run again must not double its rows
        pl.write_result(result, path, run_id="run-1", run_date=RUN_DAY)
    rules = pl.read_result(spark, path, "rules", run_id="run-1")
    return rules.withColumn("run_date", F.col("run_date").cast("string"))


def _suggested(suggest: Callable[[DataFrame], DataFrame]):
    return lambda spark, sf_dir: suggest(_described(spark, sf_dir))


def _part(name: str):
    return lambda spark, sf_dir: getattr(_run(spark, sf_dir).result, name)


def _config_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the suggested configuration of every table holds, counted."""
    rows = []
    for name, config in suggest_configs(_described(spark, sf_dir)).items():
        key = ",".join(config.duplicate_key_columns or ())
        rows.append(
            (name, key, len(config.expected_schema), len(config.business_rules), len(config.sql_queries))
        )
    return spark.createDataFrame(
        rows, "dataset string, key string, types int, rules int, queries int"
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {
        "missing_by_column": lambda s, d: pl.check_missing(dirty(s, d)),
        "missing_summary": lambda s, d: pl.missing_summary(dirty(s, d)),
        "profile_columns": lambda s, d: pl.profile_columns(dirty(s, d)),
        "profile_samples": lambda s, d: pl.sample_values(dirty(s, d)),
        "preview": lambda s, d: pl.preview(load(s, d, "events"), 20, ["event_id"]),
        "dup_key_summary": lambda s, d: with_text(
            pl.check_duplicates(load(s, d, "lineitem"), LINE_KEY), "key_columns"
        ),
        "dup_key_topk": lambda s, d: with_text(
            pl.largest_duplicate_groups(load(s, d, "lineitem"), LINE_KEY), "duplicate_key"
        ),
        "profile_samples_large_ints": _large_ints,
        "dup_key_rows": lambda s, d: pl.duplicate_rows(load(s, d, "lineitem"), LINE_KEY),
        "dup_full_row_rows": lambda s, d: pl.duplicate_rows(documents_without_id(s, d)),
        "dup_full_row_summary": lambda s, d: with_text(
            pl.check_duplicates(documents_without_id(s, d)), "key_columns"
        ),
        "dup_full_row_topk": lambda s, d: with_text(
            pl.largest_duplicate_groups(documents_without_id(s, d)), "duplicate_key"
        ),
        "dup_null_keys": lambda s, d: with_text(
            pl.check_duplicates(dirty(s, d), ["user_id", "reading"]), "key_columns"
        ),
        "type_by_column": lambda s, d: pl.check_types(dirty(s, d), DIRTY_SCHEMA),
        "type_summary": lambda s, d: pl.type_summary(dirty(s, d), DIRTY_SCHEMA),
        "type_examples": lambda s, d: pl.type_examples(dirty(s, d), DIRTY_SCHEMA, ["event_id"]),
        "rules_by_rule": lambda s, d: pl.check_rules(
            dirty(s, d), DIRTY_RULES, reference_date=REFERENCE_DATE
        ),
        "rules_summary": lambda s, d: pl.rule_summary(
            dirty(s, d), DIRTY_RULES, reference_date=REFERENCE_DATE
        ),
        "rule_examples": lambda s, d: pl.rule_examples(
            dirty(s, d), DIRTY_RULES, ["event_id"], reference_date=REFERENCE_DATE
        ),
        "rule_not_null": _rule("user_id_required"),
        "rule_range": _rule("age_in_range"),
        "rule_range_one_bound": _rule("age_at_most"),
        "rule_null_disallowed": _rule("age_known_in_range"),
        "rule_positive": _rule("amount_positive"),
        "rule_non_negative": _rule("amount_non_negative"),
        "rule_allowed_values": _rule("status_known"),
        "rule_allowed_values_table": lambda s, d: pl.check_allowed_table(
            load(s, d, "lineitem"), "l_partkey", load(s, d, "part").filter("p_size < 25").select("p_partkey")
        ),
        "run_with_allowed_table": lambda s, d: _allowed_run(s, d).rules,
        "run_allowed_table_examples": lambda s, d: _allowed_run(s, d).rule_examples,
        "rule_not_future_date": _rule("signup_not_future"),
        "sql_total_rows": lambda s, d: total_rows(dirty(s, d)),
        "sql_distribution": lambda s, d: value_distribution(dirty(s, d), "status"),
        "sql_numeric_summary": lambda s, d: numeric_summary(
            dirty(s, d), ["age", "amount", "reading"]
        ).withColumn("avg_value", F.round("avg_value", 6)),
        "sql_date_range": lambda s, d: date_range(dirty(s, d), ["signup_date"]),
        "sql_quoted_identifier": _quoted_identifier,
        "sql_batch_results": lambda s, d: with_text(
            sql_results(s, run_queries(dirty(s, d), BATCH)), "columns"
        ).drop("error_message"),
        "sql_batch_status": lambda s, d: summarize_sql(
            sql_results(s, run_queries(dirty(s, d), BATCH))
        ),
        "sql_batch_rows": lambda s, d: sql_result_rows(s, run_queries(dirty(s, d), BATCH[:2]))
        .select("query_name", "row_number", F.explode("row").alias("column_name", "value")),
        "sql_result_strings": lambda s, d: as_text(
            dirty(s, d).select(
                "event_id", "user_id", "age", "signup_date", "status", "amount", "is_active"
            )
        ),
        "sql_nested_strings": lambda s, d: as_text(
            load(s, d, "events").select(
                "event_id",
                F.array("user_id", F.col("user_id") + 1).alias("pair"),
                F.create_map(F.lit("kind"), "event_type").alias("named"),
            )
        ),
        "sql_numeric_text": _numeric_text,
        "verify_multiline_sql": _multiline,
        "run_with_date_formats": _date_formats,
        "suggest_types": _suggested(pl.suggest_types),
        "suggest_keys": _suggested(pl.suggest_keys),
        "suggest_rules": _suggested(lambda c: pl.suggest_rules(c).drop("description")),
        "suggest_queries": _suggested(
            lambda c: pl.suggest_queries(c).drop("description", "sql")
        ),
        "suggest_config": _config_rows,
        "score_components": _part("score_components"),
        "score_total": _part("score"),
        "score_recommendations": _part("score_recommendations"),
        "score_without_config": lambda s, d: _bare_run(s, d).score_components,
        "recommendations_without_config": lambda s, d: _bare_run(s, d).score_recommendations,
        "verify_run": _part("verification"),
        "verify_summary": _part("verification_summary"),
        "verify_tampered": _tampered,
        "observations": _part("observations"),
        "observations_without_config": lambda s, d: _bare_run(s, d).observations,
        "run_log": _part("log"),
        "run_log_without_config": lambda s, d: _bare_run(s, d).log,
        "report_rows": lambda s, d: _run(s, d).result.report(),
        "report_recommendations": _part("report_recommendations"),
        "csv_scan_typed": _csv_round_trip,
        "csv_scan_line_breaks": _csv_line_breaks,
        "sink_roundtrip": _stored,
        "sink_two_datasets": _two_datasets,
        "asof_events": _asof,
        "distinct_counts": lambda s, d: distinct_counts(dirty(s, d), exact=True),
        "distributions_documents": lambda s, d: value_distributions(
            load(s, d, "documents"), ["text", "lang", "source", "n_chars"], "documents"
        ),
        "distributions_lineitem": lambda s, d: value_distributions(
            load(s, d, "lineitem"), ["l_returnflag", "l_linenumber", "l_shipdate", "l_orderkey"], "lineitem", 20
        ),
        "numeric_quantiles": lambda s, d: numeric_quantiles(
            dirty(s, d), ["age", "amount", "reading"], QUANTILES, exact=True
        ),
        "json_paths": _json_paths,
        "json_list_paths": _list_paths,
        "incremental_run": _grown_orders,
        "incremental_duplicates": _grown_lines,
        "missing_by_slice": lambda s, d: missing_by_slice(dirty(s, d), ["status"]).drop("slice_values"),
        "rules_by_slice": lambda s, d: rules_by_slice(
            load(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], LINE_RULES
        ).drop("slice_values"),
        "score_by_slice": _sliced_score,
        "stream_rules": lambda s, d: _streamed(s, d).results()["rules"],
        "stream_types": lambda s, d: _streamed(s, d).results()["types"],
        "stream_quarantined": _quarantined,
    }
    found.update({name: _sql(name) for name in SQL})
    return found


def _allowed_run(spark: SparkSession, sf_dir: str) -> pl.RunResult:
    """A run in which the parts of lines have to be in a table of parts."""
    parts = load(spark, sf_dir, "part").filter("p_size < 25").select("p_partkey")
    rules = [
        pl.Rule("few", "l_quantity", "range", max_value=45),
        pl.Rule("part_known", "l_partkey", "allowed_values", allowed_table=parts),
    ]
    config = pl.RunConfig("lines", duplicate_key_columns=LINE_KEY, business_rules=rules)
    return pl.run_checks(load(spark, sf_dir, "lineitem"), config)


def _json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The properties of events, some broken, missing, or within larger values."""
    load(spark, sf_dir, "events").createOrReplaceTempView("json_events")
    return pl.json_paths(spark.sql(JSON_VALUES.format(T="json_events")), "v")


def _list_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nested column: vectors as lists of numbers."""
    return pl.json_paths(load(spark, sf_dir, "embeddings").select("embedding"), "embedding")


def _quoted_identifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A suggested query works on a column whose name needs quoting."""
    named = dirty(spark, sf_dir).select(F.col("status").alias("event status`x"))
    text = pl.suggest_queries(pl.describe_table(named)).filter("kind = 'distribution'").first().sql
    with pl.sql_session(named) as session:
        return query_dataset(session, text)
