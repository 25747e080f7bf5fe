"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR is the folder with the tables, BENCH_CPUS the number of local cores, BENCH_REPEAT how
often each query is timed after one warm-up (the median counts).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

import plumbline as pl  # noqa: E402
from fixtures.queries import SQL  # noqa: E402
from fixtures.tables import (  # noqa: E402
    DIRTY_RULES,
    DIRTY_SCHEMA,
    REFERENCE_DATE,
    dirty,
    documents_without_id,
    load,
)
from plumbline.operators.missing import plan_missing  # noqa: E402
from plumbline.operators.profile import plan_profile  # noqa: E402
from plumbline.operators.rules import plan_rules  # noqa: E402
from plumbline.operators.sqlcheck import query_dataset  # noqa: E402
from plumbline.operators.types import plan_types  # noqa: E402
from plumbline.plans.table import Scan, Table  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEAT = int(os.environ.get("BENCH_REPEAT", "3"))

LINE_KEY = ["l_orderkey", "l_linenumber"]
LINE_CONFIG = pl.RunConfig(
    "lineitem",
    LINE_KEY,
    {
        "l_orderkey": "integer", "l_quantity": "integer", "l_extendedprice": "numeric",
        "l_discount": "numeric", "l_returnflag": "string", "l_shipdate": "date",
    },
    (
        pl.Rule("key_given", "l_orderkey", "not_null"),
        pl.Rule("quantity_in_range", "l_quantity", "range", 1, 45),
        pl.Rule("price_positive", "l_extendedprice", "positive"),
        pl.Rule("flag_known", "l_returnflag", "allowed_values", allowed_values=["A", "N"]),
        pl.Rule("shipped", "l_shipdate", "not_future_date"),
    ),
)


def session() -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("plumbline-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        # Recording the call site of every column expression about doubles the time of a small run.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def one_job_per_check(df):
    for check in (
        pl.profile_columns(df),
        pl.check_missing(df),
        pl.check_types(df, DIRTY_SCHEMA),
        *[pl.check_rules(df, [rule], reference_date=REFERENCE_DATE) for rule in DIRTY_RULES],
    ):
        check.collect()


def fused(df):
    """The same checks as one_job_per_check, in one pass."""
    scan = Scan(Table.of(df))
    scan.row(
        profile=plan_profile(scan),
        missing=plan_missing(scan),
        types=plan_types(scan, DIRTY_SCHEMA),
        rules=plan_rules(scan, DIRTY_RULES, reference_date=REFERENCE_DATE),
    ).collect()


def widened(df, columns):
    """The table with its columns repeated under other names."""
    names = [(name, i) for i in range(-(-columns // len(df.columns))) for name in df.columns]
    return df.select(*[F.col(name).alias(f"{name}_{i}") for name, i in names[:columns]])


def grouped_sum(orders):
    with pl.sql_session(orders) as sandbox:
        return query_dataset(sandbox, SQL["sql_grouped_sum"][1]).collect()


def main() -> None:
    spark = session()
    lineitem = load(spark, SF_DIR, "lineitem")
    messy = dirty(spark, SF_DIR)
    documents = documents_without_id(spark, SF_DIR)
    orders = load(spark, SF_DIR, "orders")
    queries = {
        "missing_lineitem": lambda: pl.check_missing(lineitem).collect(),
        "profile_lineitem": lambda: pl.profile_columns(lineitem).collect(),
        "samples_lineitem": lambda: pl.sample_values(lineitem).collect(),
        "dup_key_lineitem": lambda: pl.check_duplicates(lineitem, LINE_KEY).collect(),
        "dup_topk_lineitem": lambda: pl.largest_duplicate_groups(lineitem, LINE_KEY).collect(),
        "dup_full_row_lineitem": lambda: pl.check_duplicates(lineitem).collect(),
        "dup_full_row_documents": lambda: pl.check_duplicates(documents).collect(),
        "types_dirty": lambda: pl.check_types(messy, DIRTY_SCHEMA).collect(),
        "rules_dirty": lambda: pl.check_rules(messy, DIRTY_RULES, reference_date=REFERENCE_DATE).collect(),
        "rule_examples_dirty": lambda: pl.rule_examples(
            messy, DIRTY_RULES, ["event_id"], reference_date=REFERENCE_DATE
        ).collect(),
        "sql_grouped_sum": lambda: grouped_sum(orders),
        "run_lineitem": lambda: pl.run_checks(lineitem, LINE_CONFIG).score.collect(),
        "auto_run_dirty": lambda: pl.auto_run(
            messy, "dirty", ["event_id"], REFERENCE_DATE
        ).result.verification.collect(),
    }
    wide = widened(orders, 300)
    compared = {
        "one_job_per_check_dirty": lambda: one_job_per_check(messy),
        "fused_dirty": lambda: fused(messy),
        "missing_300_columns": lambda: pl.check_missing(wide).collect(),
    }
    seconds = {}
    for name, query in {**queries, **compared}.items():
        query()
        times = []
        for _ in range(REPEAT):
            start = time.perf_counter()
            query()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    total = round(sum(seconds[name] for name in queries), 3)
    print(
        json.dumps(
            {
                "metric": "data_quality_headline_queries",
                "value": total,
                "unit": "sec",
                "queries": {name: seconds[name] for name in queries},
                "compared": {name: seconds[name] for name in compared},
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": CPUS,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
