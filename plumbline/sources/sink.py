"""Result tables on shared storage."""

from __future__ import annotations

from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.plans.run import RunResult
from plumbline.plans.storage import side_by_side

KEY = ("run_id", "dataset")


def write_result(result: RunResult, path: str, run_id: str, run_date: date | None = None) -> None:
    """Write every table of a run and its report below ``path``, partitioned by run and dataset.

    Writing the run of a dataset again, on whatever day, replaces what it wrote before, drops the
    tables it no longer has, and leaves all other runs and datasets alone. ``run_date`` is a column.
    """
    spark = result.facts.sparkSession
    day = F.lit(run_date or date.today())
    dataset = result.config.dataset_name

    def write(name: str, table: DataFrame) -> None:
        # A table has a few rows per column, rule or query, so one file each is enough.
        (
            table.coalesce(1)
            .withColumns({"run_date": day, "run_id": F.lit(run_id), "dataset": F.lit(dataset)})
            .write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic")
            .partitionBy(*KEY)
            .parquet(f"{path}/{name}")
        )

    tables = {**result.tables(), "report": result.report()}
    # Writing replaces a partition as a whole, so a failure leaves the earlier rows or the new ones.
    side_by_side(spark, [partial(write, name, table) for name, table in tables.items()])
    # A table without rows writes no partition, and one that the run lacks nothing at all; what was
    # stored of those goes last.
    empty = side_by_side(spark, [table.isEmpty for table in tables.values()])
    written = {name for name, none in zip(tables, empty, strict=True) if not none}
    for name in {*RunResult.__dataclass_fields__, "report"} - {"config"} - written:
        _drop_partition(spark, f"{path}/{name}", run_id, dataset)


def _drop_partition(spark: SparkSession, table_path: str, run_id: str, dataset: str) -> None:
    escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName
    folder = f"{table_path}/run_id={escape(run_id)}/dataset={escape(dataset)}"
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_result(
    spark: SparkSession, path: str, name: str, run_id: str | None = None, dataset: str | None = None
) -> DataFrame:
    """A stored table, of one run or dataset or of all."""
    where = f"{path}/{name}"
    fields = [
        T.StructField(f.name, T.StringType()) if f.name in KEY else f
        for f in spark.read.parquet(where).schema.fields
    ]
    # Told the schema, Spark does not take a run named 07 for the number 7.
    table = spark.read.schema(T.StructType(fields)).parquet(where)
    for column, value in zip(KEY, (run_id, dataset), strict=True):
        if value is not None:
            table = table.filter(F.col(column) == value)
    return table
