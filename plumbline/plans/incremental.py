"""Checks of a folder of Parquet files that grows: only files not seen before are read.

Every file has states of its own, counts that add up to those of the table, and its keys' hashes with how
often they occur. Both are stored below

    <store>/<fingerprint>/keys/batch=<id>/      file, two hashes, copies
    <store>/<fingerprint>/states/batch=<id>/    file, modified, length, and a column for each count

where the fingerprint stands for everything that the counts depend on: another configuration, schema or
reference date starts anew. A file is known by path, time of change and length; a file that changed is
read again, one that is gone no longer counts. States are written last, so a batch that failed halfway was
never there, and its leftovers are not looked at.

Results are sums over the states of the files there are. Duplicates are found from the stored hashes, which are
read again each time, some 40 bytes for each key and file, but never the files. Two hashes of 64 bits stand
for a key; different keys agree in both with a chance of about n * n / 2 ** 129 for n keys.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.grading import check_status, percent, severity
from plumbline.functions.hashing import key_hashes, key_value
from plumbline.operators.scoring import score_components, score_recommendations, score_totals
from plumbline.plans.config import RunConfig
from plumbline.plans.facts import collect_facts
from plumbline.plans.states import CheckStates
from plumbline.plans.storage import settle, side_by_side
from plumbline.plans.table import Table

#: Paths of new files that the driver holds at a time.
FILES_AT_A_TIME = 10_000
VERSION = ("file", "modified", "length")
_VERSION_SCHEMA = [
    T.StructField("file", T.StringType()),
    T.StructField("modified", T.TimestampType()),
    T.StructField("length", T.LongType()),
]
_KEYS = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("hash", T.LongType()),
        T.StructField("other_hash", T.LongType()),
        T.StructField("copies", T.LongType()),
        T.StructField("batch", T.StringType()),
    ]
)


@dataclass(frozen=True)
class IncrementalResult:
    """Result tables as of a run, and how many files were read for it or known before."""

    tables: dict[str, DataFrame]
    files_read: int
    files_known: int


class CheckStore:
    """Stored states of the Parquet files below ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        store: str,
        config: RunConfig | None = None,
        reference_date: date | None = None,
        date_formats: tuple[str, ...] = (),
        warning_threshold: float = 1.0,
        high_threshold: float = 5.0,
        missing_thresholds: tuple[float, float] = (5.0, 20.0),
        schema: T.StructType | None = None,
        files_at_a_time: int = FILES_AT_A_TIME,
    ) -> None:
        self.spark, self.path = spark, path
        self.config = config or RunConfig()
        self.thresholds = (warning_threshold, high_threshold)
        self.files_at_a_time = files_at_a_time
        self.schema = schema or spark.read.parquet(path).schema  # of one file, unless given
        self._check = partial(
            CheckStates,
            config=self.config,
            reference_date=reference_date or date.today(),
            date_formats=date_formats,
            warning_threshold=warning_threshold,
            high_threshold=high_threshold,
            missing_thresholds=missing_thresholds,
        )
        self.checks = self._check(Table.of(spark.createDataFrame([], self.schema)))
        table = self.checks.table
        table.require(self.config.duplicate_key_columns or (), "duplicate key")
        self.keys = list(self.config.duplicate_key_columns or table.names)
        self.store = f"{store}/{self.checks.fingerprint()}"
        self.state_schema = T.StructType(
            [
                *_VERSION_SCHEMA,
                *[T.StructField(label, T.LongType()) for label in self.checks.scan.labels],
                T.StructField("batch", T.StringType()),
            ]
        )

    def files(self) -> DataFrame:
        """path, and file, modified and length of every file there is; no file is opened."""
        listed = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet")
        return listed.option("recursiveFileLookup", "true").load(self.path).select(
            "path",
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_modification_time").alias("modified"),
            F.col("_metadata.file_size").alias("length"),
        )

    def states(self) -> DataFrame:
        """The states of every version of a file that was ever read, once."""
        found = self._stored("states", self.state_schema)
        # A batch that was done twice has the same counts in each.
        labels = [F.first(label).alias(label) for label in self.checks.scan.labels]
        return found.groupBy(*VERSION, "batch").agg(*labels).groupBy(*VERSION).agg(
            F.min("batch").alias("batch"),
            *[F.min_by(label, "batch").alias(label) for label in self.checks.scan.labels],
        )

    def run(self) -> IncrementalResult:
        """Read new and changed files, and give the results over all there are."""
        there = settle(self.files())
        known = self.states().select(*VERSION)
        new = settle(there.join(known, list(VERSION), "left_anti"))
        read = 0
        for chunk in self._chunks(new):
            self._read(new, chunk)
            read += len(chunk)
        return IncrementalResult(self._results(there), read, there.count() - read)

    def _chunks(self, new: DataFrame) -> Iterator[list[str]]:
        chunk: list[str] = []
        for row in new.select("path").toLocalIterator():
            chunk.append(row[0])
            if len(chunk) == self.files_at_a_time:
                yield chunk
                chunk = []
        if chunk:
            yield chunk

    def _read(self, new: DataFrame, paths: list[str]) -> None:
        df = self.spark.read.schema(self.schema).option("basePath", self.path).parquet(*paths)
        df = df.select("*", F.col("_metadata.file_path"))
        table = Table.of(df, carried=1)
        file = F.col("carried_0").alias("file")
        checks = self._check(table)
        kinds = [table.kind(name) for name in self.keys]
        values = [key_value(table.column(n), kind) for n, kind in zip(self.keys, kinds, strict=True)]
        one, other = key_hashes(values, kinds)
        keys = (
            table.frame.select(file, one.alias("hash"), other.alias("other_hash"))
            .groupBy("file", "hash", "other_hash")
            .agg(F.count(F.lit(1)).alias("copies"))
        )
        # A file without rows has states too, or it would be read again and again.
        versions = new.filter(F.col("path").isin(paths)).select(*VERSION)
        counted = versions.join(checks.of_rows(file), "file", "left").fillna(0, checks.scan.labels)
        batch = uuid.uuid4().hex
        keys.write.parquet(f"{self.store}/keys/batch={batch}")
        counted.select(*VERSION, *checks.scan.labels).write.parquet(f"{self.store}/states/batch={batch}")

    def _results(self, there: DataFrame) -> dict[str, DataFrame]:
        current = settle(self.states().join(there.select(*VERSION), list(VERSION), "left_semi"))
        one_row, duplicates = side_by_side(
            self.spark,
            [
                lambda: settle(self.checks.results(self.checks.merged(current))),
                lambda: settle(self._duplicates(current)),
            ],
        )
        tables = self.checks.tables(one_row) | {"duplicates": duplicates}
        facts = settle(
            collect_facts(
                tables["counts"],
                tables["missing_summary"],
                duplicates,
                tables.get("type_summary"),
                tables.get("rule_summary"),
            )
        )
        components = score_components(facts)
        return tables | {
            "facts": facts,
            "score_components": components,
            "score": score_totals(components),
            "score_recommendations": score_recommendations(components),
        }

    def _duplicates(self, current: DataFrame) -> DataFrame:
        stored = self._stored("keys", _KEYS)
        copies = (
            stored.join(current.select("file", "batch"), ["file", "batch"], "left_semi")
            .groupBy("hash", "other_hash")
            .agg(F.sum("copies").alias("copies"))
        )
        repeated = F.col("copies") > 1
        counts = copies.agg(
            F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("row_count"),
            F.coalesce(F.sum(F.when(repeated, F.col("copies"))), F.lit(0)).cast("long").alias("duplicate_row_count"),
            F.count_if(repeated).alias("duplicate_group_count"),
        )
        graded = counts.withColumn(
            "duplicate_percentage", percent(F.col("duplicate_row_count"), F.col("row_count"))
        ).withColumn("severity", severity(F.col("duplicate_percentage"), *self.thresholds))
        scope = "key_columns" if self.config.duplicate_key_columns else "full_row"
        return graded.select(
            F.lit(self.config.dataset_name).alias("dataset"),
            check_status(F.col("duplicate_row_count"), F.col("severity") == "high").alias("status"),
            F.lit(scope).alias("scope"),
            F.array(*map(F.lit, self.keys)).alias("key_columns"),
            *counts.columns,
            "duplicate_percentage",
            "severity",
        )

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}")
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.store}/{name}")

    def forget_unused(self) -> int:
        """Delete the batches of which no file is left, and say how many; for a store that has grown old."""
        used = self.states().join(self.files().select(*VERSION), list(VERSION), "left_semi")
        stored = self._stored("states", self.state_schema).select("batch").distinct()
        unused = [r[0] for r in stored.join(used.select("batch"), "batch", "left_anti").collect()]
        for batch in unused:
            for name in ("states", "keys"):
                where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.store}/{name}/batch={batch}")
                where.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(where, True)
        return len(unused)


def incremental_run(
    spark: SparkSession, path: str, store: str, config: RunConfig | None = None, **options
) -> IncrementalResult:
    """Check the Parquet files below ``path``, reading only those that ``store`` doesn't know yet."""
    return CheckStore(spark, path, store, config, **options).run()
