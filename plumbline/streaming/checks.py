"""Rules and types on a stream: every batch is split into valid and quarantined rows, and counted.

A batch is read once. Its rows are written below ``rows/batch_id=N/outcome=valid`` and ``=quarantined``, the
latter with what is wrong with them, and the same pass counts what the checks count. The counts
of a batch are a row of states below ``states/batch_id=N``; results are the sum over all batches. A batch
that is repeated after a failure has the same number and replaces what it wrote, so nothing is counted twice.

A batch counts from the moment its states are written, which is last; ``valid_rows`` and ``quarantined_rows``
show those of counted batches only.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.rules import violates
from plumbline.operators.types import is_invalid
from plumbline.plans.config import RunConfig
from plumbline.plans.states import CheckStates
from plumbline.plans.storage import settle
from plumbline.plans.table import Table

VALID, QUARANTINED = "valid", "quarantined"
#: Columns of the stored rows besides those of the stream.
PROBLEMS = "_problems"
OUTCOME, BATCH = "_outcome", "_batch_id"


def row_problems(checks: CheckStates) -> Column:
    """What is wrong with a row: the names of broken rules, and of columns of another type.

    An array of texts, in the order of the rules and then of the expected schema.
    """
    config, scan = checks.config, checks.scan
    found = [
        F.when(violates(scan, rule, checks.reference_date, checks.date_formats), rule.rule_name)
        for rule in config.business_rules
    ]
    found += [
        F.when(is_invalid(scan, name, expected, checks.date_formats), f"{name} is no {expected}")
        for name, expected in (config.expected_schema or {}).items()
    ]
    if not found:
        raise ValueError("a stream needs rules or an expected schema to be split by")
    return F.array_compact(F.array(*found))


class StreamChecks:
    """The checks of a stream with the given schema, stored below ``path``."""

    def __init__(
        self,
        spark: SparkSession,
        schema: T.StructType,
        path: str,
        config: RunConfig,
        reference_date: date | None = None,
        date_formats: tuple[str, ...] = (),
        **thresholds,
    ) -> None:
        clashing = {PROBLEMS, OUTCOME, BATCH} & set(schema.names)
        if clashing:
            raise ValueError(f"columns of these names are added to stored rows: {sorted(clashing)}")
        self.spark, self.schema, self.path, self.config = spark, schema, path, config
        # A stream that goes on past midnight judges all its rows by the day it was set up for.
        self.options = {
            "reference_date": reference_date or date.today(),
            "date_formats": date_formats,
            **thresholds,
        }
        self.checks = self._checks(spark.createDataFrame([], schema))
        self.state_schema = T.StructType(
            [T.StructField(label, T.LongType()) for label in self.checks.scan.labels]
        )
        self.row_schema = T.StructType([*schema.fields, T.StructField(PROBLEMS, T.ArrayType(T.StringType()))])
        row_problems(self.checks)  # nothing to split by fails here

    def _checks(self, df: DataFrame) -> CheckStates:
        return CheckStates(Table.of(df), self.config, **self.options)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Split and count one batch; for ``foreachBatch``."""
        checks = self._checks(batch)
        problems = row_problems(checks)
        names = list(checks.table.names)
        seen = Observation()
        judged = checks.scan.row_values().withColumn(PROBLEMS, problems)
        counted = judged.observe(seen, *checks.scan.aggregates())
        outcome = F.when(F.size(PROBLEMS) == 0, VALID).otherwise(QUARANTINED).alias(OUTCOME)
        kept = counted.select(
            *[F.col(f"c{i}").alias(name) for i, name in enumerate(names)], PROBLEMS, outcome
        )
        target = f"{self.path}/rows/{BATCH}={batch_id}"
        kept.write.mode("overwrite").partitionBy(OUTCOME).parquet(target)
        states = [tuple(int(seen.get[label]) for label in checks.scan.labels)]
        (
            batch.sparkSession.createDataFrame(states, self.state_schema)
            .coalesce(1)
            .write.mode("overwrite")
            .parquet(f"{self.path}/states/{BATCH}={batch_id}")
        )

    def start(
        self, stream: DataFrame, checkpoint: str | None = None, available_now: bool = True, **trigger
    ) -> StreamingQuery:
        """Start checking a stream: what there is by now, or on and on with the trigger given."""
        if stream.schema.names != self.schema.names:
            raise ValueError("the stream has other columns than the checks were made for")
        timing = {"availableNow": True} if available_now and not trigger else trigger
        writer = (
            stream.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", checkpoint or f"{self.path}/checkpoint")
        )
        return (writer.trigger(**timing) if timing else writer).start()

    def states(self) -> DataFrame:
        """The states of every counted batch."""
        return self._stored("states", self.state_schema)

    def results(self) -> dict[str, DataFrame]:
        """counts, missing, types, rules and their summaries over all counted batches."""
        one_row = settle(self.checks.results(self.checks.merged(self.states())))
        return self.checks.tables(one_row)

    def by_batch(self, part: str) -> DataFrame:
        """The rows of one check for each batch, told by ``batch_id``."""
        rows = self.checks.results(self.states(), BATCH)
        return rows.select(F.col(BATCH).alias("batch_id"), "dataset", F.inline(part))

    def valid_rows(self) -> DataFrame:
        """The rows nothing is wrong with, with the columns of the stream."""
        return self._rows(VALID).select(*[f"`{name}`" for name in self._escaped()])

    def quarantined_rows(self) -> DataFrame:
        """The other rows, with ``_problems`` and ``_batch_id``."""
        return self._rows(QUARANTINED).drop(OUTCOME)

    def _escaped(self) -> list[str]:
        return [name.replace("`", "``") for name in self.schema.names]

    def _rows(self, outcome: str) -> DataFrame:
        counted = self.states().select(BATCH)
        found = self._stored("rows", T.StructType([*self.row_schema.fields, T.StructField(OUTCOME, T.StringType())]))
        return found.filter(F.col(OUTCOME) == outcome).join(F.broadcast(counted), BATCH, "left_semi")

    def _stored(self, name: str, schema: T.StructType) -> DataFrame:
        """The stored table, empty before the first batch."""
        where = f"{self.path}/{name}"
        full = T.StructType([*schema.fields, T.StructField(BATCH, T.LongType())])
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], full)
        return self.spark.read.schema(full).parquet(where)


def check_stream(
    stream: DataFrame,
    path: str,
    config: RunConfig,
    **options,
) -> StreamChecks:
    """Check all that a stream has by now, and wait for it."""
    checks = StreamChecks(stream.sparkSession, stream.schema, path, config, **options)
    checks.start(stream).awaitTermination()
    return checks
