"""Suggested checks, derived from column names, types and sample values.

The input has one row per column, of one table or of a whole catalog; see ``describe_tables``.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.parsing import DATE_PATTERN, NUMBER_PATTERN, TIME_TYPES, is_checkable
from plumbline.functions.text import WHITESPACE, is_boolean_word, strip
from plumbline.operators.profile import smallest_values
from plumbline.plans.config import Rule, RunConfig, SqlQuery
from plumbline.plans.table import Table

#: Sample values of each column that suggestions look at.
SAMPLES = 5

# Words in a column name, and what they say about the column.
DATE_WORDS = ("date", "datetime", "timestamp", "time")
AMOUNT_WORDS = ("amount", "price", "cost", "revenue", "sales", "total", "balance", "value")
COUNT_WORDS = ("quantity", "qty", "count", "number", "nb")
FLAG_WORDS = ("active", "enabled", "flag")
FLAG_PREFIXES = ("is_", "has_", "can_")
CATEGORY_WORDS = ("country", "city", "region", "status", "category", "segment", "type")

# How Spark names its types.
INTEGER_TYPES = ("tinyint", "smallint", "int", "bigint")
DAY_TYPES = ("date", "timestamp", "timestamp_ntz")


def describe_tables(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Rows ``(dataset, position, column_name, data_type, sample_values, boolean_words)`` for
    several tables; the last says whether all values there are read as a boolean.
    """
    return reduce(
        DataFrame.unionByName, [describe_table(df, name) for name, df in tables.items()]
    )


def describe_table(df: DataFrame, dataset: str = "dataset") -> DataFrame:
    """Samples and boolean words are found in one pass: that a column has other words is one more value
    to look for.
    """
    spark, table = df.sparkSession, Table.of(df)
    schema = spark.createDataFrame(
        [(i, n, kind.simpleString()) for i, (n, kind) in enumerate(zip(table.names, table.kinds, strict=True))],
        "position int, column_name string, data_type string",
    )
    found = spark.createDataFrame([], "position int, sample_rank int, sample_value string")
    if table.names:
        found = smallest_values(table, SAMPLES, _other_words(table))
    columns = len(table.names)
    of_column = F.col("position") < columns
    samples = F.array_sort(
        F.collect_list(F.when(of_column, F.struct("sample_rank", "sample_value")))
    )
    of_columns = found.groupBy(F.pmod("position", F.lit(columns or 1)).alias("position")).agg(
        F.bool_and(of_column).alias("boolean_words"),
        F.transform(samples, lambda sample: sample["sample_value"]).alias("sample_values"),
    )
    return schema.join(F.broadcast(of_columns), "position", "left").select(
        F.lit(dataset).alias("dataset"),
        "position",
        "column_name",
        "data_type",
        F.coalesce("boolean_words", F.lit(True)).alias("boolean_words"),
        F.coalesce("sample_values", F.array().cast("array<string>")).alias("sample_values"),
    )


def _other_words(table: Table) -> list[Column]:
    """For each column, 1 where its value is present and no word for a boolean, null elsewhere.

    Words for a boolean are compared as text only where the type leaves that open.
    """
    found = []
    for i, kind in enumerate(table.kinds):
        value = F.col(f"c{i}")
        if not is_checkable(kind):
            other = F.lit(True)
        elif isinstance(kind, T.BooleanType):
            other = F.lit(False)
        elif isinstance(kind, T.IntegralType):
            other = ~value.isin(0, 1)
        elif isinstance(kind, (T.FractionalType, *TIME_TYPES)) and not isinstance(kind, T.DecimalType):
            other = value.isNotNull()  # their text has a point or a dash
        else:
            other = ~is_boolean_word(value.cast("string"))
        found.append(F.when(other, F.lit(1)))
    return found


def described_samples(columns: DataFrame) -> DataFrame:
    """The rows of ``sample_values``, from a description."""
    return columns.select(
        "dataset", "position", "column_name", F.posexplode("sample_values").alias("rank", "sample_value")
    ).select(
        "dataset", "position", "column_name", (F.col("rank") + 1).alias("sample_rank"), "sample_value"
    )


class _Traits:
    """What a column's name, type and values say about it."""

    def __init__(self, columns: DataFrame):
        name = F.lower(strip(F.col("column_name")))
        self.name = F.btrim(F.regexp_replace(name, "[^a-z0-9]+", "_"), F.lit("_"))
        self.words = F.split(self.name, "_")
        kind = F.col("data_type")
        self.is_integer = kind.isin(*INTEGER_TYPES)
        self.is_fractional = kind.isin("float", "double") | kind.startswith("decimal")
        self.is_day = kind.isin(*DAY_TYPES)
        self.is_text = kind == "string"
        self.is_boolean = kind == "boolean"
        self.is_nested = kind.rlike("^(array|map|struct|binary|variant|interval)")

        self.names_id = self._has("id") | self.name.endswith("_identifier")
        self.names_date = self._has(*DATE_WORDS) | self.name.endswith("_at")
        self.names_age = self._has("age")
        self.names_amount = self._has(*AMOUNT_WORDS)
        self.names_count = self._has(*COUNT_WORDS)
        samples = F.col("sample_values")
        # Columns described by hand may have samples only.
        all_words = F.col("boolean_words") if "boolean_words" in columns.columns else F.lit(True)
        self.like_boolean = (
            self.is_boolean
            | reduce(Column.__or__, [self.name.startswith(p) for p in FLAG_PREFIXES])
            | self._has(*FLAG_WORDS)
            | ((F.size(samples) > 0) & F.forall(samples, is_boolean_word) & all_words)
        )
        self.is_category = ~self.names_date & (self._has(*CATEGORY_WORDS) | self.is_text)

    def _has(self, *words: str) -> Column:
        return F.arrays_overlap(self.words, F.array(*[F.lit(w) for w in words]))

    def expected_type(self) -> Column:
        return (
            F.when(self.names_date, "date")
            .when(self.names_age, "integer")
            .when(self.like_boolean, "boolean")
            .when(self.names_amount, "numeric")
            .when(self.names_count, "integer")
            .when(self.is_integer, "integer")
            .when(self.is_fractional, "numeric")
            .when(self.is_day, "date")
            .otherwise("string")
        )


def suggest_types(columns: DataFrame) -> DataFrame:
    """The expected type of every column that holds single values."""
    traits = _Traits(columns)
    return columns.filter(~traits.is_nested).select(
        "dataset",
        "position",
        "column_name",
        "data_type",
        traits.expected_type().alias("expected_type"),
    )


def suggest_keys(columns: DataFrame) -> DataFrame:
    """The first column of every table that looks like an identifier, null where there is none."""
    names_id = _Traits(columns).names_id
    return columns.groupBy("dataset").agg(
        F.min_by("column_name", F.when(names_id, F.col("position"))).alias("key_column")
    )


def suggest_rules(columns: DataFrame) -> DataFrame:
    """Rules that follow from column names; of several with one name, the first."""
    traits = _Traits(columns)

    def rule(applies, order, suffix, kind, low=None, high=None, allow_null=True, why=""):
        return F.when(
            applies,
            F.struct(
                F.lit(order).alias("rule_order"),
                F.concat(traits.name, F.lit(suffix)).alias("rule_name"),
                F.lit(kind).alias("rule_type"),
                F.lit(low).cast("double").alias("min_value"),
                F.lit(high).cast("double").alias("max_value"),
                F.lit(allow_null).alias("allow_null"),
                F.lit(why).alias("description"),
            ),
        )

    single = ~traits.is_nested
    suggested = F.array_compact(
        F.array(
            rule(
                traits.names_id, 0, "_required", "not_null", allow_null=False,
                why="rows are joined and traced by their identifier",
            ),
            rule(
                single & traits.names_age, 1, "_valid_range", "range", 0, 120,
                why="ages of people lie in a known range",
            ),
            rule(
                single & traits.names_amount, 2, "_non_negative", "non_negative",
                why="amounts are rarely negative",
            ),
            rule(
                single & traits.names_date, 3, "_not_future", "not_future_date",
                why="recorded dates lie in the past",
            ),
        )
    )
    first = Window.partitionBy("dataset", "rule_name").orderBy("position", "rule_order")
    return (
        columns.select("dataset", "position", "column_name", F.inline(suggested))
        .withColumn("nth", F.row_number().over(first))
        .filter("nth = 1")
        .drop("nth")
    )


# What the generated queries are made of. White space around values is stripped as everywhere else, and
# the cast alone would accept text such as '1d' or '2024'.
_STRIPPED = "BTRIM({c}, '%s')" % "".join(f"\\u{ord(c):04X}" for c in WHITESPACE)
TEXT_NUMBER = f"CASE WHEN {_STRIPPED} RLIKE '^(?:{NUMBER_PATTERN})$' THEN TRY_CAST({_STRIPPED} AS DOUBLE) END"
OTHER_NUMBER = "TRY_CAST({c} AS DOUBLE)"
TEXT_DAY = f"CASE WHEN {_STRIPPED} RLIKE '^(?:{DATE_PATTERN})$' THEN TRY_CAST({_STRIPPED} AS DATE) END"
OTHER_DAY = "TRY_CAST({c} AS DATE)"
NUMBER_SUMMARY = "SELECT MIN({c}) AS min_value, MAX({c}) AS max_value, AVG({c}) AS avg_value FROM dataset"
DAY_RANGE = "SELECT MIN({c}) AS min_date, MAX({c}) AS max_date FROM dataset"
DISTRIBUTION = (
    "SELECT {c} AS value, COUNT(*) AS row_count FROM dataset GROUP BY {c} ORDER BY row_count DESC, value"
)
TOTAL_ROWS = "SELECT COUNT(*) AS row_count FROM dataset"


def suggest_queries(
    columns: DataFrame,
    max_categorical_queries: int | None = 3,
    max_numeric_queries: int | None = 3,
    max_date_queries: int | None = 2,
) -> DataFrame:
    """Queries worth running on every table: its size, and per column a distribution or a range.

    The first columns of each kind get one, with None all of them.
    """
    traits = _Traits(columns)
    quoted = F.concat(
        F.lit("`"), F.replace(F.col("column_name"), F.lit("`"), F.lit("``")), F.lit("`")
    )
    number = F.when(traits.is_text, _fill(TEXT_NUMBER, quoted)).otherwise(_fill(OTHER_NUMBER, quoted))
    day = F.when(traits.is_text, _fill(TEXT_DAY, quoted)).otherwise(_fill(OTHER_DAY, quoted))

    def query(applies, order, kind, suffix, sql, what):
        return F.when(
            applies,
            F.struct(
                F.lit(order).alias("kind_order"),
                F.lit(kind).alias("kind"),
                F.concat(traits.name, F.lit(suffix)).alias("query_name"),
                sql.alias("sql"),
                F.concat(F.lit(what), F.col("column_name")).alias("description"),
            ),
        )

    numeric = ~traits.is_nested & traits.expected_type().isin("integer", "float", "numeric")
    per_column = F.array_compact(
        F.array(
            query(
                traits.is_category, 1, "distribution", "_distribution",
                _fill(DISTRIBUTION, quoted),
                "how often each value occurs in ",
            ),
            query(
                numeric, 2, "numeric_summary", "_numeric_summary",
                _fill(NUMBER_SUMMARY, number),
                "smallest, largest and average number in ",
            ),
            query(
                traits.names_date, 3, "date_range", "_date_range",
                _fill(DAY_RANGE, day),
                "first and last day in ",
            ),
        )
    )
    nth_of_kind = Window.partitionBy("dataset", "kind").orderBy("position")
    limit = (
        F.when(F.col("kind") == "distribution", F.lit(max_categorical_queries))
        .when(F.col("kind") == "numeric_summary", F.lit(max_numeric_queries))
        .otherwise(F.lit(max_date_queries))
    )
    chosen = (
        columns.select("dataset", "position", "column_name", F.inline(per_column))
        .withColumn("nth", F.row_number().over(nth_of_kind))
        .filter(limit.isNull() | (F.col("nth") <= limit))
        .drop("nth")
    )
    size = columns.groupBy("dataset").agg(
        F.lit(None).cast("int").alias("position"),
        F.lit(None).cast("string").alias("column_name"),
        F.lit(0).alias("kind_order"),
        F.lit("total_rows").alias("kind"),
        F.lit("total_rows").alias("query_name"),
        F.lit(TOTAL_ROWS).alias("sql"),
        F.lit("number of rows").alias("description"),
    )
    return size.unionByName(chosen)


def _fill(template: str, value: Column) -> Column:
    """The template with every ``{c}`` replaced by a text column."""
    parts = template.split("{c}")
    pieces = [F.lit(parts[0])]
    for part in parts[1:]:
        pieces += [value, F.lit(part)]
    return F.concat(*pieces)


def is_generated(query: SqlQuery, kind: T.DataType | None) -> bool:
    """Whether the text of a query is what is suggested for its kind and the type of its column."""
    name = "`" + (query.column_name or "").replace("`", "``") + "`"
    text = isinstance(kind, T.StringType)
    number, day = (TEXT_NUMBER, TEXT_DAY) if text else (OTHER_NUMBER, OTHER_DAY)
    generated = {
        "total_rows": TOTAL_ROWS,
        "distribution": DISTRIBUTION.replace("{c}", name),
        "numeric_summary": NUMBER_SUMMARY.replace("{c}", number.replace("{c}", name)),
        "date_range": DAY_RANGE.replace("{c}", day.replace("{c}", name)),
    }
    return query.sql == generated.get(query.kind)


def suggest_configs(
    columns: DataFrame,
    max_categorical_queries: int | None = 3,
    max_numeric_queries: int | None = 3,
    max_date_queries: int | None = 2,
) -> dict[str, RunConfig]:
    """All suggestions for every table as run configurations.

    ``columns`` should be settled. Only suggestions, a few rows per column, come to the driver.
    """
    suggestions = {
        "types": suggest_types(columns),
        "key": suggest_keys(columns),
        "rules": suggest_rules(columns),
        "queries": suggest_queries(
            columns, max_categorical_queries, max_numeric_queries, max_date_queries
        ),
    }
    rows = reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True),
        [table.withColumn("part", F.lit(part)) for part, table in suggestions.items()],
    ).collect()
    found: dict[str, dict[str, list]] = {}
    for row in rows:
        found.setdefault(row.dataset, {part: [] for part in suggestions})[row.part].append(row)
    return {dataset: _as_config(dataset, parts) for dataset, parts in found.items()}


def _as_config(dataset: str, parts: dict[str, list]) -> RunConfig:
    types = sorted(parts["types"], key=lambda row: row.position)
    rules = sorted(parts["rules"], key=lambda row: (row.position, row.rule_order))
    queries = sorted(parts["queries"], key=lambda row: (row.kind_order, row.position or 0))
    return RunConfig(
        dataset_name=dataset,
        duplicate_key_columns=[r.key_column for r in parts["key"] if r.key_column is not None] or None,
        expected_schema={row.column_name: row.expected_type for row in types},
        business_rules=[
            Rule(
                row.rule_name, row.column_name, row.rule_type, row.min_value, row.max_value,
                None, row.allow_null, row.description,
            )
            for row in rules
        ],
        sql_queries=[
            SqlQuery(row.query_name, row.sql, row.description, row.kind, row.column_name)
            for row in queries
        ],
    )


def suggest_config(
    columns: DataFrame,
    dataset: str = "dataset",
    max_categorical_queries: int | None = 3,
    max_numeric_queries: int | None = 3,
    max_date_queries: int | None = 2,
) -> RunConfig:
    """All suggestions for one table as a run configuration."""
    found = suggest_configs(
        columns.filter(F.col("dataset") == dataset),
        max_categorical_queries,
        max_numeric_queries,
        max_date_queries,
    )
    return found.get(dataset, RunConfig(dataset))


def suggestion_notes(config: RunConfig) -> list[str]:
    """What the suggestions found, in words."""
    key = ", ".join(config.duplicate_key_columns or ())
    return [
        f"key: {key}" if key else "no key found, whole rows are compared",
        f"expected types: {len(config.expected_schema or {})}",
        f"business rules: {len(config.business_rules)}",
        f"queries: {len(config.sql_queries)}",
    ]
