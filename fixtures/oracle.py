"""SQL that computes the same results as the registered queries, for comparison in DuckDB."""

from __future__ import annotations

from fixtures.queries import BATCH, LINE_KEY, QUANTILES, RUN_DAY, SQL
from fixtures.tables import DIRTY, DIRTY_COLUMNS, DIRTY_RULES, DIRTY_SCHEMA, JSON_VALUES
from plumbline.operators.suggest import TEXT_DAY

# What counts as a number, a date and a boolean here, said once more and not taken from the library.
NUMBER_PATTERN = "[-+]?([0-9]+|[0-9]+[.][0-9]*|[.][0-9]+)([eE][-+]?[0-9]+)?"
DATE_PATTERN = "[0-9]{4}-[0-9]{2}-[0-9]{2}( [0-9]{2}:[0-9]{2}:[0-9]{2})?"
BOOLEAN_WORDS = ("y", "yes", "true", "1", "n", "no", "false", "0")

DAY = "DATE '2026-01-01'"

DIRTY_CTE = f"""
dirty AS ({DIRTY.format(S="VARCHAR", T="events")}),
d AS (SELECT record_id, event_id, user_id, age, signup_date, status, amount,
  CASE WHEN isnan(reading) THEN NULL ELSE reading END AS reading, is_active FROM dirty)
"""

# What the suggestions make of the dirty table, worked out by hand.
AUTO_SCHEMA = {
    "record_id": "integer", "event_id": "integer", "user_id": "integer", "age": "integer",
    "signup_date": "date", "status": "string", "amount": "numeric", "reading": "numeric",
    "is_active": "boolean",
}
AUTO_RULES = (
    ("record_id_required", "record_id", "not_null", "record_id IS NULL", "expected a value"),
    ("event_id_required", "event_id", "not_null", "event_id IS NULL", "expected a value"),
    ("user_id_required", "user_id", "not_null", "user_id IS NULL", "expected a value"),
    ("age_valid_range", "age", "range", None, "expected a number from 0 to 120"),
    ("signup_date_not_future", "signup_date", "not_future_date", None, "expected a date up to the reference date"),
    ("amount_non_negative", "amount", "non_negative", "amount < 0", "expected zero or a number above"),
)


def words(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def names(values) -> str:
    """A JSON list of names."""
    return '["' + '","'.join(values) + '"]'


def pct(part: str, whole: str) -> str:
    """Percentage with two decimals, rounded from the exact binary value, ties to even."""
    return f"""CASE WHEN ({whole}) = 0 THEN 0.0::DOUBLE ELSE (
      SELECT (k + CASE WHEN past > 0 OR (past = 0 AND k % 2 = 1) THEN 1 ELSE 0 END)::DOUBLE / 100.0::DOUBLE
      FROM (SELECT k, (hi * 200.0::DOUBLE - (2 * k + 1)::DOUBLE) + (x - hi) * 200.0::DOUBLE AS past
      FROM (SELECT x, floor(x * 100.0::DOUBLE)::BIGINT AS k,
              x * 134217729.0::DOUBLE - (x * 134217729.0::DOUBLE - x) AS hi
      FROM (SELECT ({part})::DOUBLE / ({whole})::DOUBLE * 100.0::DOUBLE AS x)))) END"""


def severity(share: str, warning: float, high: float) -> str:
    return (
        f"CASE WHEN {share} = 0 THEN 'ok' WHEN {share} <= {warning} THEN 'low' "
        f"WHEN {share} <= {high} THEN 'medium' ELSE 'high' END"
    )


def status(total: str, any_high: str) -> str:
    return f"CASE WHEN {total} = 0 THEN 'passed' WHEN {any_high} THEN 'failed' ELSE 'warning' END"


def count_if(condition: str) -> str:
    return f"CAST(count(CASE WHEN {condition} THEN 1 END) AS BIGINT)"


def union(selects: list[str]) -> str:
    return "\nUNION ALL ".join(selects)


# --- missing values, profile ---


def missing_rows(dataset: str) -> str:
    counted = union(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, count(*) AS row_count, "
            f"count(*) - count({c}) AS null_count FROM d"
            for i, c in enumerate(DIRTY_COLUMNS)
        ]
    )
    return f"""SELECT '{dataset}' AS dataset, *, {severity("null_percentage", 5, 20)} AS severity
      FROM (SELECT *, {pct("null_count", "row_count")} AS null_percentage FROM ({counted}))"""


def missing_totals(dataset: str) -> str:
    return f"""SELECT '{dataset}' AS dataset, {status("sum(null_count)", "bool_or(severity = 'high')")} AS status,
      CAST(sum(null_count) AS BIGINT) AS total_missing_values, count(*) AS columns_checked,
      {count_if("null_count > 0")} AS columns_with_missing_values FROM ({missing_rows(dataset)})"""


def profile_rows(dataset: str) -> str:
    counted = union(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, '{t}' AS data_type, "
            f"count({c}) AS non_null_count, count(*) - count({c}) AS null_count FROM d"
            for i, (c, t) in enumerate(DIRTY_COLUMNS.items())
        ]
    )
    return f"""SELECT '{dataset}' AS dataset, non_null_count + null_count AS row_count,
      CAST({len(DIRTY_COLUMNS)} AS BIGINT) AS column_count, *,
      {pct("null_count", "non_null_count + null_count")} AS null_percentage FROM ({counted})"""


def sample_rows(dataset: str = "dataset") -> str:
    parts = []
    for i, (c, kind) in enumerate(DIRTY_COLUMNS.items()):
        order = "v" if kind != "string" else "CAST(v AS VARCHAR)"
        parts.append(
            f"SELECT * FROM (SELECT '{dataset}' AS dataset, {i} AS position, '{c}' AS column_name, "
            f"CAST(row_number() OVER (ORDER BY {order}) AS INTEGER) AS sample_rank, "
            f"CAST(v AS VARCHAR) AS sample_value "
            f"FROM (SELECT DISTINCT {c} AS v FROM d WHERE {c} IS NOT NULL)) WHERE sample_rank <= 5"
        )
    return union(parts)


# Ids that a double can't tell apart, of both signs.
LARGE_INTS_SAMPLES = """
WITH x AS (SELECT event_id - 4611686018427387904 AS low, 4611686018427387904 + event_id AS high FROM events)
SELECT 'dataset' AS dataset, 0 AS position, 'low' AS column_name, CAST(n AS INTEGER) AS sample_rank, CAST(low AS VARCHAR) AS sample_value
FROM (SELECT low, row_number() OVER (ORDER BY low) AS n FROM (SELECT DISTINCT low FROM x)) WHERE n <= 5
UNION ALL SELECT 'dataset', 1, 'high', CAST(n AS INTEGER), CAST(high AS VARCHAR)
FROM (SELECT high, row_number() OVER (ORDER BY high) AS n FROM (SELECT DISTINCT high FROM x)) WHERE n <= 5
"""

# Values of 1e7 and more, in text with tabs; the average of whole numbers below 2 ** 53 is compared rounded.
NUMERIC_TEXT_ROWS = """
SELECT min(event_id + 20000000.0) AS min_value, max(event_id + 20000000.0) AS max_value,
  round(avg(event_id + 20000000.0), 3) AS avg_value, 1 AS n FROM events
"""


# --- duplicates ---


def duplicate_totals(dataset: str, source: str, keys, scope: str) -> str:
    listed = ", ".join(keys)
    return f"""SELECT '{dataset}' AS dataset, {status("duplicate_row_count", "severity = 'high'")} AS status,
      '{scope}' AS scope, '{names(keys)}' AS key_columns, row_count, duplicate_row_count,
      duplicate_percentage, duplicate_group_count, severity
      FROM (SELECT *, {severity("duplicate_percentage", 1, 5)} AS severity
      FROM (SELECT *, {pct("duplicate_row_count", "row_count")} AS duplicate_percentage
      FROM (SELECT CAST(sum(n) AS BIGINT) AS row_count,
        CAST(coalesce(sum(CASE WHEN n > 1 THEN n END), 0) AS BIGINT) AS duplicate_row_count,
        {count_if("n > 1")} AS duplicate_group_count
      FROM (SELECT {listed}, count(*) AS n FROM {source} GROUP BY {listed}))))"""


def duplicate_top(dataset: str, source: str, keys) -> str:
    listed = ", ".join(keys)
    texts = ", ".join(f"'{k}', coalesce(CAST({k} AS VARCHAR), '<missing>')" for k in keys)
    return f"""SELECT '{dataset}' AS dataset, group_rank, duplicate_key, duplicate_count
      FROM (SELECT CAST(row_number() OVER (ORDER BY n DESC, {listed}) AS INTEGER) AS group_rank,
        CAST(json_object({texts}) AS VARCHAR) AS duplicate_key, n AS duplicate_count
      FROM (SELECT {listed}, count(*) AS n FROM {source} GROUP BY {listed} HAVING count(*) > 1))
      WHERE group_rank <= 10"""


# --- types ---


def invalid(column: str, expected: str) -> str:
    text = DIRTY_COLUMNS[column] == "string"
    if expected == "string":
        bad = "FALSE"
    elif expected == "boolean":
        bad = f"lower(trim(CAST({column} AS VARCHAR))) NOT IN ({words(BOOLEAN_WORDS)})"
    elif expected == "date":
        bad = (
            f"NOT regexp_full_match(trim({column}), '{DATE_PATTERN}') "
            f"OR TRY_CAST(trim({column}) AS TIMESTAMP) IS NULL"
        )
    elif not text:
        bad = f"{column} % 1 <> 0" if expected == "integer" else "FALSE"
    else:
        bad = f"NOT regexp_full_match(trim({column}), '{NUMBER_PATTERN}')"
        if expected == "integer":
            bad += f" OR TRY_CAST(trim({column}) AS DOUBLE) % 1 <> 0"
    return f"{column} IS NOT NULL AND ({bad})"


def type_rows(dataset: str, schema: dict[str, str]) -> str:
    counted = union(
        [
            f"SELECT {i} AS position, '{c}' AS column_name, '{e}' AS expected_type, "
            f"'{DIRTY_COLUMNS[c]}' AS data_type, count({c}) AS non_null_count, "
            f"{count_if(invalid(c, e))} AS invalid_count FROM d"
            for i, (c, e) in enumerate(schema.items())
        ]
    )
    return f"""SELECT '{dataset}' AS dataset, *, {severity("invalid_percentage", 1, 5)} AS severity
      FROM (SELECT *, {pct("invalid_count", "non_null_count")} AS invalid_percentage FROM ({counted}))"""


def type_totals(dataset: str, schema: dict[str, str]) -> str:
    return f"""SELECT '{dataset}' AS dataset, {status("sum(invalid_count)", "bool_or(severity = 'high')")} AS status,
      count(*) AS columns_checked, {count_if("invalid_count > 0")} AS columns_with_invalid_values,
      CAST(sum(invalid_count) AS BIGINT) AS total_invalid_values,
      CAST(sum(non_null_count) AS BIGINT) AS total_checked_values
      FROM ({type_rows(dataset, schema)})"""


def type_examples(dataset: str, schema: dict[str, str]) -> str:
    return union(
        [
            f"SELECT * FROM (SELECT '{dataset}' AS dataset, '{c}' AS column_name, "
            f"'{e}' AS expected_type, "
            f"CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS example_rank, "
            f"CAST(event_id AS VARCHAR) AS row_label, CAST({c} AS VARCHAR) AS value "
            f"FROM d WHERE {invalid(c, e)}) WHERE example_rank <= 10"
            for c, e in schema.items()
        ]
    )


# --- rules ---

AGE = f"CASE WHEN regexp_full_match(trim(age), '{NUMBER_PATTERN}') THEN TRY_CAST(trim(age) AS DOUBLE) END"
SIGNUP = f"CASE WHEN regexp_full_match(trim(signup_date), '{DATE_PATTERN}') THEN CAST(TRY_CAST(trim(signup_date) AS TIMESTAMP) AS DATE) END"
AGE_OUT = f"(({AGE}) IS NULL OR ({AGE}) < 0 OR ({AGE}) > 120)"
SIGNUP_LATE = f"signup_date IS NOT NULL AND (({SIGNUP}) IS NULL OR ({SIGNUP}) > {DAY})"

VIOLATIONS = {
    "user_id_required": "user_id IS NULL",
    "age_in_range": f"age IS NOT NULL AND {AGE_OUT}",
    "age_known_in_range": f"age IS NULL OR {AGE_OUT}",
    "age_at_most": f"age IS NOT NULL AND (({AGE}) IS NULL OR ({AGE}) > 100)",
    "amount_positive": "amount <= 0",
    "amount_non_negative": "amount < 0",
    "status_known": "trim(status) NOT IN ('click', 'view', 'purchase', 'signup')",
    "signup_not_future": SIGNUP_LATE,
    "age_valid_range": f"age IS NOT NULL AND {AGE_OUT}",
    "signup_date_not_future": SIGNUP_LATE,
}
MESSAGES = {
    "user_id_required": "expected a value",
    "age_in_range": "expected a number from 0 to 120",
    "age_known_in_range": "expected a number from 0 to 120",
    "age_at_most": "expected at most 100",
    "amount_positive": "expected a number above zero",
    "amount_non_negative": "expected zero or a number above",
    "status_known": "expected one of the allowed values",
    "signup_not_future": "expected a date up to the reference date",
}
# (name, column, kind, condition, message)
DIRTY_RULE_ROWS = [
    (r.rule_name, r.column_name, r.rule_type, VIOLATIONS[r.rule_name], MESSAGES[r.rule_name])
    for r in DIRTY_RULES
]
AUTO_RULE_ROWS = [(n, c, k, v or VIOLATIONS[n], m) for n, c, k, v, m in AUTO_RULES]


def rule_rows(dataset: str, rules) -> str:
    counted = union(
        [
            f"SELECT {i} AS position, '{name}' AS rule_name, '{column}' AS column_name, "
            f"'{kind}' AS rule_type, count(*) AS row_count, "
            f"{count_if(condition)} AS violation_count FROM d"
            for i, (name, column, kind, condition, _) in enumerate(rules)
        ]
    )
    return f"""SELECT '{dataset}' AS dataset, *, {severity("violation_percentage", 1, 5)} AS severity,
      CASE WHEN violation_count = 0 THEN 'passed' ELSE 'failed' END AS status
      FROM (SELECT *, {pct("violation_count", "row_count")} AS violation_percentage FROM ({counted}))"""


def rule_totals(dataset: str, rules) -> str:
    return f"""SELECT '{dataset}' AS dataset, {status("sum(violation_count)", "bool_or(severity = 'high')")} AS status,
      count(*) AS rules_checked, {count_if("violation_count > 0")} AS rules_with_violations,
      CAST(sum(violation_count) AS BIGINT) AS total_violations FROM ({rule_rows(dataset, rules)})"""


def rule_examples(dataset: str, rules) -> str:
    return union(
        [
            f"SELECT * FROM (SELECT '{dataset}' AS dataset, '{name}' AS rule_name, "
            f"'{column}' AS column_name, "
            f"CAST(row_number() OVER (ORDER BY event_id) AS INTEGER) AS example_rank, "
            f"CAST(event_id AS VARCHAR) AS row_label, "
            f"coalesce(CAST({column} AS VARCHAR), '<missing>') AS value, '{message}' AS message "
            f"FROM d WHERE {condition}) WHERE example_rank <= 10"
            for name, column, kind, condition, message in rules
        ]
    )


def one_rule(name: str) -> str:
    chosen = [row for row in DIRTY_RULE_ROWS if row[0] == name]
    return f"""WITH {DIRTY_CTE} SELECT rule_name, column_name, rule_type, status, row_count,
      violation_count, violation_percentage, severity FROM ({rule_rows("dataset", chosen)})"""


# --- the suggested run over the dirty table ---

AUTO_QUERIES = [
    ("total_rows", "SELECT COUNT(*) AS row_count FROM dataset", ["row_count"]),
    *[
        (
            f"{c}_distribution",
            f"SELECT `{c}` AS value, COUNT(*) AS row_count FROM dataset "
            f"GROUP BY `{c}` ORDER BY row_count DESC, value",
            ["value", "row_count"],
        )
        for c in ("age", "status", "is_active")
    ],
    *[
        (
            f"{c}_numeric_summary",
            f"SELECT MIN(TRY_CAST(`{c}` AS DOUBLE)) AS min_value, MAX(TRY_CAST(`{c}` AS DOUBLE)) AS max_value, "
            f"AVG(TRY_CAST(`{c}` AS DOUBLE)) AS avg_value FROM dataset",
            ["min_value", "max_value", "avg_value"],
        )
        for c in ("record_id", "event_id", "user_id")
    ],
]
# The text of the query itself, which a run reports.
_DAY_SQL = TEXT_DAY.replace("{c}", "`signup_date`")
AUTO_QUERIES.append(
    (
        "signup_date_date_range",
        f"SELECT MIN({_DAY_SQL}) AS min_date, MAX({_DAY_SQL}) AS max_date FROM dataset",
        ["min_date", "max_date"],
    )
)


def _distributions(table: str, columns: list[str], most: int) -> str:
    return union(
        [
            f"SELECT '{table}' AS dataset, '{c}' AS column_name, CAST(n AS INTEGER) AS value_rank, "
            f"CAST({c} AS VARCHAR) AS value, row_count, value_count FROM (SELECT *, count(*) OVER () AS value_count, "
            f"row_number() OVER (ORDER BY row_count DESC, {c} ASC NULLS FIRST) AS n "
            f"FROM (SELECT {c}, count(*) AS row_count FROM {table} GROUP BY {c})) WHERE n <= {most}"
            for c in columns
        ]
    )


def _distribution(column: str) -> str:
    return f"SELECT {column} AS value, count(*) AS row_count FROM d GROUP BY {column}"


def auto_sql_rows() -> str:
    """Shown rows of the suggested queries, each as JSON text with sorted names."""
    parts = ["SELECT 'total_rows' AS query_name, 1 AS row_number, CAST(json_object('row_count', CAST(count(*) AS VARCHAR)) AS VARCHAR) AS row FROM d"]
    parts += [
        f"SELECT '{c}_distribution', n, CAST(json_object('row_count', CAST(row_count AS VARCHAR), 'value', coalesce(value, '')) AS VARCHAR) "
        f"FROM (SELECT *, row_number() OVER (ORDER BY row_count DESC, value ASC NULLS FIRST) AS n FROM ({_distribution(c)})) WHERE n <= 50"
        for c in ("age", "status", "is_active")
    ]
    parts += [
        f"SELECT '{c}_numeric_summary', 1, CAST(json_object('avg_value', CAST(avg(CAST({c} AS DOUBLE)) AS VARCHAR), "
        f"'max_value', CAST(max(CAST({c} AS DOUBLE)) AS VARCHAR), 'min_value', CAST(min(CAST({c} AS DOUBLE)) AS VARCHAR)) AS VARCHAR) FROM d"
        for c in ("record_id", "event_id", "user_id")
    ]
    parts.append(
        f"SELECT 'signup_date_date_range', 1, CAST(json_object('max_date', CAST(max({SIGNUP}) AS VARCHAR), "
        f"'min_date', CAST(min({SIGNUP}) AS VARCHAR)) AS VARCHAR) FROM d"
    )
    return union(parts)


def auto_sql_results() -> str:
    sizes = {
        "total_rows": "1",
        **{f"{c}_distribution": f"(SELECT count(*) FROM ({_distribution(c)}))" for c in ("age", "status", "is_active")},
    }
    return union(
        [
            f"SELECT 'dirty' AS dataset, {i} AS position, '{name}' AS query_name, "
            f"'{sql.replace(chr(39), chr(39) * 2)}' AS sql, 'passed' AS status, "
            f"CAST({sizes.get(name, '1')} AS BIGINT) AS row_count, "
            f"'{names(columns)}' AS columns, CAST(NULL AS VARCHAR) AS error_message"
            for i, (name, sql, columns) in enumerate(AUTO_QUERIES)
        ]
    )


def _points(share: str, most: int) -> str:
    levels = [most, round(most * 0.9), round(most * 0.65), round(most * 0.4), round(most * 0.1)]
    return (
        f"CASE WHEN {share} = 0 THEN {levels[0]} WHEN {share} <= 1 THEN {levels[1]} "
        f"WHEN {share} <= 5 THEN {levels[2]} WHEN {share} <= 10 THEN {levels[3]} ELSE {levels[4]} END"
    )


def _grade(score: str, most: int) -> str:
    return (
        f"CASE WHEN {score} / {most}.0 >= 0.85 THEN 'strong' "
        f"WHEN {score} / {most}.0 >= 0.6 THEN 'acceptable' ELSE 'weak' END"
    )


def component_rows(facts: str) -> str:
    """Score components over a relation with the columns of FACTS_SQL; null means skipped."""
    parts = []
    for position, name, most, part, whole, subject, ran in (
        (0, "missing_values", 25, "missing", "rows * cols", "all cells are missing", "TRUE"),
        (1, "duplicates", 25, "duplicates", "rows", "rows are duplicated", "TRUE"),
        (2, "type_validation", 20, "invalid", "checked", "checked values have the wrong type", "checked IS NOT NULL"),
        (3, "business_rules", 20, "violations", "rows * rules", "rule evaluations are violations", "rules IS NOT NULL"),
    ):
        parts.append(
            f"SELECT dataset, {position} AS position, '{name}' AS component_name, "
            f"CAST(CASE WHEN ran THEN {_points('share', most)} ELSE 10 END AS INTEGER) AS score, "
            f"{most} AS max_score, CASE WHEN ran THEN {_grade(_points('share', most), most)} "
            f"ELSE 'skipped' END AS status, CASE WHEN ran THEN share END AS issue_percentage, "
            f"CASE WHEN ran THEN printf('%.2f', share) || '% of {subject}' "
            f"ELSE 'not checked, partial credit' END AS explanation "
            f"FROM (SELECT dataset, {ran} AS ran, {pct(part, whole)} AS share FROM ({facts}))"
        )
    advanced = "(CASE WHEN checked IS NULL THEN 0 ELSE 1 END + CASE WHEN rules IS NULL THEN 0 ELSE 1 END)"
    coverage = f"CASE {advanced} WHEN 2 THEN 10 WHEN 1 THEN 7 ELSE 5 END"
    parts.append(
        f"SELECT dataset, 4, 'check_coverage', CAST({coverage} AS INTEGER), 10, "
        f"{_grade(f'({coverage})', 10)}, CAST(NULL AS DOUBLE), "
        f"CAST({advanced} AS VARCHAR) || ' of 2 optional checks ran' FROM ({facts})"
    )
    return union(parts)


AUTO_FACTS = f"""SELECT 'dirty' AS dataset, m.*, mv.*, du.*, t.*, r.* FROM
  (SELECT count(*) AS rows, {len(DIRTY_COLUMNS)} AS cols FROM d) AS m,
  (SELECT total_missing_values AS missing, columns_with_missing_values AS missing_columns
   FROM ({missing_totals("dirty")})) AS mv,
  (SELECT duplicate_row_count AS duplicates
   FROM ({duplicate_totals("dirty", "d", ["record_id"], "key_columns")})) AS du,
  (SELECT total_invalid_values AS invalid, total_checked_values AS checked,
   columns_with_invalid_values AS invalid_columns FROM ({type_totals("dirty", AUTO_SCHEMA)})) AS t,
  (SELECT total_violations AS violations, rules_checked AS rules, rules_with_violations AS broken
   FROM ({rule_totals("dirty", AUTO_RULE_ROWS)})) AS r"""

BARE_FACTS = f"""SELECT 'orders' AS dataset, count(*) AS rows, 6 AS cols, CAST(0 AS BIGINT) AS missing,
  CAST(0 AS BIGINT) AS missing_columns,
  (SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderkey HAVING count(*) > 1)) AS duplicates,
  CAST(NULL AS BIGINT) AS invalid, CAST(NULL AS BIGINT) AS checked, CAST(NULL AS BIGINT) AS invalid_columns,
  CAST(NULL AS BIGINT) AS violations, CAST(NULL AS BIGINT) AS rules, CAST(NULL AS BIGINT) AS broken
  FROM orders"""


def score_row(components: str) -> str:
    return f"""SELECT dataset, overall_score, max_score, rating,
      CAST(overall_score AS VARCHAR) || ' of ' || CAST(max_score AS VARCHAR) || ' points, rated ' || rating AS summary
      FROM (SELECT *, CASE WHEN overall_score >= 90 THEN 'excellent' WHEN overall_score >= 75 THEN 'good'
        WHEN overall_score >= 50 THEN 'needs_attention' ELSE 'poor' END AS rating
      FROM (SELECT dataset, CAST(sum(score) AS INTEGER) AS overall_score,
        CAST(sum(max_score) AS INTEGER) AS max_score FROM ({components}) GROUP BY dataset))"""


ADVICE = (
    ("missing_values", "weak", "find out why values are missing and repair, fill or exclude them"),
    ("duplicates", "weak", "remove repeated rows or keys, they inflate totals and multiply joins"),
    ("type_validation", "weak", "correct values of the wrong type before loading"),
    ("type_validation", "skipped", "define the expected types of the important columns"),
    ("business_rules", "weak", "go through rule violations with the owners of the data"),
    ("business_rules", "skipped", "define rules for the critical columns"),
)


def advice_rows(components: str) -> str:
    values = ", ".join(f"('{name}', '{state}', '{text}')" for name, state, text in ADVICE)
    return f"""SELECT c.dataset, c.position, c.component_name, a.text AS recommendation
      FROM ({components}) AS c JOIN (VALUES {values}) AS a(name, state, text)
      ON c.component_name = a.name AND c.status = a.state
      UNION ALL SELECT dataset, 0, 'all', 'nothing to do, the table looks ready' FROM ({components})
      GROUP BY dataset HAVING bool_and(component_name = 'check_coverage' OR status NOT IN ('weak', 'skipped'))"""


VERIFIED = "\nUNION ALL ".join(
    [
        """SELECT 'dirty' AS dataset, 0 AS position, 'schema_counts' AS check_name,
           CASE WHEN (SELECT count(*) FROM d) = (SELECT count(*) FROM events) THEN 'passed' ELSE 'failed' END AS status,
           'consistent' AS message""",
        """SELECT 'dirty', 1, 'missing_values', CASE WHEN (SELECT sum(CASE WHEN user_id IS NULL THEN 1 ELSE 0 END
           + CASE WHEN age IS NULL THEN 1 ELSE 0 END + CASE WHEN reading IS NULL THEN 1 ELSE 0 END) FROM d)
           = (SELECT 3 * count(*) - count(user_id) - count(age) - count(reading) FROM d) THEN 'passed' ELSE 'failed' END, 'consistent'""",
        """SELECT 'dirty', 2, 'duplicates', CASE WHEN (SELECT sum(CASE WHEN n > 1 THEN 1 ELSE 0 END) FROM
           (SELECT count(*) OVER (PARTITION BY record_id) AS n FROM d)) = (SELECT sum(n) FROM
           (SELECT count(*) AS n FROM d GROUP BY record_id HAVING count(*) > 1)) THEN 'passed' ELSE 'failed' END, 'consistent'""",
        "SELECT 'dirty', 3, 'type_validation', 'passed', 'consistent'",
        "SELECT 'dirty', 4, 'business_rules', 'passed', 'consistent'",
        "SELECT 'dirty', 5, 'sql_analysis', 'passed', 'consistent'",
        "SELECT 'dirty', 6, 'bi_readiness_score', 'passed', 'consistent'",
    ]
)

VERIFIED_SUMMARY = f"""SELECT 'dirty' AS dataset, CASE WHEN bool_and(status = 'passed') THEN 'passed' ELSE 'failed' END AS status,
  count(*) AS checks_run, {count_if("status = 'failed'")} AS checks_failed,
  {count_if("status = 'warning'")} AS checks_warning FROM ({VERIFIED})"""


def tampered() -> str:
    def row(position, check, actual, more=1):
        return (
            f"SELECT 'dirty' AS dataset, {position} AS position, '{check}' AS check_name, 'failed' AS status, "
            f"'reported ' || CAST({actual} + {more} AS VARCHAR) || ', counted ' || CAST({actual} AS VARCHAR) AS message FROM facts"
        )

    score = f"(SELECT overall_score FROM ({score_row(component_rows('SELECT * FROM facts'))}))"
    return f"""WITH {DIRTY_CTE}, facts AS ({AUTO_FACTS})
      {row(0, "schema_counts", "rows")}
      UNION ALL {row(1, "missing_values_consistency", "missing")}
      UNION ALL {row(2, "duplicates_recomputation", "duplicates")}
      UNION ALL {row(3, "type_validation_total", "invalid")}
      UNION ALL {row(4, "business_rules_affected_rules", "broken")}
      UNION ALL SELECT 'dirty', 5, 'sql_read_only_validation', 'failed', '1 queries are not read-only'
      UNION ALL {row(6, "bi_readiness_score_total", score)}"""


def observation_rows(facts: str, score: str, scope: str, verified: str | None) -> str:
    def text(*parts):
        return " || ".join(parts)

    def num(name):
        return f"CAST({name} AS VARCHAR)"

    parts = [
        f"SELECT dataset, 0 AS position, 'missing_values' AS source, CASE WHEN missing > 0 THEN 'warning' ELSE 'info' END AS severity, "
        f"{text(num('missing'), chr(39) + ' values missing in ' + chr(39), num('missing_columns'), chr(39) + ' columns' + chr(39))} AS message FROM ({facts})",
        f"SELECT dataset, 1, 'duplicates', CASE WHEN duplicates = 0 THEN 'info' WHEN 100.0 * duplicates / rows > 5 THEN 'critical' ELSE 'warning' END, "
        f"{num('CAST(duplicates AS BIGINT)')} || ' duplicate rows, compared by {scope}' FROM ({facts})",
        f"SELECT dataset, 2, 'type_validation', CASE WHEN invalid = 0 THEN 'info' ELSE 'warning' END, "
        f"coalesce({num('invalid')} || ' values of the wrong type in ' || {num('invalid_columns')} || ' columns', 'no expected types, not checked') FROM ({facts})",
        f"SELECT dataset, 3, 'business_rules', CASE WHEN violations = 0 THEN 'info' ELSE 'warning' END, "
        f"coalesce({num('violations')} || ' violations of ' || {num('broken')} || ' rules', 'no rules, not checked') FROM ({facts})",
        f"SELECT dataset, 5, 'bi_readiness_score', CASE rating WHEN 'poor' THEN 'critical' WHEN 'needs_attention' THEN 'warning' ELSE 'info' END, "
        f"{num('overall_score')} || ' of 100 points, rated ' || rating FROM ({score})",
    ]
    if verified:
        parts.append(
            f"SELECT dataset, 6, 'result_verification', CASE status WHEN 'failed' THEN 'critical' WHEN 'warning' THEN 'warning' ELSE 'info' END, "
            f"status || ', ' || {num('checks_failed')} || ' checks failed, ' || {num('checks_warning')} || ' with warnings' FROM ({verified})"
        )
    return union(parts)


def log_rows(facts: str, score: str, scope: str, configured: bool) -> str:
    def skipped(position, name):
        return f"SELECT dataset, {position}, '{name}', 'skipped', 'not configured' FROM ({facts})"

    parts = [
        f"SELECT dataset, 0 AS position, 'schema_profile' AS step_name, 'completed' AS status, "
        f"CAST(rows AS VARCHAR) || ' rows, ' || CAST(cols AS VARCHAR) || ' columns' AS message FROM ({facts})",
        f"SELECT dataset, 1, 'missing_values', 'completed', CAST(missing AS VARCHAR) || ' values missing in ' || CAST(missing_columns AS VARCHAR) || ' columns' FROM ({facts})",
        f"SELECT dataset, 2, 'duplicates', 'completed', CAST(CAST(duplicates AS BIGINT) AS VARCHAR) || ' duplicate rows, compared by {scope}' FROM ({facts})",
    ]
    if configured:
        parts += [
            f"SELECT dataset, 3, 'type_validation', 'completed', '{len(AUTO_SCHEMA)} columns checked, ' || CAST(invalid AS VARCHAR) || ' invalid values' FROM ({facts})",
            f"SELECT dataset, 4, 'business_rules', 'completed', CAST(rules AS VARCHAR) || ' rules checked, ' || CAST(violations AS VARCHAR) || ' violations' FROM ({facts})",
            f"SELECT dataset, 5, 'sql_analysis', 'completed', '{len(AUTO_QUERIES)} queries run, 0 failed' FROM ({facts})",
        ]
    else:
        parts += [
            skipped(3, "type_validation"),
            skipped(4, "business_rules"),
            skipped(5, "sql_analysis"),
        ]
    parts.append(
        f"SELECT dataset, 6, 'bi_readiness_score', 'completed', CAST(overall_score AS VARCHAR) || ' of 100 points, rated ' || rating FROM ({score})"
    )
    return union(parts)


REPORT_ADVICE = (
    ("missing_values", "missing", "review the columns with missing values"),
    ("duplicates", "duplicates", "look into the duplicate rows"),
    ("type_validation", "invalid", "repair values of the wrong type"),
    ("business_rules", "violations", "discuss the rule violations with the data owners"),
)


def report_advice() -> str:
    return union(
        [
            f"SELECT dataset, {i} AS position, '{check}' AS check_name, '{text}' AS recommendation "
            f"FROM facts WHERE {count} > 0"
            for i, (check, count, text) in enumerate(REPORT_ADVICE)
        ]
    )


def melt(table: str, section: str, item: list[str], metrics: list[str]) -> str:
    key = " || '/' || ".join(f"CAST({c} AS VARCHAR)" for c in item) or "''"
    return union(
        [
            f"SELECT dataset, '{section}' AS section, {key} AS item, '{m}' AS metric, "
            f"CAST({m} AS VARCHAR) AS value FROM {table}"
            for m in metrics
        ]
    )


def report() -> str:
    facts = "SELECT * FROM facts"
    ctes = {
        "components": component_rows(facts),
        "score": score_row("SELECT * FROM components"),
        "counts": "SELECT dataset, rows AS row_count, cols AS column_count FROM facts",
        "profile": profile_rows("dirty"),
        "samples": sample_rows("dirty"),
        "missing": missing_rows("dirty"),
        "missing_all": missing_totals("dirty"),
        "dup": duplicate_totals("dirty", "d", ["record_id"], "key_columns"),
        "dup_top": duplicate_top("dirty", "d", ["record_id"]),
        "types": type_rows("dirty", AUTO_SCHEMA),
        "types_all": type_totals("dirty", AUTO_SCHEMA),
        "type_ex": type_examples("dirty", AUTO_SCHEMA),
        "rules": rule_rows("dirty", AUTO_RULE_ROWS),
        "rules_all": rule_totals("dirty", AUTO_RULE_ROWS),
        "rule_ex": rule_examples("dirty", AUTO_RULE_ROWS),
        "sql_res": auto_sql_results(),
        "sql_all": f"SELECT 'dirty' AS dataset, 'passed' AS status, {len(AUTO_QUERIES)} AS queries_executed, 0 AS queries_failed",
        "sql_shown": f"SELECT 'dirty' AS dataset, * FROM ({auto_sql_rows()})",
        "verified": VERIFIED,
        "verified_all": VERIFIED_SUMMARY,
        "log": log_rows(facts, "SELECT * FROM score", "key_columns", True),
        "advice": report_advice(),
    }
    sections = [
        melt("counts", "overview", [], ["row_count", "column_count"]),
        melt("profile", "schema", ["column_name"], ["data_type", "non_null_count", "null_count", "null_percentage"]),
        melt("samples", "sample_values", ["column_name", "sample_rank"], ["sample_value"]),
        melt("missing_all", "missing_values", [], ["status", "total_missing_values", "columns_checked", "columns_with_missing_values"]),
        melt("missing", "missing_by_column", ["column_name"], ["row_count", "null_count", "null_percentage", "severity"]),
        melt("dup", "duplicates", [], ["status", "scope", "key_columns", "row_count", "duplicate_row_count", "duplicate_percentage", "duplicate_group_count", "severity"]),
        melt("dup_top", "duplicate_examples", ["group_rank"], ["duplicate_key", "duplicate_count"]),
        melt("types_all", "type_validation", [], ["status", "columns_checked", "columns_with_invalid_values", "total_invalid_values", "total_checked_values"]),
        melt("types", "type_by_column", ["column_name"], ["expected_type", "data_type", "non_null_count", "invalid_count", "invalid_percentage", "severity"]),
        melt("type_ex", "type_examples", ["column_name", "example_rank"], ["expected_type", "row_label", "value"]),
        melt("rules_all", "business_rules", [], ["status", "rules_checked", "rules_with_violations", "total_violations"]),
        melt("rules", "rule_by_rule", ["rule_name"], ["column_name", "rule_type", "status", "row_count", "violation_count", "violation_percentage", "severity"]),
        melt("rule_ex", "rule_examples", ["rule_name", "example_rank"], ["column_name", "row_label", "value", "message"]),
        melt("sql_all", "sql_analysis", [], ["status", "queries_executed", "queries_failed"]),
        melt("sql_res", "sql_queries", ["query_name"], ["sql", "status", "row_count", "columns", "error_message"]),
        melt("sql_shown", "sql_rows", ["query_name", "row_number"], ["row"]),
        melt("score", "bi_readiness_score", [], ["overall_score", "max_score", "rating", "summary"]),
        melt("components", "score_components", ["component_name"], ["score", "max_score", "status", "issue_percentage", "explanation"]),
        melt("verified_all", "verification", [], ["status", "checks_run", "checks_failed", "checks_warning"]),
        melt("verified", "verification_checks", ["check_name"], ["status", "message"]),
        melt("log", "run_log", ["step_name"], ["status", "message"]),
        melt("advice", "recommendations", ["check_name"], ["recommendation"]),
    ]
    named = ",\n".join(f"{name} AS ({sql})" for name, sql in ctes.items())
    return f"WITH {DIRTY_CTE}, facts AS ({AUTO_FACTS}),\n{named}\n{union(sections)}"


# --- suggestions over all tables ---

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
    "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def described() -> str:
    """A row per column, with whether its smallest values are all boolean words."""
    rows = []
    for table, schema in SCHEMAS.items():
        for position, column in enumerate(schema.split(", ")):
            name, kind = column.split(" ")
            order = "v" if kind in ("int", "bigint", "double") else "CAST(v AS VARCHAR)"
            rows.append(
                f"SELECT '{table}' AS dataset, {position} AS position, '{name}' AS column_name, '{kind}' AS data_type, "
                f"(SELECT coalesce(bool_and(lower(trim(CAST(v AS VARCHAR))) IN ({words(BOOLEAN_WORDS)})), FALSE) FROM "
                f"(SELECT v FROM (SELECT DISTINCT {name} AS v FROM {table} WHERE {name} IS NOT NULL) "
                f"ORDER BY {order} LIMIT 5)) AS words_only"
            )
    return union(rows)


def _has(*tokens: str) -> str:
    return f"list_has_any(tokens, [{words(tokens)}])"


IS_DATE = _has("date", "datetime", "timestamp", "time") + " OR ends_with(name, '_at')"
IS_AMOUNT = _has("amount", "price", "cost", "revenue", "sales", "total", "balance", "value")
NESTED = "starts_with(data_type, 'array')"

COLUMN_CTE = f"""WITH described AS ({described()}),
normal AS (SELECT *, trim(regexp_replace(lower(trim(column_name)), '[^a-z0-9]+', '_', 'g'), '_') AS name FROM described),
split AS (SELECT *, string_split(name, '_') AS tokens FROM normal),
typed AS (SELECT *, CASE WHEN {IS_DATE} THEN 'date' WHEN {_has("age")} THEN 'integer'
  WHEN words_only OR regexp_matches(name, '^(is_|has_|can_)') OR {_has("active", "enabled", "flag")} THEN 'boolean'
  WHEN {IS_AMOUNT} THEN 'numeric' WHEN {_has("quantity", "qty", "count", "number", "nb")} THEN 'integer'
  WHEN data_type IN ('int', 'bigint') THEN 'integer' WHEN data_type = 'double' THEN 'numeric'
  WHEN data_type = 'timestamp_ntz' THEN 'date' ELSE 'string' END AS expected_type,
  ({_has("id")} OR ends_with(name, '_identifier')) AS names_id FROM split),
rules AS (SELECT dataset, position, column_name, 0 AS rule_order, name || '_required' AS rule_name, 'not_null' AS rule_type,
    CAST(NULL AS DOUBLE) AS min_value, CAST(NULL AS DOUBLE) AS max_value, FALSE AS allow_null FROM typed WHERE names_id
  UNION ALL SELECT dataset, position, column_name, 1, name || '_valid_range', 'range', 0, 120, TRUE FROM typed WHERE {_has("age")}
  UNION ALL SELECT dataset, position, column_name, 2, name || '_non_negative', 'non_negative', NULL, NULL, TRUE FROM typed WHERE {IS_AMOUNT}
  UNION ALL SELECT dataset, position, column_name, 3, name || '_not_future', 'not_future_date', NULL, NULL, TRUE FROM typed WHERE {IS_DATE}),
candidates AS (SELECT dataset, position, column_name, 1 AS kind_order, 'distribution' AS kind, name || '_distribution' AS query_name, 3 AS most
    FROM typed WHERE NOT ({IS_DATE}) AND (data_type = 'string' OR {_has("country", "city", "region", "status", "category", "segment", "type")})
  UNION ALL SELECT dataset, position, column_name, 2, 'numeric_summary', name || '_numeric_summary', 3
    FROM typed WHERE expected_type IN ('integer', 'numeric') AND NOT {NESTED}
  UNION ALL SELECT dataset, position, column_name, 3, 'date_range', name || '_date_range', 2 FROM typed WHERE {IS_DATE}),
queries AS (SELECT DISTINCT dataset, CAST(NULL AS INTEGER) AS position, CAST(NULL AS VARCHAR) AS column_name, 0 AS kind_order,
    'total_rows' AS kind, 'total_rows' AS query_name FROM described
  UNION ALL SELECT dataset, position, column_name, kind_order, kind, query_name
    FROM (SELECT *, row_number() OVER (PARTITION BY dataset, kind ORDER BY position) AS nth FROM candidates) WHERE nth <= most)
"""


def batch(kind: str) -> str:
    sizes = [
        "(SELECT count(DISTINCT status) FROM d)",
        "1",
        "(SELECT count(DISTINCT record_id) FROM d)",
        "0",
        "0",
    ]
    columns = ['["status","n"]', '["users"]', '["record_id"]', "[]", "[]"]
    rows = union(
        [
            f"SELECT 'dataset' AS dataset, {i} AS position, '{q.query_name}' AS query_name, '{q.sql}' AS sql, "
            f"'{'passed' if i < 3 else 'failed'}' AS status, CAST({sizes[i]} AS BIGINT) AS row_count, '{columns[i]}' AS columns"
            for i, q in enumerate(BATCH)
        ]
    )
    if kind == "results":
        return f"WITH {DIRTY_CTE} {rows}"
    return f"""WITH {DIRTY_CTE} SELECT dataset, 'warning' AS status, count(*) AS queries_executed,
      {count_if("status = 'failed'")} AS queries_failed FROM ({rows}) GROUP BY dataset"""


# --- slices, streams ---

SLICED = """sliced AS (SELECT *, {label} AS slice FROM {table} UNION ALL SELECT *, NULL FROM {table})"""
STATUS_SLICES = f"""WITH {DIRTY_CTE},
  {SLICED.format(table="d", label="coalesce('status=' || status, 'status is missing')")} """
LINE_SLICES = "WITH " + SLICED.format(
    table="lineitem", label="'l_returnflag=' || l_returnflag || ', l_linestatus=' || l_linestatus"
)
LINE_RULE_ROWS = [
    ("small_discount", "l_discount", "range", "l_discount > 0.08::DOUBLE", ""),
    ("few", "l_quantity", "range", "l_quantity < 1 OR l_quantity > 45", ""),
    ("status_known", "l_linestatus", "allowed_values", "l_linestatus <> 'O'", ""),
]
ORDER_RULE_ROWS = [
    ("price_fits", "o_totalprice", "range", "o_totalprice < 1000 OR o_totalprice > 400000", ""),
    ("done", "o_orderstatus", "allowed_values", "o_orderstatus NOT IN ('F', 'O')", ""),
]
PROBLEMS = ", ".join(
    [f"CASE WHEN {condition} THEN '{name}' END" for name, _, _, condition, _ in DIRTY_RULE_ROWS]
    + [f"CASE WHEN {invalid(c, e)} THEN '{c} is no {e}' END" for c, e in DIRTY_SCHEMA.items()]
)


def sliced(rows: str) -> str:
    """Rows of a check over d, for each slice instead."""
    return " " + rows.replace(" AS position,", " AS position, slice,").replace(
        " FROM d", " FROM sliced GROUP BY slice"
    )


SLICE_FACTS = f"""SELECT coalesce(m.slice, 'whole') AS dataset, m.rows, {len(DIRTY_COLUMNS)} AS cols, missing,
  duplicates, invalid, checked, violations, {len(DIRTY_RULE_ROWS)} AS rules FROM
  (SELECT slice, max(row_count) AS rows, sum(null_count) AS missing
   FROM ({sliced(missing_rows("dirty"))}) GROUP BY slice) AS m
  JOIN (SELECT slice, coalesce(sum(n) FILTER (n > 1), 0) AS duplicates FROM
   (SELECT slice, count(*) AS n FROM sliced GROUP BY slice, record_id) GROUP BY slice) AS u
   ON u.slice IS NOT DISTINCT FROM m.slice
  JOIN (SELECT slice, sum(invalid_count) AS invalid, sum(non_null_count) AS checked
   FROM ({sliced(type_rows("dirty", DIRTY_SCHEMA))}) GROUP BY slice) AS t ON t.slice IS NOT DISTINCT FROM m.slice
  JOIN (SELECT slice, sum(violation_count) AS violations
   FROM ({sliced(rule_rows("dirty", DIRTY_RULE_ROWS))}) GROUP BY slice) AS r ON r.slice IS NOT DISTINCT FROM m.slice"""


def json_by_path(values: str) -> str:
    """Nodes of JSON by path; indexes of lists become []."""
    kinds = {
        "null": "('NULL')",
        "object": "('OBJECT')",
        "array": "('ARRAY')",
        "string": "('VARCHAR')",
        "boolean": "('BOOLEAN')",
        "number": "('UBIGINT', 'BIGINT', 'DOUBLE', 'HUGEINT')",
    }
    columns = ", ".join(f"{count_if(f'type IN {words}')} AS {kind}_count" for kind, words in kinds.items())
    return f"""WITH v AS ({values}),
      node AS (SELECT regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS path, t.type AS type
        FROM (SELECT CAST(v AS JSON) AS j FROM v WHERE json_valid(v)) AS j, json_tree(j.j) AS t
        UNION ALL SELECT '$', CASE WHEN v IS NULL THEN 'missing' ELSE 'invalid' END
        FROM v WHERE NOT coalesce(json_valid(v), false))
      SELECT path, {count_if("type NOT IN ('missing', 'invalid')")} AS node_count, {columns},
        CAST(0 AS BIGINT) AS other_count, {count_if("type = 'missing'")} AS missing_count,
        {count_if("type = 'invalid'")} AS invalid_count
      FROM node GROUP BY path"""


def oracle_sql() -> dict[str, str]:
    dirty = f"WITH {DIRTY_CTE} "
    documents = ["text", "lang", "source", "n_chars"]
    line_key = list(LINE_KEY)
    run = f"WITH {DIRTY_CTE}, facts AS ({AUTO_FACTS}) "
    facts = "SELECT * FROM facts"
    score = score_row(component_rows(facts))
    bare_components = component_rows(BARE_FACTS)
    bare_score = score_row(bare_components)
    found = {
        "missing_by_column": dirty + missing_rows("dataset"),
        "missing_summary": dirty + missing_totals("dataset"),
        "profile_columns": dirty + profile_rows("dataset"),
        "profile_samples": dirty + sample_rows(),
        "preview": "SELECT * FROM events ORDER BY event_id LIMIT 20",
        "dup_key_summary": duplicate_totals("dataset", "lineitem", line_key, "key_columns"),
        "dup_key_topk": duplicate_top("dataset", "lineitem", line_key),
        "dup_full_row_rows": "SELECT * FROM (SELECT text, lang, source, n_chars, "
        "count(*) OVER (PARTITION BY text, lang, source, n_chars) AS duplicate_count FROM documents) "
        "WHERE duplicate_count > 1",
        "profile_samples_large_ints": LARGE_INTS_SAMPLES,
        "sql_numeric_text": NUMERIC_TEXT_ROWS,
        "verify_multiline_sql": "SELECT 'sql_analysis' AS check_name, 'passed' AS status",
        "csv_scan_line_breaks": "SELECT doc_id, text, lang, source, n_chars FROM documents",
        "sql_nested_strings": "SELECT CAST(event_id AS VARCHAR) AS event_id, "
        "'[' || CAST(user_id AS VARCHAR) || ',' || CAST(user_id + 1 AS VARCHAR) || ']' AS pair, "
        "'{\"kind\":\"' || event_type || '\"}' AS named FROM events",
        "run_with_date_formats": "SELECT 'shipped' AS column_name, count(*) AS non_null_count, "
        "count(*) FILTER (WHERE l_linenumber = 7) AS invalid_count FROM lineitem",
        "sink_two_datasets": "SELECT 'run-1' AS run_id, 'orders' AS dataset, count(*) AS row_count FROM orders "
        "UNION ALL SELECT 'run-1', 'events', count(*) FROM events",
        "asof_events": "SELECT b.event_id, b.user_id, b.ts, v.view_id, v.ts AS viewed "
        "FROM (SELECT * FROM events WHERE event_type = 'purchase') AS b ASOF LEFT JOIN "
        "(SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY user_id, ts) AS v "
        "ON b.user_id = v.user_id AND b.ts >= v.ts",
        "distinct_counts": dirty + union(
            [
                f"SELECT 'dataset' AS dataset, '{c}' AS column_name, {i} AS position, "
                f"count({c}) AS non_null_count, count(DISTINCT {c}) AS distinct_count FROM d"
                for i, c in enumerate(DIRTY_COLUMNS)
            ]
        ),
        "distributions_documents": _distributions("documents", ["text", "lang", "source", "n_chars"], 50),
        "distributions_lineitem": _distributions(
            "lineitem", ["l_returnflag", "l_linenumber", "l_shipdate", "l_orderkey"], 20
        ),
        "numeric_quantiles": dirty + union(
            [
                f"SELECT '{c}' AS column_name, {i} AS position, count(x) AS value_count, "
                f"CAST({p} AS DOUBLE) AS probability, min(x) FILTER (place >= {p}) AS value "
                f"FROM (SELECT x, cume_dist() OVER (ORDER BY x) AS place FROM "
                f"(SELECT {number} AS x FROM d) WHERE x IS NOT NULL)"
                for i, (c, number) in enumerate((("age", AGE), ("amount", "amount"), ("reading", "reading")))
                for p in QUANTILES
            ]
        ),
        "incremental_run": f"WITH d AS (SELECT * FROM orders) {rule_rows('orders', ORDER_RULE_ROWS)}",
        "incremental_duplicates": duplicate_totals("dataset", "lineitem", line_key, "key_columns"),
        "missing_by_slice": STATUS_SLICES + sliced(missing_rows("dataset")),
        "rules_by_slice": LINE_SLICES + sliced(rule_rows("dataset", LINE_RULE_ROWS)),
        "score_by_slice": f"{STATUS_SLICES}, facts AS ({SLICE_FACTS}) SELECT NULLIF(dataset, 'whole') AS slice, "
        f"overall_score, max_score, rating FROM ({score})",
        "stream_rules": dirty + rule_rows("dataset", DIRTY_RULE_ROWS),
        "stream_types": dirty + type_rows("dataset", DIRTY_SCHEMA),
        "stream_quarantined": f"{dirty} SELECT * FROM (SELECT event_id, concat_ws('|', {PROBLEMS}) AS problems "
        "FROM d) WHERE problems <> ''",
        "dup_key_rows": "SELECT * EXCLUDE (n), n AS duplicate_count "
        "FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n > 1",
        "dup_full_row_summary": duplicate_totals("dataset", "documents", documents, "full_row"),
        "dup_full_row_topk": duplicate_top("dataset", "documents", documents),
        "dup_null_keys": dirty
        + duplicate_totals("dataset", "d", ["user_id", "reading"], "key_columns"),
        "type_by_column": dirty + type_rows("dataset", DIRTY_SCHEMA),
        "type_summary": dirty + type_totals("dataset", DIRTY_SCHEMA),
        "type_examples": dirty + type_examples("dataset", DIRTY_SCHEMA),
        "rules_by_rule": dirty + rule_rows("dataset", DIRTY_RULE_ROWS),
        "rules_summary": dirty + rule_totals("dataset", DIRTY_RULE_ROWS),
        "rule_examples": dirty + rule_examples("dataset", DIRTY_RULE_ROWS),
        "rule_not_null": one_rule("user_id_required"),
        "rule_range": one_rule("age_in_range"),
        "rule_range_one_bound": one_rule("age_at_most"),
        "rule_null_disallowed": one_rule("age_known_in_range"),
        "rule_positive": one_rule("amount_positive"),
        "rule_non_negative": one_rule("amount_non_negative"),
        "rule_allowed_values": one_rule("status_known"),
        "rule_allowed_values_table": f"""SELECT 'dataset' AS dataset, *, {severity("violation_percentage", 1, 5)} AS severity,
          CASE WHEN violation_count = 0 THEN 'passed' ELSE 'failed' END AS status
          FROM (SELECT *, {pct("violation_count", "row_count")} AS violation_percentage
          FROM (SELECT 0 AS position, 'l_partkey_allowed' AS rule_name, 'l_partkey' AS column_name,
            'allowed_values' AS rule_type, count(*) AS row_count,
            {count_if("l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")} AS violation_count
            FROM lineitem))""",
        "run_with_allowed_table": f"""SELECT 'lines' AS dataset, *, {severity("violation_percentage", 1, 5)} AS severity,
          CASE WHEN violation_count = 0 THEN 'passed' ELSE 'failed' END AS status
          FROM (SELECT *, {pct("violation_count", "row_count")} AS violation_percentage
          FROM (SELECT 0 AS position, 'few' AS rule_name, 'l_quantity' AS column_name, 'range' AS rule_type,
              count(*) AS row_count, {count_if("l_quantity > 45")} AS violation_count FROM lineitem
            UNION ALL SELECT 1, 'part_known', 'l_partkey', 'allowed_values', count(*),
              {count_if("l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)")} FROM lineitem))""",
        "run_allowed_table_examples": """SELECT 'lines' AS dataset, rule_name, column_name,
            CAST(n AS INTEGER) AS example_rank, concat(l_orderkey, ', ', l_linenumber) AS row_label, value, message
          FROM (SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY l_orderkey, l_linenumber, value) AS n
            FROM (SELECT 'few' AS rule_name, 'l_quantity' AS column_name, l_orderkey, l_linenumber,
                CAST(l_quantity AS VARCHAR) AS value, 'expected at most 45' AS message
                FROM lineitem WHERE l_quantity > 45
              UNION ALL SELECT 'part_known', 'l_partkey', l_orderkey, l_linenumber, CAST(l_partkey AS VARCHAR),
                'expected one of the allowed values'
                FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 25)))
          WHERE n <= 10""",
        "rule_not_future_date": one_rule("signup_not_future"),
        "sql_total_rows": dirty + "SELECT count(*) AS row_count FROM d",
        "sql_distribution": dirty + _distribution("status"),
        "sql_quoted_identifier": dirty + _distribution("status"),
        "sql_numeric_summary": dirty
        + union(
            [
                f"SELECT '{c}' AS column_name, min({v}) AS min_value, max({v}) AS max_value, round(avg({v}), 6) AS avg_value FROM d"
                for c, v in (("age", AGE), ("amount", "amount"), ("reading", "reading"))
            ]
        ),
        "sql_date_range": dirty
        + f"SELECT 'signup_date' AS column_name, min({SIGNUP}) AS min_date, max({SIGNUP}) AS max_date FROM d",
        "sql_batch_results": batch("results"),
        "sql_batch_status": batch("status"),
        "sql_batch_rows": dirty
        + f"""SELECT 'statuses' AS query_name, CAST(n AS INTEGER) AS row_number, 'status' AS column_name, value
          FROM (SELECT *, row_number() OVER (ORDER BY row_count DESC, value) AS n FROM ({_distribution("status")}))
          UNION ALL SELECT 'statuses', CAST(n AS INTEGER), 'n', CAST(row_count AS VARCHAR)
          FROM (SELECT *, row_number() OVER (ORDER BY row_count DESC, value) AS n FROM ({_distribution("status")}))
          UNION ALL SELECT 'users', 1, 'users', CAST(count(DISTINCT user_id) AS VARCHAR) FROM d""",
        "sql_result_strings": dirty
        + "SELECT "
        + ", ".join(
            f"coalesce(CAST({c} AS VARCHAR), '') AS {c}"
            for c in ("event_id", "user_id", "age", "signup_date", "status", "amount", "is_active")
        )
        + " FROM d",
        "suggest_types": COLUMN_CTE
        + f"SELECT dataset, position, column_name, data_type, expected_type FROM typed WHERE NOT {NESTED}",
        "suggest_keys": COLUMN_CTE
        + "SELECT dataset, min_by(column_name, CASE WHEN names_id THEN position END) AS key_column FROM typed GROUP BY dataset",
        "suggest_rules": COLUMN_CTE + "SELECT * FROM rules",
        "suggest_queries": COLUMN_CTE + "SELECT * FROM queries",
        "suggest_config": COLUMN_CTE
        + f"""SELECT t.dataset, coalesce(min_by(column_name, CASE WHEN names_id THEN position END), '') AS key,
          CAST(count(CASE WHEN NOT {NESTED} THEN 1 END) AS INTEGER) AS types,
          CAST((SELECT count(*) FROM rules AS r WHERE r.dataset = t.dataset) AS INTEGER) AS rules,
          CAST((SELECT count(*) FROM queries AS q WHERE q.dataset = t.dataset) AS INTEGER) AS queries
          FROM typed AS t GROUP BY t.dataset""",
        "score_components": run + component_rows(facts),
        "score_total": run + score,
        "score_recommendations": run + advice_rows(component_rows(facts)),
        "score_without_config": bare_components,
        "recommendations_without_config": advice_rows(bare_components),
        "verify_run": dirty + VERIFIED,
        "verify_summary": dirty + VERIFIED_SUMMARY,
        "verify_tampered": tampered(),
        "observations": run + observation_rows(facts, score, "key_columns", VERIFIED_SUMMARY),
        "observations_without_config": observation_rows(BARE_FACTS, bare_score, "key_columns", None),
        "run_log": run + log_rows(facts, score, "key_columns", True),
        "run_log_without_config": log_rows(BARE_FACTS, bare_score, "key_columns", False),
        "report_rows": report(),
        "report_recommendations": run + report_advice(),
        "json_paths": json_by_path(JSON_VALUES.format(T="events")),
        "json_list_paths": json_by_path("SELECT CAST(to_json(embedding) AS VARCHAR) AS v FROM embeddings"),
        "csv_scan_typed": dirty + "SELECT * FROM d",
        "sink_roundtrip": dirty
        + f"SELECT *, '{RUN_DAY.isoformat()}' AS run_date, 'run-1' AS run_id FROM ({rule_rows('dirty', AUTO_RULE_ROWS)})",
    }
    found.update({name: text.replace("FROM dataset", f"FROM {table}").replace("JOIN dataset", f"JOIN {table}") for name, (table, text) in SQL.items()})
    return found
