"""How ready a table is for reporting, as points out of 100.

Everything here works on *facts*: one row per dataset with the totals of its checks (see
``plumbline.plans.facts``), so any number of datasets is scored in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.grading import percent

# Points per component, and which share of them is left up to which percentage.
MISSING_POINTS = 25
DUPLICATE_POINTS = 25
TYPE_POINTS = 20
RULE_POINTS = 20
COVERAGE_POINTS = 10
SKIPPED_POINTS = 10
SHARES = ((1.0, 0.9), (5.0, 0.65), (10.0, 0.4))
LEAST_SHARE = 0.1


def points(percentage: Column, most: Column) -> Column:
    shares = [(percentage == 0, 1.0)] + [(percentage <= limit, share) for limit, share in SHARES]
    left = F
    for applies, share in shares:
        left = left.when(applies, F.lit(share))
    # Half a point goes to the even neighbour.
    return F.bround(most * left.otherwise(LEAST_SHARE)).cast("int")


def component_status(score: Column, most: Column) -> Column:
    ratio = score / most
    return F.when(ratio >= 0.85, "strong").when(ratio >= 0.6, "acceptable").otherwise("weak")


def rating(score: Column) -> Column:
    return (
        F.when(score >= 90, "excellent")
        .when(score >= 75, "good")
        .when(score >= 50, "needs_attention")
        .otherwise("poor")
    )


def score_components(facts: DataFrame) -> DataFrame:
    """Five rows per dataset: points, status and the percentage behind them."""
    ran = F.lit(True)
    types_ran = F.col("columns_type_checked").isNotNull()
    rules_ran = F.col("rules_checked").isNotNull()
    advanced = types_ran.cast("int") + rules_ran.cast("int")

    def component(position, name, most, ran, part, whole, subject):
        return F.struct(
            F.lit(position).alias("position"),
            F.lit(name).alias("component_name"),
            F.lit(most).alias("max_score"),
            ran.alias("ran"),
            part.alias("part"),
            whole.alias("whole"),
            F.lit(subject).alias("subject"),
        )

    # The names of the components.
    issues = F.array(
        component(
            0, "missing_values", MISSING_POINTS, ran, F.col("total_missing_values"),
            F.col("row_count") * F.col("column_count"), "all cells are missing",
        ),
        component(
            1, "duplicates", DUPLICATE_POINTS, ran, F.col("duplicate_row_count"),
            F.col("row_count"), "rows are duplicated",
        ),
        component(
            2, "type_validation", TYPE_POINTS, types_ran, F.col("total_invalid_values"),
            F.col("total_checked_values"), "checked values have the wrong type",
        ),
        component(
            3, "business_rules", RULE_POINTS, rules_ran, F.col("total_violations"),
            F.col("row_count") * F.col("rules_checked"), "rule evaluations are violations",
        ),
    )
    shared = F.transform(
        issues,
        lambda c: c.withField("share", F.when(c["ran"], percent(c["part"], c["whole"]))),
    )
    scored = F.transform(
        shared,
        lambda c: c.withField(
            "score",
            F.when(c["ran"], points(c["share"], c["max_score"])).otherwise(SKIPPED_POINTS),
        ),
    )
    components = F.transform(
        scored,
        lambda c: F.struct(
            c["position"].alias("position"),
            c["component_name"].alias("component_name"),
            c["score"].alias("score"),
            c["max_score"].alias("max_score"),
            F.when(c["ran"], component_status(c["score"], c["max_score"]))
            .otherwise("skipped")
            .alias("status"),
            c["share"].alias("issue_percentage"),
            F.when(c["ran"], F.format_string("%.2f%% of %s", c["share"], c["subject"]))
            .otherwise("not checked, partial credit")
            .alias("explanation"),
        ),
    )
    coverage = F.when(advanced == 2, COVERAGE_POINTS).when(advanced == 1, 7).otherwise(5)
    most = F.lit(COVERAGE_POINTS)
    checked = F.struct(
        F.lit(4).alias("position"),
        F.lit("check_coverage").alias("component_name"),
        coverage.alias("score"),
        most.alias("max_score"),
        component_status(coverage, most).alias("status"),
        F.lit(None).cast("double").alias("issue_percentage"),
        F.format_string("%d of 2 optional checks ran", advanced).alias("explanation"),
    )
    return facts.select("dataset", F.inline(F.concat(components, F.array(checked))))


def score_totals(components: DataFrame) -> DataFrame:
    """One row per dataset: points, rating and a summary."""
    total = F.sum("score").cast("int")
    return (
        components.groupBy("dataset")
        .agg(total.alias("overall_score"), F.sum("max_score").cast("int").alias("max_score"))
        .withColumn("rating", rating(F.col("overall_score")))
        .withColumn(
            "summary",
            F.format_string(
                "%d of %d points, rated %s", "overall_score", "max_score", "rating"
            ),
        )
    )


def score_recommendations(components: DataFrame) -> DataFrame:
    """What to do about weak components and skipped checks."""
    advice = F.create_map(
        *[
            F.lit(text)
            for pair in (
                ("missing_values:weak", "find out why values are missing and repair, fill or exclude them"),
                ("duplicates:weak", "remove repeated rows or keys, they inflate totals and multiply joins"),
                ("type_validation:weak", "correct values of the wrong type before loading"),
                ("type_validation:skipped", "define the expected types of the important columns"),
                ("business_rules:weak", "go through rule violations with the owners of the data"),
                ("business_rules:skipped", "define rules for the critical columns"),
            )
            for text in pair
        ]
    )
    text = F.try_element_at(advice, F.concat_ws(":", "component_name", "status"))
    given = F.array_sort(
        F.collect_list(
            F.when(
                text.isNotNull(),
                F.struct("position", "component_name", text.alias("recommendation")),
            )
        )
    )
    default = F.array(
        F.struct(
            F.lit(0).alias("position"),
            F.lit("all").alias("component_name"),
            F.lit("nothing to do, the table looks ready").alias("recommendation"),
        )
    )
    return (
        components.groupBy("dataset")
        .agg(given.alias("given"))
        .select("dataset", F.inline(F.when(F.size("given") > 0, F.col("given")).otherwise(default)))
    )
