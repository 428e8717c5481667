"""Declared quality rules with warn, drop and fail severities.

A rule holds for a row only when its condition is TRUE; NULL counts as a violation.
Rules are checked before duplicates are removed, so a bad copy cannot displace a good one.
"""

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import functions as F

WARN, DROP, FAIL = "warn", "drop", "fail"


@dataclass(frozen=True)
class Expectation:
    name: str
    condition: str
    action: str

    @property
    def holds(self):
        return F.coalesce(F.expr(self.condition), F.lit(False))


# The rules of each table
EXPECTATIONS = {
    "orders": (
        Expectation("pk_not_null", "order_id IS NOT NULL", FAIL),
        Expectation("valid_qty", "order_qty > 0", DROP),
        Expectation("valid_amount", "order_amount > 0", DROP),
        Expectation("valid_date", "order_date IS NOT NULL", WARN),
    ),
    "inventory": (
        Expectation("valid_qty", "inventory_qty >= 0", DROP),
        Expectation("valid_value", "inventory_value >= 0", DROP),
        Expectation("has_item", "item_id IS NOT NULL", WARN),
    ),
    "receipts": (
        Expectation("pk_not_null", "receipt_id IS NOT NULL", FAIL),
        Expectation("valid_qty", "receipt_qty > 0", DROP),
    ),
    "overstock_alert": (
        Expectation("has_alert_items", "turnover_rate < 4.0", WARN),
    ),
}


def expect_or_fail(df, expectations):
    """Stop the job at the first row that breaks a fail rule.

    The check is a filter rather than a rewritten column, so column pruning cannot
    remove it.
    """
    for rule in _with_action(expectations, FAIL):
        stop = F.raise_error(F.lit(f"expectation {rule.name} violated: {rule.condition}"))
        df = df.filter(F.when(rule.holds, F.lit(True)).otherwise(stop.cast("boolean")))
    return df


def expect_or_drop(df, expectations):
    """Keep the rows that satisfy every drop rule."""
    dropping = _with_action(expectations, DROP)
    return df.filter(_all_hold(dropping)) if dropping else df


def observe_violations(df, observation, expectations):
    """Count violations while the rows flow past.

    ``observation`` is an ``Observation`` in batch, or a name whose metrics appear in
    the progress of a streaming query.
    """
    counts = [
        F.count_if(~rule.holds).alias(rule.name)
        for rule in expectations if rule.action != FAIL
    ]
    return df.observe(observation, F.count(F.lit(1)).alias("total_rows"), *counts)


def apply_expectations(df, expectations, observation=None):
    """Fail, count, then drop."""
    df = expect_or_fail(df, expectations)
    if observation is not None:
        df = observe_violations(df, observation, expectations)
    return expect_or_drop(df, expectations)


def violation_counts(df, dataset, expectations):
    """One row per rule with the rows seen and the rows in violation, in a single pass."""
    counted = df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(~rule.holds).alias(f"v_{i}") for i, rule in enumerate(expectations)],
    )
    lines = F.array(*[
        F.struct(
            F.lit(dataset).alias("dataset"),
            F.lit(rule.name).alias("expectation"),
            F.lit(rule.action).alias("severity"),
            F.col("total_rows"),
            F.col(f"v_{i}").alias("violations"),
        )
        for i, rule in enumerate(expectations)
    ])
    return counted.select(F.inline(lines))


def pass_rate(df, dataset, expectations):
    """Share of rows that satisfy every rule."""
    good = _all_hold(expectations)
    return df.agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(good).alias("passed_rows"),
        F.round(F.avg(F.when(good, 1.0).otherwise(0.0)) * 100, 2).alias("pass_rate_pct"),
    ).select(F.lit(dataset).alias("dataset"), "total_rows", "passed_rows", "pass_rate_pct")


def layer_row_counts(tables):
    """Tables and rows per layer; ``tables`` lists (layer, table name, DataFrame)."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(layer).alias("layer"), "row_count")
        for layer, _, df in tables
    ]
    return (
        reduce(lambda a, b: a.unionByName(b), counts)
        .groupBy("layer")
        .agg(F.count(F.lit(1)).alias("table_count"), F.sum("row_count").alias("row_count"))
    )


def _with_action(expectations, action):
    return [rule for rule in expectations if rule.action == action]


def _all_hold(expectations):
    return reduce(lambda a, b: a & b, [rule.holds for rule in expectations])
