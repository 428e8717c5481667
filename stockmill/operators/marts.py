"""Dashboard datasets and their chart-level roll-ups."""

from pyspark.sql import Window, functions as F

from stockmill import rules
from stockmill.functions.stock import net_position
from stockmill.functions.text import format_money


def latest_month(summary):
    """Rows of the newest month; the month is found once by a scalar subquery.

    For roll-ups use ``newest_of``, which reads the rows once.
    """
    newest = summary.select(F.max("month")).scalar()
    return summary.filter(F.col("month") == newest)


def newest_of(per_month, month="month"):
    """Rows of the newest month of a table that is aggregated by month already."""
    newest = F.max(month).over(Window.partitionBy())
    return per_month.withColumn("_newest", newest).where(
        F.col(month) == F.col("_newest")).drop("_newest", month)


def inventory_kpi(summary):
    """Value and items of the newest month; without any row, one row of NULL and 0."""
    newest = newest_of(summary.groupBy("month").agg(
        F.sum("avg_inventory_value").alias("total_value"),
        F.count_distinct("item_id").alias("total_items"),
    ))
    return newest.agg(F.sum("total_value").alias("total_value"),
                      F.coalesce(F.sum("total_items"), F.lit(0)).alias("total_items"))


def turnover_kpi(analysis):
    """Unweighted mean of the category averages."""
    return analysis.agg(F.avg("avg_turnover_rate").alias("avg_turnover"))


def overstock_kpi(alerts, min_days=rules.KPI_DAYS):
    return alerts.filter(F.col("days_on_hand") >= min_days).agg(
        F.count_distinct("item_id").alias("overstock_count")
    )


def inventory_trend(summary, ordered=True):
    """``ordered=False`` spares the sort where a roll-up follows."""
    trend = summary.groupBy("month", "category").agg(
        F.sum("avg_inventory_value").alias("avg_inventory_value")
    )
    return trend.orderBy("month", "category") if ordered else trend


def category_breakdown(summary, ordered=True):
    breakdown = newest_of(summary.groupBy("month", "category").agg(
        F.sum("avg_inventory_value").alias("total_value"),
        F.count_distinct("item_id").alias("item_count"),
    ))
    return breakdown.orderBy(F.desc("total_value"), "category") if ordered else breakdown


def overstock_alerts(alerts, min_days=rules.ALERT_DAYS, rows=rules.ALERT_ROWS):
    """The longest-held alerts; ties go by item, then month."""
    return (
        alerts.filter(F.col("days_on_hand") >= min_days)
        .orderBy(F.desc("days_on_hand"), "item_id", "month")
        .limit(rows)
        .select("item_id", "item_name", "category", "turnover_rate", "days_on_hand",
                "avg_inventory_value")
    )


def overstock_worst(alerts, rows=rules.WORST_ROWS):
    """The slowest-turning alerts."""
    return (
        alerts.orderBy("turnover_rate", "item_id", "month")
        .limit(rows)
        .select("item_id", "item_name", "category", "month", "turnover_rate", "days_on_hand")
    )


def turnover_trend(analysis, ordered=True):
    trend = analysis.select("month", "category", "avg_turnover_rate")
    return trend.orderBy("month", "category") if ordered else trend


def supplier_leadtime(receipts, rows=rules.SUPPLIER_ROWS):
    return (
        receipts.groupBy("supplier_id")
        .agg(F.avg("lead_time_actual_days").alias("avg_lead_time"))
        .orderBy(F.desc("avg_lead_time"), "supplier_id")
        .limit(rows)
    )


def overstock_listing(overstock):
    return overstock.orderBy(F.desc("avg_inventory_value"), "item_id", "month").select(
        "item_id", "item_name", "category_name",
        format_money("avg_inventory_value").alias("inventory_value_text"),
        "turnover_rate", "days_on_hand", "recommended_action",
    )


def overstock_category_summary(overstock):
    return (
        overstock.groupBy("category_name")
        .agg(
            F.count(F.lit(1)).alias("item_rows"),
            F.sum("avg_inventory_value").alias("total_value"),
            F.round(F.avg("turnover_rate"), 2).alias("avg_turnover"),
            F.round(F.avg("days_on_hand"), 0).alias("avg_days"),
        )
        .orderBy(F.desc("total_value"), "category_name")
    )


def shortage_listing(positions):
    return positions.orderBy("item_id", F.desc("location")).select(
        "item_id", "item_name", "location", "current_stock", "required_qty",
        net_position().alias("net_position"), "lead_time_days", "status",
    )


# Chart roll-ups: each reads the dataset above it.

def widget_inventory_trend(trend):
    return trend.groupBy(
        F.date_trunc("MONTH", "month").cast("date").alias("month"), "category"
    ).agg(F.sum("avg_inventory_value").alias("sum_inventory_value"))


def widget_turnover_trend(trend):
    """Averages, not sums: a sum of averages has no meaning."""
    return trend.groupBy(
        F.date_trunc("MONTH", "month").cast("date").alias("month"), "category"
    ).agg(F.avg("avg_turnover_rate").alias("avg_turnover_rate"))


def widget_category_value(breakdown):
    return breakdown.groupBy("category").agg(F.sum("total_value").alias("sum_total_value"))


def widget_supplier_leadtime(leadtime):
    return leadtime.groupBy("supplier_id").agg(F.avg("avg_lead_time").alias("avg_lead_time"))


def widget_counters(stock_kpi, turn_kpi, alert_kpi):
    """Three one-row datasets as one row."""
    stacked = (
        stock_kpi.select("total_value")
        .unionByName(turn_kpi, allowMissingColumns=True)
        .unionByName(alert_kpi, allowMissingColumns=True)
    )
    return stacked.agg(
        F.sum("total_value").alias("total_value"),
        F.sum("avg_turnover").alias("avg_turnover"),
        F.sum("overstock_count").alias("overstock_count"),
    )
