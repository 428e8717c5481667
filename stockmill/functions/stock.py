"""Column expressions for stock, demand and delivery measures."""

from pyspark.sql import functions as F

from stockmill import rules


def month_key(day):
    """First day of the month of ``day``."""
    return F.trunc(day, "MM")


def turnover_rate(avg_qty):
    qty = F.col(avg_qty) if isinstance(avg_qty, str) else avg_qty
    return F.round(
        F.lit(rules.TURNOVER_NUMERATOR) / (qty / F.lit(rules.TURNOVER_QTY_UNIT) + F.lit(1)), 2
    )


def days_on_hand(avg_qty):
    """Whole days, truncated."""
    qty = F.col(avg_qty) if isinstance(avg_qty, str) else avg_qty
    return (qty / F.lit(rules.DAYS_QTY_UNIT)).cast("bigint")


def line_value(qty, unit_price):
    """Money for a quantity; rounded to cents so sums do not depend on row order."""
    return F.round(F.col(qty) * F.col(unit_price), 2)


def due_date(start, days):
    return F.date_add(F.col(start), F.col(days).cast("int"))


def days_between(end, start):
    return F.date_diff(F.col(end), F.col(start)).cast("bigint")


def gap_qty(forecast="forecast_qty", actual="actual_qty"):
    return F.col(forecast) - F.col(actual)


def gap_rate_pct(forecast="forecast_qty", actual="actual_qty"):
    """Forecast gap in percent of actual demand; demand below one counts as one."""
    base = F.greatest(F.col(actual), F.lit(1))
    return F.round((F.col(forecast) - F.col(actual)) / base * 100, 1)


def net_position(stock="current_stock", required="required_qty"):
    return F.col(stock) - F.col(required)


def stock_status(stock="current_stock", required="required_qty", factor=rules.SURPLUS_FACTOR):
    return (
        F.when(net_position(stock, required) < 0, rules.STATUS_SHORT)
        .when(F.col(stock) > F.col(required) * factor, rules.STATUS_SURPLUS)
        .otherwise(rules.STATUS_ADEQUATE)
    )


def critical_flag(turnover="turnover_rate", days="days_on_hand",
                  max_turnover=rules.CRITICAL_TURNOVER, min_days=rules.CRITICAL_DAYS):
    return (F.col(turnover) < max_turnover) | (F.col(days) >= min_days)


def turnover_verdict(turnover, good_from=rules.GOOD_TURNOVER):
    return F.when(F.col(turnover) >= good_from, rules.VERDICT_GOOD).otherwise(rules.VERDICT_POOR)


def proposal_priority(turnover="turnover_rate", days="days_on_hand"):
    t, d = F.col(turnover), F.col(days)
    high = (t < rules.HIGH_TURNOVER_BELOW) & (d > rules.HIGH_DAYS_ABOVE)
    medium = t.between(*rules.MEDIUM_TURNOVER) & d.between(*rules.MEDIUM_DAYS)
    return (
        F.when(high, rules.PRIORITY_HIGH)
        .when(medium, rules.PRIORITY_MEDIUM)
        .otherwise(rules.PRIORITY_LOW)
    )


def quantitative_basis(turnover="turnover_rate", days="days_on_hand"):
    """Measured turnover and days against their base values, as one sentence."""
    # wording
    text = "在庫回転率 %.2f（基準値比 %+d%%）、滞留日数 %d日（%s %+d日）"
    over, under = "閾値超", "閾値未満"
    pct = F.round((F.col(turnover) / rules.HIGH_TURNOVER_BELOW - 1) * 100).cast("bigint")
    diff = (F.col(days) - rules.HIGH_DAYS_ABOVE).cast("bigint")
    return F.format_string(
        text, F.col(turnover), pct, F.col(days), F.when(diff > 0, over).otherwise(under), diff
    )
