"""Moving surplus stock of an item to locations that are short of it.

Both sides of an item are laid out as back-to-back intervals on one line: shortages in
location order, surpluses largest first.  Where a shortage and a surplus overlap, that
much stock moves.  The overlaps are found by walking the interval starts in order, so an
item with s short and u surplus locations costs s + u rows, never s * u pairs.

Positions are keyed by item and location.  Items are spread over range buckets of (item,
order), so an item of any size is split over tasks.
"""

from pyspark.sql import functions as F

from stockmill.functions import stock
from stockmill.functions.ordered import carry_forward, running_sums

_SHORT, _SURPLUS = 1, 0


def _intervals(positions):
    """Short and surplus positions with their interval [start, stop) on the item's line."""
    net = positions.withColumn("net", stock.net_position()).filter(F.col("net") != 0)
    is_short = F.col("net") < 0
    amount = F.abs("net")
    sided = net.withColumns({
        "side": F.when(is_short, _SHORT).otherwise(_SURPLUS),
        "amount": amount,
        "short_amount": F.when(is_short, amount),
        "surplus_amount": F.when(~is_short, amount),
        "size_rank": F.when(~is_short, -amount).otherwise(0),
    })
    lines = running_sums(
        sided, "item_id", ["side", "size_rank", "location"],
        {"short_stop": "short_amount", "surplus_stop": "surplus_amount"},
    )
    stop = F.when(F.col("side") == _SHORT, F.col("short_stop")).otherwise(F.col("surplus_stop"))
    return lines.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("amount"))


def transfer_plan(positions):
    """Quantity to move from each source to each target location, per item."""
    short = F.col("side") == _SHORT
    starts = _intervals(positions).select(
        "item_id", "item_name", "lead_time_days", "start", "side",
        F.when(~short, F.col("location")).alias("source_location"),
        F.when(~short, F.col("stop")).alias("source_stop"),
        F.when(short, F.col("location")).alias("target_location"),
        F.when(short, F.col("stop")).alias("target_stop"),
        F.when(short, F.col("amount")).alias("shortage_qty"),
    )
    paired = carry_forward(
        starts, "item_id", ["start", "side"],
        ["source_location", "source_stop", "target_location", "target_stop", "shortage_qty"],
    )
    end = F.least("source_stop", "target_stop")
    return (
        paired.filter(F.col("source_location").isNotNull() & F.col("target_location").isNotNull())
        .withColumn("transfer_qty", end - F.col("start"))
        .filter(F.col("transfer_qty") > 0)
        .select(
            "item_id", "item_name", "source_location", "target_location", "transfer_qty",
            (F.col("source_stop") - end).alias("source_left"),
            (F.col("target_stop") - end).alias("target_left"),
            "shortage_qty", "lead_time_days",
        )
    )


def uncovered_shortages(positions):
    """Short positions that the item's surplus cannot fill, with the missing quantity.

    A shortage is covered as far as its interval lies below the item's total surplus,
    so the plan itself need not be joined back.
    """
    held = positions.withColumn("net", stock.net_position()).filter(F.col("net") > 0)
    surplus = held.groupBy("item_id").agg(F.sum("net").alias("item_surplus"))
    covered = F.greatest(
        F.least("stop", F.coalesce("item_surplus", F.lit(0))) - F.col("start"), F.lit(0))
    return (
        _intervals(positions)
        .filter(F.col("side") == _SHORT)
        .join(surplus, "item_id", "left")
        .withColumn("covered_qty", covered)
        .withColumn("order_qty", F.col("amount") - F.col("covered_qty"))
        .filter(F.col("order_qty") > 0)
        .select(*positions.columns, F.col("amount").alias("shortage_qty"),
                "covered_qty", "order_qty")
    )
