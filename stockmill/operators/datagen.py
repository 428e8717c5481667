"""Repeatable inventory data for any number of items and orders.

Every value is a pure function of a row key (see ``functions.draws``), so generation is a
projection that runs in parallel and repeats exactly.  Category profiles are small
constant maps looked up inside the projection; only orders need a join, to their items.
"""

from itertools import chain

from pyspark.sql import Window, functions as F

from stockmill import rules
from stockmill.functions.draws import BITS, draw, uniform, whole
from stockmill.functions.stock import gap_rate_pct

# Period and shares
START_DATE = "2025-03-01"
DAYS = 365
MONTHS = 12
STOCKED_SHARE = 0.7
DEMAND_SHARE = 0.84
SAFETY_DAYS = (7, 14, 21, 30)
DELAY_DAYS = (-2, 7)
RECEIVED_SHARE = (0.95, 1.05)
#: A sample counts draws in 2**20 ranges.
RANGE_BITS = 20

_FIELDS = ("name", "items", "price_low", "price_high", "lot_low", "lot_high",
           "stock_low", "stock_high", "noise_low", "noise_high",
           "forecast_low", "forecast_high", "actual_low", "actual_high")


def _profile(field):
    """The category's value of one profile field."""
    at = _FIELDS.index(field) + 1
    pairs = chain.from_iterable((F.lit(p[0]), F.lit(p[at])) for p in rules.CATEGORY_PROFILES)
    return F.create_map(*pairs)[F.col("category")]


def _pick(values, index):
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def _start():
    return F.lit(START_DATE).cast("date")


def gen_item_master(keys, seq="item_seq"):
    """Items for a table of item numbers counted from zero."""
    place = F.col(seq) % sum(p[2] for p in rules.CATEGORY_PROFILES)
    codes, places, low = [], [], 0
    for code, _, count, *_ in rules.CATEGORY_PROFILES:
        inside = (place >= low) & (place < low + count)
        codes.append(F.when(inside, code))
        places.append(F.when(inside, place - low))
        low += count
    category, index = F.coalesce(*codes), F.coalesce(*places)
    slow = [s for s in rules.SUPPLIERS if s[2] >= rules.LONG_LEAD_DAYS]
    picked = draw("supplier", seq)
    long_lead = F.col("category") == rules.GROWTH_CATEGORY

    def supplier(field):
        return F.when(long_lead, _pick([s[field] for s in slow], picked % len(slow))).otherwise(
            _pick([s[field] for s in rules.SUPPLIERS], picked % len(rules.SUPPLIERS))
        )

    letter = F.chr((F.lit(65) + F.floor(F.col("n") / 26) % 26).cast("bigint"))
    return (
        keys.select(F.col(seq), category.alias("category"), index.alias("n"))
        .select(
            seq,
            F.format_string("ITM-%04d", F.col(seq) + 1).alias("item_id"),
            F.concat(_profile("name"), F.lit("_"), letter,
                     F.format_string("%02d", F.col("n") % 26 + 1)).alias("item_name"),
            "category",
            _profile("name").alias("category_name"),
            whole("price", _profile("price_low"), _profile("price_high"), seq)
            .cast("bigint").alias("unit_price"),
            supplier(0).alias("primary_supplier_id"),
            supplier(2).cast("bigint").alias("lead_time_days"),
            _pick(SAFETY_DAYS, draw("safety", seq) % len(SAFETY_DAYS)).cast("bigint")
            .alias("safety_stock_days"),
            whole("reorder", 50, 500, seq).cast("bigint").alias("reorder_point_qty"),
            F.date_sub(_start(), whole("created", 30, 365, seq).cast("int")).alias("created_at"),
        )
    )


def gen_orders(keys, items, item_count, seq="order_seq"):
    """Orders for a table of order numbers; ``item_count`` is a column or number."""
    placed = keys.select(
        seq, (draw("item", seq) % item_count).alias("item_seq"),
        F.date_add(_start(), (draw("day", seq) % DAYS).cast("int")).alias("order_date"),
        _pick([rules.DELIVERED] * 3 + [rules.IN_TRANSIT, rules.PENDING],
              draw("status", seq) % 5).alias("status"),
    )
    qty = whole("lot", _profile("lot_low"), _profile("lot_high"), seq).cast("bigint")
    return (
        placed.join(items, "item_seq")
        .withColumn("order_qty", qty)
        .select(
            F.format_string("ORD-%06d", F.col(seq) + 1).alias("order_id"),
            "item_id", F.col("primary_supplier_id").alias("supplier_id"), "order_qty", "unit_price",
            (F.col("order_qty") * F.col("unit_price")).alias("order_amount"), "order_date",
            F.date_add("order_date", F.col("lead_time_days").cast("int"))
            .alias("expected_delivery_date"),
            "status",
        )
    )


def gen_inventory(items):
    """Month-end stock of about 70% of the items in one to four warehouses."""
    shuffled = F.array_sort(F.array(*[
        F.struct(draw(f"place{i}", "item_seq", "m").alias("o"), F.lit(name).alias("w"))
        for i, name in enumerate(rules.WAREHOUSES)
    ]))
    count = whole("places", 1, len(rules.WAREHOUSES), "item_seq", "m").cast("int")
    growth = F.when(F.col("category") == rules.GROWTH_CATEGORY,
                    1 + F.col("m") * rules.MONTHLY_GROWTH).otherwise(F.lit(1.0))
    key = ("item_seq", "m", "location_id")
    base = whole("base", _profile("stock_low"), _profile("stock_high"), *key)
    noise = uniform("noise", _profile("noise_low"), _profile("noise_high"), *key)
    return (
        items.withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
        .filter(uniform("stocked", 0.0, 1.0, "item_seq", "m") < STOCKED_SHARE)
        .withColumn("place", F.explode(F.slice(shuffled, 1, count)))
        .withColumn("location_id", F.col("place.w"))
        .withColumn("inventory_qty", (base * growth * noise).cast("bigint"))
        .select(
            "item_id", "location_id", "inventory_qty",
            (F.col("inventory_qty") * F.col("unit_price")).alias("inventory_value"),
            F.last_day(F.add_months(_start(), F.col("m"))).alias("snapshot_date"),
        )
    )


def gen_receipts(orders):
    """One receipt per delivered order."""
    delay = whole("delay", *DELAY_DAYS, "order_id").cast("int")
    return (
        orders.filter(F.col("status") == rules.DELIVERED)
        .withColumn("receipt_date", F.date_add("expected_delivery_date", delay))
        .select(
            F.concat(F.lit("RCV"), F.substring("order_id", 4, 100)).alias("receipt_id"),
            "order_id", "item_id", "supplier_id",
            (F.col("order_qty") * uniform("received", *RECEIVED_SHARE, "order_id"))
            .cast("bigint").alias("receipt_qty"),
            "receipt_date",
            F.date_diff("receipt_date", "order_date").cast("bigint").alias("lead_time_actual_days"),
            F.when(draw("check", "order_id") % 5 == 4, "inspection_required").otherwise("passed")
            .alias("quality_status"),
        )
    )


def gen_demand(items):
    """Monthly forecast and actual demand of about 84% of the items."""
    base = whole("demand", 50, 500, "item_seq", "m")

    def qty(kind):
        share = uniform(kind, _profile(f"{kind}_low"), _profile(f"{kind}_high"), "item_seq", "m")
        return (base * share).cast("bigint")

    return (
        items.filter(uniform("tracked", 0.0, 1.0, "item_seq") < DEMAND_SHARE)
        .withColumn("m", F.explode(F.sequence(F.lit(0), F.lit(MONTHS - 1))))
        .select(
            "item_id", F.add_months(_start(), F.col("m")).alias("month"),
            qty("forecast").alias("forecast_qty"), qty("actual").alias("actual_qty"),
        )
        .withColumns({
            "gap_qty": F.col("forecast_qty") - F.col("actual_qty"),
            "gap_rate_pct": gap_rate_pct(),
        })
    )


def sample_n(df, n, seed, *keys):
    """A repeatable sample of exactly ``n`` rows without replacement.

    Rows are ranked by a draw on their key.  Counts per range of draws tell which ranges are
    in whole and which one the n-th row falls into; only that range is sorted, so no task
    sees the sample.
    """
    ranked = df.withColumn("_rank", draw(f"sample{seed}", *keys))
    ranked = ranked.withColumn("_range", F.shiftright("_rank", BITS - RANGE_BITS))
    upto = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counts = ranked.groupBy("_range").agg(F.count(F.lit(1)).alias("rows")).withColumn(
        "upto", F.sum("rows").over(upto))
    # the first range that goes beyond n, and how many of its rows are still in
    edge = counts.select(F.min(F.when(F.col("upto") > n, F.struct(
        F.col("_range"), (n - F.col("upto") + F.col("rows")).alias("left"))))).scalar()
    cut = F.coalesce(edge["_range"], F.lit(1 << RANGE_BITS))
    left = F.coalesce(edge["left"], F.lit(0))
    last = ranked.where(F.col("_range") == cut).withColumn(
        "_place", F.row_number().over(Window.orderBy("_rank", *keys))).where(
        F.col("_place") <= left).drop("_place")
    return ranked.where(F.col("_range") < cut).unionByName(last).drop("_rank", "_range")
