"""Declared table schemas.  Ids are text; quantities are BIGINT so a hot item cannot overflow."""

from pyspark.sql import types as T

_TYPES = {
    "s": T.StringType(),
    "l": T.LongType(),
    "d": T.DoubleType(),
    "date": T.DateType(),
    "ts": T.TimestampType(),
}


def _schema(*fields):
    out = []
    for name, kind, comment in fields:
        out.append(T.StructField(name, _TYPES[kind], True, {"comment": comment}))
    return T.StructType(out)


ITEM_MASTER = _schema(
    ("item_id", "s", "item key"),
    ("item_name", "s", "item name"),
    ("category", "s", "category code"),
    ("category_name", "s", "category name"),
    ("unit_price", "d", "price per unit"),
    ("primary_supplier_id", "s", "default supplier"),
    ("lead_time_days", "l", "supplier lead time in days"),
    ("safety_stock_days", "l", "days of demand held as safety stock"),
    ("reorder_point_qty", "l", "reorder point"),
    ("created_at", "date", "date the item was registered"),
)

RAW_ORDERS = _schema(
    ("order_id", "s", "order key"),
    ("item_id", "s", "item key"),
    ("supplier_id", "s", "supplier key"),
    ("order_qty", "l", "ordered quantity"),
    ("unit_price", "d", "price per unit"),
    ("order_amount", "d", "quantity times price"),
    ("order_date", "date", "order date"),
    ("expected_delivery_date", "date", "promised date"),
    ("status", "s", "delivered, in_transit or pending"),
)

RAW_INVENTORY = _schema(
    ("item_id", "s", "item key"),
    ("location_id", "s", "warehouse"),
    ("inventory_qty", "l", "stock on hand"),
    ("inventory_value", "d", "quantity times price"),
    ("snapshot_date", "date", "month end"),
)

RAW_RECEIPTS = _schema(
    ("receipt_id", "s", "receipt key"),
    ("order_id", "s", "order key"),
    ("item_id", "s", "item key"),
    ("supplier_id", "s", "supplier key"),
    ("receipt_qty", "l", "received quantity"),
    ("receipt_date", "date", "receipt date"),
    ("lead_time_actual_days", "l", "days from order to receipt"),
    ("quality_status", "s", "passed or inspection_required"),
)

RAW_DEMAND = _schema(
    ("item_id", "s", "item key"),
    ("month", "date", "month start"),
    ("forecast_qty", "l", "forecast demand"),
    ("actual_qty", "l", "actual demand"),
    ("gap_qty", "l", "forecast minus actual"),
    ("gap_rate_pct", "d", "gap in percent of actual"),
)

OVERSTOCK_ENTRIES = _schema(
    ("item_id", "s", "item key"),
    ("item_name", "s", "item name"),
    ("category", "s", "category code"),
    ("category_name", "s", "category name"),
    ("month", "date", "snapshot month"),
    ("avg_inventory_qty", "d", "average stock quantity"),
    ("avg_inventory_value", "d", "average stock value"),
    ("unit_price", "d", "price per unit"),
    ("turnover_rate", "d", "stock turnover"),
    ("days_on_hand", "l", "average days on hand"),
    ("recommended_action", "s", "recommended action"),
)

STOCK_POSITION = _schema(
    ("item_id", "s", "item key"),
    ("item_name", "s", "item name"),
    ("location", "s", "warehouse"),
    ("current_stock", "l", "stock on hand"),
    ("required_qty", "l", "quantity needed next"),
    ("lead_time_days", "l", "supplier lead time in days"),
    ("status", "s", "short, surplus or adequate"),
    ("category", "s", "category code"),
    ("category_name", "s", "category name"),
)

ORDER_PROPOSALS = _schema(
    ("proposal_id", "s", "proposal key"),
    ("created_at", "ts", "time of writing"),
    ("item_id", "s", "item key"),
    ("item_name", "s", "item name"),
    ("category", "s", "category code"),
    ("current_stock", "l", "stock on hand"),
    ("recommended_order_qty", "l", "quantity to order"),
    ("reason", "s", "reason with quantitative basis"),
    ("priority", "s", "HIGH, MEDIUM or LOW"),
    ("status", "s", "approval status"),
    ("created_by", "s", "author"),
)

FEEDS = {
    "orders": RAW_ORDERS,
    "inventory": RAW_INVENTORY,
    "receipts": RAW_RECEIPTS,
    "demand": RAW_DEMAND,
    "item_master": ITEM_MASTER,
}


def conform(df, schema):
    """Select and cast ``df`` to a declared schema, keeping the column comments."""
    return df.select(
        *[df[f.name].cast(f.dataType).alias(f.name, metadata=f.metadata) for f in schema.fields]
    )
