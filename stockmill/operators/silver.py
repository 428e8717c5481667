"""Typed, checked and deduplicated tables, batch form.

Casts use ``try_cast``: malformed text becomes NULL and is then judged by the rules.
"""

from stockmill.operators.dedupe import KEYS, dedupe
from stockmill.operators.quality import EXPECTATIONS, apply_expectations

# Columns cast on the way to silver
CASTS = {
    "orders": {
        "order_date": "date", "expected_delivery_date": "date",
        "order_qty": "bigint", "unit_price": "double", "order_amount": "double",
    },
    "inventory": {"snapshot_date": "date", "inventory_qty": "bigint", "inventory_value": "double"},
    "receipts": {
        "receipt_date": "date", "receipt_qty": "bigint", "lead_time_actual_days": "bigint",
    },
}


def typed(raw, table):
    """Cast the raw columns; other columns pass through."""
    return raw.withColumns({c: raw[c].try_cast(t) for c, t in CASTS[table].items()})


def checked(raw, table, observation=None):
    """Typed rows that passed the table's rules, duplicates still in place."""
    return apply_expectations(typed(raw, table), EXPECTATIONS[table], observation)


def silver(raw, table, observation=None):
    return dedupe(checked(raw, table, observation), KEYS[table])


def silver_orders(raw, observation=None):
    return silver(raw, "orders", observation)


def silver_inventory(raw, observation=None):
    return silver(raw, "inventory", observation)


def silver_receipts(raw, observation=None):
    return silver(raw, "receipts", observation)
