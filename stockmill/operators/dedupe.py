"""Duplicate removal."""

from pyspark.sql import functions as F

# The key of each table
KEYS = {
    "orders": ["order_id"],
    "inventory": ["item_id", "location_id", "snapshot_date"],
    "receipts": ["receipt_id"],
}


def dedupe(df, keys):
    """One row per key: the smallest by the remaining columns, NULLs first.

    The survivor does not depend on row order, so a recomputed partition yields the
    same rows.  ``min`` combines before the shuffle, which reduces a key with very many
    copies to one row per map task.
    """
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.dropDuplicates(keys)
    best = F.min(F.struct(*rest)).alias("kept")
    return df.groupBy(*keys).agg(best).select(
        *[c if c in keys else F.col("kept")[c].alias(c) for c in df.columns]
    )
