"""Running sums and carried values along an order within groups.

Rows are spread over range buckets of (group, order), every bucket is handled on its own,
and one summary row per group and bucket carries the result across buckets.  No task sees
more than one bucket, however large the group.
"""

from pyspark.sql import Window, functions as F

from stockmill.session import new_dir

_BUCKET = "_bucket"


def running_sums(df, group, order, sums):
    """Add columns with the sum from the group's start; ``sums`` maps new name to value column.

    ``order`` must be unique within a group.
    """
    rows = _spread(df, group, order)
    before = Window.partitionBy(group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        rows.groupBy(group, _BUCKET)
        .agg(*[F.sum(value).alias(new) for new, value in sums.items()])
        .select(group, _BUCKET,
                *[F.coalesce(F.sum(new).over(before), F.lit(0)).alias(f"_{new}") for new in sums])
    )
    line = _upto_here([group, _BUCKET], order)
    inside = rows.withColumns(
        {new: F.coalesce(F.sum(value).over(line), F.lit(0)) for new, value in sums.items()})
    joined = inside.join(offsets, [group, _BUCKET])
    return joined.withColumns({new: F.col(new) + F.col(f"_{new}") for new in sums}).drop(
        _BUCKET, *[f"_{new}" for new in sums])


def carry_forward(df, group, order, columns):
    """Fill NULLs in each column with the last value before them in the group's order."""
    rows = _spread(df, group, order)
    place = F.struct(*order)
    before = Window.partitionBy(group).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    handed = (
        rows.groupBy(group, _BUCKET)
        .agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), place)).alias(c) for c in columns])
        .select(group, _BUCKET,
                *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    )
    line = _upto_here([group, _BUCKET], order)
    inside = rows.withColumns({c: F.last(c, ignorenulls=True).over(line) for c in columns})
    joined = inside.join(handed, [group, _BUCKET])
    return joined.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop(
        _BUCKET, *[f"_{c}" for c in columns])


def _upto_here(partition, order):
    return (
        Window.partitionBy(*partition).orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )


def _spread(df, group, order):
    """Rows with their range bucket, stored in the shared folder.

    Range bounds are sampled, so the buckets are written once and read back: every use,
    and every recomputed task, sees the same ones.
    """
    path = new_dir(df.sparkSession, "buckets")
    ranged = df.repartitionByRange(group, *order).withColumn(_BUCKET, F.spark_partition_id())
    ranged.write.parquet(path)
    return df.sparkSession.read.parquet(path)
