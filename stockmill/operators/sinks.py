"""Writing tables.

A table is replaced by writing its new rows into a folder beside it and then swapping names,
so a write that fails leaves the old table whole, and a table may be computed from itself.
"""

import uuid

from pyspark.sql import functions as F

from stockmill.schemas import ORDER_PROPOSALS, conform


def register_table(spark, name, path, comment=None, layer=None):
    """Name a written folder in the session catalog; ``layer`` becomes its quality tag."""
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet", description=comment)
    if layer:
        spark.sql(f"ALTER TABLE {name} SET TBLPROPERTIES ('quality' = '{layer}')")


def replace_files(df, path):
    """Write ``df`` as Parquet beside ``path``, then put it in the place of ``path``.

    Both renames touch names only.  What was there is deleted last.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    new, old = f"{path.rstrip('/')}.new-{tag}", f"{path.rstrip('/')}.old-{tag}"
    df.write.parquet(new)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(hadoop(path)):
        files.rename(hadoop(path), hadoop(old))
    if not files.rename(hadoop(new), hadoop(path)):
        files.rename(hadoop(old), hadoop(path))
        raise OSError(f"{new} could not be renamed to {path}")
    files.delete(hadoop(old), True)
    spark.catalog.refreshByPath(path)


def write_materialized_view(df, path, layer="gold", name=None, comment=None, cluster_by=None):
    """Replace a table by a full recompute and return it read back.

    Rows are rebalanced before the write: small partitions merge and a large one is
    split, so files keep a sensible size.  ``cluster_by`` gathers and sorts equal values,
    which lets a filter on that column skip whole row groups.
    """
    spark = df.sparkSession
    if cluster_by:
        df = df.hint("rebalance", F.col(cluster_by)).sortWithinPartitions(cluster_by)
    else:
        df = df.hint("rebalance")
    replace_files(df, path)
    if name:
        register_table(spark, name, path, comment, layer)
    return spark.read.parquet(path)


def create_or_replace_table(df, schema, path, name=None, comment=None):
    """Replace a table that has declared types and column comments."""
    spark = df.sparkSession
    replace_files(conform(df, schema), path)
    if name:
        register_table(spark, name, path, comment)
    return spark.read.schema(schema).parquet(path)


def append_order_proposals(proposals, path):
    """Add proposals, stamped with the time of writing, to the proposal log."""
    stamped = proposals.withColumn("created_at", F.current_timestamp())
    conform(stamped, ORDER_PROPOSALS).write.mode("append").parquet(path)
    return proposals.sparkSession.read.schema(ORDER_PROPOSALS).parquet(path)


def export_csv(df, path):
    """CSV with a header line, in UTF-8."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)
