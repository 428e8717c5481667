"""Tables bucketed by key in the session catalog, so that joins on the key move no rows.

Only rows that are already unique by key and month are bucketed: an item that fills a third of
the raw snapshots has one row per month here, so no bucket is much larger than the others.

Each write goes to a folder and a table of its own, which the view ``name`` then shows.  Readers of the
view have a whole table at every moment; the tables before stay for those who still read
them, until ``drop_old`` is called.
"""

import re
import uuid

from pyspark.sql import functions as F

#: Rows of a bucket: some 128 MB of the monthly tables.
ROWS_PER_BUCKET = 2_000_000


def bucket_count(rows):
    """Buckets for a number of rows: a power of two, so that tables of other sizes still match."""
    return 1 << max(0, -(-rows // ROWS_PER_BUCKET) - 1).bit_length()


def write(df, name, path, keys, buckets, comment=None):
    """Store ``df`` below ``path`` in ``buckets`` by ``keys`` (each file sorted by them) and show it
    as ``name``; returns it read back.

    Rows are dealt out as the buckets are, so each bucket is one file and the sort is kept.
    Column comments are kept.
    """
    spark, tag = df.sparkSession, uuid.uuid4().hex
    table = f"{name}__{tag}"
    writer = (
        df.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
        .option("path", f"{path.rstrip('/')}/{tag}")
    )
    writer.saveAsTable(table)
    told = " COMMENT '{}'".format(comment.replace("'", "\\'")) if comment else ""
    spark.sql(f"CREATE OR REPLACE VIEW {name}{told} AS SELECT * FROM {table}")
    return spark.table(name)


def _tables(spark, name):
    database, _, plain = name.rpartition(".")
    found = spark.catalog.listTables(database or None)
    return [(f"{database}.{t.name}" if database else t.name) for t in found
            if re.fullmatch(re.escape(plain.lower()) + "__[0-9a-f]{32}", t.name)]


def drop_old(spark, name):
    """Take the tables that ``name`` no longer shows out of the catalog; their folders stay."""
    shown = spark.sql(f"SHOW CREATE TABLE {name}").first()[0] if spark.catalog.tableExists(
        name) else ""
    gone = [t for t in _tables(spark, name) if t.rpartition(".")[2] not in shown]
    for table in gone:
        spark.sql(f"DROP TABLE {table}")
    return sorted(gone)


def exchanges(df):
    """Number of shuffles in the physical plan of ``df``; 0 is what these tables are for."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?:hash|range|round|single)", plan))


def largest_bucket(df, keys, buckets):
    """Rows in the largest bucket and in the median one, for tables yet to be written."""
    bucket = F.pmod(F.hash(*keys), F.lit(buckets))
    return df.groupBy(bucket.alias("bucket")).count().agg(
        F.max("count").alias("largest"), F.median("count").alias("median"))
