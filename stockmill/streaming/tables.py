"""Incremental landing, bronze and silver tables.

Every stream runs with the ``availableNow`` trigger: it takes all files that have arrived,
in one or more batches, and stops.  The checkpoint remembers the files, so the next run
takes only new ones.
"""

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from stockmill.operators.dedupe import KEYS
from stockmill.operators.quality import EXPECTATIONS, FAIL, apply_expectations
from stockmill.operators.silver import typed
from stockmill.schemas import FEEDS
from stockmill.session import exists, folders, keep_state_on_disk, names, new_dir
from stockmill.sources.landing import (
    FILES_AT_ONCE, feed_path, first_lines, note_headers, parse_lines, read_files,
)

BATCH_BYTES = 1 << 40
#: Spark's own default leaves out files a week older than the newest one.
MAX_FILE_AGE = "36500d"
_EVENT_TIME = "_event_time"
_NAMES = "path string, modificationTime timestamp, length bigint, content binary"
_COUNTS = "dataset string, batch bigint, measure string, row_count bigint"


def _reader(spark, max_files, batch_bytes=BATCH_BYTES):
    """Batches hold at most ``max_files`` files, or else about ``batch_bytes``.

    A backlog of any size is thus worked off in batches whose state and output commit one
    after the other, and a restart repeats one batch at most.  Files are told apart by path
    alone: one that arrives late with an old modification time is taken too.
    """
    reader = spark.readStream.option("maxFileAge", MAX_FILE_AGE)
    if max_files:
        return reader.option("maxFilesPerTrigger", max_files)
    return reader.option("maxBytesPerTrigger", batch_bytes)


def read_landing_stream(spark, root, feed, max_files=None, noted=None, batch_bytes=BATCH_BYTES):
    """New CSV files of a feed, each read by its own header; a field that does not fit its type
    becomes NULL and the row's text is kept in ``_corrupt_record``.

    Headers are noted in the table ``noted`` (default: a new folder) before the stream starts;
    a file that arrives in between stops the run, and the next run takes it.
    """
    path = feed_path(root, feed)
    headers = note_headers(spark, path, noted or new_dir(spark, "headers"))
    lines = _reader(spark, max_files, batch_bytes).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"))
    return parse_lines(lines, headers, FEEDS[feed])


def read_table_stream(spark, path, schema, max_files=None, batch_bytes=BATCH_BYTES):
    """New files of a table written by a stream, whatever folders they lie in."""
    return _reader(spark, max_files, batch_bytes).schema(schema).option(
        "recursiveFileLookup", True).parquet(path)


def write_streaming_table(df, path, checkpoint):
    """Append a stream to a Parquet table and wait until all arrived files are in."""
    keep_state_on_disk(df.sparkSession)
    query = (
        df.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return query


def ingest_files(spark, folder, schema, path, checkpoint, noted, max_files=None):
    """Take new CSV files of a folder into the Parquet table ``path``, each file read once.

    The stream sees names only.  A batch takes the headers from the first bytes of its files,
    reads files of one header together with the CSV reader, and writes a folder of its own
    (``batch=N``); a batch that runs again finds that folder complete, or writes it over.
    """
    files = spark.readStream.format("binaryFile").schema(_NAMES).option(
        "maxFileAge", MAX_FILE_AGE).option("maxFilesPerTrigger", max_files or FILES_AT_ONCE).load(
        folder).select(F.col("_metadata.file_path").alias("file"))

    def take(batch, number):
        target = f"{path}/batch={number}"
        if exists(spark, f"{target}/_SUCCESS"):
            return
        session = batch.sparkSession
        headers = first_lines(session, [r.file for r in batch.distinct().collect()])
        session.createDataFrame(headers, "file string, header string").coalesce(1).write.mode(
            "overwrite").parquet(f"{noted}/batch={number}")
        read_files(session, headers, schema).write.mode("overwrite").parquet(target)

    query = files.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(
        availableNow=True).start()
    query.awaitTermination()
    return query


def collapse_copies(df, keys):
    """Drop repeated keys inside each Arrow batch, before any shuffle.

    Built-in stream operators do not combine on the map side, so a key with very many
    copies would send them all to one state task.  This leaves it one row per batch of
    input rows.  It keeps no state and needs no shuffle.
    """
    def first_rows(batches):
        for batch in batches:
            columns = {k: batch.column(k) for k in keys}
            columns["_row"] = np.arange(batch.num_rows)
            kept = pa.table(columns).group_by(keys, use_threads=False).aggregate([("_row", "min")])
            yield batch.take(kept.column("_row_min").combine_chunks())

    return df.mapInArrow(first_rows, df.schema)


def dedupe_stream(df, keys, collapse=True, watermark=None):
    """First arrival of each key, across batches.

    ``watermark`` (date or timestamp column, delay) bounds the state for feeds whose copies
    arrive close together; without it the state holds every key seen.
    """
    if collapse:
        df = collapse_copies(df, keys)
    if watermark:
        column, delay = watermark
        if isinstance(df.schema[column].dataType, DateType):
            timed = df.withColumn(_EVENT_TIME, F.col(column).cast("timestamp"))
            return timed.withWatermark(_EVENT_TIME, delay).dropDuplicatesWithinWatermark(
                keys).drop(_EVENT_TIME)
        return df.withWatermark(column, delay).dropDuplicatesWithinWatermark(keys)
    return df.dropDuplicates(keys)


def dedupe_least(df, keys, time_column, delay):
    """The least copy of each key, in whatever order copies arrive within ``delay``.

    ``time_column``, a date or timestamp, must be one of the keys.  A key's least row so far is
    kept in state and leaves, once, when the watermark has passed it; copies combine before the
    shuffle, so a key with very many costs one row per task.  The rows are those of the
    batch dedupe, whereas ``dedupe_stream`` keeps the first arrival at once.
    """
    if time_column not in keys:
        raise ValueError(f"{time_column} must be one of the keys")
    rest = [c for c in df.columns if c not in keys]
    timed = df.withColumn(_EVENT_TIME, F.col(time_column).cast("timestamp")).withWatermark(
        _EVENT_TIME, delay)
    least = timed.groupBy(*keys, _EVENT_TIME).agg(F.min(F.struct(*rest)).alias("_least"))
    return least.select(*[F.col("_least")[c].alias(c) if c in rest else c for c in df.columns])


def silver_stream(bronze, table, observe=False, **dedupe_options):
    """Typed, checked and deduplicated stream; ``observe`` puts rule counts in its progress."""
    rules = EXPECTATIONS[table]
    gated = apply_expectations(typed(bronze, table), rules, f"{table}_quality" if observe else None)
    return dedupe_stream(gated, KEYS[table], **dedupe_options)


def store_counts(counts, path, name):
    """Write rule counts (dataset, batch, measure, row_count) in place of earlier ones of a name."""
    counts.select("dataset", "batch", "measure", "row_count").coalesce(1).write.mode(
        "overwrite").parquet(f"{path}/{name}")


def rule_counts(spark, path):
    """(dataset, batch, measure, row_count) of all batches stored."""
    whole = [f for f in folders(spark, path) if exists(spark, f"{f}/_SUCCESS")]
    if not whole:
        return spark.createDataFrame([], _COUNTS)
    return spark.read.schema(_COUNTS).parquet(*whole)


def count_batches(spark, table, source, schema, checkpoint, path):
    """Store the rule counts of all batches that a silver stream has committed and that have none.

    Which files a batch took is read from the stream's own log, up to its last commit, so counts
    are exact whenever the driver was lost, however many batches ran and whatever history of
    progress is kept.  Only bronze folders that hold such files are read, for the columns that
    rules need.
    """
    committed = [int(n) for n in names(spark, f"{checkpoint}/commits") if n.isdigit()]
    if not committed:
        return
    offsets = [r.value for r in spark.read.text(
        f"{checkpoint}/offsets/{max(committed)}", wholetext=True).collect()][0].splitlines()
    upto = json.loads(offsets[2])["logOffset"]
    known = rule_counts(spark, path).where(F.col("dataset") == table).select("batch").distinct()
    log = spark.read.text(f"{checkpoint}/sources/0").select(
        F.from_json("value", "path string, batchId bigint").alias("e")).where(
        f"e.path IS NOT NULL AND e.batchId <= {upto}").select(
        F.col("e.batchId").alias("batch"), F.regexp_extract("e.path", "[^/]+$", 0).alias("name"),
        F.regexp_extract("e.path", "/batch=([0-9]+)/[^/]+$", 1).alias("folder")).distinct().join(
        known, "batch", "left_anti")
    taken = [r.folder for r in log.select("folder").distinct().collect()]
    if not taken:
        return
    rows = typed(spark.read.schema(schema).parquet(*[f"{source}/batch={n}" for n in taken]),
                 table).select("*", F.col("_metadata.file_name").alias("name"))
    rules = [r for r in EXPECTATIONS[table] if r.action != FAIL]
    counted = rows.join(log.select("batch", "name"), "name").groupBy("batch").agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count_if(~r.holds).alias(r.name) for r in rules])
    lines = F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).alias("row_count"))
                      for m in ("total_rows", *[r.name for r in rules])])
    store_counts(counted.select(F.lit(table).alias("dataset"), "batch", F.inline(lines)), path,
                 f"{table}-upto-{upto}")
