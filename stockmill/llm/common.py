"""Helpers shared by the text operators."""

import ctypes
import gc

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from stockmill.session import new_dir

FOLDS = 5
SLICE_BYTES = 8 << 20


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id="doc_id"):
    """Fold 0 of five by CRC-32 of the id's text; a null id is never held out."""
    remainder = F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS
    return F.coalesce(remainder == 0, F.lit(False))


def stored(df, label):
    """Write a DataFrame below the shared folder and read it back: a cut in the lineage that
    survives lost executors."""
    path = new_dir(df.sparkSession, label)
    df.write.parquet(path)
    held = df.sparkSession.read.schema(df.schema).parquet(path)
    held.stored_at = path
    return held


def discard(*tables):
    """Delete tables that ``stored`` gave and nothing reads any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def unbounded(df):
    """A join side that grows with the corpus: sorted and merged at every size, never broadcast."""
    return df.hint("merge")


def free_shuffles(spark):
    """Let the driver notice unused shuffle files between rounds of a loop."""
    spark.sparkContext._jvm.System.gc()


def slices(batches):
    """Batches of about ``SLICE_BYTES``, so that what is made of one stays small."""
    for batch in batches:
        rows = max(1, batch.num_rows * SLICE_BYTES // max(1, batch.nbytes))
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def give_back():
    """Return freed memory to the system: a Python worker waits for its next task, and would
    hold what this one took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def with_arrow_columns(df, inputs, outputs, prepare, keep=None):
    """Add columns computed per Arrow batch, whatever the other columns are called.

    ``inputs`` are columns, or names of columns that are carried anyway and so need not be
    sent twice; ``outputs`` is a DDL list, ``prepare()`` runs once per task and gives
    a function from the input arrays to one list or array per output.  The result has two
    columns: ``row`` (the columns ``keep`` of ``df``, or all) and ``out`` (the outputs).
    """
    packed = df.select(
        F.struct(*[F.col(f"`{c}`") for c in keep or df.columns]).alias("row"),
        F.struct(F.lit(True).alias("x"), *[
            column.alias(f"x{i}") for i, column in enumerate(inputs)
            if not isinstance(column, str)]).alias("x"),
    )
    out_type = StructType.fromDDL(outputs)
    names = [x if isinstance(x, str) else None for x in inputs]
    schema = StructType().add(packed.schema["row"]).add("out", out_type, False)

    def run(batches):
        compute = prepare()
        types = [to_arrow_type(f.dataType) for f in out_type.fields]
        fields = [pa.field(f.name, t) for f, t in zip(out_type.fields, types)]
        for batch in slices(batches):
            row, sent = batch.column("row"), iter(batch.column("x").flatten()[1:])
            columns = compute(*[row.field(row.type.get_field_index(x)) if isinstance(x, str)
                                else next(sent) for x in names])
            arrays = [c.cast(t) if isinstance(c, pa.Array) else pa.array(c, type=t)
                      for c, t in zip(columns, types)]
            out = pa.StructArray.from_arrays(arrays, fields=fields)
            yield pa.RecordBatch.from_arrays([row, out], names=["row", "out"])
            del columns, arrays, out
            pa.default_memory_pool().release_unused()
        del compute
        give_back()

    return packed.mapInArrow(run, schema)
