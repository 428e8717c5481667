"""CSV landing folders, read by the names in each file's header.

Files of one feed may differ in the order of their columns.  The first line of each file, taken
from its first bytes, is its header; files with one header are read together, once, by Spark's
CSV reader, so a column can never land in another one's place.  A column that a file lacks is
NULL; a column that the feed does not know is kept by name in a map.
"""

import csv
import re
import warnings
from concurrent.futures import ThreadPoolExecutor
from functools import reduce
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from stockmill.schemas import FEEDS

LANDING_PATH = "stockmill.landing_path"
DEFAULT_LANDING_PATH = "landing"
CORRUPT = "_corrupt_record"
#: Values of columns that the feed does not know, by name.
EXTRA = "_extra"
#: Files whose names and headers the driver holds at once.
FILES_AT_ONCE = 10_000
HEADER_BYTES = 1 << 20
_READERS = 16
_HEADERS = "file string, header string"


def landing_path(spark):
    """Root of the landing folders, from the session configuration."""
    return spark.conf.get(LANDING_PATH, DEFAULT_LANDING_PATH)


def feed_path(root, feed):
    return f"{root.rstrip('/')}/{feed}"


def with_corrupt_record(schema):
    """The schema plus a column that keeps the text of rows that do not fit it."""
    return StructType([*schema.fields, StructField(CORRUPT, StringType())])


def listed(spark, path):
    """Names of the files of a folder; contents are not asked for, so they are not read."""
    return spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("file"))


def first_lines(spark, files):
    """[(file, first line that is not blank)]; at most ``HEADER_BYTES`` of a file are read."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)

    def first_line(file):
        path = jvm.org.apache.hadoop.fs.Path(unquote(file))
        stream = path.getFileSystem(conf).open(path)
        try:
            codec = codecs.getCodec(path)
            start = jvm.org.apache.commons.io.input.BoundedInputStream(
                codec.createInputStream(stream) if codec else stream, HEADER_BYTES)
            lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(start, "UTF-8"))
            line = lines.readLine()
            while line is not None and not line.strip():
                line = lines.readLine()
        finally:
            stream.close()
        return file, (line or "").lstrip("\ufeff")

    with ThreadPoolExecutor(_READERS) as pool:
        return list(pool.map(first_line, files))


def note_headers(spark, path, noted):
    """The headers of all files of a folder, kept in the table ``noted``; a later call reads
    only the files that are not noted yet, whatever their modification time."""
    try:
        known = spark.read.schema(_HEADERS).parquet(noted)
    except AnalysisException:
        known = None
    files = listed(spark, path)
    new = [r.file for r in (files.join(known, "file", "left_anti") if known else files).collect()]
    for start in range(0, max(1, len(new)), FILES_AT_ONCE):
        lines = first_lines(spark, new[start:start + FILES_AT_ONCE])
        if lines or known is None:
            spark.createDataFrame(lines, _HEADERS).write.mode("append").parquet(noted)
    return spark.read.schema(_HEADERS).parquet(noted)


def _columns(header, schema):
    """Names of a header's columns; repeated ones are numbered, unknown ones reported."""
    names = []
    for name in next(csv.reader([header]), []):
        name, n = name.strip(), 1
        while (name if n == 1 else f"{name}#{n}") in names:
            n += 1
        names.append(name if n == 1 else f"{name}#{n}")
    unknown = [n for n in names if n not in schema.names]
    if unknown:
        warnings.warn(f"columns kept in {EXTRA}: {', '.join(unknown)}", stacklevel=3)
    return names, unknown


def _laid(names, schema):
    """Columns by place: a header may hold any name."""
    known = {f.name: f.dataType for f in schema.fields}
    return StructType([*[StructField(f"_c{i}", known.get(n, StringType()))
                         for i, n in enumerate(names)], StructField(CORRUPT, StringType())])


def _cells(names, unknown, schema, value):
    """The schema's columns, the malformed text and the unknown columns of a parsed row."""
    place = {n: f"_c{i}" for i, n in enumerate(names)}
    cells = [(value(place[f.name]) if f.name in place else F.lit(None).cast(f.dataType))
             .alias(f.name, metadata=f.metadata) for f in schema.fields]
    extra = F.lit(None).cast(MapType(StringType(), StringType()))
    if unknown:
        extra = F.map_filter(
            F.map_from_arrays(F.array(*[F.lit(n) for n in unknown]),
                              F.array(*[value(place[n]) for n in unknown])),
            lambda _, v: v.isNotNull())
    return [*cells, value(CORRUPT).alias(CORRUPT), extra.alias(EXTRA)]


def read_files(spark, headers, schema):
    """Rows of files [(file, header)]: the schema's columns, ``_corrupt_record`` and ``_extra``.

    Files with one header are one scan.
    """
    groups = {}
    for file, header in headers:
        groups.setdefault(header, []).append(re.sub(r"([\\*?\[\]{}])", r"\\\1", unquote(file)))
    parts = []
    for header in sorted(groups):
        names, unknown = _columns(header, schema)
        raw = spark.read.schema(_laid(names, schema)).option("header", True).option(
            "columnNameOfCorruptRecord", CORRUPT).csv(groups[header])
        parts.append(raw.select(*_cells(names, unknown, schema, F.col)))
    if not parts:
        parts = [spark.createDataFrame([], _laid((), schema)).select(
            *_cells((), (), schema, F.col))]
    return reduce(lambda a, b: a.union(b), parts)


def _bound(parsed, names, unknown, schema):
    """The cells of a parsed row, which the function binds once for all of them."""
    return F.transform(F.array(parsed), lambda r: F.struct(
        *_cells(names, unknown, schema, lambda n: r[n])))[0]


def parse_lines(lines, headers, schema):
    """Rows of CSV text (``value``, ``file``) as the schema's columns and ``_corrupt_record``.

    The number of different header lines is small; each gives one way to parse.
    """
    kinds = [r.header for r in headers.select("header").distinct().orderBy("header").collect()]
    row = F.raise_error(F.concat(F.lit("no header noted for "), F.col("file")))
    row = F.transform(F.array(row), lambda text: F.struct(
        *_cells((), (), schema, lambda n: text)))[0]
    for header in kinds:
        names, unknown = _columns(header, schema)
        parsed = F.from_csv(
            "value", ", ".join(f"{f.name} {f.dataType.simpleString()}"
                               for f in _laid(names, schema).fields),
            {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
        row = F.when(F.col("header").eqNullSafe(header),
                     _bound(parsed, names, unknown, schema)).otherwise(row)
    body = lines.join(headers.select("file", "header"), "file", "left").where(
        (F.col("value") != "") & ~F.col("value").eqNullSafe(F.col("header")))
    rows = body.select(F.inline(F.array(row)))
    fields = {f.name: f.metadata for f in schema.fields}
    return rows.select(*[F.col(n).alias(n, metadata=m) for n, m in fields.items()], CORRUPT)


def read_csv(spark, path, schema, keep_malformed=False):
    """CSV files by header; ``keep_malformed`` adds the text of rows that do not fit and the
    columns that the schema does not know."""
    files = [r.file for r in listed(spark, path).collect()]
    rows = read_files(spark, first_lines(spark, files), schema)
    return rows if keep_malformed else rows.drop(CORRUPT, EXTRA)


def read_item_master(spark, root, keep_malformed=False):
    return read_csv(spark, feed_path(root, "item_master"), FEEDS["item_master"], keep_malformed)


def land(df, root, feed, mode="append"):
    """Drop rows into a feed's landing folder as CSV files with a header."""
    df.select(*FEEDS[feed].names).write.mode(mode).option("header", True).csv(feed_path(root, feed))
