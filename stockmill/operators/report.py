"""Report tables: detail rows followed by one total row."""

from pyspark.sql import functions as F, types as T

from stockmill import rules


def summable_columns(schema, words=rules.NUMERIC_WORDS, label_columns=2):
    """Numeric columns named like a number; the leading label columns never count."""
    return [
        f.name for f in schema.fields[label_columns:]
        if isinstance(f.dataType, T.NumericType) and any(w in f.name.lower() for w in words)
    ]


def report_totals(detail, label_columns=None):
    """Detail rows plus one row of sums; text columns of the total row hold a dash.

    The first two columns are labels, or the first one where there are only two columns.

    The total is a plain aggregate, combined before its one-row shuffle.
    """
    if label_columns is None:
        label_columns = min(2, len(detail.columns) - 1)
    first = detail.columns[0]
    summed = summable_columns(detail.schema, label_columns=label_columns)
    total = detail.agg(*[F.sum(c).alias(c) for c in summed]) if summed else detail.agg(
        F.count(F.lit(1)).alias("rows"))
    cells = [F.lit(rules.TOTAL_LABEL).alias(first)]
    for i, field in enumerate(detail.schema.fields[1:], start=1):
        if field.name in summed:
            cell = F.col(field.name)
        elif i >= label_columns and isinstance(field.dataType, T.StringType):
            cell = F.lit(rules.NO_TOTAL)
        else:
            cell = F.lit(None).cast(field.dataType)
        cells.append(cell.alias(field.name))
    return (
        detail.withColumn(first, F.col(first).cast("string"))
        .withColumn("row_kind", F.lit("detail"))
        .unionByName(total.select(*cells, F.lit("total").alias("row_kind")))
    )
