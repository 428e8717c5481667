"""Running a query and its SQL on the same tables and comparing the rows."""

import datetime
import decimal
import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, datetime.datetime):
        return value.date() if value.time() == datetime.time() else value
    return value


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_cell(row[i]) for i in order) for row in rows]
    return sorted(columns), sorted(out, key=repr)


def spark_rows(df):
    return _rows(df.columns, df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    return _rows([c[0] for c in result.description], result.fetchall())


def difference(actual, expected):
    """Empty when equal, else a short description."""
    if actual[0] != expected[0]:
        return f"columns {actual[0]} != {expected[0]}"
    if len(actual[1]) != len(expected[1]):
        return f"row counts {len(actual[1])} != {len(expected[1])}"
    wrong = [(a, e) for a, e in zip(actual[1], expected[1]) if a != e]
    return f"{len(wrong)} rows differ, first {wrong[0]}" if wrong else ""
