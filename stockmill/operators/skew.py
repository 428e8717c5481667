"""Joins whose frequent keys are spread over many tasks, without adaptive execution.

A sketch of fixed size finds the keys that hold more than a task's fair share.  Their fact rows
get a salt, and their dimension rows are repeated once per salt; all other keys join as usual.
Everything is one plan: the sketch's keys are at most ``TRACKED`` rows, so they are broadcast.
"""

from pyspark.sql import functions as F

#: Keys the sketch may report and those it follows; a key with more than 1 / ``TRACKED`` of the
#: rows cannot escape it.
REPORTED = 1_000
TRACKED = 10_000
#: Fair share: rows divided by this many tasks.
TASKS = 200
_SALT, _KEY, _COPIES = "_salt", "_heavy", "_copies"


def heavy_keys(facts, key, tasks=TASKS):
    """(_heavy, _copies): keys with more than a fair share of the rows and the tasks they need."""
    told = facts.agg(F.expr(f"approx_top_k(`{key}`, {REPORTED}, {TRACKED})").alias("top"),
                     F.count(F.lit(1)).alias("rows")).select(F.explode("top").alias("t"), "rows")
    copies = F.ceil(F.col("t.count") * tasks / F.col("rows")).cast("int")
    return told.select(F.col("t.item").alias(_KEY), copies.alias(_COPIES)).where(
        (F.col(_COPIES) > 1) & F.col(_KEY).isNotNull())


def join_spread(facts, dimension, key, tasks=TASKS, how="inner"):
    """``facts`` joined to ``dimension`` on ``key`` (``how``: inner or left).

    ``dimension`` may hold a key more than once.  The salt is the row's place in its partition, so
    rows that are alike in every column are spread too.
    """
    if how not in ("inner", "left"):
        raise ValueError("only inner and left joins keep their rows when salted")
    heavy = F.broadcast(heavy_keys(facts, key, tasks))
    copies = F.coalesce(F.col(_COPIES), F.lit(1))
    salted = facts.join(heavy, F.col(key) == F.col(_KEY), "left").withColumn(
        _SALT, F.pmod(F.monotonically_increasing_id(), copies).cast("int")).drop(_KEY, _COPIES)
    repeated = dimension.join(heavy, F.col(key) == F.col(_KEY), "left").withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), copies - 1))).drop(_KEY, _COPIES)
    return salted.join(repeated, [key, _SALT], how).drop(_SALT)
