"""Connected components of an edge table by contraction, smallest member as the name."""

from pyspark.sql import functions as F

from stockmill.llm.common import free_shuffles, stored


def components(edges):
    """(id, component) of every end of ``edges`` (columns a, b).

    In each round every node gives way to the neighbour that comes first in a random order, or
    stays; edges are renamed, and those that became loops or doubles go.  A constant share of
    the nodes vanishes each round, chains included.  Edges and steps are stored per round, so a
    hub's rows can be split over tasks and a lost executor costs no earlier round.
    """
    spark = edges.sparkSession
    left = stored(_plain(edges.select("a", "b")), "links")
    names, turn = None, 0
    while names is None or left.limit(1).count():
        both = left.union(left.select("b", "a"))
        place = F.xxhash64(F.lit(turn), "b")
        near = both.groupBy(F.col("a").alias("id")).agg(
            F.min_by("b", place).alias("near"), F.min(place).alias("first"))
        step = stored(near.select("id", F.when(
            F.xxhash64(F.lit(turn), "id") <= F.col("first"), F.col("id")).otherwise(
            F.col("near")).alias("to")), "steps")
        for end in "ab":
            moved = step.select(F.col("id").alias(end), F.col("to").alias(f"{end}_to"))
            left = left.join(moved, end).drop(end).withColumnRenamed(f"{end}_to", end)
        left = stored(_plain(left.select("a", "b")), "links")
        if names is None:
            names = step
        else:
            later = step.select(F.col("id").alias("to"), F.col("to").alias("next"))
            names = stored(names.join(later, "to", "left").select(
                "id", F.coalesce("next", "to").alias("to")), "names")
        turn += 1
        free_shuffles(spark)
    lowest = stored(names.groupBy("to").agg(F.min("id").alias("component")), "lowest")
    return stored(names.join(lowest, "to").select("id", "component"), "components")


def _plain(edges):
    """Each edge once, without loops."""
    return edges.where("a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
