"""Sharding by best-fit decreasing: whole groups into as few equal shards as possible.

A group is all rows with the same text.  Groups are counted by size; from the largest down,
each enters the open shard with the least room that still takes it (found in a balanced tree
of rooms), or opens a new one.  Groups of one size fill a shard one after another, because
after one has entered, that shard has the least room again; so the counts per size, not the
groups, pass through the driver.  Sizes are exact.  As different sizes add up to no more than
all bytes, there are at most sqrt(2 * bytes) of them: 14 million for 100 TB, if every text were
of another length.

A null text counts as an empty one.  Repeated rows are of one group.  A group larger than a
shard's capacity has a shard of its own.  An empty table gives no rows.
"""

import random
from dataclasses import dataclass

from pyspark.sql import Window, functions as F

from stockmill.llm.common import stored

SHARDS = 8
#: Least spread of one size class, and of one shard's rows, over tasks.
PIECES = 64
ROWS_PER_PIECE = 50_000
FINENESS = 20_000


class RoomTree:
    """Rooms of open shards, ordered by (room, shard): a treap, balanced in expectation."""

    def __init__(self, seed=5):
        self._root, self._random = None, random.Random(seed)

    def add(self, room, shard):
        low, high = self._split(self._root, (room, shard))
        node = [(room, shard), self._random.random(), None, None]
        self._root = self._join(self._join(low, node), high)

    def take_tightest(self, size):
        """Remove and return the smallest room that holds ``size``, or None."""
        low, high = self._split(self._root, (size, -1))
        if high is None:
            self._root = low
            return None
        node = high
        while node[2]:
            node = node[2]
        _, rest = self._split(high, (node[0][0], node[0][1] + 1))
        self._root = self._join(low, rest)
        return node[0]

    def _split(self, node, key):
        if node is None:
            return None, None
        if node[0] < key:
            node[3], high = self._split(node[3], key)
            return node, high
        low, node[2] = self._split(node[2], key)
        return low, node

    def _join(self, low, high):
        if low is None or high is None:
            return low or high
        if low[1] < high[1]:
            low[3] = self._join(low[3], high)
            return low
        high[2] = self._join(low, high[2])
        return high


@dataclass(frozen=True)
class Run:
    """Groups ``first`` to ``last`` (from 0) of a size class go to one shard."""

    size: int
    first: int
    last: int
    shard: int


def best_fit_decreasing(counts, capacity, limit=None):
    """Runs for {size: number of groups}; None when more than ``limit`` shards are needed."""
    rooms, runs, opened = RoomTree(), [], 0
    for size in sorted(counts, reverse=True):
        placed = 0
        while placed < counts[size]:
            found = rooms.take_tightest(size)
            if found is None:
                if opened == limit:
                    return None
                found, opened = (max(capacity, size), opened), opened + 1
            room, shard = found
            n = min(counts[size] - placed, room // size)
            runs.append(Run(size, placed, placed + n - 1, shard))
            placed += n
            rooms.add(room - n * size, shard)
    return runs


def fill_shards(counts, shards):
    """Runs for the least capacity, to a part in ``FINENESS``, at which ``shards`` suffice."""
    total = sum(size * n for size, n in counts.items())
    low = max(-(-total // shards), 1)
    step, high = max(1, low // FINENESS), low
    while (runs := best_fit_decreasing(counts, high, shards)) is None:
        low, high = high + 1, high * 2
    while high - low >= step:
        middle = (low + high) // 2
        tried = best_fit_decreasing(counts, middle, shards)
        if tried is None:
            low = middle + 1
        else:
            runs, high = tried, middle
    return runs


def pack(docs, text="text", doc_id="doc_id", shards=None, capacity=None):
    """doc_id, size, text_crc32, shard, slot for every row.

    Give ``capacity`` (bytes per shard; as few shards as best fit decreasing finds) or
    ``shards`` (their number; the least capacity that suffices, so sizes are near equal).
    """
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"),
        (F.octet_length(body).cast("bigint") + 1).alias("size"),
        F.crc32(body.cast("binary")).cast("bigint").alias("text_crc32"),
        F.xxhash64(body).alias("h1"), F.hash(body).alias("h2"),
        F.monotonically_increasing_id().alias("row_id"),
    )
    rows = stored(rows, "shard-rows")
    key = ["h1", "h2", "text_crc32", "size"]
    groups = rows.groupBy(*key).agg(F.sum("size").alias("bytes"))
    groups = stored(groups.select(*key, F.col("bytes").alias("class")), "shard-groups")
    spread = max(PIECES, groups.count() // ROWS_PER_PIECE)
    groups = groups.withColumn("piece", F.pmod(F.xxhash64("h2", "h1"), F.lit(spread)))
    pieces = groups.groupBy("class", "piece").agg(F.count("*").alias("n"))
    counts = {r["class"]: r["n"] for r in
              pieces.groupBy("class").agg(F.sum("n").alias("n")).toLocalIterator()}
    runs = (best_fit_decreasing(counts, capacity) if capacity else
            fill_shards(counts, shards or SHARDS))
    placed = _placed(groups, pieces, runs)
    joined = rows.join(stored(placed, "shard-of-group"), key).drop("h1", "h2")
    return _slots(stored(joined, "shard-of-row"))


def _placed(groups, pieces, runs):
    """Shard of every group: its rank in the size class falls into one run."""
    spark = groups.sparkSession
    plan = spark.createDataFrame(
        [(r.size, r.first, r.last, r.shard) for r in runs],
        "class bigint, first bigint, last bigint, shard int")
    before = Window.partitionBy("class").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = pieces.select("class", "piece",
                            F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("class", "piece").orderBy("h1", "h2", "text_crc32")
    ranked = groups.withColumn("rank", F.row_number().over(inside) - 1).join(
        offsets, ["class", "piece"])
    rank = F.col("rank") + F.col("offset")
    return ranked.join(plan, "class").where(
        rank.between(F.col("first"), F.col("last"))).select(
        "h1", "h2", "text_crc32", "size", "shard")


def _slots(rows):
    """Number the rows of each shard from 0 without gaps; no task holds a whole shard."""
    total = rows.count()
    pieces = max(PIECES, total // ROWS_PER_PIECE)
    spread = rows.withColumn(
        "piece", F.pmod(F.xxhash64("row_id"), F.lit(pieces)))
    before = Window.partitionBy("shard").orderBy("piece").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = spread.groupBy("shard", "piece").agg(F.count("*").alias("n")).select(
        "shard", "piece", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "piece").orderBy("row_id")
    return spread.withColumn("slot", F.row_number().over(inside) - 1).join(
        offsets, ["shard", "piece"]).select(
        "doc_id", "size", "text_crc32", "shard",
        (F.col("slot") + F.col("offset")).cast("bigint").alias("slot"))
