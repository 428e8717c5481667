"""Near-duplicate vectors by NN-descent on cosine similarity.

Vectors are scaled to length one; equal ones are one point with a count.  The neighbour graph
starts from random-projection orders: points are sorted by the signs of random projections,
and each looks at the points next to it.  Each round then joins neighbours of neighbours:
around every point, its list and the points that list it meet and exchange better neighbours.
Rounds end when hardly any list that has room gains links (similarity at the threshold).

A list full of links is saturated: its point may have more.  Inside the point's connected part
of the graph all members meet in blocks of bounded size; there cosines are taken in double
precision and links leave as counts and spanning ties, so a large group of copies costs no row
per pair.  Links to other parts, which closer members of its own part keep off a full list, are
searched on their own: full points keep second lists of the best points of other parts, parts
with a link become one, and this goes on until no full point has a link to another part.

Recall is audited: points sampled from parts of every size, and from those without links, are
compared with all.  Each counts by the share of its own links that was found, so a large group
does not outweigh small ones.  While that falls short further projection orders and rounds
follow; in the end it is an error.

Null, empty and zero vectors, and those with null or non-finite components, link with nothing,
nor do vectors of different lengths.  Repeated rows are copies.  A null id names nothing.
"""

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockmill.llm.common import free_shuffles, stored, with_arrow_columns
from stockmill.llm.components import components
from stockmill.llm.ngram_join import smallest_reached

SIMILARITY = 0.9
NEIGHBOURS = 10
ORDERS = 12
BESIDE = 32
#: Points of a block, and of the part of a hub's listeners that meet at once.
BLOCK, LISTENERS = 256, 96
#: Points of a part that look for other parts at each place of an order.
LANES = 8
AUDIT, RECALL, ATTEMPTS = 256, 0.99, 4
AUDIT_ROWS = 1024
#: Slack for the half-precision vectors that the graph is built with.
SLACK = 0.004
SETTLED = 0.002


def unit(values):
    """The vector scaled to length one in double precision, or None if it cannot be."""
    if not values or any(v is None for v in values):
        return None
    x = np.array(values, np.float64)
    top = np.abs(x).max()
    if not np.isfinite(x).all() or top == 0:
        return None
    x = x / top
    return x / np.linalg.norm(x)


def _points(rows):
    """Every row with the name of its point (null: none) and the unit vector."""

    def prepare():
        def compute(vectors):
            names, units = [], []
            for values in vectors.to_pylist():
                x = unit(values)
                units.append(None if x is None else x.tobytes())
                names.append(None if x is None else xxhash.xxh3_128_digest(
                    np.array(values, np.float64).tobytes()))
            return names, units

        return compute

    return with_arrow_columns(rows, [F.col("vector")], "name binary, unit binary",
                              prepare).select("row.vec_id", "out.name", "out.unit")


def _stack(column, dtype):
    return [np.frombuffer(x, dtype) for x in column.to_pylist()]


def _best(ids, vectors, k, parts, worse=None):
    """For each point of a group its best points of other parts: rows (id, near, sim)."""
    out = []
    sizes = np.array([len(v) for v in vectors])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        if len(at) < 2:
            continue
        x = np.stack([vectors[i] for i in at]).astype(np.float32)
        sims = x @ x.T
        sims[parts[at][:, None] == parts[at][None]] = -2
        n = min(k, len(at) - 1)
        top = np.argpartition(-sims, n - 1, axis=1)[:, :n]
        found = np.take_along_axis(sims, top, 1)
        good = found > (worse[at][:, None] if worse is not None else -1.5)
        mine = np.broadcast_to(ids[at][:, None], top.shape)[good]
        out.append((mine, ids[at][top][good], found[good]))
    return [np.concatenate(x) for x in zip(*out)] if out else None


_LISTED = "id bigint, near bigint, sim float"
_LISTED_SCHEMA = pa.schema([("id", pa.int64()), ("near", pa.int64()), ("sim", pa.float32())])


def _spread(points, bits, seed, orders=ORDERS):
    """Each point with its place in every random-projection order: order, code, fine."""

    def keys():
        def planes(size):
            rng = np.random.default_rng([seed, size])
            return rng.standard_normal((size, orders * (bits + 1))).astype(np.float32)

        known = {}

        def compute(units):
            codes, fine = [], []
            for x in _stack(units, np.float16):
                if len(x) not in known:
                    known[len(x)] = planes(len(x))
                p = (x.astype(np.float32) @ known[len(x)]).reshape(orders, bits + 1)
                codes.append(((p[:, :bits] > 0) @ (1 << np.arange(bits))).tolist())
                fine.append(p[:, bits].tolist())
            return codes, fine

        return compute

    keyed = with_arrow_columns(points.select("id", "part", "half"), [F.col("half")],
                               "codes array<bigint>, fine array<float>", keys)
    return keyed.select(
        "row.id", "row.part", "row.half",
        F.explode(F.arrays_zip(F.sequence(F.lit(1), F.lit(orders)).alias("o"),
                               F.col("out.codes").alias("c"), F.col("out.fine").alias("f"))
                  ).alias("k")).select("id", "part", "half", "k.*").toDF(
        "id", "part", "half", "order", "code", "fine")


def _bits(n, beside=BESIDE):
    return max(1, math.ceil(math.log2(max(2, n / beside))))


def _orders(spread, beside=BESIDE):
    """Neighbours of other parts found next to each point in random-projection orders."""

    def look(batches):
        ids, vectors = np.zeros(0, np.int64), []
        parts, order = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            ids = np.concatenate([ids, batch.column("id").to_numpy()])
            parts = np.concatenate([parts, batch.column("part").to_numpy()])
            order = np.concatenate([order, batch.column("order").to_numpy()])
            vectors = vectors + _stack(batch.column("half"), np.float16)
            start = 0
            while start + beside // 2 < len(ids) or start == 0:
                end = start + beside
                for o in np.unique(order[start:end]):
                    at = start + np.flatnonzero(order[start:end] == o)
                    found = _best(ids[at], [vectors[i] for i in at], 4, parts[at])
                    if found:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(x) for x in found], schema=_LISTED_SCHEMA)
                start += beside // 2
            ids, parts, order = ids[start:], parts[start:], order[start:]
            vectors = vectors[start:]

    ranged = spread.repartitionByRange("order", "code", "fine").sortWithinPartitions(
        "order", "code", "fine")
    return ranged.select("id", "part", "half", F.col("order").cast("bigint").alias("order")
                         ).mapInArrow(look, _LISTED)


def _kept(listed, k, similarity):
    """The k best of each point's neighbours, and how many of them are links."""
    pair = listed.repartition("id").groupBy("id", "near").agg(F.max("sim").alias("sim"))
    return pair.groupBy("id").agg(F.slice(F.sort_array(F.collect_list(
        F.struct("sim", "near")), False), 1, k).alias("list")).withColumn(
        "links", F.size(F.filter("list", lambda n: n["sim"] >= similarity - SLACK)))


def _listed(lists):
    return lists.select("id", F.explode("list").alias("n")).select("id", "n.near", "n.sim")


def _descend(near, lists, points, k, similarity):
    """One round: around every point the points it is ``near`` to and its listeners meet, and
    ``lists`` take better neighbours of other parts."""
    listeners = stored(near.groupBy("near").agg(
        F.ceil(F.count("*") / LISTENERS).cast("int").alias("parts")).select(
        F.col("near").alias("center"), "parts"), "listeners")
    part = F.pmod(F.xxhash64("member"), F.col("parts")).cast("int")
    back = near.select(F.col("near").alias("center"), F.col("id").alias("member")).join(
        listeners, "center").select("center", "member", part.alias("share"))
    ahead = near.select(F.col("id").alias("center"), F.col("near").alias("member")).union(
        near.select(F.col("id").alias("center"), F.col("id").alias("member"))).distinct().join(
        listeners, "center", "left").select(
        "center", "member",
        F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("share"))
    around = ahead.union(back).distinct()
    last = F.col("list")[F.size("list") - 1]["sim"]
    worst = stored(points.join(lists, "id", "left").select(
        F.col("id").alias("member"), "half", "part",
        F.when(F.size("list") >= k, last).otherwise(F.lit(-1.5)).cast("float").alias("worst")),
        "worst")
    placed = around.join(worst, "member").repartition("center", "share").sortWithinPartitions(
        "center", "share")

    def meet(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            key = held.column("center").to_numpy() * 31 + held.column("share").to_numpy()
            heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            if len(heads) > 1:
                yield from exchange(held.slice(0, heads[-1]), heads[:-1])
                held = held.slice(heads[-1]).combine_chunks()
        if held is not None:
            yield from exchange(held, np.zeros(1, np.int64))

    def exchange(table, heads):
        ids, worse = table.column("member").to_numpy(), table.column("worst").to_numpy()
        parts = table.column("part").to_numpy()
        vectors, out = _stack(table.column("half"), np.float16), []
        for low, high in zip(heads, np.append(heads[1:], len(ids))):
            found = _best(ids[low:high], vectors[low:high], k, parts[low:high], worse[low:high])
            if found and len(found[0]):
                out.append(found)
        if out:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(x)) for x in zip(*out)], schema=_LISTED_SCHEMA)

    found = placed.select("center", "share", "member", "half", "part", "worst").mapInArrow(
        meet, _LISTED)
    return _kept(_listed(lists).union(found), k, similarity)


def _settled(before, lists, k):
    """Whether few lists gained links, of those that have room for more; links never leave one."""
    was = before.select("id", F.col("links").alias("was"))
    gained = F.col("links") > F.coalesce("was", F.lit(0))
    room = (F.col("links") > 0) & (F.col("links") < k)
    r = lists.join(was, "id", "left").agg(
        F.count_if(gained).alias("gained"), F.count_if(gained | room).alias("open")).first()
    return r.gained <= SETTLED * r.open


def _ties(lists, similarity):
    """Approximate links of the lists."""
    return _listed(lists).where(F.col("sim") >= similarity - SLACK).select(
        F.col("id").alias("a"), F.col("near").alias("b"))


def _parts(lists, points, k, similarity, seed):
    """(id, part): points of connected parts by approximate links.

    A point whose list is not full has all its links there, so links between parts run between
    full points only.  Of each part a few full points per place of every order look for others.
    """
    parts = components(_ties(lists, similarity)).withColumnRenamed("component", "part")
    full = stored(lists.where(F.col("links") >= k).select("id"), "full-points")
    own = _listed(lists.join(full, "id", "left_semi")).select("id", "near").join(
        full.withColumnRenamed("id", "near"), "near", "left_semi").select("id", "near")
    far = None
    while True:
        at = stored(parts.join(full, "id", "left_semi"), "full-parts")
        n = at.select("part").distinct().count()
        if n < 2:
            return parts
        held = stored(points.select("id", "half").join(at, "id"), "full-vectors")
        rank = F.xxhash64("order", "id")
        few = _spread(held, _bits(n * LANES), seed).groupBy(
            "order", "code", "part", F.pmod(F.xxhash64("id"), F.lit(LANES)).alias("lane")).agg(
            F.min_by(F.struct("id", "half", "fine"), rank).alias("x")).select(
            "order", "code", "part", "x.*")
        seen = _orders(few)
        if far is not None:
            mine, other = (at.select(F.col("id").alias(c), F.col("part").alias(f"{c}_part"))
                           for c in ("id", "near"))
            seen = seen.union(_listed(far).join(mine, "id").join(other, "near").where(
                "id_part <> near_part").select("id", "near", "sim"))
        far, moved = stored(_kept(seen, k, similarity), "far-lists"), True
        while moved:
            near = own.union(_listed(far).select("id", "near")).distinct()
            new = stored(_descend(near, far, held, k, similarity), "far-lists")
            free_shuffles(points.sparkSession)
            best = far.select("id", F.col("list")[0]["sim"].alias("was"))
            better = new.join(best, "id", "left").where(
                F.col("was").isNull() | (F.col("list")[0]["sim"] > F.col("was"))).count()
            far, moved = new, better > SETTLED * held.count()
        joined = _ties(far, similarity)
        for end in "ab":
            joined = joined.join(at.select(F.col("id").alias(end), F.col("part").alias(f"{end}_part")),
                                 end)
        joined = stored(joined.select(F.col("a_part").alias("a"), F.col("b_part").alias("b")
                                      ).distinct(), "joined-parts")
        if not joined.limit(1).count():
            return parts
        parts = stored(parts.join(components(joined).withColumnRenamed("id", "part"), "part", "left"
                                  ).select("id", F.coalesce("component", "part").alias("part")),
                       "parts")


def _all_links(parts, points, similarity):
    """(id, links, low) of each meeting of two blocks of a part, in double precision."""
    sizes = stored(parts.groupBy("part").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "part-sizes")
    placed = parts.join(sizes, "part").withColumn(
        "block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    meetings = stored(placed.select(
        "id", "part", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")), "part-meetings")
    one, two = F.least("block", "other"), F.greatest("block", "other")
    sorted_ = meetings.join(points.select("id", "unit", "copies"), "id").select(
        "id", "unit", "copies", "part", "block", one.alias("one"), two.alias("two"))

    def meet(table):
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        vectors, copies = _stack(table.column("unit"), np.float64), table.column("copies").to_numpy()
        links = np.zeros((len(ids), len(ids)), bool)
        sizes = np.array([len(v) for v in vectors])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            x = np.stack([vectors[i] for i in at])
            links[np.ix_(at, at)] = x @ x.T >= similarity
        if table.column("one")[0].as_py() != table.column("two")[0].as_py():
            links &= block[:, None] != block[None]
        np.fill_diagonal(links, False)
        links &= links.T
        return pa.table({"id": pa.array(ids), "links": pa.array(links @ copies),
                         "low": pa.array(smallest_reached(links, ids))})

    return sorted_.groupBy("part", "one", "two").applyInArrow(
        meet, "id bigint, links bigint, low bigint")


def _audit(points, parts, links, similarity, sample):
    """Least recall of links: of the points in parts of like size, and of all small parts.

    About ``sample`` points are drawn for each power of two of the part size, and as many of the
    points without a part, whose links are all missed.
    """
    sizes = stored(parts.groupBy("part").agg(
        F.floor(F.log2(F.count("*"))).cast("int").alias("grade")), "part-grades")
    graded = stored(points.select("id", "unit").join(
        parts.join(sizes, "part").select("id", "grade"), "id", "left").select(
        "id", "unit", F.coalesce("grade", F.lit(0)).alias("grade")), "graded-points")
    counts = {r.grade: r["count"] for r in graded.groupBy("grade").count().collect()}
    if not counts:
        return 1.0
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for g, n in counts.items()
                           for v in (g, min(scale, scale * sample // n))])
    chosen = graded.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < share[F.col("grade")]).collect()
    queries = {}
    for r in chosen:
        queries.setdefault(len(r.unit), []).append((r.id, np.frombuffer(r.unit, np.float64)))
    shared = points.sparkSession.sparkContext.broadcast(
        {size: (np.array([i for i, _ in q]), np.stack([v for _, v in q]))
         for size, q in queries.items()})

    def count(batches):
        totals = {size: np.zeros(len(asked), np.int64)
                  for size, (asked, _) in shared.value.items()}
        for batch in batches:
            ids, copies = batch.column("id").to_numpy(), batch.column("copies").to_numpy()
            units = batch.column("unit").to_pylist()
            sizes = np.array([len(u) for u in units])
            for size in set(sizes.tolist()) & totals.keys():
                asked, x = shared.value[size]
                of_size = np.flatnonzero(sizes == size)
                for start in range(0, len(of_size), AUDIT_ROWS):
                    at = of_size[start:start + AUDIT_ROWS]
                    near = x @ np.stack([np.frombuffer(units[i], np.float64) for i in at]).T
                    links = (near >= similarity) & (asked[:, None] != ids[at][None])
                    totals[size] += links @ copies[at]
        for size, (asked, _) in shared.value.items():
            yield pa.RecordBatch.from_arrays([pa.array(asked), pa.array(totals[size])],
                                             names=["id", "n"])

    true = points.select("id", "unit", "copies").mapInArrow(count, "id bigint, n bigint").groupBy(
        "id").agg(F.sum("n").alias("n")).where("n > 0")
    true = {r.id: r.n for r in true.collect()}
    ids = points.sparkSession.createDataFrame([(r.id,) for r in chosen], "id bigint")
    found = {r.id: r.links for r in  # bounded by ``sample`` per grade
             links.join(F.broadcast(ids), "id").collect()}
    return least_recall(counts, [(r.grade, found.get(r.id, 0), true.get(r.id, 0)) for r in chosen])


def least_recall(counts, sampled, small=BLOCK):
    """Least recall from the number of points per grade and (grade, found, true) of a sample."""
    least, had, linked = 1.0, 0.0, 0.0
    for grade, n in counts.items():
        of_grade = [(f, t) for g, f, t in sampled if g == grade]
        shares = [min(1.0, f / t) for f, t in of_grade if t]
        if not shares:
            continue
        if grade:
            least = min(least, float(np.mean(shares)))
        if 2 ** grade < small:
            weight = n / len(of_grade)
            had, linked = had + weight * sum(shares), linked + weight * len(shares)
    return min(least, had / linked) if linked else least


def near_duplicates(vectors, vector="embedding", vec_id="vec_id", similarity=SIMILARITY,
                    k=NEIGHBOURS, recall=RECALL, audit=AUDIT):
    """One row per vector: vec_id, n_links, component_id; and the audited recall."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{vector}`").alias("vector"))
    named = stored(_points(rows), "vectors")
    points = named.where("name IS NOT NULL").groupBy("name").agg(
        F.min("vec_id").alias("id"), F.count("*").alias("copies"),
        F.any_value("unit").alias("unit"))

    def halve():
        return lambda units: [[u.astype(np.float16).tobytes()
                               for u in _stack(units, np.float64)]]

    halved = with_arrow_columns(points, [F.col("unit")], "half binary", halve)
    # an id that stands for several vectors is told apart by a number of its own
    points = stored(halved.select(
        F.col("row.id").alias("vec_id"), F.monotonically_increasing_id().alias("id"),
        "row.name", "row.copies", "row.unit", "out.half").withColumn("part", F.col("id")), "points")
    n = points.count()
    lists, found = None, 0.0
    for attempt in range(ATTEMPTS):
        seen = _orders(_spread(points, _bits(n), attempt))
        if lists is not None:
            seen = seen.union(_listed(lists))
        lists = stored(_kept(seen, k, similarity), "lists")
        settled = False
        while not settled:
            before = lists
            lists = stored(_descend(_listed(lists).select("id", "near"), lists, points, k,
                                    similarity), "lists")
            free_shuffles(spark)
            settled = _settled(before, lists, k)
        parts = _parts(lists, points, k, similarity, attempt)
        met = stored(_all_links(parts, points, similarity), "part-links")
        links = met.groupBy("id").agg(F.sum("links").alias("links"))
        found = _audit(points, parts, links, similarity, audit)
        if found >= recall:
            break
    else:
        raise RuntimeError(f"audited recall of links is {found:.4f}, wanted {recall}")
    names = points.select("id", F.col("vec_id").alias("own"))
    ties = met.where("low <> id").select(F.col("id").alias("a"), F.col("low").alias("b"))
    named_parts = components(ties).withColumnRenamed("component", "part")
    # the smallest vec_id of the part; point numbers do not follow vec_ids
    part_of = names.join(named_parts, "id", "left").select(
        "id", "own", F.coalesce("part", "id").alias("part"))
    lowest = stored(part_of.groupBy("part").agg(F.min("own").alias("component_id")), "part-names")
    judged = stored(
        points.select("id", "name", "copies").join(links, "id", "left")
        .join(part_of.select("id", "part"), "id").join(lowest, "part")
        .select(F.col("name").alias("held"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"),
                "component_id"), "judged-points")
    joined = named.select("vec_id", "name").join(
        judged, F.col("name") == F.col("held"), "left")
    return joined.select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id")), found
