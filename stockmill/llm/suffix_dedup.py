"""Removal of every byte inside a ``WINDOW``-byte string that starts elsewhere too.

Every window holds an anchor: the place of the least hash among its ``CORE``-byte strings, the
same place in every copy of the window.  Only windows around anchors whose core string occurs
again can repeat, so each such anchor gives one short document, its context: all bytes that
windows with that core can reach.  Equal contexts are counted together; a context that occurs
twice repeats whole.  Different contexts of one core form a collection whose sorted suffixes
are built column by column, from the last column to the first: each round inserts one symbol
in front of every document's suffix, so the new order is the old one sorted stably by that
symbol (the step of the collection's Burrows-Wheeler transform) and each common prefix with
the neighbour is one more than the least one between them before.  The columns lie in an
external file and are read in sequence; memory holds the order and the prefixes.  Windows
whose common prefix reaches ``WINDOW`` repeat.  The windows of one anchor overlap, so the
repeats around it cover one interval; intervals are joined per text.

A collection with more contexts than the mean task has (``LEAST`` at least, ``COLLECTION`` at
most) is not built whole: its window range is cut into ``PIECES``, which makes the shared core
longer and the contexts shorter, and equal ones collapse again, until the parts are small or a
single window is left.

Null and short texts lose nothing.  Copies of a text, repeated rows included, are occurrences
like any other, so long copies lose all bytes.  Ids are only carried along.
"""

import tempfile

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import functions as F

from stockmill.llm.common import discard, free_shuffles, stored, with_arrow_columns
from stockmill.llm.words import mix, prefix_sums, run_hash

WINDOW = 400
CORE = 64
COLLECTION = 50_000
LEAST = 256
PIECES = 4
_BASE = 0x9E3779B97F4A7C15
_SEGMENT = 1 << 18
_PLACE_BITS = np.uint64(20)


def anchors(data, window=WINDOW, core=CORE):
    """Places of the anchors of all windows of ``data``, and the hashes of their cores."""
    width = window - core + 1
    places, cores = [], []
    for start in range(0, len(data) - window + 1, _SEGMENT):
        part = np.frombuffer(data, np.uint8)[start:start + _SEGMENT + window - 1]
        sums = prefix_sums(part.astype(np.uint64) + np.uint64(1), _BASE)
        at = np.arange(len(part) - core + 1)
        hashes = mix(run_hash(sums, at, at + core, _BASE))
        keyed = (hashes >> _PLACE_BITS << _PLACE_BITS) | at.astype(np.uint64)
        low = _sliding_min(keyed, width) & np.uint64((1 << 20) - 1)
        chosen = low[np.concatenate([[True], low[1:] != low[:-1]])].astype(np.int64)
        places.append(chosen + start)
        cores.append(hashes[chosen])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    places, first = np.unique(np.concatenate(places), return_index=True)
    return places, np.concatenate(cores)[first]


def _sliding_min(values, width):
    """Least of each run of ``width`` values, by minima from both ends of fixed blocks."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def contexts(data, places, low, high, window=WINDOW):
    """The bytes that windows starting ``high`` to ``low`` before each place can reach."""
    return [data[max(0, p - high):p - low + window] for p in places.tolist()]


def _anchor_table(rows, window, core):
    """A row per anchor: text, place, core, name of the context, least and greatest distance
    of a window's start before the anchor."""
    reach = window - core

    def prepare():
        def compute(texts):
            lists = {k: [] for k in ("pos", "core", "context", "low", "high")}
            sizes = [0]
            for t in texts.to_pylist():
                data = (t or "").encode()
                places, cores = anchors(data, window, core)
                sizes.append(sizes[-1] + len(places))
                high = np.minimum(places, reach)
                lists["pos"].append(places)
                lists["core"].append(cores.view(np.int64))
                lists["high"].append(high)
                lists["low"].append(np.maximum(0, window - (len(data) - places)))
                lists["context"] += [
                    xxhash.xxh3_128_digest(c, seed=h) for c, h in
                    zip(contexts(data, places, 0, reach, window), high.tolist())]
            flat = {k: np.concatenate(v) if k != "context" and v else v for k, v in lists.items()}
            kinds = {"pos": pa.int64(), "core": pa.int64(), "context": pa.binary(),
                     "low": pa.int16(), "high": pa.int16()}
            packed = pa.StructArray.from_arrays(
                [pa.array(flat[k], type=kinds[k]) for k in kinds], names=list(kinds))
            return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), packed)]

        return compute

    found = with_arrow_columns(
        rows, [F.col("text")],
        "anchors array<struct<pos:bigint,core:bigint,context:binary,low:smallint,high:smallint>>",
        prepare, keep=["place"])
    return found.select("row.place", F.explode("out.anchors").alias("a")).select("place", "a.*")


def repeated_windows(columns, low, high, reach, window):
    """Least and greatest distance at which each context's window equals another context's.

    ``columns(c)`` gives column c of the collection; column ``reach`` holds the anchors.
    Contexts without such a window have -1.
    """
    n = len(low)
    order, prefix = np.arange(n), np.zeros(n + 1, np.int16)
    least, most = np.full(n, -1), np.full(n, -1)
    for c in range(reach + window - 1, -1, -1):
        symbol = columns(c)[order]
        step = np.argsort(symbol, kind="stable")
        symbol = symbol[step]
        same = np.flatnonzero(symbol[1:] == symbol[:-1]) + 1
        new = np.zeros(n + 1, np.int16)
        if len(same):
            spans = np.stack([step[same - 1] + 1, step[same] + 1], 1).ravel()
            new[same] = np.minimum(np.minimum.reduceat(prefix, spans)[::2] + 1, window)
        order, prefix = order[step], new
        distance = reach - c
        if distance < 0:
            continue
        equal = prefix[1:n] >= window
        if not equal.any():
            continue
        run = np.concatenate([[0], np.cumsum(~equal)])
        valid = (low[order] <= distance) & (distance <= high[order])
        hit = order[valid & (np.bincount(run[valid], minlength=run[-1] + 1)[run] > 1)]
        least[hit] = np.where(least[hit] < 0, distance, least[hit])
        most[hit] = distance
    return least, most


def _collections(reach, window):
    """All collections of a partition, through one external file of columns."""
    width = reach + window

    def run(batches):
        with tempfile.TemporaryFile() as rows, tempfile.TemporaryFile() as by_column:
            names, low, high = [], [], []
            for batch in batches:
                bodies = batch.column("bytes").to_pylist()
                for body, h in zip(bodies, batch.column("high").to_pylist()):
                    rows.write((b"\0" * (reach - h) + body).ljust(width, b"\0"))
                for held, name in ((names, "context"), (low, "low"), (high, "high")):
                    held.append(batch.column(name))
            n = sum(map(len, names))
            if not n:
                return
            rows.flush()
            by_row = np.memmap(rows, np.uint8, "r", shape=(n, width))
            by_column.truncate(n * width)
            turned = np.memmap(by_column, np.uint8, "r+", shape=(width, n))
            for first in range(0, n, 1 << 14):
                turned[:, first:first + (1 << 14)] = by_row[first:first + (1 << 14)].T
            least, most = repeated_windows(
                lambda c: turned[c], *(np.concatenate([x.to_numpy() for x in v])
                                       for v in (low, high)), reach, window)
            found = most >= 0
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays(names).filter(pa.array(found)),
                 pa.array(least[found], pa.int16()), pa.array(most[found], pa.int16())],
                names=["context", "least", "most"])

    return run


def _bytes_of(wanted, rows, reach, window):
    """The bytes of the wanted contexts, each from one text that holds it."""
    asked = stored(wanted.groupBy(F.col("at.place").alias("held")).agg(
        F.collect_list(F.struct("context", "core", "at.pos", "low", "high")).alias("asked")),
        "asked-contexts")
    held = rows.join(asked, F.col("place") == F.col("held")).select("text", "asked", "held")

    def prepare():
        def compute(texts, asked):
            out = []
            for t, wants in zip(texts.to_pylist(), asked.to_pylist()):
                data = t.encode()
                for w in wants:
                    w["bytes"] = data[max(0, w["pos"] - reach):w["pos"] + window]
                    del w["pos"]
                out.append(wants)
            return [out]

        return compute

    made = with_arrow_columns(
        held, [F.col("text"), F.col("asked")],
        "contexts array<struct<context:binary,core:bigint,low:smallint,high:smallint,"
        "bytes:binary>>", prepare, keep=["held"])
    return made.select(F.explode("out.contexts").alias("c")).select("c.*").dropDuplicates(
        ["context"])


def _split(parts, window):
    """Each part of a crowded collection as up to ``PIECES``, with shorter window ranges."""

    def prepare():
        def compute(bodies, lows, highs, froms, tos):
            out = []
            for body, low, high, a, b in zip(*(x.to_pylist() for x in (
                    bodies, lows, highs, froms, tos))):
                pieces = []
                cuts = [a + (b + 1 - a) * i // PIECES for i in range(PIECES + 1)]
                for first, last in ((x, y - 1) for x, y in zip(cuts, cuts[1:])):
                    lo, hi = max(low, first), min(high, last)
                    if first > last or lo > hi:
                        continue
                    # body starts `high` bytes before the anchor
                    part = body[high - hi:high - lo + window]
                    core = body[high - first:high - last + window]
                    pieces.append({
                        "core": xxhash.xxh3_64_intdigest(core, seed=first) - (1 << 63),
                        "part": xxhash.xxh3_128_digest(part, seed=hi * 1024 + lo),
                        "low": lo, "high": hi, "first": first, "last": last, "bytes": part})
                out.append(pieces)
            return [out]

        return compute

    made = with_arrow_columns(
        parts, [F.col(c) for c in ("bytes", "low", "high", "first", "last")],
        "pieces array<struct<core:bigint,part:binary,low:smallint,high:smallint,first:smallint,"
        "last:smallint,bytes:binary>>", prepare, keep=["context"])
    return made.select("row.context", F.explode("out.pieces").alias("p")).select("context", "p.*")


def _crowded(parts, reach, window, limit):
    """(context, least, most) for collections above ``limit`` contexts, by shorter ranges.

    Contexts with an equal piece are known to repeat there; one piece without a context goes on
    in their place, for others to be compared with.
    """
    found, columns = None, ["low", "high", "first", "last", "bytes"]
    while True:
        pieces = stored(_split(parts, window), "pieces")
        kinds = stored(pieces.groupBy("core", "part").agg(
            F.count("*").alias("n"), F.min("context").alias("context"),
            *[F.first(c).alias(c) for c in columns]), "piece-kinds")
        twice = stored(pieces.where("context IS NOT NULL").join(
            kinds.where("n > 1").select("core", "part"), ["core", "part"]).select(
            "context", F.col("low").alias("least"), F.col("high").alias("most")), "equal-pieces")
        several = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where(
            "kinds > 1"), "piece-cores")
        rest = stored(kinds.where("first < last").join(several, "core").select(
            "core", "kinds", F.when(F.col("n") == 1, F.col("context")).alias("context"),
            *columns), "piece-rest")
        built = stored(rest.where(F.col("kinds") <= limit).select(
            "core", "context", "low", "high", "bytes").repartition("core").mapInArrow(
            _collections(reach, window), "context binary, least smallint, most smallint").where(
            "context IS NOT NULL"), "built-pieces")
        discard(pieces, kinds)
        found = (twice if found is None else found.union(twice)).union(built)
        parts = rest.where(F.col("kinds") > limit).select("context", *columns)
        if parts.limit(1).count() == 0:
            return found


def _whole(spark, several, limit):
    """Contexts that a collection may have to be built whole: the mean task's, ``limit`` at most."""
    contexts = several.agg(F.sum("kinds")).first()[0] or 0
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return min(limit, max(LEAST, contexts // tasks))


def repeated_spans(rows, window=WINDOW, core=CORE, limit=COLLECTION):
    """(place, spans): byte intervals of each text (by hash) that repeat; unsorted."""
    spark, reach = rows.sparkSession, window - core
    found = stored(_anchor_table(rows, window, core), "anchors")
    again = stored(found.groupBy("core").count().where("count > 1").select("core"), "cores")
    found = stored(found.join(again, "core"), "anchors-again")
    free_shuffles(spark)
    kinds = stored(found.groupBy("context").agg(
        F.count("*").alias("n"), F.min("core").alias("core"), F.min("low").alias("low"),
        F.min("high").alias("high"), F.min(F.struct("place", "pos")).alias("at")), "contexts")
    several = stored(kinds.groupBy("core").agg(F.count("*").alias("kinds")).where("kinds > 1"),
                     "mixed-cores")
    wanted = stored(kinds.join(several, "core"), "mixed-contexts")
    bodies = stored(_bytes_of(wanted, rows, reach, window), "context-bytes")
    free_shuffles(spark)
    limit = _whole(spark, several, limit)
    crowds = stored(several.where(F.col("kinds") > limit).select("core"), "crowded-cores")
    built = bodies.join(crowds, "core", "left_anti").repartition("core").mapInArrow(
        _collections(reach, window), "context binary, least smallint, most smallint")
    if crowds.limit(1).count():
        parts = bodies.join(crowds, "core").select(
            "context", "bytes", "low", "high", F.lit(0).cast("smallint").alias("first"),
            F.lit(reach).cast("smallint").alias("last"))
        built = built.union(_crowded(parts, reach, window, limit))
    built = stored(built, "repeats").groupBy("context").agg(
        F.min("least").alias("least"), F.max("most").alias("most"))
    free_shuffles(spark)
    twice = F.col("n") > 1
    judged = stored(kinds.join(stored(built, "repeats-by-context"), "context", "left").select(
        "context", F.when(twice, F.col("low")).otherwise(F.col("least")).alias("least"),
        F.when(twice, F.col("high")).otherwise(F.col("most")).alias("most")).where(
        "least IS NOT NULL"), "judged-contexts")
    return found.select("context", "place", "pos").join(judged, "context").groupBy("place").agg(
        F.collect_set(F.struct((F.col("pos") - F.col("most")).alias("start"),
                               (F.col("pos") - F.col("least") + window).alias("end"))
                      ).alias("spans"))


def _merged(spans):
    merged = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def dedupe(docs, text="text", window=WINDOW, core=CORE, limit=COLLECTION):
    """Columns ``row`` (the document's own) and ``out``: n_bytes, spans (sorted byte intervals
    that repeat), kept (the bytes that are left, which may not be whole characters)."""
    body = F.col(f"`{text}`")
    place = F.unhex(F.md5(body.cast("binary")))
    rows = docs.select(body.alias("text"), place.alias("place"))
    spans = stored(repeated_spans(rows, window, core, limit), "spans").withColumnRenamed(
        "place", "held")
    free_shuffles(docs.sparkSession)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
                         place.alias("place")).join(
        spans, F.col("place") == F.col("held"), "left").select("row", "spans")

    def prepare():
        def compute(texts, spans):
            out = [], [], []
            for t, found in zip(texts.to_pylist(), spans.to_pylist()):
                data = (t or "").encode()
                merged = _merged((s["start"], s["end"]) for s in found or ())
                kept, end = [], 0
                for first, last in merged:
                    kept.append(data[end:first])
                    end = last
                out[0].append(len(data))
                out[1].append(merged)
                out[2].append(b"".join([*kept, data[end:]]))
            return out

        return compute

    return with_arrow_columns(
        joined, [F.col("row")[text], F.col("spans")],
        "n_bytes bigint, spans array<array<bigint>>, kept binary", prepare).select("row.row", "out")
