"""Line dedup: equal lines and lines one word apart, by a join of deletion neighbourhoods.

Lines are compared by their normalised words.  Two lines are near when their edit distance in
words is at most the bound (one word in lines of ``NEAR_WORDS`` words and more, none in shorter
ones); lines under ``MIN_WORDS`` words are never touched.  A line is dropped when an equal or a
near line stands earlier in the corpus, by (doc_id, text hash, line number), whether or not
that earlier line stays itself.

Every variant of a line within the bound, that is the line itself and the line without each of
its words, becomes a hashed key.  Lines that share a variant with the word gone at the same
place are one replacement apart, a line that equals another's variant is one insertion apart;
so each group of equal keys only hands its earliest member to the rest and no pairs of a group
are formed.  The edit distance to that earliest member is then verified on the words.

Before variants are made, an exact screen leaves lines out that cannot have a near line: two
lines one edit apart share their first or last half, so a line alone with all its halves has
none.

Null texts stay null, empty ones empty.  Rows equal in id and text are judged as one document
and get the same result.  Null ids come first.  Extra columns are kept.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockmill.llm.common import free_shuffles, stored, unbounded, with_arrow_columns
from stockmill.llm.words import CLEAN, Runs, mix, word_hashes

MIN_WORDS = 3
NEAR_WORDS = 8


def _signed(values):
    return values.view(np.int64)


def _lines(text):
    """Word runs, and the first word of each line and of the one after."""
    hashes, starts = word_hashes(text)
    breaks = np.flatnonzero(np.frombuffer(text, np.uint8) == 10)
    bounds = np.searchsorted(starts, breaks)
    return Runs(hashes), np.concatenate([[0], bounds]), np.concatenate([bounds, [len(hashes)]])


def _half_keys(runs, first, last):
    """Four keys per line: its first and last half, once as the longer and once as the shorter
    or equal line of a pair."""
    keys = []
    for longer in (0, 1):
        half = (last - first + longer) // 2
        for side in (0, 1):
            a = first if side == 0 else last - half
            b = first + half if side == 0 else last
            tag = (last - first + longer).astype(np.uint64) * np.uint64(4) + np.uint64(side)
            keys.append(_signed(mix(runs.run(a, b)[0] ^ mix(tag))))
    return np.stack(keys, 1)


def _line_table(docs, text):
    """One row per line that takes part: place, line hash, half keys."""

    def prepare():
        def compute(texts):
            held = [t.encode() if t else b"" for t in texts.to_pylist()]
            runs, first, last = _lines(b"\n".join(held))  # all texts at once
            counts = np.array([h.count(b"\n") + 1 for h in held])
            begin = np.cumsum(counts) - counts
            line = np.arange(len(first)) - np.repeat(begin, counts)
            used = last - first >= MIN_WORDS
            upto = np.concatenate([[0], np.cumsum(used)])[np.append(begin, len(first))]
            first, last, line = first[used], last[used], line[used]
            near = last - first >= NEAR_WORDS
            keys = _half_keys(runs, first, last)[near].ravel()
            h1, h2 = runs.run(first, last)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate([[0], np.cumsum(near * 4)]), pa.int32()), pa.array(keys))
            rows = pa.StructArray.from_arrays(
                [pa.array(line, pa.int32()), pa.array(_signed(h1)), pa.array(_signed(h2)), lists],
                names=["line", "h1", "h2", "keys"])
            return [pa.ListArray.from_arrays(pa.array(upto, pa.int32()), rows)]

        return compute

    scanned = with_arrow_columns(
        docs, [F.col(f"`{text}`")],
        "lines array<struct<line:int,h1:bigint,h2:bigint,keys:array<bigint>>>", prepare,
        keep=["doc_id", "place"])
    return scanned.select("row.doc_id", "row.place", F.explode("out.lines").alias("l")).select(
        F.struct("doc_id", "place", "l.line").alias("at"), "l.h1", "l.h2", "l.keys")


def _screened(distinct):
    """Lines that share half a line with another one.

    Half the line's name stands for it here: a clash only lets a line through.
    """
    halves = distinct.select("h1", F.explode("keys").alias("key"))
    shared = halves.groupBy("key").count().where("count > 1").select("key")
    through = halves.join(unbounded(stored(shared, "line-halves")), "key").select("h1").distinct()
    return distinct.select("h1", "first").join(
        unbounded(stored(through, "line-names")), "h1").select("first")


def _variants(survivors, docs, text):
    """The words of each surviving line, and the keys of all its variants."""
    wanted = survivors.groupBy("first.doc_id", "first.place").agg(
        F.collect_list(F.col("first.line")).alias("numbers"))
    wanted = stored(wanted, "line-places").select(
        F.col("doc_id").alias("id"), F.col("place").alias("hash"), "numbers")
    held = docs.join(unbounded(wanted), F.col("doc_id").eqNullSafe(F.col("id")) & (
        F.col("place") == F.col("hash")))

    def prepare():
        def compute(texts, numbers):
            out = []
            for t, ns in zip(texts.to_pylist(), numbers.to_pylist()):
                data = t.encode()
                runs, first, last = _lines(data)
                cut = data.split(b"\n")
                rows = []
                for n in ns:
                    a, b = int(first[n]), int(last[n])
                    gone = np.stack([_signed(h) for h in runs.without(a, b)], 1).tolist()
                    whole = [_signed(h).tolist()[0] for h in
                             runs.run(np.array([a]), np.array([b]))]
                    rows.append({"line": n, "words": cut[n].translate(CLEAN).split(),
                                 "keys": [[-1, *whole]] + [[i, *g] for i, g in enumerate(gone)]})
                out.append(rows)
            return [out]

        return compute

    rows = with_arrow_columns(
        held, [F.col(f"`{text}`"), F.col("numbers")],
        "lines array<struct<line:int,words:array<binary>,keys:array<array<bigint>>>>", prepare,
        keep=["doc_id", "place"])
    return rows.select("row.doc_id", "row.place", F.explode("out.lines").alias("l")).select(
        F.struct("doc_id", "place", "l.line").alias("first"), "l.words", "l.keys")


def _earliest_near(variants):
    """For each line the earliest line that shares a variant, where that is earlier."""
    keys = variants.select("first", F.explode("keys").alias("k")).select(
        "first", F.col("k")[0].alias("gone"), F.col("k")[1].alias("v1"), F.col("k")[2].alias("v2"))
    shared = keys.groupBy("v1", "v2").count().where("count > 1").select("v1", "v2")
    keys = stored(keys.join(unbounded(stored(shared, "shared-variants")), ["v1", "v2"]), "line-variants")
    whole = F.col("gone") == -1
    same_place = keys.where(~whole).groupBy("v1", "v2", "gone").agg(
        F.min("first").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    inserted = keys.groupBy("v1", "v2").agg(
        F.min(F.when(whole, F.col("first"))).alias("low_whole"),
        F.min(F.when(~whole, F.col("first"))).alias("low_part")).where(
        "low_whole IS NOT NULL AND low_part IS NOT NULL")
    replaced = keys.join(unbounded(stored(same_place, "line-same-place")), ["v1", "v2", "gone"]).select(
        "first", "low")
    grown = keys.join(unbounded(stored(inserted, "line-inserted")), ["v1", "v2"]).select(
        "first", F.when(whole, F.col("low_part")).otherwise(F.col("low_whole")).alias("low"))
    return replaced.union(grown).where("low < first").groupBy("first").agg(
        F.min("low").alias("low"))


def within_one_edit(a, b):
    """Whether two word lists are at most one replacement, insertion or deletion apart."""
    if abs(len(a) - len(b)) > 1:
        return False
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    return max(len(a), len(b)) - start - end <= 1


def _verified(pairs, variants):
    words = variants.select("first", "words")
    both = pairs.join(words, "first").withColumnRenamed("words", "mine").join(
        words.select(F.col("first").alias("low"), F.col("words").alias("other")), "low")

    def prepare():
        return lambda mine, other: [[within_one_edit(a, b) for a, b in
                                     zip(mine.to_pylist(), other.to_pylist())]]

    checked = with_arrow_columns(both, [F.col("mine"), F.col("other")], "near boolean", prepare)
    return checked.where("out.near").select("row.first").distinct()


def repeated_lines(docs, text="text", doc_id="doc_id"):
    """(doc_id, place, dropped): line numbers, from 0, that repeat an earlier line; ``place`` is
    the text's hash."""
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"),
                       F.xxhash64(F.col(f"`{text}`")).alias("place"))
    lines = stored(_line_table(rows, "text"), "lines")
    distinct = stored(lines.groupBy("h1", "h2").agg(
        F.min("at").alias("first"), F.any_value("keys").alias("keys"),
        F.count("*").alias("n")), "distinct-lines")
    survivors = stored(_screened(distinct), "line-survivors")
    free_shuffles(spark)
    variants = stored(_variants(survivors, rows, "text"), "line-words")
    free_shuffles(spark)
    near = stored(_verified(stored(_earliest_near(variants), "line-pairs"), variants),
                  "near-lines")
    free_shuffles(spark)
    again = distinct.where("n > 1").select("h1", "h2", "first")
    repeated = lines.select("at", "h1", "h2").join(unbounded(again), ["h1", "h2"]).where(
        F.col("at") != F.col("first")).select("at")
    dropped = repeated.union(near.select(F.col("first").alias("at")))
    return dropped.groupBy("at.doc_id", "at.place").agg(
        F.sort_array(F.collect_set("at.line")).alias("dropped"))


def dedupe_lines(docs, text="text", doc_id="doc_id"):
    """Columns ``row`` (the document's own) and ``out``: n_lines, dropped (line numbers) and
    the text without them."""
    dropped = stored(repeated_lines(docs, text, doc_id), "dropped-lines").select(
        F.col("doc_id").alias("_id"), F.col("place").alias("_place"), "dropped")
    free_shuffles(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    body = F.col("row")[text]
    joined = rows.join(
        unbounded(dropped), (F.xxhash64(body) == F.col("_place"))
        & F.col("row")[doc_id].eqNullSafe(F.col("_id")), "left").select("row", "dropped")

    def prepare():
        def compute(texts, dropped):
            out = [], [], []
            for t, gone in zip(texts.to_pylist(), dropped.to_pylist()):
                cut = (t or "").split("\n")
                out[0].append(len(cut) if t else 0)
                out[1].append(gone or [])
                if gone:
                    away = set(gone)
                    t = "\n".join(x for i, x in enumerate(cut) if i not in away)
                out[2].append(t)
            return out

        return compute

    cut = with_arrow_columns(joined, [body, F.col("dropped")],
                             "n_lines bigint, dropped array<int>, text string", prepare)
    return cut.select("row.row", "out")
