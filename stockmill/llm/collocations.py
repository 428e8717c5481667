"""Phrase collocations, counted in tiles of frequency-ranked ids, level by level.

Texts are cut into blocks of one language.  A block numbers its distinct words and keeps the text
as these numbers, with -1 between pieces; its word counts are added up by Spark, frequent words
get ids in the order of their frequency, and every block receives the ids of its own words (never
the whole vocabulary).  Then pairs of neighbouring ids are counted: ids are split into tiles
of ``TILE`` by ``TILE``; a tile with many occurrences is a dense array, addressed directly and
counted by ``bincount``, the occurrences of all other tiles are sorted.  A block's pairs travel as
arrays, dealt by hash into buckets of about ``BUCKET_PAIRS``; a bucket adds them up, and frequent
pairs are ranked anew and become the symbols of the next level: a symbol at a place is the phrase that
starts there, so two neighbours of one level are a phrase that is a word longer.  A phrase can
only be frequent if both of these are, hence nothing is missed.

A phrase of ``least`` occurrences or more is a candidate.  It is cut in two after each word in
turn; ``score`` is floor(2000000 * a / (l + r)) of the lowest cut, the earliest on ties.  A
candidate inside a longer one that has ``absorbed`` percent of its occurrences is dropped.  As
counts only fall with length, the longest candidates it could lie in are met one word further.
Sums and products are exact decimals.

Null languages are ``und``, null texts are empty.  Repeated rows count each.  A language without
candidates has no rows.  Long texts are cut between pieces.  Other columns are not read.
"""

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Window, functions as F

from stockmill.llm.common import discard, free_shuffles, give_back, slices, stored, unbounded
from stockmill.llm.words import mix

LEAST = 30
LONGEST = 4
TOP = 2000
ABSORBED = 80
UNDETERMINED = "und"
#: Bytes of text a task holds before it writes blocks.
BLOCK_BYTES = 16 << 20
TILE_BITS = 8
#: Ids that may fall into dense tiles, and the share of cells that makes one.
DENSE_IDS = 1 << 13
DENSE_SHARE = 4
_PART = 1 << 17
BUCKET_PAIRS = 1 << 20
_ROWS_PER_CELL = 50_000
_SALTS = 64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PIECE_END = re.compile(rb"[.,;:!?\x0a-\x0d]")
_ENDS = np.zeros(256, bool)
_ENDS[[*b".,;:!?\x0a\x0b\x0c\x0d"]] = True
_GAP = _ENDS.copy()
_GAP[[9, 32]] = True
_BLOCKS = ("block bigint, lang string, place bigint, word string, n bigint, ids binary, "
           "bucket bigint, left binary, right binary, counts binary")
_RANKED = ("lang string, id bigint, left bigint, right bigint, f bigint, block bigint, n bigint, "
           "places binary, ids binary")


def numbered_words(data):
    """Distinct words of bytes, their counts, and the text as word numbers, -1 between pieces."""
    letters = np.frombuffer(data.translate(_LOWER), np.uint8)
    gap = _GAP[letters]
    inside = np.zeros(len(letters) + 2, np.int8)
    inside[1:-1] = ~gap
    edges = np.flatnonzero(np.diff(inside))
    starts, ends = edges[::2], edges[1::2]
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    words = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(offsets), pa.py_buffer(letters[~gap])).dictionary_encode()
    ids = words.indices.to_numpy()
    piece = np.cumsum(_ENDS[letters], dtype=np.int32)[starts]
    turns = np.flatnonzero(piece[1:] != piece[:-1]) + 1
    return words.dictionary, np.bincount(ids), np.insert(ids, turns, -1)


def count_pairs(left, right, bits=TILE_BITS, dense_ids=DENSE_IDS, share=DENSE_SHARE):
    """Distinct pairs of ids (left, right), their counts, and the number of each pair given."""
    number = np.empty(len(left), np.int64)
    lefts, rights, counts, found = [], [], [], 0
    across, cells = -(-dense_ids >> bits), 1 << 2 * bits
    near = np.flatnonzero((left < dense_ids) & (right < dense_ids))
    tile = (left[near] >> bits) * across + (right[near] >> bits)
    dense = np.flatnonzero(np.bincount(tile, minlength=across * across) * share >= cells)
    sparse = np.ones(len(left), bool)
    if len(dense):
        slot = np.full(across * across, -1)
        slot[dense] = np.arange(len(dense))
        held = slot[tile] >= 0
        near = near[held]
        low = (1 << bits) - 1
        cell = slot[tile[held]] * cells + ((left[near] & low) << bits) + (right[near] & low)
        n = np.bincount(cell, minlength=len(dense) * cells)
        used = np.flatnonzero(n)
        place = np.full(len(n), -1, np.int32)
        place[used] = np.arange(len(used))
        number[near] = place[cell]
        at = dense[used >> 2 * bits]
        lefts.append((at // across << bits) + (used >> bits & low))
        rights.append((at % across << bits) + (used & low))
        counts.append(n[used])
        found = len(used)
        sparse[near] = False
    rest = np.flatnonzero(sparse)
    pairs, which, n = np.unique(left[rest] << 32 | right[rest], return_inverse=True,
                                return_counts=True)
    number[rest] = which + found
    lefts.append(pairs >> 32)
    rights.append(pairs & 0xFFFFFFFF)
    counts.append(n)
    return *(np.concatenate(x) for x in (lefts, rights, counts)), number


def _text_rows(block, lang, ids):
    """A block's text in parts."""
    for part, start in enumerate(range(0, len(ids), _PART)):
        yield _row_batch(1, {
            "block": pa.array([block]), "lang": pa.array([lang]), "place": pa.array([part]),
            "ids": pa.array([ids[start:start + _PART].astype("<i4").tobytes()], pa.binary())})


def _word_rows(block, lang, words, counts):
    for start in range(0, len(words), _PART):
        size = min(_PART, len(words) - start)
        yield _row_batch(size, {
            "block": pa.array(np.full(size, block)), "lang": pa.repeat(pa.scalar(lang), size),
            "place": pa.array(np.arange(start, start + size)),
            "word": words.slice(start, size),
            "n": pa.array(np.asarray(counts[start:start + size], np.int64))})


def _packed(values):
    """Bytes of numbers, 4 or 8 each as the largest needs; the length tells which."""
    small = len(values) == 0 or int(values.max()) < 1 << 32
    return np.asarray(values).astype("<u4" if small else "<u8").tobytes()


def _unpacked(data, count):
    kind = "<u8" if count and len(data) == 8 * count else "<u4"
    return np.frombuffer(data, kind).astype(np.int64)


def _pair_rows(block, lang, buckets, left, right, counts):
    """Pairs, sorted by bucket, as a row per bucket; ``place`` is the first one's number."""
    cuts = np.flatnonzero(np.diff(buckets, prepend=-1))
    ends = np.append(cuts[1:], len(buckets))
    out = {k: [] for k in ("left", "right", "counts")}
    for a, b in zip(cuts, ends):
        for k, v in (("left", left), ("right", right), ("counts", counts)):
            out[k].append(_packed(v[a:b]))
    size = len(cuts)
    yield _row_batch(size, {
        "block": pa.array(np.full(size, block)), "lang": pa.repeat(pa.scalar(lang), size),
        "place": pa.array(cuts), "n": pa.array(ends - cuts), "bucket": pa.array(buckets[cuts]),
        **{k: pa.array(v, pa.binary()) for k, v in out.items()}})


_SCHEMA = pa.schema([
    ("block", pa.int64()), ("lang", pa.string()), ("place", pa.int64()), ("word", pa.string()),
    ("n", pa.int64()), ("ids", pa.binary()), ("bucket", pa.int64()), ("left", pa.binary()),
    ("right", pa.binary()), ("counts", pa.binary())])
_SYMBOLS = pa.schema([
    ("lang", pa.string()), ("id", pa.int64()), ("left", pa.int64()), ("right", pa.int64()),
    ("f", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("places", pa.binary()),
    ("ids", pa.binary())])


def _row_batch(size, columns, schema=_SCHEMA):
    return pa.RecordBatch.from_arrays(
        [columns[f.name].cast(f.type) if f.name in columns else pa.nulls(size, f.type)
         for f in schema], schema=schema)


def _blocks(docs, lang, text, block_bytes):
    """The first level: words."""
    def run(batches):
        held, size = {}, 0
        block = TaskContext.get().partitionId() << 32

        def written():
            nonlocal block
            for name, parts in held.items():
                words, counts, ids = numbered_words(b"\n".join(parts))
                yield from _word_rows(block, name, words, counts)
                yield from _text_rows(block, name, ids)
                block += 1
            held.clear()

        for batch in slices(batches):
            for name, body in zip(batch.column("lang").to_pylist(),
                                  batch.column("text").to_pylist()):
                data = body.encode()
                while data:
                    cut = _PIECE_END.search(data, block_bytes)
                    part, data = (data[:cut.end()], data[cut.end():]) if cut else (data, b"")
                    held.setdefault(name, []).append(part)
                    size += len(part)
                    if size >= block_bytes:
                        yield from written()
                        size = 0
        yield from written()
        give_back()

    return docs.select(
        F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit(UNDETERMINED)).alias("lang"),
        F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).mapInArrow(run, _BLOCKS)


def _ranked(symbols, names):
    """An id per symbol and language: more frequent ones first, by powers of two of their count;
    ranks are counted in cells, so no task ranks a whole language."""
    cells = max(1, symbols.count() // _ROWS_PER_CELL)
    placed = symbols.select(
        "*", F.length(F.bin("f")).alias("octave"),
        F.pmod(F.xxhash64(*names), F.lit(cells)).alias("cell"))
    upto = Window.partitionBy("lang").orderBy(F.desc("octave"), "cell").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = placed.groupBy("lang", "octave", "cell").agg(F.count("*").alias("size")).select(
        "lang", "octave", "cell", F.coalesce(F.sum("size").over(upto), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("lang", "octave", "cell").orderBy(F.desc("f"), *names)
    return placed.withColumn("place", F.row_number().over(inside) - 1).join(
        offsets, ["lang", "octave", "cell"]).select(
        "lang", *names, "f", (F.col("offset") + F.col("place")).alias("id"))


def _frequent_words(level, least):
    """Ids of frequent words (lang, word, f, id), and of every block's own (block, places, ids)."""
    rows = level.where("word IS NOT NULL").select("block", "lang", "place", "word", "n")
    dealt = rows.repartition("lang", "word")  # one exchange serves the sums and the join
    sums = dealt.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    kept = stored(dealt.drop("n").join(unbounded(sums), ["lang", "word"]), "frequent-in-blocks")
    words = kept.groupBy("lang", "word").agg(F.first("f").alias("f"))
    words = stored(_ranked(stored(words, "frequent"), ["word"]), "ranked")
    own = kept.drop("f").join(unbounded(words.drop("f")), ["lang", "word"]).select(
        "block", "place", "id")
    return words, own, kept


def _pairs_of(buckets):
    """The text of a block with its pairs of neighbouring symbols as the new symbols."""
    def run(text, places, ids):
        text = text.sort_by("place")
        held = np.concatenate([np.frombuffer(x.as_py(), "<i4") for x in text.column("ids")])
        order = np.argsort(ids)
        rank = np.full(max(int(held.max()), int(places.max())) + 2, -1, np.int64)
        rank[places[order]] = np.arange(len(order))
        held = rank[held]  # the place behind the last symbol stands for -1
        at = np.flatnonzero((held[:-1] >= 0) & (held[1:] >= 0))
        if not len(at):
            return
        left, right, counts, which = count_pairs(held[at], held[at + 1])
        ids = ids[order]
        left, right = ids[left], ids[right]
        bucket = (mix(left.view(np.uint64) ^ mix(right.view(np.uint64)))
                  % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        new = np.full(len(held) - 1, -1, np.int32)
        new[at] = number[which]
        block, lang = text.column("block")[0].as_py(), text.column("lang")[0].as_py()
        yield from _pair_rows(block, lang, bucket[order], left[order], right[order],
                              counts[order])
        yield from _text_rows(block, lang, new)

    return run


def _next_level(level, own, buckets, packed):
    """Blocks of phrases that are a word longer."""
    one = _pairs_of(buckets)

    def pairs_of(text, symbols):
        batches = []
        if text.num_rows and symbols.num_rows:
            if packed:
                n = symbols.column("n").to_pylist()
                places, ids = (np.concatenate([
                    _unpacked(x.as_py(), k) for x, k in zip(symbols.column(c), n)])
                    for c in ("places", "ids"))
            else:
                places, ids = (symbols.column(c).to_numpy() for c in ("place", "id"))
            batches = list(one(text, places, ids))
        return pa.Table.from_batches(batches, schema=_SCHEMA)

    text = level.where("ids IS NOT NULL").select("block", "lang", "place", "ids")
    return text.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(pairs_of, _BLOCKS)


def _frequent_pairs(level, least, buckets):
    """Ids of frequent pairs (lang, id, left, right, f), and of every block's own.

    A bucket adds up its pairs over all blocks and ranks the frequent ones of each language;
    buckets take turns, which is close to the rank among all, as they hold alike shares.
    """
    def ranked(rows):
        bucket = rows.column("bucket")[0].as_py()
        batches = []
        langs = rows.column("lang")
        for lang in langs.unique().to_pylist():
            part = rows.filter(pc.equal(langs, lang))
            sizes = part.column("n").to_numpy()
            left, right, n = (np.concatenate([
                _unpacked(x.as_py(), k) for x, k in zip(part.column(c), sizes.tolist())])
                for c in ("left", "right", "counts"))
            order = np.lexsort((right, left))
            first = np.flatnonzero(np.append(True, (np.diff(left[order]) != 0)
                                             | (np.diff(right[order]) != 0)))
            total = np.add.reduceat(n[order], first)
            often = np.flatnonzero(total >= least)
            often = often[np.argsort(-total[often], kind="stable")]
            if not len(often):
                continue
            ids = np.arange(len(often)) * buckets + bucket
            id_of = np.full(len(first), -1)
            id_of[often] = ids
            spot = order[first[often]]
            batches.append(_row_batch(len(often), {
                "lang": pa.repeat(pa.scalar(lang), len(often)), "id": pa.array(ids),
                "left": pa.array(left[spot]), "right": pa.array(right[spot]),
                "f": pa.array(total[often])}, _SYMBOLS))
            of_row = np.empty(len(order), np.int64)
            of_row[order] = np.repeat(id_of, np.diff(np.append(first, len(order))))
            ends = np.cumsum(sizes)
            out = {k: [] for k in ("block", "n", "places", "ids")}
            for block, place, end, size in zip(part.column("block").to_pylist(),
                                               part.column("place").to_pylist(), ends, sizes):
                mine = of_row[end - size:end]
                at = np.flatnonzero(mine >= 0)
                if len(at):
                    values = (block, len(at), _packed(at + place), _packed(mine[at]))
                    for column, value in zip(out.values(), values):
                        column.append(value)
            batches.append(_row_batch(len(out["n"]), {
                k: pa.array(v, _SYMBOLS.field(k).type) for k, v in out.items()}, _SYMBOLS))
        return pa.Table.from_batches(batches, schema=_SYMBOLS)

    rows = level.where("bucket IS NOT NULL").select(
        "bucket", "lang", "block", "place", "n", "left", "right", "counts")
    found = stored(rows.groupBy("bucket").applyInArrow(ranked, _RANKED), "ranked-pairs")
    own = found.where("block IS NOT NULL").select("block", "n", "places", "ids")
    return found.where("id IS NOT NULL").select("lang", "id", "left", "right", "f"), own, found


def phrases(docs, lang="lang", text="text", least=LEAST, longest=LONGEST, block_bytes=BLOCK_BYTES):
    """Totals (lang, n) and, per length from 2, the phrases that occur ``least`` times.

    A phrase has lang, id, left, right (ids of its ends, a word shorter), f, text, last (its last
    word), heads and tails: frequencies of both sides of each cut.
    """
    spark = docs.sparkSession
    level = stored(_blocks(docs, lang, text, block_bytes), "word-blocks")
    totals = stored(level.where("word IS NOT NULL").groupBy("lang").agg(F.sum("n").alias("n")),
                    "totals")
    symbols, own, held = _frequent_words(level, least)
    none = F.array().cast("array<bigint>")
    known = symbols.select("lang", "id", "f", F.col("word").alias("text"),
                           F.col("word").alias("last"), none.alias("heads"), none.alias("tails"))
    found = []
    for length in range(2, longest + 1):
        seen = symbols.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
        buckets = max(1, seen // BUCKET_PAIRS)
        past = [level, held]
        level = stored(_next_level(level, own, buckets, length > 2), "phrase-blocks")
        discard(*past)
        free_shuffles(spark)
        symbols, own, held = _frequent_pairs(level, least, buckets)
        free_shuffles(spark)
        ends = {side: unbounded(known.select("lang", *[
            F.col(c).alias(f"{side}_{c}") for c in ("id", "f", "text", "last", "heads", "tails")
        ]).withColumnRenamed(f"{side}_id", side)) for side in ("left", "right")}
        known = stored(symbols.join(ends["left"], ["lang", "left"]).join(
            ends["right"], ["lang", "right"]).select(
            "lang", "id", "left", "right", "f",
            F.concat_ws(" ", "left_text", "right_last").alias("text"),
            F.col("right_last").alias("last"),
            F.concat("left_heads", F.array("left_f")).alias("heads"),
            F.concat(F.array("right_f"), "right_tails").alias("tails")), "phrases")
        found.append(known)
    discard(level)
    free_shuffles(spark)
    return totals, found


def _scored(known):
    """Score of the lowest cut, with its two sides."""
    cuts = F.transform(F.sequence(F.lit(0), F.size("heads") - 1), lambda i: F.struct(
        i.alias("cut"), F.get("heads", i).alias("l"), F.get("tails", i).alias("r")))
    lowest = F.expr(
        "array_min(transform(cuts, c -> struct(cast(2000000 AS decimal(17, 0)) * "
        "cast(f AS decimal(20, 0)) div (cast(c.l AS decimal(20, 0)) + c.r) AS score, "
        "c.cut AS cut, c.l AS l, c.r AS r)))")
    return known.withColumn("cuts", cuts).withColumn("low", lowest).drop("cuts")


def collocations(docs, lang="lang", text="text", least=LEAST, longest=LONGEST, top=TOP,
                 absorbed=ABSORBED, block_bytes=BLOCK_BYTES):
    """Each language's best phrases: lang, rank, phrase, a, l, r, n, score."""
    totals, found = phrases(docs, lang, text, least, longest, block_bytes)
    kept = None
    for k, known in enumerate(found):
        scored = _scored(known)
        if k + 1 < len(found):
            inside = [found[k + 1].groupBy("lang", F.col(side).alias("id")).agg(
                F.max("f").alias("longer")) for side in ("left", "right")]
            longer = inside[0].union(inside[1]).groupBy("lang", "id").agg(
                F.max("longer").alias("longer"))
            gone = F.expr(f"cast(longer AS decimal(20, 0)) * 100 >= "
                          f"cast(f AS decimal(20, 0)) * {int(absorbed)}")
            scored = scored.join(unbounded(longer), ["lang", "id"], "left").where(
                ~F.coalesce(gone, F.lit(False)))
        chosen = scored.select("lang", F.col("text").alias("phrase"), F.col("f").alias("a"),
                               "low.l", "low.r", "low.score")
        kept = chosen if kept is None else kept.union(chosen)
    best = [F.desc("score"), F.desc("a"), "phrase"]
    # the best of each salt first, so that no task sorts a language's candidates
    salted = kept.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    some = salted.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(
        Window.partitionBy("lang").orderBy(*best))).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select(
        "lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
