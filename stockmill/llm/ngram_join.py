"""Similarity join on word n-grams: MinHash bands for candidates, full sets for the answer.

A document's set holds its runs of ``n`` words (a shorter document with words has one).
Documents with equal sets are one class, so copies never meet each other; a class carries its
number of documents.  Each class gets bands of MinHash values; band and row counts follow from
the recall wanted at the threshold.  Equal bands make candidates: every member of a bucket is
tied to the bucket's smallest class, and connected ties are a candidate cluster.  All sets of
a cluster meet in blocks of bounded size, and a link counts if the Jaccard similarity of the
full sets reaches the threshold.  Links leave a block as counts and spanning ties, not as
pairs, so a cluster of many near copies costs no row per pair.

Classes have numbers of their own, so rows that share an id, or have none, link like any others.
Null, empty and wordless texts have no set: a class of their own each, no links.  Repeated
rows are copies.  A class or component is named by its smallest document id, which is null where
no row of it has an id.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stockmill.llm.common import free_shuffles, stored, with_arrow_columns
from stockmill.llm.components import components
from stockmill.llm.words import mix, shingles, word_hashes

WORDS = 5
SIMILARITY = 0.8
RECALL = 0.9999
ROWS = 5
#: Classes of a block; two blocks meet in one task.
BLOCK = 96
CODES_AT_ONCE = 1 << 17
_SEED = 0x5851F42D4C957F2D


def bands_for(similarity=SIMILARITY, recall=RECALL, rows=ROWS):
    """Bands of ``rows`` values each, so that a pair at the threshold shares one with the recall
    wanted."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity ** rows))


def min_hashes(codes, count):
    """``count`` MinHash values of a set of 64-bit hashes."""
    keys = mix(np.arange(1, count + 1, dtype=np.uint64) * np.uint64(_SEED))
    factor = (keys >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    shift = keys.astype(np.uint32)
    low = (codes >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, np.uint32(0xFFFFFFFF))
    for start in range(0, len(low), 4096):  # bounded memory for long texts
        part = low[start:start + 4096]
        np.minimum(best, (factor[:, None] * part[None] + shift[:, None]).min(1), out=best)
    return best


def band_keys(codes, bands, rows):
    values = min_hashes(codes, bands * rows).astype(np.uint64).reshape(bands, rows)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        key = mix(key * np.uint64(_SEED) + values[:, r])
    return key.view(np.int64)


def set_name(codes):
    """Two 64-bit names of a set."""
    low = mix(codes + np.uint64(1)).sum(dtype=np.uint64) + np.uint64(len(codes))
    high = mix(codes ^ np.uint64(_SEED)).sum(dtype=np.uint64)
    return np.array([low, high]).view(np.int64).tolist()


def _signatures(docs, n, bands, rows):
    """doc_id and place with the name of the set and the band keys; no set, no name."""

    def prepare():
        def compute(texts):
            names, keys = [], []
            for t in texts.to_pylist():
                codes = shingles(word_hashes(t.encode())[0], n) if t else ()
                names.append(set_name(codes) if len(codes) else None)
                keys.append(band_keys(codes, bands, rows) if len(codes) else None)
            return names, keys

        return compute

    return with_arrow_columns(docs, [F.col("text")], "name array<bigint>, keys array<bigint>",
                              prepare, keep=["doc_id", "place"]).select(
        "row.doc_id", "row.place", F.col("out.name")[0].alias("h1"),
        F.col("out.name")[1].alias("h2"), "out.keys")


def _candidate_clusters(classes):
    """(cls, cluster) of classes that share a band with another one."""
    banded = stored(classes.select("cls", F.posexplode("keys").alias("band", "key")),
                    "bands")
    buckets = banded.groupBy("band", "key").agg(
        F.min("cls").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n")
    ties = banded.join(stored(buckets, "buckets"), ["band", "key"]).where("cls <> low").select(
        F.col("cls").alias("a"), F.col("low").alias("b"))
    return components(ties).select(F.col("id").alias("cls"), F.col("component").alias("cluster"))


def _meetings(members):
    """Each class once per meeting of two blocks of its cluster."""
    sizes = members.groupBy("cluster").agg(
        F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = members.join(stored(sizes, "cluster-sizes"), "cluster").withColumn(
        "block", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    return placed.select("cls", "cluster", "block", F.explode(others).alias("other")).select(
        "cls", "cluster", F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
        (F.col("block") <= F.col("other")).alias("left"))


def linked(sets, similarity):
    """Matrix of which sets reach the similarity, their own place included.

    Hashes that occur in the same sets are counted together, so the product stays small.
    """
    lengths = np.array([len(s) for s in sets])
    codes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), lengths)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    place = np.cumsum(new) - 1
    common = np.zeros((len(sets), len(sets)))
    starts = np.flatnonzero(new)
    for low in range(0, len(starts), CODES_AT_ONCE):
        first = starts[low]
        last = starts[low + CODES_AT_ONCE] if low + CODES_AT_ONCE < len(starts) else len(codes)
        inside = np.zeros((place[last - 1] - low + 1, len(sets)), np.uint8)
        inside[place[first:last] - low, owner[first:last]] = 1
        patterns, weight = np.unique(np.packbits(inside, axis=1), axis=0, return_counts=True)
        inside = np.unpackbits(patterns, axis=1)[:, :len(sets)].astype(np.float64)
        common += (inside.T * weight) @ inside
    union = lengths[:, None] + lengths[None] - common
    return common >= similarity * union - 1e-9


def smallest_reached(links, names):
    """Smallest name of each place's connected part of a symmetric link matrix."""
    while True:
        low = np.minimum(names, np.where(links, names[None], names[:, None]).min(1))
        if (low == names).all():
            return low
        names = low


def _meet(n, similarity):
    """For each meeting: per class its linked documents and the smallest class it is tied to."""
    schema = pa.schema([("cls", pa.int64()), ("links", pa.int64()), ("low", pa.int64())])

    def run(table):
        cls = table.column("cls").to_numpy()
        block = table.column("block").to_numpy()
        copies = table.column("copies").to_numpy()
        one, two = table.column("one")[0].as_py(), table.column("two")[0].as_py()
        sets = [np.frombuffer(x, np.uint64) for x in table.column("codes").to_pylist()]
        links = linked(sets, similarity)
        if one != two:  # pairs inside one block meet elsewhere
            links &= block[:, None] != block[None]
        np.fill_diagonal(links, False)
        return pa.table([pa.array(cls), pa.array(links @ copies),
                         pa.array(smallest_reached(links, cls))], schema=schema)

    return run


def _with_sets(meetings, classes, rows, n):
    """The sets of the classes that meet, made again from one text of each.

    Copies of a text combine before they move, however many rows hold it.
    """
    met = meetings.select("cls").distinct()
    wanted = stored(met.join(classes.select("cls", "place", "h1", "h2", "copies"), "cls"),
                    "met-classes")
    texts = rows.where("text IS NOT NULL").groupBy("place").agg(F.any_value("text").alias("text"))
    chosen = wanted.join(texts, "place")

    def prepare():
        def compute(texts):
            codes = [shingles(word_hashes(t.encode())[0], n) for t in texts.to_pylist()]
            return ([c.tobytes() for c in codes],)

        return compute

    return with_arrow_columns(chosen, [F.col("text")], "codes binary", prepare,
                              keep=["cls", "copies"]).select("row.*", "out.codes")


def similar(docs, n=WORDS, similarity=SIMILARITY, recall=RECALL, text="text", doc_id="doc_id"):
    """One row per document: doc_id, class_id (smallest id with the same set), n_links (other
    documents at the similarity or more), component_id (smallest id reachable by links)."""
    spark = docs.sparkSession
    bands = bands_for(similarity, recall)
    body = F.col(f"`{text}`")
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), body.alias("text"),
                       F.unhex(F.md5(body.cast("binary"))).alias("place"))
    signed = stored(_signatures(rows, n, bands, ROWS), "signatures")
    # numbers are given once, as the table is written
    classes = stored(signed.where("h1 IS NOT NULL").groupBy("h1", "h2").agg(
        F.min("doc_id").alias("low_id"), F.count("*").alias("copies"),
        F.any_value("keys").alias("keys"), F.min("place").alias("place")).withColumn(
        "cls", F.monotonically_increasing_id()), "classes")
    meetings = stored(_meetings(_candidate_clusters(classes)), "meetings")
    sets = stored(_with_sets(meetings, classes, rows, n), "met-sets")
    free_shuffles(spark)
    placed = meetings.join(sets, "cls").withColumn(
        "block", F.when(F.col("left"), F.col("one")).otherwise(F.col("two")))
    met = stored(placed.groupBy("cluster", "one", "two").applyInArrow(
        _meet(n, similarity), "cls bigint, links bigint, low bigint"), "met")
    free_shuffles(spark)
    tied = components(met.where("low <> cls").select(F.col("cls").alias("a"),
                                                     F.col("low").alias("b")))
    tied = classes.select(F.col("cls").alias("id"), "low_id").join(tied, "id")
    names = tied.select("id", "component").join(
        tied.groupBy("component").agg(F.min("low_id").alias("least_id")), "component").select(
        F.col("id").alias("cls"), "least_id")
    counted = met.groupBy("cls").agg(F.sum("links").alias("links"))
    judged = stored(
        classes.select("h1", "h2", "cls", "low_id", "copies")
        .join(counted, "cls", "left").join(names, "cls", "left")
        .select(F.col("h1").alias("k1"), F.col("h2").alias("k2"), "low_id",
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("least_id", "low_id").alias("component")), "judged")
    named = signed.select("doc_id", "h1", "h2").join(
        judged, (F.col("h1") == F.col("k1")) & (F.col("h2") == F.col("k2")), "left")
    return named.select(
        "doc_id", F.coalesce("low_id", "doc_id").alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component", "doc_id").alias("component_id"))
