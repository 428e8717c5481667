"""Sharding and pieces."""

import collections
import math
import os
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stockmill.llm import pieces, sharding

MODEL = pieces.MODEL


def one_by_one(sizes, capacity):
    """Best fit decreasing, an item at a time."""
    rooms, placed = [], collections.Counter()
    for size in sorted(sizes, reverse=True):
        fits = [(room, i) for i, room in enumerate(rooms) if room >= size]
        if fits:
            room, i = min(fits)
        else:
            i, room = len(rooms), max(capacity, size)
            rooms.append(room)
        rooms[i] = room - size
        placed[size, i] += 1
    return placed, len(rooms)


@pytest.mark.parametrize("seed", range(20))
def test_runs_equal_items_one_by_one(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([1, 2, 3, 5, 8, 13, 40, rng.randrange(1, 60)]) for _ in range(200)]
    runs = sharding.best_fit_decreasing(collections.Counter(sizes), 50)
    got = collections.Counter()
    for r in runs:
        got[r.size, r.shard] += r.last - r.first + 1
    want, shards = one_by_one(sizes, 50)
    assert got == want and max(r.shard for r in runs) + 1 == shards


def test_packing(make_docs, odd_rows, clashing):
    rng = random.Random(6)
    rows = [(i, "x" * rng.randrange(300) + str(i % 150)) for i in range(100, 500)] + odd_rows
    got = sharding.pack(make_docs(rows, clashing), shards=3).collect()
    assert len(got) == len(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r.shard].append(r)
    assert set(by_shard) <= {0, 1, 2}
    for held in by_shard.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    where = collections.defaultdict(set)
    for r in got:
        where[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    want = collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
                               for _, t in rows)
    assert collections.Counter((r.size, r.text_crc32) for r in got) == want
    assert sharding.pack(make_docs([]), shards=3).count() == 0


def test_capacity_holds(make_docs):
    rng = random.Random(9)
    rows = [(i, str(i) + "y" * rng.randrange(900)) for i in range(300)] + [(999, "z" * 20_000)]
    got = sharding.pack(make_docs(rows), capacity=10_000).groupBy("shard").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("n")).collect()
    assert all(r.bytes <= 10_000 or r.n == 1 for r in got)
    assert len(got) <= 2 + math.ceil(sum(len(t) + 1 for i, t in rows if i != 999) / 9_900)


def test_near_equal_shards(make_docs):
    rng = random.Random(4)
    rows = [(i, str(i) + "y" * rng.randrange(500)) for i in range(2000)]
    got = [r.bytes for r in sharding.pack(make_docs(rows), shards=8).groupBy("shard").agg(
        F.sum("size").alias("bytes")).collect()]
    assert len(got) == 8 and max(got) < 1.02 * min(got)


def test_shards_of_real_texts_differ_by_less_than_a_thousandth(spark):
    folder = "/root/testdata/sf0.01"
    if not os.path.isdir(folder):
        pytest.skip("test tables not found")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    got = [r.bytes for r in sharding.pack(docs, shards=8).groupBy("shard").agg(
        F.sum("size").alias("bytes")).collect()]
    assert len(got) == 8 and max(got) - min(got) < 0.001 * max(got)


def test_one_size_with_very_many_groups(make_docs):
    rows = [(i, f"{i:06}") for i in range(3000)]
    got = sharding.pack(make_docs(rows), shards=8).groupBy("shard").count().collect()
    assert sorted(r["count"] for r in got) == [375] * 8


needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no vocabulary file")


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.load()


@needs_model
def test_pieces_round_trip_and_repeat(make_docs, vocabulary, odd_rows, clashing):
    rows = odd_rows + [(20, "a  b ▁c\t\n\u0000 𝄞 é"), (21, "x" * 5000), (22, " lead and trail  ")]
    docs = make_docs(rows, clashing)
    coded = pieces.encode(docs, vocabulary)
    back = pieces.decode(coded, vocabulary, F.col("out.ids")).collect()
    assert len(back) == len(rows)
    assert all(r.out.text == r.row.row.text for r in back)
    assert all((r.row.out.ids is None) == (r.row.row.text is None) for r in back)

    def ids(df):
        return sorted(((r.row.doc_id is None, r.row.doc_id or 0, r.row.text or "",
                        tuple(r.out.ids or ())) for r in df.collect()))

    assert ids(coded) == ids(pieces.encode(docs.repartition(7), vocabulary))
    assert ids(coded) != ids(pieces.encode(docs, vocabulary, seed=2))
    assert pieces.encode(make_docs([]), vocabulary).count() == 0


@needs_model
def test_shared_library_spells_the_same(vocabulary):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    text = "Sampled pieces of one text, ünï, 日本.\n"
    ids, _ = pieces.Segmenter(vocabulary).encode([text.encode()], [5])
    assert model.decode(ids.tolist()) == text


@needs_model
def test_samples_follow_the_path_weights(vocabulary):
    """Frequencies of all segmentations of a short word against their exact shares."""
    word, n = b" theme", 20_000
    spelt = {}
    for i, s in enumerate(vocabulary.spelling):
        if s and i not in set(vocabulary.byte_ids.tolist()):
            spelt[s] = i

    def paths(at):
        if at == len(word):
            return [((), 0.0)]
        return [((spelt[word[at:end]], *rest), vocabulary.log_weight[spelt[word[at:end]]] + w)
                for end in range(at + 1, len(word) + 1) if word[at:end] in spelt
                for rest, w in paths(end)]

    weights = {p: math.exp(w) for p, w in paths(0)}
    total = sum(weights.values())
    ids, counts = pieces.Segmenter(vocabulary).encode([word[1:]] * n, np.arange(n))
    at, seen = 0, collections.Counter()
    for c in counts:
        seen[tuple(ids[at:at + c].tolist())] += 1
        at += c
    assert set(seen) <= set(weights)
    for path, w in weights.items():
        share = w / total
        assert abs(seen[path] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


@pytest.fixture(scope="module")
def segmenter():
    return pieces.Segmenter(pieces.load())


def test_one_text_without_a_space(segmenter):
    text = ("abcdefghij" * 30_000).encode()
    assert len(text) > pieces.LETTERS_AT_ONCE
    ids, counts = segmenter.encode([b"ahead", text, b"after it"], [1, 2, 3])
    ends = counts.cumsum()
    assert segmenter.decode(ids[ends[0]:ends[1]]) == text
    assert segmenter.decode(ids[ends[1]:]) == b"after it"


def test_batches_that_end_around_a_boundary(segmenter, monkeypatch):
    """The last part of a batch crosses a boundary, byte by byte."""
    monkeypatch.setattr(pieces, "LETTERS_AT_ONCE", 64)
    for size in range(100, 260):
        texts = [b"some words here " * 3, b"x" * (size % 37), b"y" * (size - 48 - size % 37)]
        ids, counts = segmenter.encode(texts, [4, 5, 6])
        ends = np.concatenate([[0], counts.cumsum()])
        assert [segmenter.decode(ids[a:b]) for a, b in zip(ends, ends[1:])] == texts
