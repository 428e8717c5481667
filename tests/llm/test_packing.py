"""Sum-of-squares packing."""

import collections
import random

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stockmill.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


def checked(docs, packed, size=1024):
    """Every id once and in place; returns the lengths of sequences."""
    plain = Tokenizer.from_file(PATH)
    want = collections.Counter()
    for key, text in docs:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [0]
        want[key, len(ids), np.array(ids, "<u4").tobytes()] += 1
    rows = packed.collect()
    by_key, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0
        by_key[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    for held in sequences.values():
        at = 0
        for r in sorted(held, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= size
    for (key, n), held in by_key.items():
        bodies = [b for (k, m, b), c in want.items() if (k, m) == (key, n) for _ in range(c)]
        assert sum(r.length for r in held) == n * len(bodies)
        if len(bodies) == 1:
            assert b"".join(r.ids for r in sorted(held, key=lambda r: r.start)) == bodies[0]
        for r in held:
            assert any(b[4 * r.start:4 * (r.start + r.length)] == r.ids for b in bodies)
    assert set(by_key) == {(k, n) for k, n, _ in want}
    return [sum(r.length for r in held) for held in sequences.values()]


def test_packing(make_docs, odd_rows, clashing):
    rng = random.Random(5)
    rows = odd_rows + [(i, " ".join(rng.choice(["the", "house", "ünï", "x1"]) for _ in
                                    range(rng.randrange(2500)))) for i in range(100, 250)]
    packed = packing.pack(make_docs([(*r,) for r in rows], clashing), PATH)
    assert packed.columns[0] == "doc_id"
    lengths = checked(rows, packed)
    assert sum(n < 1024 for n in lengths) <= 3 * 10  # by powers of two, once a task
    assert all(n & (n - 1) == 0 for n in lengths)
    assert packing.pack(make_docs([]), PATH).count() == 0


def test_small_windows(make_docs):
    """Windows of 16 ids, eight open at most."""
    rng = random.Random(8)
    rows = [(i, " a" * rng.randrange(40)) for i in range(400)]
    lengths = checked(rows, packing.pack(make_docs(rows), PATH, size=16, open_windows=8), 16)
    assert all(n & (n - 1) == 0 for n in lengths)
    with pytest.raises(ValueError):
        packing.pack(make_docs(rows), PATH, size=10)


def test_choice_is_least_sum_of_squares():
    rng, size = random.Random(3), 32
    levels, open_at = packing.Levels(size), collections.Counter()
    for _ in range(3000):
        n = rng.randrange(1, size)

        def after(h):
            new = open_at.copy()
            if h:
                new[h] -= 1
            if h + n < size:
                new[h + n] += 1
            return sum(v * v for v in new.values())

        fits = [0] + [h for h, v in open_at.items() if v and h + n <= size]
        h = levels.choose(n)
        assert h in fits and after(h) == min(map(after, fits))
        levels.move(h, n)
        if h:
            open_at[h] -= 1
        if h + n < size:
            open_at[h + n] += 1


def test_two_libraries_agree(spark, sf_dir):
    coder, plain = packing.Coder(PATH), Tokenizer.from_file(PATH)
    assert coder._quick is not None
    texts = [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select(
        "text").where(F.col("text").isNotNull()).collect()]
    texts += ["a<|endoftext|> b", "текст ünï 日本語", "x" * 50_000, " \n \t  a  ", "it's 12.5 ©®"]
    assert [coder.ids(t) for t in texts] == [
        plain.encode(t, add_special_tokens=False).ids for t in texts]
