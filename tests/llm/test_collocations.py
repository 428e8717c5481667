"""Phrase collocations against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from stockmill.llm import collocations as co

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, least, longest=4, top=2000, absorbed=80):
    freq, totals = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                freq.update((lang, *w[i:i + k]) for i in range(len(w) - k + 1))
    found = {p: f for p, f in freq.items() if f >= least and len(p) > 2}
    inside = collections.defaultdict(int)
    for (lang, *w), f in found.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                part = (lang, *w[i:i + k])
                inside[part] = max(inside[part], f)
    out = []
    for (lang, *w), a in found.items():
        if 100 * inside[lang, *w] >= absorbed * a:
            continue
        cuts = [(freq[lang, *w[:k]], freq[lang, *w[k:]]) for k in range(1, len(w))]
        score, _, l, r = min((2000000 * a // (l + r), k, l, r) for k, (l, r) in enumerate(cuts))
        out.append((lang, -score, -a, " ".join(w).encode(), l, r))
    out.sort()
    result, place = [], collections.Counter()
    for lang, score, a, phrase, l, r in out:
        place[lang] += 1
        if place[lang] <= top:
            result.append((lang, place[lang], phrase.decode(), -a, l, r, totals[lang], -score))
    return result


def rows_of(df):
    return sorted(tuple(r) for r in df.select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("least, top, block_bytes", [(2, 2000, 1 << 24), (3, 7, 300)])
def test_against_plain_counting(make_docs, least, top, block_bytes):
    rng = random.Random(least)
    words = ["The", "of", "and", "a", "ünï", "日本", "x\x00y", "new", "York", "City", "in"]
    rows = []
    for i in range(250):
        text = "".join(rng.choice(words[:rng.choice([4, 11])]) + rng.choice(
            [" ", " ", " ", "\t  ", ". ", ",", "\n"]) for _ in range(rng.randrange(40)))
        rows.append((i, text, rng.choice(["en", "fr", None, "und"])))
    rows += [(1, None, "en"), (2, "", "en"), (3, " .,\n", "de"), (4, rows[0][1], rows[0][2]),
             (None, "new york city " * 3000, None), (5, "word" * 50_000, "en")]
    got = rows_of(co.collocations(make_docs(rows), least=least, top=top, block_bytes=block_bytes))
    want = sorted(plain([(lang, text) for _, text, lang in rows], least, top=top))
    assert got == want and len({r[0] for r in got}) == 3


def test_nothing_to_find(make_docs):
    assert co.collocations(make_docs([])).count() == 0
    assert co.collocations(make_docs([(1, "one two three", "en")])).count() == 0


@pytest.mark.parametrize("bits, dense_ids, share", [(8, 1 << 13, 4), (2, 16, 2), (1, 8, 1000)])
def test_tiles_count_all_pairs(bits, dense_ids, share):
    rng = np.random.default_rng(bits)
    left, right = (rng.zipf(1.3, 20_000).astype(np.int64) % 5000 for _ in range(2))
    lefts, rights, counts, number = co.count_pairs(left, right, bits, dense_ids, share)
    want = collections.Counter(zip(left.tolist(), right.tolist()))
    assert len(counts) == len(want)
    assert {(a, b): n for a, b, n in zip(lefts, rights, counts)} == want
    assert (lefts[number] == left).all() and (rights[number] == right).all()


def test_large_counts_stay_exact(spark):
    """Products beyond 64 bits."""
    big = (1 << 62) + 1
    known = spark.createDataFrame([("en", big, [big, big + 2], [big + 4, big])],
                                  "lang string, f bigint, heads array<bigint>, tails array<bigint>")
    low = co._scored(known).collect()[0].low
    cuts = [(2000000 * big // (l + r), k, l, r) for k, (l, r) in enumerate(
        [(big, big + 4), (big + 2, big)])]
    assert tuple(low) == min(cuts)
