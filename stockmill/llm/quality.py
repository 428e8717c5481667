"""Quality by compression: dictionaries of good and of bad text, and which one helps more.

Two zstandard dictionaries are built from labelled good and bad texts.  A text is cut into
blocks, so that long texts keep needing the dictionary, and every block is compressed with
each.  The difference of the two sizes, divided by the text's length, goes through a logistic
curve fitted on other labelled texts: the score.  The curve also knows how short a text is,
as a short one shows little difference either way.

An empty or null text has difference zero and the greatest shortness.  Rows are scored
alone: repeated rows, ties, null ids and extra columns do not matter.  With fewer than
``MIN_PER_CLASS`` usable texts of either label every text gets the share of good labels (1.0
when nothing is labelled), so that a filter keeps what it cannot judge.
"""

import math
from dataclasses import dataclass

import numpy as np
import zstandard
from pyspark.sql import functions as F

from stockmill.llm.common import held_out, with_arrow_columns

#: Labelled texts taken per label, at most; half build the dictionary, half fit the curve.
SAMPLE_PER_CLASS = 2000
#: Longer labelled texts are not used for fitting; every text is scored whole.
SAMPLE_TEXT_BYTES = 32 << 10
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 2 << 10
LEVEL = 3
KEEP_FROM = 0.3
MIN_PER_CLASS = 16
_PRIOR_BYTES = 64


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    curve: tuple  # slope, weight of shortness, offset


def _compressor(dictionary):
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=held, write_checksum=False,
                                    write_content_size=False, write_dict_id=False)


def _difference(text, good, bad):
    """Bytes that the good dictionary saves over the bad one, per byte of text; shortness; 1."""
    saved = 0
    for start in range(0, len(text), BLOCK_BYTES):
        block = text[start:start + BLOCK_BYTES]
        saved += len(bad.compress(block)) - len(good.compress(block))
    return saved / (len(text) + _PRIOR_BYTES), _PRIOR_BYTES / (len(text) + _PRIOR_BYTES), 1.0


def _logistic(curve, x):
    z = sum(a * b for a, b in zip(curve, x))
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))


def _dictionary(texts):
    """A trained zstandard dictionary; too little text to train one is used as it is."""
    try:
        samples = [t[i:i + BLOCK_BYTES] for t in texts for i in range(0, len(t), BLOCK_BYTES)]
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(texts)[:DICTIONARY_BYTES] or b"\n" * 8


def _curve(x, y, ridge=1e-3, rounds=100):
    """Weights of a logistic curve, by Newton steps on scaled columns."""
    scale = np.where(np.std(x, 0) > 0, np.std(x, 0), 1)
    z = x / scale
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, z.T @ (y - p) - ridge * w)
        w += np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def fit(docs, labels, doc_id="doc_id", text="text", label="quality",
        sample_per_class=SAMPLE_PER_CLASS):
    """A model from labelled rows outside the held-out fold.

    At most ``sample_per_class`` ids per label, chosen by a hash of the id, so what reaches
    the driver is bounded.
    """
    usable = labels.where(~held_out(doc_id) & F.col(label).isin(0, 1)).select(
        F.col(doc_id).alias("id"), F.col(label).alias("label"))
    counts = {r.label: r["count"] for r in usable.groupBy("label").count().collect()}
    pick = [usable.where(F.col("label") == k).orderBy(F.xxhash64("id"), "id")
            .limit(sample_per_class) for k in (0, 1)]
    ids = pick[0].union(pick[1])  # bounded by 2 * sample_per_class, so it may be broadcast
    rows = (
        docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
        .where(F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_TEXT_BYTES))
        .join(F.broadcast(ids), "id")
        .orderBy(F.xxhash64("id", "text")).limit(2 * sample_per_class)
        .collect()
    )
    parts = {0: [], 1: []}
    for r in sorted(rows, key=lambda r: (r.label, r.id, r.text)):
        parts[r.label].append(r.text.encode())
    share = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
    if min(len(parts[0]), len(parts[1])) < MIN_PER_CLASS:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(b"\n" * 8, b"\n" * 8, (0.0, 0.0, math.log(share / (1 - share))))
    good, bad = _dictionary(parts[1][::2]), _dictionary(parts[0][::2])
    with_good, with_bad = _compressor(good), _compressor(bad)
    x, y, weight = [], [], {k: counts[k] / len(parts[k][1::2]) for k in parts}
    for k in parts:
        for t in parts[k][1::2]:
            x.append(_difference(t, with_good, with_bad))
            y.append(k)
    slope, short, offset = _curve(np.array(x), np.array(y, float)).tolist()
    # the sample holds the labels in other shares than the table
    return Model(good, bad, (slope, short, offset + math.log(weight[1] / weight[0])))


def score(docs, model, text="text"):
    """Columns ``row`` (the document's own) and ``out.score`` from 0 to 1, of whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        held = shared.value
        good, bad = _compressor(held.good), _compressor(held.bad)

        def compute(texts):
            return [[_logistic(held.curve, _difference((t or "").encode(), good, bad))
                     for t in texts.to_pylist()]]

        return compute

    return with_arrow_columns(docs, [text], "score double", prepare)
