"""Language by hierarchical discrimination: family first, then the close relatives.

A linear support vector machine per family (one against the rest) picks the family; inside
it, one machine per pair of languages votes.  Features are hashed byte trigrams of the
lower-case words of the whole text, square-rooted and scaled to length one.

A null text, or one without a letter, is ``und`` with score 0.  Every row is predicted alone,
so repeated rows, null ids and extra columns do not matter; equal votes go to the larger sum
of probabilities, then to the first language by name.  A language without training rows is
never predicted; without any training row all texts are ``und``.
"""

import re
from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from stockmill.llm.common import held_out, with_arrow_columns

UNDETERMINED = "und"
#: Families of languages by ISO 639-1 code; a language not listed is its own family.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af fy lb yi",
    "romance": "fr es it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk bs",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz ky tk",
    "indic": "hi mr ne bn gu pa ur",
    "semitic": "ar he mt am",
}
#: Labelled texts used for fitting: per language on average at most, in all, and per language at
#: least, however many languages there are.
SAMPLE_PER_LANGUAGE = 500
SAMPLE = 2500
LEAST_PER_LANGUAGE = 8
FEATURES = 4096
#: Each training text also gives a snippet of so many characters, for short texts.
SNIPPET = 80

_FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
_LETTER = re.compile(r"[^\W\d_]")
_SPACED = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass(frozen=True)
class Model:
    """One row of ``weights`` and (slope, offset) per machine."""

    families: tuple     # (family, its languages)
    machines: tuple     # ("family", name) or (first language, second language)
    weights: np.ndarray
    curves: np.ndarray


def family(language):
    return _FAMILY_OF.get(language, f"only-{language}")


def features(text):
    """Unit vector of hashed trigrams."""
    spaced = b" " + b" ".join(text.lower().encode("utf-8", "ignore").translate(_SPACED).split())
    b = np.frombuffer(spaced + b"  ", np.uint8).astype(np.uint32)
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    counts = np.sqrt(np.bincount(code >> np.uint32(20), minlength=FEATURES))
    return (counts / np.linalg.norm(counts)).astype(np.float32)


def has_letter(text):
    return bool(text) and _LETTER.search(text) is not None


def _machine(x, y, rounds=400, batch=256, penalty=1e-4):
    """Linear support vector machine by averaged subgradient steps; the last column is the bias."""
    rng = np.random.default_rng(7)
    x = np.hstack([x, np.ones((len(x), 1), np.float32)])
    sides = [np.flatnonzero(y > 0), np.flatnonzero(y < 0)]
    w, mean = np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for step in range(1, rounds + 1):
        rows = np.concatenate([rng.choice(side, batch // 2) for side in sides])
        wrong = rows[y[rows] * (x[rows] @ w) < 1]
        w -= (penalty * w - (y[wrong, None] * x[wrong]).sum(0) / batch) * 20 / np.sqrt(step)
        mean += w * (step > rounds // 2)
    return mean / (rounds - rounds // 2)


def _curve(margin, y):
    """Slope and offset that make margins probabilities (Newton steps, ridge)."""
    z, t, w = np.stack([margin, np.ones_like(margin)], 1), (y > 0).astype(float), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        hess = (z * (p * (1 - p) + 1e-6)[:, None]).T @ z + 1e-2 * np.eye(2)
        w += np.clip(np.linalg.solve(hess, z.T @ (t - p) - 1e-2 * w), -3, 3)
    return w


def _fit_arrays(x, fit, langs):
    """``fit`` marks the rows that train; the rest give the curves."""
    names = sorted(set(langs[fit]))
    groups = {}
    for name in names:
        groups.setdefault(family(name), []).append(name)
    wanted = [("family", f) for f in groups] if len(groups) > 1 else []
    wanted += [pair for members in groups.values() for pair in combinations(members, 2)]
    weights, curves = [np.zeros((0, x.shape[1] + 1))], [np.zeros((0, 2))]
    for first, second in wanted:
        if first == "family":
            rows = np.ones(len(langs), bool)
            y = np.where(np.isin(langs, groups[second]), 1.0, -1.0)
        else:
            rows = np.isin(langs, [first, second])
            y = np.where(langs == first, 1.0, -1.0)
        w = _machine(x[rows & fit], y[rows & fit])
        tune = rows & ~fit if len(set(y[rows & ~fit])) == 2 else rows
        weights.append(w[None])
        curves.append(_curve(x[tune] @ w[:-1] + w[-1], y[tune])[None])
    return Model(tuple((f, tuple(m)) for f, m in groups.items()), tuple(wanted),
                 np.concatenate(weights).astype(np.float32), np.concatenate(curves))


def fit(docs, doc_id="doc_id", text="text", lang="lang", sample=SAMPLE_PER_LANGUAGE):
    """A model from rows outside the held-out fold whose language is known.

    About ``sample`` rows per language, picked by a hash of the id: ``SAMPLE`` in all or
    ``LEAST_PER_LANGUAGE`` each, whichever is more, and never more than twice that; every language
    is learned.  Feature vectors (8 KB each) come to the driver, texts do not.
    """
    known = docs.where(~held_out(doc_id) & F.col(lang).isNotNull()).select(
        F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return Model((), (), np.zeros((0, FEATURES + 1), np.float32), np.zeros((0, 2)))
    sample = max(min(sample, SAMPLE // len(counts)), LEAST_PER_LANGUAGE)
    scale = 1 << 30
    share = F.create_map(*[F.lit(v) for r in counts
                           for v in (r.lang, min(scale, scale * sample // r["count"]))])
    picked = known.where(F.pmod(F.xxhash64("id"), F.lit(scale)) < share[F.col("lang")]).limit(
        2 * sample * len(counts))

    def prepare():
        def compute(texts):
            out = [], []
            for t in texts.to_pylist():
                usable = has_letter(t)
                out[0].append(features(t).astype(np.float16).tobytes() if usable else None)
                middle = max(0, len(t or "") // 2 - SNIPPET)
                snippet = (t or "")[middle:middle + SNIPPET]
                out[1].append(features(snippet).astype(np.float16).tobytes()
                              if has_letter(snippet) else None)
            return out

        return compute

    rows = with_arrow_columns(picked, [F.col("text")], "whole binary, snippet binary",
                              prepare).select("row.id", "row.lang", "out.*").collect()
    rows = sorted(rows, key=lambda r: (r.lang, r.id is None, r.id or 0, r.whole or b""))
    vectors, langs, fits = [], [], []
    for i, r in enumerate(rows):
        for vector in (r.whole, r.snippet):
            if vector:
                vectors.append(np.frombuffer(vector, np.float16))
                langs.append(r.lang)
                fits.append(i % 4 > 0)
    if not vectors:
        return Model((), (), np.zeros((0, FEATURES + 1), np.float32), np.zeros((0, 2)))
    langs, fits = np.array(langs, object), np.array(fits)
    for name in set(langs):  # a language with one row has it in both parts
        if not fits[langs == name].any():
            fits[langs == name] = True
    return _fit_arrays(np.stack(vectors).astype(np.float32), fits, langs)


def decide(model, chance):
    """Language and score from the machines' probabilities."""
    at = dict(zip(model.machines, chance))
    best, p_family = model.families[0], 1.0
    if len(model.families) > 1:
        total = sum(at["family", f] for f, _ in model.families) or 1.0
        best = max(model.families, key=lambda f: at["family", f[0]])
        p_family = at["family", best[0]] / total
    members = best[1]
    votes = {m: [0, 0.0] for m in members}
    for first, second in combinations(members, 2):
        p = at[first, second]
        votes[first if p >= 0.5 else second][0] += 1
        votes[first][1] += p
        votes[second][1] += 1 - p
    name = max(sorted(members), key=lambda m: votes[m])
    inner = votes[name][1] / (len(members) - 1) if len(members) > 1 else 1.0
    return name, float(min(1.0, max(0.0, p_family * inner)))


def predict(docs, model, text="text"):
    """Columns ``row`` (the document's own) and ``out``: lang_pred, score; whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def prepare():
        held = shared.value

        def compute(texts):
            names, scores = [], []
            for t in texts.to_pylist():
                if not has_letter(t) or not held.families:
                    names.append(UNDETERMINED)
                    scores.append(0.0)
                    continue
                margin = held.weights[:, :-1] @ features(t) + held.weights[:, -1]
                z = np.clip(held.curves[:, 0] * margin + held.curves[:, 1], -30, 30)
                name, value = decide(held, 1 / (1 + np.exp(-z)))
                names.append(name)
                scores.append(value)
            return names, scores

        return compute

    return with_arrow_columns(docs, [text], "lang_pred string, score double",
                              prepare)
