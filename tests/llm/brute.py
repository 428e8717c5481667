"""Plain versions of the operators, for small tables."""

import math
import re
import string

import zstandard

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def contamination(text, items, window=13):
    """n_words, hit word places, item ids."""
    tokens, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i:i + window]
            for s in range(len(tokens) - len(part) + 1):
                if tokens[s:s + len(part)] == part:
                    hit.update(range(s, s + len(part)))
                    found.add(item)
    return len(tokens), hit, found


def one_edit(a, b):
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def repeated_lines(docs, least=3, near=8):
    """{doc_id: dropped line numbers} for (doc_id, text) in order."""
    seen, seen_near, out = set(), [], {}
    for doc, text in sorted(docs, key=lambda d: d[0]):
        out[doc] = []
        for n, line in enumerate(text.split("\n") if text else []):
            w = words(line)
            if len(w) < least:
                continue
            if tuple(w) in seen:
                out[doc].append(n)
                continue
            if len(w) >= near:
                if any(one_edit(w, o) for o in seen_near if abs(len(o) - len(w)) <= 1):
                    out[doc].append(n)
                seen_near.append(w)
            seen.add(tuple(w))
    return out


def groups(ids, linked):
    """Smallest id reachable by links, and link counts."""
    name, count = {i: i for i in ids}, {i: 0 for i in ids}

    def top(x):
        while name[x] != x:
            x = name[x]
        return x

    ids = sorted(ids)
    for k, a in enumerate(ids):
        for b in ids[k + 1:]:
            if linked(a, b):
                count[a] += 1
                count[b] += 1
                x, y = sorted((top(a), top(b)))
                name[y] = x
    return {i: top(i) for i in ids}, count


def shingles(text, n=5):
    w = words(text)
    return frozenset(tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def similar(docs, threshold=(4, 5)):
    sets = {d: shingles(t) for d, t in docs}

    def linked(a, b):
        both = len(sets[a] & sets[b])
        return both > 0 and threshold[1] * both >= threshold[0] * len(sets[a] | sets[b])

    return groups([d for d, _ in docs], linked)


def repeated_spans(docs, window):
    """{doc: merged byte intervals covered by windows that start elsewhere too}."""
    starts = {}
    for doc, text in docs:
        data = (text or "").encode()
        for i in range(len(data) - window + 1):
            starts[data[i:i + window]] = starts.get(data[i:i + window], 0) + 1
    out = {}
    for doc, text in docs:
        data, spans = (text or "").encode(), []
        for i in range(len(data) - window + 1):
            if starts[data[i:i + window]] > 1:
                if spans and i <= spans[-1][1]:
                    spans[-1][1] = i + window
                else:
                    spans.append([i, i + window])
        out[doc] = spans
    return out


def language(text, model, features):
    """Language and score by asking every machine of the model for this one text."""
    if not any(c.isalpha() for c in text or "") or not model.families:
        return "und", 0.0
    vector, chance = features(text), {}
    for machine, weights, (slope, offset) in zip(model.machines, model.weights, model.curves):
        margin = sum(float(w) * float(v) for w, v in zip(weights, vector)) + float(weights[-1])
        chance[machine] = 1 / (1 + math.exp(-min(30.0, max(-30.0, slope * margin + offset))))
    family, share = model.families[0], 1.0
    if len(model.families) > 1:
        p = {f: chance["family", f[0]] for f in model.families}
        family = max(p, key=p.get)
        share = p[family] / (sum(p.values()) or 1.0)
    won, total = {m: 0 for m in family[1]}, {m: 0.0 for m in family[1]}
    for (a, b), p in chance.items():
        if a in won and b in won:
            won[a if p >= 0.5 else b] += 1
            total[a] += p
            total[b] += 1 - p
    best = sorted(won, key=lambda m: (-won[m], -total[m], m))[0]
    inner = total[best] / (len(won) - 1) if len(won) > 1 else 1.0
    return best, min(1.0, max(0.0, share * inner))


def quality(text, model, level, block, prior):
    """Score from fresh compressors for every block of this one text."""
    data = (text or "").encode()

    def size(dictionary):
        held = zstandard.ZstdCompressionDict(dictionary)
        return sum(len(zstandard.ZstdCompressor(
            level=level, dict_data=held, write_checksum=False, write_content_size=False,
            write_dict_id=False).compress(data[i:i + block])) for i in range(0, len(data), block))

    slope, short, offset = model.curve
    z = (slope * (size(model.bad) - size(model.good)) + short * prior) / (
        len(data) + prior) + offset
    return 1 / (1 + math.exp(-min(30.0, max(-30.0, z))))
