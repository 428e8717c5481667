"""Benchmark decontamination: one Aho-Corasick automaton over the normalised items.

Words are runs of digits, letters and any non-ASCII characters, ASCII letters in lower case.
A window is ``window`` consecutive item words; a shorter item with words is one window.  Item
words are numbered, and the automaton reads word numbers, so it has at most ``window`` nodes per
item word.  A text is read once; every word inside an occurrence of a window is hit, and hit
runs are mapped back to character offsets of the original text.

Null and empty texts have no words and no hits.  Repeated items and rows, null ids and extra
columns are fine: each row is judged alone.  Item ids may have any type that sorts.  Without
items nothing is hit.
"""

import re
import uuid
from itertools import repeat

import ahocorasick
from pyspark.sql import functions as F

from stockmill.llm.common import stored, with_arrow_columns

WINDOW = 13
#: Item text of one automaton: at two bytes a word or more, at most 6.8 million nodes.
ITEM_BYTES = 1 << 20
#: A document is contaminated when hit words are at least one in so many.
ONE_IN = 20

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_OUT = ("n_words bigint, n_hit bigint, items array<{item}>, runs array<array<bigint>>, "
        "spans array<array<bigint>>")
_automata = {}


def words(text):
    """Normalised words of UTF-8 bytes."""
    return text.translate(_CLEAN).split()


def item_windows(items, window):
    """Every window of (id, text) pairs: normalised text to its ids."""
    found = {}
    for item, text in items:
        tokens = words(text.encode()) if text else []
        for start in range(max(1, len(tokens) - window + 1) if tokens else 0):
            found.setdefault(b" ".join(tokens[start:start + window]), set()).add(item)
    return found


def automaton(windows):
    """The automaton over word numbers, and the numbers of item words (from 1)."""
    built = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    numbers = {}
    for pattern, items in windows.items():
        key = tuple(numbers.setdefault(w, len(numbers) + 1) for w in pattern.split(b" "))
        built.add_word(key, (len(key), tuple(items)))
    if windows:
        built.make_automaton()
    return built, numbers


def _merge(runs):
    merged = []
    for first, last in sorted(runs):
        if merged and first <= merged[-1][1] + 1:
            merged[-1][1] = max(merged[-1][1], last)
        else:
            merged.append([first, last])
    return merged


def scan_text(text, built, before=()):
    """Word count, item ids and merged hit runs (first word, last word) of one text."""
    tokens = words(text)
    runs, items = [list(r) for r in before], set()
    tree, numbers = built
    if tokens and numbers:
        # the number 0 is no item word and leads back to the root
        for last, (length, ids) in tree.iter(tuple(map(numbers.get, tokens, repeat(0)))):
            runs.append([last - length + 1, last])
            items.update(ids)
    return len(tokens), items, _merge(runs)


def char_spans(text, runs):
    """(start, end) character offsets in the original text of runs of words."""
    if not runs:
        return []
    places = [m.span() for m in _WORD.finditer(text.translate(_CLEAN))]
    spans = []
    for first, last in runs:
        start = len(text[:places[first][0]].decode())
        spans.append([start, start + len(text[places[first][0]:places[last][1]].decode())])
    return spans


def scan(docs, items, text="text", item_id="item_id", item_text="text", window=WINDOW,
         item_bytes=ITEM_BYTES):
    """Columns ``row`` (the document's own) and ``out``: n_words, n_hit, items (sorted ids of
    items with occurring windows), spans (character offsets of hit runs), contaminated.

    The automaton goes to every task, so its size is checked: item texts beyond
    ``item_bytes`` are cut into blocks of that size by item id and the texts are scanned once
    per block, the hit runs carried from one pass to the next.
    """
    rows = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    kind = rows.schema["item"].dataType.simpleString()
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = -(-size // item_bytes) or 1
    state = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"),
        F.struct(F.array().cast(f"array<{kind}>").alias("items"),
                 F.array().cast("array<array<bigint>>").alias("runs")).alias("out"))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        windows = item_windows(((r.item, r.text) for r in part.toLocalIterator()), window)
        state = _one_pass(state, text, windows, kind)
        if block + 1 < blocks:
            state = stored(state, "decontaminate")
    n_hit, n_words = F.col("out.n_hit"), F.col("out.n_words")
    return state.select("row", F.struct(
        "out.n_words", "out.n_hit", "out.items", "out.spans",
        ((n_hit > 0) & (n_hit * ONE_IN >= n_words)).alias("contaminated")).alias("out"))


def _one_pass(state, text, windows, kind):
    shared = state.sparkSession.sparkContext.broadcast(windows)
    name = uuid.uuid4().hex

    def prepare():
        if name not in _automata:  # built once per Python worker
            _automata.clear()
            _automata[name] = automaton(shared.value)
        built = _automata[name]

        def compute(texts, items_before, runs_before):
            out = [], [], [], [], []
            for text, items, runs in zip(texts.to_pylist(), items_before.to_pylist(),
                                         runs_before.to_pylist()):
                data = (text or "").encode()
                n_words, found, merged = scan_text(data, built, runs)
                out[0].append(n_words)
                out[1].append(sum(last - first + 1 for first, last in merged))
                out[2].append(sorted(found.union(items), key=lambda x: (x is None, x)))
                out[3].append(merged)
                out[4].append(char_spans(data, merged))
            return out

        return compute

    scanned = with_arrow_columns(
        state, [F.col("row")[text], F.col("out.items"), F.col("out.runs")],
        _OUT.format(item=kind), prepare)
    return scanned.select("row.row", "out")
