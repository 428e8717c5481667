"""Words of a text as 64-bit hashes, for all words at once.

Words are runs of digits, letters and any non-ASCII characters, ASCII letters in lower case.
A hash of a run of words comes from prefix sums of a polynomial modulo 2**64, so that any
run, or a run with one word left out, costs a constant number of array operations.
"""

import numpy as np

CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
    for c in range(256)
)
_CHUNK = 1 << 16
#: Odd multipliers, each with its inverse modulo 2**64.
_BYTES, _FIRST, _SECOND = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
_powers = {}


def mix(x):
    """A bijection of 64-bit values that spreads every bit (SplitMix64's last step)."""
    x = np.atleast_1d(np.asarray(x, np.uint64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base, n):
    """``base**i`` for i below n, and the inverses."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for value in (base, pow(base, -1, 1 << 64)):
            row = np.full(size, value, np.uint64)
            row[0] = 1
            both.append(np.multiply.accumulate(row))
        held = _powers[base] = tuple(both)
    return held[0][:n], held[1][:n]


def prefix_sums(values, base):
    up, _ = powers(base, len(values))
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up, dtype=np.uint64, out=out[1:])
    return out


def run_hash(sums, starts, ends, base):
    """Polynomial of values[start:end], as if it began at place 0."""
    _, down = powers(base, len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def word_places(clean):
    """Starts and ends of the words in cleaned bytes."""
    inside = np.zeros(len(clean) + 2, np.int8)
    inside[1:-1] = np.frombuffer(clean, np.uint8) != 32
    edges = np.flatnonzero(np.diff(inside))
    return edges[::2], edges[1::2]


def word_hashes(text):
    """64-bit hashes of the words of UTF-8 bytes, with their starts."""
    clean = text.translate(CLEAN)
    starts, ends = word_places(clean)
    data = np.frombuffer(clean, np.uint8).astype(np.uint64)
    out = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):  # long texts by chunks of whole words
        last = max(first + 1, int(np.searchsorted(starts, starts[first] + _CHUNK)))
        low = starts[first]
        sums = prefix_sums(data[low:ends[last - 1]] + np.uint64(1), _BYTES)
        out[first:last] = run_hash(sums, starts[first:last] - low, ends[first:last] - low, _BYTES)
        first = last
    return mix(out ^ mix((ends - starts).astype(np.uint64))), starts


class Runs:
    """Hashes of runs of a sequence of word hashes, in two independent halves."""

    def __init__(self, hashes):
        self.halves = [(prefix_sums(hashes, _FIRST), _FIRST),
                       (prefix_sums(mix(hashes + np.uint64(1)), _SECOND), _SECOND)]

    def run(self, starts, ends, tag=0):
        """Two hashes of each run [start, end)."""
        n = (ends - starts).astype(np.uint64) * np.uint64(2654435761) + np.uint64(tag)
        return [mix(run_hash(s, starts, ends, base) ^ mix(n)) for s, base in self.halves]

    def without(self, start, end):
        """Two hashes of [start, end) without each of its words in turn."""
        left = np.arange(start, end)
        n = np.uint64((end - start - 1) * 2654435761)
        out = []
        for sums, base in self.halves:
            _, down = powers(base, len(sums) + 1)
            value = (sums[left] - sums[start]) * down[start]
            value += (sums[end] - sums[left + 1]) * down[start + 1]
            out.append(mix(value ^ mix(n)))
        return out


def shingles(hashes, n):
    """Sorted distinct hashes of runs of ``n`` words; a shorter text with words is one run."""
    if len(hashes) == 0:
        return hashes
    width = min(n, len(hashes))
    code = np.zeros(len(hashes) - width + 1, np.uint64)
    for k in range(width):
        code = code * np.uint64(_FIRST) + hashes[k:len(hashes) - width + 1 + k]
    return np.unique(mix(code + np.uint64(width)))
