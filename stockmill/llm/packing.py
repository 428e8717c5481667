"""Packing of tokenized documents into sequences by the online sum-of-squares rule.

A document is its token ids and an end id.  It is cut every ``SEQUENCE`` ids; whole parts are
sequences of their own, the rest enters a window that is partly filled, or a new one: the one
that leaves the least sum of squares of the numbers of open windows per fill level.  A level
array holds these numbers, so a document costs one pass over the levels.  Windows leave as soon
as they are full.

Every task packs the documents of its partition as they come and needs no other task.  It holds
open windows only.  When ``OPEN`` windows are open, and at the end of the task, those still open
are joined and cut anew into full sequences; what is then left becomes sequences of power-of-two
lengths, which need no padding.  Only documents in such windows are cut below ``SEQUENCE`` ids.

A null text is an empty one and gives its end id alone.  Repeated rows and equal or null keys are
documents of their own; the order of rows decides only where they lie.  Sequence numbers hold
the task's number, so the input should be a table, whose partitions a second attempt sees alike.
An empty table gives no rows; other columns are not read.
"""

import json
import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from stockmill.llm.common import give_back, slices

SEQUENCE = 1024
END_ID = 0
#: Windows a task keeps open: at most this many times ``SEQUENCE`` ids.
OPEN = 4096
_OUT_IDS = 1 << 20
_TASK_SHIFT = 40
_COLUMNS = ("start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, "
            "offset bigint")
# Fixed value: how byte-level BPE parts a text
_PARTS = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
_BEYOND_LATIN = re.compile("[^\x00-ɏ]")


def byte_alphabet():
    """The character that stands for each byte in a byte-level vocabulary: visible Latin-1
    characters stand for themselves, the other bytes take those from U+0100 on, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {chr(b if b in visible else next(others)): b for b in range(256)}


class Coder:
    """Token ids as the tokenizer's file defines them.

    Texts of Latin script go through the quicker of two libraries, where the file's merges are
    in the order of their ids, so that both must give the same; letters elsewhere, whose classes
    change with the Unicode version, and texts that spell a special token use ``tokenizers``.
    """

    def __init__(self, path):
        self._plain = Tokenizer.from_file(path)
        model = json.loads(self._plain.to_str())
        vocab = self._plain.get_vocab(with_added_tokens=False)
        added = [t["content"] for t in model["added_tokens"]]
        byte_of = byte_alphabet()
        self._quick = None
        if model["model"]["type"] == "BPE" and set("".join(vocab)) <= set(byte_of):
            merged = [vocab["".join(m if isinstance(m, list) else m.split(" "))]
                      for m in model["model"]["merges"]]
            parts = model.get("pre_tokenizer") or {}
            if (merged == sorted(merged) and parts.get("type") == "ByteLevel"
                    and parts.get("use_regex") and not parts.get("add_prefix_space")
                    and not model.get("normalizer")):
                self._quick = tiktoken.Encoding(
                    "vocabulary", pat_str=_PARTS, special_tokens={}, mergeable_ranks={
                        bytes(byte_of[c] for c in t): i for t, i in vocab.items()
                        if t not in added})
        self._special = re.compile("|".join(map(re.escape, added)) or "(?!)")

    def ids(self, text):
        if (self._quick is None or _BEYOND_LATIN.search(text) or self._special.search(text)):
            return self._plain.encode(text, add_special_tokens=False).ids
        return self._quick.encode_ordinary(text)


class Levels:
    """Numbers of open windows per fill level, and the sum-of-squares choice.

    Moving a window from level h to h + n changes the sum of squares by
    2 * (N[h + n] - N[h] + 1); a new window counts as leaving a level of half a window, a full
    one as entering a level of minus a half.  Twice the numbers are held, to stay whole.
    """

    def __init__(self, size):
        self.size = size
        self._twice = np.zeros(size + 1, np.int64)
        self._twice[0], self._twice[size] = 1, -1

    def choose(self, n):
        """The level whose window takes ``n`` more ids (0: a new window); the fullest on ties."""
        here, there = self._twice[:self.size - n + 1], self._twice[n:]
        change = np.where(here > 0, there - here, np.iinfo(np.int64).max)
        return len(here) - 1 - int(np.argmin(change[::-1]))

    def move(self, level, n):
        if level:
            self._twice[level] -= 2
        if level + n < self.size:
            self._twice[level + n] += 2

    def clear(self):
        self._twice[1:self.size] = 0


class Packer:
    """Windows of one task.  A piece is (key, start, ids, ids of its document)."""

    def __init__(self, first, size=SEQUENCE, open_windows=OPEN):
        self._next, self._size, self._limit = first, size, open_windows
        self._levels = Levels(size)
        self._open, self._count = [[] for _ in range(size)], 0
        self.done = []   # (piece, sequence, offset)
        self.held = 0    # ids in done

    def add(self, key, ids):
        whole = len(ids) - len(ids) % self._size
        for start in range(0, whole, self._size):
            self._leave([(key, start, ids[start:start + self._size], len(ids))])
        rest = len(ids) - whole
        if not rest:
            return
        level = self._levels.choose(rest)
        window = self._open[level].pop() if level else []
        window.append((key, whole, ids[whole:], len(ids)))
        self._levels.move(level, rest)
        self._count -= level > 0
        if level + rest == self._size:
            self._leave(window)
            return
        self._open[level + rest].append(window)
        self._count += 1
        if self._count == self._limit:
            self.join()

    def join(self, end=False):
        """Windows that are open become full sequences; the remainder stays open, or leaves in
        power-of-two lengths at the end."""
        pieces = [p for level in reversed(self._open) for window in level for p in window]
        self._open, self._count = [[] for _ in range(self._size)], 0
        self._levels.clear()
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left >= self._size or (end and left):
            room = min(self._size, 1 << (left.bit_length() - 1))
            left -= room
            window = []
            while room:
                key, start, ids, n = pieces.pop()
                window.append((key, start, ids[:room], n))
                if len(ids) > room:
                    pieces.append((key, start + room, ids[room:], n))
                room -= len(window[-1][2])
            self._leave(window)
        if left:
            self._levels.move(0, left)
            self._open[left].append(pieces[::-1])
            self._count = 1

    def _leave(self, window):
        offset = 0
        for piece in window:
            self.done.append((piece, self._next, offset))
            offset += len(piece[2])
        self._next += 1
        self.held += offset


def pack(docs, tokenizer, key="doc_id", text="text", size=SEQUENCE, end_id=END_ID,
         open_windows=OPEN):
    """One row per piece: ``key``, start, length, ids (little-endian unsigned 32-bit, as token
    files hold them), doc_tokens, sequence_id, offset.

    ``tokenizer`` is the path of a tokenizer file that every executor has.  ``size`` must be a
    power of two.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    sent = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    schema = StructType([sent.schema["key"], *StructType.fromDDL(_COLUMNS)])

    def batch_of(packer, kind):
        done, packer.done, packer.held = packer.done, [], 0
        lengths = np.array([len(p[2]) for p, _, _ in done], np.int64)
        body = (np.concatenate([p[2] for p, _, _ in done]) if done else
                np.zeros(0, np.uint32)).astype("<u4")
        ends = np.concatenate([[0], np.cumsum(lengths) * 4]).astype(np.int32)
        return pa.RecordBatch.from_arrays([
            pa.array([p[0] for p, _, _ in done], kind),
            pa.array([p[1] for p, _, _ in done], pa.int64()),
            pa.array(lengths),
            pa.BinaryArray.from_buffers(pa.binary(), len(done), [
                None, pa.py_buffer(ends), pa.py_buffer(body)]),
            pa.array([p[3] for p, _, _ in done], pa.int64()),
            pa.array([s for _, s, _ in done], pa.int64()),
            pa.array([o for _, _, o in done], pa.int64()),
        ], names=schema.names)

    def run(batches):
        coder = Coder(tokenizer)
        packer = Packer(TaskContext.get().partitionId() << _TASK_SHIFT, size, open_windows)
        kind = None
        for batch in slices(batches):
            kind = batch.column("key").type
            for k, t in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                packer.add(k, np.array([*(coder.ids(t) if t else ()), end_id], np.uint32))
                if packer.held >= _OUT_IDS:
                    yield batch_of(packer, kind)
        packer.join(end=True)
        if packer.done:
            yield batch_of(packer, kind)
        del coder, packer
        give_back()

    return sent.mapInArrow(run, schema).withColumnRenamed("key", key)
