"""SentencePiece segmentations by forward filtering and backward sampling, and decoding.

A text's piece lattice has a node per character and an edge per vocabulary piece that matches;
a character without a piece is an edge of its byte pieces.  Forward filtering sums, per node,
the probability of all paths up to it; backward sampling walks from the end and draws each
edge by its share of that sum.  The draws are hashes of (seed, row key, place in the text), so
a row gets the same segmentation on every run, in any partitioning.

No piece has a space after another character, so paths fall apart where a run of spaces
starts; equal parts share one lattice, and all parts of a batch are filtered and sampled
together.  A BPE model stores merge ranks instead of probabilities; a piece of rank r weighs
``(r + 2) ** -sharpness``.

A space stands in front of every text that is not empty, as the model expects, and goes when
decoding.  A literal U+2581, which pieces use for the space, is spelt in bytes, so decoding
gives back every text exactly; each batch is decoded and compared when it is encoded.

A null text has null pieces, an empty one none.  Repeated rows with equal keys are segmented
alike; null keys are keys like any other.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import functions as F

from stockmill.llm.common import with_arrow_columns
from stockmill.llm.words import mix, prefix_sums, run_hash

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SHARPNESS = 1.0
SEED = 1
_SPACE = "▁"
_BASE = 0xC2B2AE3D27D4EB4F
#: Bytes of text whose lattices are held at once; one longer part is held whole.
LETTERS_AT_ONCE = 1 << 18
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Vocabulary:
    """Bytes of every piece by id (None where it stands for no text), weights, byte pieces."""

    spelling: tuple
    log_weight: np.ndarray
    byte_ids: np.ndarray


def load(path=MODEL, sharpness=SHARPNESS):
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    spelling, weight, byte_ids = [], [], np.full(256, -1, np.int32)
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        weight.append(-sharpness * np.log(2 - model.get_score(i)))
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
            spelling.append(bytes([int(piece[3:5], 16)]))
            weight[-1] = -sharpness * np.log(2 + model.get_piece_size())
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            spelling.append(None)
        else:
            if _SPACE in piece.lstrip(_SPACE):
                raise ValueError(f"piece {i} has a space after another character")
            spelling.append(piece.replace(_SPACE, " ").encode())
    if (byte_ids < 0).any():
        raise ValueError("the model has no byte pieces")
    return Vocabulary(tuple(spelling), np.array(weight), byte_ids)


class Segmenter:
    """Sampled segmentations of many texts at once."""

    def __init__(self, vocabulary):
        self.words = vocabulary
        children, ends = [{}], [-1]
        bytes_only = set(vocabulary.byte_ids.tolist())
        for i, piece in enumerate(vocabulary.spelling):
            if piece is None or i in bytes_only:
                continue
            node = 0
            for b in piece:
                if b not in children[node]:
                    children[node][b] = len(children)
                    children.append({})
                    ends.append(-1)
                node = children[node][b]
            ends[node] = i
        self._next = np.zeros((len(children), 256),
                              np.uint16 if len(children) <= 1 << 16 else np.int32)
        for node, found in enumerate(children):
            for b, child in found.items():
                self._next[node, b] = child
        self._ends = np.array(ends, np.int32)
        spelt = [s or b"" for s in vocabulary.spelling]
        self._length = np.array([len(s) for s in spelt])
        self._offset = np.concatenate([[0], np.cumsum(self._length)[:-1]])
        self._letters = np.frombuffer(b"".join(spelt), np.uint8)

    def encode(self, texts, keys):
        """Piece ids of all texts in a row, and how many each has; ``keys`` seed the rows."""
        padded = [b" " + t if t else b"" for t in texts]
        data = np.frombuffer(b"".join(padded), np.uint8)
        sizes = np.array([len(p) for p in padded], np.int64)
        begin = np.cumsum(sizes) - sizes
        opens = np.flatnonzero((data[1:] == 32) & (data[:-1] != 32)) + 1
        starts = np.unique(np.concatenate([opens, begin[sizes > 0]]))
        lengths = np.diff(np.append(starts, len(data)))
        text = np.repeat(np.arange(len(sizes)), sizes)[starts]
        seeds = mix(np.asarray(keys, np.int64).view(np.uint64))
        out, counts = [np.zeros(0, np.int32)], np.zeros(len(texts), np.int64)
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(data), LETTERS_AT_ONCE)))
        cuts = cuts[cuts < len(starts)]  # nothing starts after the last part
        for low, high in zip(cuts, np.append(cuts[1:], len(starts))):
            at, owner = starts[low:high], text[low:high]
            part = data[at[0]:at[-1] + lengths[high - 1]]
            ids, n = self._encode(part, at - at[0], lengths[low:high], seeds[owner],
                                  at - begin[owner])
            out.append(ids)
            np.add.at(counts, owner, n)
        return np.concatenate(out), counts

    def letters(self, ids):
        """The bytes that pieces spell."""
        n = self._length[ids]
        ends = np.cumsum(n)
        place = np.repeat(self._offset[ids] - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)
        return self._letters[place]

    def decode(self, ids):
        """The text's bytes: what the pieces spell, without the space in front."""
        return self.letters(ids)[1:].tobytes()

    def _encode(self, data, starts, lengths, seeds, places, share=True):
        """Piece ids of parts that fill ``data``, and how many each has."""
        first = which = np.arange(len(starts))
        if share:
            sums = prefix_sums(data.astype(np.uint64) + np.uint64(1), _BASE)
            names = mix(run_hash(sums, starts, starts + lengths, _BASE)
                        ^ mix(lengths.astype(np.uint64)))
            _, first, which = np.unique(names, return_index=True, return_inverse=True)
        lattice = self._lattice(data, starts[first], lengths[first])
        ids, counts = self._sample(data, starts, seeds, places, which, lattice)
        if share and not np.array_equal(self.letters(ids), data):  # two parts with one hash
            return self._encode(data, starts, lengths, seeds, places, share=False)
        return ids, counts

    def _lattice(self, data, starts, lengths):
        """Edges of the distinct parts by end node, with cumulated shares of the filter's sums."""
        base = np.cumsum(lengths) - lengths
        part = np.repeat(np.arange(len(starts)), lengths)
        place = np.arange(len(part))
        letters = data[starts[part] + place - base[part]]
        limit = (base + lengths)[part]
        lead = np.flatnonzero((letters & 0xC0) != 0x80)
        frm, to, piece = [], [], []
        alone = np.zeros(len(letters), bool)  # characters that are a piece
        width = np.diff(np.append(lead, len(letters)))
        width_at = np.zeros(len(letters), np.int64)
        width_at[lead] = width
        at, node, depth = lead, np.zeros(len(lead), np.int64), 0
        while len(at):
            inside = at + depth < limit[at]
            at, node = at[inside], node[inside]
            node = self._next[node, letters[at + depth]]
            depth += 1
            alive = node > 0
            at, node = at[alive], node[alive]
            found = self._ends[node]
            ended = found >= 0
            frm.append(at[ended])
            to.append(at[ended] + depth)
            piece.append(found[ended])
            alone[at[ended & (width_at[at] == depth)]] = True
        bare = lead[~alone[lead]]
        frm.append(bare)
        to.append(bare + width_at[bare])
        piece.append(np.where(width_at[bare] == 1, self.words.byte_ids[letters[bare]], -1))
        # long pieces first: they are drawn most
        frm, to, piece = (np.concatenate(x[::-1]) for x in (frm, to, piece))
        weight = self.words.log_weight[piece]
        spelt = piece < 0
        weight[spelt] = self.words.log_weight[self.words.byte_ids[0]] * (to - frm)[spelt]
        owner = part[frm]
        reach = to - base[owner]                      # place of the end in its part
        node_from, node_to = frm + owner, to + owner  # one node more than letters per part
        order = np.argsort(node_to, kind="stable")
        order = order[np.argsort(reach[order], kind="stable")]
        node_from, node_to, reach = node_from[order], node_to[order], reach[order]
        piece, weight = piece[order], weight[order]
        heads = np.flatnonzero(np.append(True, node_to[1:] != node_to[:-1]))
        members = np.diff(np.append(heads, len(node_to)))
        head = np.zeros(len(letters) + len(starts), np.int64)
        head[node_to[heads]] = heads
        total = np.zeros(len(letters) + len(starts))
        share = np.empty(len(node_to))
        cuts = np.flatnonzero(np.append(True, reach[1:] != reach[:-1]))
        head_cuts = np.searchsorted(heads, np.append(cuts, len(reach)))
        for low, high, g, h in zip(cuts, np.append(cuts[1:], len(reach)), head_cuts,
                                   head_cuts[1:]):
            local, n = heads[g:h] - low, members[g:h]
            value = total[node_from[low:high]] + weight[low:high]
            top = np.maximum.reduceat(value, local)
            value = np.exp(value - np.repeat(top, n))
            sums = np.add.reduceat(value, local)
            total[node_to[heads[g:h]]] = top + np.log(sums)
            upto = np.cumsum(value)
            before = upto[local] - value[local]
            share[low:high] = (upto - np.repeat(before, n)) / np.repeat(sums, n)
        share[heads + members - 1] = 1.0
        return base + np.arange(len(starts)), lengths, node_from, piece, share, head

    def _sample(self, data, starts, seeds, places, which, lattice):
        root, lengths, node_from, piece, share, head = lattice
        shift = starts - root[which]
        chosen = np.full(len(data) + 1, -1, np.int64)
        node, origin = root[which] + lengths[which], root[which]
        offset = places - root[which]  # from a node to its place in the text
        live = np.arange(len(starts))
        while len(live):
            now = node[live]
            drawn = mix(seeds[live] ^ ((now + offset[live]).astype(np.uint64) * _STEP))
            u = (drawn >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
            edge = head[now]
            later = np.flatnonzero(share[edge] <= u)
            while len(later):
                edge[later] += 1
                later = later[share[edge[later]] <= u[later]]
            chosen[now + shift[live]] = edge
            node[live] = node_from[edge]
            live = live[node[live] > origin[live]]
        ends = np.flatnonzero(chosen >= 0)
        ids = piece[chosen[ends]]
        n = np.ones(len(ids), np.int64)
        spelt = np.flatnonzero(ids < 0)
        widths = np.diff(np.append(0, ends))
        n[spelt] = widths[spelt]
        out = np.repeat(ids, n).astype(np.int32)
        if len(spelt):
            place = np.repeat(ends - widths, n) + np.arange(len(out)) - np.repeat(
                np.cumsum(n) - n, n)
            out[out < 0] = self.words.byte_ids[data[place[out < 0]]]
        upto = np.concatenate([[0], np.cumsum(n)])
        counts = np.diff(upto[np.searchsorted(ends, np.append(starts, len(data)), side="right")])
        return out, counts


def encode(docs, vocabulary, key="doc_id", text="text", seed=SEED):
    """Columns ``row`` (the document's own) and ``out``: ids, one sampled segmentation, and
    lossless, whether they decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def prepare():
        segmenter = Segmenter(shared.value)

        def compute(texts, keys):
            held = [t.encode() if t else b"" for t in texts.to_pylist()]
            ids, counts = segmenter.encode(held, keys.to_numpy())
            offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            same = [segmenter.decode(ids[a:b]) == t
                    for t, a, b in zip(held, offsets, offsets[1:])]
            return [pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(ids, pa.int32()), mask=texts.is_null()), same]

        return compute

    return with_arrow_columns(
        docs, [text, F.xxhash64(F.lit(seed), F.col(f"`{key}`"))],
        "ids array<int>, lossless boolean", prepare)


def decode(coded, vocabulary, ids):
    """Columns ``row`` (the table's own) and ``out.text``, from the column of piece ids."""
    shared = coded.sparkSession.sparkContext.broadcast(vocabulary)

    def prepare():
        segmenter = Segmenter(shared.value)

        def compute(lists):
            values = lists.flatten().to_numpy()
            sizes = pc.list_value_length(lists).to_pylist()
            out, at = [], 0
            for n in sizes:
                if n is None:
                    out.append(None)
                    continue
                out.append(segmenter.decode(values[at:at + n]).decode())
                at += n
            return [out]

        return compute

    return with_arrow_columns(coded, [ids], "text string", prepare)
