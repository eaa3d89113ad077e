"""Sampled segmentations of a SentencePiece vocabulary, and lossless decoding.

A text is a row of words, each a space mark and the characters up to the next space (one
mark is put before the first). No piece crosses a mark, so the lattice of a text is that
of its words. For every distinct word of a slice of documents, forward filtering
adds up the weights of all segmentations of each prefix; backward sampling then draws, for
every occurrence of the word, the last piece, the one before it, and so on, each with
the probability that the filter gives it. The draws are a hash of the row's key, the
word's number and the step, so a row has the same segmentation on every run, whatever
task it is in, and other rows have others.

Pieces weigh ``exp(alpha * score)``. Vocabularies of merges have ranks for scores; there
the score of rank r is taken as -log(2 + r). A character that is no piece, and the space
mark itself if it occurs in a text, is spelt in bytes. Pieces of several marks have no
weight. Decoding joins the bytes of the pieces and drops the first mark: it gives every
text back exactly.

Null and empty texts have no pieces. Rows with a null key are drawn like key 0, repeated
rows alike.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import Lookup, arrow_map, mix, powers, slices, with_bytes

ALPHA = 1.0
SLICE = 2 << 20
_MARK = 0x2581
_LITERAL_MARK = 0x110000  # a mark that stands in the text
_BASE = np.uint64(0x9E3779B97F4A7C13)
_DOWN = np.uint64(pow(0x9E3779B97F4A7C13, -1, 2**64))


class Vocabulary:
    def __init__(self, path: str, alpha: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = {i: model.get_score(i) for i in plain if "▁" not in pieces[i][1:]}
        ranked = min(scores.values()) < -1000
        weights = {i: alpha * (-np.log(2.0 - s) if ranked else s) for i, s in scores.items()}
        self.bytes_first = next(i for i in range(n) if model.is_byte(i))
        self.lowest = min(weights.values())
        self.raw = [b""] * n
        for i in range(n):
            if model.is_byte(i):
                self.raw[i] = bytes([i - self.bytes_first])
            elif i in scores or "▁" in pieces[i]:
                self.raw[i] = pieces[i].replace("▁", " ").encode()
        self.longest = max(len(pieces[i]) for i in weights)
        # by the hash of a string: the piece it is (or -1) and its weight; all starts of pieces are there
        found: dict[int, tuple[int, float]] = {}
        for i, weight in weights.items():
            code = np.array([ord(c) for c in pieces[i]], np.uint64)
            sums = np.cumsum(code * powers(_BASE, len(code)), dtype=np.uint64)
            hashes = mix(sums + np.arange(1, len(code) + 1).astype(np.uint64)).tolist()
            for h in hashes[:-1]:
                found.setdefault(h, (-1, 0.0))
            found[hashes[-1]] = i, weight
        self.hashes = np.array(sorted(found), np.uint64)
        self.piece = np.array([found[h][0] for h in self.hashes.tolist()])
        self.weight = np.array([found[h][1] for h in self.hashes.tolist()])
        self.places = Lookup(self.hashes, np.arange(len(self.hashes)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))[1:]


@lru_cache(maxsize=2)
def vocabulary(path: str, alpha: float = ALPHA) -> Vocabulary:
    return Vocabulary(path, alpha)


class Lattice:
    """Edges of the lattices of words, sorted by the node they enter, with their cumulated probability there.

    Nodes lie by layers: first those before all words, then those after one character, and so on; in a layer, longer words
    come first. So the node after p characters of word w is ``layer[p] + rank[w]``, and a layer's nodes and edges lie together.
    """

    def __init__(self, vocab: Vocabulary, code: np.ndarray, begin: np.ndarray, length: np.ndarray):
        """Word w is ``code[begin[w] : begin[w] + length[w]]``, and nothing lies between words."""
        n = len(begin)
        by_length = np.argsort(-length, kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[by_length] = np.arange(n)
        reach = np.searchsorted(-length[by_length], -np.arange(int(length.max(initial=0)) + 1), side="right")
        self.layer = np.append(0, np.cumsum(reach))
        place = np.repeat(self.rank, length)
        inside = np.arange(len(code)) - np.repeat(begin, length)
        spot = self.layer[inside] + place  # the node before each character
        left = np.repeat(begin + length, length) - np.arange(len(code))
        up = powers(_BASE, len(code) + 1)
        sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * up[:-1], dtype=np.uint64, out=sums[1:])
        down = powers(_DOWN, len(code) + 1)
        active = np.arange(len(code))
        source, target, piece, weight = [], [], [], []
        single = np.zeros(len(code), bool)
        for size in range(1, vocab.longest + 1):
            active = active[left[active] >= size]
            if not len(active):
                break
            h = mix((sums[active + size] - sums[active]) * down[active] + np.uint64(size))
            at = vocab.places.get(h)
            hit = at >= 0
            active, at = active[hit], at[hit]
            whole = vocab.piece[at] >= 0
            chosen, at = active[whole], at[whole]
            if size == 1:
                single[chosen] = True
            source.append(spot[chosen])
            target.append(self.layer[inside[chosen] + size] + place[chosen])
            piece.append(vocab.piece[at])
            weight.append(vocab.weight[at])
        spelt = np.flatnonzero(~single)
        own = code[spelt].astype(np.int64)
        source.append(spot[spelt])
        target.append(self.layer[inside[spelt] + 1] + place[spelt])
        piece.append(np.where(own < 128, vocab.bytes_first + own, -own))
        weight.append(np.full(len(spelt), vocab.lowest - 1))
        number = np.zeros(int(self.layer[-1]), np.int64)
        for nodes in target:  # edges of one size enter a node each
            number[nodes] += 1
        self.first = np.append(0, np.cumsum(number))
        edges = int(self.first[-1])
        self.source, self.piece, weights = np.empty(edges, np.int64), np.empty(edges, np.int64), np.empty(edges)
        free = self.first[:-1].copy()
        for nodes, *values in zip(target, source, piece, weight):
            at = free[nodes]
            self.source[at], self.piece[at], weights[at] = values
            free[nodes] += 1
        self._filter(np.repeat(np.arange(len(number)), number), weights)

    def _filter(self, target: np.ndarray, weight: np.ndarray) -> None:
        total = np.zeros(len(self.first) - 1)
        log = np.zeros(len(target))
        for low, high in zip(self.layer[1:-1].tolist(), self.layer[2:].tolist()):
            own = slice(int(self.first[low]), int(self.first[high]))
            offset, n = self.first[low:high] - own.start, np.diff(self.first[low : high + 1])
            value = total[self.source[own]] + weight[own]
            most = np.maximum.reduceat(value, offset)
            total[low:high] = most + np.log(np.add.reduceat(np.exp(value - np.repeat(most, n)), offset))
            log[own] = value - np.repeat(total[low:high], n)
        share = np.exp(log)
        sums = np.cumsum(share)
        before = np.concatenate([[0.0], sums])[self.first[target]]
        self.bar = target + np.minimum(sums - before, 1.0)  # rises over all edges
        self.bar[self.first[target + 1] - 1] = target[self.first[target + 1] - 1] + 1.0

    def draw(self, word: np.ndarray, length: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of occurrences of words, one after the other, and their number for each."""
        at = self.layer[length[word]] + self.rank[word]
        alive = np.arange(len(word))
        steps = []
        count = np.zeros(len(word), np.int64)
        step = 0
        while len(alive):
            bits = mix(key[alive] + np.uint64(step * 0xD1B54A32D192ED03 % 2**64))
            u = (bits >> np.uint64(12)).astype(np.float64) / 2.0**52
            node = at[alive]
            edge = np.searchsorted(self.bar, node + u, side="right")
            edge = np.clip(edge, self.first[node], self.first[node + 1] - 1)
            steps.append((alive, self.piece[edge]))
            count[alive] += 1
            at[alive] = self.source[edge]
            alive = alive[at[alive] >= len(self.rank)]
            step += 1
        end = np.cumsum(count)
        out = np.zeros(int(end[-1]) if len(end) else 0, np.int64)
        for s, (who, piece) in enumerate(steps):
            out[end[who] - 1 - s] = piece
        return out, count


def sample(texts: list[str], keys: np.ndarray, vocab: Vocabulary, seed: int) -> list[np.ndarray]:
    """Ids of each text."""
    flat = np.frombuffer("".join(" " + t for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + 1 for t in texts])
    mark = flat == 32
    code = np.where(mark, np.uint64(_MARK), np.where(flat == _MARK, np.uint64(_LITERAL_MARK), flat))
    mark[(np.cumsum(size) - size)[size > 0]] = True
    begin = np.flatnonzero(mark)
    length = np.diff(np.append(begin, len(code)))
    owner = np.repeat(np.arange(len(texts)), size)[begin]
    first = np.searchsorted(owner, np.arange(len(texts) + 1))
    up, down = powers(_BASE, len(code) + 1), powers(_DOWN, len(code) + 1)
    sums = np.zeros(len(code) + 1, np.uint64)
    np.cumsum(code * up[:-1], dtype=np.uint64, out=sums[1:])
    h = mix((sums[begin + length] - sums[begin]) * down[begin] + length.astype(np.uint64))
    _, index, word = np.unique(h, return_index=True, return_inverse=True)
    lengths = length[index]
    offset = np.cumsum(lengths) - lengths
    own = np.repeat(begin[index] - offset, lengths) + np.arange(int(lengths.sum()))
    lattice = Lattice(vocab, code[own], offset, lengths)
    number = np.arange(len(begin)) - first[owner]
    key = mix(mix(keys.astype(np.uint64) + np.uint64(seed))[owner] + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(word, kind="stable")
    drawn, count = lattice.draw(word[order], lengths, key[order])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    starts = (np.cumsum(count) - count)[place]
    count = count[place]
    end = np.cumsum(count)
    pieces = drawn[np.repeat(starts - (end - count), count) + np.arange(int(count.sum()))]
    cuts = np.concatenate([[0], end])[first]
    out = []
    for i, text in enumerate(texts):
        ids = pieces[cuts[i] : cuts[i + 1]] if text else pieces[:0]
        if len(ids) and ids.min() < 0:
            spelt: list[int] = []
            for x in ids.tolist():
                if x >= 0:
                    spelt.append(x)
                else:
                    spelt += [vocab.bytes_first + b for b in chr(_MARK if -x == _LITERAL_MARK else -x).encode("utf-8", "surrogatepass")]
            ids = np.array(spelt)
        out.append(ids)
    return out


def encode(docs: DataFrame, path: str, seed: int = 0, alpha: float = ALPHA) -> DataFrame:
    """``doc_id, n_pieces, ids`` (little-endian unsigned 16-bit), ``ids_crc32`` and ``lossless``: decoding gave the text back."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        vocab = vocabulary(path, alpha)
        for part in slices(batch, limit=SLICE):
            raw = [t or b"" for t in part.column("text").to_pylist()]
            keys = part.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            found = sample([t.decode() for t in raw], keys.view(np.uint64), vocab, seed)
            ids = [f.astype("<u2").tobytes() for f in found]
            yield {
                "doc_id": part.column("doc_id"),
                "n_pieces": [len(f) for f in found],
                "ids": ids,
                "ids_crc32": [zlib.crc32(x) for x in ids],
                "lossless": [vocab.decode(f.tolist()) == t for f, t in zip(found, raw)],
            }

    if len(vocabulary(path, alpha).raw) > 1 << 16:
        raise ValueError("ids of this vocabulary do not fit into 16 bits")
    return arrow_map(with_bytes(docs, "doc_id"), work, "doc_id long, n_pieces long, ids binary, ids_crc32 long, lossless boolean")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text`` from ``doc_id, ids``; a text that was null comes back empty."""

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        vocab = vocabulary(path)
        texts = [vocab.decode(np.frombuffer(x or b"", "<u2").tolist()).decode() for x in batch.column("ids").to_pylist()]
        yield {"doc_id": batch.column("doc_id"), "text": texts}

    return arrow_map(encoded.select("doc_id", "ids"), work, "doc_id long, text string")
