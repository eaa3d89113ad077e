"""Token ids in blocks, packed by an adaptive context-mixing range coder.

An id is coded as one to nine hexadecimal digits; the ids that a block has most often have the
shortest codes. For each digit three tables predict its 16 values from counts: of the
digits before it in the id (order 0), of these
and the id before (order 1), of these and the two ids before (order 2; both hashed). Mixing
weights say how far each is trusted. They are learnt by expectation maximisation, one set for
each digit and for how much the two higher orders have seen. The mixture drives a
carry-less 64-bit range coder that puts out 16 bits at a time.

A block is cut into lanes of equal length that are coded side by side with one set of
tables, which learn from all lanes after each digit: this is what makes numpy
arrays of the work. Every block starts with fresh tables and carries check sums of its bytes
and of its ids, so any block can be read alone, and a damaged one is noticed.

All arithmetic is on integers, or on single float64 operations and sums in a fixed order,
so the reader repeats the writer's tables exactly.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

LANES = 8192
LEAST_STEPS = 256
#: Ids of a block, unless a single document has more.
BLOCK_IDS = 1 << 21
_MAGIC = b"IDCM"
_HEAD = struct.Struct("<4sIIIIIQ")
_SCALE = 65520  # with one more for each of 16 values: 65536
_FULL = 4000
_ROWS0, _ROWS1, _ROWS2 = 1 << 14, 1 << 15, 1 << 16
_A, _B, _C, _D = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))


#: Ids by their rank in a block: the first digit alone, with one more, with two more. Others: the last value, then all digits.
SHORT, MIDDLE, LONG = 4, 7, 4
_RANKED = SHORT + MIDDLE * 16 + LONG * 256


class Codes:
    """Digits of ids. ``frequent`` are the ids with codes by rank, the most frequent first."""

    def __init__(self, frequent: np.ndarray, digits: int):
        self.frequent, self.digits = frequent.astype(np.uint64), digits
        rank = np.arange(len(frequent))
        middle, long = rank - SHORT, rank - SHORT - MIDDLE * 16
        self.length = np.where(rank < SHORT, 1, np.where(middle < MIDDLE * 16, 2, 3))
        self.code = np.where(rank < SHORT, rank, np.where(middle < MIDDLE * 16, (SHORT << 4) + middle, (SHORT + MIDDLE << 8) + long))

    @staticmethod
    def most_frequent(ids: np.ndarray) -> np.ndarray:
        found, count = np.unique(ids, return_counts=True)
        return found[np.argsort(-count, kind="stable")][:_RANKED]

    def of(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes and their number of digits."""
        order = np.argsort(self.frequent)
        at = np.minimum(np.searchsorted(self.frequent[order], ids), max(len(order) - 1, 0))
        if not len(order):
            return ids + (np.uint64(15) << np.uint64(4 * self.digits)), np.full(len(ids), self.digits + 1)
        rank = order[at]
        known = self.frequent[rank] == ids
        escaped = ids + (np.uint64(15) << np.uint64(4 * self.digits))
        return np.where(known, self.code[rank].astype(np.uint64), escaped), np.where(known, self.length[rank], self.digits + 1)

    def more(self, first: np.ndarray) -> np.ndarray:
        """Digits that follow a first one."""
        return np.where(first < SHORT, 0, np.where(first < SHORT + MIDDLE, 1, np.where(first < 15, 2, self.digits)))

    def ids(self, code: np.ndarray, length: np.ndarray) -> np.ndarray:
        low = code.astype(np.int64)
        rank = np.where(length == 1, low, np.where(length == 2, low - (SHORT << 4) + SHORT, low - (SHORT + MIDDLE << 8) + SHORT + MIDDLE * 16))
        escaped = length == self.digits + 1
        plain = code - (np.uint64(15) << np.uint64(4 * self.digits))
        if not len(self.frequent):
            return plain
        return np.where(escaped, plain, self.frequent[np.where(escaped, 0, np.minimum(rank, len(self.frequent) - 1))])


class Mixer:
    """Predictions of the next digit for some of the lanes.

    Counts and what is made of them are whole numbers below 2**24, which float32 holds exactly.
    """

    def __init__(self, lanes: int, digits: int):
        self.counts = [np.full((n, 16), float(o == 0), np.float32) for o, n in enumerate((_ROWS0, _ROWS1, _ROWS2))]
        self.weights = np.full(((digits + 1) * 64, 3), 1 / 3)
        self.before = np.zeros(lanes, np.uint64), np.zeros(lanes, np.uint64)
        self.steps = 0

    def start_id(self) -> None:
        one, two = self.before
        self.h1 = (one + np.uint64(1)) * _A
        self.h2 = self.h1 ^ ((two + np.uint64(1)) * _B)

    def end_id(self, ids: np.ndarray) -> None:
        self.before = ids, self.before[0]
        self.steps += 1

    def cumulated(self, digit: int, path: np.ndarray, who: np.ndarray) -> np.ndarray:
        """(17, lanes in ``who``) of 0 .. 65536: where each value's range begins. Lanes lie side by side, as numpy is fast along them."""
        self.lane = np.arange(len(who))
        spot = (path + np.uint64(1)) * _C + np.uint64(digit)
        i0 = ((spot * _D) >> np.uint64(50)).astype(np.int64)
        i1 = (((self.h1[who] + spot) * _D) >> np.uint64(49)).astype(np.int64)
        i2 = (((self.h2[who] + spot) * _D) >> np.uint64(48)).astype(np.int64)
        self.at = i0, i1, i2
        self.rows, self.factor, seen = [], [], []
        for table, i in zip(self.counts, self.at):
            rows = np.ascontiguousarray(table.take(i, axis=0).T)
            total = rows.sum(axis=0)
            big = np.flatnonzero(total > _FULL)
            if len(big):
                halved = np.ceil(rows[:, big] * np.float32(0.5))
                rows[:, big] = halved
                table[i[big]] = halved.T
                total[big] = halved.sum(axis=0)
            self.rows.append(rows)
            self.factor.append(np.floor(np.float32(_SCALE) / np.maximum(total, np.float32(1))))
            seen.append(total)
        level = [_LEVEL.take(s.astype(np.int64)) for s in seen[1:]]
        self.cell = digit * 64 + level[0] * 8 + level[1]
        tables = self.weights[digit * 64 : digit * 64 + 64].copy()
        tables[:8, 1] = 0  # nothing seen
        tables[::8, 2] = 0
        tables = np.floor(tables * (256 / (tables[:, 0] + tables[:, 1] + tables[:, 2]))[:, None]).astype(np.float32)
        tables[:, 0] = 256 - tables[:, 1] - tables[:, 2]
        self.mix = [tables[:, o].take(self.cell - digit * 64) for o in range(3)]
        mixed = self.rows[0] * (self.factor[0] * self.mix[0])
        for o in (1, 2):
            mixed += self.rows[o] * (self.factor[o] * self.mix[o])
        mixed *= np.float32(1 / 256)
        np.floor(mixed, out=mixed)
        mixed += np.float32(1)
        out = np.zeros((17, len(who)), np.float32)
        np.cumsum(mixed[:15], axis=0, out=out[1:16])
        out[16] = 65536
        return out

    def learn(self, value: np.ndarray) -> None:
        if self.steps < 32 or self.steps % 4 == 0:
            given = [rows[value, self.lane] * factor + np.float32(1) for rows, factor in zip(self.rows, self.factor)]
            part = [g.astype(np.float64) * (self.mix[o] + 0.25) for o, g in enumerate(given)]
            whole = part[0] + part[1] + part[2]
            n = np.bincount(self.cell, minlength=len(self.weights))
            hit = np.flatnonzero(n)
            for o in range(3):
                mean = np.bincount(self.cell, part[o] / whole, minlength=len(self.weights))[hit] / n[hit]
                self.weights[hit, o] += (mean - self.weights[hit, o]) * 0.2
        for o, (table, i, more) in enumerate(zip(self.counts, self.at, (2, 6, 12))):
            flat, cell = table.reshape(-1), i * 16 + value
            if o:  # a cell that several lanes hit rises once
                flat[cell] += np.float32(more)
            else:
                np.add.at(flat, cell, np.float32(more))


#: Length in bits of a total, 7 at most.
_LEVEL = np.array([min(n.bit_length(), 7) for n in range(1 << 17)])
_TOP, _BOTTOM, _STEP = np.uint64(1 << 48), np.uint64(1 << 32), np.uint64(16)


def _digits(ids: np.ndarray) -> int:
    return 4 if not len(ids) or int(ids.max()) < 1 << 16 else 8


def _shape(n: int) -> tuple[int, int]:
    lanes = max(1, min(LANES, n // LEAST_STEPS))
    return lanes, -(-n // lanes)


class _Range:
    """State of the range coder of each lane."""

    def __init__(self, lanes: int):
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)

    def narrow(self, who: np.ndarray, begin: np.ndarray, stop: np.ndarray, unit: np.ndarray) -> Iterator[np.ndarray]:
        """Go into a value's range. Yields lanes whose highest 16 bits are settled, before they are shifted out."""
        begin = begin.astype(np.uint64)
        self.low[who] += unit * begin
        self.size[who] = unit * (stop.astype(np.uint64) - begin)
        while len(who):
            low, size = self.low[who], self.size[who]
            same = (low ^ (low + size)) < _TOP
            ready = same | (size < _BOTTOM)
            who, same = who[ready], same[ready]
            if not len(who):
                return
            force = who[~same]
            self.size[force] = (~self.low[force] + np.uint64(1)) & (_BOTTOM - np.uint64(1))
            yield who
            self.low[who] <<= _STEP
            self.size[who] <<= _STEP


def pack_ids(ids: np.ndarray) -> bytes:
    """Unsigned 32-bit ids as one coded block."""
    digits = _digits(ids)
    lanes, steps = _shape(len(ids))
    codes = Codes(Codes.most_frequent(ids), digits)
    grid = np.zeros(lanes * steps, np.uint64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    mixer, coder, every = Mixer(lanes, digits), _Range(lanes), np.arange(lanes)
    words = np.zeros((lanes, steps * (digits + 1) + 8), np.uint16)
    used = np.zeros(lanes, np.int64)
    for own in grid:
        mixer.start_id()
        code, length = codes.of(own)
        who = every
        for d in range(digits + 1):
            mine, left = code[who], (4 * (length[who] - 1 - d)).astype(np.uint64)
            value = ((mine >> left) & np.uint64(15)).astype(np.int64)
            bounds = mixer.cumulated(d, mine >> left >> np.uint64(4), who)
            mixer.learn(value)
            lane = np.arange(len(who))
            for out in coder.narrow(who, bounds[value, lane], bounds[value + 1, lane], coder.size[who] >> np.uint64(16)):
                words[out, used[out]] = (coder.low[out] >> np.uint64(48)).astype(np.uint16)
                used[out] += 1
            who = who[length[who] > d + 1]
            if not len(who):
                break
        mixer.end_id(own)
    for _ in range(4):
        words[every, used] = (coder.low >> np.uint64(48)).astype(np.uint16)
        used += 1
        coder.low <<= _STEP
    body = b"".join(row[:n].tobytes() for row, n in zip(words, used.tolist()))
    names = codes.frequent.astype("<u4")
    return bytes([digits]) + np.array([len(names)], "<u4").tobytes() + names.tobytes() + used.astype("<u4").tobytes() + body


def unpack_ids(data: bytes, n: int) -> np.ndarray:
    digits = data[0]
    lanes, steps = _shape(n)
    known = int(np.frombuffer(data, "<u4", 1, 1)[0])
    codes = Codes(np.frombuffer(data, "<u4", known, 5), digits)
    used = np.frombuffer(data, "<u4", lanes, 5 + 4 * known).astype(np.int64)
    first = 5 + 4 * known + 4 * lanes
    words = np.concatenate([np.frombuffer(data, "<u2", int(used.sum()), first), np.zeros(8, np.uint16)]).astype(np.uint64)
    at = np.cumsum(used) - used
    mixer, coder, every = Mixer(lanes, digits), _Range(lanes), np.arange(lanes)
    seen = np.zeros(lanes, np.uint64)
    for _ in range(4):
        seen = (seen << _STEP) | words[at]
        at = at + 1
    grid = np.zeros((steps, lanes), np.uint32)
    for s in range(steps):
        mixer.start_id()
        code, length, who = np.zeros(lanes, np.uint64), np.ones(lanes, np.int64), every
        for d in range(digits + 1):
            bounds = mixer.cumulated(d, code[who], who)
            unit = coder.size[who] >> np.uint64(16)
            mark = np.minimum((seen[who] - coder.low[who]) // unit, np.uint64(65535)).astype(np.float32)
            value, lane = np.zeros(len(who), np.int64), np.arange(len(who))
            for half in (8, 4, 2, 1):
                value += half * (bounds[value + half, lane] <= mark)
            mixer.learn(value)
            for out in coder.narrow(who, bounds[value, lane], bounds[value + 1, lane], unit):
                seen[out] = (seen[out] << _STEP) | words[at[out]]
                at[out] += 1
            code[who] = (code[who] << np.uint64(4)) | value.astype(np.uint64)
            if not d:
                length = 1 + codes.more(value)
            who = who[length[who] > d + 1]
            if not len(who):
                break
        own = codes.ids(code, length)
        mixer.end_id(own)
        grid[s] = own
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def write_block(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, before: int) -> bytes:
    """A block: the ids of whole documents, in their order. ``before``: ids of the same file before it."""
    known = np.array([d is not None for d in doc_ids], np.uint8)
    named = np.array([d or 0 for d in doc_ids], "<i8")
    table = zlib.compress(known.tobytes() + named.tobytes() + np.array(counts, "<u4").tobytes(), 1)
    body = table + pack_ids(ids)
    plain = zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())
    return _HEAD.pack(_MAGIC, len(doc_ids), len(ids), len(table), plain, zlib.crc32(body), before) + body


def read_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """(doc ids, ids of each, all ids, ids of the file before it); fails if a check sum does not fit."""
    magic, docs, n, table, plain, whole, before = _HEAD.unpack_from(block)
    body = block[_HEAD.size :]
    if magic != _MAGIC or zlib.crc32(body) != whole:
        raise ValueError("damaged block")
    raw = zlib.decompress(body[:table])
    known, named = raw[:docs], np.frombuffer(raw, "<i8", docs, docs)
    counts = np.frombuffer(raw, "<u4", docs, 9 * docs)
    ids = unpack_ids(body[table:], n)
    if zlib.crc32(ids.astype("<u4").tobytes()) != plain:
        raise ValueError("block does not decode to what was written")
    return [int(d) if k else None for d, k in zip(named, known)], counts.astype(np.int64), ids, before
