"""Best-fit packing of token sequences by a linear grouping scheme.

Documents are tokenised where they lie and cut into pieces of at most ``capacity``
tokens. What the packing needs to know of the corpus is the number of pieces of each
length: a table of at most ``capacity`` rows, whatever the corpus. From it the driver
makes a plan:

1. Lengths above ``capacity / LARGE`` are sorted and dealt into ``GROUPS`` groups of
   equal cardinality; within a group all count as long as its longest.
2. Configurations of these few sizes that fill a sequence are found by column
   generation, and the linear programme says how many sequences follow each; ``SHARE`` of them are opened.
3. The actual lengths take the places of the rounded ones.
4. Pieces that are left, the longest first and then the small ones, go where they fit best.

The plan says of runs of equally long pieces to which runs of sequences they go, so
its size depends on the capacity and not on the corpus. Pieces are then numbered
within their length (counts per partition and length, added up) and look up their place.
Nothing else than counts leaves the executors, and no length is dealt to one task.

A null or empty text is a document of its end id alone. Every row is packed, also
repeated ones and those with a null id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batch_map, slices, stored
from .tokens import tokenizer_path, word_encoder

CAPACITY = 2048
LARGE = 4
GROUPS = 32
#: Part of the programme's sequences that is opened. The rest of the large pieces is left to fill, at its actual lengths,
#: what rounding has left free in the sequences opened.
SHARE = 0.75
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def pieces(docs: DataFrame, path: str, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Documents as pieces of at most ``capacity`` tokens.

    ``part`` and ``place`` number the pieces of each length within a partition of
    ``docs``. Where the caller coalesces the result, one task runs through several of
    these, so ``part`` is a column from below and not the task's number.
    ``keep_ids`` adds the ids, little-endian unsigned 32-bit.
    """
    end = np.array([end_id], "<u4").tobytes()
    schema = _PIECES + (", ids binary" if keep_ids else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        seen = [0] * (capacity + 1)
        for batch in (part for whole in batches for part in slices(whole)):
            rows = []
            for doc_id, text, part in zip(*(batch.column(i).to_pylist() for i in range(3))):
                ids = encoder.encode(text or "") + end
                for i, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    n = len(own) // 4
                    rows.append((doc_id, i, at // 4, n, zlib.crc32(own), part, seen[n], own)[: 7 + keep_ids])
                    seen[n] += 1
            columns = list(zip(*rows)) or [()] * (7 + keep_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)],
                names=[c.split()[0] for c in schema.split(", ")],
            )

    return batch_map(docs.select("doc_id", "text", F.spark_partition_id().alias("part")), run, schema)


def configurations(sizes: np.ndarray, wanted: np.ndarray, capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Ways to fill a sequence with the given sizes, and how many sequences should follow each.

    Solves the linear programme over all configurations by column generation: a
    knapsack over the sizes, valued by the current duals, yields the next column.
    """
    n = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    reach = np.arange(capacity + 1)[:, None] - sizes[None, :]
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        dual = inverse.sum(axis=0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        low = int(sizes.min())
        for c in range(low, capacity + 1):
            fits = reach[c] >= 0
            value = np.where(fits, best[np.maximum(reach[c], 0)] + dual, -1.0)
            i = int(value.argmax())
            if value[i] > best[c - 1]:
                best[c], pick[c] = value[i], i
            else:
                best[c], pick[c] = best[c - 1], -1
        if best[capacity] <= 1 + 1e-4:
            break
        column, c = np.zeros(n), capacity
        while c >= low:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        share, step = inverse @ wanted, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(share, 0) / np.where(step > 1e-9, step, 1), np.inf)
        if not np.isfinite(ratio.min()):
            break
        basis[:, int(ratio.argmin())] = column
    share = np.linalg.solve(basis, wanted)
    return [(basis[:, i].astype(int), max(0.0, float(share[i]))) for i in range(n)]


class Plan:
    """Runs of equally long pieces and the sequences they go to.

    A step (length, rank, count, sequence, each, offset) sends the pieces of that
    length numbered from ``rank`` to sequences from ``sequence`` on, ``each`` per
    sequence, the first at ``offset``.
    """

    def __init__(self, counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: int = LARGE, share: float = SHARE):
        self.capacity, self.sequences = capacity, 0
        self.left = {length: n for length, n in counts.items() if n}
        self.taken = dict.fromkeys(self.left, 0)
        self.steps: list[tuple[int, int, int, int, int, int]] = []
        self.room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by free tokens: (sequence, count)
        self._group(groups, capacity // large, share)
        for length in sorted(self.left, reverse=True):
            self._best_fit(length)

    def _open(self, n: int) -> int:
        self.sequences += n
        return self.sequences - n

    def _place(self, length: int, n: int, sequence: int, each: int, offset: int) -> None:
        self.steps.append((length, self.taken[length], n, sequence, each, offset))
        self.taken[length] += n
        self.left[length] -= n

    def _group(self, groups: int, above: int, part: float) -> None:
        lengths = sorted((x for x in self.left if above < x < self.capacity), reverse=True)
        total = sum(self.left[x] for x in lengths)
        groups = min(groups, len(lengths), total)
        if not groups:
            return
        cuts = [total * (i + 1) // groups for i in range(groups)]
        queues: list[list[list[int]]] = [[] for _ in range(groups)]  # of each group: [length, count], the longest first
        g = passed = 0
        for length in lengths:
            n = self.left[length]
            while n:
                while passed >= cuts[g]:
                    g += 1
                take = min(n, cuts[g] - passed)
                queues[g].append([length, take])
                passed, n = passed + take, n - take
        queues = [q for q in queues if q]
        sizes = np.array([q[0][0] for q in queues])
        wanted = np.array([sum(n for _, n in q) for q in queues], float)
        for column, share in configurations(sizes, wanted, self.capacity):
            if n := int(part * share):
                self._substitute(column, n, queues)

    def _substitute(self, column: np.ndarray, n: int, queues: list[list[list[int]]]) -> None:
        """Open ``n`` sequences of a configuration and put actual lengths into its places.

        Its smallest place stays open if it has more than one: what fits best there
        is found among the actual lengths, which wastes less than a rounded one.
        """
        runs = [(self._open(n), n, 0)]
        places = [g for g in np.flatnonzero(column) for _ in range(column[g])]
        for g in places[: len(places) - 1 or 1]:
            filled, queue = [], queues[g]
            for sequence, count, used in runs:
                while count and queue:
                    length, there = queue[0]
                    take = min(count, there)
                    self._place(length, take, sequence, 1, used)
                    filled.append((sequence, take, used + length))
                    sequence, count = sequence + take, count - take
                    queue[0][1] -= take
                    if not queue[0][1]:
                        queue.pop(0)
                if count:
                    filled.append((sequence, count, used))
            runs = filled
        for sequence, count, used in runs:
            self.room[self.capacity - used].append((sequence, count))

    def _best_fit(self, length: int) -> None:
        """All pieces of a length, one after the other, each where it leaves least free."""
        free = length
        while n := self.left[length]:
            while free <= self.capacity and not self.room[free]:
                free += 1
            if free > self.capacity:
                each = self.capacity // length
                count = -(-n // each)
                free = self.capacity
                self.room[free].append((self._open(count), count))
            sequence, count = self.room[free].pop()
            each, offset = free // length, self.capacity - free
            full = min(count, n // each)
            if full:
                self._place(length, full * each, sequence, each, offset)
                self.room[free - each * length].append((sequence, full))
            sequence, count, rest = sequence + full, count - full, n - full * each
            if count and rest:  # fewer than fill one more
                self._place(length, rest, sequence, rest, offset)
                self.room[free - rest * length].append((sequence, 1))
                sequence, count = sequence + 1, count - 1
            if count:
                self.room[free].append((sequence, count))

    def arrays(self) -> tuple[np.ndarray, ...]:
        """The steps in the order of (length, rank), as columns."""
        return tuple(np.array(sorted(self.steps), np.int64).reshape(-1, 6).T)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``. ``cut`` is a stored table of pieces, as it is read twice."""
    spark = cut.sparkSession
    each = stored(cut.groupBy("part", "length").agg(F.count("*").alias("n")), "lengths")
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    steps = spark.sparkContext.broadcast(Plan(counts, capacity).arrays())
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranks = each.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rank_from"))
    ranked = cut.join(ranks, ["part", "length"]).withColumn("rank", F.col("rank_from") + F.col("place"))
    kept = [c for c in cut.columns if c not in ("part", "place")]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks_, _, sequence, per, offset = steps.value
        key = lengths << 44 | ranks_
        for batch in batches:
            length = batch.column("length").to_numpy().astype(np.int64)
            rank = batch.column("rank").to_numpy().astype(np.int64)
            i = np.searchsorted(key, length << 44 | rank, side="right") - 1
            ahead = rank - ranks_[i]
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(sequence[i] + ahead // per[i]), pa.array(offset[i] + ahead % per[i] * length)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "sequence_id", "offset"])

    return batch_map(ranked.select(*kept, "rank"), run, f"{schema}, sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """Whole documents packed into as few sequences as the scheme finds."""
    cut = pieces(docs, path or tokenizer_path("word_bpe_49k.json"), end_id, capacity, keep_ids)
    return pack(stored(cut, "pieces"), capacity)
