"""Hard negatives by segment summaries.

Of each vector the mean and the deviation of its segments are kept, at two levels: a few long
segments, and each of these in four. For a segment of m components with means p, q and deviations s, t (roots of the mean
squared distance from the mean), the inner product is m * p * q and a rest between -m * s * t and
m * s * t. Added up over segments this bounds a score from both sides. An anchor's candidates are refined level by level:
those whose upper bound is below every score that is still wanted, or whose lower bound is above, are dropped,
and only what stays is scored exactly.

Anchors come in waves of at most ``WAVE`` vectors, however many there are; a wave is sent to
all executors, which its size bounds, and candidates are read where they lie. First every wave finds the
positives of its anchors: best rows of the same label. Their scores are the edges of the second
search: for each positive, the best rows of other labels with a score between
a share of the positive's and the positive's. A task hands on at most k rows for each anchor and
positive, and a ranking by these merges the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .whole import Matrix, checked, clipped, rows_by_length, sound

WAVE = 20_000
BLOCK = 4096
TILE = 256
#: Segments of a vector at the first level; each is cut in FINER at the next.
SEGMENTS = 4
FINER = 4
#: Bounds are widened by this share of the vectors' lengths for what float64 rounds.
SLACK = 1e-9
_FOUND = "anchor_id long, place int, row_id long, score long, fits boolean"


class Summary:
    """Means and deviations of segments: ``both @ other.both.T`` is the upper bound of scores, with ``lower`` the lower one."""

    def __init__(self, vectors: np.ndarray, segments: int):
        parts = [p for p in np.array_split(np.arange(vectors.shape[1]), max(1, segments)) if len(p)]
        root = np.array([np.sqrt(len(p)) for p in parts])
        n = len(vectors)
        mean = np.stack([vectors[:, p].mean(axis=1) for p in parts], 1) if parts else np.zeros((n, 0))
        off = np.stack([vectors[:, p].std(axis=1) for p in parts], 1) if parts else np.zeros((n, 0))
        self.both = np.concatenate([mean * root, off * root], 1)
        self.lower = np.concatenate([mean * root, -off * root], 1)


def _float(score: float) -> float:
    return float(min(max(score, -1e300), 1e300)) if abs(score) < float("inf") else score


class Wanted:
    """What one anchor still looks for: for each place a range of scores and the best rows in it so far."""

    def __init__(self, low: list[float], high: list[float] | None, k: int):
        self.low, self.high, self.k = low, high, k
        self.found: list[list[tuple[int, int]]] = [[] for _ in low]  # (-score, row)

    def edges(self) -> tuple[float, float]:
        """No row below the first or above the second of these scores is of use."""
        least = [max(low, -f[-1][0]) if len(f) == self.k else low for low, f in zip(self.low, self.found)]
        return _float(min(least)), _float(max(self.high)) if self.high else np.inf

    def offer(self, scores: list[int], rows: list[int]) -> None:
        for j, low in enumerate(self.low):
            high = None if self.high is None else self.high[j]
            last = self.found[j][-1] if len(self.found[j]) == self.k else None
            new = [(-s, r) for s, r in zip(scores, rows) if s >= low and (high is None or s <= high) and (last is None or (-s, r) < last)]
            if new:
                self.found[j] = sorted(self.found[j] + new)[: self.k]


class Search:
    """One task's search for a wave of anchors of one length."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray, scale: int, same: bool, wanted: list[Wanted | None]):
        self.ids, self.labels, self.same, self.wanted = ids, labels, same, wanted
        self.vectors = Matrix(raw, scale)
        self.scale = scale
        self.levels = [Summary(self.vectors.plain, s) for s in (SEGMENTS, SEGMENTS * FINER)]
        self.norm = np.sqrt((self.vectors.plain**2).sum(axis=1))

    def block(self, ids: np.ndarray, labels: np.ndarray, raw: np.ndarray) -> None:
        block = Matrix(raw, self.scale)
        levels = [Summary(block.plain, s) for s in (SEGMENTS, SEGMENTS * FINER)]
        norm = np.sqrt((block.plain**2).sum(axis=1))
        big = np.zeros(len(ids), bool)
        big[list(block.large)] = True
        for at in range(0, len(self.ids), TILE):
            stop = min(at + TILE, len(self.ids))
            upper = self.levels[0].both[at:stop] @ levels[0].both.T
            lower = self.levels[0].both[at:stop] @ levels[0].lower.T
            for a in range(at, stop):
                if self.wanted[a] is None:
                    continue
                fits = (labels == self.labels[a]) == self.same
                fits &= ids != self.ids[a]
                if a in self.vectors.large:
                    self._slowly(a, np.flatnonzero(fits), block, ids)
                    continue
                self._slowly(a, np.flatnonzero(fits & big), block, ids)
                low, high = self.wanted[a].edges()
                slack = SLACK * self.norm[a] * norm + 1e-6
                stay = np.flatnonzero(fits & ~big & (upper[a - at] + slack >= low) & (lower[a - at] - slack <= high))
                if len(stay):
                    mine = self.levels[1].both[a]
                    may = (levels[1].both[stay] @ mine + slack[stay] >= low) & (levels[1].lower[stay] @ mine - slack[stay] <= high)
                    stay = stay[may]
                if len(stay):
                    self._offer(a, np.rint(block.plain[stay] @ self.vectors.plain[a]).astype(np.int64), ids[stay])

    def _offer(self, a: int, scores: np.ndarray, ids: np.ndarray) -> None:
        """Hands on no more than can be among the best of a place."""
        wanted = self.wanted[a]
        for j, low in enumerate(wanted.low):
            inside = scores >= low
            if wanted.high is not None:
                inside &= scores <= wanted.high[j]
            own, rows = scores[inside], ids[inside]
            if len(own) > wanted.k:
                least = np.partition(own, len(own) - wanted.k)[len(own) - wanted.k]
                best = np.flatnonzero(own >= least)
                best = best[np.lexsort((rows[best], -own[best]))][: wanted.k]
                own, rows = own[best], rows[best]
            if len(own):
                single = Wanted([low], None if wanted.high is None else [wanted.high[j]], wanted.k)
                single.found = [wanted.found[j]]
                single.offer(own.tolist(), rows.tolist())
                wanted.found[j] = single.found[0]

    def _slowly(self, a: int, rows: np.ndarray, block: Matrix, ids: np.ndarray) -> None:
        if len(rows):
            self.wanted[a].offer(self.vectors.exact(a, block, rows).tolist(), ids[rows].tolist())

    def results(self) -> Iterator[tuple]:
        for a, wanted in zip(self.ids.tolist(), self.wanted):
            for j, found in enumerate(wanted.found if wanted else []):
                for negative, row in found:
                    yield a, j, row, *clipped(-negative)


def _pass(candidates: DataFrame, wave, scale: int, same: bool, k: int) -> DataFrame:
    """What each task finds for a broadcast wave: by length of vector ``(ids, labels, raw, ranges)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = {}
        for dims, (ids, labels, raw, ranges) in wave.value.items():
            searches[dims] = Search(ids, labels, raw, scale, same, [Wanted(*r, k) if r else None for r in ranges])
        for batch in batches:
            ids, labels = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy()
            for dims, rows, raw in rows_by_length(batch, "vector"):
                for at in range(0, len(rows) if dims in searches else 0, BLOCK):
                    part = rows[at : at + BLOCK]
                    searches[dims].block(ids[part], labels[part], raw[at : at + BLOCK])
        for search in searches.values():
            found = list(search.results())
            columns = list(zip(*found)) if found else [()] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["anchor_id", "place", "row_id", "score", "fits"])

    return candidates.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "row_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.withColumn("score", checked("score", "fits")).drop("fits")


def mine(
    vectors: DataFrame, is_anchor: Column, label: Column | None = None, n_positives: int = 5, n_negatives: int = 5,
    percent: int = 80, scale: int = 256, wave_size: int = WAVE,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for each anchor and positive.

    ``vectors`` has ``vec_id``, ``embedding`` and, unless given as a column expression, ``label``; other columns are
    not looked at. Rows with a null id, label or vector, or a null or non-finite component, take no part; nor do vectors
    of another length than the anchor's, for this anchor. Ties go to the smaller id. A repeated row is a candidate each time; an
    anchor is asked once for each id (its smallest label, then vector), and no row with its id is its candidate.
    Negatives have at least ``percent`` of the positive's score and at most all of it, so a positive with a negative score has none.
    An empty table, one without anchors, or one with a single label gives an empty result. A score of the
    result that is no 64-bit integer fails the job; others of any size are compared exactly.
    """
    spark = vectors.sparkSession
    ready = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), (F.col("label") if label is None else label).cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"),
    )
    ready = stored(ready.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & sound(F.col("vector"))), "vectors", coalesce=False)
    chosen = ready.where("anchor").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("own"))
    chosen = stored(chosen.select("vec_id", "own.label", "own.vector"), "anchors")
    waves = max(1, -(-chosen.count() // wave_size))
    results = []
    for w in range(waves):
        own: dict[int, list] = {}
        for r in chosen.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).collect():  # a wave: bounded
            own.setdefault(len(r["vector"]), []).append(r)
        wave = {
            dims: (np.array([r["vec_id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), np.array([r["vector"] for r in rows], np.float64).reshape(len(rows), dims))
            for dims, rows in own.items()
        }
        first = spark.sparkContext.broadcast({d: (*v, [([float("-inf")], None)] * len(v[0])) for d, v in wave.items()})
        positives = _best(_pass(ready, first, scale, True, n_positives), n_positives)
        positives = stored(positives.select("anchor_id", "rank", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
        edges: dict[int, dict[int, int]] = {}
        for r in positives.collect():  # at most n_positives for each anchor of the wave
            edges.setdefault(r["anchor_id"], {})[r["rank"]] = r["positive_score"]
        ranges = {a: ([-(-percent * p[i] // 100) for i in sorted(p)], [p[i] for i in sorted(p)]) for a, p in edges.items() if max(p.values()) >= 0}
        second = spark.sparkContext.broadcast({d: (*v, [ranges.get(a) for a in v[0].tolist()]) for d, v in wave.items()})
        negatives = _best(_pass(ready, second, scale, False, n_negatives), n_negatives)
        negatives = negatives.select("anchor_id", (F.col("place") + 1).alias("place"), "rank", F.col("row_id").alias("negative_id"), F.col("score").alias("negative_score"))
        both = negatives.join(positives.withColumnRenamed("rank", "place"), ["anchor_id", "place"])
        results.append(stored(both, "negatives") if waves > 1 else both)
    out = results[0]
    for other in results[1:]:
        out = out.union(other)
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
