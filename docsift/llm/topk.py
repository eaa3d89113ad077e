"""Exact top-k search by inner product: columnar branch and bound.

Queries come in waves of about ``WAVE`` vectors, whatever their number. A wave is sent
to all executors (its size is bounded by that) and the candidates are passed over
where they lie, in blocks in vertical layout: a row for each dimension.

For a block, inner products are accumulated some dimensions at a time, the dimensions
with the most mass first. By Cauchy and Schwarz, what the remaining dimensions add is
at most the product of the remaining norms of query and candidate. Candidates that
cannot reach the query's bound any more are dropped, and the block is compacted once
half of them have gone. The bound of a query is the k-th best score of a sample of
candidates at first, and rises with what the task has found. A task hands on
at most k candidates for each query, and a ranking by query merges the tasks.

Components are whole numbers, so scores are exact: sums are taken in float64 while they
are below 2**53, and of Python integers for vectors with larger components (see ``whole``). A
score of the result that is no 64-bit integer fails the job. Only vectors of the same length are
compared. Vectors that are null, or hold a null or non-finite component, and rows with a null id take no part. A
repeated row is a candidate each time; a query is asked once for each id, and no row with its id is its candidate. Ties go
to the smaller id. An empty table gives an empty result.
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
BLOCK = 8192
TILE = 256
STEP = 16
SAMPLE = 4096
_FOUND = "query_id long, vec_id long, score long, fits boolean"


class Searcher:
    """Top k of a wave of queries over the blocks that a task passes it."""

    def __init__(self, ids: np.ndarray, raw: np.ndarray, k: int, scale: int, bounds: np.ndarray | None = None):
        self.ids, self.k, self.scale = ids, k, scale
        self.whole = Matrix(raw, scale)
        self.queries = self.whole.plain
        self.bounds = np.full(len(ids), -np.inf) if bounds is None else bounds.astype(np.float64)
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)

    def block(self, ids: np.ndarray, raw: np.ndarray) -> None:
        """``raw`` has a row for each candidate. Large vectors, as queries or candidates, are compared one by one."""
        block = Matrix(raw, self.scale)
        large = np.zeros(len(ids), bool)
        large[list(block.large)] = True
        for q in range(len(self.ids)):
            slow = np.arange(len(ids)) if q in self.whole.large else np.flatnonzero(large)
            if len(slow):
                self._merge(q, ids[slow], self.whole.exact(q, block, slow))
        self._plain(ids[~large], np.ascontiguousarray(block.plain[~large].T))

    def _plain(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """``vectors`` has a column for each candidate."""
        dims = len(vectors)
        order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=1), kind="stable")
        columns = np.ascontiguousarray(vectors[order], np.float64)
        cuts = [*range(0, dims, STEP), dims]
        mass = [np.sqrt((columns[c:] ** 2).sum(axis=0)) for c in cuts]
        where = {}
        for i, x in enumerate(ids.tolist()):
            where.setdefault(x, []).append(i)
        for at in range(0, len(self.ids), TILE):
            tile = self.queries[at : at + TILE][:, order]
            rest = [np.sqrt((tile[:, c:] ** 2).sum(axis=1)) for c in cuts]
            head = tile[:, : cuts[1]] @ columns[: cuts[1]] if dims else np.zeros((len(tile), len(ids)))
            for j in range(len(tile)):
                if at + j in self.whole.large:
                    continue
                own = where.get(int(self.ids[at + j]))
                self._search(at + j, tile[j], head[j], ids, columns, cuts, mass, [r[j] for r in rest], own)

    def _search(self, q, query, score, ids, columns, cuts, mass, rest, own) -> None:
        bound, left, base = self.bounds[q], None, 0  # left: the candidates that stay after compaction
        for b in range(1, len(cuts)):
            if b > 1:
                part = columns[cuts[b - 1] - base : cuts[b] - base]
                score = score + query[cuts[b - 1] : cuts[b]] @ part
            may = score + rest[b] * (mass[b] if left is None else mass[b][left]) * (1 + 1e-12) + 1e-6 >= bound
            n = int(np.count_nonzero(may))
            if n * 2 <= len(score) or b == len(cuts) - 1:
                stay = np.flatnonzero(may)
                left = stay if left is None else left[stay]
                score = score[stay]
                columns = columns[cuts[b] - base :, stay]
                base = cuts[b]
        if left is None:
            left = np.arange(len(ids))
        if own and len(left):
            stay = ~np.isin(left, own)
            left, score = left[stay], score[stay]
        if len(left):
            self._merge(q, ids[left], np.rint(score).astype(np.int64), True)

    def _merge(self, q: int, ids: np.ndarray, scores: np.ndarray, sifted: bool = False) -> None:
        if not sifted:
            stay = ids != self.ids[q]
            ids, scores = ids[stay], scores[stay]
        ids, scores = np.concatenate([self.found[q][0], ids]), np.concatenate([self.found[q][1], scores])
        if len(ids) > self.k and scores.dtype == object:
            near = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[: self.k])
            ids, scores = ids[near], scores[near]
        elif len(ids) > self.k:
            least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            near = np.flatnonzero(scores >= least)
            near = near[np.lexsort((ids[near], -scores[near]))][: self.k]
            ids, scores = ids[near], scores[near]
        if len(ids) == self.k:
            self.bounds[q] = max(self.bounds[q], float(min(max(int(scores.min()), -(10**300)), 10**300)))
        self.found[q] = ids, scores


def _pass(candidates: DataFrame, wave, k: int, scale: int) -> DataFrame:
    """``query_id, vec_id, score``: what each task hands on. ``wave`` is broadcast: by length (ids, raw, bounds)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = {dims: Searcher(ids, raw, k, scale, bounds.copy()) for dims, (ids, raw, bounds) in wave.value.items()}
        for batch in batches:
            ids = batch.column("vec_id").to_numpy()
            for dims, rows, raw in rows_by_length(batch, "vector"):
                for at in range(0, len(rows) if dims in searchers else 0, BLOCK):
                    searchers[dims].block(ids[rows[at : at + BLOCK]], raw[at : at + BLOCK])
        for s in searchers.values():
            n = [len(f[0]) for f in s.found]
            scores = [clipped(int(x)) for f in s.found for x in f[1].tolist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(s.ids, n)), pa.array(np.concatenate([f[0] for f in s.found])),
                 pa.array([x for x, _ in scores], pa.int64()), pa.array([x for _, x in scores], pa.bool_())],
                names=["query_id", "vec_id", "score", "fits"],
            )

    return candidates.mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", checked("score", "fits").alias("score"))


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, wave_size: int = WAVE) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows for each row that ``is_query`` picks.

    ``vectors`` has ``vec_id`` and ``embedding``.
    """
    spark = vectors.sparkSession
    ready = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    ready = stored(ready.where(F.col("vec_id").isNotNull() & sound(F.col("vector"))), "vectors", coalesce=False)
    n = ready.count()
    queries = stored(ready.where(is_query).groupBy("vec_id").agg(F.min("vector").alias("vector")), "queries")
    waves = max(1, -(-queries.count() // wave_size))
    part = F.pmod(F.xxhash64("vec_id", F.lit(5)), F.lit(1 << 20)) < max(1, min(1 << 20, (SAMPLE << 20) // max(n, 1)))
    sample = stored(ready.where(part), "sample")
    results = []
    for w in range(waves):
        by: dict[int, list] = {}
        for r in queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w).collect():
            by.setdefault(len(r["vector"]), []).append((r["vec_id"], r["vector"]))
        wave = {
            dims: (np.array([i for i, _ in rows], np.int64), np.array([v for _, v in rows], np.float64).reshape(len(rows), dims), np.full(len(rows), -np.inf))
            for dims, rows in by.items()
        }
        first = spark.sparkContext.broadcast(wave)
        known = _pass(sample, first, k, scale).where("fits").groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n"))
        least = {r["query_id"]: r["least"] for r in known.where(F.col("n") >= k).collect()}
        for ids, _, bounds in wave.values():
            bounds[:] = [least.get(i, -np.inf) for i in ids.tolist()]
        found = _pass(ready, spark.sparkContext.broadcast(wave), k, scale)
        results.append(stored(_best(found, k), "top") if waves > 1 else _best(found, k))
    out = results[0]
    for other in results[1:]:
        out = out.union(other)
    return out
