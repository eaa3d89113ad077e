"""Exact k nearest neighbours of each point of a set, without comparing all pairs."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ranking import hash_sample

FOUND = "key bigint, near bigint, gap double"


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def closest(gaps: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Positions of the k smallest finite gaps of each row; equal gaps go to the smaller id."""
    out = []
    for row in gaps:
        if len(row) > k:
            edge = np.partition(row, k - 1)[k - 1]
            pool = np.flatnonzero(row <= edge)
        else:
            pool = np.arange(len(row))
        pool = pool[np.isfinite(row[pool])]
        out.append(pool[np.lexsort((ids[pool], row[pool]))][:k])
    return out


def _stack(column: pd.Series) -> np.ndarray:
    return np.vstack(column.to_numpy())


def _found(keys, ids, gaps, k) -> pd.DataFrame:
    gaps = np.where(ids[None, :] == np.asarray(keys)[:, None], np.inf, gaps)
    picks = closest(gaps, ids, k)
    return pd.DataFrame(
        {
            "key": np.repeat(np.asarray(keys, dtype=np.int64), [len(p) for p in picks]),
            "near": np.concatenate([ids[p] for p in picks]) if picks else np.zeros(0, dtype=np.int64),
            "gap": np.concatenate([gaps[i][p] for i, p in enumerate(picks)]) if picks else np.zeros(0),
        }
    )


def nearest(points: DataFrame, k: int, max_bytes: int = 256 << 20, block_rows: int = 4096) -> DataFrame:
    """``key, near, gap``: the k nearest other points of each ``key bigint, x array<double>``.

    A set whose matrix fits ``max_bytes`` is broadcast. A larger one is split
    into cells that are searched only as far as the triangle inequality asks.
    """
    width = points.select(F.size("x").alias("w")).first()
    n = points.count()
    if width is None or n * width.w * 8 <= max_bytes:
        return _nearest_shared(points, k)
    return _nearest_in_cells(points, n, k, block_rows)


def _nearest_shared(points: DataFrame, k: int) -> DataFrame:
    table = points.select("key", "x").orderBy("key").toArrow()
    ids = table["key"].to_numpy().astype(np.int64)
    flat = table["x"].combine_chunks().flatten().to_numpy()
    matrix = flat.reshape(len(ids), -1) if len(ids) else np.zeros((0, 1))
    shared = points.sparkSession.sparkContext.broadcast((ids, matrix))

    def run(frames):
        all_ids, all_points = shared.value
        for frame in frames:
            for start in range(0, len(frame), 512):
                part = frame.iloc[start : start + 512]
                yield _found(part["key"].to_numpy(), all_ids, distances(_stack(part["x"]), all_points), k)

    return points.select("key", "x").mapInPandas(run, FOUND)


def _nearest_in_cells(points: DataFrame, n: int, k: int, block_rows: int, pivots: int = 1024) -> DataFrame:
    """Cells around sampled points, blocks of bounded size inside the cells.

    Each point is first compared with its own block. Its k-th gap there bounds
    how far its neighbours can be, so it then visits only blocks of cells that
    reach into that distance: a cell with pivot p and radius r holds nothing
    closer to q than d(q, p) - r. Blocks are read once and visitors stream past
    them, so a task holds one block at a time however many visitors come.
    """
    count = min(pivots, math.ceil(n / block_rows), n)
    sample = points.join(hash_sample(points, "key", count, n), "key", "left_semi").select("x").collect()
    context = points.sparkSession.sparkContext
    centres = context.broadcast(np.array([r.x for r in sample], dtype=float))

    def assign(frames):
        for frame in frames:
            gaps = distances(_stack(frame["x"]), centres.value)
            yield frame[["key", "x"]].assign(cell=gaps.argmin(axis=1).astype("int32"), reach=gaps.min(axis=1))

    placed = materialize(
        points.select("key", "x").mapInPandas(assign, "key bigint, x array<double>, cell int, reach double"), "cells"
    )
    cells = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("reach").alias("radius")).collect()
    blocks = np.zeros(count, dtype=int)
    radius = np.full(count, -np.inf)
    for c in cells:
        blocks[c.cell], radius[c.cell] = math.ceil(c.n / block_rows), c.radius
    per_cell = F.element_at(F.array(*[F.lit(max(int(b), 1)) for b in blocks]), F.col("cell") + 1)
    blocked = placed.withColumn("block", F.pmod(F.xxhash64("key"), per_cell).cast("int"))

    def own_block(frame: pd.DataFrame) -> pd.DataFrame:
        ids = frame["key"].to_numpy()
        matrix = _stack(frame["x"])
        found = _found(ids, ids, distances(matrix, matrix), k)
        lists = found.groupby("key").agg(near=("near", list), gap=("gap", list))
        out = frame[["key", "x", "cell", "block"]].join(lists, on="key")
        out["near"] = [v if isinstance(v, list) else [] for v in out["near"]]
        out["gap"] = [v if isinstance(v, list) else [] for v in out["gap"]]
        return out

    first = materialize(
        blocked.drop("reach").groupBy("cell", "block").applyInPandas(
            own_block, "key bigint, x array<double>, cell int, block int, near array<bigint>, gap array<double>"
        ),
        "own-block",
    )
    slices = max(1, math.ceil(n / 250_000))
    side = "cell int, block int, slice int, visitor int, key bigint, x array<double>, bound double"

    def visits(frames):
        slack = 1e-9
        for frame in frames:
            gaps = distances(_stack(frame["x"]), centres.value)
            bound = np.array([g[-1] if len(g) == k else np.inf for g in frame["gap"]])
            reached = gaps - radius[None, :] <= bound[:, None] * (1 + slack) + slack
            for row, key in enumerate(frame["key"]):
                own = (frame["cell"].iloc[row], frame["block"].iloc[row])
                targets = [(c, b) for c in np.flatnonzero(reached[row]) for b in range(blocks[c]) if (c, b) != own]
                if targets:
                    yield pd.DataFrame(
                        {
                            "cell": np.array([t[0] for t in targets], dtype="int32"),
                            "block": np.array([t[1] for t in targets], dtype="int32"),
                            "slice": np.int32(key % slices),
                            "visitor": np.int32(1),
                            "key": key,
                            "x": [frame["x"].iloc[row]] * len(targets),
                            "bound": bound[row],
                        }
                    )

    hosts = blocked.select(
        "cell", "block", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"),
        F.lit(0).alias("visitor"), "key", "x", F.lit(0.0).alias("bound"),
    )
    guests = first.select("key", "x", "cell", "block", "gap").mapInPandas(visits, side)
    together = hosts.unionByName(guests).repartition("cell", "block", "slice")
    together = together.sortWithinPartitions("cell", "block", "slice", "visitor")

    def meet(frames):
        here, ids, parts = None, None, []
        for frame in frames:
            for place, part in frame.groupby(["cell", "block", "slice"], sort=False):
                if place != here:
                    here, ids, parts = place, np.zeros(0, dtype=np.int64), []
                host = part[part["visitor"] == 0]
                if len(host):
                    ids = np.concatenate([ids, host["key"].to_numpy()])
                    parts.append(_stack(host["x"]))
                guest = part[part["visitor"] == 1]
                if len(guest) and len(ids):
                    if len(parts) > 1:
                        parts = [np.vstack(parts)]
                    gaps = distances(_stack(guest["x"]), parts[0])
                    far = gaps > guest["bound"].to_numpy()[:, None] * (1 + 1e-9) + 1e-9
                    yield _found(guest["key"].to_numpy(), ids, np.where(far, np.inf, gaps), k)

    later = together.mapInPandas(meet, FOUND)
    early = first.select("key", F.explode_outer(F.arrays_zip("near", "gap")).alias("e")).select("key", "e.near", "e.gap")
    every = early.filter("near IS NOT NULL").unionByName(later)
    # At most k rows per visited block and point meet here.
    best = every.groupBy("key").agg(F.slice(F.array_sort(F.collect_list(F.struct("gap", "near"))), 1, k).alias("best"))
    return best.select("key", F.inline("best")).select("key", "near", "gap")
