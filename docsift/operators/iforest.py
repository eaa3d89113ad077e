"""Isolation forest: trees on small samples, scores in one pass over the rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scoring import anomaly_to_label
from .ranking import quantile

TREE_SCHEMA = "tree int, feature array<int>, threshold array<double>, left array<int>, right array<int>, size array<int>"


def path_length(n) -> np.ndarray:
    """Mean depth of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    out = np.where(n == 2, 1.0, 0.0)
    big = n > 2
    safe = np.where(big, n, 3.0)
    return np.where(big, 2.0 * (np.log(safe - 1.0) + np.euler_gamma) - 2.0 * (safe - 1.0) / safe, out)


def grow_tree(points: np.ndarray, seed: int) -> dict[str, list]:
    """Random splits until points are alone or the depth reaches log2 of the sample."""
    rng = np.random.default_rng(seed)
    limit = math.ceil(math.log2(max(len(points), 2)))
    nodes = {"feature": [], "threshold": [], "left": [], "right": [], "size": []}

    def add(rows: np.ndarray, depth: int) -> int:
        index = len(nodes["size"])
        for name, value in (("feature", -1), ("threshold", 0.0), ("left", -1), ("right", -1), ("size", len(rows))):
            nodes[name].append(value)
        spans = np.ptp(rows, axis=0) if len(rows) > 1 else np.zeros(points.shape[1])
        usable = np.flatnonzero(spans > 0)
        if depth >= limit or not len(usable):
            return index
        column = int(rng.choice(usable))
        low, high = rows[:, column].min(), rows[:, column].max()
        cut = float(rng.uniform(low, high))
        goes_left = rows[:, column] <= cut
        nodes["feature"][index], nodes["threshold"][index] = column, cut
        nodes["left"][index] = add(rows[goes_left], depth + 1)
        nodes["right"][index] = add(rows[~goes_left], depth + 1)
        return index

    add(points, 0)
    return nodes


def tree_depths(points: np.ndarray, tree: dict[str, np.ndarray]) -> np.ndarray:
    at = np.zeros(len(points), dtype=int)
    depth = np.zeros(len(points))
    inner = tree["feature"][at] >= 0
    while inner.any():
        rows = np.flatnonzero(inner)
        node = at[rows]
        goes_left = points[rows, tree["feature"][node]] <= tree["threshold"][node]
        at[rows] = np.where(goes_left, tree["left"][node], tree["right"][node])
        depth[rows] += 1
        inner = tree["feature"][at] >= 0
    return depth + path_length(tree["size"][at])


@dataclass
class IsolationForest:
    """Unsupervised classifier: anomalies count as useful.

    ``contamination`` is the share of anomalies in the training rows; ``"auto"``
    takes the fixed limit -0.5 on the score.
    """

    contamination: float | str = 0.1
    seed: int = 42
    trees: int = 100
    sample: int = 256

    def fit(self, rows: DataFrame, features: str = "features", y: str | None = None, key: str = "doc_id"):
        # Each tree draws from all rows by a hash of its own, a few more than it needs,
        # and keeps those with the smallest hash. Rows go to the trees that drew them.
        share = min(1.0, (self.sample + 8 * self.sample**0.5) / max(rows.count(), 1))
        limit = int(share * (1 << 40))

        def draw(tree):
            return F.pmod(F.xxhash64(F.col(key), tree, F.lit(self.seed)), F.lit(1 << 40))

        trees = F.filter(F.sequence(F.lit(0), F.lit(self.trees - 1)), lambda t: draw(t) < limit)
        drawn = rows.select(key, vector_to_array(features).alias("x"), F.explode(trees).alias("tree"))
        pick = Window.partitionBy("tree").orderBy(draw(F.col("tree")), key)
        drawn = drawn.withColumn("_rank", F.row_number().over(pick)).filter(F.col("_rank") <= self.sample)
        seed = self.seed

        def build(frame: pd.DataFrame) -> pd.DataFrame:
            tree = int(frame["tree"].iloc[0])
            points = np.vstack(frame.sort_values("_rank")["x"].to_numpy())
            nodes = grow_tree(points, seed * 1000 + tree)
            return pd.DataFrame([{"tree": tree, **nodes}])

        grown = drawn.groupBy("tree").applyInPandas(build, TREE_SCHEMA).collect()
        arrays = [
            {name: np.array(row[name]) for name in ("feature", "threshold", "left", "right", "size")} for row in grown
        ]
        model = FittedForest(arrays, features, key, -0.5)
        if self.contamination != "auto":
            scored = model.raw_scores(rows).persist()
            try:
                model.offset = quantile(scored, "score", float(self.contamination))
            finally:
                scored.unpersist()
        return model


@dataclass
class FittedForest:
    forest: list[dict[str, np.ndarray]]  # trees x at most 2 * sample nodes
    features: str
    key: str
    offset: float

    def raw_scores(self, rows: DataFrame) -> DataFrame:
        """``key, score``: the lower, the more isolated."""
        shared = rows.sparkSession.sparkContext.broadcast(self.forest)
        key = self.key

        def run(frames):
            trees = shared.value
            scale = path_length(max(int(t["size"][0]) for t in trees)) * len(trees)
            for frame in frames:
                points = np.vstack(frame["x"].to_numpy()) if len(frame) else np.zeros((0, 1))
                depth = sum((tree_depths(points, t) for t in trees), np.zeros(len(points)))
                yield pd.DataFrame({key: frame[key].to_numpy(), "score": -(2.0 ** (-depth / max(float(scale), 1e-12)))})

        kind = rows.schema[key].dataType.simpleString()
        return rows.select(key, vector_to_array(self.features).alias("x")).mapInPandas(run, f"{key} {kind}, score double")

    def score(self, rows: DataFrame) -> DataFrame:
        """``key, score, prediction``; 1 marks an anomaly."""
        sign = F.when(F.col("score") < self.offset, F.lit(-1)).otherwise(F.lit(1))
        return self.raw_scores(rows).withColumn("prediction", anomaly_to_label(sign))
