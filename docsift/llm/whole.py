"""Vectors scaled to whole numbers, and inner products that are exact at any size.

A component x becomes floor(scale * x), for a scale that is a power of two: such products of doubles are exact. Inner products of
vectors whose components stay below ``plain_limit`` are sums of float64 that never leave the
whole numbers float64 holds; the others are multiplied as Python integers.
"""

from __future__ import annotations

import math
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

LONGS = -(2**63), 2**63 - 1


def sound(vector: Column) -> Column:
    """Whether a vector takes part: not null, and no component null, infinite or not a number."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return vector.isNotNull() & finite


def plain_limit(dims: int) -> float:
    """Sums of ``dims`` products of components up to this stay below 2**53."""
    return float(2 ** ((52 - math.ceil(math.log2(max(dims, 1)))) // 2))


def whole(component: float, scale: int) -> int:
    """floor(scale * component), also where the product is beyond float64."""
    return int(component) * scale if abs(component) >= 2.0**53 else math.floor(component * scale)


class Matrix:
    """Rows of vectors of one length as whole numbers.

    ``plain`` are the rows as float64 whose products with other plain rows are exact; rows that are not are zero
    there and are given in ``large`` as lists of integers by their number.
    """

    def __init__(self, raw: np.ndarray, scale: int):
        limit = plain_limit(raw.shape[1])
        with np.errstate(over="ignore"):
            self.plain = np.floor(raw * scale)
        big = np.flatnonzero((np.abs(self.plain) > limit).any(axis=1)) if raw.size else np.zeros(0, int)
        self.large = {int(i): [whole(x, scale) for x in raw[i].tolist()] for i in big}
        self.plain[big] = 0

    @cached_property
    def integers(self) -> np.ndarray:
        """All rows as Python integers."""
        out = self.plain.astype(np.int64).astype(object)
        for i, row in self.large.items():
            out[i] = row
        return out

    def exact(self, i: int, other: Matrix, rows: np.ndarray) -> np.ndarray:
        """Inner products of row i with rows of another matrix, as Python integers."""
        return (other.integers[rows] * self.integers[i]).sum(axis=1) if other.plain.shape[1] else np.zeros(len(rows), object)


def rows_by_length(batch: pa.RecordBatch, column: str):
    """``dims, rows, raw``: for each length of vector in a batch the numbers of its rows, and these as a matrix."""
    vectors = batch.column(column)
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    for dims in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == dims)
        yield dims, rows, vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), dims)


def clipped(score: int) -> tuple[int, bool]:
    """A score as a 64-bit integer, and whether it is one."""
    return min(max(score, LONGS[0]), LONGS[1]), LONGS[0] <= score <= LONGS[1]


def checked(score: str, fits: str) -> Column:
    """The score of a result row; the job fails where it is no 64-bit integer."""
    return F.when(F.col(fits), F.col(score)).otherwise(F.raise_error(F.lit("a score of the result does not fit a 64-bit integer")).cast("long"))
