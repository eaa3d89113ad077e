"""Tables, scratch tables, and word arrays that the operators share."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize

#: Whole documents go through numpy in slices of about this many bytes; one longer document is a slice of its own.
SLICE_BYTES = 4 << 20
#: The same for hashed words, whose arrays take some forty times as much.
WORD_BYTES = 1 << 20

#: Bytes that separate words: space and \t \n \v \f \r.
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False

_RANDOM = np.random.default_rng(20240501)
_BYTE_CODE = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64)
_WORD_BASE = np.uint64(0x9E3779B97F4A7C13)
_PHRASE_BASE = np.uint64(0xC2B2AE3D27D4EB4B)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def with_bytes(docs: DataFrame, *columns: str, text: str = "text") -> DataFrame:
    """The named columns and ``text`` as UTF-8 bytes, the form in which tasks read it."""
    return docs.select(*columns, F.col(text).cast("binary").alias("text"))


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], Iterable[dict]], schema: str) -> DataFrame:
    """``work`` turns each Arrow batch into dicts of columns, in the order of ``schema``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for columns in work(batch):
                yield pa.RecordBatch.from_arrays([as_arrow(columns[f.name], f.type) for f in target], schema=target)

    return batch_map(df, run, schema)


def batch_map(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` whose workers give back, at the end of each task, what it has freed. They live on and wait beside the JVM."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return df.mapInArrow(whole, schema)


def trim() -> None:
    """Return free memory of this process to the system. The allocators of Arrow and of glibc (where it is used) keep it otherwise."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):
        give(0)


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, type=kind)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose ``column`` holds about ``limit`` bytes."""
    sizes = np.diff(_offsets(batch.column(column)))
    start = total = 0
    for i, size in enumerate(sizes.tolist()):
        if total and total + size > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if len(sizes) > start:
        yield batch.slice(start)


def _offsets(array: pa.Array) -> np.ndarray:
    return np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int32)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; a bijection."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """Words of a slice of documents as arrays.

    ``first[i]:first[i + 1]`` are the words of document i (null texts have none),
    ``start`` and ``end`` their byte ranges in ``data``, and ``code`` a 64-bit hash
    of each word.
    """

    def __init__(self, texts: pa.Array, lower: bool = False):
        offsets = _offsets(texts).astype(np.int64)
        buffer = texts.buffers()[2]
        data = np.frombuffer(buffer, np.uint8)[offsets[0] : offsets[-1]] if buffer and len(texts) else np.zeros(0, np.uint8)
        offsets = offsets - offsets[0]
        self.n = len(texts)
        if lower:
            data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        self.data = data
        word = _IS_WORD[data]
        opens = word.copy()
        opens[1:] &= ~word[:-1]
        inner = offsets[(offsets < len(data)) & (offsets > 0)]
        opens[inner] = word[inner]
        self.start = np.flatnonzero(opens)
        closes = word.copy()
        closes[:-1] &= ~word[1:]
        closes[inner - 1] = word[inner - 1]
        self.end = np.flatnonzero(closes) + 1
        self.first = np.searchsorted(self.start, offsets)

    @property
    def code(self) -> np.ndarray:
        lengths = self.end - self.start
        if not len(lengths):
            return np.zeros(0, np.uint64)
        offset = np.cumsum(lengths) - lengths
        inside = np.arange(int(lengths.sum())) - np.repeat(offset, lengths)
        letters = self.data[_IS_WORD[self.data]]
        weight = powers(_WORD_BASE, int(lengths.max()))
        sums = np.add.reduceat(_BYTE_CODE[letters] * weight[inside], offset)
        return mix(sums + lengths.astype(np.uint64))

    @property
    def owner(self) -> np.ndarray:
        """The document of each word."""
        return np.repeat(np.arange(self.n), np.diff(self.first))


class Phrases:
    """Hashes of any run of words, from prefix sums over their codes."""

    def __init__(self, code: np.ndarray):
        up = powers(_PHRASE_BASE, len(code) + 1)
        self.sums = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code * up[: len(code)], dtype=np.uint64, out=self.sums[1:])
        self.down = powers(np.uint64(pow(int(_PHRASE_BASE), -1, 2**64)), len(code) + 1)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start] + (end - start).astype(np.uint64))


class Lookup:
    """Numbers from 0 on by distinct 64-bit keys, for whole arrays of keys.

    A key stands at the first free place from where its hash points, in a table of four to eight times their number.
    """

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int64)
        left, at = np.arange(len(keys)), self._home(keys)
        while len(left):
            new = self.values[at] < 0
            self.values[at[new]], self.keys[at[new]] = values[left[new]], keys[left[new]]
            other = self.keys[at] != keys[left]
            left, at = left[other], (at[other] + 1) & self.last

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _WORD_BASE) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 for those that are not there."""
        at = self._home(keys)
        value = self.values.take(at)
        other = self.keys.take(at) != keys
        left = np.flatnonzero(other & (value >= 0))
        value[other] = -1
        while len(left):
            at[left] = near = (at[left] + 1) & self.last
            found = self.values[near]
            same = self.keys[near] == keys[left]
            value[left[same]] = found[same]
            left = left[~same & (found >= 0)]
        return value


def byte_phrases(data: bytes) -> Phrases:
    """Hashes of any run of bytes."""
    return Phrases(_BYTE_CODE[np.frombuffer(data, np.uint8)])


def ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many as its length, one after the other."""
    end = np.cumsum(length)
    return np.repeat(start - (end - length), length) + np.arange(int(end[-1]) if len(end) else 0)


def spaced(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """What texts (none of them null) have between their spaces: distinct parts, the number of the part at each place, and where a text's places begin."""
    parts = pc.split_pattern(texts, " ")
    coded = parts.flatten().dictionary_encode()
    first = np.append(0, np.cumsum(pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)))
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64), first


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: Ids go to all executors for a join if there are no more than these (16 MB); else both sides are shuffled.
BROADCAST_IDS = 2_000_000


def small(ids: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """``ids`` as a side of a join, sent to all executors up to ``limit`` rows, so that the other side stays where it is."""
    return F.broadcast(ids) if ids.count() <= limit else ids


def anti(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """Rows of ``docs`` whose key is not in ``gone``; null keys stay."""
    return docs.join(gone.select(key), key, "left_anti")


def free(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores before it until no column is called so (in any case)."""
    lower = {t.lower() for t in taken}
    while name.lower() in lower:
        name = "_" + name
    return name


#: Files of an intermediate table for each core of the cluster, at most. Many shuffle partitions of a few rows each cost
#: more to write than to compute.
FILES_PER_CORE = 6


def stored(df: DataFrame, name: str, coalesce: bool = True) -> DataFrame:
    """``df`` as a table in the shared folder, so that a lost executor costs no more than a reread.

    Without ``coalesce`` it has a file for each partition: for heavy rows, and for work that should not wait for few tasks.
    """
    if coalesce:
        df = df.coalesce(FILES_PER_CORE * df.sparkSession.sparkContext.defaultParallelism)
    return materialize(df, f"llm-{name}")
