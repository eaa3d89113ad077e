"""Token ids of documents as files of coded blocks, in ascending order of their ids.

Documents are dealt out by ranges of doc_id and sorted, tokenised and coded within a range; a
range is one file. Files are Parquet tables of blocks (``file, block, payload``), so that
any store that Spark writes to holds them; a payload is self-contained (see
``coder``): whole documents with their ids, an index of them, and check sums. A block ends with
the document that fills it.

Reading needs only the payloads and one number for each file, the ids in it; these are
added up to say where every document begins in the whole.

A null or empty text is its end id alone. Null ids come first; repeated rows are
written as often as they come.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from .coder import BLOCK_IDS, read_block, write_block
from .common import arrow_map
from .tokens import tokenizer_path, word_encoder

_FILE = "file int, block int, docs long, ids long, payload binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, block_ids: int = BLOCK_IDS) -> None:
    """Write the ids of every document, each followed by ``end_id``, to files below ``path``."""
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, file = word_encoder(tokenizer), TaskContext.get().partitionId()
        names, counts, parts, size, number, before = [], [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), "<u4")
            payload = write_block(names, counts, ids, before)
            return pa.RecordBatch.from_pydict(
                {"file": [file], "block": [number], "docs": [len(names)], "ids": [len(ids)], "payload": [payload]},
                schema=pa.schema([("file", pa.int32()), ("block", pa.int32()), ("docs", pa.int64()), ("ids", pa.int64()), ("payload", pa.binary())]),
            )

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = encoder.encode(text or "") + end
                names.append(doc_id)
                counts.append(len(own) // 4)
                parts.append(own)
                size += len(own) // 4
                if size >= block_ids:
                    yield block()
                    names, counts, parts, size, number, before = [], [], [], 0, number + 1, before + size
        if names:
            yield block()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    ordered.mapInArrow(run, _FILE).write.parquet(path)


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the files, and ``ids`` (little-endian unsigned 32-bit) if kept."""
    blocks = spark.read.schema(_FILE).parquet(path)
    sums = blocks.groupBy("file").agg(F.sum("ids").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    firsts = sums.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))

    def work(batch: pa.RecordBatch) -> Iterable[dict]:
        for i in range(batch.num_rows):
            names, counts, ids, at = read_block(batch.column("payload")[i].as_py())
            raw = ids.astype("<u4").tobytes()
            stops = np.cumsum(counts)
            own = [raw[4 * a : 4 * b] for a, b in zip((stops - counts).tolist(), stops.tolist())]
            columns = {"doc_id": names, "start": at + batch.column("first")[i].as_py() + stops - counts, "n_tokens": counts}
            columns["ids_crc32"] = [zlib.crc32(x) for x in own]
            yield columns | ({"ids": own} if keep_ids else {})

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if keep_ids else "")
    return arrow_map(blocks.join(F.broadcast(firsts), "file").select("first", "payload"), work, schema)


def through_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Write all documents to a new folder below the shared one and read them back."""
    path = scratch_path(docs.sparkSession, "llm-tokens")
    write_tokens(docs, path, tokenizer or tokenizer_path("word_bpe_49k.json"), end_id)
    return read_tokens(docs.sparkSession, path)
